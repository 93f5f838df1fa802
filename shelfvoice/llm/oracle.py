"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

COLLOCATIONS = r"""
WITH lowered AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), phrases AS (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
    UNION ALL
    SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
    UNION ALL
    SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words
), counts AS (
    SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY lang, k, phrase
), sizes AS (
    SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT lang, k, phrase, a, w, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM candidates
    UNION ALL
    SELECT lang, k, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.w, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f * t.f) AS score,
           row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000::HUGEINT * c.a * c.a) // (h.f * t.f), c.cut) AS place
    FROM cuts c
    JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
    JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest
), longer AS (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3
    UNION ALL
    SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3
), held AS (
    SELECT lang, phrase, max(a) AS most FROM longer GROUP BY lang, phrase
), ranked AS (
    SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score,
           row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
    WHERE s.place = 1 AND NOT coalesce(100 * h.most >= 50 * s.a, FALSE)
)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes ON sizes.lang = ranked.lang
WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": COLLOCATIONS}
