"""The registered queries as SQL over the same tables."""

from __future__ import annotations

# ------------------------------------------------------------------ pieces

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
FRESH = f"written_at > {NOW} - INTERVAL 10 DAY"


def _trim(c):
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _half_even(x, digits=2):
    return f"(round_even(({x}) * {10.0**digits}, 0) / {10.0**digits})"


def _share(a, b):
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0) * 100)"


def _pct(a, b, digits=2):
    return _half_even(_share(a, b), digits)


def _bucket(r):
    return f"CASE WHEN {r} <= 2 THEN 'negative' WHEN {r} <= 3 THEN 'neutral' WHEN {r} > 3 THEN 'positive' END"


def _normalise(c):
    out = f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"
    for phrase, short in (("5 stars", "5星"), ("4 stars", "4星"), ("3 stars", "3星"), ("2 stars", "2星"), ("1 star", "1星")):
        out = f"replace({out}, '{phrase}', '{short}')"
    return out


def _clean(c):
    for mark in "。，！？":
        c = f"replace({c}, '{mark}{mark}', '{mark}')"
    return c


def _chunks(c):
    """Greedy packing as a fold over structs (finished pieces, open piece)."""
    pieces = f"list_transform(string_split({c}, '. '), lambda s: {{'done': CAST([] AS VARCHAR[]), 'cur': s || '. ', 'raw': s}})"
    fold = (
        f"list_reduce({pieces}, lambda a, b: CASE WHEN length(a.cur || b.raw) < 4000 "
        "THEN {'done': a.done, 'cur': a.cur || b.cur, 'raw': ''} "
        "ELSE {'done': list_append(a.done, trim(a.cur)), 'cur': b.cur, 'raw': ''} END)"
    )
    return f"CASE WHEN length({c}) > 4000 THEN (SELECT list_append(f.done, trim(f.cur)) FROM (SELECT {fold} AS f)) ELSE [{c}] END"


RAW = """raw AS (
  SELECT ' A' || l_partkey || ' ' AS "Asin", chr(160) || 'line ' || l_linenumber || chr(9) AS "Title",
         'order ' || l_orderkey || ' ' || chr(10) AS "Content", '  ' || l_returnflag || l_linestatus || ' ' AS "Model",
         CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(ceil(l_quantity / 10) AS INT) AS VARCHAR) END AS "Rating",
         CASE WHEN l_linenumber = 6 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "Date", lineitem.*
  FROM lineitem)"""
LINE = f"""line AS (
  SELECT 'A' || l_partkey AS "Asin", l_returnflag || l_linestatus AS "Model", CAST(ceil(l_quantity / 10) AS DOUBLE) AS "Rating",
         l_shipdate AS "Date", {_bucket('ceil(l_quantity / 10)')} AS "Review Type", {ORDER}
  FROM lineitem)"""
RAW_BRAND = "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 2 THEN '  ' END"
BR = f"""br AS (
  SELECT 'A' || p_partkey AS asin, nullif(trim({RAW_BRAND}), '') AS brand, {RAW_BRAND} AS raw_brand, 'A' || (p_partkey + 1) AS parent,
         p_partkey AS ord
  FROM part)"""
# In BR product and parent keys are unique, so no dedupe is needed here.
BRANDED = f"""{LINE}, {BR}, branded AS (
  SELECT line.*, coalesce(a.brand, b.brand) AS "Brand"
  FROM line LEFT JOIN br a ON line."Asin" = a.asin LEFT JOIN br b ON line."Asin" = b.parent)"""
TEXT = f"""rated AS (
  SELECT d.doc_id AS "ID", d.source AS "Asin", d.lang || ' ' || d.source AS "Title", d.lang AS "Model", d.text AS "Content",
         CAST(CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 AND l.toxic = 0 THEN 5
                   WHEN l.quality = 1 THEN 3 ELSE 1 END AS DOUBLE) AS "Rating",
         CAST(CASE WHEN d.doc_id % 50 = 7 THEN NULL
                   ELSE DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) END AS TIMESTAMP) AS "Date"
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
text_reviews AS (SELECT *, {_bucket('"Rating"')} AS "Review Type" FROM rated)"""
LEX = """lex AS (
  SELECT * FROM (VALUES ('topic', 'thing', 'thing'), ('topic', 'thing', 'heed'), ('topic', 'notice', 'license'),
    ('topic', 'notice', '@'), ('lang', 'german', 'und'), ('lang', 'french', 'que la'), ('lang', 'none', 'zzqx')) t(main, sub, keyword))"""
HITS = f"""{TEXT}, {LEX}, hits AS (
  SELECT "ID", "Rating", main, sub, keyword FROM text_reviews JOIN lex ON contains(lower("Content"), lower(keyword)))"""
MATCHED = f"""{HITS}, matched AS (
  SELECT r."ID", r."Rating", count(h.keyword) AS "Match_Count", coalesce(string_agg(h.keyword, '|' ORDER BY h.keyword), '') AS matches
  FROM text_reviews r LEFT JOIN hits h ON r."ID" = h."ID" GROUP BY r."ID", r."Rating")"""
FLAGS = ", ".join(
    f"coalesce({test}, false) AS is_{name}"
    for name, test in (
        ("lang__french", """contains(lower("Content"), 'que la')"""),
        ("lang__german", """contains(lower("Content"), 'und')"""),
        ("lang__none", """contains(lower("Content"), 'zzqx')"""),
        ("topic__notice", """(contains(lower("Content"), 'license') OR contains(lower("Content"), '@'))"""),
        ("topic__thing", """(contains(lower("Content"), 'thing') OR contains(lower("Content"), 'heed'))"""),
    )
)
CATEGORIES = f"""{HITS}, stats AS (
  SELECT c.main, c.sub, count(DISTINCT h."ID") AS matched, {_pct('count(DISTINCT h."ID")', '(SELECT count(*) FROM text_reviews)')} AS pct,
         (SELECT count(*) FROM text_reviews) - count(DISTINCT h."ID") AS unmatched
  FROM (SELECT DISTINCT main, sub FROM lex) c LEFT JOIN hits h ON c.main = h.main AND c.sub = h.sub GROUP BY c.main, c.sub)"""
FREQUENCY = f"""{HITS}, freq AS (SELECT main, sub, keyword, count(*) AS n FROM hits GROUP BY ALL)"""
# The syllables of views.SYLLABLES: consonant, vowel, consonant; main is the vowel, sub the first consonant.
SYLLABLES = """syllables AS (
  SELECT v AS main, c AS sub, c || v || d AS keyword
  FROM (SELECT unnest(string_split('lmnrst', '')) AS c), (SELECT unnest(string_split('aeiou', '')) AS v),
       (SELECT unnest(string_split('lmnrst', '')) AS d)),
syllable_hits AS (SELECT "ID", main, sub, keyword FROM text_reviews JOIN syllables ON contains(lower("Content"), keyword))"""
STOP = "stop AS (SELECT unnest(['the', 'and', 'der', 'that', 'don', 't']) AS word)"
TOKENS = """tokens AS (
  SELECT "ID", "Review Type", list_filter(regexp_split_to_array(lower("Content"), '[^\\p{L}\\p{N}_]+'),
                                          lambda w: regexp_full_match(w, '[a-z0-9]+')) AS words FROM text_reviews)"""
COUNTS = f"""{TEXT}, {TOKENS}, {STOP}, counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM tokens)
  WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stop) GROUP BY word)"""
PART_ENTRIES = """entries AS (
  SELECT p_type AS main, p_brand AS sub, replace(p_name, ' ', ' , ,') || ',' || p_name AS keywords FROM part)"""
PART_WORDS = f"""{PART_ENTRIES}, part_words AS (
  SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT unnest(string_split(keywords, ',')) AS w FROM entries) WHERE trim(w) <> '')"""
OPENINGS = """openings AS (
  SELECT DISTINCT coalesce(lang, 'none') AS main, coalesce(source, 'none') AS sub, substring(text, 1, 14) AS keyword
  FROM documents WHERE length(trim(substring(text, 1, 14), ' ')) >= 4),
opening_hits AS (SELECT doc_id AS "ID", main, sub, keyword FROM documents JOIN openings ON contains(lower(text), lower(keyword)))"""
PART_PAIRS = f"""{PART_ENTRIES}, part_keys AS (
  SELECT DISTINCT main, sub, trim(k) AS keyword FROM (SELECT main, sub, unnest(string_split(keywords, ',')) AS k FROM entries) WHERE trim(k) <> '')"""
CACHE = "cache AS (SELECT md5(CAST(user_id AS VARCHAR)) AS cache_key, event_type AS value, ts AS written_at FROM events)"
VALID = f"""{CACHE}, valid AS (
  SELECT cache_key, value, written_at FROM cache WHERE {FRESH}
  QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY written_at DESC, value DESC) = 1)"""
REQUESTS = "requests AS (SELECT DISTINCT md5(CAST(o_custkey AS VARCHAR)) AS cache_key, CAST(o_custkey AS VARCHAR) AS text FROM orders)"
MARKED = _clean("array_to_string(list_transform(pieces, lambda p: '[x] ' || p), ' ')")
PART_CACHED = f"""{TEXT}, masked AS (
  SELECT "ID", CASE WHEN "ID" % 10 <> 3 THEN {_normalise('"Content"')} END AS norm, {_normalise('"Content"')} AS full_norm, "Model"
  FROM text_reviews),
known AS (SELECT DISTINCT full_norm FROM masked WHERE "Model" = 'de'),
cut AS (SELECT "ID", norm, {_chunks('norm')} AS pieces, norm IN (SELECT full_norm FROM known) AS is_known FROM masked),
done AS (
  SELECT "ID", norm, pieces, CASE WHEN coalesce(norm, '') = '' THEN 'blank' WHEN is_known THEN 'cached'
              WHEN contains(norm, 'license') OR contains(norm, 'heed') OR contains(norm, 'than') THEN 'failed' ELSE 'done' END AS status
  FROM cut)"""


def _group_stats(cte, view, key):
    return f"""WITH {cte} SELECT {key} AS grp, count("Rating") AS n_reviews, {_half_even('avg("Rating")')} AS avg_rating,
      {_half_even('stddev_samp("Rating")')} AS std_rating FROM {view} WHERE {key} IS NOT NULL GROUP BY {key}"""


def _level(name, key):
    types = ", ".join(f"""count(*) FILTER ("Review Type" = '{t}') AS n_{t}""" for t in ("positive", "neutral", "negative"))
    shares = ", ".join(f"""{_share(f'count(*) FILTER ("Rating" = {r})', 'count("Rating")')} AS rating_{r}""" for r in range(1, 6))
    other = _share('count(*) FILTER ("Rating" NOT IN (1, 2, 3, 4, 5))', 'count("Rating")')
    return f"""SELECT '{name}' AS level, {key} AS grp, count("Rating") AS n_reviews, {_half_even('avg("Rating")')} AS avg_rating,
      {_half_even('stddev_samp("Rating")')} AS std_rating, {types}, {shares}, {other} AS rating_other FROM branded WHERE {key} IS NOT NULL GROUP BY {key}"""


def _crosstab(key, extra=""):
    return f"""WITH {LINE}, c AS (SELECT {key} AS grp, "Rating", count(*) AS n_reviews FROM line
      WHERE {key} IS NOT NULL AND "Rating" IS NOT NULL {extra} GROUP BY ALL)
      SELECT grp, "Rating", n_reviews, {_share('n_reviews', 'sum(n_reviews) OVER (PARTITION BY grp)')} AS pct FROM c"""


def _processed(numbered, asin="trim(num.\"Asin\")"):
    return f"""WITH {numbered}, {BR}
      SELECT "ID", {asin} AS "Asin", coalesce(a.brand, b.brand) AS "Brand", {_trim('"Title"')} AS "Title",
        {_trim('"Content"')} AS "Content", {_trim('"Model"')} AS "Model", TRY_CAST("Rating" AS DOUBLE) AS "Rating",
        TRY_CAST("Date" AS TIMESTAMP) AS "Date", {_bucket('TRY_CAST("Rating" AS DOUBLE)')} AS "Review Type"
      FROM num LEFT JOIN br a ON {asin} = a.asin LEFT JOIN br b ON {asin} = b.parent"""


ORDER_REVIEWS = """num AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS "ID", 'A' || o_custkey AS "Asin", o_orderpriority AS "Title",
         'order ' || o_orderkey AS "Content", o_orderstatus AS "Model", CAST(CAST(ceil(o_totalprice / 100000) AS INT) AS VARCHAR) AS "Rating",
         strftime(o_orderdate, '%Y-%m-%d') AS "Date" FROM orders)"""
RAW_COLUMNS = '"Asin", "Title", "Content", "Model", "Rating", "Date"'


def oracle_sql() -> dict[str, str]:
    text = f"WITH {TEXT} "
    line = f"WITH {LINE} "
    branded = f"WITH {BRANDED} "
    raw = f"WITH {RAW} "
    bam = """("Brand" || ' - ' || "Asin" || ' - ' || "Model")"""
    am = """("Asin" || ' - ' || "Model")"""
    out = {
        "scan_reviews_csv": f"{raw} SELECT {RAW_COLUMNS} FROM raw",
        "scan_reviews_json": f"{raw} SELECT {RAW_COLUMNS} FROM raw",
        "scan_brands": f"""WITH {BR} SELECT asin || ' ' AS "ASIN", raw_brand AS "Brand", parent AS "Parent ASIN", true AS has_parent FROM br""",
        "write_tsv": text
        + """SELECT CAST("ID" AS VARCHAR) AS "ID", "Title", "Content", CAST("Rating" AS VARCHAR) AS "Rating",
             strftime("Date", '%Y-%m-%d %H:%M:%S') AS "Date" FROM text_reviews""",
        "write_results": text + "SELECT * FROM text_reviews",
        "export_projection": text
        + """SELECT "ID", "Asin", "Title", "Model", "Rating", "Date", "Review Type", '[x] ' || "Content" AS "Content_zh" FROM text_reviews""",
        "cache_file_scan": "SELECT 'value=' || event_type AS folder, 33 * count(*) AS n_bytes, true AS has_time FROM events GROUP BY event_type",
        "cache_storage": """SELECT 'value=' || event_type AS folder, CAST(1 AS BIGINT) AS n_files, 33 * count(*) AS n_bytes FROM events GROUP BY event_type
            UNION ALL SELECT NULL, count(DISTINCT event_type), 33 * count(*) FROM events""",
        # cleaning
        "process_reviews": _processed(
            f"""{RAW}, num AS (SELECT row_number() OVER (ORDER BY {ORDER}) AS "ID", {RAW_COLUMNS} FROM raw)"""
        ),
        "process_reviews_file_order": _processed(ORDER_REVIEWS),
        "project_required": f"{raw} SELECT {RAW_COLUMNS} FROM raw",
        "coerce_rating": f"""{raw} SELECT {ORDER}, TRY_CAST("Rating" AS DOUBLE) AS "Rating" FROM raw""",
        "coerce_date": f"""{raw} SELECT {ORDER}, TRY_CAST("Date" AS TIMESTAMP) AS "Date" FROM raw""",
        "trim_text": f"""{raw} SELECT {ORDER}, {_trim('"Asin"')} AS "Asin", {_trim('"Title"')} AS "Title",
            {_trim('"Content"')} AS "Content", {_trim('"Model"')} AS "Model" FROM raw""",
        "row_ids": """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "ID", o_orderkey, o_totalprice FROM orders""",
        "row_ids_file_order": f"""WITH {ORDER_REVIEWS} SELECT "ID", "Content" FROM num""",
        "rating_bucket": text + """SELECT "ID", "Review Type" AS review_type FROM text_reviews""",
        "canonical_order": text + """SELECT "ID", "Asin", "Date", "Review Type" FROM text_reviews""",
        "group_key": branded + f"SELECT {ORDER}, {bam} AS grp FROM branded",
        "month_bucket": text + """SELECT "ID", strftime("Date", '%Y-%m') AS month FROM text_reviews""",
        "normalise_brands": f"""WITH {BR} SELECT asin AS "ASIN", brand AS "Brand", parent AS "Parent ASIN", ord FROM br""",
        "tag_projection": text
        + """SELECT "ID", "Content", "Review Type" AS "Original Review Type", upper("Model") AS "Translation" FROM text_reviews""",
        # filters
        "facet_filter": branded
        + """SELECT * FROM branded WHERE "Brand" = 'Brand#7' AND "Rating" = 5 AND "Review Type" = 'positive'""",
        "row_range": text
        + """SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER (ORDER BY "ID") AS pos FROM text_reviews
             WHERE "Review Type" = 'positive') WHERE pos > 10 AND pos <= 60""",
        "row_range_long": """SELECT * EXCLUDE (pos, o_orderkey), o_orderkey AS "ID" FROM (
             SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders)
             WHERE pos > 100 AND pos <= 20000""",
        "min_length": text + """SELECT "ID", "Content" FROM text_reviews WHERE length("Content") >= 200""",
        "in_list": line + """SELECT * FROM line WHERE "Asin" IN ('A1', 'A17', 'A150')""",
        "type_filter_ci": text + """SELECT "ID", "Review Type" FROM text_reviews WHERE lower("Review Type") = 'positive'""",
        "flag_filter": text
        + f"""SELECT "ID", "Content", "Review Type" AS "Original Review Type", {FLAGS} FROM text_reviews
             WHERE contains(lower("Content"), 'thing') OR contains(lower("Content"), 'heed')""",
        "rating_thresholds": line
        + f"""SELECT count(*) AS n_reviews, count(*) FILTER ("Rating" >= 4) AS n_high, count(*) FILTER ("Rating" <= 2) AS n_low,
             {_half_even('avg("Rating")')} AS avg_rating FROM line""",
        "matched_only": f"""WITH {MATCHED} SELECT "ID", "Match_Count" FROM matched WHERE "Match_Count" > 0""",
        "nonblank": text + """SELECT "ID", "Content" FROM text_reviews WHERE "ID" % 3 <> 0 AND "ID" % 5 <> 0 AND trim("Content") <> ''""",
        "nonzero_share": f"""WITH t AS ({_crosstab(am)}) SELECT grp, 'rating_' || CAST("Rating" AS INT) AS rating, pct FROM t""",
        "filter_selectivity": text
        + f"""SELECT count(*) FILTER (k) AS n_kept, count(*) AS n_all, {_half_even('avg("Rating") FILTER (k)', 1)} AS avg_rating,
             {_pct('count(*) FILTER (k)', 'count(*)', 1)} AS pct_kept
             FROM (SELECT *, coalesce("Review Type" = 'positive' AND length("Content") >= 200, false) AS k FROM text_reviews)""",
        "facets": branded
        + """SELECT DISTINCT facet, value FROM (SELECT 'Brand' AS facet, "Brand" AS value FROM branded UNION ALL
             SELECT 'Asin', "Asin" FROM branded UNION ALL SELECT 'Rating', CAST("Rating" AS VARCHAR) FROM branded UNION ALL
             SELECT 'Review Type', "Review Type" FROM branded) WHERE value IS NOT NULL""",
        "facet_values": branded + """SELECT DISTINCT "Brand" AS value FROM branded WHERE "Brand" IS NOT NULL""",
        # joins
        "brand_join": f"""WITH {LINE}, {BR} SELECT line.*, a.brand AS "Brand" FROM line LEFT JOIN br a ON line."Asin" = a.asin""",
        "brand_join_parent": branded + "SELECT * FROM branded",
        "brand_dedupe": f"""WITH {BR}, dup AS (SELECT asin || ' ' AS asin, 'stale' AS brand, parent, -1 AS ord FROM br
             UNION ALL SELECT asin || ' ', raw_brand, parent, ord FROM br)
             SELECT asin AS "ASIN", brand AS "Brand", parent AS "Parent ASIN", CAST(ord AS BIGINT) AS ord
             FROM dup QUALIFY row_number() OVER (PARTITION BY asin ORDER BY ord DESC) = 1""",
        "brand_match_report": f"""WITH {LINE}, {BR}, j AS (
             SELECT a.brand AS direct, b.brand AS parent FROM line LEFT JOIN br a ON line."Asin" = a.asin LEFT JOIN br b ON line."Asin" = b.parent)
             SELECT count(*) AS total, count(coalesce(direct, parent)) AS matched, count(direct) AS first_round,
               count(*) FILTER (direct IS NULL AND parent IS NOT NULL) AS second_round,
               {_pct('count(coalesce(direct, parent))', 'count(*)', 1)} AS match_rate FROM j""",
        "attach_labels": text + f"SELECT *, {FLAGS} FROM text_reviews",
        "lexicon_join": f"""WITH {HITS} SELECT "ID", main, sub, keyword FROM hits""",
        "dense_types": line
        + """SELECT d.t AS review_type, count(r."Asin") AS n_reviews FROM (VALUES ('positive'), ('neutral'), ('negative')) d(t)
             LEFT JOIN line r ON r."Review Type" = d.t AND d.t <> 'neutral' GROUP BY d.t""",
        "cache_split": f"""WITH {VALID}, {REQUESTS} SELECT r.cache_key, v.value, v.value IS NOT NULL AS is_hit
             FROM requests r LEFT JOIN valid v ON r.cache_key = v.cache_key""",
        # statistics
        "overview": text
        + f"""SELECT count(*) AS n_reviews, {_half_even('avg("Rating")')} AS avg_rating, count(*) FILTER ("Review Type" = 'positive') AS n_positive,
             count(*) FILTER ("Review Type" = 'negative') AS n_negative FROM text_reviews""",
        "span_overview": line
        + """SELECT count(DISTINCT "Asin") AS n_products, strftime(min("Date"), '%Y-%m') AS first_month,
             strftime(max("Date"), '%Y-%m') AS last_month FROM line""",
        "review_type_stats": text
        + f"""SELECT "Review Type" AS review_type, count(*) AS n_reviews, {_pct('count(*)', '(SELECT count(*) FROM text_reviews)')} AS pct
             FROM text_reviews WHERE "Review Type" IS NOT NULL GROUP BY "Review Type" """,
        "rating_histogram": text
        + """SELECT "Rating", count(*) AS n_reviews FROM text_reviews WHERE "Rating" IS NOT NULL GROUP BY "Rating" """,
        "group_stats_asin": _group_stats(LINE, "line", '"Asin"'),
        "group_stats_brand": _group_stats(BRANDED, "branded", '"Brand"'),
        "group_stats_asin_model": _group_stats(LINE, "line", am),
        "group_stats_brand_asin_model": _group_stats(BRANDED, "branded", bam),
        "group_report": f"""WITH {BRANDED}, g AS (SELECT "Brand" AS grp, count("Rating") AS n_reviews, {_half_even('avg("Rating")')} AS avg_rating,
             {_half_even('stddev_samp("Rating")')} AS std_rating FROM branded WHERE "Brand" IS NOT NULL GROUP BY "Brand")
             SELECT g.*, "Review Type" AS review_type, count(*) AS n_of_type FROM g JOIN branded b ON g.grp = b."Brand"
             WHERE "Review Type" IS NOT NULL GROUP BY ALL""",
        "group_type_map": line + f"""SELECT {am} AS grp, "Review Type" AS review_type, count(*) AS n_reviews FROM line GROUP BY ALL""",
        "group_levels": f"WITH {BRANDED} "
        + " UNION ALL ".join(
            _level(name, key)
            for name, key in (
                ("Brand", '"Brand"'), ("Asin", '"Asin"'), ("Model", '"Model"'), ("Asin - Model", am), ("Brand - Asin - Model", bam),
            )
        ),
        "rating_crosstab": _crosstab('"Asin"'),
        "rating_crosstab_wide": branded
        + 'SELECT "Brand" AS grp, '
        + ", ".join(f"""{_share(f'count(*) FILTER ("Rating" = {r})', 'count("Rating")')} AS rating_{r}""" for r in range(1, 6))
        + f""", {_share('count(*) FILTER ("Rating" NOT IN (1, 2, 3, 4, 5))', 'count("Rating")')} AS rating_other FROM branded WHERE "Brand" IS NOT NULL GROUP BY "Brand" """,
        "group_stats_multikey": branded
        + f"""SELECT "Brand", "Model", count("Rating") AS n_reviews, {_half_even('avg("Rating")')} AS avg_rating,
             {_half_even('stddev_samp("Rating")')} AS std_rating FROM branded WHERE "Brand" IS NOT NULL AND "Model" IS NOT NULL GROUP BY ALL""",
        "trend_overall": text
        + f"""SELECT strftime("Date", '%Y-%m') AS month, avg("Rating") AS avg_rating FROM text_reviews
             WHERE "Date" IS NOT NULL GROUP BY month""",
        "trend_asin": line
        + f"""SELECT strftime("Date", '%Y-%m') AS month, "Asin" AS grp, avg("Rating") AS avg_rating FROM line
             WHERE "Date" IS NOT NULL GROUP BY month, grp""",
        "trend_brand": branded
        + f"""SELECT strftime("Date", '%Y-%m') AS month, "Brand" AS grp, avg("Rating") AS avg_rating FROM branded
             WHERE "Date" IS NOT NULL AND "Brand" IS NOT NULL GROUP BY month, grp""",
        "rating_shares": _crosstab(am, f"AND {am} = 'A17 - AF'"),
        "completeness": text
        + "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count("{c}") AS n_present, count(*) - count("{c}") AS n_missing,
                {_pct(f'count("{c}")', 'count(*)', 1)} AS pct_present FROM text_reviews"""
            for c in ("Title", "Content", "Rating", "Date", "Review Type")
        )
        + ")",
        "dataset_profile": text
        + """SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, CAST(5 AS BIGINT) AS n_text_columns, 'Title,Content' AS enrichable,
             greatest(count("Title"), count("Content")) AS n_texts, count(*) = 0 AS is_empty FROM text_reviews""",
        "preview": text + """SELECT * FROM text_reviews ORDER BY "ID" LIMIT 10""",
        "sample_values": text
        + """SELECT "ID", CASE WHEN length("Content") > 100 THEN substr("Content", 1, 100) || '...' ELSE "Content" END AS preview
             FROM text_reviews WHERE "Content" IS NOT NULL ORDER BY "ID" LIMIT 3""",
        # words
        "tokenise": f"""WITH {TEXT}, {TOKENS} SELECT "ID", array_to_string(words, ' ') AS tokens FROM tokens""",
        "word_freq": f"WITH {COUNTS} SELECT word, n FROM counts",
        "word_freq_negative": f"""WITH {TEXT}, {TOKENS}, {STOP}, {PART_WORDS}
             SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM tokens WHERE "Review Type" = 'positive')
             WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stop) AND word NOT IN (SELECT word FROM part_words)
               AND word NOT IN ('thing', 'heed') GROUP BY word""",
        "vocab_stats": f"""WITH {TEXT}, {TOKENS}, {STOP} SELECT (SELECT count(*) FROM text_reviews) AS n_reviews,
             (SELECT count(*) FROM text_reviews WHERE "Review Type" = 'negative') AS n_analysed, count(DISTINCT word) AS n_words
             FROM (SELECT unnest(words) AS word FROM tokens WHERE "Review Type" = 'negative')
             WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stop)""",
        "top_words": f"WITH {COUNTS} SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 50",
        "cloud_weights": f"""WITH {COUNTS} SELECT word, n, CAST(n AS DOUBLE) / max(n) OVER () AS weight
             FROM (SELECT * FROM counts ORDER BY n DESC, word LIMIT 150)""",
        "stop_union": f"WITH {PART_WORDS} SELECT word FROM part_words UNION SELECT unnest(['the', 'and', 'der', 'that', 'don''t'])",
        "words_add": f"WITH {PART_WORDS} SELECT word FROM part_words UNION SELECT unnest(['the', 'and', 'der', 'that', 'don''t'])",
        "words_remove": f"WITH {PART_WORDS} SELECT word FROM part_words WHERE word NOT IN (SELECT p_name FROM part WHERE p_size > 45)",
        # lexicon
        "lexicon_normalise": f"""WITH {PART_ENTRIES} SELECT DISTINCT main, sub, trim(k) AS keyword
             FROM (SELECT main, sub, unnest(string_split(keywords, ',')) AS k FROM entries) WHERE trim(k) <> ''""",
        "lexicon_upsert": """SELECT DISTINCT p_type AS main, p_brand AS sub, p_name AS keyword FROM part p WHERE p_size >= 45
             OR (p_size <= 44 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= 45 AND q.p_type = p.p_type AND q.p_brand = p.p_brand))""",
        "lexicon_delete": """SELECT DISTINCT p_type AS main, p_brand AS sub, p_name AS keyword FROM part p
             WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size = 45 AND q.p_type = p.p_type AND q.p_brand = p.p_brand)""",
        "lexicon_upgrade": """SELECT coalesce(k.main, 'other') AS main, p_name AS sub, lower(p_brand) AS keywords FROM part LEFT JOIN
             (SELECT p_name AS name, min(p_type) AS main FROM part WHERE p_size < 2 GROUP BY p_name) k ON p_name = k.name""",
        "match_array": f"""WITH {MATCHED} SELECT "ID", matches, "Match_Count" FROM matched""",
        "category_flags": text + f"""SELECT "ID", "Content", "Review Type" AS "Original Review Type", {FLAGS} FROM text_reviews""",
        "category_stats": f"WITH {CATEGORIES} SELECT * FROM stats",
        "keyword_frequency": f"WITH {FREQUENCY} SELECT * FROM freq",
        "category_stats_many": f"""WITH {TEXT}, {SYLLABLES}
             SELECT c.main, c.sub, count(DISTINCT h."ID") AS matched, {_pct('count(DISTINCT h."ID")', '(SELECT count(*) FROM text_reviews)')} AS pct,
               (SELECT count(*) FROM text_reviews) - count(DISTINCT h."ID") AS unmatched
             FROM (SELECT DISTINCT main, sub FROM syllables) c LEFT JOIN syllable_hits h ON c.main = h.main AND c.sub = h.sub GROUP BY c.main, c.sub""",
        "keyword_frequency_many": f"WITH {TEXT}, {SYLLABLES} SELECT main, sub, keyword, count(*) AS n FROM syllable_hits GROUP BY ALL",
        "lexicon_pairs_openings": f"""WITH {OPENINGS} SELECT * FROM opening_hits""",
        "keyword_frequency_openings": f"""WITH {OPENINGS} SELECT main, sub, keyword, count(*) AS n FROM opening_hits GROUP BY ALL""",
        "category_stats_openings": f"""WITH {OPENINGS}
             SELECT c.main, c.sub, count(DISTINCT h."ID") AS matched, {_pct('count(DISTINCT h."ID")', '(SELECT count(*) FROM documents)')} AS pct,
               (SELECT count(*) FROM documents) - count(DISTINCT h."ID") AS unmatched
             FROM (SELECT DISTINCT main, sub FROM openings) c LEFT JOIN opening_hits h ON c.main = h.main AND c.sub = h.sub GROUP BY c.main, c.sub""",
        "keyword_frequency_parts": f"""WITH {PART_PAIRS} SELECT main, sub, keyword, count(*) AS n
             FROM documents JOIN part_keys ON contains(lower(text), lower(keyword)) GROUP BY ALL""",
        "match_summary": f"""WITH {MATCHED} SELECT count(*) AS total_reviews, count(*) FILTER ("Match_Count" > 0) AS matched_reviews,
             {_share('count(*) FILTER ("Match_Count" > 0)', 'count(*)')} AS match_rate FROM matched""",
        "match_by_rating": f"""WITH {MATCHED} SELECT "Rating", count(*) AS n_reviews, {_half_even('avg("Match_Count")')} AS avg_matches
             FROM matched WHERE "Match_Count" > 0 AND "Rating" IS NOT NULL GROUP BY "Rating" """,
        "match_keyword_counts": f"WITH {HITS} SELECT keyword, count(*) AS n FROM hits GROUP BY keyword",
        "match_rating_counts": f"""WITH {MATCHED} SELECT "Rating", count(*) AS n_reviews FROM matched
             WHERE "Match_Count" > 0 AND "Rating" IS NOT NULL GROUP BY "Rating" """,
        "top_keywords": f"""WITH {FREQUENCY} SELECT * FROM freq
             QUALIFY row_number() OVER (PARTITION BY main, sub ORDER BY n DESC, keyword) <= 1""",
        "category_ranking": f"WITH {CATEGORIES} SELECT *, row_number() OVER (ORDER BY matched, main, sub) AS rank FROM stats",
        "top_categories": f"WITH {CATEGORIES} SELECT * FROM stats ORDER BY pct DESC, main, sub LIMIT 3",
        # enrichment
        "normalise_text": text + f"""SELECT "ID", {_normalise('"Content"')} AS normalised FROM text_reviews""",
        "clean_output": text
        + f"""SELECT "ID", {_clean('''replace(replace("Content", '.', '。。。'), ',', '，，')''')} AS cleaned FROM text_reviews""",
        "chunk_text": f"""WITH {TEXT}, n AS (SELECT "ID", {_normalise('"Content"')} AS norm FROM text_reviews),
             c AS (SELECT "ID", {_chunks('norm')} AS pieces FROM n)
             SELECT "ID", CAST(unnest(range(len(pieces))) AS BIGINT) AS pos, unnest(pieces) AS piece FROM c""",
        "render_prompt": text
        + """SELECT "ID", CASE "ID" % 3 WHEN 0 THEN 'Label ' || "Content" || ' as {kind}' WHEN 1 THEN "Content" || ': good or bad?'
             ELSE 'no slot' END AS prompt FROM text_reviews""",
        "cache_key": text + """SELECT "ID", md5("Content" || '_google_en_zh') AS cache_key FROM text_reviews""",
        "preview_text": text
        + """SELECT "ID", CASE WHEN length("Content") > 50 THEN substr("Content", 1, 50) || '...' ELSE "Content" END AS preview FROM text_reviews""",
        "error_class": """SELECT o_orderkey, CASE WHEN contains(k, '404') THEN 'not_found' WHEN contains(k, '401') THEN 'unauthorized'
             WHEN contains(k, '429') THEN 'rate_limited' WHEN o_orderkey % 7 = 0 THEN 'timeout' ELSE 'other' END AS error_class
             FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""",
        "enrich_columns": f"""WITH {TEXT}, n AS (SELECT "ID", {_normalise('"Content"')} AS norm FROM text_reviews),
             c AS (SELECT "ID", norm, {_chunks('norm')} AS pieces FROM n)
             SELECT "ID", CASE WHEN norm = '' THEN '' ELSE {MARKED} END AS "Content_zh" FROM c""",
        "enrich_two_columns": f"""WITH {TEXT}, n AS (SELECT "ID", "Title", {_normalise('"Content"')} AS norm FROM text_reviews),
             c AS (SELECT "ID", "Title", norm, {_chunks('norm')} AS pieces FROM n)
             SELECT "ID", CASE WHEN "ID" % 4 <> 0 THEN '[x] ' || "Title" ELSE '' END AS "Title_zh",
               CASE WHEN norm = '' THEN '' ELSE {MARKED} END AS "Content_zh" FROM c""",
        "label_tasks": text
        + f"""SELECT "ID", CASE WHEN {_trim('"Content"')} = '' THEN '' ELSE {_trim("'[x] Theme of: ' || " + '"Content"')} END AS theme,
             '[x] Origin of ' || "Title" || ', see {{notes}}' AS origin, '[x] Same for all' AS fixed FROM text_reviews""",
        "enrich_failures": f"""WITH {PART_CACHED} SELECT "ID", status,
             CASE WHEN status = 'failed' THEN CASE WHEN contains(norm, 'license') THEN 'rate_limited' WHEN contains(norm, 'heed') THEN 'timeout' ELSE 'other' END END AS error_class,
             CASE status WHEN 'blank' THEN '' WHEN 'cached' THEN 'kept' WHEN 'done' THEN {MARKED}
               ELSE '[error: ' || CASE WHEN length(norm) > 50 THEN substr(norm, 1, 50) || '...' ELSE norm END || ']' END AS "Content_zh"
             FROM done""",
        "job_counters": f"""WITH {PART_CACHED} SELECT count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed,
             count(*) FILTER (status = 'cached') AS n_cached, count(*) FILTER (status = 'blank') AS n_blank,
             {_pct("count(*) FILTER (status IN ('done', 'cached'))", "count(*) FILTER (status IN ('done', 'cached', 'failed'))", 1)} AS pct_success
             FROM done""",
        "cache_read_through": f"""WITH {VALID}, {REQUESTS} SELECT r.cache_key, coalesce(v.value, '[x] ' || r.text) AS value,
             CASE WHEN v.value IS NULL THEN 'done' ELSE 'cached' END AS status, 'cached' AS status_again,
             coalesce(v.value, '[x] ' || r.text) AS value_again, CAST(v.value IS NULL AS BIGINT) AS n_stored
             FROM requests r LEFT JOIN valid v ON r.cache_key = v.cache_key""",
        "cache_compacted": f"WITH {VALID} SELECT cache_key, value, written_at FROM valid",
        "cache_retention": f"WITH {VALID} SELECT * FROM valid ORDER BY written_at DESC, cache_key LIMIT 100",
        "cache_report": f"""WITH {CACHE} SELECT count(*) AS n_items, count(*) FILTER ({FRESH}) AS n_valid,
             count(*) FILTER (NOT ({FRESH})) AS n_expired FROM cache""",
    }
    return out
