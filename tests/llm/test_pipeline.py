import corpus_pipeline
from shelfvoice.llm import decontaminate, secret_scan, simhash_trie, toxicity
from shelfvoice.llm.common import table
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    """Each stage's rows on all its predecessor kept, by plain Python on collected rows."""
    docs = table(spark, SF, "documents")
    for name, apply in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = corpus_pipeline.stage(apply(spark, docs, SF), name)
        rows = after.collect()
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SF, "labels"))
            ids = sorted(before)
            scores = toxicity.score_texts(model, [before[k].text for k in ids])
            assert {r.doc_id for r in rows} == {k for k, s in zip(ids, scores) if s < toxicity.THRESHOLD}
        elif name == "simhash_near_dedup":
            prints = {k: simhash_trie.text_fingerprint(r.text, 3) for k, r in before.items()}
            group = {k: {k} for k in prints}
            for a in prints:
                for b in prints:
                    if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] is not group[b]:
                        group[a] |= group[b]
                        for k in group[b]:
                            group[k] = group[a]
            assert {r.doc_id for r in rows} == {min(g) for g in group.values()}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, decontaminate.WORD.findall(r.text.lower())) for r in table(spark, SF, "benchmark").collect()]
            text = {k: " ".join(["", *decontaminate.WORD.findall(r.text.lower()), ""]) for k, r in before.items()}
            held = {k for k, t in text.items() if any(" ".join(["", *w, ""]) in t for _, w in items)}
            assert {r.doc_id for r in rows} == set(before) - held
        elif name == "secret_scans":
            assert {r.doc_id for r in rows} == set(before)
            found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_findings(spark))).filter("is_secret").collect()
            spans = {}
            for f in found:
                spans.setdefault(f.doc_id, []).append((f.start, f.length))
            for r in rows:
                text = before[r.doc_id].text
                for start, length in sorted(spans.get(r.doc_id, []), reverse=True):
                    text = text[:start] + "[SECRET]" + text[start + length :]
                assert r.text == text and r.n_chars == len(text)
        else:
            assert {r.doc_id for r in rows} == set(before)
        docs = after


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names; then no rows at all."""
    odd = helpers.table(spark)
    for docs, ids in ((odd, [r[0] for r in helpers.ROWS]), (helpers.empty(spark), [])):
        by_name = {name: apply(spark, docs, SF) for name, apply in corpus_pipeline.STAGES}
        for name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans"):
            assert by_name[name].columns == docs.columns, name
        found = {name: sorted((r.doc_id for r in df.collect()), key=str) for name, df in by_name.items()}
        assert found["simhash_near_dedup"] == sorted(set(ids) - {2, 4, 6}, key=str)
        assert found["benchmark_decontamination"] == found["secret_scans"] == sorted(ids, key=str)
        assert set(found["toxicity"]) <= set(ids) and set(found["best_fit_packing"]) == set(ids)
