"""Registered queries: each runs an operator over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvoice.functions import numbers as N
from shelfvoice.functions import text as X
from shelfvoice.operators import brands as B
from shelfvoice.operators import cache as K
from shelfvoice.operators import clean as C
from shelfvoice.operators import containment as G
from shelfvoice.operators import enrich as E
from shelfvoice.operators import filters as Q
from shelfvoice.operators import lexicon as L
from shelfvoice.operators import profile as P
from shelfvoice.operators import rowids as R
from shelfvoice.operators import stats as S
from shelfvoice.operators import words as V
from shelfvoice.plans import views as T
from shelfvoice.plans.pipelines import process_reviews
from shelfvoice.schema import REQUIRED, REVIEW_TYPE
from shelfvoice.sources import readers, writers
from shelfvoice.sources.workspace import new_path

NOW = datetime(2024, 1, 31)
TTL_DAYS = 10
KEEP_ITEMS = 100
ENGINE = "test"
BRAND_AND_TYPE = {"Brand": "Brand#7", "Rating": 5.0, REVIEW_TYPE: "positive", "Asin": None}
LABEL_TASKS = [
    E.LabelTask("theme", "theme", "Theme of: {Content}", "Content"),
    E.LabelTask("origin", "origin", "Origin of {text}, see {notes}", "Title"),
    E.LabelTask("fixed", "fixed", "Same for all", "Model"),
]
GROUP_LEVELS = [["Brand"], ["Asin"], ["Model"], ["Asin", "Model"], ["Brand", "Asin", "Model"]]
NO_WAIT = E.CallOptions(pause=0.0)


def _mark():
    """A pure enrichment function; nested, so that workers get it by value."""

    def mark(texts):
        return ["[x] " + t for t in texts]

    return mark


def _flaky():
    """Fails for some texts, always with the same message."""

    def mark(texts):
        if any("license" in t for t in texts):
            raise RuntimeError("HTTP 429 too many requests")
        if any("heed" in t for t in texts):
            raise RuntimeError("Read Timeout")
        return [None if "than" in t else "[x] " + t for t in texts]

    return mark


def _lexicon(spark: SparkSession) -> L.Lexicon:
    return L.Lexicon.of(T.lexicon(spark))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.word_freq(T.texts(spark, sf), T.stop_words(spark))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return L.match_array(T.text_reviews(spark, sf), T.MATCH_KEYWORDS)


# ------------------------------------------------------- sources and sinks


def scan_reviews_csv(spark, sf):
    path = new_path(spark, "reviews-csv")
    writers.write_results(T.line_reviews_raw(spark, sf).select(*REQUIRED), path, "csv")
    return readers.read_reviews(spark, path, "csv").select(*REQUIRED)


def scan_reviews_json(spark, sf):
    path = new_path(spark, "reviews-json")
    writers.write_results(T.line_reviews_raw(spark, sf).select(*REQUIRED), path, "json")
    return readers.read_reviews(spark, path, "json").select(*REQUIRED)


def scan_brands(spark, sf):
    path = new_path(spark, "brands-csv")
    writers.write_results(T.brands(spark, sf), path, "csv")
    found = readers.read_brands(spark, path, "csv")
    return found.select("ASIN", "Brand", "Parent ASIN", F.lit(readers.has_parent(found)).alias("has_parent"))


def write_tsv(spark, sf):
    path = new_path(spark, "reviews-tsv")
    writers.write_tsv(T.text_reviews(spark, sf).select("ID", "Title", "Content", "Rating", "Date"), path)
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"')


def write_results(spark, sf):
    path = new_path(spark, "reviews-parquet")
    writers.write_results(T.text_reviews(spark, sf), path)
    return spark.read.parquet(path)


def export_projection(spark, sf):
    made = T.text_reviews(spark, sf).withColumn("Content_zh", F.concat(F.lit("[x] "), "Content"))
    return writers.export_projection(made, ["Content"], ["Content_zh"], keep_sources=False)


def _cache_files(spark, sf):
    """One text file for each event type: its keys, 32 characters and a line end each."""
    path = new_path(spark, "cache-files")
    keys = T.event_cache(spark, sf).select("cache_key", "value")
    keys.repartition("value").write.partitionBy("value").text(path)
    return path


def cache_file_scan(spark, sf):
    files = readers.scan_files(spark, _cache_files(spark, sf))
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        "n_bytes",
        F.col("modified_at").isNotNull().alias("has_time"),
    )


def cache_storage(spark, sf):
    return K.storage_report(spark, _cache_files(spark, sf))


# ---------------------------------------------------------------- cleaning


def process_reviews_sorted(spark, sf):
    return process_reviews(
        T.line_reviews_raw(spark, sf),
        T.brands_with_stale(spark, sf),
        order_by=T.LINE_ORDER,
        brand_order=["ord"],
    )


def process_reviews_file_order(spark, sf):
    return process_reviews(T.order_reviews_raw(spark, sf), T.brands_with_stale(spark, sf), brand_order=["ord"])


def coerce_rating(spark, sf):
    raw = T.line_reviews_raw(spark, sf)
    odd = F.concat("Rating", F.when(F.col("l_linenumber") == 5, F.lit("e0 ")).otherwise(F.lit("")))
    return raw.select(*T.LINE_ORDER, N.coerce_rating(odd).alias("Rating"))


def coerce_date(spark, sf):
    raw = T.line_reviews_raw(spark, sf)
    slashed = F.when(F.col("l_linenumber") == 5, F.replace("Date", F.lit("-"), F.lit("/"))).otherwise(F.col("Date"))
    return raw.select(*T.LINE_ORDER, N.coerce_date(slashed).alias("Date"))


def row_ids(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.assign_row_ids(orders, [F.desc("o_totalprice"), "o_orderkey"])


def row_ids_file_order(spark, sf):
    return R.ids_in_file_order(T.order_reviews_raw(spark, sf)).select("ID", "Content")


def canonical_order(spark, sf):
    mixed = T.text_reviews(spark, sf).select("Date", REVIEW_TYPE, "Asin", F.lit("extra").alias("extra"), "ID")
    return C.canonical_order(mixed)


def normalise_brands(spark, sf):
    return B.normalise_brands(T.brands(spark, sf))


def tag_projection(spark, sf):
    reviews = T.text_reviews(spark, sf)
    return L.tag_projection(reviews.withColumn("Translation", F.upper("Model")))


# ----------------------------------------------------------------- filters


def row_range(spark, sf):
    return Q.filter_reviews(T.text_reviews(spark, sf), {REVIEW_TYPE: "positive", "row_range": (10, 60)})


def row_range_long(spark, sf):
    orders = T.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "ID")
    return Q.row_range(orders, 100, 20_000)


def filter_selectivity(spark, sf):
    kept = (F.col(f"`{REVIEW_TYPE}`") == "positive") & (F.length("Content") >= 200)
    return Q.selectivity(T.text_reviews(spark, sf), kept)


def nonblank(spark, sf):
    blanked = T.text_reviews(spark, sf).withColumn("Content", F.when(F.col("ID") % 3 != 0, F.col("Content")))
    blanked = blanked.withColumn("Content", F.when(F.col("ID") % 5 == 0, F.lit(" 　\n")).otherwise(F.col("Content")))
    return Q.with_text(blanked, "Content").select("ID", "Content")


# ------------------------------------------------------------------- stats


def nonzero_share(spark, sf):
    """Shares above zero of a table in which many are zero: a product's ratings as columns."""
    wide = S.rating_crosstab_wide(T.line_reviews(spark, sf), ["Asin", "Model"])
    shares = wide.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("rating"), F.col(c).alias("pct")) for c in wide.columns[1:]])).alias("s"))
    return shares.select("grp", "s.rating", "s.pct").filter("pct > 0")


def group_type_map(spark, sf):
    made = S.group_type_map(T.line_reviews(spark, sf), ["Asin", "Model"])
    return made.select("grp", F.explode("type_dist").alias("review_type", "n_reviews"))


def group_report(spark, sf):
    """Count, mean, deviation and type distribution in one aggregation."""
    made = S.group_stats(T.branded_reviews(spark, sf), "Brand", with_types=True)
    return made.select(
        "grp", "n_reviews", "avg_rating", "std_rating", F.explode("type_dist").alias("review_type", "n_of_type")
    )


def group_levels(spark, sf):
    """All groups of the statistics page, each of its levels, from one scan."""
    return S.group_levels(T.branded_reviews(spark, sf), GROUP_LEVELS)


# ------------------------------------------------------------------- words


def tokenise(spark, sf):
    return T.texts(spark, sf).select("ID", F.array_join(X.tokenise(F.col("Content")), " ").alias("tokens"))


def word_freq_negative(spark, sf):
    negative = V.split_words(T.part_lexicon_raw(spark, sf), "keywords").union(
        readers.literal_table(spark, [("thing",), ("heed",)], ["word"])
    )
    return V.word_freq(Q.of_review_type(T.text_reviews(spark, sf), "Positive"), T.stop_words(spark), negative)


def vocab_stats(spark, sf):
    reviews = T.text_reviews(spark, sf)
    analysed = Q.of_review_type(reviews, "NEGATIVE")
    return V.vocab_stats(reviews, analysed, V.word_freq(analysed, T.stop_words(spark)))


def stop_union(spark, sf):
    return V.union_words(T.stop_words(spark), V.split_words(T.part_lexicon_raw(spark, sf), "keywords"))


def words_add(spark, sf):
    upper = T.part_lexicon_raw(spark, sf).select(F.upper("keywords").alias("entry"))
    return V.add_words(T.stop_words(spark), upper, "entry")


def words_remove(spark, sf):
    words = V.split_words(T.part_lexicon_raw(spark, sf), "keywords")
    gone = T.table(spark, sf, "part").filter("p_size > 45").select(F.col("p_name").alias("word"))
    return V.remove_words(words, gone)


# ----------------------------------------------------------------- lexicon


def _part_lexicon(spark, sf, condition):
    parts = T.table(spark, sf, "part").filter(condition)
    raw = parts.select(F.col("p_type").alias("main"), F.col("p_brand").alias("sub"), F.col("p_name").alias("keywords"))
    return L.normalise_lexicon(raw)


def lexicon_upsert(spark, sf):
    return L.upsert_categories(_part_lexicon(spark, sf, "p_size <= 44"), _part_lexicon(spark, sf, "p_size >= 45"))


def lexicon_delete(spark, sf):
    return L.delete_categories(
        _part_lexicon(spark, sf, "true"), _part_lexicon(spark, sf, "p_size = 45").select("main", "sub")
    )


def lexicon_upgrade(spark, sf):
    parts = T.table(spark, sf, "part")
    flat = parts.select(F.col("p_name").alias("sub"), F.lower("p_brand").alias("keywords"))
    preset = parts.filter("p_size < 2").select(F.col("p_name").alias("sub"), F.col("p_type").alias("main"))
    return L.upgrade_flat(flat, preset, "other")


def match_array(spark, sf):
    return _matched(spark, sf).select("ID", F.array_join("Matches", "|").alias("matches"), "Match_Count")


def matched_only(spark, sf):
    return L.matched_only(_matched(spark, sf)).select("ID", "Match_Count")


def category_ranking(spark, sf):
    return L.category_ranking(L.category_stats(T.text_reviews(spark, sf), _lexicon(spark)), "matched", False)


# -------------------------------------------------------------- enrichment


def chunk_text(spark, sf):
    pieces = X.chunk_text(X.normalise_text(F.col("Content")))
    return T.text_reviews(spark, sf).select("ID", F.posexplode(pieces).alias("pos", "piece")).select(
        "ID", F.col("pos").cast("bigint").alias("pos"), "piece"
    )


def clean_output(spark, sf):
    """Full stops and commas as doubled full-width marks, then cleaned."""
    wide = F.replace(F.replace("Content", F.lit("."), F.lit("。。。")), F.lit(","), F.lit("，，"))
    return T.text_reviews(spark, sf).select("ID", X.clean_output(wide).alias("cleaned"))


def render_prompt(spark, sf):
    prompt = (
        F.when(F.col("ID") % 3 == 0, F.lit("Label {Content} as {kind}"))
        .when(F.col("ID") % 3 == 1, F.lit("{text}: good or bad?"))
        .otherwise(F.lit("no slot"))
    )
    return T.text_reviews(spark, sf).select("ID", X.render_prompt(prompt, F.col("Content")).alias("prompt"))


def cache_key(spark, sf):
    key = X.cache_key(F.col("Content"), F.lit("google"), F.lit("en"), F.lit("zh"))
    return T.text_reviews(spark, sf).select("ID", key.alias("cache_key"))


def error_class(spark, sf):
    message = F.concat(
        F.lit("code "),
        F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" Timeout")).otherwise(F.lit("")),
    )
    return T.table(spark, sf, "orders").select("o_orderkey", X.error_class(message).alias("error_class"))


def cache_split(spark, sf):
    return K.split_requests(T.cache_requests(spark, sf), T.event_cache(spark, sf), NOW, TTL_DAYS)


def cache_read_through(spark, sf):
    """Twice with only a path: the second pass finds what the first one stored, which holds each key once."""
    path = new_path(spark, "cache")
    requests, cache = T.cache_requests(spark, sf), T.event_cache(spark, sf)
    first = E.read_through(requests, cache, _mark(), cache_path=path, now=NOW, ttl_days=TTL_DAYS)
    again = E.read_through(requests, cache, _mark(), cache_path=path, now=NOW, ttl_days=TTL_DAYS)
    stored = K.read_cache(spark, path, NOW, TTL_DAYS).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_stored"))
    later = again.select("cache_key", F.col("status").alias("status_again"), F.col("value").alias("value_again"))
    made = first.select("cache_key", "value", "status").join(later, "cache_key").join(stored, "cache_key", "left")
    return made.withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))


def cache_compacted(spark, sf):
    """All events stored, then the table rewritten to the newest valid entry of each key."""
    path = new_path(spark, "cache")
    events = T.event_cache(spark, sf).select("cache_key", "value", "written_at")
    rows = events.withColumns({"status": F.lit("done"), "written_on": F.to_date("written_at")})
    rows.write.partitionBy("written_on").parquet(path)
    K.compact_cache(spark, path, NOW, TTL_DAYS)
    return K.read_cache(spark, path).select("cache_key", "value", "written_at")


def cache_retention(spark, sf):
    return K.retain(T.event_cache(spark, sf), NOW, TTL_DAYS, KEEP_ITEMS)


def enrich_columns(spark, sf):
    made = E.enrich_columns(T.text_reviews(spark, sf), ["Content"], _mark(), engine=ENGINE, options=NO_WAIT)
    return made.rows.select("ID", "Content_zh")


def enrich_two_columns(spark, sf):
    reviews = T.text_reviews(spark, sf).withColumn("Title", F.when(F.col("ID") % 4 != 0, F.col("Title")))
    made = E.enrich_columns(reviews, ["Title", "Content"], _mark(), engine=ENGINE, options=NO_WAIT)
    return made.rows.select("ID", "Title_zh", "Content_zh")


def label_tasks(spark, sf):
    made = E.label_columns(T.text_reviews(spark, sf), LABEL_TASKS, _mark(), model="m1", options=NO_WAIT)
    return made.rows.select("ID", *[t.col_name for t in LABEL_TASKS])


def _part_cached(spark, sf):
    """Enrichment with a cache of the German texts, some failures and some blanks."""
    reviews = T.text_reviews(spark, sf)
    key = X.cache_key(X.normalise_text(F.col("Content")), F.lit(ENGINE), F.lit("en"), F.lit("zh"))
    cache = (
        reviews.filter("Model = 'de'")
        .select(key.alias("cache_key"), F.lit("kept").alias("value"))
        .distinct()
        .withColumns({"written_at": F.lit("2024-01-30").cast("timestamp_ntz"), "status": F.lit("done")})
    )
    reviews = reviews.withColumn("Content", F.when(F.col("ID") % 10 != 3, F.col("Content")))
    return E.enrich_columns(
        reviews, ["Content"], _flaky(), engine=ENGINE, cache=cache, now=NOW, ttl_days=TTL_DAYS, options=NO_WAIT
    )


def enrich_failures(spark, sf):
    made = _part_cached(spark, sf)
    log = made.log.select("ID", "status", "error_class")
    return made.rows.select("ID", "Content_zh").join(log, "ID")


def job_counters(spark, sf):
    return E.job_counters(_part_cached(spark, sf).log)


def _over(view, fn):
    """Query that applies ``fn`` to a view."""
    return lambda spark, sf: fn(view(spark, sf))


def _with_lexicon(fn):
    return lambda spark, sf: fn(T.text_reviews(spark, sf), _lexicon(spark))


def _texts_with_lexicon(fn):
    return lambda spark, sf: fn(T.texts(spark, sf), _lexicon(spark))


def queries():
    raw, line, text, branded = T.line_reviews_raw, T.line_reviews, T.text_reviews, T.branded_reviews
    col = F.col
    return {
        # sources and sinks
        "scan_reviews_csv": scan_reviews_csv,
        "scan_reviews_json": scan_reviews_json,
        "scan_brands": scan_brands,
        "write_tsv": write_tsv,
        "write_results": write_results,
        "export_projection": export_projection,
        "cache_file_scan": cache_file_scan,
        "cache_storage": cache_storage,
        # cleaning
        "process_reviews": process_reviews_sorted,
        "process_reviews_file_order": process_reviews_file_order,
        "project_required": _over(raw, C.project_required),
        "coerce_rating": coerce_rating,
        "coerce_date": coerce_date,
        "trim_text": _over(raw, lambda d: C.trim_review_text(d).select(*T.LINE_ORDER, "Asin", "Title", "Content", "Model")),
        "row_ids": row_ids,
        "row_ids_file_order": row_ids_file_order,
        "rating_bucket": _over(text, lambda d: d.select("ID", N.rating_bucket(col("Rating")).alias("review_type"))),
        "canonical_order": canonical_order,
        "group_key": _over(
            branded, lambda d: d.select(*T.LINE_ORDER, X.group_key(col("Brand"), col("Asin"), col("Model")).alias("grp"))
        ),
        "month_bucket": _over(text, lambda d: d.select("ID", N.month_bucket(col("Date")).alias("month"))),
        "normalise_brands": normalise_brands,
        "tag_projection": tag_projection,
        # filters
        "facet_filter": _over(branded, lambda d: Q.filter_reviews(d, BRAND_AND_TYPE)),
        "row_range": row_range,
        "row_range_long": row_range_long,
        "min_length": _over(text, lambda d: Q.min_length(d, "Content").select("ID", "Content")),
        "in_list": _over(line, lambda d: Q.in_list(d, "Asin", ["A1", "A17", "A150"])),
        "type_filter_ci": _over(text, lambda d: Q.of_review_type(d, "POSITIVE").select("ID", REVIEW_TYPE)),
        "flag_filter": _with_lexicon(lambda d, x: L.flag_filter(L.category_flags(d, x), "topic", "thing")),
        "rating_thresholds": _over(line, S.rating_thresholds),
        "matched_only": matched_only,
        "nonblank": nonblank,
        "nonzero_share": nonzero_share,
        "filter_selectivity": filter_selectivity,
        "facets": _over(branded, Q.facets),
        "facet_values": _over(branded, lambda d: Q.facet_values(d, "Brand")),
        # joins
        "brand_join": lambda spark, sf: B.join_brands(
            line(spark, sf), T.brands(spark, sf), ["ord"], F.struct(*T.LINE_ORDER), use_parent=False
        ),
        "brand_join_parent": branded,
        "brand_dedupe": lambda spark, sf: B.dedupe_brands(T.brands_with_stale(spark, sf), ["ord"]),
        "brand_match_report": lambda spark, sf: B.brand_match_report(
            line(spark, sf), T.brands_with_stale(spark, sf), ["ord"]
        ),
        "attach_labels": _with_lexicon(L.add_flags),
        "lexicon_join": _texts_with_lexicon(L.lexicon_join),
        "dense_types": _over(line, lambda d: S.dense_types(d.withColumn(REVIEW_TYPE, F.when(F.col(REVIEW_TYPE) != "neutral", F.col(REVIEW_TYPE))))),
        "cache_split": cache_split,
        # statistics
        "overview": _over(text, S.overview),
        "span_overview": _over(line, S.span_overview),
        "review_type_stats": _over(text, S.review_type_stats),
        "rating_histogram": _over(text, S.rating_histogram),
        "group_stats_asin": _over(line, lambda d: S.group_stats(d, "Asin")),
        "group_stats_brand": _over(branded, lambda d: S.group_stats(d, "Brand")),
        "group_stats_asin_model": _over(line, lambda d: S.group_stats(d, ["Asin", "Model"])),
        "group_stats_brand_asin_model": _over(branded, lambda d: S.group_stats(d, ["Brand", "Asin", "Model"])),
        "group_report": group_report,
        "group_type_map": group_type_map,
        "group_levels": group_levels,
        "rating_crosstab": _over(line, lambda d: S.rating_crosstab(d, "Asin")),
        "rating_crosstab_wide": _over(branded, lambda d: S.rating_crosstab_wide(d, "Brand")),
        "group_stats_multikey": _over(branded, lambda d: S.group_stats_multikey(d, ["Brand", "Model"])),
        "trend_overall": _over(text, S.rating_trend),
        "trend_asin": _over(line, lambda d: S.rating_trend(d, "Asin")),
        "trend_brand": _over(branded, lambda d: S.rating_trend(d, "Brand")),
        "rating_shares": _over(line, lambda d: S.rating_shares(d, ["Asin", "Model"], "A17 - AF")),
        "completeness": _over(text, lambda d: P.completeness(d, ["Title", "Content", "Rating", "Date", REVIEW_TYPE])),
        "dataset_profile": _over(text, P.dataset_profile),
        "preview": _over(text, P.preview),
        "sample_values": _over(text, lambda d: P.sample_values(d, "Content")),
        # words
        "tokenise": tokenise,
        "word_freq": _counts,
        "word_freq_negative": word_freq_negative,
        "vocab_stats": vocab_stats,
        "top_words": lambda spark, sf: V.top_words(_counts(spark, sf)),
        "cloud_weights": lambda spark, sf: V.cloud_weights(_counts(spark, sf)),
        "stop_union": stop_union,
        "words_add": words_add,
        "words_remove": words_remove,
        # lexicon
        "lexicon_normalise": lambda spark, sf: L.normalise_lexicon(T.part_lexicon_raw(spark, sf)),
        "lexicon_upsert": lexicon_upsert,
        "lexicon_delete": lexicon_delete,
        "lexicon_upgrade": lexicon_upgrade,
        "match_array": match_array,
        "category_flags": _with_lexicon(L.category_flags),
        "category_stats": _texts_with_lexicon(L.category_stats),
        "keyword_frequency": _texts_with_lexicon(L.keyword_frequency),
        "category_stats_many": _over(T.texts, lambda d: L.category_stats(d, L.Lexicon(tuple(T.SYLLABLES)))),
        "keyword_frequency_many": _over(T.texts, lambda d: L.keyword_frequency(d, L.Lexicon(tuple(T.SYLLABLES)))),
        "match_summary": lambda spark, sf: L.match_summary(_matched(spark, sf)),
        "match_by_rating": lambda spark, sf: L.match_by_rating(_matched(spark, sf)),
        "lexicon_pairs_openings": lambda spark, sf: G.lexicon_pairs(T.texts(spark, sf), T.opening_lexicon(spark, sf)),
        "keyword_frequency_openings": lambda spark, sf: G.keyword_frequency(T.texts(spark, sf), T.opening_lexicon(spark, sf)),
        "category_stats_openings": lambda spark, sf: G.category_stats(T.texts(spark, sf), T.opening_lexicon(spark, sf)),
        "keyword_frequency_parts": lambda spark, sf: G.keyword_frequency(T.texts(spark, sf), L.normalise_lexicon(T.part_lexicon_raw(spark, sf))),
        "match_keyword_counts": lambda spark, sf: L.match_keyword_counts(_matched(spark, sf)),
        "match_rating_counts": lambda spark, sf: L.match_rating_counts(_matched(spark, sf)),
        "top_keywords": _with_lexicon(lambda d, x: L.top_keywords(L.keyword_frequency(d, x), 1)),
        "category_ranking": category_ranking,
        "top_categories": _with_lexicon(lambda d, x: L.top_categories(L.category_stats(d, x), 3)),
        # enrichment
        "normalise_text": _over(text, lambda d: d.select("ID", X.normalise_text(col("Content")).alias("normalised"))),
        "clean_output": clean_output,
        "chunk_text": chunk_text,
        "render_prompt": render_prompt,
        "cache_key": cache_key,
        "preview_text": _over(text, lambda d: d.select("ID", X.preview_text(col("Content"), 50).alias("preview"))),
        "error_class": error_class,
        "enrich_columns": enrich_columns,
        "enrich_two_columns": enrich_two_columns,
        "label_tasks": label_tasks,
        "enrich_failures": enrich_failures,
        "job_counters": job_counters,
        "cache_read_through": cache_read_through,
        "cache_retention": cache_retention,
        "cache_compacted": cache_compacted,
        "cache_report": lambda spark, sf: K.cache_report(T.event_cache(spark, sf), NOW, TTL_DAYS),
    }
