"""The registered queries of the text operators, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    exact, language, licenses, lines, mixing, ngram_join, packing, periods, quality, ranked, repeats, secrets, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan
    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op1_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op2_url_filter", r"""
    WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
               FROM pages),
         h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                         'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
         r AS (SELECT *, CASE
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages", "page_id", "url")).drop("url")


@query("op3_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify(table(spark, folder, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op4_ngram_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_components(table(spark, folder, "documents", "doc_id", "text"))


@query("op5_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


@query("op6_exact_dedup", r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
         r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS place,
                      first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
                      count(*) OVER (PARTITION BY bare) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM r""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.mark_copies(table(spark, folder, "documents", "doc_id", "text")).drop("text")


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents", "doc_id", "text", "lang"),
                           table(spark, folder, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.learn(docs))
    names = F.array(*[F.lit(k) for k in (*secrets.KINDS, "crf")])

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))))

    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))
    counts = [F.size(F.filter("spans", lambda s, i=i: s["kind"] == i)).cast("bigint").alias(f"n_{k}")
              for i, k in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op9_mixing", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
               FROM documents),
         s AS (SELECT source, sum(size)::BIGINT AS s,
                      row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
         w AS (SELECT *, 3 * s AS lim, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
         o AS (SELECT *, (sum(s) OVER ())::BIGINT AS t, (sum(w) OVER ())::BIGINT AS tw,
                      (sum(lim) OVER (ORDER BY lim / w, rank ROWS UNBOUNDED PRECEDING))::BIGINT AS c,
                      (sum(w) OVER (ORDER BY lim / w, rank ROWS UNBOUNDED PRECEDING))::BIGINT AS cw FROM w),
         h AS (SELECT *, (t - c + lim)::DOUBLE / (tw - cw + w)::DOUBLE AS share FROM o),
         r AS (SELECT max(share) AS rest FROM h WHERE lim / w > share),
         g AS (SELECT source, s, CASE WHEN lim / w <= share THEN lim::DOUBLE ELSE least(lim::DOUBLE, rest * w) END AS target
               FROM h, r),
         p AS (SELECT doc_id, size, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
                      ('0x' || substr(md5('17:' || coalesce('v' || doc_id, 'n')), 1, 13))::BIGINT / 4503599627370496.0 AS u
               FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target,
           (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM p""")
def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, folder, "documents", "doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"))


@query("op11_ranked_search", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
         p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
               FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
         f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
         q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
                 SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
               GROUP BY item_id, term),
         c AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
               FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = periods.scan(docs.select("doc_id", periods.planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = periods.longest(F.col("runs"))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                         periods.digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_line_dedup", r"""
    WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
         k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
         r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
         m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, folder, "documents", "doc_id", "text"))
