"""Quality rules whose cutoffs are chosen on labelled rows so that few good documents are rejected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import SPACES, WORD, whole, without
from tablewright.session import written

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

# Cutoffs per rule, from lenient to strict; a document fails where its signal is above the cutoff.
CUTOFFS: Mapping[str, Sequence[float]] = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeated_words": (0.49, 0.45, 0.4, 0.35, 0.3, 0.25),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0),
}
FALSE_REJECTIONS = 0.02  # of the good documents of a stratum, over all rules together
ERROR = 0.05  # chance that any stratum's limit does not hold
BROADCAST_STRATA = 10_000


def window_hashes(words: Column) -> Column:
    """A hash of every window of three words, in order."""
    size = F.size(words)
    return F.when(size >= 3, F.transform(
        F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
    )).otherwise(F.array().cast("array<bigint>"))


# Words inside windows that a text has twice or more, the first ones included. Only texts with two equal
# windows sort them with their places; a repeated window covers three words, less those already covered.
_REPEATED_WORDS = """
    CASE WHEN size(array_distinct(__windows)) = size(__windows) THEN 0L ELSE
      aggregate(
        sort_array(transform(
          filter(
            transform(__sorted, (x, i) -> named_struct('i', x.i, 'again',
              (i > 0 AND __sorted[greatest(i - 1, 0)].h = x.h) OR (i + 1 < size(__sorted)
               AND __sorted[least(i + 1, size(__sorted) - 1)].h = x.h))),
            x -> x.again),
          x -> x.i)),
        named_struct('stop', 0L, 'total', 0L),
        (s, i) -> named_struct('stop', i + 3L, 'total', s.total + i + 3L - greatest(s.stop, CAST(i AS BIGINT))),
        s -> s.total)
    END"""


def measures(text: Column) -> Mapping[str, Column]:
    """The counts of a text that need no second look at its words."""
    value = whole(text)
    lines = F.filter(F.split(value, "\n", -1), lambda line: F.length(without(line, SPACES)) > 0)
    return {
        "word_chars": F.length(without(value, SPACES)).cast("bigint"),
        "n_symbols": (F.length(value) - F.length(without(value, SYMBOLS))).cast("bigint"),
        "__lines": lines,
        "__words": F.regexp_extract_all(value, F.lit(WORD), F.lit(0)),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``.

    A null text is empty and has all counts 0; lines count where they hold a word.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    given = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    counted = docs.drop(*added).withColumns(dict(measures(F.col(text))))
    counted = counted.select(
        *given, "word_chars", "n_symbols", F.size("__words").cast("bigint").alias("n_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        window_hashes(F.col("__words")).alias("__windows"))
    ordered = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("__sorted", ordered).withColumn("n_repeat_words", F.expr(_REPEATED_WORDS))
    return counted.select(*given, *added)


def signals() -> Mapping[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def binomial_tail(n: str, k: str, limit: str) -> Column:
    """P(X <= k) for n draws of chance ``limit``: terms from their predecessors, added as logarithms."""
    return F.expr(f"""
        CASE WHEN {n} = 0 OR {k} >= {n} * {limit} THEN 1.0D ELSE exp(aggregate(
            filter(sequence(0L, {k}), i -> i > 0),
            named_struct('term', {n} * ln(1 - {limit}), 'total', {n} * ln(1 - {limit})),
            (s, i) -> named_struct(
                'term', s.term + ln(({n} - i + 1) / i) + ln({limit} / (1 - {limit})),
                'total', greatest(s.total, s.term + ln(({n} - i + 1) / i) + ln({limit} / (1 - {limit})))
                    + ln(1 + exp(-abs(s.total - (s.term + ln(({n} - i + 1) / i) + ln({limit} / (1 - {limit}))))))),
            s -> s.total)) END""")


def choose_cutoffs(
    labelled: DataFrame, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS,
    false_rejections: float = FALSE_REJECTIONS, error: float = ERROR,
) -> DataFrame:
    """One row per stratum: a map from rule to cutoff, for the rules that may be used there.

    ``labelled`` has ``stratum``, ``good`` and the signals; cutoffs are given beforehand, so all its
    rows are held out from their choice. Along a rule's cutoffs, from lenient to strict, each is tested
    by the exact binomial chance of seeing so few good documents rejected if more than the rule's part
    of the limit were; the sequence stops at the first that fails, which needs no correction within
    the rule, and the error is shared over rules and strata (Bonferroni). Of the cutoffs that hold, the
    most lenient that rejects most bad documents is taken; a rule that rejects none is left out.
    """
    tried = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(float(cut)).alias("cutoff"),
                 (F.col(rule) > cut).cast("bigint").alias("rejected"))
        for rule, cuts in cutoffs.items() for step, cut in enumerate(cuts)])
    rows = labelled.select("stratum", "good", F.explode(tried).alias("t")).select("stratum", "good", "t.*")
    counts = rows.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.sum(F.col("good").cast("bigint")).alias("n"),
        F.sum(F.when(F.col("good"), F.col("rejected")).otherwise(0)).alias("k"),
        F.sum(F.when(~F.col("good"), F.col("rejected")).otherwise(0)).alias("bad"))
    counts = written(counts, "cutoffs")  # strata x cutoffs rows
    strata = counts.select("stratum").distinct().agg(F.count("*").alias("strata"))  # one row
    tested = counts.join(F.broadcast(strata)).withColumn("limit", F.lit(false_rejections / len(cutoffs)))
    holds = binomial_tail("n", "k", "limit") <= F.lit(error) / (F.col("strata") * len(cutoffs))
    ladder = tested.groupBy("stratum", "rule").agg(  # a rule's steps, at most as many as it has cutoffs
        F.sort_array(F.collect_list(F.struct("step", "cutoff", "bad", holds.alias("holds")))).alias("steps"))
    stop = F.coalesce(F.array_min(F.transform(F.filter("steps", lambda s: ~s["holds"]), lambda s: s["step"])), F.size("steps"))
    passed = F.filter("steps", lambda s: (s["step"] < F.col("stop")) & (s["bad"] > 0))
    best = F.array_max(F.transform(passed, lambda s: F.struct(
        s["bad"].alias("bad"), (-s["step"]).alias("lenient"), s["cutoff"].alias("cutoff"))))
    chosen = ladder.withColumn("stop", stop).withColumn("best", best)
    return chosen.where(F.col("best").isNotNull()).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", F.col("best.cutoff")))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """``docs`` with the counts of :func:`measure`, ``base_failed``, ``failed_rules`` and ``kept``.

    ``labels`` has the key and ``quality`` (1 good, 0 bad; others are left out). Null strata are one
    stratum; a null key meets no label; a key labelled twice counts twice. Without labels only the base
    rules reject. An empty table gives no rows. Columns of ``docs`` with one of these names are replaced.
    """
    docs = docs.drop("base_failed", "failed_rules", "kept")
    measured = measure(docs, text).withColumn("__stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    measured = written(measured.drop(text), "measures") if text not in (key, stratum) else written(measured, "measures")
    scored = measured.withColumns({f"__{name}": value for name, value in signals().items()})
    marks = labels.select(F.col(key).alias("__key"), "quality").where(F.col("quality").isin(0, 1))
    labelled = scored.join(marks, F.col(key) == F.col("__key")).select(
        F.col("__stratum").alias("stratum"), (F.col("quality") == 1).alias("good"),
        *[F.col(f"__{rule}").alias(rule) for rule in CUTOFFS])
    cutoffs = written(choose_cutoffs(labelled), "chosen").withColumnRenamed("stratum", "__of")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    joined = scored.join(cutoffs, F.col("__stratum") == F.col("__of"), "left")
    failed = F.array_compact(F.array(*[
        F.when(F.col(f"__{rule}") > F.col("cutoffs")[rule], F.lit(rule)) for rule in CUTOFFS]))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    names = [c for c in measured.columns if c != "__stratum"]
    return joined.select(*[F.col(f"`{c}`") for c in names], base.alias("base_failed"), failed.alias("failed_rules"),
                         (~base & (F.size(failed) == 0)).alias("kept"))
