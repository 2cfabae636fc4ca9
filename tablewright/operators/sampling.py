"""Reproducible samples, splits and folds of set sizes, without sorting the table.

Every row has a pseudo-random number from its key. A histogram of its leading bits
tells in which bucket each wanted size is reached, and a second look at those few
buckets gives the exact number to cut at. After that a sample, a split or a fold is a
comparison with literals: a projection with no shuffle, the same on every run. One
class may hold any share of the table, as its rows spread over all buckets.

Rows of equal keys have equal numbers and stay together, so copies never straddle a
split. Only where exactly n rows are asked for is such a group divided.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import default_key, digest, row_hash
from tablewright.functions.kinds import q
from tablewright.operators.task import TaskError

# Fixed values.
SEED = 42
SAMPLE_ROWS = 300_000
MAX_STRATA = 100
TEST_SHARE = 0.2
MAX_FOLDS = 5
ROWS_PER_FOLD = 10
EARLY_STOPPING_SHARE = 0.1
MIN_ROWS_PER_CLASS = 3
MAX_BUCKET_DIGITS = 5  # hex digits: a million buckets


def class_table(df: DataFrame, target: str, limit: int = MAX_STRATA) -> list[tuple[object, int]] | None:
    """Class sizes in label order, or None when there are more than ``limit`` classes.

    The sketch keeps a continuous target from being grouped at all, and the limit
    on the grouped rows bounds what reaches the driver.
    """
    present = df.filter(q(target).isNotNull())
    if present.agg(F.approx_count_distinct(q(target))).first()[0] > 2 * limit + 20:
        return None
    counts = present.groupBy(q(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return sorted(((r["label"], r["n"]) for r in rows), key=lambda pair: pair[0])


def shares(sizes: Sequence[int], total: int) -> list[int]:
    """Split ``total`` over the classes in proportion, by largest remainder (ties to the earlier class)."""
    whole = sum(sizes)
    if not whole:
        return [0] * len(sizes)
    out = [n * total // whole for n in sizes]
    by_remainder = sorted(range(len(sizes)), key=lambda i: (-(sizes[i] * total % whole), i))
    for i in by_remainder[: total - sum(out)]:
        out[i] += 1
    return out


@dataclass(frozen=True)
class Cut:
    """Where a class is cut: rows up to ``at`` come before, and ``over`` of the rows at it are too many."""

    at: str
    over: int


def find_cuts(
    df: DataFrame, key: Sequence[str], sizes: Sequence[tuple[object, Sequence[int]]], by: str | None = None,
    seed: int = SEED, h: Column | None = None,
) -> dict[object, list[Cut]]:
    """Per class, the hash numbers below which the given running sizes of rows lie.

    Both steps are map-side combined aggregates; what reaches the driver is one row per
    class and cut, for at most a few hundred classes.
    """
    label: Column = q(by) if by else F.lit(0)
    most = max((n for _, cuts in sizes for n in cuts), default=0)
    digits = min(max(most.bit_length() // 8, 2), MAX_BUCKET_DIGITS)  # about as many buckets as rows in one
    hashed = df.select(label.alias("label"), (row_hash(key, seed) if h is None else h).alias("h"))
    hashed = hashed.withColumn("bucket", F.substring("h", 1, digits))
    wanted = [(value if by else 0, piece, int(n)) for value, cuts in sizes for piece, n in enumerate(cuts)]
    label_type = df.schema[by].dataType.simpleString() if by else "int"
    goals = df.sparkSession.createDataFrame(wanted, f"label {label_type}, piece int, goal bigint")

    def reached(counts: DataFrame, groups: list[str], order: str, goals_: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        steps = counts.withColumn("upto", F.sum("n").over(upto))
        hit = (F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal"))
        return steps.join(F.broadcast(goals_), groups).filter(hit)

    histogram = hashed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    borders = reached(histogram, ["label"], "bucket", goals).select(
        "label", "piece", "bucket", (F.col("goal") - F.col("upto") + F.col("n")).alias("goal")).collect()
    out: dict[object, list[Cut]] = {value: [Cut("", 0)] * len(cuts) for value, cuts in sizes}
    if not borders:
        return out
    places = df.sparkSession.createDataFrame(borders, f"label {label_type}, piece int, bucket string, goal bigint")
    narrow = hashed.filter(F.col("bucket").isin(sorted({r["bucket"] for r in borders})))
    numbers = narrow.groupBy("label", "bucket", "h").agg(F.count(F.lit(1)).alias("n"))
    for r in reached(numbers, ["label", "bucket"], "h", places).collect():
        value = r["label"] if by else sizes[0][0]
        out[value][r["piece"]] = Cut(r["h"], r["upto"] - r["goal"])
    return out


def segment_of(cuts: dict[object, list[Cut]], h: Column, by: str | None = None) -> Column:
    """The piece a row falls in by its hash ``h``, from 0; NULL for a class that was not cut."""
    def pieces(borders: list[Cut]) -> Column:
        return sum(((h > F.lit(c.at)).cast("int") for c in borders[1:]), (h > F.lit(borders[0].at)).cast("int"))

    if by is None:
        return pieces(next(iter(cuts.values())))
    out: Column | None = None
    for value, borders in cuts.items():
        test = q(by) == F.lit(value)
        out = F.when(test, pieces(borders)) if out is None else out.when(test, pieces(borders))
    return F.lit(None).cast("int") if out is None else out


def segments(
    df: DataFrame, key: Sequence[str], sizes: Sequence[tuple[object, Sequence[int]]], by: str | None = None,
    name: str = "segment", seed: int = SEED,
) -> DataFrame:
    """Cut each class, in hash order, after the given running sizes; rows of other classes are dropped."""
    if not sizes or not any(list(cuts) for _, cuts in sizes):
        return df.withColumn(name, F.lit(0))
    cuts = find_cuts(df, key, sizes, by, seed)
    # The hash has a column of its own, so that it is computed once per row.
    hashed = df.withColumn("__h", row_hash(key, seed))
    if by:
        hashed = hashed.filter(q(by).isin([value for value, _ in sizes]))
    return hashed.select(*[q(c) for c in df.columns], segment_of(cuts, F.col("__h"), by).alias(name))


def take(df: DataFrame, key: Sequence[str], sizes: Sequence[tuple[object, int]], by: str | None = None,
         seed: int = SEED, whole: bool = False) -> DataFrame:
    """Exactly the given number of rows of each class, in hash order.

    Where rows of one hash reach over the border, they are told apart by the digest of the
    whole row (``whole``); rows that are equal in that are written as often as they are
    needed, by as many tasks as it takes.
    """
    h = digest(df, df.columns) if whole else row_hash(key, seed)
    cuts = find_cuts(df, key, [(value, [n]) for value, n in sizes], by, seed, h)
    hashed = df.withColumn("__h", h)
    chosen = hashed.filter(segment_of(cuts, F.col("__h"), by) == 0)
    tied = {value: cut[0] for value, cut in cuts.items() if cut[0].over}
    if not tied:
        return chosen.drop("__h")
    at_border = {
        value: (F.col("__h") == F.lit(cut.at)) & (q(by) == F.lit(value) if by else F.lit(True)) for value, cut in tied.items()
    }
    out = chosen.filter(~reduce(lambda a, b: a | b, at_border.values())).drop("__h")
    for value, cut in tied.items():
        group = chosen.filter(at_border[value]).drop("__h")
        need = group.count() - cut.over
        if not whole:
            part = take(group, df.columns, [(0, need)], seed=seed, whole=True)
        else:
            one = group.limit(1).withColumn("__copy", F.lit(0))
            copies = df.sparkSession.range(need).select(F.lit(0).alias("__copy"))
            part = copies.join(F.broadcast(one), "__copy").select(*[q(c) for c in df.columns])  # one row
        out = out.unionByName(part)
    return out


def uniform_sample(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run."""
    if df.count() <= n:
        return df
    return take(df, default_key(df, key), [(0, n)], seed=seed)


def working_set(
    df: DataFrame, target: str, key: Sequence[str] | None = None, n: int = SAMPLE_ROWS, seed: int = SEED
) -> tuple[DataFrame, dict]:
    """The rows models train on: all of a small table, else ``n`` rows that have a target,
    stratified where the target looks like classes. Returns the rows and how they were chosen."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count(q(target)).alias("labelled")).first()
    rows, labelled = counted["rows"], counted["labelled"]
    info = {"rows_total": rows, "rows_used": rows, "sampled": False, "stratified": False}
    if rows <= n:
        return df, info
    info.update(sampled=True, rows_used=min(n, labelled), rows_with_target=labelled)
    present = df.filter(q(target).isNotNull())
    if labelled <= n:
        return present, info
    classes = class_table(present, target)
    stratify = bool(classes) and min(c for _, c in classes) >= 2 and labelled - n >= len(classes)
    info["stratified"] = stratify
    key = default_key(df, key)
    if stratify:
        quota = shares([c for _, c in classes], n)
        return take(present, key, [(v, k) for (v, _), k in zip(classes, quota)], target, seed), info
    return take(present, key, [(0, n)], seed=seed), info


def _split(
    df: DataFrame, target: str, key: Sequence[str], stratify: bool, sizes: Callable[[int], list[int]],
    name: str, seed: int,
) -> DataFrame:
    """Cut per class when stratified (running sizes proportional to the class), else over all rows."""
    if not stratify:
        return segments(df, key, [(0, sizes(df.count()))], name=name, seed=seed)
    classes = class_table(df, target)
    if classes is None:
        raise TaskError(f"{target!r} has more than {MAX_STRATA} classes.")
    counts = [n for _, n in classes]
    per_cut = [shares(counts, total) for total in sizes(sum(counts))]
    return segments(df, key, [(v, [cut[i] for cut in per_cut]) for i, (v, _) in enumerate(classes)],
                    by=target, name=name, seed=seed)


def train_test_split(
    df: DataFrame, target: str, key: Sequence[str] | None = None, stratify: bool = True,
    test_share: float = TEST_SHARE, seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: a fifth of the rows (rounded up), keeping class shares when stratified."""
    def sizes(n: int) -> list[int]:
        return [-int(-n * test_share // 1)]
    cut = _split(df, target, default_key(df, key), stratify, sizes, "__part", seed)
    return cut.withColumn("is_test", F.col("__part") == 0).drop("__part")


def early_stopping_slice(
    df: DataFrame, target: str, key: Sequence[str] | None = None, stratify: bool = True, seed: int = SEED + 2
) -> DataFrame:
    """Add ``is_validation``: a tenth of the training rows, held back to find the tree count."""
    cut = train_test_split(df, target, key, stratify, EARLY_STOPPING_SHARE, seed)
    return cut.withColumnRenamed("is_test", "is_validation")


def fold_count(df: DataFrame, target: str, classification: bool) -> int:
    if classification:
        # The rarest class decides; it needs no list of the classes.
        rarest = df.filter(q(target).isNotNull()).groupBy(q(target)).count().agg(F.min("count")).first()[0]
        return max(2, min(MAX_FOLDS, rarest or 0))
    return max(2, min(MAX_FOLDS, df.count() // ROWS_PER_FOLD))


def with_folds(
    df: DataFrame, target: str, key: Sequence[str] | None = None, classification: bool = True,
    folds: int | None = None, seed: int = SEED + 1,
) -> DataFrame:
    """Add ``fold``; fold sizes differ by at most one row, within each class when classifying."""
    key = default_key(df, key)
    if not classification:
        n = df.count()
        folds = folds or max(2, min(MAX_FOLDS, n // ROWS_PER_FOLD))
        return segments(df, key, [(0, [n * (i + 1) // folds for i in range(folds - 1)])], name="fold", seed=seed)
    classes = class_table(df, target)
    if classes is None:
        raise TaskError(f"{target!r} has more than {MAX_STRATA} classes.")
    folds = folds or max(2, min(MAX_FOLDS, min((n for _, n in classes), default=0)))
    cuts = [(v, [n * (i + 1) // folds for i in range(folds - 1)]) for v, n in classes]
    return segments(df, key, cuts, by=target, name="fold", seed=seed)


def check_class_sizes(df: DataFrame, target: str, least: int = MIN_ROWS_PER_CLASS) -> DataFrame:
    """The classes too small to be in the test set and in every training fold."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") < least)


def require_class_sizes(df: DataFrame, target: str, least: int = MIN_ROWS_PER_CLASS) -> None:
    small = [r["label"] for r in check_class_sizes(df, target, least).orderBy("label").limit(20).collect()]
    if small:
        raise TaskError(f"Classes {small} have fewer than {least} rows; collect more rows or merge rare classes.")


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """``(label, code)``: classes in sorted order, from 0. Numbers sort as numbers."""
    classes = class_table(df, target)
    if classes is None:
        raise TaskError(f"{target!r} has more than {MAX_STRATA} classes.")
    label_type = df.schema[target].dataType.simpleString()
    pairs = [(value, code) for code, (value, _) in enumerate(classes)]
    return df.sparkSession.createDataFrame(pairs, f"label {label_type}, code bigint")


def class_weights(df: DataFrame, target: str, folds: int, fold: str = "fold") -> DataFrame:
    """Balanced weights ``n / (classes * n_class)`` of every training fold, from its own labels only.

    One aggregate by (class, fold); the training rows of a fold are the total minus the fold.
    """
    cells = df.groupBy(q(target).alias("label"), q(fold).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    # At most one row per class, holding its few folds.
    per_class = cells.groupBy("label").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("own", "n"))).alias("held"))
    train = per_class.select("label", "all", "held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    train = train.select(
        "fold", "label", (F.col("all") - F.coalesce(F.col("held")[F.col("fold")], F.lit(0))).alias("train_rows")
    ).filter("train_rows > 0")
    per_fold = Window.partitionBy("fold")
    weight = F.sum("train_rows").over(per_fold) / (F.count("label").over(per_fold) * F.col("train_rows"))
    return train.select("fold", "label", "train_rows", F.round(weight, 6).alias("weight"))


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Give each row its balanced class weight; rows without a target weigh 1.

    Up to MAX_STRATA classes are literals, which needs no join; more are joined as a table.
    """
    classes = class_table(df, target)
    if classes is None:
        counts = df.filter(q(target).isNotNull()).groupBy(q(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
        totals = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__classes"))  # one row
        weights = counts.join(F.broadcast(totals)).select("__class", (F.col("__all") / (F.col("__classes") * F.col("__n"))).alias(name))
        return df.join(weights, q(target) == F.col("__class"), "left").select(
            *[q(c) for c in df.columns], F.coalesce(q(name), F.lit(1.0)).alias(name))
    total = sum(n for _, n in classes)
    weight = F.lit(1.0)
    for value, n in classes:
        weight = F.when(q(target) == F.lit(value), total / (len(classes) * n)).otherwise(weight)
    return df.withColumn(name, weight)
