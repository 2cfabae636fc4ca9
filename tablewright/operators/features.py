"""Structural decisions on a table, and the encoders models are trained on.

Encoders are fitted from aggregates on the training rows only. Small level lists
become literal expressions, so that scoring is a projection; a long level list stays
a table and is joined.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions import values as V
from tablewright.functions.kinds import columns_of, kinds, q
from tablewright.operators.cleaning import CleaningSpec, column_sources, merge_labels, merged_rows, prepare
from tablewright.operators.ordering import position, quantiles
from tablewright.operators.profile import profile, rows_per_column, value_counts

# Fixed values.
MISSING_SHARE = 0.5
ID_SHARE = 0.95
ONE_HOT_LEVELS = 10
POOLED_LEVELS = 20
FORM_CHOICES = 100
LITERAL_LEVELS = 900  # longer level lists are joined instead of written into the plan; Spark's top-n per group goes to 1,000


# -- structural drops --------------------------------------------------------------


def drop_decisions(df: DataFrame, target: str) -> DataFrame:
    """``(column, reason)`` for every column that does not reach the model."""
    features = [c for c in df.columns if c != target]
    known = kinds(df)
    rows_and_gaps = rows_per_column(
        {c: {"rows": F.count(F.lit(1)), "missing": F.count_if(q(c).isNull())} for c in features}, df)
    temporal = [c for c in features if known[c] in ("temporal", "interval")]
    words = [c for c in features if known[c] in ("text", "nested")]
    gaps = F.when(F.col("missing") > MISSING_SHARE * F.col("rows"), "more than 50% missing")
    dates = F.when(F.col("column").isin(temporal), "date or time") if temporal else F.lit(None)
    reasons = rows_and_gaps.select("column", F.coalesce(gaps, dates).alias("reason"))
    if words:
        labelled = profile(df.filter(q(target).isNotNull()), words)
        ids = labelled.select("column", (F.col("unique") >= ID_SHARE * F.col("rows")).alias("id_like"))
        reasons = reasons.join(F.broadcast(ids), "column", "left").select(  # one row per column
            "column", F.coalesce("reason", F.when(F.col("id_like"), "id-like")).alias("reason"))
    return reasons.filter("reason IS NOT NULL")


def encoding_plan(df: DataFrame, target: str) -> DataFrame:
    """``(column, encoding, levels)`` of the columns that are not numbers."""
    words = [c for c in columns_of(df, "text") if c != target]
    if not words:
        return df.sparkSession.createDataFrame([], "column string, encoding string, levels bigint")
    stats = profile(df, words)
    encoding = F.when(F.col("unique") <= ONE_HOT_LEVELS, "one_hot").otherwise("ordinal")
    return stats.select("column", encoding.alias("encoding"), F.col("unique").alias("levels"))


@dataclass(frozen=True)
class Engineered:
    """A table ready for training, and how raw inputs become it."""

    table: DataFrame
    spec: CleaningSpec
    input_columns: list[str]
    model_columns: list[str]
    report: DataFrame


def _within(spec: CleaningSpec, raw: Collection[str], made: Callable[[str], bool] = lambda name: True) -> CleaningSpec:
    """The part of a spec that works on the given raw columns and makes wanted columns."""
    parts = {c: [p for p in ps if made(f"{c}__{p}")] for c, ps in spec.date_parts.items() if c in raw}
    return replace(
        spec, missing_codes={c: v for c, v in spec.missing_codes.items() if c in raw},
        new_columns=[n for n in spec.new_columns if made(n.name) and set(n.sources()) <= set(raw)],
        categorical=[c for c in spec.categorical if c in raw], date_parts={c: ps for c, ps in parts.items() if ps})


def _spec_notes(spec: CleaningSpec) -> list[tuple[str, str, str]]:
    said = {
        "missing_codes": lambda: [(c, f"codes {list(v)} are missing values") for c, v in spec.missing_codes.items()],
        "new_columns": lambda: [(n.name, f"new column: {n.formula or f'ranges of {n.column}'}") for n in spec.new_columns],
        "categorical": lambda: [(c, "codes are categories") for c in spec.categorical],
        "date_parts": lambda: [(c, f"turned into {', '.join(p)}") for c, p in spec.date_parts.items()],
    }
    return [("cleaned", column, detail) for notes in said.values() for column, detail in notes()]


def engineer(df: DataFrame, target: str, spec: CleaningSpec | None = None, drops: Sequence[str] = ()) -> Engineered:
    """The table a model trains on, the spec that scoring repeats, and a report.

    Three selects (the drops, the spec, the structural drops) with one report per step; the rows are
    read for the merged labels, the structural facts, the encodings and the final count.
    """
    spec = spec or CleaningSpec()
    gone = [c for c in drops if c in df.columns and c != target]
    start = df.select(*[q(c) for c in df.columns if c not in gone])
    raw = [c for c in start.columns if c != target]
    usable = _within(spec, raw, lambda name: name not in start.columns)
    cleaned = prepare(merge_labels(start, target, spec.label_merges), usable)
    structural = [(r["column"], r["reason"]) for r in drop_decisions(cleaned, target).collect()]
    model = [c for c in cleaned.columns if c != target and c not in dict(structural)]
    table = cleaned.select(*[q(c) for c in cleaned.columns if c == target or c in model]).filter(q(target).isNotNull())

    origin = column_sources(usable)
    inputs = [c for c in dict.fromkeys(s for m in model for s in origin.get(m, [m]))]
    merged = merged_rows(start, target, spec.label_merges).collect() if spec.label_merges else []
    report = [
        *[("dropped", c, "per analysis") for c in gone],
        *[("cleaned", target, f"merged labels into {r['label']} ({r['rows_changed']} rows)") for r in merged],
        *_spec_notes(usable), *[("dropped", c, why) for c, why in structural],
        *[("encoded", r["column"], f"{r['encoding']}, {r['levels']} levels") for r in encoding_plan(table, target).collect()],
        ("result", "features", str(len(model))), ("result", "rows", str(table.count())),
    ]
    kept = _within(usable, inputs, lambda name: name in model)
    return Engineered(table, kept, inputs, model, df.sparkSession.createDataFrame(report, "step string, column string, detail string"))


# -- values for forms ----------------------------------------------------------------


def form_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = FORM_CHOICES) -> DataFrame:
    """Per text column of at most ``limit`` values: its trimmed values, numbers first and in number order."""
    words = list(columns or columns_of(df, "text"))
    trimmed = df.select(*[F.when(V.text(q(c)) != "", V.text(q(c))).alias(c) for c in words])
    # One value more than the limit shows that a column is too long; no more than that is ever gathered.
    values = commonest(trimmed, words, limit + 1).withColumnRenamed("level", "value")
    as_number = V.number_text(F.col("value"))
    entry = F.struct(
        F.when(as_number.isNull(), 1).otherwise(0).alias("group"), F.coalesce(as_number, F.lit(0.0)).alias("number"),
        F.lower("value").alias("lower"), "value")
    lists = values.groupBy("column").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    lists = lists.filter(F.size("entries") <= limit)
    return lists.select("column", F.transform("entries", lambda e: e["value"]).alias("choices"))


# -- fitted values --------------------------------------------------------------------


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)``: the most frequent text per column, the smallest on a tie."""
    counts = value_counts(df, columns).filter("value IS NOT NULL")
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def medians(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    marks = quantiles(df, columns, [0.5], rows)
    return rows_per_column({c: {"m": marks[c]} for c in columns}, df).select("column", F.col("m")[0].alias("median"))


def scales(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """``(column, median, mean, std)``: mean and population deviation once gaps hold the median.

    Filling moves the moments by a known amount, so one pass gives all three.
    """
    marks = quantiles(df, columns, [0.5], rows)
    exprs = {}
    for c in columns:
        v = q(c).cast("double")
        exprs[c] = {"n": F.count(v), "rows": F.count(F.lit(1)), "m": F.avg(v), "v": F.var_pop(v), "marks": marks[c]}
    seen = rows_per_column(exprs, df).select("*", F.col("marks")[0].alias("median"))
    gaps = F.col("rows") - F.col("n")
    mean = (F.col("n") * F.col("m") + gaps * F.col("median")) / F.col("rows")
    moved = seen.withColumn("mean", mean)
    own = F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2)
    filled = gaps * (F.col("median") - F.col("mean")) ** 2
    return moved.select("column", "median", "mean", F.sqrt((own + filled) / F.col("rows")).alias("std"))


def commonest(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """``(column, level, n, rank)``: at most ``limit`` levels per column, the most frequent first, ties by value.

    Spark keeps that many per task before the shuffle.
    """
    counts = value_counts(df, columns).filter("value IS NOT NULL")
    by_size = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= limit)
    return ranked.select("column", F.col("value").alias("level"), "n", "rank")


def frequent_levels(df: DataFrame, columns: Sequence[str], limit: int = POOLED_LEVELS) -> DataFrame:
    """``(column, level, n)``: all levels of a short column, else the ``limit - 1`` most frequent."""
    longest = Window.partitionBy("column")
    kept = commonest(df, columns, limit + 1).withColumn("longest", F.max("rank").over(longest)).filter(
        (F.col("longest") <= limit) | (F.col("rank") <= limit - 1))
    return kept.select("column", "level", "n")


def level_codes(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """``(level, code)``: sorted levels numbered from 0, whatever their number."""
    levels = df.filter(q(column).isNotNull()).select(q(column).cast("string").alias("level")).distinct()
    numbered = position(levels, [F.col("level")], "code", rows=rows)
    return numbered.select("level", (F.col("code") - 1).alias("code"))


def one_hot(value: Column, levels: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per level (a two-level column needs only its second); unknown values are all zero."""
    shown = list(levels)[1:] if len(levels) == 2 else list(levels)
    return [F.when(value == F.lit(x), 1.0).otherwise(0.0).alias(f"{prefix}_{x}") for x in shown]


# -- the encoder -------------------------------------------------------------------------


@dataclass
class Encoder:
    """How prepared columns become a feature vector. ``style`` is ``tree``, ``ordinal`` or ``scaled``."""

    style: str
    numeric: list[str]
    text: list[str]
    below: dict[str, float] = field(default_factory=dict)  # tree styles: the stand-in for a gap
    scale: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    fill: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)  # one-hot
    pooled: list[str] = field(default_factory=list)  # one-hot with an "other" column
    codes: dict[str, list[str]] = field(default_factory=dict)  # ordinal
    tables: dict[str, DataFrame] = field(default_factory=dict)  # ordinal with too many levels for a literal

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], style: str, rows: int | None = None) -> "Encoder":
        numeric = [c for c in features if c in columns_of(df, "numeric", "boolean")]
        text = [c for c in features if c not in numeric]
        rows = df.count() if rows is None else rows
        enc = Encoder(style, numeric, text)
        # One bounded list of levels per column says what fills gaps, which levels there are, and whether there are more.
        limit = POOLED_LEVELS if style == "scaled" else LITERAL_LEVELS
        levels: dict[str, list[str]] = {c: [] for c in text}
        if text:
            for r in sorted(commonest(df, text, limit + 1).collect(), key=lambda r: r["rank"]):
                levels[r["column"]].append(r["level"])
        enc.fill = {c: found[0] for c, found in levels.items() if found}
        if style == "scaled":
            if numeric:
                for r in scales(df, numeric, rows).collect():
                    enc.scale[r["column"]] = (r["median"] or 0.0, r["mean"] or 0.0, r["std"] or 1.0)
            enc.pooled = [c for c in text if len(levels[c]) > limit]
            enc.levels = {c: sorted(levels[c][:limit - 1] if c in enc.pooled else levels[c]) for c in text}
            return enc
        if numeric:
            ends = rows_per_column(
                {c: {"lo": F.min(q(c).cast("double")), "hi": F.max(q(c).cast("double"))} for c in numeric}, df)
            enc.below = {r["column"]: (r["lo"] or 0.0) - 1.0 - ((r["hi"] or 0.0) - (r["lo"] or 0.0)) for r in ends.collect()}
        for c in text:
            if len(levels[c]) > limit:
                enc.tables[c] = level_codes(df, c, rows)
            elif style == "tree" and len(levels[c]) <= ONE_HOT_LEVELS:
                enc.levels[c] = sorted(levels[c])
            else:
                enc.codes[c] = sorted(levels[c])
        return enc

    def _columns(self) -> list[Column]:
        out: list[Column] = []
        for c in self.numeric:
            x = q(c).cast("double")
            if self.style == "scaled":
                median, mean, std = self.scale[c]
                out.append(((F.coalesce(x, F.lit(median)) - mean) / (std or 1.0)).alias(c))
            else:
                out.append(F.coalesce(x, F.lit(self.below[c])).alias(c))
        for c in self.text:
            value = F.coalesce(q(c).cast("string"), F.lit(self.fill.get(c)))
            if c in self.levels and self.style == "tree":
                out += one_hot(value, self.levels[c], c)
            elif c in self.levels:
                out += [F.when(value == F.lit(x), 1.0).otherwise(0.0).alias(f"{c}_{x}") for x in self.levels[c]]
                if c in self.pooled:
                    known = value.isin(self.levels[c])
                    out.append(F.when(known, 0.0).otherwise(1.0).alias(f"{c}_other"))
            elif c in self.codes:
                spot = F.array_position(F.array(*[F.lit(x) for x in self.codes[c]]), value)
                out.append((F.coalesce(spot, F.lit(0)) - 1).cast("double").alias(c))
            else:
                out.append(F.coalesce(F.col(f"__code_{self.text.index(c)}"), F.lit(-1)).cast("double").alias(c))
        return out

    def names(self) -> list[str]:
        """The encoded feature names, in vector order."""
        out = list(self.numeric)
        for c in self.text:
            if c in self.levels:
                shown = self.levels[c][1:] if self.style == "tree" and len(self.levels[c]) == 2 else self.levels[c]
                out += [f"{c}_{x}" for x in shown] + ([f"{c}_other"] if c in self.pooled else [])
            else:
                out.append(c)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add the feature vector; every other column is kept."""
        wide, flat = self._wide(df)
        out = VectorAssembler(inputCols=flat, outputCol=features, handleInvalid="keep").transform(wide)
        return out.select(*[q(c) for c in df.columns], features)

    def numbers(self, df: DataFrame, features: str) -> DataFrame:
        """As :meth:`transform`, with the features as a plain array."""
        wide, flat = self._wide(df)
        return wide.select(*[q(c) for c in df.columns], F.array(*flat).alias(features))

    def _wide(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        for c, table in self.tables.items():
            i = self.text.index(c)
            codes = table.select(F.col("level").alias(f"__level_{i}"), F.col("code").alias(f"__code_{i}"))
            value = F.coalesce(q(c).cast("string"), F.lit(self.fill.get(c)))
            df = df.join(codes, value == F.col(f"__level_{i}"), "left")
        encoded = self._columns()
        flat = [f"__f{i}" for i in range(len(encoded))]
        return df.withColumns({n: e for n, e in zip(flat, encoded)}), flat

    def describe(self, spark: SparkSession) -> DataFrame:
        """``(column, treatment, outputs)`` of the fitted encoder."""
        rows = [(c, "standardised" if self.style == "scaled" else "as is", [c]) for c in self.numeric]
        for c in self.text:
            treatment = "one_hot_pooled" if c in self.pooled else "one_hot" if c in self.levels else "ordinal"
            rows.append((c, treatment, self.levels.get(c) or self.codes.get(c) or []))
        return spark.createDataFrame(rows, "column string, treatment string, outputs array<string>")

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {k: v for k, v in self.__dict__.items() if k != "tables"}
        plain["tables"] = list(self.tables)
        spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/encoder")
        for i, table in enumerate(self.tables.values()):
            table.write.mode("overwrite").parquet(f"{path}/levels_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Encoder":
        raw = json.loads(spark.read.text(f"{path}/encoder").first()[0])
        tables = {c: spark.read.parquet(f"{path}/levels_{i}") for i, c in enumerate(raw.pop("tables"))}
        raw["scale"] = {c: tuple(v) for c, v in raw["scale"].items()}
        return Encoder(**raw, tables=tables)


