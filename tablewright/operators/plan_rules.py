"""What a cleaning plan claims about a table, judged by rules over one aggregate.

A plan is first turned into claims: one for each code, category, date part, new column, merge and
drop. A claim names the figures it needs, as aggregate expressions, and its rules, each a reason
and a test of those figures. All figures come from one pass; then the claims are judged in order, and
those that no rule refuses enter the cleaning spec.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as V
from tablewright.functions.formula import FormulaError
from tablewright.functions.kinds import kind, q
from tablewright.operators.cleaning import CleaningSpec, NewColumn

# What a plan may ask for.
MOST_LEVELS = 1_000
LEAST_DATES = 0.9
MOST_EDGES = 20
NAME_LENGTH, LABEL_LENGTH = 64, 40
LEAST_FILLED = 0.5

NOTES = "item string, column string, accepted boolean, reason string"


@dataclass
class Draft:
    """The spec so far."""
    missing: dict[str, list] = field(default_factory=dict)
    categorical: list[str] = field(default_factory=list)
    dates: dict[str, list[str]] = field(default_factory=dict)
    columns: list[NewColumn] = field(default_factory=list)
    merges: dict[str, list[str]] = field(default_factory=dict)
    goes_to: dict[str, str] = field(default_factory=dict)  # label: the one it is written as

    def spec(self) -> CleaningSpec:
        return CleaningSpec(self.missing, self.columns, self.categorical, self.dates, self.merges)


Figures = Mapping[str, object]
Rule = tuple[str, Callable[[Figures, Draft], bool]]  # why not, and when


@dataclass
class Claim:
    item: str
    column: str
    rules: list[Rule]
    figures: dict[str, Column] = field(default_factory=dict)
    grant: Callable[[Draft], None] = lambda draft: None


@dataclass(frozen=True)
class Setting:
    """What claims are made about."""
    types: Mapping[str, T.DataType]
    target: str
    task: str
    drops: frozenset[str]

    def about_column(self, item: Mapping) -> list[Rule]:
        c = item.get("column")
        return [
            _always("the target is left as it is", c == self.target),
            _always("the table has no such column", c not in self.types),
            _always("the column is to be dropped", c in self.drops),
            _always("the plan gives no evidence", not _words(item.get("evidence"))),
        ]


def _always(reason: str, holds: bool) -> Rule:
    return reason, lambda figures, draft: holds


def _words(value: object, most: int | None = None) -> str:
    return ("" if value is None else str(value).strip())[:most]


def _known(setting: Setting, item: Mapping, figures: Callable[[Column, T.DataType], dict[str, Column]]) -> dict[str, Column]:
    """Figures of a column, if the table has it."""
    c = item.get("column")
    return figures(q(c), setting.types[c]) if c in setting.types else {}


def _codes(setting: Setting, item: Mapping) -> Iterator[Claim]:
    c = item.get("column")
    for code in dict.fromkeys(item.get("values") or []):
        plain = isinstance(code, (str, int, float)) and not isinstance(code, bool)
        yield Claim(
            "missing_codes", str(c),
            [*setting.about_column(item), _always(f"{code!r} is neither text nor a number", not plain),
             (f"no row holds {code!r}", lambda figures, draft: not figures["rows"])],
            _known(setting, item, lambda v, t: {"rows": F.count_if(V.is_code(v, t, [code]))}) if plain else {},
            lambda draft, code=code: draft.missing.setdefault(c, []).append(code) if code not in draft.missing.get(c, []) else None)


def _categories(setting: Setting, item: Mapping) -> Iterator[Claim]:
    c = item.get("column")
    yield Claim(
        "categorical", str(c),
        [*setting.about_column(item), _always("text and flags are categories already", c in setting.types and kind(setting.types[c]) != "numeric"),
         ("it is listed before", lambda figures, draft: c in draft.categorical),
         (f"it has more than {MOST_LEVELS} codes", lambda figures, draft: figures["levels"] > MOST_LEVELS)],
        # Only whether there are more than so many matters: the table of levels is cut there.
        _known(setting, item, lambda v, t: {"levels": F.approx_count_distinct(v, 0.01)}),
        lambda draft: draft.categorical.append(c))


def _dates(setting: Setting, item: Mapping) -> Iterator[Claim]:
    c = item.get("column")

    def figures(value: Column, data_type: T.DataType) -> dict[str, Column]:
        stamp = V.parse_timestamp(value, data_type)
        spread = {p: F.min(V.date_part(stamp, p)) < F.max(V.date_part(stamp, p)) for p in V.DATE_PARTS}
        return {"filled": F.count(value), "read": F.count(stamp), **spread}

    for part in dict.fromkeys(item.get("parts") or []):
        yield Claim(
            "date_parts", str(c),
            [*setting.about_column(item), _always(f"there is no part {part!r} of a date", part not in V.DATE_PARTS),
             ("it serves as a category", lambda figures, draft: c in draft.categorical),
             _always("numbers and flags are no dates", c in setting.types and kind(setting.types[c]) in ("numeric", "boolean")),
             ("most of its values are no dates", lambda figures, draft: figures["read"] < LEAST_DATES * max(figures["filled"], 1)),
             (f"all rows have the same {part}", lambda figures, draft, part=part: not figures[part]),
             (f"the {part} is listed before", lambda figures, draft, part=part: part in draft.dates.get(c, []))],
            _known(setting, item, figures), lambda draft, part=part: draft.dates.setdefault(c, []).append(part))


def _ranges(name: str, bins: Mapping) -> tuple[NewColumn | None, str]:
    edges = [float(e) for e in bins.get("edges") or [] if type(e) in (int, float) and math.isfinite(e)]
    labels = [_words(x, LABEL_LENGTH) for x in bins.get("labels") or []]
    if len(edges) != len(bins.get("edges") or []) or not 1 <= len(edges) <= MOST_EDGES or sorted(set(edges)) != edges:
        return None, f"ranges need 1 to {MOST_EDGES} rising cut points"
    if len(set(labels) - {""}) != len(edges) + 1 or len(labels) != len(edges) + 1:
        return None, f"{len(edges)} cut points need {len(edges) + 1} different labels"
    return NewColumn(name, None, bins.get("column"), tuple(edges), tuple(labels)), ""


def _built(item: Mapping) -> tuple[NewColumn | None, str]:
    """The column an item describes, or why it describes none."""
    name, formula, bins = _words(item.get("name"), NAME_LENGTH), item.get("formula"), item.get("bins")
    if not name:
        return None, "a column needs a name"
    if (not formula) == (not isinstance(bins, Mapping)):
        return None, "a column comes from a formula or from ranges"
    if not formula:
        return _ranges(name, bins)
    column = NewColumn(name, _words(formula))
    try:
        column.sources()
    except FormulaError as error:
        return None, str(error)
    return column, ""


def _new_columns(setting: Setting, item: Mapping) -> Iterator[Claim]:
    column, why_not = _built(item)
    name = _words(item.get("name"), NAME_LENGTH)
    sources = column.sources() if column else []
    lost = [s for s in sources if s not in setting.types or s in setting.drops]
    figures = {}
    if column and sources and all(s in setting.types for s in sources):
        value = column.build(setting.types)
        figures = {"all": F.count(F.lit(1)), "filled": F.count(value), "differ": F.min(value) < F.max(value)}
    yield Claim(
        "new_columns", name,
        [_always(why_not, bool(why_not)), _always("it reads no column", not sources),
         _always("it reads the target", setting.target in sources),
         _always(f"the model has no {', '.join(map(str, lost))}", bool(lost)),
         (f"{name!r} is in use", lambda figures, draft: name in setting.types or "__" in name or name in {c.name for c in draft.columns}),
         ("most rows have no value", lambda figures, draft: figures["filled"] < LEAST_FILLED * figures["all"]),
         ("all rows have one value", lambda figures, draft: not figures["differ"])],
        figures, lambda draft: draft.columns.append(column))


def _merges(setting: Setting, item: Mapping) -> Iterator[Claim]:
    into = _words(item.get("into"))
    others = sorted({_words(v) for v in item.get("labels") or []} - {into})
    label = V.text(q(setting.target))
    names = [into, *others]

    def grant(draft: Draft) -> None:
        draft.goes_to.update(dict.fromkeys(names, into))
        draft.merges[into] = list(dict.fromkeys([*draft.merges.get(into, []), *others]))

    yield Claim(
        "label_merges", setting.target,
        [_always("a number has no labels", setting.task != "classification"),
         _always("the plan gives no evidence", not _words(item.get("evidence"))),
         _always("there is nothing to merge", not others),
         (f"no row has one of the labels {names}", lambda figures, draft: not all(figures[f"label{i}"] for i in range(len(names)))),
         ("another merge says otherwise", lambda figures, draft: any(draft.goes_to.get(n, into) != into for n in names))],
        {f"label{i}": F.count_if(label == n) for i, n in enumerate(names)}, grant)


#: Key of the plan: the claims that an item under it makes. Later ones may depend on earlier ones.
CLAIMS: dict[str, Callable[[Setting, Mapping], Iterator[Claim]]] = {
    "missing_value_codes": _codes, "label_merges": _merges, "categorical_columns": _categories, "date_features": _dates,
    "new_columns": _new_columns,
}


def judge(claims: Sequence[Claim], figures: Sequence[Figures], draft: Draft) -> list[tuple[str, str, bool, str]]:
    """One note per claim; those that no rule refuses are granted."""
    notes = []
    for claim, seen in zip(claims, figures):
        why_not = next((reason for reason, test in claim.rules if test(seen, draft)), "")
        if not why_not:
            claim.grant(draft)
        notes.append((claim.item, claim.column, not why_not, why_not))
    return notes


def _measured(df: DataFrame, claims: Sequence[Claim]) -> list[dict[str, object]]:
    """The figures of all claims, from one aggregate."""
    wanted = [(i, name, column) for i, claim in enumerate(claims) for name, column in claim.figures.items()]
    out: list[dict[str, object]] = [{} for _ in claims]
    if wanted:
        row = df.agg(*[column.alias(f"f{n}") for n, (_, _, column) in enumerate(wanted)]).first()
        for n, (i, name, _) in enumerate(wanted):
            out[i][name] = row[n]
    for claim, figures in zip(claims, out):
        # A sketch can't decide near the limit; there the levels are counted, up to one too many.
        if "levels" in figures and 0.9 * MOST_LEVELS < figures["levels"] < 1.1 * MOST_LEVELS:
            figures["levels"] = df.select(q(claim.column)).na.drop().distinct().limit(MOST_LEVELS + 1).count()
    return out


def _classes_left(df: DataFrame, target: str, goes_to: Mapping[str, str]) -> bool:
    """Whether two classes remain when labels are written as the merges say."""
    label = V.text(q(target))
    merged = reduce(lambda out, pair: F.when(label == pair[0], pair[1]).otherwise(out), goes_to.items(), label)
    return bool(df.agg((F.min(merged) < F.max(merged)).alias("two")).first()["two"])


def judge_plan(df: DataFrame, target: str, task: str, plan: Mapping, drops: Sequence[str] = ()) -> tuple[CleaningSpec, DataFrame]:
    """The part of a plan that the table bears out, as a spec, and one note per claim.

    The plan's keys are those of ``CLAIMS``. Labels and codes are looked up by their own count, so
    neither their number nor that of the target's labels is limited.
    """
    setting = Setting({f.name: f.dataType for f in df.schema.fields}, target, task, frozenset(drops))
    claims = [c for key, make in CLAIMS.items() for item in plan.get(key) or [] if isinstance(item, Mapping) for c in make(setting, item)]
    draft = Draft()
    notes = judge(claims, _measured(df, claims), draft)
    if draft.merges and not _classes_left(df, target, draft.goes_to):
        draft.merges = {}
        notes.append(("label_merges", target, False, "one class would be left"))
    return draft.spec(), df.sparkSession.createDataFrame(notes, NOTES)


def judge_drops(columns: Sequence[str], target: str, drops: Sequence[Mapping]) -> tuple[list[str], list[str]]:
    """The columns that may be dropped, and why others may not."""
    setting = Setting(dict.fromkeys(columns, T.StringType()), target, "", frozenset())
    kept: list[str] = []
    claims = [Claim("drop", str(d.get("column")), setting.about_column(d), grant=lambda draft, d=d: kept.append(d["column"])) for d in drops]
    notes = [f"{column}: {reason}" for _, column, _, reason in judge(claims, [{}] * len(claims), Draft()) if reason]
    kept = list(dict.fromkeys(kept))
    if len(columns) - len(kept) < 2:  # the target and one feature
        return [], [*notes, "without these columns no feature would be left"]
    return kept, notes
