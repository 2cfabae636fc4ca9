"""A search over a family's settings whose cost is counted in fitted folds.

A search is a :class:`Search`: what has been tried, what it cost and what is best. Settings
come from a fixed list first, then from seeded draws, and once enough trials have told a score from a guide: the
settings of the best trials and those of the rest are two densities over all settings jointly, and of some candidates drawn
near the good ones the one with the greatest ratio is tried. After each fold a stop rule may give a trial
up: with large folds successive halving on the running means, with small ones the median of
the trials that ran to their end. Several trials may run side by side; each rung then compares with those that have reached it.
"""

from __future__ import annotations

import json
import math
import random
import statistics
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
PATIENCE = 5  # whole cross-validations without a gain
HALVING_FOLD_ROWS = 10_000
RUNGS = (1, 3)
KEPT_SHARE = 1 / 3
MEDIAN_AFTER_TRIALS = 4
MEDIAN_AFTER_FOLDS = 2
GUIDED_AFTER = 10  # trials with a score
GOOD_SHARE = 0.15
CANDIDATES = 32
NARROWEST = 0.1  # of a range, for the width of a density's bumps
# (low, high, scale) per setting; a list is a choice.
RANGES: dict[str, dict[str, object]] = {
    "boosted": {"learning_rate": (0.015, 0.3, "log"), "max_depth": (3, 10, "int"), "subsample": (0.6, 1.0, "linear"),
                "column_share": (0.5, 1.0, "linear")},
    "leafwise": {"learning_rate": (0.015, 0.3, "log"), "max_leaves": (8, 256, "logint"), "subsample": (0.6, 1.0, "linear"),
                 "column_share": (0.5, 1.0, "linear")},
    "forest": {"max_depth": (3, 10, "int"), "subsample": (0.6, 1.0, "linear"), "column_share": (0.5, 1.0, "linear")},
    "boosted_codes": {"learning_rate": (0.015, 0.3, "log"), "max_depth": (4, 10, "int")},
    "kernel": {"C": (1e-2, 1e2, "log"), "gamma": (1e-4, 1.0, "log")},
    "neighbours": {"n_neighbors": (3, 60, "logint"), "weights": ["uniform", "distance"]},
    "linear": {"strength": (1e-3, 1e2, "log")},
}
# The settings tried first, without those that these families do not have.
STARTS: dict[str, list[dict[str, object]]] = {
    "boosted": [
        {"learning_rate": 0.0181, "max_depth": 10, "subsample": 1.0, "column_share": 0.692},
        {"learning_rate": 0.0878, "max_depth": 5, "subsample": 1.0, "column_share": 0.663},
        {"learning_rate": 0.0929, "max_depth": 7, "subsample": 1.0, "column_share": 0.909},
        {"learning_rate": 0.0384, "max_depth": 7, "subsample": 1.0, "column_share": 0.745},
        {"learning_rate": 0.0779, "max_depth": 6, "subsample": 1.0, "column_share": 0.633},
    ],
    "leafwise": [
        {"learning_rate": 0.03, "max_leaves": 128, "subsample": 1.0, "column_share": 0.9},
        {"learning_rate": 0.0471, "max_leaves": 89, "subsample": 1.0, "column_share": 0.625},
        {"learning_rate": 0.0186, "max_leaves": 22, "subsample": 1.0, "column_share": 0.742},
        {"learning_rate": 0.0313, "max_leaves": 210, "subsample": 1.0, "column_share": 0.825},
    ],
    "forest": [{"max_depth": 10, "subsample": 1.0, "column_share": 0.6}],
    "boosted_codes": [
        {"learning_rate": 0.0686, "max_depth": 6}, {"learning_rate": 0.0494, "max_depth": 4},
        {"learning_rate": 0.0173, "max_depth": 8}, {"learning_rate": 0.0503, "max_depth": 5},
        {"learning_rate": 0.0848, "max_depth": 7},
    ],
    "kernel": [{"C": 10.0, "gamma": 0.01}, {"C": 1.0, "gamma": 0.1}, {"C": 100.0, "gamma": 0.001}],
    "neighbours": [{"n_neighbors": 5, "weights": "distance"}, {"n_neighbors": 30, "weights": "distance"},
                   {"n_neighbors": 15, "weights": "uniform"}],
    "linear": [{"strength": 0.01}, {"strength": 0.1}, {"strength": 10.0}],
}

LOG = "trial int, origin string, settings string, folds int, score double, outcome string, error string"


def draw(name: str, rng: random.Random) -> dict[str, object]:
    """One random setting inside the ranges of a family."""
    out: dict[str, object] = {}
    for setting, span in RANGES[name].items():
        if isinstance(span, list):
            out[setting] = rng.choice(span)
            continue
        low, high, scale = span  # type: ignore[misc]
        if "log" in scale:
            value = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            value = rng.uniform(low, high)
        out[setting] = min(max(round(value), low), high) if "int" in scale else value
    return out


def _place(value: object, span: object) -> float:
    """Where a setting lies in its range, from 0 to 1 (a choice: its number)."""
    if isinstance(span, list):
        return float(span.index(value))
    low, high, scale = span  # type: ignore[misc]
    if "log" in scale:
        low, high, value = math.log(low), math.log(high), math.log(value)
    return (float(value) - low) / (high - low)


def _setting(place: float, span: object) -> object:
    if isinstance(span, list):
        return span[int(place)]
    low, high, scale = span  # type: ignore[misc]
    value = math.exp(math.log(low) + place * (math.log(high) - math.log(low))) if "log" in scale else low + place * (high - low)
    return min(max(round(value), low), high) if "int" in scale else min(max(value, low), high)


class _Density:
    """A sum of bumps around settings, and one flat part: joint, so that settings that go together stay together."""

    def __init__(self, places: Sequence[Sequence[float]], spans: Sequence[object]):
        self.places, self.spans = places, spans
        shrink = max(1, len(places)) ** (-1 / (len(spans) + 4))
        self.widths = []
        for i, span in enumerate(spans):
            column = [p[i] for p in places]
            self.widths.append(0.0 if isinstance(span, list) else max(NARROWEST, shrink * (statistics.pstdev(column) if len(column) > 1 else 0.3)))

    def draw(self, rng: random.Random) -> list[float]:
        at = rng.randrange(len(self.places) + 1)
        if at == len(self.places):
            return [float(rng.randrange(len(s))) if isinstance(s, list) else rng.random() for s in self.spans]
        out = []
        for value, width, span in zip(self.places[at], self.widths, self.spans):
            if isinstance(span, list):
                out.append(value if rng.random() < 0.8 else float(rng.randrange(len(span))))
            else:
                out.append(next(p for p in iter(lambda value=value, width=width: rng.gauss(value, width), None) if 0 <= p <= 1))
        return out

    def log(self, at: Sequence[float]) -> float:
        total = 1.0
        for place in self.places:
            part = 1.0
            for value, mine, width, span in zip(at, place, self.widths, self.spans):
                if isinstance(span, list):
                    part *= (0.8 if value == mine else 0.0) * len(span) + 0.2
                else:
                    # A bump is cut at the ends of the range, so what is left of it counts in full there.
                    inside = (math.erf((1 - mine) / width / math.sqrt(2)) + math.erf(mine / width / math.sqrt(2))) / 2
                    part *= math.exp(-0.5 * ((value - mine) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
            total += part
        return math.log(total / (len(self.places) + 1))


def guided(name: str, trials: Sequence[Trial], rng: random.Random) -> dict[str, object]:
    """Of some settings near those of the best trials, the one that the best make likelier than the rest by most.

    Whole trials stand before those given up, and among either the higher mean first.
    """
    spans = list(RANGES[name].values())
    told = sorted((t for t in trials if t.means), key=lambda t: (t.outcome == "whole", t.means[-1]), reverse=True)
    places = [[_place(t.settings[s], span) for s, span in RANGES[name].items()] for t in told]
    cut = math.ceil(GOOD_SHARE * len(places))
    good, rest = _Density(places[:cut], spans), _Density(places[cut:], spans)
    best = max((good.draw(rng) for _ in range(CANDIDATES)), key=lambda at: good.log(at) - rest.log(at))
    return {s: _setting(p, span) for (s, span), p in zip(RANGES[name].items(), best)}


def proposals(name: str, seed: int, trials: Sequence[Trial] = (), guided_after: int | None = None) -> Iterator[tuple[str, dict[str, object]]]:
    """Settings without end, each with where it comes from. ``trials`` may grow between two of them."""
    least = GUIDED_AFTER if guided_after is None else guided_after
    for settings in STARTS[name]:
        yield "listed", dict(settings)
    rng = random.Random(seed)
    while True:
        if sum(bool(t.means) for t in trials) < least:
            yield "drawn", draw(name, rng)
        else:
            yield "guided", guided(name, list(trials), rng)


def noise(scores: Sequence[float]) -> float:
    """The standard error of a cross-validated mean."""
    return statistics.pstdev(scores) / math.sqrt(len(scores))


@dataclass
class Trial:
    """One setting: the running mean after each fold, and how it ended."""
    origin: str
    settings: dict[str, object]
    means: list[float] = field(default_factory=list)
    folds: int = 0  # begun, a failed one too
    outcome: str = "open"  # open, whole, given up, failed
    error: str | None = None

    @property
    def score(self) -> float | None:
        return self.means[-1] if self.outcome == "whole" else None


Rule = Callable[[Sequence[Trial], Trial, int], bool]  # earlier trials, this one, folds of a whole check: give up?


def halving(earlier: Sequence[Trial], trial: Trial, folds: int) -> bool:
    """At each rung, only the best third of the trials that came so far go on."""
    step = len(trial.means)
    if step not in RUNGS:
        return False
    reached = sorted((t.means[step - 1] for t in [*earlier, trial] if len(t.means) >= step), reverse=True)
    places = max(1, math.floor(len(reached) * KEPT_SHARE))
    return trial.means[-1] < reached[places - 1]


def median(earlier: Sequence[Trial], trial: Trial, folds: int) -> bool:
    """Once enough trials are whole, one that is behind their median at this fold is given up."""
    step = len(trial.means)
    whole = [t.means[step - 1] for t in earlier if t.outcome == "whole"]
    late = MEDIAN_AFTER_FOLDS < step < folds
    return late and len(whole) >= MEDIAN_AFTER_TRIALS and trial.means[-1] < statistics.median(whole)


def rule_of(fold_rows: int) -> Rule:
    return halving if fold_rows >= HALVING_FOLD_ROWS else median


def ended_by(trial: Trial, folds: int, rule: Rule) -> bool:
    """Whether a trial is whole with all its folds, or was given up where its rule looks."""
    if trial.outcome == "given up":
        return trial.folds in RUNGS if rule is halving else MEDIAN_AFTER_FOLDS < trial.folds < folds
    return trial.outcome == "whole" and trial.folds == folds


@dataclass
class Search:
    """What a search has tried and found so far. ``params`` and ``score`` are the best ones."""
    folds: int
    params: dict[str, object]
    score: float
    least_gain: float = 0.0
    trials: list[Trial] = field(default_factory=list)
    start: float = 0.0

    def __post_init__(self) -> None:
        self.start = self.score

    @property
    def spent(self) -> int:
        return sum(t.folds for t in self.trials)

    @property
    def promised(self) -> int:
        """Folds that are fitted or that an open trial may still ask for, so that trials side by side keep to the budget too."""
        return sum(self.folds if t.outcome == "open" else t.folds for t in self.trials)

    @property
    def idle(self) -> int:
        """Folds fitted since the last gain; those of listed settings never count."""
        best, folds = self.start, 0
        for t in self.trials:
            gain = (t.score if t.score is not None else -math.inf) - best
            best = max(best, best + gain)
            folds = 0 if gain > self.least_gain else folds + t.folds * (t.origin != "listed")
        return folds

    def run(self, trial: Trial, fold_score: Callable[[dict[str, object], int], float], rule: Rule, lock: threading.Lock) -> None:
        """Fit the folds of a trial of this search until it is whole, given up or broken; one bad setting does not end the search."""
        scores: list[float] = []
        try:
            while trial.outcome == "open":
                trial.folds += 1
                scores.append(fold_score(trial.settings, len(scores)))
                with lock:
                    trial.means.append(statistics.fmean(scores))
                    if rule([t for t in self.trials if t is not trial], trial, self.folds):
                        trial.outcome = "given up"
                    elif len(scores) == self.folds:
                        trial.outcome = "whole"
        except Exception as error:
            trial.outcome, trial.error = "failed", str(error)[:200]
        with lock:
            if trial.score is not None and trial.score > self.score:
                self.params, self.score = trial.settings, trial.score

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per trial; trial 0 is the setting the search began with."""
        rows = [(0, "default", "", self.folds, round(self.start, 4), "whole", None)]
        rows += [(n, t.origin, json.dumps(t.settings), t.folds, None if t.score is None else round(t.score, 4), t.outcome, t.error)
                 for n, t in enumerate(self.trials, 1)]
        return spark.createDataFrame(rows, LOG)


def search(
    name: str, fold_score: Callable[[dict[str, object], int], float], folds: int, fold_rows: int,
    defaults: Mapping[str, object], start_score: float, budget: float = 20, seconds: float = 300.0,
    min_gain: float = 0.0, seed: int = 42, parallelism: int = 1, guided_after: int | None = None,
) -> Search:
    """Try settings until the budget (in whole cross-validations), the time or the patience is used up.

    ``fold_score(settings, fold)`` fits on Spark and scores one fold, higher being better. Up to ``parallelism`` trials run at a
    time. The stop rule goes by the rows of a fold, as the halving of few rows would be by chance. Once ``guided_after`` trials
    (ten, if not given) have told a score, settings are guided.
    """
    state = Search(folds, dict(defaults), start_score, min_gain)
    rule = rule_of(fold_rows)
    until = time.monotonic() + seconds
    source, lock = proposals(name, seed, state.trials, guided_after), threading.Lock()

    def work() -> None:
        while True:
            with lock:
                if state.promised >= budget * folds or state.idle >= PATIENCE * folds or time.monotonic() >= until:
                    return
                trial = Trial(*next(source))
                state.trials.append(trial)
            state.run(trial, fold_score, rule, lock)

    helpers = [threading.Thread(target=work) for _ in range(parallelism - 1)]
    for h in helpers:
        h.start()
    work()
    for h in helpers:
        h.join()
    return state
