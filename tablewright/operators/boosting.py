"""Boosted trees over histograms of gradients, grown level by level or best leaf first.

Rows are held in blocks: one row of the table is some ten thousand cells of one model, as arrays of bin numbers, sums of weights
and targets, and score. A cell is all rows of equal bins: they go the same way in every tree, so their sums stand for them
exactly, and a table of few different bins is as small as these. Where trees sample rows, the rows of a cell are dealt
over 16 by their ids, and each of these is drawn as one. The score is that of all trees up to the last one written into the blocks; boosting goes on from there and never starts again.

A pass over the blocks sends every leaf in question as sums of gradients, second derivatives and rows per
(feature, bin), added up by Spark. Of two siblings only the one of fewer rows is counted, the other is what is left of
their parent. The sums are as large as the model, whatever the number of rows, and the driver picks the splits from them.
Best-first growth asks in one pass for the children of every leaf that may still be split, so that a tree takes about as many
passes as it is deep. Several models (folds, or classes against the rest) grow side by side in the same passes.

A model of few enough cells for one task grows there from its first tree to its last, by the same steps: a pass is then some
sums over arrays and no Spark job. Cells of equal bins differ in their rows alone, so score and leaf are held once for them.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.session import dropped, written

BINS = 64
BLOCK_ROWS = 16_384
TREES_PER_WRITE = 12  # trees that a pass may have to add to the written scores
CELLS_PER_PASS = 4_000_000
FEW_TASKS = 16
DRAWN_PARTS = 16  # that the rows of equal bins are drawn in
LOOKED_UP = 1 << 20  # kinds of bins whose scores a worker holds
CELLS_PER_TASK = 2_000_000  # of a model that grows in one task
PATIENCE = 50
SEED = 17
_U = np.uint64
_STATE = "model int, ids binary, bins binary, n binary, w binary, wy binary, wyy binary, held binary, score binary"
# Per cell: rows, weights, and weights times the target and its square.
_KINDS = {"ids": "<i8", "bins": "u1", "n": "<f8", "w": "<f8", "wy": "<f8", "wyy": "<f8", "held": "u1", "score": "<f8"}


@dataclass(frozen=True)
class Settings:
    """How trees are grown. ``leaves`` limits best-first growth; without it a tree grows level by level to ``depth``."""

    logistic: bool = False
    learning_rate: float = 0.05
    depth: int = 6
    leaves: int | None = None
    subsample: float = 1.0
    column_share: float = 1.0
    penalty: float = 1.0  # added to a leaf's second derivatives
    least_rows: int = 1  # of a leaf
    least_curvature: float = 0.0  # second derivatives of a leaf
    seed: int = SEED


@dataclass
class Tree:
    """Nodes in lists; a leaf has feature -1. Rows whose bin is at most ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = first, first + 1
        for name, value in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("gain", 0.0), ("value", 0.0), ("rows", 0)):
            getattr(self, name).extend([value, value])
        return first, first + 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(v) for k, v in vars(self).items()}

    @property
    def leaf_count(self) -> int:
        return sum(f < 0 for f in self.feature)

    def pruned(self, kept: set[int]) -> Tree:
        """The tree in which only the nodes of ``kept`` are split."""
        out, todo = Tree(), [(0, 0)]
        out.value[0], out.rows[0] = self.value[0], self.rows[0]
        while todo:
            old, new = todo.pop()
            if old in kept:
                pair = out.split(new, self.feature[old], self.cut[old], self.gain[old])
                for o, n in zip((self.left[old], self.right[old]), pair):
                    out.value[n], out.rows[n] = self.value[o], self.rows[o]
                    todo.append((o, n))
        return out


def _route(tree: Mapping[str, np.ndarray], bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The leaf of every row, from the root on or from the node where it is."""
    node = np.zeros(len(bins), np.int64) if start is None else start.copy()
    flat, width, children = bins.reshape(-1), bins.shape[1], np.stack([tree["right"], tree["left"]], 1).reshape(-1)
    rows = np.flatnonzero(tree["feature"].take(node) >= 0)
    at = node.take(rows)
    while len(rows):
        left = flat.take(rows * width + tree["feature"].take(at)) <= tree["cut"].take(at)
        at = children.take(2 * at + left)
        node[rows] = at
        inner = tree["feature"].take(at) >= 0
        rows, at = rows[inner], at[inner]
    return node


@dataclass
class Ensemble:
    """One fitted model: where its score starts, the borders of its bins, and its trees."""

    base: float
    edges: list[list[float]]
    trees: list[Tree]
    logistic: bool
    losses: list[float] = field(default_factory=list)  # on the rows held back, before each tree and after the last

    def binned(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges)

    def raw(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        return _sums_of(self.base, [tree.arrays() for tree in self.trees[:trees]], self.binned(x))

    def importance(self) -> np.ndarray:
        """The gain of each feature's splits."""
        out = np.zeros(len(self.edges))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out

    def threshold(self, feature: int, cut: int) -> float:
        return self.edges[feature][cut]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        raw = json.loads(text)
        return Ensemble(**{**raw, "trees": [Tree(**t) for t in raw["trees"]]})


def _sums_of(base: float, trees: Sequence[Mapping[str, np.ndarray]], bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), base)
    for tree in trees:
        out += tree["value"][_route(tree, bins)]
    return out


def _binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """The number of borders below each value."""
    out = np.zeros(x.shape, np.uint8)
    for f, border in zip(range(x.shape[1]), edges):  # features beyond a row's are constant and never split
        out[:, f] = np.searchsorted(np.asarray(border), x[:, f], side="left")
    return out


# -- bins and blocks -----------------------------------------------------------------------


def bin_edges(rows: DataFrame, width: int, bins: int = BINS) -> dict[int, list[list[float]]]:
    """Per model and feature the borders between bins: all values but the largest while they fit, else quantiles.

    ``rows`` has ``model`` and ``x``, an array of ``width`` numbers.
    """
    each = [F.col("x")[f] for f in range(width)]
    found = {r["model"]: r["distinct"] for r in rows.groupBy("model").agg(
        F.array(*[F.approx_count_distinct(c, 0.02) for c in each]).alias("distinct")).collect()}
    few = {(m, f) for m, distinct in found.items() for f in range(width) if distinct[f] <= 2 * bins}
    values: dict[tuple[int, int], list[float]] = defaultdict(list)
    if few:
        # At most some 2 * bins values per model and feature.
        wanted = sorted({f for _, f in few})
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col("x")[f].alias("v")) for f in wanted])
        for r in rows.select("model", F.inline(pairs)).distinct().where(_among(few)).collect():
            values[(r["model"], r["f"])].append(r["v"])
    out = {m: [sorted(values[(m, f)])[:-1] for f in range(width)] for m in found}
    many = [f for f in range(width) if any(not 0 < len(values[(m, f)]) <= bins for m in found)]
    if many:  # quantiles cost most, so that features of few values are spared them
        marks = [(i + 1) / bins for i in range(bins - 1)]
        for r in rows.groupBy("model").agg(F.array(*[F.percentile_approx(each[f], marks, 10_000) for f in many]).alias("marks")).collect():
            for f, ends in zip(many, r["marks"]):
                if not 0 < len(values[(r["model"], f)]) <= bins:
                    out[r["model"]][f] = sorted(set(ends))[:bins - 1]
    return out


def _among(pairs: set[tuple[int, int]]) -> Column:
    by_feature = defaultdict(list)
    for model, f in pairs:
        by_feature[f].append(model)
    out = F.lit(False)
    for f, models in by_feature.items():
        out = out | ((F.col("f") == f) & F.col("model").isin(models))
    return out


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of bytes, the first of each kind, and every row's kind."""
    if keys.shape[1] <= 8:  # numbers are sorted faster than bytes
        wide = np.zeros((len(keys), 8), np.uint8)
        wide[:, :keys.shape[1]] = keys
        flat = wide.view(np.uint64).reshape(-1)
    else:
        flat = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").reshape(-1)
    _, first, kind = np.unique(flat, return_index=True, return_inverse=True)
    return first, kind


def _block(model: int, columns: Mapping[str, np.ndarray]) -> tuple:
    return (model, *[np.ascontiguousarray(columns[c], _KINDS[c]).tobytes() for c in _KINDS])


def _batch(blocks: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks)) or [()] * (len(_KINDS) + 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["model", *_KINDS])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = {c: np.frombuffer(r[c], kind) for c, kind in _KINDS.items()}
            columns["bins"] = columns["bins"].reshape(-1, width)
            yield r["model"], columns


def to_cells(rows: DataFrame, edges: Mapping[int, list[list[float]]], width: int, sampled: bool,
             centres: Mapping[int, float] | None = None) -> DataFrame:
    """``rows`` (model, id, x, y, w, held) as cells: rows of equal bins are added up, those that trees sample by 16 parts of their ids.

    Targets are taken from their model's centre on, so that squares of a distant mean do not hide the differences.
    """
    schema = "model int, id long, bins binary, n double, w double, wy double, wyy double, held boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column("model").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            y, w = (np.array(batch.column(c).to_numpy(zero_copy_only=False), float) for c in ("y", "w"))
            y -= np.array([(centres or {}).get(m, 0.0) for m in model.tolist()])
            ids, sums = batch.column("id").to_numpy(), [np.ones(len(y)), w, w * y, w * y * y]
            for m in np.unique(model).tolist():
                mine = np.flatnonzero(model == m)
                bins = _binned(x[mine], edges[m])
                part = (_mixed(ids[mine], 0) & _U(DRAWN_PARTS - 1)).astype(np.uint8) if sampled else np.zeros(len(mine), np.uint8)
                keys = np.concatenate([bins, held[mine, None].astype(np.uint8), part[:, None]], 1)
                first, group = _kinds(keys)
                bins, own, kept, part = bins[first], [np.bincount(group, v[mine]) for v in sums], mine[first], part[first]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), m), pa.int32()), pa.array(part.astype(np.int64)),
                     packed.cast(pa.binary()), *[pa.array(v) for v in own], pa.array(held[kept])],
                    ["model", "id", "bins", "n", "w", "wy", "wyy", "held"])
    cells = rows.select("model", "id", "x", "y", "w", "held").mapInArrow(run, schema)
    cells = cells.groupBy("model", "held", "bins", "id").agg(*[F.sum(c).alias(c) for c in ("n", "w", "wy", "wyy")])
    return cells.select("model", F.xxhash64("bins", "id").alias("id"), "bins", "n", "w", "wy", "wyy", "held")


def to_blocks(cells: DataFrame, bases: Mapping[int, float], width: int) -> DataFrame:
    """Cells as blocks, with each model's base (from its centre on) as the score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[dict]] = defaultdict(list)

        def packed(model: int) -> tuple:
            parts = waiting.pop(model)
            return _block(model, {c: np.concatenate([p[c] for p in parts]) for c in _KINDS})

        for batch in batches:
            model = batch.column("model").to_numpy()
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            for m in np.unique(model).tolist():
                mine = np.flatnonzero(model == m)
                part = {c: batch.column(c).to_numpy(zero_copy_only=False)[mine] for c in ("n", "w", "wy", "wyy", "held")}
                waiting[m].append({**part, "ids": batch.column("id").to_numpy()[mine], "bins": bins[mine],
                                   "score": np.full(len(mine), bases[m])})
                if sum(len(p["n"]) for p in waiting[m]) >= BLOCK_ROWS:
                    yield _batch([packed(m)])
        for m in list(waiting):
            yield _batch([packed(m)])
    return cells.select("model", "id", "bins", "n", "w", "wy", "wyy", "held").mapInArrow(run, _STATE)


# -- passes --------------------------------------------------------------------------------


def _drawn(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each row takes part, as its key and the tree's number decide."""
    if share >= 1:
        return np.ones(len(ids), bool)
    return (_mixed(ids, seed) >> _U(11)).astype(np.float64) < share * 2 ** 53


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    h = ids.view(np.uint64) ^ _U((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _with_trees(columns: Mapping[str, np.ndarray], trees: Sequence[Mapping[str, np.ndarray]]) -> np.ndarray:
    score = columns["score"].copy()
    for tree in trees:
        score += tree["value"][_route(tree, columns["bins"])]
    return score


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def _losses(w: np.ndarray, wy: np.ndarray, wyy: np.ndarray, score: np.ndarray, logistic: bool) -> float:
    if logistic:
        return float((w * np.logaddexp(0, score) - wy * score).sum())
    return float((score * (w * score - 2 * wy) + wyy).sum())


@dataclass
class _Question:
    """What a pass asks of one model: the trees not yet written, the tree that grows, and the nodes to count."""

    trees: list[Mapping[str, np.ndarray]]
    tree: Mapping[str, np.ndarray]
    nodes: list[int]
    draw: int


def _ask(blocks: DataFrame, questions: Mapping[int, _Question], settings: Settings, width: int, tasks: int) -> tuple[dict, dict]:
    """The sums of every asked node, as an array (feature, bin, sum), and the loss on the rows held back, by model."""
    shared = blocks.sparkSession.sparkContext.broadcast(dict(questions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        sums: dict[int, np.ndarray] = {}
        held_back: dict[int, np.ndarray] = {}
        for model, c in _blocks(batches, width):
            if model not in asked:
                continue
            question = asked[model]
            score = _with_trees(c, question.trees)
            w, wy, held = c["w"], c["wy"], c["held"] > 0
            total = held_back.setdefault(model, np.zeros(2))
            total += [_losses(w[held], wy[held], c["wyy"][held], score[held], settings.logistic), w[held].sum()]
            used = ~held & _drawn(c["ids"], question.draw, settings.subsample)
            slot_of = np.full(len(question.tree["feature"]), -1)
            slot_of[question.nodes] = np.arange(len(question.nodes))
            slot = slot_of[_ancestor(question, c["bins"])]
            used &= slot >= 0
            slot, bins, n, w, wy, score = slot[used], c["bins"][used], c["n"][used], w[used], wy[used], score[used]
            p = _probability(score) if settings.logistic else score
            g, h = w * p - wy, w * (p * (1 - p) if settings.logistic else 1.0)
            cells = sums.setdefault(model, np.zeros((3, len(question.nodes), width, BINS)))
            _add_up(cells, slot, bins, (g, h, n))
        out = []
        for model, cells in sums.items():
            node, f, b = np.nonzero(cells[2])
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), model), pa.int32()), pa.array(node, pa.int32()), pa.array(f, pa.int32()), pa.array(b, pa.int32()),
                 *[pa.array(cells[i, node, f, b], pa.float64()) for i in range(3)]], ["model", "slot", "feature", "bin", "g", "h", "n"]))
        for model, (loss, weight) in held_back.items():
            out.append(pa.RecordBatch.from_arrays(
                [pa.array([model], pa.int32()), *[pa.array([-1], pa.int32())] * 3, pa.array([loss]), pa.array([weight]), pa.array([0.0])],
                ["model", "slot", "feature", "bin", "g", "h", "n"]))
        yield from out

    found = blocks.mapInArrow(run, "model int, slot int, feature int, bin int, g double, h double, n double")
    if tasks > FEW_TASKS:  # of fewer, the driver adds up the parts itself: each is as large as the model
        found = found.groupBy("model", "slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    table = found.toArrow()  # as many rows as the nodes asked for have cells: nodes x features x bins
    column = {c: table.column(c).to_numpy() for c in table.column_names}
    sums = {m: np.zeros((len(question.nodes), width, BINS, 3)) for m, question in questions.items()}
    losses = {}
    for m in questions:
        mine = column["model"] == m
        last = mine & (column["slot"] < 0)
        weight = float(column["h"][last].sum())
        losses[m] = float(column["g"][last].sum()) / weight if weight else 0.0
        mine &= ~last
        at = tuple(column[c][mine] for c in ("slot", "feature", "bin"))
        np.add.at(sums[m], at, np.stack([column[c][mine] for c in ("g", "h", "n")], 1))
    return sums, losses


def _add_up(into: np.ndarray, slot: np.ndarray, bins: np.ndarray, values: Sequence[np.ndarray]) -> None:
    """Sums of each of the values by (slot, feature, bin)."""
    slots, width = into.shape[1:3]
    for f in range(width):
        at = slot * BINS + bins[:, f]
        for i, v in enumerate(values):
            into[i, :, f] += np.bincount(at, v, slots * BINS).reshape(-1, BINS)


def _ancestor(question: _Question, bins: np.ndarray) -> np.ndarray:
    """The asked node that each row is under, or the leaf it comes to."""
    tree = dict(question.tree)
    tree["feature"] = tree["feature"].copy()
    tree["feature"][question.nodes] = -1  # rows stop at an asked node
    return _route(tree, bins)


# -- growth --------------------------------------------------------------------------------


@dataclass
class Split:
    feature: int
    cut: int
    gain: float
    left: np.ndarray  # sums of the rows that go left: gradients, second derivatives, rows
    right: np.ndarray


def best_split(sums: np.ndarray, settings: Settings, features: Sequence[int]) -> Split | None:
    """The split of greatest gain; of equals (to nine digits) the first feature, then the lowest cut. None without any gain."""
    total = sums[features[0]].sum(0)
    left = np.cumsum(sums[list(features)], axis=1)[:, :-1]
    right = total - left

    def worth(part: np.ndarray) -> np.ndarray:
        return part[..., 0] ** 2 / np.maximum(part[..., 1] + settings.penalty, 1e-300)
    gain = worth(left) + worth(right) - worth(total)
    fits = (left[..., 2] >= max(settings.least_rows, 0.5)) & (right[..., 2] >= max(settings.least_rows, 0.5))
    fits &= (left[..., 1] >= settings.least_curvature) & (right[..., 1] >= settings.least_curvature)
    gain = np.where(fits, gain, -np.inf)
    best = gain.max(initial=-np.inf)
    if not best > 1e-9 * max(1.0, float(worth(total))):
        return None
    f, b = np.argwhere(gain >= best - 1e-9 * abs(best))[0]
    return Split(int(features[f]), int(b), float(gain[f, b]), left[f, b], right[f, b])


class _Growth:
    """One tree of one model as it grows. ``tree`` holds splits that are only tried; ``kept`` those that are taken."""

    def __init__(self, settings: Settings, width: int, draw: int):
        self.settings, self.draw, self.tree = settings, draw, Tree()
        share = max(1, round(settings.column_share * width))
        order = np.random.default_rng(draw).permutation(width)[:share]
        self.features = sorted(order.tolist())
        self.sums: dict[int, np.ndarray] = {}
        self.splits: dict[int, Split | None] = {}
        self.depth, self.parent = {0: 0}, {0: -1}
        self.kept: set[int] = set()
        self.heap: list[tuple[float, int]] = []
        self.waiting = [0]  # nodes without sums; siblings stand together
        self.done = False

    def asked(self) -> list[int]:
        """The nodes to count: of siblings the one of fewer rows."""
        out = []
        for node in self.waiting:
            parent = self.parent[node]
            if parent < 0:
                out.append(node)
                continue
            split = self.splits[parent]
            if (node == self.tree.left[parent]) == (split.left[2] <= split.right[2]):
                out.append(node)
        return out

    def _weigh(self, node: int, sums: np.ndarray) -> None:
        g, h, n = sums.tolist()
        self.tree.value[node] = -self.settings.learning_rate * g / max(h + self.settings.penalty, 1e-300)
        self.tree.rows[node] = round(n)

    def take(self, nodes: Sequence[int], sums: np.ndarray) -> None:
        self.sums.update(zip(nodes, sums))
        for node in nodes:
            parent = self.parent[node]
            if parent >= 0:
                other = self.tree.left[parent] + self.tree.right[parent] - node
                self.sums[other] = self.sums[parent] - self.sums[node]
                self.sums[other][self.sums[other][..., 2] < 0.5] = 0.0
        for node in self.waiting:
            if self.parent[node] < 0:
                self._weigh(node, self.sums[node][self.features[0]].sum(0))
            self.splits[node] = best_split(self.sums[node], self.settings, self.features)
        ready, self.waiting = self.waiting, []
        if self.settings.leaves is None:
            self._next_level(ready)
        else:
            self._best_first(ready)

    def _open(self, node: int) -> None:
        split = self.splits[node]
        for child, sums in zip(self.tree.split(node, split.feature, split.cut, split.gain), (split.left, split.right)):
            self.depth[child], self.parent[child] = self.depth[node] + 1, node
            self._weigh(child, sums)
            # Leaves of the last depth are never split, and their sums are known from the split above them.
            if self.depth[child] < self.settings.depth:
                self.waiting.append(child)
            else:
                self.splits[child] = None

    def _next_level(self, ready: Sequence[int]) -> None:
        for node in ready:
            if self.splits[node] is not None:
                self.kept.add(node)
                self._open(node)
        self.done = not self.waiting

    def _best_first(self, ready: Sequence[int]) -> None:
        for node in ready:
            if self.splits[node] is not None and (self.parent[node] < 0 or self.parent[node] in self.kept):
                heapq.heappush(self.heap, (-self.splits[node].gain, node))
        while self.heap and len(self.kept) + 1 < self.settings.leaves:
            node = self.heap[0][1]
            if not self.tree.left[node]:
                if len(self.kept) + 2 < self.settings.leaves:
                    break  # its children may be split, and are asked for below
                self._open(node)  # the last split: its children stay leaves
                self.waiting = []
                self.splits.update({self.tree.left[node]: None, self.tree.right[node]: None})
            heapq.heappop(self.heap)
            self.kept.add(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.splits[child] is not None:
                    heapq.heappush(self.heap, (-self.splits[child].gain, child))
        left = self.settings.leaves - 1 - len(self.kept)
        if not self.heap or left <= 0:
            self.done = True
            return
        # Any of the best leaves may be split next, so the children of them all are counted at once.
        for _, node in heapq.nsmallest(left, self.heap):
            if not self.tree.left[node]:
                self._open(node)

    def finished(self) -> Tree:
        return self.tree.pruned(self.kept)

    def leaves(self) -> np.ndarray:
        """Per node of ``tree`` the leaf of the finished tree that it is, or is under."""
        out = np.arange(len(self.tree.feature))
        for node, parent in self.parent.items():  # parents come first
            if parent >= 0 and (parent not in self.kept or out[parent] != parent):
                out[node] = out[parent]
        return out


def _grow(blocks: DataFrame, settings: Settings, width: int, pending: Mapping[int, list], draws: Mapping[int, int], tasks: int) -> tuple[dict[int, Tree], dict[int, float]]:
    """One more tree for each model in ``draws``, and the held-back loss before it."""
    growing = {m: _Growth(settings, width, draw) for m, draw in draws.items()}
    losses: dict[int, float] = {}
    while any(not g.done for g in growing.values()):
        room, questions = max(1, CELLS_PER_PASS // (width * BINS)), {}
        for m, g in growing.items():
            nodes = [] if g.done else g.asked()
            if nodes and (room >= len(nodes) or not questions):
                questions[m] = _Question(pending[m], g.tree.arrays(), nodes, g.draw)
                room -= len(nodes)
        sums, loss = _ask(blocks, questions, settings, width, tasks)
        for m, question in questions.items():
            losses.setdefault(m, loss[m])
            growing[m].take(question.nodes, sums[m])
    return {m: g.finished() for m, g in growing.items()}, losses


def _written_scores(blocks: DataFrame, pending: Mapping[int, list], width: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast({m: list(t) for m, t in pending.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, c in _blocks(batches, width):
            yield _batch([_block(model, {**c, "score": _with_trees(c, shared.value.get(model, []))})])
    return blocks.mapInArrow(run, _STATE)


def boost(rows: DataFrame, width: int, settings: Settings, trees: int | Mapping[int, int], patience: int | None = PATIENCE,
          trees_per_write: int = TREES_PER_WRITE, cells_per_task: int = CELLS_PER_TASK) -> dict[int, Ensemble]:
    """Fit every model of ``rows``: ``(model, id, x, y, w, held)``, where ``x`` is an array of ``width`` numbers without gaps.

    With rows held back, a model stops once no tree of the last ``patience`` lowered their loss, and keeps the trees up to
    the lowest; without, it grows to ``trees``. ``id`` decides which rows a tree samples. The target of a logistic
    model is 0 or 1. An empty table gives no models. Models of more than ``cells_per_task`` cells grow by passes over all blocks.
    """
    used = rows.where(~F.col("held"))
    starts = used.groupBy("model").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")).collect()
    bases = {}
    for r in starts:
        mean = min(max(r["mean"], 1e-6), 1 - 1e-6) if settings.logistic else r["mean"]
        bases[r["model"]] = math.log(mean / (1 - mean)) if settings.logistic else mean
    if not bases:
        return {}
    edges = bin_edges(used, width)
    centres = {m: 0.0 if settings.logistic else base for m, base in bases.items()}
    cells = to_cells(rows.where(F.col("model").isin(list(bases))), edges, width, settings.subsample < 1, centres)
    blocks = written(to_blocks(cells, {m: base - centres[m] for m, base in bases.items()}, width), "boosting")
    out = {m: Ensemble(bases[m], edges[m], [], settings.logistic) for m in bases}
    most = {m: trees if isinstance(trees, int) else trees[m] for m in bases}
    sizes = {r["model"]: r["cells"] for r in blocks.groupBy("model").agg(F.sum(F.length("held")).alias("cells")).collect()}
    few = [m for m, n in sizes.items() if n <= cells_per_task and most[m] > 0]
    if few:
        _boost_in_tasks(blocks.where(F.col("model").isin(few)), {m: out[m] for m in few}, width, settings, most, patience)
    many = {m: model for m, model in out.items() if m not in few and most[m] > 0}
    if many:
        _boost_in_passes(blocks.where(F.col("model").isin(list(many))) if few else blocks, many, width, settings, most, patience, trees_per_write)
    dropped(blocks)
    return out


def _taken(model: Ensemble, tree: Tree, loss: float, most: int, patience: int | None) -> bool:
    """Whether a model goes on after one more tree; one without a split is not taken, as nothing is left to gain."""
    model.losses.append(loss)
    if tree.leaf_count == 1:
        return False
    model.trees.append(tree)
    waited = len(model.losses) - 1 - int(np.argmin(model.losses))
    return len(model.trees) < most and (patience is None or waited < patience)


def _cut(model: Ensemble, last: float) -> None:
    """Keep the trees up to the lowest loss; ``last`` is the one after the last tree."""
    model.losses = [*model.losses[:len(model.trees)], last]
    model.trees = model.trees[:int(np.argmin(model.losses))]


def _boost_in_passes(blocks: DataFrame, out: Mapping[int, Ensemble], width: int, settings: Settings, most: Mapping[int, int], patience: int | None,
                     trees_per_write: int) -> None:
    """Grow models side by side, each tree by passes over all blocks."""
    first, tasks = blocks, blocks.rdd.getNumPartitions()
    pending: dict[int, list] = {m: [] for m in out}
    has_held = {r["model"] for r in blocks.where(F.expr("contains(held, X'01')")).select("model").distinct().collect()}
    active = set(out)
    while active:
        grown, losses = _grow(blocks, settings, width, pending, {m: _draw(settings, out[m]) for m in active}, tasks)
        for m, tree in grown.items():
            if not _taken(out[m], tree, losses[m], most[m], patience if m in has_held else None):
                active.discard(m)
            if tree.leaf_count > 1:
                pending[m].append(tree.arrays())
        if active and max(len(pending[m]) for m in active) >= trees_per_write:
            before, blocks = blocks, written(_written_scores(blocks, pending, width), "boosting")
            if before is not first:
                dropped(before)
            pending = {m: [] for m in out}
    if has_held and patience is not None:
        _, last = _ask(blocks, {m: _Question(pending[m], Tree().arrays(), [0], 0) for m in has_held}, settings, width, tasks)
        for m, loss in last.items():
            _cut(out[m], loss)
    if blocks is not first:
        dropped(blocks)


def _draw(settings: Settings, model: Ensemble) -> int:
    """What decides the rows and features of a model's next tree."""
    return settings.seed * 1_000_003 + len(model.trees)


class _Held:
    """One model's cells in one task: sums per kind of bins, and the score and leaf of each kind."""

    def __init__(self, blocks: Sequence[Mapping[str, np.ndarray]], settings: Settings):
        self.settings = settings
        c = {name: np.concatenate([b[name] for b in blocks]) for name in blocks[0]}
        first, kind = _kinds(c["bins"])
        self.bins, self.score, held = c["bins"][first], c["score"][first].copy(), c["held"] > 0
        self.any_held, self.held = bool(held.any()), [np.bincount(kind[held], c[v][held], len(first)) for v in ("w", "wy", "wyy")]
        self.ids, self.kind, self.sums = c["ids"][~held], kind[~held], [c[v][~held] for v in ("n", "w", "wy")]
        self.whole = [np.bincount(self.kind, v, len(first)) for v in self.sums]

    def loss(self) -> float:
        weight = float(self.held[0].sum())
        return _losses(*self.held, self.score, self.settings.logistic) / weight if weight else 0.0

    def tree(self, draw: int) -> Tree:
        """One more tree over the rows that it draws, added to the scores."""
        settings, width = self.settings, self.bins.shape[1]
        n, w, wy = self.whole
        if settings.subsample < 1:
            drawn = _drawn(self.ids, draw, settings.subsample)
            n, w, wy = (np.bincount(self.kind[drawn], v[drawn], len(self.bins)) for v in self.sums)
        p = _probability(self.score) if settings.logistic else self.score
        g, h = w * p - wy, w * (p * (1 - p) if settings.logistic else 1.0)
        growth, leaf = _Growth(settings, width, draw), np.zeros(len(self.bins), np.int64)
        while not growth.done:
            nodes, tree = growth.asked(), growth.tree.arrays()
            leaf = _route(tree, self.bins, leaf)
            slot_of = np.full(len(tree["feature"]), -1)
            slot_of[nodes] = np.arange(len(nodes))
            slot = slot_of[leaf]
            used = np.flatnonzero(slot >= 0)
            sums = np.zeros((3, len(nodes), width, BINS))
            _add_up(sums, slot[used], self.bins[used], (g[used], h[used], n[used]))
            growth.take(nodes, np.moveaxis(sums, 0, -1))
        if growth.kept:
            tree = growth.tree.arrays()
            self.score += tree["value"][growth.leaves()].take(_route(tree, self.bins, leaf))
        return growth.finished()


def _boost_in_tasks(blocks: DataFrame, out: Mapping[int, Ensemble], width: int, settings: Settings, most: Mapping[int, int], patience: int | None) -> None:
    """Grow each model in a task of its own, that holds all its cells."""
    starts = {m: (model.base, model.edges) for m, model in out.items()}

    def run(table: pa.Table) -> pa.Table:
        found = list(_blocks(table.to_batches(), width))
        m, cells = found[0][0], _Held([c for _, c in found], settings)
        model = Ensemble(*starts[m], [], settings.logistic)
        stop, going = patience if cells.any_held else None, True
        while going:
            loss = cells.loss()
            going = _taken(model, cells.tree(_draw(settings, model)), loss, most[m], stop)
        if cells.any_held and patience is not None:
            _cut(model, cells.loss())
        return pa.table({"model": pa.array([m], pa.int32()), "found": [model.to_json()]})

    # Ranges put every model in a task of its own, where hashes would bring some together.
    alone = blocks.repartitionByRange(len(out), "model") if len(out) > 1 else blocks
    for r in alone.groupBy("model").applyInArrow(run, "model int, found string").collect():  # as large as the models
        grown = Ensemble.from_json(r["found"])
        out[r["model"]].trees, out[r["model"]].losses = grown.trees, grown.losses


class _Scorer:
    """Raw scores of one model. Rows are looked up by their bins once more of them came than there are kinds of bins."""

    def __init__(self, model: Ensemble):
        self.model, self.trees, self.sizes = model, [t.arrays() for t in model.trees], [len(e) + 1 for e in model.edges]
        self.kinds, self.seen, self.known = math.prod(self.sizes), 0, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bins = self.model.binned(x)
        if self.kinds <= LOOKED_UP and x.shape[1] == len(self.sizes):
            self.seen += len(x)
            if self.known is None and self.seen > self.kinds:
                self.known = _sums_of(self.model.base, self.trees, np.ascontiguousarray(np.indices(self.sizes, np.uint8).reshape(len(self.sizes), -1).T))
            if self.known is not None:
                return self.known[np.ravel_multi_index(tuple(bins.T.astype(np.int64)), self.sizes)]
        return _sums_of(self.model.base, self.trees, bins)


def raw_scores(features: Column, models: Sequence[Ensemble], spark: SparkSession) -> Column:
    """The raw score of every model, as an array; ``features`` is an array of numbers."""
    shared = spark.sparkContext.broadcast([_Scorer(m) for m in models])

    @F.arrow_udf("array<double>")
    def scored(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        found = np.stack([score(rows) for score in shared.value], 1)
        ends = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))
    return scored(features)


def features_array(columns: Sequence[str]) -> Column:
    """Numeric columns as the array that trees read."""
    return F.array(*[q(c).cast("double") for c in columns])
