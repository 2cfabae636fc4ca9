"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens that adds spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.flat import LOWER, chunks, range_hash, rolling, words

# Fixed patterns of the contract, and how long a match (for the first, its value) must be.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
# Texts stand side by side in one buffer: the last letter of a word that ends in the next text stays free for a word there.
_KEYWORDS = re.compile(rb"password|passwd|secre(?=t)|token|api_?key")

OUTSIDE, BEGIN, INSIDE = range(3)
SEGMENT = 64  # tokens of a training sequence
SAMPLE_ROWS = 20_000  # documents looked at for training sequences without a secret
SEGMENTS = 1_000  # training sequences with a secret; three times as many without
EPOCHS, RATE, DROPOUT = 40, 0.08, 0.25
_NEVER = -1e4

_TOKEN_BREAK = np.ones(256, bool)  # bytes that no token holds
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256), map(ord, "_+/-.")):
    _TOKEN_BREAK[list(_r)] = False
_DIGIT, _UPPER, _SMALL, _HEXDIGIT, _SYMBOL = (np.zeros(256, np.int32) for _ in range(5))
_DIGIT[48:58] = _UPPER[65:91] = _SMALL[97:123] = _HEXDIGIT[48:58] = _HEXDIGIT[97:103] = 1
for _r in (range(33, 48), range(58, 65), range(91, 97), range(123, 127)):
    _SYMBOL[_r] = 1
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 64])
_SHAPES, _WORDS, _GAPS, _FILES = 256, 4096, 64, 16
# Where each kind of feature begins: own shape, shape before, word, word before, word after, what stands between, that with the word before, file.
_BASES = np.cumsum([0, _SHAPES, _SHAPES, _WORDS, _WORDS, _WORDS, _GAPS, _WORDS, _FILES])
_GAP = np.full(256, 7)
_GAP[[ord(c) for c in " \n:=\"'"]] = range(6)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and stop of every match that is long enough; a failing match takes its place too."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(2, m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def _value_spans(text: str) -> list[tuple[int, int]]:
    """The secret part of each match: the value of an assignment, else the whole."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    return found + [(a, b) for kind, a, b in base_spans(text) if kind]


def suspects(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts may have a match, by bytes that every match has."""
    spots = [m.start() for m in _KEYWORDS.finditer(LOWER[data].tobytes())]
    raw, at = data.tobytes(), -1
    while (at := raw.find(b"AKIA", at + 1)) >= 0:
        spots.append(at)
    start, stop = words(data, edges, _HEXDIGIT == 0)
    spots = np.concatenate([np.array(spots, np.int64), start[stop - start >= LEAST_HEX]])
    return np.unique(np.searchsorted(edges, spots, side="right") - 1)


@dataclass
class Tokens:
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    line: np.ndarray
    features: np.ndarray  # tokens x kinds of features


def tokenize(data: np.ndarray, edges: np.ndarray) -> Tokens:
    """The tokens of some texts, each with its line and its features as row numbers of the weights."""
    start, stop = words(data, edges, _TOKEN_BREAK)
    text = np.searchsorted(edges, start, side="right") - 1
    breaks = np.zeros(len(data) + 1, np.int64)
    breaks[:-1] = data == 10
    breaks[edges[1:]] += 1
    line = np.concatenate([[0], np.cumsum(breaks)])[start]
    if not len(start):
        return Tokens(start, stop, text, line, np.zeros((0, 8), np.int64))

    def within(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums

    length = stop - start
    digits, uppers, smalls, hexes, symbols = (within(t) for t in (_DIGIT, _UPPER, _SMALL, _HEXDIGIT, _SYMBOL))
    count = lambda sums: sums[stop] - sums[start]
    d, u, s = count(digits), count(uppers), count(smalls)
    shape = np.searchsorted(_LENGTHS, length, side="right")
    for flag in (d > 0, u > 0, s > 0, count(hexes) == length, d + u + s < length):
        shape = shape * 2 + flag
    word = (range_hash(rolling(LOWER[data]), start, stop) >> np.uint64(52)).astype(np.int64)
    same_before = np.concatenate([[False], line[1:] == line[:-1]])
    same_after = np.concatenate([same_before[1:], [False]])
    before = np.where(same_before, np.concatenate([[0], word[:-1]]), 0)
    after = np.where(same_after, np.concatenate([word[1:], [0]]), 0)
    shape_before = np.where(same_before, np.concatenate([[0], shape[:-1]]), 0)
    left = np.where(start > edges[text], _GAP[data[np.maximum(start - 1, 0)]], 1)
    right = np.where(same_before, _GAP[data[np.concatenate([[0], stop[:-1]])]], 1)
    # An assignment sign anywhere between a word and the one before it.
    signs = np.zeros(256, np.int32)
    signs[[ord(":"), ord("=")]] = 1
    sign_sums = within(signs)
    signed = (sign_sums[start] - sign_sums[np.concatenate([[0], stop[:-1]])] > 0) & same_before
    gap = left * 8 + right
    keyed = np.where(signed, before, 0)
    size = np.maximum(np.diff(edges), 1)
    share = lambda sums: (8 * (sums[edges[1:]] - sums[edges[:-1]]) / size).astype(np.int64).clip(0, 3)
    file = (share(digits) * 4 + share(symbols))[text]
    columns = [shape, shape_before, word, before, after, gap, keyed, file]
    return Tokens(start, stop, text, line, np.stack([b + c for b, c in zip(_BASES, columns)], axis=1))


@dataclass
class Field:
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tag before x tag


def _allowed(moves: np.ndarray) -> np.ndarray:
    moves = moves.copy()
    moves[OUTSIDE, INSIDE] = _NEVER
    return moves


def _sum(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.log(np.exp(scores - top).sum(axis=axis)) + top.squeeze(axis)


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Field:
    """Adam on the likelihood of tag sequences (sequences x SEGMENT), by sums forwards and backwards.

    Features fall away at random in each pass, so that shape and neighbours each learn to tell alone.
    """
    n, t = tags.shape
    draw = np.random.default_rng(seed)
    field = Field(np.zeros((int(_BASES[-1]), 3)), np.zeros((3, 3)))
    moments = [[np.zeros_like(field.weights)] * 2, [np.zeros_like(field.moves)] * 2]
    alive = np.arange(t)[None, :] < lengths[:, None]
    gold = np.eye(3)[tags] * alive[..., None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, epochs + 1):
        kept = (draw.random(features.shape) >= DROPOUT) & alive[..., None]
        scores = (field.weights[features] * kept[..., None]).sum(axis=2)
        scores[:, 0, INSIDE] = _NEVER
        moves = _allowed(field.moves)
        forward, backward = np.zeros((t, n, 3)), np.zeros((t, n, 3))
        forward[0] = scores[:, 0]
        for i in range(1, t):
            on = _sum(forward[i - 1][:, :, None] + moves[None], 1) + scores[:, i]
            forward[i] = np.where(alive[:, i, None], on, forward[i - 1])
        for i in range(t - 2, -1, -1):
            back = _sum(moves[None] + (scores[:, i + 1] + backward[i + 1])[:, None, :], 2)
            backward[i] = np.where(alive[:, i + 1, None], back, 0)
        total = _sum(forward[-1], 1)
        expected = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * alive[..., None]
        pairs = np.zeros((3, 3))
        for i in range(1, t):
            joint = forward[i - 1][:, :, None] + moves[None] + (scores[:, i] + backward[i])[:, None, :] - total[:, None, None]
            pairs += (np.exp(joint) * alive[:, i, None, None]).sum(axis=0)
        error = gold - expected
        slope = np.zeros_like(field.weights)
        rows = features[kept]
        for tag in range(3):
            values = np.broadcast_to(error[..., None, tag], features.shape)[kept]
            slope[:, tag] = np.bincount(rows, values, minlength=len(slope))
        for value, moment, g in ((field.weights, moments[0], slope - 0.05 * field.weights), (field.moves, moments[1], gold_moves - pairs)):
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            value += RATE * (moment[0] / (1 - 0.9 ** step)) / (np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-8)
    return field


def viterbi(field: Field, scores: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The best tags of every line.

    A secret must gain over tags outside by some token; the most that moves can add bounds what a
    token needs, so lines where no token comes near are outside as a whole. The others advance
    together, one token a step, longest lines first.
    """
    tags = np.zeros(len(scores), np.int8)
    if not len(scores):
        return tags
    moves = _allowed(field.moves)
    extra = 2 * (moves.max() - moves[OUTSIDE, OUTSIDE]) + 1e-6
    warm = scores[:, 1:].max(axis=1) - scores[:, 0] + max(extra, 0) > 0
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(first, len(line)))
    use = np.add.reduceat(warm, first) > 0
    first, size = first[use], size[use]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    if not len(first):
        return tags
    back = np.zeros((len(scores), 3), np.int8)
    best = scores[first].astype(float)
    best[:, INSIDE] = _NEVER
    going = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # lines that have more tokens than so many
    for i in range(1, int(size[0])):
        n = int(going[i])
        options = best[:n, :, None] + moves[None]
        came = options.argmax(axis=1)
        back[first[:n] + i] = came
        best[:n] = np.take_along_axis(options, came[:, None, :], axis=1)[:, 0, :] + scores[first[:n] + i]
    tag = best.argmax(axis=1)
    for i in range(int(size[0]) - 1, -1, -1):
        n = int(going[i])
        tags[first[:n] + i] = tag[:n]
        tag[:n] = np.where(i > 0, back[first[:n] + i, tag[:n]], tag[:n])
    return tags


def _pieces(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """Pieces of lines with tags from the fixed patterns: hash, whether a secret is in it, features and tags."""
    tokens = tokenize(data, edges)
    if not len(tokens.start):
        return
    tags = np.zeros(len(tokens.start), np.int8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    for t in suspects(data, edges).tolist():
        base = int(np.searchsorted(lead, edges[t]))
        places = np.append(lead[base:], edges[-1])
        for a, b in _value_spans(data[edges[t]:edges[t + 1]].tobytes().decode()):
            hit = np.flatnonzero((tokens.start < places[b]) & (tokens.stop > places[a]))
            tags[hit] = INSIDE
            tags[hit[:1]] = BEGIN
    place = np.arange(len(tags)) - np.searchsorted(tokens.line, tokens.line)
    cut = np.flatnonzero((place % SEGMENT == 0))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(tags)).tolist()):
        order = int(range_hash(rolling(data[tokens.start[a]:tokens.stop[b - 1]]), np.array([0]),
                               np.array([tokens.stop[b - 1] - tokens.start[a]]))[0] >> np.uint64(2))
        own = tags[a:b].copy()
        own[:1] = np.where(own[:1] == INSIDE, BEGIN, own[:1])
        yield order, bool(own.any()), tokens.features[a:b].astype(np.int32).tobytes(), own.tobytes()


def _segments(secret: bool, most: int):
    """Training sequences of one sort: all with a secret, or few of the others. A task gives its first ``most`` by hash."""
    def texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, data, edges in chunks(batch.column(1)):
            if not secret:
                yield data, edges
                continue
            for t in suspects(data, edges).tolist():
                own = data[edges[t]:edges[t + 1]]
                if _value_spans(own.tobytes().decode()):
                    yield own, np.array([0, len(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            for data, edges in texts(batch):
                for order, found, features, tags in _pieces(data, edges):
                    if found == secret and (secret or order % 16 == 0):
                        kept.setdefault(order, (features, tags))
                if len(kept) > 2 * most:
                    kept = {o: kept[o] for o in sorted(kept)[:most]}
        orders = sorted(kept)[:most]
        yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int64()), *(pa.array([kept[o][k] for o in orders], pa.binary()) for k in (0, 1))],
                                         ["order", "features", "tags"])
    return run


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, segments: int = SEGMENTS) -> Field | None:
    """A field fitted on at most ``segments`` sequences with a secret and three times as many without.

    Those with a secret are the first by hash over all documents, so rare ones are found too; the others
    come from about ``rows`` documents that a hash of the key picks. Tags come from the fixed patterns.
    None if no document has a match.
    """
    def first(some: DataFrame, secret: bool, most: int) -> list:
        found = some.select(key, text).mapInArrow(_segments(secret, most), "order long, features binary, tags binary")
        return found.dropDuplicates(["order"]).orderBy("order").limit(most).collect()

    taken = first(docs, True, segments)
    if not taken:
        return None
    total = docs.count()
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("secrets:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint")
    taken += first(docs.where(draw < 2 ** 32 * min(1.0, rows / max(total, 1))), False, 3 * segments)
    features = np.zeros((len(taken), SEGMENT, len(_BASES) - 1), np.int64)
    tags, lengths = np.zeros((len(taken), SEGMENT), np.int64), np.zeros(len(taken), np.int64)
    for i, r in enumerate(taken):
        own = np.frombuffer(r["tags"], np.int8)
        lengths[i] = len(own)
        tags[i, :len(own)] = own
        features[i, :len(own)] = np.frombuffer(r["features"], np.int32).reshape(len(own), -1)
    return fit(features, tags, lengths)


def _scan(field: Field | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    weights = None if field is None else field.weights.astype(np.float32)

    def added(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, first byte and byte after the last of each tagged span."""
        tokens = tokenize(data, edges)
        scores = np.zeros((len(tokens.start), 3), np.float32)
        for k in range(tokens.features.shape[1]):
            scores += weights[tokens.features[:, k]]
        tags = viterbi(field, scores, tokens.line)
        begins = np.flatnonzero(tags == BEGIN)
        going = tags == INSIDE
        for b in begins.tolist():
            e = b
            while e + 1 < len(tags) and going[e + 1]:
                e += 1
            yield int(tokens.text[b]), int(tokens.start[b]), int(tokens.stop[e])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for row, _, data, edges in chunks(batch.column(1)):
                for t in suspects(data, edges).tolist():
                    spans[row + t] = [(a, k, b) for k, a, b in base_spans(data[edges[t]:edges[t + 1]].tobytes().decode())]
                if field is not None:
                    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for t, a, b in added(data, edges):
                        a, b = int(leads[a] - leads[edges[t]]), int(leads[b] - leads[edges[t]])
                        if not any(x < b and a < y for x, k, y in spans[row + t] if k < len(KINDS)):
                            spans[row + t].append((a, len(KINDS), b))
            values = pa.array([[{"start": a, "kind": k, "stop": b} for a, k, b in sorted(s)] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["key", "spans"])
    return run


def scan(docs: DataFrame, field: Field | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and ``spans`` of every row: start, kind (0 to 2 as in ``KINDS``, 3 found by the field), stop, in code points.

    A span of the field that meets one of a fixed pattern is left out. A null text is empty and has no
    spans, rows are independent, other columns are not looked at, an empty table gives no rows.
    """
    name = dict(docs.dtypes)[key]
    found = docs.select(key, text).mapInArrow(_scan(field), f"key {name}, spans array<struct<start:long,kind:int,stop:long>>")
    return found.withColumnRenamed("key", key)
