"""Language identification by a convolutional network over bytes, trained in numpy on labelled text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tablewright.llm.flat import chunks

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 12, 8
TRAINING_ROWS = 4_000  # over all languages together, in equal parts
TRAINING_WINDOWS = 2  # per row
MOST_LANGUAGES = 500
EPOCHS, BATCH, RATE = 8, 64, 0.004
LEAST_STEPS = 500  # small samples are gone over more often
FOLDS = 5
CHUNK = 1 << 18
UNDETERMINED = "und"


@dataclass
class Network:
    """Embedded bytes, filters of several widths, the largest response of each in a window, and a softmax."""
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # per width: width x E x F
    bias: np.ndarray  # filters of all widths
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]


def start(languages: Sequence[str], seed: int = 5) -> Network:
    draw = np.random.default_rng(seed)
    scale = lambda *shape: draw.normal(0, 1 / np.sqrt(np.prod(shape[:-1])), shape).astype(np.float32)
    features = FILTERS * len(WIDTHS)
    return Network(list(languages), draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                   [scale(w, EMBEDDING, FILTERS) for w in WIDTHS], np.zeros(features, np.float32),
                   scale(features, len(languages)), np.zeros(len(languages), np.float32))


def _responses(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each window, and where it begins."""
    best, spots = [], []
    for kernel in net.filters:
        width = kernel.shape[0]
        places = WINDOW - width + 1
        total = np.zeros((len(windows), places, FILTERS), np.float32)
        for j in range(width):  # a byte's response at a place of the filter is looked up
            total += np.take(net.embedding @ kernel[j], windows[:, j:j + places], axis=0)
        spot = total.argmax(axis=1)
        spots.append(spot)
        best.append(np.take_along_axis(total, spot[:, None, :], axis=1)[:, 0, :])
    return np.concatenate(best, axis=1) + net.bias, np.concatenate(spots, axis=1)


def _largest(net: Network, windows: np.ndarray) -> np.ndarray:
    """As the first part of :func:`_responses`, for many windows."""
    best = []
    for kernel in net.filters:
        width = kernel.shape[0]
        places = WINDOW - width + 1
        total = np.take(net.embedding @ kernel[0], windows[:, :places], axis=0)
        for j in range(1, width):
            total += np.take(net.embedding @ kernel[j], windows[:, j:j + places], axis=0)
        best.append(total.max(axis=1))
    return np.concatenate(best, axis=1) + net.bias


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    return _softmax(np.maximum(_largest(net, windows), 0) @ net.out + net.out_bias)


def train(windows: np.ndarray, labels: np.ndarray, languages: Sequence[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the cross entropy; a gradient reaches a filter only where its largest response was."""
    net, draw = start(languages, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))):
        order = draw.permutation(len(windows))
        for begin in range(0, len(order), BATCH):
            rows = order[begin:begin + BATCH]
            x = windows[rows]
            raw, spots = _responses(net, x)
            active = np.maximum(raw, 0)
            error = _softmax(active @ net.out + net.out_bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = (error @ net.out.T) * (raw > 0)
            embedded, kernels = np.zeros_like(net.embedding), []
            for i, kernel in enumerate(net.filters):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                grown = np.zeros_like(kernel)
                for j in range(kernel.shape[0]):
                    seen = x[np.arange(len(rows))[:, None], spots[:, part] + j]  # the byte under each filter's best place
                    grown[j] = np.einsum("nfe,nf->ef", net.embedding[seen], back[:, part])
                    np.add.at(embedded, seen, back[:, part][:, :, None] * kernel[j].T[None])
                kernels.append(grown)
            slopes = [embedded, *kernels, back.sum(0), active.T @ error, error.sum(0)]
            step += 1
            for p, (m, v), g in zip(net.parameters(), moments, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts, the last of each filled up with zeros, and how many each text has."""
    sizes = np.diff(edges)
    counts = -(-sizes // WINDOW)
    gap = np.concatenate([[0], np.cumsum(counts * WINDOW)])[:-1] - edges[:-1]
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    flat[np.arange(len(data)) + np.repeat(gap, sizes)] = data
    return flat.reshape(-1, WINDOW), counts


def is_held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAINING_ROWS) -> Network | None:
    """A network fitted on at most ``rows`` labelled documents outside the held-out fold, in equal parts per language.

    Which ones are taken is decided by a hash of the key, against a share that the counts of all
    documents give, so no rows are sorted; each gives two windows at places the hash decides.
    None if no document has a label and a letter.
    """
    order = F.conv(F.substring(F.md5(F.concat(F.lit("sample:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint")
    usable = docs.where(F.col(lang).isNotNull() & (F.col(lang) != UNDETERMINED) & ~is_held_out(F.col(key)))
    found = usable.groupBy(F.col(lang).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the sample of {rows} rows can't show them all")
    if not found:
        return None
    each = max(1, rows // len(found))
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(2.0 ** 32, 1.5 * each / r["count"] * 2 ** 32)))])
    spots = [F.substring(F.col(text), F.pmod(F.shiftright(order, 3 * i), F.greatest(F.length(text) - WINDOW // 2, F.lit(1))).cast("int") + 1, F.lit(WINDOW))
             for i in range(TRAINING_WINDOWS)]
    chosen = usable.where((order <= share[F.col(lang)]) & F.col(text).rlike(r"\p{L}"))
    sample = chosen.select(F.col(lang).alias("lang"), order.alias("order"), F.array(*spots).alias("parts")).collect()
    languages, taken = sorted({r["lang"] for r in sample}), {}
    windows, labels = [], []
    for r in sorted(sample, key=lambda r: (r["order"], r["lang"], r["parts"])):
        if taken.get(r["lang"], 0) < each:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            for part in r["parts"]:
                cut = part.encode()[:WINDOW]
                windows.append(cut + bytes(WINDOW - len(cut)))
                labels.append(languages.index(r["lang"]))
    if not windows:
        return None
    return train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels), languages)


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the mean over all windows of the whole text.

    A null text, one without a letter, and every text where nothing could be learned are ``und`` with
    score 0. Rows are independent; an empty table gives no rows. Columns of ``docs`` with these two
    names are replaced.
    """
    given = [c for c in docs.columns if c not in ("lang_pred", "score")]
    lettered = docs.select(*[F.col(f"`{c}`") for c in given], F.col(text).rlike(r"\p{L}").alias("__lettered"))
    at = given.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, data, edges in chunks(batch.column(at), CHUNK):
                if net is None:
                    names += [None] * (len(edges) - 1)
                    scores += [0.0] * (len(edges) - 1)
                    continue
                windows, counts = cut_windows(data, edges)
                sums = np.zeros((len(windows) + 1, len(net.languages)))
                for begin in range(0, len(windows), 512):
                    part = probabilities(net, windows[begin:begin + 512])
                    sums[begin + 1:begin + 1 + len(part)] = part
                np.cumsum(sums, axis=0, out=sums)
                stops = np.concatenate([[0], np.cumsum(counts)])
                mean = (sums[stops[1:]] - sums[stops[:-1]]) / np.maximum(counts, 1)[:, None]
                best = mean.argmax(axis=1)
                names += [net.languages[b] for b in best]
                scores += np.minimum(mean[np.arange(len(best)), best], 1.0).tolist()
            columns = [batch.column(i) for i in range(len(given))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(len(given)), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*given, "__lettered", "__lang", "__score"])

    fields = StructType([*lettered.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())])
    guessed = lettered.mapInArrow(run, fields)
    known = F.coalesce(F.col("__lettered"), F.lit(False)) & F.col("__lang").isNotNull()
    return guessed.select(
        *[F.col(f"`{c}`") for c in given], F.when(known, F.col("__lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, F.col("__score")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learned on the documents that aren't held out."""
    net = learn(docs, text, lang, key, rows)
    return predict(docs.withColumn("held_out", is_held_out(F.col(key))), net, text)
