"""Long byte strings that a document shares with an earlier one, found exactly over all documents.

Every window of 50 bytes owns an anchor: the leftmost of its 25-byte strings with the smallest hash.
Equal windows have equal anchors at equal places, so windows are compared only under one anchor.
Neighbouring windows with one anchor are a run, and the bytes they cover are its context.

1. Each task sends every distinct (anchor, context) once, with its smallest document.
2. An owner task per anchor range settles equal contexts: all but the smallest document lose the whole
   run. Only anchors with several contexts and several documents go on.
3. The smallest document of each such context supplies its bytes, and a suffix array over the contexts
   of an anchor brings equal windows together: all but the smallest document lose them.
4. Documents meet their verdicts and are cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import blobs
from tablewright.llm.flat import Powers, chunks, mix, range_hash, rolling
from tablewright.llm.suffixes import suffix_array
from tablewright.session import rows_per_batch, written

WINDOW, GRAM = 50, 25
SPAN = WINDOW - GRAM + 1  # 25-byte strings in a window, windows in a run at most, symbols of a window in a suffix array
ALL = (1 << SPAN) - 1
NULL_KEY = np.int64(2 ** 63 - 1)  # a null key is larger than all others
ANCHOR_BYTES = 8_000_000  # of text per owner task of anchors
TEXT_BYTES = 16_000_000  # of text per owner task of documents
ENTRIES_PER_FLUSH = 2_000_000  # some 180 MB while they are sorted and dealt
TEXTS_PER_BATCH = 1_000
CHUNK = 1 << 17  # bytes whose windows are hashed at once, so that the arrays stay in a core's cache
HOT_CONTEXTS = 20_000  # contexts of one anchor beyond which its windows are dealt over several tasks
_U = np.uint64

_ENTRY = ["u1", "u1", "<i8", "<u4"]  # anchor (5 bytes), context (6 bytes), owners, runs of owners
_VERDICT = ["<i8", "u1", "<u4"]  # document, context, windows
_REQUEST = ["<i8", "u1", "<u8", "<u4"]  # document, context, anchor, parts
_CONTEXT = ["<u8", "<u4", "<i8", "u1", "u1", "u1", "<u4", "u1"]  # anchor, part, document, context, first window, windows, symbols' count, symbols
_PACKED = "bucket int, kind int, data binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
        ["bucket", "kind", "data"])


def _runs(data: np.ndarray, edges: np.ndarray):
    """All runs of a chunk of texts: text, first window, windows, anchor's place, anchor's hash, context's hash (48 bits)."""
    n = len(data)
    nothing = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if n < WINDOW:
        return nothing
    sums = rolling(data)
    # A hash of each 25-byte string, in whose place its own position stands below the upper half.
    least = sums[GRAM:] - sums[:-GRAM]
    least *= Powers.upto(n)[1][:len(least)]
    least &= _U(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    reach = 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    inside = np.ones(len(least), bool)
    for end in edges[1:].tolist():  # no window starts in the last bytes of a text; of a short one they reach into those of the text before
        inside[max(end - WINDOW + 1, 0):end] = False
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return nothing
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    count = np.flatnonzero(ends) + 1 - first
    anchor = (least[first] & _U(0xFFFFFFFF)).astype(np.int64)
    context = mix(range_hash(sums, first, first + count + WINDOW - 1) + (anchor - first).astype(np.uint64))
    gram = range_hash(sums, anchor, anchor + GRAM)
    text = np.searchsorted(edges, first, side="right") - 1
    return text, first, count, anchor, mix(gram ^ _U(0x5851F42D4C957F2D)), context & _U((1 << 48) - 1)


def _ordered(key: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Rows in the order of their keys, those of equal keys in the order of the ties."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(tied):
        rows = order[tied]
        order[tied] = rows[np.lexsort((*[t[rows] for t in reversed(ties)], key[rows]))]
    return order


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)


def _spot(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % _U(buckets)).astype(np.int64)


def _anchor_spot(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _verdicts(doc: np.ndarray, context: np.ndarray, windows: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(b, 0, blobs.join([d, blobs.narrow(c, 6), w]))
            for b, (d, c, w) in blobs.by_bucket(_spot(doc, buckets), [doc, context, windows.astype(np.uint32)], buckets)]


def _find(anchor_buckets: int, doc_buckets: int):
    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, context, doc = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = _ordered(anchor ^ (context << _U(16)), context, doc)
        a, c, d = anchor[order], context[order], doc[order]
        begins = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        least = d[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        lost = (d > least) & np.concatenate([[True], begins[1:] | (d[1:] != d[:-1])])
        rows = [(b, 1, x) for b, _, x in _verdicts(d[lost], c[lost], np.full(int(lost.sum()), ALL), doc_buckets)]
        sent = np.sort(order[begins])  # in the order of the documents
        del order, a, c, d, begins, least, lost
        for b, (x, y, z) in blobs.by_bucket(_anchor_spot(anchor[sent], anchor_buckets), [anchor[sent], context[sent], doc[sent]], anchor_buckets):
            start = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
            rows.append((b, 0, blobs.join([
                blobs.narrow(x, 5), blobs.narrow(y, 6), z[start], np.diff(np.append(start, len(z))).astype(np.uint32)])))
        yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            keys = _keys(batch.column(0))
            for row, _, data, edges in chunks(batch.column(1), CHUNK):
                text, _, _, _, anchor, context = _runs(data, edges)
                held.append([anchor, context, keys[row + text]])
                entries += len(text)
                if entries >= ENTRIES_PER_FLUSH:
                    yield from flush(held)
                    entries = 0
        if entries:
            yield from flush(held)
    return run


def _settle(doc_buckets: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        found = table.column("data").to_pylist()
        anchor, context, owners, sizes = blobs.gather(found, _ENTRY)
        # Only the anchor's low 40 bits travel; the bucket is part of the grouping already.
        anchor, context, doc = blobs.wide(anchor, 5), blobs.wide(context, 6), np.repeat(owners, sizes)
        order = _ordered((anchor << _U(24)) | (context >> _U(24)), context, doc)
        anchor, context, doc = anchor[order], context[order], doc[order]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        begins = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        start, group = np.flatnonzero(begins), np.cumsum(begins) - 1
        least = doc[start]  # of each context
        lost = (doc > least[group]) & (begins | np.concatenate([[True], doc[1:] != doc[:-1]]))
        rows = _verdicts(doc[lost], context[lost], np.full(int(lost.sum()), ALL), doc_buckets)
        head = np.flatnonzero(new_anchor[start])  # the first context of each anchor
        contexts = np.diff(np.append(head, len(start)))
        mixed = (np.minimum.reduceat(least, head) < np.maximum.reduceat(least, head)) & (contexts > 1)
        asked = np.repeat(mixed, contexts)
        parts = np.repeat(np.where(contexts > hot, contexts * SPAN // hot, 1), contexts)[asked]
        d, c, a = least[asked], context[start][asked], anchor[start][asked]
        rows += [(b, 1, blobs.join([x, blobs.narrow(y, 6), z, p])) for b, (x, y, z, p) in blobs.by_bucket(
            _spot(d, doc_buckets), [d, c, a, parts.astype(np.uint32)], doc_buckets)]
        return pa.Table.from_batches([_rows(rows)])
    return run


def _texts(doc_buckets: int):
    """Whole rows by document bucket: key, length, bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(0))
            spots = _spot(keys, doc_buckets)
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            rows = []
            for b, (at,) in blobs.by_bucket(spots, [np.arange(len(keys))], doc_buckets):
                mine = texts.take(pa.array(at))
                joined = b"".join(mine.to_pylist())
                lengths = np.diff(np.frombuffer(mine.buffers()[1], np.int64)[mine.offset:mine.offset + len(mine) + 1])
                rows.append((b, 2, blobs.join([keys[at], lengths, np.frombuffer(joined, np.uint8)])))
            yield _rows(rows)
    return run


def _documents(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, bytes and edges of texts, a chunk at a time."""
    for blob in table.column("data").to_pylist():
        keys, lengths, data = blobs.split(blob, ["<i8", "<i8", "u1"])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        for row, stop, part, cut in chunks(column, CHUNK):
            yield keys[row:stop], part, cut


def _pair(doc: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) + context)


def _merged(table: pa.Table, kinds: list[str]):
    """The blobs' rows by pair of document and context, sorted by that pair."""
    doc, context, *rest = blobs.gather(table.column("data").to_pylist(), kinds)
    pair = _pair(doc, blobs.wide(context, 6))
    order = np.argsort(pair)
    return pair[order], doc[order], blobs.wide(context, 6)[order], [x[order] for x in rest]


def _lookup(sought: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sought stand in the sorted known ones, and where."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    hit = np.flatnonzero(known[at] == sought)
    return hit, at[hit]


_SHIFT = bytes((b + 2) & 255 for b in range(256))  # makes room for 0 and 1; bytes above 0xF7 are in no UTF-8 text


def _supply(anchor_buckets: int):
    """The bytes of the contexts that are asked for: the anchor itself becomes one symbol, 255."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, doc, context, (anchor, parts) = _merged(right, _REQUEST)
        open_, out = np.ones(len(pair), bool), []
        for keys, data, edges in _documents(left):
            text, first, count, place, _, ctx = _runs(data, edges)
            hit, at = _lookup(_pair(keys[text], ctx), pair)
            whole = data.tobytes()
            for h, k in zip(hit.tolist(), at.tolist()):
                if open_[k]:
                    open_[k] = False
                    f, c, p = int(first[h]), int(count[h]), int(place[h])
                    symbols = whole[f:p].translate(_SHIFT) + b"\xff" + whole[p + GRAM:f + c + WINDOW - 1].translate(_SHIFT)
                    if parts[k] == 1:
                        out.append((k, 0, 0, c, symbols))
                    else:  # each window by itself, dealt by its content
                        for w in range(c):
                            piece = symbols[w:w + SPAN]
                            part = int.from_bytes(hashlib.blake2b(piece, digest_size=4).digest(), "little") % int(parts[k])
                            out.append((k, part, w, 1, piece))
        if not out:
            return pa.Table.from_batches([_rows([])])
        k, part, start, windows, symbols = zip(*out)
        k, part = np.array(k), np.array(part, np.uint32)
        target = (mix(anchor[k] + _U(0x9E37) * part.astype(np.uint64)) % _U(anchor_buckets)).astype(np.int64)
        rows = []
        for b, (i,) in blobs.by_bucket(target, [np.arange(len(k))], anchor_buckets):
            mine = [symbols[j] for j in i.tolist()]
            rows.append((b, 0, blobs.join([
                anchor[k[i]], part[i], doc[k[i]], blobs.narrow(context[k[i]], 6), np.array(start, np.uint8)[i],
                np.array(windows, np.uint8)[i], np.array([len(x) for x in mine], np.uint32), np.frombuffer(b"".join(mine), np.uint8)])))
        return pa.Table.from_batches([_rows(rows)])
    return run


def repeated_windows(contexts: list[tuple[int, int, bytes]]) -> list[int]:
    """For each (document, windows, symbols) of one anchor: the windows, as bits, that a smaller document has too."""
    text = b"\x01".join(symbols for _, _, symbols in contexts) + b"\x00"
    owner, at = [-1] * len(text), 0  # a window's context and place in it, as one number
    for number, (_, windows, symbols) in enumerate(contexts):
        owner[at:at + windows] = range(number * SPAN, number * SPAN + windows)
        at += len(symbols) + 1
    out, run, last = [0] * len(contexts), [], None

    def close() -> None:
        least = min(contexts[k // SPAN][0] for k in run)
        for k in run:
            if contexts[k // SPAN][0] > least:
                out[k // SPAN] |= 1 << k % SPAN

    for i in suffix_array(text):
        if owner[i] >= 0:
            window = text[i:i + SPAN]
            if window == last:
                run.append(owner[i])
            else:
                if len(run) > 1:
                    close()
                run, last = [owner[i]], window
    if len(run) > 1:
        close()
    return out


def shared_stretches(group: np.ndarray, doc: np.ndarray, windows: np.ndarray, starts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """The context, first window and number of windows of every stretch of windows that another document of the group may have too.

    Equal windows have equal hashes, so that a window whose hash no other document has is equal to none, and needs no place in a suffix array.
    """
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3
    places = len(symbols) - SPAN + 1
    h = np.zeros(places, np.uint64)
    for j in range(SPAN):
        h *= _U(0x9E3779B97F4A7C15)
        h += symbols[j:j + places]
    context = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    name = mix(h[starts[context] + window] ^ mix(group.astype(np.uint64))[context])
    order = np.argsort(name)
    ranked, owner = name[order], doc[context[order]]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    kept = np.zeros(len(context), bool)
    kept[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    before = np.concatenate([[False], kept[:-1]]) & (window > 0)
    after = np.concatenate([kept[1:] & (window[1:] > 0), [False]])
    begin, end = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after)
    return context[begin], window[begin], end - begin + 1


def _compare(doc_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, part, doc, context, start, windows, sizes, symbols = blobs.gather(table.column("data").to_pylist(), _CONTEXT)
        context = blobs.wide(context, 6)
        order = np.lexsort((context, doc, part, anchor))
        a, p = anchor[order], part[order]
        group = np.zeros(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (p[1:] != p[:-1])])[:len(order)])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        whole, masks = symbols.tobytes(), np.zeros(len(anchor), np.uint32)
        at, window, count = shared_stretches(group, doc, windows.astype(np.int64), starts, symbols)
        by = np.argsort(group[at], kind="stable")
        at, window, count = at[by], window[by], count[by]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group[at]) > 0, [True]])) if len(at) else np.zeros(1, int)
        begin, owner, shift = starts[at] + window, doc[at].tolist(), (window + start[at]).tolist()
        begin, end, at, count = begin.tolist(), (begin + count + SPAN - 1).tolist(), at.tolist(), count.tolist()
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            found = repeated_windows([(owner[k], count[k], whole[begin[k]:end[k]]) for k in range(lo, hi)])
            for k, mask in zip(range(lo, hi), found):
                masks[at[k]] |= np.uint32(mask << shift[k])
        lost = masks > 0
        return pa.Table.from_batches([_rows(_verdicts(doc[lost], context[lost], masks[lost], doc_buckets))])
    return run


def lost_windows(doc: np.ndarray, data: np.ndarray, edges: np.ndarray, pair: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk some lost window covers."""
    text, first, count, _, _, context = _runs(data, edges)
    hit, at = _lookup(_pair(doc[text], context), pair)
    every = (_U(1) << count[hit].astype(np.uint64)) - _U(1)
    mine = masks[at].astype(np.uint64) & every
    edge = np.zeros(len(data) + 1, np.int32)  # runs, and windows of one place in theirs, start at different bytes
    whole = hit[mine == every]
    edge[first[whole]] += 1
    edge[first[whole] + count[whole] + WINDOW - 1] -= 1
    some = np.flatnonzero(mine != every)
    for w in range(SPAN):
        these = hit[some[mine[some] >> _U(w) & _U(1) > 0]]
        edge[first[these] + w] += 1
        edge[first[these] + w + WINDOW] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _cut(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, _, _, (masks,) = _merged(right, _VERDICT)
        if len(pair):
            begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, masks = pair[begins], np.bitwise_or.reduceat(masks, begins)
        rows = []
        for keys, data, edges in _documents(left):
            lost = lost_windows(keys, data, edges, pair, masks)
            ends = np.concatenate([lost[:-1] & ~lost[1:], lost[-1:]])
            ends[edges[1:][edges[1:] > 0] - 1] = lost[edges[1:][edges[1:] > 0] - 1]
            spans = np.concatenate([[0], np.cumsum(ends)])
            gone = np.concatenate([[0], np.cumsum(lost)])
            for k, a, b in zip(keys.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                kept = (data[a:b][~lost[a:b]] if gone[b] > gone[a] else data[a:b]).tobytes()
                rows.append((None if k == NULL_KEY else k, b - a, int(gone[b] - gone[a]), int(spans[b] - spans[a]),
                             hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        columns = list(zip(*rows)) or [()] * (5 + with_text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})
    return run


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False, hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """One row per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and the bytes kept if asked for.

    A byte goes when a 50-byte string that covers it also starts in a document with a smaller key. A
    null text is empty; a null key is larger than all others; rows that share a key take nothing from
    each other. Texts under 50 bytes stay as they are. An empty table gives no rows, other columns are
    not looked at. Keys are integers.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    anchors, owners = max(8, math.ceil(size / ANCHOR_BYTES)), max(8, math.ceil(size / TEXT_BYTES))
    found = docs.mapInArrow(_find(anchors, owners), _PACKED)
    # Entries (kind 0) carry anchor buckets; verdicts that a task reached alone (kind 1) carry document buckets.
    settled = found.groupBy("kind", "bucket").applyInArrow(_settle_or_pass(owners, hot_contexts), _PACKED)
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        settled = written(settled, "settled")
    packed = docs.mapInArrow(_texts(owners), _PACKED)
    asked = settled.where("kind = 1")
    contexts = packed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_supply(anchors), _PACKED)
    # Few bytes are much work here, so partitions are not left to their size; of twice as many as buckets few hold several.
    compared = contexts.repartition(2 * anchors, "bucket").groupBy("bucket").applyInArrow(_compare(owners), _PACKED)
    compared = written(compared, "compared")
    verdicts = settled.where("kind = 0").union(compared)
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = packed.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(_cut(with_text), schema)
    return cut.withColumnRenamed("key", key)


def _settle_or_pass(doc_buckets: int, hot: int):
    """Entries (kind 0) are settled; verdicts (kind 1) go on as they are, under the number of verdicts."""
    settle = _settle(doc_buckets, hot)

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 0:
            return settle(table)
        return pa.table({"bucket": table.column("bucket"), "kind": pa.array(np.zeros(len(table), np.int32)), "data": table.column("data")})
    return run
