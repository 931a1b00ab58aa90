"""Repeated passages by distributed prefix doubling over sampled positions.

A prefix-doubling round ranks the first h bytes from every position, sorts pairs of ranks h apart
and so ranks 2h bytes, and drops positions whose rank is unique. Two rounds reach a threshold of
``length`` bytes:

1. Every ``length``-byte string is stood for by one half-length string inside it, its anchor: the one of
   least hash, the leftmost on a tie. Equal strings have equal anchors at equal places, so positions that are no
   anchor need no rank; about two in ``length`` / 2 are left. Anchors are sorted by hash, and those
   that only one document has are dropped: no string around them can repeat.
2. An anchor that is left is paired with the half-length strings on both sides. Strings through it are sorted
   by their bytes, offset by offset, and each learns the smallest document that has it.

Texts are packed into blocks of about ``BLOCK_BYTES``, anchors and their neighbourhoods into rows for each range of
hashes, so Spark shuffles packed rows and a task sorts numpy arrays of bounded size. Within a block equal
neighbourhoods are one entry, so a passage that a third of all documents share is one entry a block. Anchors that
stand at more than ``HOT`` places are dealt by whole strings instead, so a short common
phrase in ever new surroundings is spread over all tasks.

Round 1 compares 64-bit hashes and may keep an anchor too many; round 2 compares bytes, so what is removed is equal byte for byte.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import buffers as B
from .storage import cut, discard, small_batches

BLOCK_BYTES = 1 << 20
#: Anchors and entries that a task sorts at once, and places beyond which an anchor is dealt by whole strings.
PART_ANCHORS, PART_ENTRIES, HOT = 1 << 18, 1 << 15, 1 << 14
PLACE = np.uint64((1 << 20) - 1)
MANY = 1 << 15


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: document, start, end, place of the anchor and its hash.

    Start and end are places of strings in ``data``; strings never cross documents.
    """
    half = (length + 1) // 2
    starts, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s in range(0, len(data) - length + 1, B.PIECE):
        h = B.gram_hashes(data[s : s + B.PIECE + length - 1], half)
        # The place breaks ties of the upper 44 bits, so one minimum gives both.
        at = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - half + 1) & PLACE).astype(np.int64)
        turn = np.append(True, at[1:] != at[:-1])
        first = offsets[:-1]
        turn[first[(first >= s) & (first < s + len(at))] - s] = True
        turn = np.flatnonzero(turn)
        starts.append(s + turn)
        places.append(s + at[turn])
        # Anchors are least hashes, so they are mixed again to be spread evenly over the ranges.
        hashes.append(B.mix(h[at[turn]]))
    start, place, name = np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)
    doc = np.searchsorted(offsets, start, "right") - 1
    new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])) if len(start) else np.zeros(0, bool)
    doc, start, place, name = doc[new], start[new], place[new], name[new]
    end = np.minimum(np.append(start[1:], len(data)), offsets[doc + 1] - length + 1)
    held = end > start
    return doc[held], start[held], end[held], place[held], name[held]


def _blocks(batches, size: int):
    """Documents packed into rows of about ``size`` bytes: block, ids, sizes, data (compressed), n_bytes."""
    task, made = TaskContext.get().partitionId(), 0
    ids, sizes, parts, held = [], [], [], 0

    def row():
        data = b"".join(parts)
        cols = [pa.array([(task << 32) + made], pa.int64()), *(pa.array([np.concatenate(x).astype(np.int64).tobytes()], pa.binary()) for x in (ids, sizes)), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()), pa.array([len(data)], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "sizes", "data", "n_bytes"])

    for batch in batches:
        data, offsets = B.text_bytes(batch.column(1))
        doc_ids = batch.column(0).to_numpy()
        for i, j in B.pieces(offsets, size // 4):
            ids.append(doc_ids[i:j])
            sizes.append(np.diff(offsets[i : j + 1]))
            parts.append(data[offsets[i] : offsets[j]].tobytes())
            held += len(parts[-1])
            if held >= size or sum(map(len, ids)) >= 1 << 16:
                yield row()
                made, held, ids, sizes, parts = made + 1, 0, [], [], []
    if ids:
        yield row()


class _Block:
    """One packed row, read."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(pa.decompress(row["data"], row["n_bytes"], "zstd", asbytes=True), np.uint8)


def _opened(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield _Block(row), row


def _parts_of(sorted_keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The key ranges that have keys, and where each starts (one more at the end)."""
    part = ((sorted_keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return part[starts].astype(np.int64), np.append(starts, len(part))


def _anchors(batches, length: int, parts: int):
    """A block's different anchor hashes by range, with the number of places; ``MANY`` is added where several documents have one."""
    for b, _ in _opened(batches):
        doc, _, _, _, name = anchored(b.data, b.offsets, length)
        order = np.argsort(name, kind="stable")
        name, ids = name[order], b.ids[doc[order]]
        starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(name)))
        several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
        marks = (np.minimum(counts, MANY - 1) + MANY * several).astype(np.uint16)
        name = name[starts]
        part, at = _parts_of(name, parts)
        cut_at = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(at, at[1:], strict=False)], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), b.block)), cut_at(name), cut_at(marks)], ["part", "block", "names", "marks"])


def _shared(table: pa.Table, most: int) -> pa.Table:
    """For each block of a range the anchors that several documents have, and a byte each that is 1 for hot ones, at more than ``most`` places."""
    rows = [np.frombuffer(x, np.uint64) for x in table["names"].to_pylist()]
    names, marks = np.concatenate(rows), np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint16)
    order = np.argsort(names, kind="stable")
    starts = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    blocks = np.diff(np.append(starts, len(names)))
    shared = (blocks > 1) | (np.maximum.reduceat(marks[order], starts) >= MANY)
    hot = np.add.reduceat((marks[order] & (MANY - 1)).astype(np.int64), starts) > most
    # Of each place in the rows: 0 alone, 1 shared, 2 hot and shared.
    state = np.zeros(len(names), np.uint8)
    state[order] = np.repeat(shared.astype(np.uint8) * (1 + hot.astype(np.uint8)), blocks)
    out, at = [[], [], []], 0
    for block, own in zip(table["block"].to_pylist(), rows, strict=True):
        s = state[at : at + len(own)]
        at += len(own)
        if s.any():
            out[0].append(block)
            out[1].append(own[s > 0].tobytes())
            out[2].append((s[s > 0] - 1).tobytes())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["block", "names", "hot"])


class _Entries:
    """The different neighbourhoods of a block's shared anchors, and the places where each stands.

    A neighbourhood is a row of ``length`` bytes and the rest of an anchor's reach on the left, with zeros outside its strings,
    then the first and last offset of a string in it.
    """

    def __init__(self, b: _Block, row: dict, length: int):
        reach = length // 2
        names, hot = np.frombuffer(b"".join(row["names"] or []), np.uint64), np.frombuffer(b"".join(row["hot"] or []), np.uint8)
        order = np.argsort(names)
        names, hot = names[order], hot[order]
        doc, start, end, place, name = anchored(b.data, b.offsets, length)
        at = np.minimum(np.searchsorted(names, name), max(len(names) - 1, 0))
        known = names[at] == name if len(names) else np.zeros(len(name), bool)
        doc, start, end, place, name, is_hot = doc[known], start[known], end[known], place[known], name[known], hot[at[known]] > 0 if len(names) else hot.astype(bool)
        # The strings of hot anchors stand for themselves.
        n = np.where(is_hot, end - start, 1)
        pick = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
        doc, place, key, is_hot = doc[pick], place[pick], name[pick].copy(), is_hot[pick]
        start = start[pick] + step
        end = np.where(is_hot, start + 1, end[pick])
        key[is_hot] = B.span_hashes(b.data, start[is_hot], start[is_hot] + length, 1)
        low, high = start - place + reach, end - 1 - place + reach
        width = self.width(length)
        rows = np.zeros((len(key), width), np.uint8)
        padded = np.concatenate([np.zeros(reach, np.uint8), b.data, np.zeros(width, np.uint8)])
        column = np.arange(length + reach)
        for i in range(0, len(key), 1 << 12):
            s = slice(i, i + (1 << 12))
            inside = (column >= low[s, None]) & (column < high[s, None] + length)
            rows[s, : length + reach] = padded[place[s, None] + column] * inside
        rows[:, length + reach], rows[:, length + reach + 1] = low, high
        words, h = rows.view(np.uint64), np.zeros(len(key), np.uint64)
        for c in range(words.shape[1]):
            h = B.mix((h * B.STEP) ^ words[:, c])
        order = np.lexsort((h, key))
        rows, key, h = rows[order], key[order], h[order]
        new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)) if len(key) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.rows, self.key = rows[self.first], key[self.first]
        self.doc, self.base = doc[order], place[order] - reach
        self.ids = b.ids[self.doc]
        self.count = np.diff(np.append(self.first, len(key)))
        self.low = np.minimum.reduceat(self.ids, self.first) if len(key) else np.zeros(0, np.int64)
        self.offsets = self.rows[:, length + reach : length + reach + 2].astype(np.int64)

    @staticmethod
    def width(length: int) -> int:
        return -(-(length + length // 2 + 2) // 8) * 8


def _entries(batches, length: int, parts: int):
    for b, row in _opened(batches):
        e = _Entries(b, row, length)
        part, at = _parts_of(e.key, parts)
        rows = pa.array([pa.compress(e.rows[lo:hi].tobytes(), "zstd", asbytes=True) for lo, hi in zip(at, at[1:], strict=False)], pa.binary())
        lows = pa.array([e.low[lo:hi].tobytes() for lo, hi in zip(at, at[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), b.block)), pa.array(at[:-1].astype(np.int64)), rows, lows], ["part", "block", "at", "rows", "lows"])


def string_lows(rows: np.ndarray, lows: np.ndarray, length: int) -> np.ndarray:
    """For each neighbourhood and offset, the smallest document that has the string there; the row's own where there is no string."""
    reach = length // 2
    best = np.repeat(lows[:, None], reach + 1, axis=1)
    first, last = rows[:, length + reach], rows[:, length + reach + 1]
    words = np.ndarray((len(rows), rows.shape[1] - 7), "<u8", rows, strides=(rows.shape[1], 1))
    loads = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for j in range(reach + 1):
        at = np.flatnonzero((first <= j) & (j <= last))
        if len(at) < 2:
            continue
        h = np.zeros(len(at), np.uint64)
        for load in loads:
            h = B.mix((h * B.STEP) ^ words[at, j + load])
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        several = np.repeat(size > 1, size)
        low, leader = np.repeat(np.minimum.reduceat(lows[at], start), size)[several], np.repeat(at[start], size)[several]
        at = at[several]
        best[at, j] = low
        if not (words[at, j + loads[0]] == words[leader, j + loads[0]]).all() or not (rows[at, j : j + length] == rows[leader, j : j + length]).all():
            _by_bytes(rows, lows, best, j, length, np.flatnonzero((first <= j) & (j <= last)))
    return best


def _by_bytes(rows, lows, best, j: int, length: int, at: np.ndarray) -> None:
    """The same for one offset without hashes, for the case that two strings share one."""
    found: dict[bytes, int] = {}
    texts = [rows[i, j : j + length].tobytes() for i in at]
    for t, low in zip(texts, lows[at].tolist(), strict=True):
        found[t] = min(low, found.get(t, low))
    best[at, j] = [found[t] for t in texts]


def _met(table: pa.Table, length: int) -> pa.Table:
    """For each block the entries that a smaller document shares: entry, first and last offset, and that document."""
    width = _Entries.width(length)
    counts = np.array([len(x) // 8 for x in table["lows"].to_pylist()], np.int64)
    rows = np.frombuffer(b"".join(pa.decompress(x, n * width, "zstd", asbytes=True) for x, n in zip(table["rows"].to_pylist(), counts.tolist(), strict=True)), np.uint8).reshape(-1, width)
    lows = np.frombuffer(b"".join(table["lows"].to_pylist()), np.int64)
    best = string_lows(rows, lows, length)
    entry = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(table["at"].to_numpy(), counts)
    turn = np.concatenate([np.ones((len(best), 1), bool), best[:, 1:] != best[:, :-1]], axis=1)
    i, j = np.nonzero(turn)
    end = np.append(j[1:], 0)
    end = np.where(end == 0, best.shape[1], end) - 1
    met = best[i, j] < lows[i]
    i, j, end = i[met], j[met], end[met]
    found = np.stack([entry[i], j, end, best[i, j]], axis=1).astype(np.int64)
    at = np.searchsorted(i, np.append(0, np.cumsum(counts)))
    held = np.flatnonzero(np.diff(at))
    blocks = table["block"].to_numpy()
    return pa.table([pa.array(blocks[held]), pa.array([found[at[k] : at[k + 1]].tobytes() for k in held], pa.binary())], ["block", "met"])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def covered_bytes(b: _Block, row: dict, length: int) -> np.ndarray:
    """The bytes of a block that a smaller document has in a string of ``length``."""
    e = _Entries(b, row, length)
    met = np.frombuffer(b"".join(row["met"] or []), np.int64).reshape(-1, 4)
    # Against the other documents of the block, then against other blocks.
    own = np.repeat(np.arange(len(e.first)), e.count)
    here = np.flatnonzero(e.ids > e.low[own])
    starts, ends = [e.base[here] + e.offsets[own[here], 0]], [e.base[here] + e.offsets[own[here], 1] + length]
    sizes = e.count[met[:, 0]]
    at, which = _spread(e.first[met[:, 0]], sizes), np.repeat(np.arange(len(met)), sizes)
    there = e.ids[at] > met[which, 3]
    at, which = at[there], which[there]
    starts.append(e.base[at] + met[which, 1])
    ends.append(e.base[at] + met[which, 2] + length)
    step = np.bincount(np.concatenate(starts), minlength=len(b.data) + 1) - np.bincount(np.concatenate(ends), minlength=len(b.data) + 1)
    return np.cumsum(step)[:-1] > 0


def _removed(batches, length: int, as_text: bool):
    for b, row in _opened(batches):
        covered = covered_bytes(b, row, length)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[b.offsets])
        fresh = np.append(True, ~covered[:-1]) if len(covered) else covered
        final = np.append(~covered[1:], True) if len(covered) else covered
        inner = b.offsets[(b.offsets > 0) & (b.offsets < len(covered))]
        fresh[b.offsets[:-1][b.sizes > 0]] = True
        final[inner - 1] = True
        start, end = np.flatnonzero(covered & fresh), np.flatnonzero(covered & final) + 1
        doc = np.searchsorted(b.offsets, start, "right") - 1
        spans = np.stack([start - b.offsets[doc], end - b.offsets[doc]], axis=1).ravel()
        span_at = np.concatenate([[0], np.cumsum(2 * np.bincount(doc, minlength=len(b.ids)))]).astype(np.int32)
        kept_at = np.concatenate([[0], np.cumsum(b.sizes - n_removed)])
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b.data[~covered]))])
        if as_text:
            kept = pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())
        cols = [pa.array(b.ids), pa.array(b.sizes), pa.array(n_removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(span_at), pa.array(spans)), kept.cast(pa.string() if as_text else pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans, kept.

    Removes every byte covered by a ``length``-byte string (16 or more, at most 128) that also starts in a
    document with a smaller id, all judged on the input. spans lists start and
    end of the maximal removed runs in turn; kept holds the other bytes, or with
    ``as_text`` the text they make without characters of which only a part is left.

    A null text is empty; texts shorter than ``length`` bytes keep all; a long text is one block of its own and
    read whole. Rows with a null id are dropped. Ids are taken to be unique; rows that repeat an id get
    a string removed only if a smaller id has it too. Other
    columns are ignored. An empty table gives an empty result.
    """
    if not 16 <= length <= 128:
        raise ValueError("length must be from 16 to 128 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    packed = cut(texts.mapInArrow(partial(_blocks, size=BLOCK_BYTES), "block long, ids binary, sizes binary, data binary, n_bytes long"), "blocks")
    common = _common_anchors(packed, length)
    discard()  # the shuffle of all anchors
    met = _met_documents(packed, common, length)
    discard()
    out = packed.join(common, "block", "left").join(met, "block", "left")
    return out.mapInArrow(partial(_removed, length=length, as_text=as_text), f"doc_id long, n_bytes long, n_removed long, spans array<long>, kept {'string' if as_text else 'binary'}")


def _common_anchors(packed: DataFrame, length: int) -> DataFrame:
    """Round 1: block, names and hot of the anchors that several documents have."""
    parts = max(1, -(-4 * packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] // (length * PART_ANCHORS)))
    hot = HOT

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _shared(table, hot)

    anchors = packed.mapInArrow(partial(_anchors, length=length, parts=parts), "part long, block long, names binary, marks binary")
    common = anchors.groupBy("part").applyInArrow(shared, "block long, names binary, hot binary")
    return cut(common.groupBy("block").agg(F.collect_list("names").alias("names"), F.collect_list("hot").alias("hot")), "anchors")


def _met_documents(packed: DataFrame, common: DataFrame, length: int) -> DataFrame:
    """Round 2: block and met, the entries of each block that smaller documents of other blocks share."""
    known = common.agg(F.coalesce(F.sum(F.aggregate("names", F.lit(0).cast("long"), lambda n, x: n + F.length(x))), F.lit(0))).first()[0] // 8
    parts = max(1, -(-known // PART_ENTRIES))

    def met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _met(table, length)

    entries = packed.join(common, "block").mapInArrow(partial(_entries, length=length, parts=parts), "part long, block long, at long, rows binary, lows binary")
    return cut(entries.groupBy("part").applyInArrow(met, "block long, met binary").groupBy("block").agg(F.collect_list("met").alias("met")), "met")
