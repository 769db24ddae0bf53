"""Finding, over a whole corpus, which stretches of text start earlier elsewhere.

Three passes, shared by the operators that remove repeated passages:

1. a count-min sketch of signature hashes says which stretches can repeat;
2. each task turns the stretches that can repeat into items, settles those
   that repeat inside a chunk of its own rows, and sends only the first of
   each kind to a bucket chosen by its signature. A bucket thus gets at most
   one row of a kind from each chunk, however hot the passage;
3. buckets settle the rest, and the covered stretches go back to the
   documents, grouped by row id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.llm.common import batch, by_key, fan_out, ids_of, pack, slices, unpack_all
from swissline.llm.sketch import Repeated

CHUNK = 24 << 20
_ROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("blob", pa.binary())])


def pack_runs(ids: np.ndarray, rids: np.ndarray, *others: np.ndarray) -> bytes:
    """Arrays whose neighbours are mostly of one row: ids once for each run."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])
    at = np.flatnonzero(new)
    return pack(ids[at], rids[at], np.diff(np.append(at, len(ids))).astype(np.uint32), *others)


def unpack_runs(blobs, *kinds) -> list[np.ndarray]:
    """ids, rids and the other arrays of many blobs."""
    ids, rids, n, *others = unpack_all(blobs, np.int64, np.int64, np.uint32, *kinds)
    return [np.repeat(ids, n), np.repeat(rids, n), *others]


def _pack_cover(ids, rids, start, end) -> bytes:
    s = np.lexsort((start, rids, ids))
    return pack_runs(ids[s], rids[s], start[s].astype(np.uint32), (end[s] - start[s]).astype(np.uint32))


def _unpack_cover(blobs):
    ids, rids, start, size = unpack_runs(blobs, np.uint32, np.uint32)
    return ids, rids, start.astype(np.int64), start.astype(np.int64) + size


def joined(ids, rids, start, end):
    """Overlapping and touching stretches of a row as one."""
    s = np.lexsort((end, start, rids, ids))
    ids, rids, start, end = ids[s], rids[s], start[s].astype(np.int64), end[s].astype(np.int64)
    if not len(s):
        return ids, rids, start, end
    row = np.ones(len(s), bool)
    row[1:] = (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])
    n = np.cumsum(row) << 33
    reach = np.maximum.accumulate(n + end)
    new = row.copy()
    new[1:] |= (n + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1
    return ids[at], rids[at], start[at], reach[last] - n[last]


def inside(n: int, bounds: np.ndarray, k: int) -> np.ndarray:
    """Which of the n - k + 1 runs of k values stay inside one row."""
    ok = np.ones(max(0, n - k + 1), bool)
    cuts = bounds[1:-1]
    bad = (cuts[:, None] - np.arange(1, k)).ravel()
    ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def minima(grams: np.ndarray, ok_gram: np.ndarray, ok_window: np.ndarray, per: int):
    """Least gram hash of each window, and the positions that are least in some window of their row."""
    from swissline.llm.common import sliding

    g = np.where(ok_gram, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = sliding(g, per, np.minimum)
    pad = np.zeros(per - 1, np.uint64)
    high = sliding(np.concatenate([pad, np.where(ok_window, low, np.uint64(0)), pad]), per, np.maximum)
    return low, np.flatnonzero((g == high) & ok_gram)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """text[a : a + size] == text[b : b + size], pair by pair."""
    out = np.ones(len(a), bool)
    at = 0
    while at < len(a):  # some MB at a time
        to = min(len(a), at + max(1, int((8 << 20) // max(1, int(size[at : at + 65536].max(initial=1))))), at + 65536)
        s = size[at:to].astype(np.int64)
        first = np.cumsum(s) - s
        within = np.arange(int(s.sum())) - np.repeat(first, s)
        equal = text[np.repeat(a[at:to], s) + within] == text[np.repeat(b[at:to], s) + within]
        wrong = np.zeros(len(equal) + 1, np.int64)
        np.cumsum(~equal, out=wrong[1:])
        out[at:to] = wrong[first + s] == wrong[first]
        at = to
    return out


class Chunk:
    """Some rows of a task with their texts joined."""

    def __init__(self):
        self.ids, self.rids, self.bufs, self.size, self.rows = [], [], [], 0, 0

    def add(self, ids, rids, buf):
        """Returns number of the first row and place of the first byte."""
        at = self.rows, self.size
        self.ids.append(ids)
        self.rids.append(rids)
        self.bufs.append(buf)
        self.rows += len(ids)
        self.size += len(buf)
        return at

    def close(self):
        self.ids, self.rids, self.text = np.concatenate(self.ids), np.concatenate(self.rids), np.concatenate(self.bufs)
        order = np.lexsort((self.rids, self.ids))
        self.rank = np.empty(self.rows, np.int64)
        self.rank[order] = np.arange(self.rows)
        # repeated rows are one document
        same = np.zeros(self.rows, bool)
        same[1:] = (self.ids[order][1:] == self.ids[order][:-1]) & (self.rids[order][1:] == self.rids[order][:-1])
        self.rank[order] -= np.cumsum(same)


def chunks(batches, work: Callable):
    """Calls work(chunk, row, byte, buf, offs) for each slice; yields full chunks with what it returned."""
    chunk, parts = Chunk(), []
    for b in batches:
        ids, rids = ids_of(b)
        for lo, hi, buf, offs in slices(b.column("text")):
            row, byte = chunk.add(ids[lo:hi], rids[lo:hi], buf)
            parts.append(work(row, byte, buf, offs))
            if chunk.size >= CHUNK:
                chunk.close()
                yield chunk, parts
                chunk, parts = Chunk(), []
    if chunk.rows:
        chunk.close()
        yield chunk, parts


def cover_rows(ids, rids, start, end, groups: int, buckets: int):
    """Rows that carry covered stretches through the buckets."""
    ids, rids, start, end = joined(ids, rids, start, end)
    for bucket, p in by_key((rids % groups) % buckets):
        yield int(bucket), 1, _pack_cover(ids[p], rids[p], start[p], end[p])


def find_repeats(
    docs: DataFrame, total_bytes: int, items: Callable, resolve: Callable, finish: Callable, schema: str, bucket_bytes: int = 2 << 20, resolve_crowded: Callable | None = None
) -> DataFrame:
    """Of rows (doc_id, rid, text) and perhaps _rest, which is handed through.

    items(batches, groups, buckets) -> rows (bucket, kind, blob); resolve(blobs of kind 0) and resolve_crowded(blobs of kind 2) -> (ids, rids, start, end) covered;
    finish(ids, rids, texts, spans) -> columns of ``schema`` after doc_id.
    """
    spark, carry = docs.sparkSession, "_rest" in docs.columns
    if carry:
        schema += f", _rest {docs.schema['_rest'].dataType.simpleString()}"
    buckets, groups = fan_out(spark, total_bytes, bucket_bytes), fan_out(spark, total_bytes, 1 << 20)

    names = [x.split()[0] for x in schema.split(", _rest")[0].split(",")]

    def send(batches):
        rows, size = [], 0
        for row in items(batches, groups, buckets):
            rows.append(row)
            size += len(row[2])
            if size > 4 << 20 or len(rows) >= 5000:
                yield batch(_ROW, *map(list, zip(*rows)))
                rows, size = [], 0
        if rows:
            yield batch(_ROW, *map(list, zip(*rows)))

    def settle(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        blobs = [x.as_buffer() for x in t.column("blob")]
        own = resolve([b for b, k in zip(blobs, kinds) if k == 0])
        found = [_unpack_cover([b for b, k in zip(blobs, kinds) if k == 1]), own]
        if resolve_crowded:
            found.append(resolve_crowded([b for b, k in zip(blobs, kinds) if k == 2]))
        ids, rids, start, end = joined(*(np.concatenate([y.astype(x[0].dtype) for y in x]) for x in zip(*found)))
        groups_, out = [], []
        for g, p in by_key(rids % groups):
            groups_.append(int(g))
            out.append(_pack_cover(ids[p], rids[p], start[p], end[p]))
        return pa.table({"grp": pa.array(groups_, pa.int64()), "blob": pa.array(out, pa.binary())})

    def last(d: pa.Table, c: pa.Table) -> pa.Table:
        d = d.combine_chunks()
        cover = _unpack_cover([x.as_buffer() for x in c.column("blob")])
        order = np.lexsort((cover[1], cover[0]))
        ids, rids, start, end = (x[order] for x in cover)
        own = ids_of(d)
        # places of each row's stretches among the sorted ones
        key = np.zeros(len(ids), [("i", np.int64), ("r", np.int64)])
        key["i"], key["r"] = ids, rids
        want = np.zeros(len(own[0]), key.dtype)
        want["i"], want["r"] = own
        lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        texts = [x.as_py() or "" for x in d.column("text")]
        cols = [finish(t, start[a:b].astype(np.int64), end[a:b].astype(np.int64)) for t, a, b in zip(texts, lo, hi)]
        data = {"doc_id": d.column("doc_id")} | {n: [c[i] for c in cols] for i, n in enumerate(names[1:])}
        return pa.table(data | ({"_rest": d.column("_rest")} if carry else {}))

    covered = (
        docs.select("doc_id", "rid", "text").mapInArrow(send, "bucket long, kind byte, blob binary")
        .groupBy("bucket")
        .applyInArrow(settle, "grp long, blob binary")
    )
    grouped = docs.withColumn("grp", F.pmod("rid", F.lit(groups).cast("long")))
    return grouped.groupBy("grp").cogroup(covered.groupBy("grp")).applyInArrow(last, schema)


def mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places the stretches cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(end, n), -1)
    return np.cumsum(step[:-1]) > 0
