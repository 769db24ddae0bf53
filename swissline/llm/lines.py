"""Line dedup on content-defined chunks of lines (operator 6).

A rolling hash over the hashes of the last ``roll`` lines makes a line a
boundary, but for one in ``divisor``; it depends on those lines alone, so an
inserted line shifts no later boundary. Every line begins a chunk that ends with
the next boundary, and ends one that begins with the last boundary before it:
what a passage holds up to its last boundary is covered by chunks that begin in
it, and what comes after its first by chunks that end in it, whatever stands
around. A passage without a boundary inside stays. Boundaries count within
``most`` lines; where none comes, the chunk has that many lines. Blank lines are
passed over, and belong to the chunk around them. Chunks (two lines or more)
that start earlier elsewhere (smaller doc_id, or earlier in the same document,
overlaps included) are removed, after their bytes were compared with the first
chunk of that hash.

Defined cases: null and empty texts have no lines; a line that repeats without
its neighbours and blank lines alone stay; very long texts are cut like others,
no chunk has more than ``most`` lines that aren't blank; of chunks that start in
the same place each is judged alone; repeated rows (same id, same text) count as
one document; a null doc_id comes after all others; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import _WS, Poly, by_key, keyed, mix, pack, slices, table, text_bytes, unpack_all
from swissline.llm.firsts import chunks, cover_rows, find_repeats, mask, same_bytes
from swissline.llm.sketch import bits_for, repeated

_BYTES, _LINES = Poly(601), Poly(602)
_ITEM = (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)


def boundaries(h: np.ndarray, row: np.ndarray, roll: int, divisor: int) -> np.ndarray:
    """Which lines are boundaries, from the hashes of lines that aren't blank and their rows. A divisor of 1 gives none."""
    rolling, scale = np.zeros(len(h), np.uint64), np.uint64(1)
    for back in range(roll):
        same = row[back:] == row[: len(row) - back]
        rolling[back:] += np.where(same, h[: len(h) - back], np.uint64(0)) * scale
        scale = np.uint64(int(scale) * 0x5851F42D4C957F2D & (1 << 64) - 1)
    return mix(rolling) % np.uint64(divisor) != 0


def _chunks(buf, offs, roll, divisor, most=16):
    """Of each chunk, by first line: hash, row, number of first line, end line, first byte, end byte."""
    empty = np.diff(offs) == 0
    breaks = np.flatnonzero(buf == 10)
    row_of_break = np.searchsorted(offs, breaks, "right") - 1
    rows = np.concatenate([np.flatnonzero(~empty), row_of_break])
    starts = np.concatenate([offs[:-1][~empty], breaks + 1])
    s = np.lexsort((starts, rows))
    rows, starts = rows[s], starts[s]
    if not len(rows):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5)
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.where(last, offs[rows + 1], np.append(starts[1:] - 1, 0))
    h = mix(_BYTES.spans(_BYTES.prefix(buf), starts, ends))
    first = np.ones(len(rows), bool)
    first[1:] = last[:-1]
    line = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    inked = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~_WS[buf], out=inked[1:])
    full = np.flatnonzero(inked[ends] > inked[starts])
    n, row = len(full), rows[full]
    cut, k = boundaries(h[full], row, roll, divisor), np.arange(n)
    ahead = np.ones(n, bool)  # whether the next line is of the same row
    ahead[-1:] = False
    ahead[:-1] = row[1:] == row[:-1]
    behind = np.append(False, ahead[:-1])[:n]
    # the ends of a row bound its chunks as well
    following = np.minimum.accumulate(np.where(cut | ~ahead, k, n)[::-1])[::-1]
    leading = np.maximum.accumulate(np.where(cut | ~behind, k, -1))
    begins, ends_at = k[ahead], k[behind]
    one = np.concatenate([begins, np.maximum(leading[ends_at - 1], ends_at - most + 1)])
    two = np.concatenate([np.minimum(following[begins + 1], begins + most - 1), ends_at])
    pairs = np.unique(one * (n + 1) + two)
    one, two = np.divmod(pairs, n + 1)
    at, to = full[one], full[two] + 1
    return mix(_LINES.spans(_LINES.prefix(h), at, to)), rows[at], line[at], line[at] + to - at, starts[at], ends[to - 1]


def dedup_lines(docs: DataFrame, roll: int = 2, divisor: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of each row of ``docs`` (doc_id, text); carry: also its other columns, in ``_rest``."""
    docs = keyed(docs, carry)
    total = text_bytes(docs)

    def hashes(batches):
        for b in batches:
            for _, _, buf, offs in slices(b.column("text")):
                yield _chunks(buf, offs, roll, divisor)[0]

    seen = docs.sparkSession.sparkContext.broadcast(repeated(docs, hashes, bits_for(total // 120)))

    def items(batches, groups, buckets):
        def work(row, byte, buf, offs):
            found = _chunks(buf, offs, roll, divisor)
            maybe = seen.value(found[0])
            h, r, a, b, at, to = (x[maybe] for x in found)
            return h, r + row, a, b, at + byte, to - at

        for chunk, parts in chunks(batches, work):
            h, row, a, b, place, size = (np.concatenate(x) for x in zip(*parts))
            late, keep = _settle(h, chunk.rank[row] << 32 | a, chunk.text, place, size)
            r = row[late]
            yield from cover_rows(chunk.ids[r], chunk.rids[r], a[late], b[late], groups, buckets)
            for bucket, p in by_key(h[keep] % np.uint64(buckets)):
                p = keep[p]
                at = np.arange(int(size[p].sum())) + np.repeat(place[p] - (np.cumsum(size[p]) - size[p]), size[p])
                u = np.uint32
                yield int(bucket), 0, pack(h[p], chunk.ids[row[p]], chunk.rids[row[p]], a[p].astype(u), b[p].astype(u), size[p].astype(u), chunk.text[at])

    def resolve(blobs):
        h, ids, rids, a, b, size, text = unpack_all(blobs, *_ITEM)
        size = size.astype(np.int64)
        s = np.lexsort((a, rids, ids))
        order = np.empty(len(s), np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (ids[s][1:] != ids[s][:-1]) | (rids[s][1:] != rids[s][:-1]) | (a[s][1:] != a[s][:-1])
        order[s] = np.cumsum(new)
        late, _ = _settle(h, order, text, np.cumsum(size) - size, size)
        return ids[late], rids[late], a[late], b[late]

    def finish(text, start, end):
        lines = text.split("\n") if text else []
        if not len(start):
            return len(lines), 0, text
        m = mask(len(lines), start, end)
        return len(lines), int(m.sum()), "\n".join(x for x, gone in zip(lines, m) if not gone)

    return find_repeats(docs, total, items, resolve, finish, "doc_id long, n_lines long, n_removed long, kept_text string", 4 << 20)


def _settle(h, order, text, place, size):
    """Items whose bytes come earlier in ``order``, and the first items of each kind."""
    left, late, firsts = np.arange(len(h)), [], []
    while len(left):  # again for those that share a hash with other bytes
        s = left[np.lexsort((order[left], h[left]))]
        new = np.ones(len(s), bool)
        new[1:] = h[s][1:] != h[s][:-1]
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = size[s] == size[first]
        same[same] = same_bytes(text, place[s[same]], place[first[same]], size[s[same]])
        late.append(s[same & (order[s] > order[first])])
        firsts.append(s[new])
        left = s[~same]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *late]), np.concatenate([none, *firsts])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
