"""Suffix-array dedup of byte strings (operator 7).

Every string of ``length`` bytes is given to an anchor: the leftmost least hash
among its inner runs of ``gram`` bytes. Equal strings have equal anchors at
equal distances, so suffixes only have to be sorted inside an anchor's group.
A count-min sketch of anchors drops those that occur once. The others' strings
are sent by anchor hash, one copy from each chunk of a task, and buckets sort
them as suffixes (``suffix.Suffixes``): first whole contexts, then, where an
anchor has several, all their strings. Of equal strings, all but the earliest
are covered; equality is verified on bytes.

The group of an anchor that the sketch counts ``crowd`` times or more would be
too much for one task. Its strings are settled inside a chunk (bytes compared),
and the first of each goes to the bucket of its own 128-bit hash (two
polynomials), so that a bucket gets a string once from each chunk at most; there
equal hashes count as equal strings.

Defined cases: null text is empty; texts shorter than ``length`` keep
everything; matches never cross documents; repeated rows (same id, same text)
count as one document; a null doc_id comes after all others; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession

from swissline.llm.common import Poly, by_key, keyed, mix, pack, slices, table, text_bytes, unpack_all
from swissline.llm.firsts import chunks, cover_rows, find_repeats, inside, mask, minima, pack_runs, same_bytes, unpack_runs
from swissline.llm.sketch import bits_for, repeated
from swissline.llm.suffix import Suffixes

_BYTES, _OTHER = Poly(702), Poly(703)
_ITEM = (np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8)


def _anchors(buf, offs, length, gram):
    prefix = _BYTES.prefix(buf)
    n = len(buf)
    ok = inside(n, offs, length)
    if not len(ok):
        return prefix, ok, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = mix(_BYTES.grams(prefix, gram))
    low, at = minima(g, inside(n, offs, gram), ok, length - gram + 1)
    return prefix, ok, low, at, g[at]


def _contexts(buf, offs, length, gram, twice):
    """Of each anchor that may repeat: hash, place, first and last start of its strings."""
    prefix, ok, low, at, g = _anchors(buf, offs, length, gram)
    if not len(at):
        return None
    before = np.full(len(at), -1, np.int64)  # the anchor before with the same hash takes the strings that hold both
    same = np.flatnonzero(g[1:] == g[:-1]) + 1
    before[same] = at[same - 1]
    maybe = np.flatnonzero(twice(g))
    if not len(maybe):
        return None
    at, g, before = at[maybe], g[maybe], before[maybe]
    reach = length - gram
    x0, x1 = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for lo in range(0, len(at), 1 << 15):
        p = at[lo : lo + (1 << 15)]
        starts = p[:, None] + np.arange(-reach, 1)
        inn = (starts >= 0) & (starts < len(low))
        s = np.where(inn, starts, 0)
        mine = inn & ok[s] & (low[s] == g[lo : lo + (1 << 15), None]) & (starts > before[lo : lo + (1 << 15), None])
        any_ = mine.any(1)
        x0[lo : lo + (1 << 15)] = np.where(any_, p - reach + mine.argmax(1), 1)
        x1[lo : lo + (1 << 15)] = np.where(any_, p - mine[:, ::-1].argmax(1), 0)
    has = x0 <= x1
    at, g, x0, x1 = at[has], g[has], x0[has], x1[has]
    whole = mix(_BYTES.spans(prefix, x0, x1 + length) + mix(g + ((at - x0) << 8 | (x1 - x0)).astype(np.uint64)))
    return g, at, x0, x1, whole


def dedup_bytes(docs: DataFrame, length: int = 100, gram: int = 48, crowd: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of ``docs`` (doc_id, text). 100 <= length < 256 + gram."""
    docs = keyed(docs)
    total = text_bytes(docs)
    spacing = (length - gram + 2) // 2

    def hashes(batches):
        for b in batches:
            for _, _, buf, offs in slices(b.column("text")):
                yield _anchors(buf, offs, length, gram)[-1]

    seen = docs.sparkSession.sparkContext.broadcast(repeated(docs, hashes, bits_for(total // spacing), crowd=crowd))

    def items(batches, groups, buckets):
        def work(row, byte, buf, offs):
            found = _contexts(buf, offs, length, gram, seen.value)
            if found is None:
                return None
            g, at, x0, x1, whole = found
            doc = np.searchsorted(offs, x0, "right") - 1
            return g, x0 + byte, at - x0, x1 - x0, whole, doc + row, x0 - offs[doc]

        for chunk, parts in chunks(batches, work):
            parts = [p for p in parts if p]
            if not parts:
                continue
            g, place, back, more, whole, row, pos = (np.concatenate(x) for x in zip(*parts))
            order = chunk.rank[row] << 32 | pos
            s = np.lexsort((order, whole))
            new = np.ones(len(s), bool)
            new[1:] = whole[s][1:] != whole[s][:-1]
            first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
            late = np.flatnonzero(order[s] > order[first])
            a, b = s[late], first[late]
            alike = (g[a] == g[b]) & (back[a] == back[b]) & (more[a] == more[b])
            alike[alike] = same_bytes(chunk.text, place[a[alike]], place[b[alike]], more[a[alike]] + length)
            new[late[~alike]] = True  # a collision: an item of its own
            a = a[alike]
            yield from cover_rows(chunk.ids[row[a]], chunk.rids[row[a]], pos[a], pos[a] + more[a] + length, groups, buckets)
            keep = s[new]
            keep = keep[np.argsort(order[keep])]
            many = seen.value.crowded(g[keep])
            for lo in range(0, int(many.sum()), 20_000):
                yield from crowded_strings(chunk, *(x[keep[many][lo : lo + 20_000]] for x in (row, pos, place, more)), groups, buckets)
            keep = keep[~many]
            for bucket, p in by_key((g[keep] >> np.uint64(20)) % np.uint64(buckets)):
                p = keep[p]
                size = more[p] + length
                at = np.arange(int(size.sum())) + np.repeat(place[p] - (np.cumsum(size) - size), size)
                yield int(bucket), 0, pack(
                    g[p], chunk.ids[row[p]], chunk.rids[row[p]], pos[p].astype(np.uint32), back[p].astype(np.uint8), more[p].astype(np.uint8), chunk.text[at]
                )

    def crowded_strings(chunk, row, pos, place, more, groups, buckets):
        """Settles the strings of some contexts among each other; the first of each goes on."""
        size = more + length
        start = np.cumsum(size) - size
        text = chunk.text[np.arange(int(size.sum())) + np.repeat(place - start, size)]
        n = more + 1
        item = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        at = start[item] + shift
        one, two = (mix(poly.spans(poly.prefix(text), at, at + length)) for poly in (_BYTES, _OTHER))
        row, pos = row[item], pos[item] + shift
        order = chunk.rank[row] << 32 | pos
        s = np.lexsort((order, two, one))
        new = np.ones(len(s), bool)
        new[1:] = (one[s][1:] != one[s][:-1]) | (two[s][1:] != two[s][:-1])
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = order[s] > order[first]
        alike = same_bytes(text, at[s[late]], at[first[late]], np.full(int(late.sum()), length))
        a = s[late][alike]
        yield from cover_rows(chunk.ids[row[a]], chunk.rids[row[a]], pos[a], pos[a] + length, groups, buckets)
        new[np.flatnonzero(late)[~alike]] = True
        keep = np.sort(s[new])
        for bucket, p in by_key((one[keep] >> np.uint64(20)) % np.uint64(buckets)):
            p = keep[p]
            yield int(bucket), 2, pack_runs(chunk.ids[row[p]], chunk.rids[row[p]], pos[p].astype(np.uint32), one[p], two[p])

    def resolve_crowded(blobs):
        ids, rids, pos, one, two = unpack_runs(blobs, np.uint32, np.uint64, np.uint64)
        s = np.lexsort((pos, rids, ids, two, one))
        new = np.ones(len(s), bool)
        new[1:] = (one[s][1:] != one[s][:-1]) | (two[s][1:] != two[s][:-1])
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = s[(ids[s] != ids[first]) | (rids[s] != rids[first]) | (pos[s] != pos[first])]
        return ids[late], rids[late], pos[late].astype(np.int64), pos[late].astype(np.int64) + length

    def resolve(blobs):
        g, ids, rids, pos, back, more, text = unpack_all(blobs, *_ITEM)
        back, more, pos = (x.astype(np.int64) for x in (back, more, pos))
        place = np.cumsum(more + length) - (more + length)
        # earliest first, so that equal suffixes stay in that order
        s = np.lexsort((pos, rids, ids))
        g, ids, rids, pos, back, more, place = (x[s] for x in (g, ids, rids, pos, back, more, place))
        _, kind = np.unique(g, return_inverse=True)
        whole = Suffixes(text, place, more + length)
        order, eq = whole.sort(kind << 16 | back << 8 | more)
        # equal contexts: only the first goes on; one document's repeated row is no repeat
        head = order[np.maximum.accumulate(np.where(eq, 0, np.arange(len(order))))] if len(order) else order
        itself = (ids[order] == ids[head]) & (rids[order] == rids[head]) & (pos[order] == pos[head])
        late = order[eq & ~itself]
        out = [(ids[late], rids[late], pos[late], pos[late] + more[late] + length)]
        lead = np.sort(order[~eq])
        several = np.bincount(kind[lead], minlength=len(g) and int(kind.max()) + 1)[kind[lead]] > 1
        lead = lead[several]
        step = 400_000  # strings at a time, whole groups
        lead = lead[np.argsort(kind[lead], kind="stable")]
        strings = np.cumsum(more[lead] + 1)
        lo = 0
        while lo < len(lead):
            hi = int(np.searchsorted(strings, (strings[lo - 1] if lo else 0) + step, "right"))
            hi = max(hi, lo + 1)
            while hi < len(lead) and kind[lead[hi]] == kind[lead[hi - 1]]:
                hi += 1
            part = lead[lo:hi]
            n = more[part] + 1
            item = np.repeat(part, n)
            shift = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            every = Suffixes(text, place[item] + shift, np.full(len(item), length))
            order, eq = every.sort(kind[item] << 8 | (back[item] - shift))
            late = order[eq]
            out.append((ids[item[late]], rids[item[late]], pos[item[late]] + shift[late], pos[item[late]] + shift[late] + length))
            lo = hi
        ids, rids, start, end = (np.concatenate(x) for x in zip(*out))
        return ids, rids, start, end

    def finish(text, start, end):
        raw = text.encode()
        if not len(start):
            return len(raw), 0, 0, raw
        m = mask(len(raw), start, end)
        edge = np.diff(m.astype(np.int8), prepend=0)
        return len(raw), int(m.sum()), int((edge == 1).sum()), np.frombuffer(raw, np.uint8)[~m].tobytes()

    return find_repeats(docs, total, items, resolve, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", 1 << 20, resolve_crowded)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
