"""Substring dedup on word windows with a count-min prefilter (operator 3).

A window is ``window`` consecutive words. Its signature is the least hash among
its inner runs of ``gram`` words; equal windows at different places have their
signature at different places, so the number of places with a signature bounds
the number of equal windows from above. Partition sketches of these places are
merged into one count-min sketch; windows whose signature it estimates at one
occurrence cannot repeat and are dropped. A second pass groups all other
windows exactly, by two independent 64-bit hashes of their words (128 bits).

Defined cases: null and empty texts have no words; documents shorter than a
window keep everything; repeated rows (same id, same text) count as one
document; a null doc_id comes after all others; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from swissline.llm.common import Poly, by_key, keyed, mix, rows_of, slices, table, text_bytes, words
from swissline.llm.firsts import chunks, cover_rows, find_repeats, inside, mask, minima, pack_runs, unpack_runs
from swissline.llm.sketch import bits_for, repeated

_LETTERS, _WORDS, _LETTERS2, _WORDS2 = (Poly(s) for s in (301, 302, 303, 304))
_ITEM = (np.uint64, np.uint64, np.uint32)


def _signatures(buf, offs, window, gram):
    starts, ends, bounds = words(buf, offs)
    h = mix(_LETTERS.spans(_LETTERS.prefix(buf), starts, ends))
    prefix = _WORDS.prefix(h)
    n = len(h)
    ok = inside(n, bounds, window)
    if not len(ok):
        return starts, ends, bounds, prefix, ok, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = mix(_WORDS.grams(prefix, gram))
    low, at = minima(g, inside(n, bounds, gram), ok, window - gram + 1)
    return starts, ends, bounds, prefix, ok, low, g[at]


def _firsts(f1, f2, order):
    """Positions sorted by hashes and order, and the place among them of the first of each one's kind."""
    s = np.lexsort((order, f2, f1))
    new = np.ones(len(s), bool)
    new[1:] = (f1[s][1:] != f1[s][:-1]) | (f2[s][1:] != f2[s][:-1])
    return s, new, s[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(s) else s


def dedup_windows(docs: DataFrame, window: int = 20, gram: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row of ``docs`` (doc_id, text)."""
    docs = keyed(docs)
    total = text_bytes(docs)

    def hashes(batches):
        for b in batches:
            for _, _, buf, offs in slices(b.column("text")):
                yield _signatures(buf, offs, window, gram)[-1]

    twice = repeated(docs, hashes, bits_for(total * 2 // (6 * (window - gram + 2))))
    seen = docs.sparkSession.sparkContext.broadcast(twice)

    def items(batches, groups, buckets):
        def work(row, byte, buf, offs):
            starts, ends, bounds, prefix, ok, low, _ = _signatures(buf, offs, window, gram)
            if not len(low):
                return None
            change = np.ones(len(low), bool)
            change[1:] = low[1:] != low[:-1]
            at = np.flatnonzero(ok & np.repeat(seen.value(low[change]), np.diff(np.append(np.flatnonzero(change), len(low)))))
            if not len(at):
                return None
            doc = rows_of(bounds)
            second = _WORDS2.prefix(mix(_LETTERS2.spans(_LETTERS2.prefix(buf), starts, ends)))
            f1, f2 = (mix(p.spans(x, at, at + window)) for p, x in ((_WORDS, prefix), (_WORDS2, second)))
            return f1, f2, (doc[at] + row).astype(np.int64), (at - bounds[doc[at]]).astype(np.int64)

        for chunk, parts in chunks(batches, work):
            parts = [p for p in parts if p]
            if not parts:
                continue
            f1, f2, row, pos = (np.concatenate(x) for x in zip(*parts))
            _, _, first = found = _firsts(f1, f2, order := chunk.rank[row] << 32 | pos)
            s, new, _ = found
            late = order[s] > order[first]
            r = row[s[late]]
            yield from cover_rows(chunk.ids[r], chunk.rids[r], pos[s[late]], pos[s[late]] + window, groups, buckets)
            keep = np.sort(s[new])
            for bucket, p in by_key((f1[keep] >> np.uint64(20)) % np.uint64(buckets)):
                p = keep[p]
                yield int(bucket), 0, pack_runs(chunk.ids[row[p]], chunk.rids[row[p]], f1[p], f2[p], pos[p].astype(np.uint32))

    def resolve(blobs):
        ids, rids, f1, f2, pos = unpack_runs(blobs, *_ITEM)
        s = np.lexsort((pos, rids, ids))
        order = np.empty(len(s), np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (ids[s][1:] != ids[s][:-1]) | (rids[s][1:] != rids[s][:-1]) | (pos[s][1:] != pos[s][:-1])
        order[s] = np.cumsum(new)
        s, _, first = _firsts(f1, f2, order)
        late = s[order[s] > order[first]]
        return ids[late], rids[late], pos[late], pos[late] + np.uint32(window)

    def finish(text, start, end):
        w = text.encode().split()
        removed = 0
        kept = w
        if len(start):
            m = mask(len(w), start, end)
            removed = int(m.sum())
            kept = list(compress(w, ~m))
        return len(w), removed, b" ".join(kept).decode()

    return find_repeats(docs, total, items, resolve, finish, "doc_id long, n_words long, n_removed long, kept_text string", 8 << 20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
