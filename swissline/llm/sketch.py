"""Count-min sketch over hashes of the corpus, merged from partition sketches.

Every task counts its hashes in two rows of cells and sends only the occupied
cells, sorted and delta-coded, by shard. Shards are merged on the executors;
what reaches the driver is one bit for each cell ("counted twice or more"), of
a size fixed before the run: 2 * 2**bits / 8 bytes, 128 MB at most, and one more
bit for every eight cells where crowds are asked for. A sketch that is too small
for its input estimates too many hashes as repeated and so filters less; it
never misses a repeated one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swissline.llm.common import batch, pack, parallelism, unpack

ROWS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
SHARD_BITS = 5
MOST_BITS = 29
_OUT = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])
_MERGED = pa.schema([*_OUT, ("crowds", pa.binary())])


def bits_for(expected: int) -> int:
    """Four cells for each expected hash, 2**16 to 2**29."""
    return min(MOST_BITS, max(16, int(4 * max(1, expected) - 1).bit_length()))


def _cells(h: np.ndarray, bits: int, row: int) -> np.ndarray:
    return ((h * ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _code(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as steps of a byte each, larger steps apart."""
    step = np.diff(cells, prepend=0)
    return pack(np.minimum(step, 255).astype(np.uint8), step[step >= 255].astype(np.uint32))


def _decode(blob: bytes) -> np.ndarray:
    small, large = unpack(blob, np.uint8, np.uint32)
    step = small.astype(np.int64)
    step[small == 255] = large
    return np.cumsum(step)


class Repeated:
    """Tells which hashes were counted often enough, by both rows of cells, and which very often."""

    def __init__(self, bits: int, rows: list[np.ndarray], crowds: np.ndarray):
        self.bits, self.rows, self.crowds = bits, rows, crowds

    def crowded(self, h: np.ndarray) -> np.ndarray:
        """Whether one of the eight cells around that of the hash was counted ``crowd`` times: the same answer in every task."""
        c = _cells(h, self.bits, 0) >> 3
        return (self.crowds[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for r, packed in enumerate(self.rows):
            c = _cells(h, self.bits, r)
            out &= (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
        return out


def repeated(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, least: int = 2, crowd: int = 0) -> Repeated:
    """Sketch what ``hashes`` yields for the batches of each partition of ``docs``; least: 1 or 2 counts; crowd: what counts as very often (0: nothing)."""
    shard_cells = bits - SHARD_BITS

    def build(batches):
        def flush(parts):
            h = np.concatenate(parts)
            for r in range(len(ROWS)):
                c = np.sort(_cells(h, bits, r))
                first = np.ones(len(c), bool)
                first[1:] = c[1:] != c[:-1]
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(c)))
                c = c[at]
                twice, times = c[times > 1], np.minimum(times[times > 1], 65535).astype(np.uint16)
                edges = np.arange((1 << SHARD_BITS) + 1) << shard_cells
                at, at2 = np.searchsorted(c, edges), np.searchsorted(twice, edges)
                shards, blobs = [], []
                for s in range(1 << SHARD_BITS):
                    if at[s] < at[s + 1]:
                        shards.append(s * len(ROWS) + r)
                        blobs.append(pack(np.frombuffer(one := _code(c[at[s] : at[s + 1]] - edges[s]), np.uint8), np.frombuffer(_code(twice[at2[s] : at2[s + 1]] - edges[s]), np.uint8), times[at2[s] : at2[s + 1]]))
                if shards:
                    yield batch(_OUT, shards, blobs)

        parts, n = [], 0
        for h in hashes(batches):
            if len(h):
                parts.append(h)
                n += len(h)
            if n >= 1 << 22:
                yield from flush(parts)
                parts, n = [], 0
        if parts:
            yield from flush(parts)

    most = np.uint16(max(2, crowd))

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1)):
                n = counts.setdefault(s, np.zeros(1 << shard_cells, np.uint16 if crowd > 255 else np.uint8))
                one, two, times = unpack(blob.as_buffer(), np.uint8, np.uint8, np.uint16)
                for c, more in ((_decode(one.tobytes()), np.uint16(1)), (_decode(two.tobytes()), np.minimum(times - np.uint16(1), most))):  # the first of the times is in ``one``
                    n[c] = np.minimum(n[c] + more, most)
        for s, n in counts.items():
            crowds = np.packbits((n >= crowd).reshape(-1, 8).any(1)).tobytes() if crowd and s % len(ROWS) == 0 else b""
            yield batch(_MERGED, [s], [np.packbits(n >= least).tobytes()], [crowds])

    merged = (
        docs.mapInArrow(build, "shard long, blob binary")
        .repartition(min(parallelism(docs.sparkSession), len(ROWS) << SHARD_BITS), "shard")
        .mapInArrow(merge, "shard long, blob binary, crowds binary")
    )
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in ROWS]
    width = (1 << shard_cells) // 8
    crowds = np.zeros((1 << bits) // 64 if crowd else 0, np.uint8)
    for s, blob, often in merged.collect():  # 2 * 2**bits / 8 bytes in all, and an eighth of a row for crowds
        i = s // len(ROWS)
        rows[s % len(ROWS)][i * width : (i + 1) * width] = np.frombuffer(blob, np.uint8)
        if often:
            crowds[i * width // 8 : (i + 1) * width // 8] = np.frombuffer(often, np.uint8)
    return Repeated(bits, rows, crowds)
