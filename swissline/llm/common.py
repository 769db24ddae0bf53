"""Shared pieces of the text operators: shared storage, text slices, words, hashes, blobs.

Rows are identified by ``(doc_id, rid)`` with ``rid = xxhash64(doc_id, text)``:
repeated rows are one document, rows that share an id but not a text are
ordered by ``rid``, a null id sorts last.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- storage
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where none is set and Spark runs on this machine alone (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of ``text``: the only figure that sizes buckets and sketches."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, rid, text; all columns of the table as ``_rest`` if carried, else whatever else it holds is left out."""
    out = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), F.col("text")]
    return docs.select(*out, *([F.struct(*(c for c in docs.columns if c != "text")).alias("_rest")] if carry else []))


def fan_out(spark: SparkSession, total_bytes: int, per: int) -> int:
    """Number of buckets: one for ``per`` bytes of text, two for each partition at least; it grows with the input, so that no bucket does."""
    return int(max(2 * parallelism(spark), total_bytes // per))


# ---------------------------------------------------------------- slices of an Arrow batch
def slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, end row, bytes, offsets) of runs of rows of ``limit`` bytes or one row."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def runs(inside: np.ndarray, offs: np.ndarray):
    """Starts and ends of the runs of ``inside``, cut at row offsets, and runs before each row."""
    prev = np.zeros(len(inside), bool)
    prev[1:] = inside[:-1]
    prev[offs[:-1][offs[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(inside), bool)
    nxt[:-1] = inside[1:]
    last = offs[1:] - 1
    nxt[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray):
    return runs(~_WS[buf], offs)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from items before each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


# ---------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (public-domain splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Poly:
    """Prefix polynomial hashes modulo 2**64 with a fixed random odd base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5
        self.base &= (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 1 << 12)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: uint8 letters or uint64 numbers."""
        n = len(values)
        self.grow(n)
        out = np.zeros(n + 1, np.uint64)
        v = self.letters[values] if values.dtype == np.uint8 else values
        np.cumsum(v * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.grow(len(prefix))
        return (prefix[b] - prefix[a]) * self.down[a]

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of each of the ``n - k + 1`` runs of k values."""
        n = len(prefix) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        self.grow(n)
        return (prefix[k:] - prefix[: n - k + 1]) * self.down[: n - k + 1]


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values (doubling); length n - w + 1."""
    if len(x) < w:
        return x[:0]
    have, cur = 1, x
    while have * 2 <= w:
        cur = op(cur[:-have], cur[have:])
        have *= 2
    rest = w - have
    return op(cur[: len(x) - w + 1], cur[rest : rest + len(x) - w + 1]) if rest else cur


# ---------------------------------------------------------------- blobs
def pack(*arrays: np.ndarray) -> bytes:
    """A few arrays as one value; ``unpack`` needs their types."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for k, kind in zip(n, kinds):
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, int(k), at))
        at += int(k) * kind.itemsize
    return out


def unpack_all(blobs, *kinds) -> list[np.ndarray]:
    """The arrays of many blobs, each joined."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def by_key(key: np.ndarray, n: int | None = None):
    """(value, positions) of each distinct key, keys ascending, positions in input order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.diff(k)) + 1
    for part in np.split(order, cut):
        if len(part):
            yield key[part[0]], part


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def ids_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id with null as the largest, and rid."""
    ids = pc.fill_null(b.column("doc_id"), NULL_ID).to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), b.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
