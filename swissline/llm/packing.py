"""Packing with deficit round-robin over source queues (operator 8).

Each source is a queue of tokens. Every window gives each source its quantum
(window size times its target share) and takes what its deficit counter allows;
what rounding leaves goes to the largest deficits, and deficits are carried to
the next window. Rates say how fast the queues empty against each other, so that
a mixture by rows can set the takes in tokens. Over a period of windows the takes are whole, so the schedule
repeats and every task can place its pieces from totals by task and source:
deficits carry over task boundaries as they do over windows. When a queue runs
dry its share goes to the others. What is less than a window at the very end
becomes sequences whose lengths are powers of two, filled by the same shares, so
nothing is padded. A source with a target of 0 comes after all others.

Texts are encoded once, with tiktoken over the vocabulary of the tokenizer file
(the same ids as tokenizers gives, which is the fallback), and kept as 16-bit
ids in the shared folder.

Defined cases: a null text is only its end id; a null source is a queue of its
own; repeated rows are packed each; a null doc_id is kept; columns other than
doc_id, text and source are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from swissline.llm.common import materialize, table
from swissline.llm.schedule import Phase, offsets, phases, quotas, source_key

_TOKENS = "doc_id long, _source string, _task int, _local long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Longer runs of white space go to tokenizers: tiktoken's pattern engine recurses over them and breaks off the process's stack.
_LONG_SPACE = re.compile(r"\s{2000}")


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], list[dict]]:
    """Bytes of each entry of a byte-level BPE file, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet of byte-level BPE: printable characters stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if not (word.startswith("<|") and word.endswith("|>"))}
    return ranks, spec.get("added_tokens") or []


def encoder(path: str, special: bool = True):
    """text -> uint32 ids, from a byte-level BPE file; the added tokens of the file take their ids wherever they stand in a text, or are plain text if not ``special``."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks, added = byte_vocabulary(path)
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = not special
    names = [t["content"] for t in added]
    # tokens that take in what is around them are left to tokenizers
    wide = [t["content"] for t in added if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]

    def encode(text: str) -> np.ndarray:
        if _LONG_SPACE.search(text) or special and any(x in text for x in wide):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if special and any(x in text for x in names):
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


def tokenized(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    rows = docs.select("doc_id", source_key().alias("_source"), "text")

    def run(batches):
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = [np.append(encode(t) if t else np.zeros(0, np.uint32), end_id).astype("<u2") for t in part.column("text").to_pylist()]
                sources, local = part.column("_source").to_pylist(), []
                for s, x in zip(sources, ids):
                    local.append(seen.get(s, 0))
                    seen[s] = local[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sources, pa.string()), pa.array([task] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "_source", "_task", "_local", "n", "ids"],
                )

    return materialize(rows.mapInArrow(run, _TOKENS), "tokens")


def deficit_table(window: int, least_period: int = 64):
    """Takes of one period of deficit round-robin."""

    def table_of(weights: np.ndarray) -> np.ndarray:
        period = max(least_period, 1 + int((weights > 0).sum()) * 8 // window)
        k = quotas(weights, window * period)
        given, takes = np.zeros(len(k), np.int64), []
        for j in range(1, period + 1):
            deficit = k * j / period - given
            take = np.floor(deficit + 1e-9).astype(np.int64)
            most = np.argsort(-(deficit - take), kind="stable")
            take[most[: window - int(take.sum())]] += 1
            given += take
            takes.append(take)
        return np.array(takes)

    return table_of


def plan(totals: dict, window: int, weights: dict | None, rates: dict | None = None) -> tuple[dict, list[Phase], list[tuple[np.ndarray, int]]]:
    """Number of each source, the phases, and for each short sequence at the end its takes and length."""
    names = sorted(totals)
    amount = np.array([totals[s] for s in names], np.int64)
    weight = amount.astype(float) if weights is None else np.array([weights.get(s[1:] if s[0] == "s" else None, 0.0) for s in names], float)
    if rates is not None:
        weight = amount * np.array([rates[s] for s in names])
    made, got, rounds = phases(amount, weight, window, deficit_table(window))
    while (rest := amount - got).sum():
        size = 1 << (int(rest.sum()).bit_length() - 1)
        share = np.where(rest > 0, weight, 0.0)
        share = share if share.any() else rest.astype(float)
        take, left = np.zeros(len(names), np.int64), size
        while left:  # by target shares; what a queue doesn't hold goes round the others
            open_ = np.where(rest > take, share, 0.0)
            part = quotas(open_ if open_.any() else (rest > take).astype(float), left) if left >= int((rest > take).sum()) else np.eye(len(names), dtype=np.int64)[np.argmax(np.where(rest > take, share, -1.0))]
            more = np.minimum(part, rest - take)
            take += more
            left -= int(more.sum())
        made.append(Phase(rounds, 1, got.copy(), np.vstack([np.zeros_like(take), take])))
        got, rounds = got + take, rounds + 1
    return {s: i for i, s in enumerate(names)}, made


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, weights: dict | None = None, rates: dict | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, source), queues in the order of the partitions and the rows in them.

    weights: target share of each source; None: as in ``docs``. rates: in their place, the part of each queue (by source key) that goes in a unit of time.
    """
    rows, totals = offsets(tokenized(docs, tokenizer, end_id), "n")
    number, made = plan(totals, window, weights, rates)
    # places of a source within a round: after the takes of the sources before it
    inner = [np.hstack([np.zeros((p.period, 1), np.int64), np.cumsum(np.diff(p.got, axis=0), 1)[:, :-1]]) for p in made]
    ends = np.array([p.base + p.all_before(p.rounds) for p in made]).reshape(len(made), len(number))

    def run(batches):
        for b in batches:
            out = []
            for doc, source, before, local, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_source", "_before", "_local", "n", "ids"))):
                s, at = number[source], before + local
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                done = 0
                k = int(np.searchsorted(ends[:, s], at, "right"))
                while done < n:
                    p = made[k]
                    unit = at + done - int(p.base[s])
                    j = int(p.round_of(s, unit))
                    stop = min(n, int(p.base[s] + p.before(s, j + 1)) - at)
                    out.append((doc, done, stop - done, zlib.crc32(ids[done:stop].tobytes()), n, p.first + j, int(inner[k][j % p.period, s]) + unit - int(p.before(s, j))))
                    done = stop
                    while k < len(made) and at + done >= ends[k, s]:
                        k += 1
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return rows.select("doc_id", "_source", "_before", "_local", "n", "ids").mapInArrow(run, _PIECES)


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [x.split()[0] for x in _PIECES.split(", ")])


def op8_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
