"""Cross-tokenizer alignment (operator 11).

Texts are tokenised once by two tokenizers, which gives for each the ids and the
byte offsets where tokens end. All else is Spark: ``array_intersect`` of the two
arrays of ends gives the offsets where both end; sorting an array of ends with
the shared ones put in once more makes these neighbours, and their places give
the number of tokens before each cut. From the cuts ``transform`` over a
``sequence`` and ``zip_with`` build the groups, and ``zip_with`` the links (the last token of
either side of a group: tokens aren't empty, so no others end together).
``aggregate`` isn't needed: with growing arrays it would copy them at each step.

Links are kept as one number (A's id times 2**16 plus B's) in an intermediate
table. Counts of id pairs are one aggregation; they are looked up by a broadcast
while there are at most ``most_pairs`` of them, and beyond that by a join with
each pair salted, as a frequent pair may hold a large part of all links.

Defined cases: null and empty texts, and texts whose tokens don't spell them,
have no tokens (zeros and an empty digest); repeated rows count each; a null
doc_id is kept; very long texts are one row of arrays; ties for the best pair
are all best; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import materialize, table
from swissline.llm.packing import byte_vocabulary, encoder

TOKENS = "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
SALTS = 64


# ---------------------------------------------------------------- tokenising
def byte_side(path: str):
    """text -> ids of space and text, with the number of bytes of each entry. Every byte has an entry and none is changed, so entries spell
    the text if they have as many bytes."""
    ranks, _ = byte_vocabulary(path)
    encode = encoder(path, special=False)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, i in ranks.items():
        size[i] = len(word)

    def run(text: str):
        ids = encode(" " + text)
        return ids, size[ids]

    return run


def piece_side(path: str):
    """text -> ids of the text, a space before it, with the number of bytes of each piece, and their bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelt = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    size = np.array([len(x) for x in spelt], np.int64)

    def run(text: str):
        ids = model.encode(text, num_threads=1)
        return np.array(ids, np.int64), size[ids], b"".join([spelt[i] for i in ids])

    return run


def tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Ids and ends of both tokenizers; empty arrays where a text has no tokens."""

    def run(batches):
        a_side, b_side = byte_side(a_path), piece_side(b_path)

        def columns(docs_, rows):
            out = [docs_]
            for k in range(4):
                parts = [r[k] for r in rows]
                offs = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))))
            return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in TOKENS.split(", ")])

        none = (np.zeros(0, np.int32),) * 4
        for b in batches:
            rows, lo, size = [], 0, 0
            for at, text in enumerate(b.column("text").to_pylist()):
                row = none
                if text:
                    want = b" " + text.encode()
                    a_ids, a_size = a_side(text)
                    b_ids, b_size, b_bytes = b_side(text)
                    a_ends = np.cumsum(a_size)
                    if b_bytes == want and a_ends[-1] == len(want):
                        row = a_ids, a_ends, b_ids, np.cumsum(b_size)
                    size += len(want)
                rows.append(row)
                if size > 1 << 20:
                    yield columns(b.column("doc_id").slice(lo, at + 1 - lo), rows)
                    rows, lo, size = [], at + 1, 0
            yield columns(b.column("doc_id").slice(lo, b.num_rows - lo), rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


# ---------------------------------------------------------------- groups and links
def _cuts(merged: str) -> Column:
    """-1, then the places (from 0) of the shared ends among the ends of one side. merged: that side's ends with the shared ones once more, in order."""
    here = F.col(merged)
    twice = F.filter(F.sequence(F.lit(0), F.size(here) - 2), lambda i: F.get(here, i) == F.get(here, i + 1))
    places = F.when(F.size(here) > 1, F.transform(twice, lambda i, k: i - k)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(-1)), places)


def aligned(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (text), links. Each step is a column of its own, so nothing is computed for every element again."""
    both = tokens.withColumn("_shared", F.array_intersect("a_ends", "b_ends"))
    merged = both.withColumns({"_ma": F.sort_array(F.concat("a_ends", "_shared")), "_mb": F.sort_array(F.concat("b_ends", "_shared"))})
    cut = merged.withColumns({"_ca": _cuts("_ma"), "_cb": _cuts("_mb")})

    own = lambda cuts, ids: F.transform(F.slice(cuts, 2, F.size("_shared")), lambda i: F.get(ids, i))
    last = cut.withColumns({"_la": own("_ca", "a_ids"), "_lb": own("_cb", "b_ids")})  # the last ids of each group
    single = F.zip_with(F.col("_la").cast("array<string>"), F.col("_lb").cast("array<string>"), lambda x, y: F.concat(x, F.lit("|"), y))

    def run_of(ids: str, cuts: str, k: Column) -> Column:
        """Ids of group k (from 0), joined by commas."""
        return F.array_join(F.slice(ids, F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k)).cast("array<string>"), ",")

    def group(text: Column, k: Column) -> Column:
        """Most groups are one token on either side."""
        alone = F.get("_ca", k + 1) - F.get("_ca", k) + F.get("_cb", k + 1) - F.get("_cb", k) == 2
        return F.when(alone, text).otherwise(F.concat(run_of("a_ids", "_ca", k), F.lit("|"), run_of("b_ids", "_cb", k)))

    groups = F.array_join(F.transform(single, group), ";")
    links = F.zip_with("_la", "_lb", lambda i, j: i.cast("long") * 65536 + j)
    size = lambda c: F.size(c).cast("long")
    return last.select("doc_id", size("a_ids").alias("n_a"), size("b_ids").alias("n_b"), size("_shared").alias("n_groups"), size("_shared").alias("n_links"), groups.alias("groups"), links.alias("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """link, n (links that hold the pair), best (no pair of its B id has more)."""
    counts = links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    most = counts.groupBy((F.col("link") % 65536).alias("_b")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_b", F.col("link") % 65536).join(most, "_b").select("link", "n", (F.col("n") == F.col("_most")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = 2_000_000) -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, how its links count in all of ``docs``, and the digest of its groups."""
    found = aligned(tokenised(docs, a_path, b_path))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = materialize(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "links")
    counts = materialize(pair_counts(kept), "pairs")
    own = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = kept.select(*own, F.explode_outer("links").alias("link"))
    if counts.count() <= most_pairs:
        met = each.join(F.broadcast(counts), "link", "left")
    else:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")
        met = each.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("long")).join(counts.select("*", salt), ["link", "_salt"], "left")
    sums = met.groupBy(*own).agg(F.coalesce(F.sum("best"), F.lit(0)).cast("long").alias("n_best"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count_sum"))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
