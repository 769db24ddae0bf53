"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns the columns of ``documents``; the last returns the pieces of the packed
sequences. Rows with a null doc_id, null texts and repeated rows go through like
any other, by the rules each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import materialize, parallelism, table
from swissline.llm.jaccard import similar_groups
from swissline.llm.lines import dedup_lines
from swissline.llm.mixing import in_queues, mix_sources, order_rates, written_order
from swissline.llm.packing import pack_documents
from swissline.llm.quality import judged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go."""
    return judged(docs).filter("_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; so does a document of which nothing is left."""
    out = dedup_lines(docs, carry=True).filter("n_removed = 0 or kept_text <> ''")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text"))}
    kept = {c: F.col("_rest")[c] for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    return out.select(*(F.coalesce(changed[c], kept[c]).alias(c) if c in changed else kept[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    gone = similar_groups(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mixture: files and rows within them go by position."""
    mixed = mix_sources(docs)
    return mixed.repartitionByRange(parallelism(spark), "mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences. The order in which the rows were written is that of the mixture: it is the order of each queue, and
    says how fast the queues empty."""
    import public_tokenizers

    ordered = written_order(docs)
    return pack_documents(in_queues(ordered), public_tokenizers.path("byte_bpe_50k.json"), rates=order_rates(ordered))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("source_mixing", mixing), ("packing", packing)]

#: None of the stages but the first can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
