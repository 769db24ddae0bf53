"""The pipeline's rows against plain versions of its stages."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from test_llm_operators import ends  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from swissline.llm.common import materialize

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    for s in stages[:-1]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_documents(stages):
    kept = set(rows(stages[1]))
    for i, t in rows(stages[0]):
        n, _, _, _, again, covered, longest = brute.quality(t) if len(t or "") < 3000 else (None,) * 7
        if n is not None:
            fine = n >= 50 and 100 * again <= 50 * n and covered <= 0.3 * n and not (longest > 40 and longest > 0.1 * n)
            assert fine == ((i, t) in kept), i


def test_lines_near_duplicates_and_mixing(stages):
    want = {k[0]: left for k, (_, gone, left) in brute.without_repeated_chunks(rows(stages[1]), ends).items() if left or not gone}
    assert dict(rows(stages[2])) == want
    groups = brute.groups(rows(stages[2]))
    assert sorted(rows(stages[3])) == sorted((i, t) for i, t in rows(stages[2]) if groups[i][1] == i)
    assert sorted(rows(stages[4])) == sorted(rows(stages[3]))
    assert stages[4].agg({"n_chars": "sum"}).first()[0] == sum(len(t) for _, t in rows(stages[4]))


def test_packing_covers_all(stages, spark):
    import public_tokenizers
    from swissline.llm.packing import encoder

    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(encode(t)) + 1 for _, t in rows(stages[4]))
    assert stages[5].agg({"length": "sum"}).first()[0] == total
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
