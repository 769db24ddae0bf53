"""Inputs on which an operator once did less than the whole job."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from swissline.llm.common import materialize
from swissline.llm import lines, mixing, packing, recurrent


def planted_passages(n=30):
    """Passages of 2 to 10 lines, one after another's text and before another's, with and without blank lines inside."""
    rnd = random.Random(5)
    line = lambda: " ".join(str(rnd.random()) for _ in range(4))
    passages = [[line() for _ in range(k)] for k in range(2, 11) for _ in range(n)]
    passages += [[line(), "", line(), " ", "", line()] for _ in range(n)]
    rows, single = [], line()
    for i in range(3):
        for k, p in enumerate(passages):
            rows.append((1000 * i + k, "\n".join([*(line() for _ in range(rnd.randint(0, 5))), *p, line(), single, line()])))
    return passages, rows


def test_op6_short_passages_go_in_any_context(spark):
    """Nine tenths and more of the lines of repeated passages, and no line besides; without boundaries few of them."""
    passages, rows = planted_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    removed, planted = Counter(), Counter()
    for i, text in rows:
        p = passages[i % 1000]
        left = Counter(got[i].kept_text.split("\n"))
        gone = Counter(text.split("\n")) - left
        assert not gone - Counter(p) and not (i < 1000 and gone), i
        if i >= 1000:
            planted[len(p)] += len(p)
            removed[len(p)] += sum(gone.values())
    assert sum(removed.values()) >= 0.95 * sum(planted.values()), (removed, planted)
    assert removed[2] >= 0.6 * planted[2] and all(removed[k] >= 0.9 * planted[k] for k in planted if k > 2), (removed, planted)
    off = lines.dedup_lines(df, divisor=1).agg({"n_removed": "sum"}).first()[0]
    assert off < 0.5 * sum(removed.values())


def test_op6_runs_of_like_lines_stay_bounded():
    """Where no boundary comes, chunks have ``most`` lines."""
    raw = np.frombuffer("\n".join(["same"] * 5000 + ["x", "y"]).encode(), np.uint8)
    for divisor in (1, 4):
        _, _, a, b, _, _ = lines._chunks(raw, np.array([0, len(raw)]), 2, divisor)
        assert (b - a <= 16).all() and (b - a >= 2).all() and len(a) <= 2 * 5002


def test_pipeline_sequences_follow_the_mixture(spark):
    """Shares of sources in the first sequences, and which documents come first, are those of stage 4."""
    rnd = random.Random(6)
    rows = []
    for i in range(4000):
        source = "hot" if i % 10 else f"s{i // 10 % 3}"
        rows.append((i, " ".join(rnd.choice(("river", "stone", "walk", "green")) for _ in range(90 if source == "s0" else 40)), "en", source, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    source = {r[0]: r[3] for r in rows}
    place = {r.doc_id: r.mix_position for r in mixing.mix_sources(docs).collect()}
    written = materialize(corpus_pipeline.mixing(spark, docs, ""), "mixed")
    pieces = corpus_pipeline.packing(spark, written, "").collect()
    # without the stage before it the sequences are others
    other = corpus_pipeline.packing(spark, materialize(docs, "unmixed"), "").collect()
    key = lambda r: (r.sequence_id, r.offset)
    assert [r.doc_id for r in sorted(pieces, key=key)] != [r.doc_id for r in sorted(other, key=key)]
    plain = Counter()
    for r in other:
        plain[source[r.doc_id]] += r.length * (r.sequence_id < 12)
    assert plain["hot"] > 0.75 * sum(plain.values())
    size = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(size.values()) and len(size) == len(rows)
    first = [r for r in pieces if r.sequence_id < 12]
    got = Counter()
    for r in first:
        got[source[r.doc_id]] += r.length
    want, left = Counter(), sum(got.values())
    for i in sorted(place, key=place.get):
        want[source[i]] += (n := min(left, size[i]))
        left -= n
    assert all(abs(got[s] - want[s]) < 0.03 * sum(got.values()) for s in want), (got, want)
    assert got["hot"] < 0.75 * sum(got.values())  # nine tenths of the rows
    for s in want:  # each queue begins with the rows that the mixture places first
        n = len(own := {r.doc_id for r in first if source[r.doc_id] == s})
        assert own == set(sorted((i for i in place if source[i] == s), key=place.get)[:n])


def learned(sizes, monkeypatch):
    """How often each token of documents of these sizes gives a gradient."""
    m = recurrent.Model(8, np.array([0, 4, 36]), 2, 4)
    m.start(np.ones(4), np.ones(36))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rng, seen = np.random.default_rng(0), np.zeros(bounds[-1], int)
    gradients = recurrent.Trainer._gradients

    def watch(self, p, *others):
        np.add.at(seen, p[p >= 0], 1)
        return gradients(self, p, *others)

    monkeypatch.setattr(recurrent.Trainer, "_gradients", watch)
    before = m.vector.copy()
    done = recurrent.Trainer(m).fit(rng.integers(0, 8, bounds[-1]), rng.integers(0, 4, bounds[-1]), rng.integers(0, 4, bounds[-1]), bounds)
    assert done > 0 and (m.vector != before).any()
    return seen


def test_op4_every_window_is_learned_at_every_size(monkeypatch):
    assert (learned([5000] * 256, monkeypatch) == 1).all()  # 313 windows: once every third


def test_op4_few_and_very_long_documents_are_learned_whole(monkeypatch):
    for sizes in ([40], [3000], [7, 500, 1], [20000, *[30] * 200], [200] * 7):
        assert (learned(sizes, monkeypatch) == 1).all(), sizes
        monkeypatch.undo()


def test_op8_added_tokens_take_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = packing.encoder(path), Tokenizer.from_file(path)
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny <|endof", "é <|endoftext|>  it's", "none"):
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_op4_keeps_the_largest_id_and_null(spark):
    from swissline.llm import language_model

    rows = [(2**63 - 1, "a b"), (None, "a b"), (2**63 - 1, "c"), (None, None), (5, "a b a")] * 2
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, len((t or "").split()) + 1) for i, t in rows)


def test_buckets_grow_with_the_input(spark):
    from swissline.llm.common import fan_out

    for size in (1 << 30, 1 << 40, 100 << 40):
        assert size // fan_out(spark, size, 1 << 20) <= 1 << 20


def test_op4_gates_of_a_window_are_derived_in_place():
    """No array of a window's size is kept for the gates beside the states' own."""
    import tracemalloc

    rng = np.random.default_rng(5)
    m = recurrent.Model(8, np.array([0, 4]), 2, 24)
    m.start(np.ones(3), np.ones(4))
    n = 16 * 512
    bounds = np.arange(0, n + 1, 16)
    p, f, _ = next(recurrent.windows(bounds, 512, 16))
    args = rng.integers(0, 8, n), rng.integers(0, 3, n).astype(np.int16), rng.integers(0, 4, n), np.zeros((p.shape[1], 24), np.float32)
    trainer = recurrent.Trainer(m)
    tracemalloc.start()
    trainer._gradients(p, f, *args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 23.5 * 4 * 24 * p.size  # in arrays of the states' size; 24.7 with temporaries
