"""Operators 11 to 13 against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swissline.llm import alignment, chat, negatives, packing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- 11
def plain_alignment(rows):
    """doc -> (n_a, n_b, groups, links), by positions of ends; and the counts of id pairs."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    ranks, _ = packing.byte_vocabulary(A)
    spelt = {i: w for w, i in ranks.items()}
    out, count = [], Counter()
    for doc, text in rows:
        row = (doc, 0, 0, "", [])
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [spelt[i] for i in a]
            b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                at_a = {int(e): k + 1 for k, e in enumerate(np.cumsum([len(x) for x in a_bytes]))}
                at_b = {int(e): k + 1 for k, e in enumerate(np.cumsum([len(x) for x in b_bytes]))}
                i = j = 0
                groups, links = [], []
                for end in sorted(at_a.keys() & at_b.keys()):
                    k, m = at_a[end], at_b[end]
                    groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                    links.append((a[k - 1], b[m - 1]))
                    i, j = k, m
                row = (doc, len(a), len(b), ";".join(groups), links)
                count.update(links)
        out.append(row)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(d, na, nb, len(ls), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha(g)) for d, na, nb, g, ls in out]


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "naïve café 数据 🙂🙂 ☃", "<s> </s> <|endoftext|> [INST]", "▁ under", "\x00 zero", "x" * 3000, " " * 5000 + "end", "\n" * 2500,
    "internationalisation of tokenisation, e.g. don't; 12345 67", "The same text. " * 400,
]


@pytest.mark.parametrize("most_pairs", [2_000_000, 0])
def test_op11_is_the_plain_alignment(spark, most_pairs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a"), (3, "a"), (7, "another text of an id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, link long, _row long").repartition(3)
    got = alignment.align(docs, A, B, most_pairs=most_pairs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignment(rows)))


def test_op11_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_op11_groups_join_to_both_token_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tokens = alignment.tokenised(docs, A, B)
    got = alignment.aligned(tokens.withColumn("doc_id", F.xxhash64("doc_id", "a_ids"))).join(tokens.withColumn("doc_id", F.xxhash64("doc_id", "a_ids")), "doc_id").collect()
    for r in got:
        sides = [x.split("|") for x in r.groups.split(";")] if r.groups else []
        assert [int(i) for a, _ in sides for i in a.split(",")] == r.a_ids and [int(i) for _, b in sides for i in b.split(",")] == r.b_ids
        assert len(sides) == r.n_groups == len(r.links)


def test_encoder_long_white_space_and_plain_specials():
    model = Tokenizer.from_file(A)
    model.encode_special_tokens = True
    encode = packing.encoder(A, special=False)
    for t in (" " * 300_000 + "x", "\n \t" * 100_000, "a <|endoftext|> b", "", "é" * 5000):
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids
    assert packing.encoder(A)("a <|endoftext|>")[-1] == 50256


# ---------------------------------------------------------------- 12
PARTS = st.lists(st.sampled_from(["<", ">", "[", "]", "/", "\\", "s", "s>", "<s>", "</s>", "[INST]", " [/INST]", "[SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "INST]", " ", "\n", "é", "🙂", "a"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[TEXT]", "</s>"]), PARTS), max_size=6))
def test_op12_template_is_read_back(turns):
    formatted = chat.marked([(chat.escape(r), chat.escape(t)) for r, t in turns])
    assert chat.read_turns(formatted) == (turns, "")


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_op12_escape_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[:2])
        said = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said)
    return out


def conversation_rows():
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice(["</s>", "[INST]", "<\\s>", " ", "wörd ", "🙂", "\n", "["]) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", None]), text()) for c in (1, 2, 3) for t in range(rnd.randint(1, 9))]
    rows += [(9, t, ("user", "assistant")[t % 2], text()) for t in range(700)]  # over more than one block
    rows += [(10, 5000 + 400 * t, "assistant", text()) for t in range(5)] + [(11, -3, "user", "below"), (11, 0, "assistant", "zero"), (11, None, "assistant", "last")]
    rows += [(None, 0, "user", None), (None, 1, "assistant", None), (12, 0, "assistant", "x" * 300_000)]
    rows += [(13, 0, "user", "again")] * 3 + [(14, 0, "assistant", "</s>[INST] ok [/INST]")]
    return rows


@pytest.mark.parametrize("block", [256, 4, None])
def test_op12_digests_are_those_of_the_table(spark, block):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, span long, tie long").repartition(5)
    formatted = chat.format_conversations(df, block=block)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == plain_digests(rows)
    assert formatted.filter("rewritten > 0 or not context_free").count() == 0


def test_op12_spans_are_the_rendering_whatever_the_blocks(spark):
    rows = [r for r in conversation_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for block in (3, 256, None):
        by = defaultdict(list)
        for r in chat.format_conversations(df, block=block).collect():
            by[r.conv_id].append(((r.turn is None, r.turn or 0, r.tie), r.span))
        found.append({c: "".join(s for _, s in sorted(x)) for c, x in by.items()})
    assert found[0] == found[1] == found[2]
    turns = [(chat.escape(r or ""), chat.escape(t or "")) for c, _, r, t in sorted((r for r in rows if r[0] == 9), key=lambda r: r[1])]
    assert found[0][9] == chat.marked(turns)


def test_op12_detects_rewritten_history_and_context():
    thinking = chat.Template(lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]}" for i, (r, t) in enumerate(turns)))
    got = list(chat.spans(thinking, [("user", "q"), ("assistant", "long thought|answer"), ("user", "next")], []))
    assert [s.rewritten for s in got] == [0, 0, len("long thought|answer")] and got[2].start is None
    numbered = chat.Template(lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns)))
    assert [s.context_free for s in chat.spans(numbered, [("user", "a"), ("user", "b"), ("user", "c")], [])] == [True, True, False]
    strip = chat.Template(lambda turns: "".join(f"<{r}>{t.strip()}" for r, t in turns))
    assert [s.start for s in chat.spans(strip, [("assistant", " a "), ("assistant", "b")], [])] == [None, len("<assistant>")]


def test_op12_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(df)).collect() == []


# ---------------------------------------------------------------- 13
def plain_negatives(rows, anchor, positives=5, negatives=3):
    """rows: (id, label, whole numbers)."""
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, (a, label, q) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(product(q, r[2]), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for p in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = sorted((s for s in scored if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:negatives]
            out += [(a, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(fit)]
    return sorted(map(str, out))


@pytest.mark.parametrize("size, blocks, span", [(8, (256, 8192), 20), (64, (3, 17), 300), (70, (16, 40), 3), (5, (4, 9), 2), (3, (256, 8192), 2**25)])
def test_op13_is_the_plain_search(spark, monkeypatch, size, blocks, span):
    """Few values, so that scores tie; shorter and empty vectors; repeated rows, ids and anchors; null ids."""
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "ROWS", blocks[1])
    rnd = random.Random(size)
    rows = [(i, rnd.randint(0, 3), [rnd.randint(-span, span) for _ in range(size)]) for i in range(260)]
    rows += [rows[10], rows[10], rows[50], (50, 1, rows[60][2]), (None, 1, rows[51][2]), (None, 2, rows[51][2]), (400, 9, [span] * size), (401, 2, []), (450, 1, [span] * (size - 1)), (500, 2, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, q array<long>, rid long, copies string").repartition(3)
    got = negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, rows_a_tile=64, anchors_a_tile=8).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_negatives(rows, lambda i: i is not None and i % 10 == 0)


def test_op13_leaves_out_what_is_not_a_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [nan, 1.0]), (4, 2, [1.0, -inf]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = negatives.whole_numbers(df)
    assert {r.vec_id for r in q.collect()} == {0, 1, 2}
    got = [tuple(r) for r in negatives.mine_negatives(q, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 256 + 128 * 64, 256 * 128 + 128 * 128)]
    assert negatives.mine_negatives(q.filter("false"), F.lit(True)).collect() == []


def test_op13_planes_add_up():
    rnd = np.random.default_rng(1)
    a, r = rnd.integers(-200, 200, (5, 70)), rnd.integers(-200, 200, (9, 70))
    pa, pr = negatives.Planes(a, 9), negatives.Planes(r, 9)
    ai, ri = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(9), indexing="ij"))
    assert (sum(pr.weight(k) * negatives.sliced(pa, ai, pr, ri, k) for k in range(9)) == (a @ r.T).ravel()).all()
