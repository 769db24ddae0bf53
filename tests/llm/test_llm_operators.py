"""Operators against brute force, on a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from swissline.llm import common, jaccard, language_model, lines, media, mixing, packing, quality, recurrent, substring, suffix, suffix_dedup, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, grp long, n_words long, kept boolean, _source string, score double"


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, block = text(70), "\n".join(text(6) for _ in range(12))
    rows = [(i, text(rnd.choice((3, 30, 120))) + rnd.choice((" ", "\n")) + (passage if i % 3 == 0 else "") + ("\n" + block if i % 5 == 0 else "")) for i in range(1, 40)]
    rows += [(100 + i, rows[5][1]) for i in range(6)]  # copies
    base = text(200).split()
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(i % 4 * 3):
            w[rnd.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "One"), (304, "ONE"), (305, "a b c d"), (306, "the " * 300), (307, text(9000)), (None, rows[2][1]), (None, None)]
    rows += [rows[7], rows[7]]  # repeated rows
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if n % 7 == 0 else f"s{n % 3}", 1, 2, 3, 4, True, "x", 0.5) for n, (i, t) in enumerate(ROWS)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def expected(result):
    out = {}
    for i, t in ROWS:
        out.setdefault(i, []).append(result[i, t])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(got[k]) == sorted(want[k]), k


def test_op3_windows(docs, empty):
    got = [(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in substring.dedup_windows(docs).collect()]
    same(by_id(got), expected(brute.windows(ROWS)))
    assert substring.dedup_windows(empty).count() == 0


def test_op7_strings(docs, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.dedup_bytes(docs).collect()]
    same(by_id(got), expected(brute.strings(ROWS)))
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    for crowd in (2, 6):  # all groups, and the larger ones, go by the hashes of their strings
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.dedup_bytes(docs, crowd=crowd).collect()]
        same(by_id(got), expected(brute.strings(ROWS)))


def test_suffix_sort_and_its_collision_path():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    start = np.arange(2800)
    s = suffix.Suffixes(text, start, np.full(2800, 40))
    (a, b), (c, d) = s.sort(start % 3), s._direct(start % 3)
    assert (a == c).all() and (b == d).all()
    raw = text.tobytes()
    assert [raw[i : i + 40] for i in a[start[a] % 3 == 1]] == sorted(raw[i : i + 40] for i in start[start % 3 == 1])


def ends(own, roll=2, divisor=4):
    """Boundaries of lines that aren't blank, from the hash of each alone."""
    h = np.array([common.mix(lines._BYTES.spans(lines._BYTES.prefix(x), np.zeros(1, int), np.array([len(x)])))[0] for x in (np.frombuffer(y.encode(), np.uint8) for y in own)], np.uint64)
    return lines.boundaries(h, np.zeros(len(h), int), roll, divisor)


def test_op6_chunks(docs, empty):
    want = {k: (n, gone, brute.sha(left)) for k, (n, gone, left) in brute.without_repeated_chunks(ROWS, ends).items()}
    got = [(r.doc_id, r.n_lines, r.n_removed, brute.sha(r.kept_text)) for r in lines.dedup_lines(docs).collect()]
    same(by_id(got), expected(want))
    assert sum(v[1] for v in want.values()) > 0
    assert lines.dedup_lines(empty).count() == 0
    assert set(lines.dedup_lines(docs, carry=True).select("_rest.*").columns) == set(docs.columns) - {"text"}


def test_op6_boundaries_survive_an_insertion():
    own = [f"line {i} of the text" for i in range(60)]

    def cut(x):
        raw = np.frombuffer("\n".join(x).encode(), np.uint8)
        return {"\n".join(x[a:b]) for a, b in zip(*lines._chunks(raw, np.array([0, len(raw)]), 2, 4)[2:4])}

    assert len(cut(own) & cut(own[:10] + ["new"] + own[10:])) >= len(cut(own)) - 6


def test_op5_figures(docs, empty):
    got = quality.judged(docs).select("doc_id", "_q.*", "_base_failed", "_kept").collect()
    want = {(i, t): brute.quality(t) for i, t in ROWS if t is None or len(t) < 5000}
    long_ = {i for i, t in ROWS if t and len(t) >= 5000}
    same(by_id([r[:8] for r in got if r[0] not in long_]), {i: v for i, v in by_id([(i, *want[i, t]) for i, t in ROWS if (i, t) in want]).items()})
    for r in got:
        assert r._base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r._base_failed and r._kept)
    assert quality.judged(empty).count() == 0


def test_op9_groups(docs, empty):
    got = jaccard.similar_groups(docs).collect()
    want = brute.groups(sorted({(i, t) for i, t in ROWS if i is not None}))
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert jaccard.similar_groups(empty).count() == 0
    small = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, tile=3).collect()}  # tiles cut into blocks
    assert small == {r.doc_id: r.component_id for r in got}


def test_op9_links_over_bands_and_blocks(spark):
    """Chains of texts, each at or just under the threshold from the next, of many sizes, all of common shingles."""
    rnd = random.Random(9)
    rows, k = [], 0
    for size in (9, 14, 29, 44, 104, 129, 204):
        for _ in range(6):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            for cut in (0, 0, 1, 2, size // 10, size // 5, size // 4):
                rows.append((k, " ".join(words[: size - cut])))
                k += 1
                rows.append((k, " ".join(words[cut:] + [f"x{i}" for i in range(cut // 2)])))
                k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.groups(rows)
    for tile in (2, 1024):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, tile=tile).collect()} == want


def test_op1_positions_and_deviation(docs, empty):
    got = mixing.mix_sources(docs, block=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(ROWS))) and set(docs.columns) <= set(got[0].asDict())
    assert mixing.mix_sources(empty).count() == 0
    for weights in ([0.9, 0.05, 0.03, 0.02], [0.5, 0.25, 0.25], list(np.random.default_rng(1).random(17) ** 3)):
        takes = mixing.pfair_table(1024)(np.array(weights))
        got = np.cumsum(takes, 0)
        assert (takes.sum(1) == 1).all() and np.abs(got - got[-1] / len(takes) * np.arange(1, len(takes) + 1)[:, None]).max() < 1


def test_op1_small_and_zero_targets(spark):
    rows = [(i, "a" if i < 20_000 else "b" if i < 20_300 else "c") for i in range(20_320)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(6)
    got = sorted(mixing.mix_sources(docs, {"a": 1.0, "b": 0.0004, "c": 0.0}, block=1).collect(), key=lambda r: r.mix_position)
    first = Counter(r.source for r in got[:18_000])
    assert [r.mix_position for r in got] == list(range(len(rows))) and abs(first["b"] - 18_000 * 0.0004) < 1.5 and not first["c"]
    assert {r.source for r in got[-20:]} == {"c"}  # no target: after all others


def test_op8_the_tail_keeps_the_shares():
    number, made = packing.plan({"sa": 70_000, "sb": 30_000}, 2048, {"a": 0.7, "b": 0.3})
    tail = [np.diff(p.got, axis=0)[0] for p in made if p.rounds == 1 and p.got[-1].sum() < 2048]
    assert tail and all(abs(t[0] - 0.7 * t.sum()) <= 2 for t in tail if t.sum() > 64) and sum(p.all_before(p.rounds).sum() for p in made) == 100_000


def test_op8_pieces(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack_documents(docs, path).collect()
    fill = Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values()) and sorted(fill) == list(range(len(fill)))
    want = Counter((i, len(ids := np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")), zlib.crc32(ids.tobytes())) for i, x in ROWS if i not in {r[0] for r in ROWS[-2:]} and i is not None)
    for (i, n, crc), _ in want.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        ids = np.array(t.encode(dict(ROWS)[i] or "", add_special_tokens=False).ids + [1], "<u4")
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == n
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == n for r in own)
    assert packing.pack_documents(empty, path).count() == 0


def test_op8_shares_are_kept_in_every_window():
    takes = packing.deficit_table(2048)(np.array([0.61, 0.3, 0.09]))
    assert (takes.sum(1) == 2048).all() and np.abs(np.cumsum(takes, 0) - np.outer(np.arange(1, len(takes) + 1), takes.sum(0) / len(takes))).max() < 2


def test_op10_round_trip(docs, empty, spark):
    for t in (None, "", "é" * 288, "x" * 577):
        p = media.payload_of(t)
        assert len(p) % 576 == 0 and p and media.decode_png(media.encode_png(p)) == p and p.startswith((t or "").encode())
    page = "<p>a &amp; b</p><figure><img src='media:" + "0" * 64 + "' alt='no'><figcaption>cap</figcaption></figure><p>c</p><img src='u.png' alt='alt'>"
    got = [(x["position"], x["kind"], x["text"], x["caption"]) for x in media.parse_page(page)]
    assert got == [(0, "text", "a & b", None), (1, "media", None, "cap"), (2, "text", "c", None), (3, "media", None, "alt")] and media.parse_page(None) == []
    kinds = lambda page: [(x["kind"], x["text"], x["caption"]) for x in media.parse_page(page)]
    img = "<img src='a.png'>"
    assert kinds(f"<figure>{img}<figcaption>cap</figure><p>one</p><p>two</p>") == [("media", None, "cap"), ("text", "one", None), ("text", "two", None)]
    assert kinds(f"<p>a</p><figure>{img}<figcaption>cap<p>one</p>") == [("text", "a", None), ("media", None, "cap"), ("text", "one", None)]
    assert kinds(f"<figure>before<figcaption><p>cap</p></figcaption>{img}</figure>after") == [("text", "before", None), ("media", None, "cap"), ("text", "after", None)]
    assert kinds("<figure><figcaption>no media</figcaption></figure><figcaption>loose") == [("text", "no media", None), ("text", "loose", None)]
    from pyspark.sql import functions as F

    pages = media.document_pages(docs).select(F.struct("doc_id", "n_bytes").alias("page"), "html")
    out = media.resolve(media.references(media.page_sequences(pages, "page"), "page"), media.document_media(docs)).collect()
    assert sorted((r.page.n_bytes, r.payload_sha256) for r in out) == sorted((len((t or "").encode()), brute.sha(media.payload_of(t))) for _, t in ROWS)
    assert media.document_pages(empty).count() == 0 and media.document_media(empty).count() == 0
    stored = {r.digest: bytes(r.media) for r in media.document_media(docs).collect()}
    for r in out:  # columns of the query from the stored bytes, read by another decoder
        x = stored[r.payload_sha256]
        at, data = 8, b""
        while at < len(x):
            n, kind = int.from_bytes(x[at : at + 4], "big"), x[at + 4 : at + 8]
            data += x[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += n + 12
        raw = zlib.decompress(data)
        payload = b"".join(raw[i + 1 : i + 577] for i in range(0, len(raw), 577))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(payload), brute.sha(payload), zlib.crc32(payload[-32:]), len(x), brute.sha(x))


def test_op2_features_are_those_of_a_plain_search():
    rnd = random.Random(4)
    weights = {" ab": 1.0, " ab ": 2.5, " abc": 1.5, " b": 0.3, " c a": 0.7, " bca ": 3.0}
    lexicon = toxicity.Lexicon(weights, ("ab c", "c ab", "b"), np.zeros(0))
    a = lexicon.automaton()
    for size in (0, 1, 5, 40, 3000):
        text = toxicity.fold(" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))) for _ in range(size)))
        spared = [(m.start(), m.start() + len(x) + 1) for x in lexicon.exceptions for m in re.finditer(f"(?= {x} )", text)]
        hits = []
        for at in range(len(text)):
            found = max((x for x in weights if text.startswith(x, at)), key=len, default=None)
            if found and not any(s <= at < e for s, e in spared):
                hits.append(weights[found])
        n = len(text.split())
        assert np.allclose(lexicon.features(a, text), [1, math.log1p(sum(hits)), 10 * sum(hits) / (n + 20), max(hits, default=0), math.log1p(len(hits))]), size


def test_op2_learns_and_folds(spark, docs, empty):
    assert toxicity.fold("1d1ot! Сlown, h4te") == " idiot clown hate "
    rnd = random.Random(1)
    plain = lambda: " ".join(rnd.choice(("table", "green", "walk", "river", "stone")) for _ in range(30))
    rows = [(i, plain() + (rnd.choice((" idiot", " 1d1ot", " ѕcum")) if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.learn(d, labels)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in held)
    none = toxicity.score(docs, toxicity.learn(docs, labels.limit(0)))
    assert none.count() == len(ROWS) and toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


def plain_log_probability(m, inputs, klass, within, bounds):
    """One document and one token at a time, in double precision."""
    out, k = [], m.hidden
    x, u, wc, bc, wi, bi = (getattr(m, n).astype(float) for n in ("x", "u", "wc", "bc", "wi", "bi"))
    softmax = lambda v: np.exp(v) / np.exp(v).sum()
    for a, b in zip(bounds[:-1], bounds[1:]):
        h = np.zeros(k)
        for i in range(a, b):
            v, g = x[inputs[i]], h @ u
            r, z = 1 / (1 + np.exp(-v[:k] - g[:k])), 1 / (1 + np.exp(-v[k : 2 * k] - g[k : 2 * k]))
            n = np.tanh(v[2 * k :] + r * g[2 * k :])
            h = (1 - z) * n + z * h
            p = np.log(softmax(h @ wc + bc)[klass[i]])
            if klass[i] < m.classes:
                own = slice(m.at[klass[i]], m.at[klass[i] + 1])
                p += np.log(softmax(wi[own] @ h + bi[own])[within[i]])
            out.append(p)
    return np.array(out)


def a_model(scale=0.5):
    rng = np.random.default_rng(0)
    m = recurrent.Model(10, np.array([0, 1, 8, 40]), 3, 4)
    m.view(rng.normal(0, scale, m.size))
    sizes = np.array([7, 5, 1, 90, 33])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    klass = rng.integers(0, 6, bounds[-1])
    within = np.array([rng.integers(0, [1, 7, 32, 1, 1, 1][k]) for k in klass])
    return m, (rng.integers(0, 10, bounds[-1]), klass, within, bounds)


def test_op4_log_probability_is_that_of_a_plain_loop():
    m, args = a_model()
    m.view(m.vector.astype(np.float32))
    want = plain_log_probability(m, *args)
    for width, window in ((256, 16), (2, 4), (1, 200)):
        assert np.abs(recurrent.log_probability(m, *args, width, window) - want).max() < 1e-4


def test_op4_gradients():
    m, args = a_model()
    trainer = recurrent.Trainer(m)
    trainer.g = m.like().view(np.zeros(m.size))
    p, f, _ = next(recurrent.windows(args[3], 5, 200))
    trainer._gradients(p, f, args[0], args[1].astype(np.int16), args[2], np.zeros((p.shape[1], 4)))
    got = trainer.g.vector.copy()
    for i in np.random.default_rng(1).integers(0, m.size, 60):
        up, down = [], []
        for e, out in ((1e-5, up), (-1e-5, down)):
            m.vector[i] += e
            out.append(-plain_log_probability(m, *args).sum())
            m.vector[i] -= e
        assert abs((up[0] - down[0]) / 2e-5 - got[i]) < 2e-3 * max(1, abs(got[i])), i


def test_op4_scores_do_not_depend_on_the_layout(spark):
    from swissline.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    found = []
    for n in (1, 8, 64):
        rows = language_model.score_documents(docs.repartition(n), trainer_tokens=20_000, least_short=256).collect()
        found.append({r.doc_id: r.score for r in rows})
    one = found[0]
    assert all(abs(f[i] - one[i]) < 1e-6 * abs(one[i]) for f in found[1:] for i in one)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_base_scores(docs, empty):
    got = language_model.score_documents(docs).collect()
    tokens = [(i, t, re.findall(brute.WORD, brute.lower(t)) + ["\n"]) for i, t in ROWS]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, _, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = by_id([(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, _, ws in tokens])
    same(by_id([(*r[:5], round(r.base_score, 6)) for r in got]), want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score_documents(empty).count() == 0
