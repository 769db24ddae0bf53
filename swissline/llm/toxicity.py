"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 2).

Texts are folded first: lower case, homoglyphs and digit substitutions to the
letters they stand for, zero-width characters away, punctuation to spaces. The
lexicon holds all whole words and word beginnings that are sure to tell, with
their log odds, learned from at most ``most_labelled`` labelled rows (those with
the least hash of doc_id, held-out rows left out). At each word only the longest entry counts, and none
inside an exception phrase: given ones, and pairs of words learned as harmless.
The sum of weights, its share of the text's length, the largest weight and the
number of matches give a score by a logistic fit on the same rows.

Defined cases: null and empty texts have no matches and get the score of none;
without labels of both kinds the score is 0; repeated rows are scored each; a
null doc_id counts as the text "" for held_out; of labels that differ for one id
the larger counts; of terms that are equally sure the first in the alphabet is
kept; very long texts are scored whole; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import materialize, table

# fixed values: letters that look like Latin ones, and what stands for letters
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмнтвαεορτυνκιη", "aeopcyxijsdhlkmhtbaeoptuvkin"))
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
ZERO_WIDTH = "​‌‍⁠﻿­"
EXCEPTIONS = ("clown fish", "class clown", "stupid question", "trash can", "trash bin", "trash collection", "idiot proof")
_PUNCTUATION = "\t\n\x0b\x0c\r\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»„“”‘’…–—¿¡"
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {c: " " for c in _PUNCTUATION} | {c: None for c in ZERO_WIDTH})
_MARKS_AFTER_WORD = re.compile(r"(?<=\w)[!$@]+(?=\s|$|[^\w!$@])")
BEGINNINGS = range(3, 8)


def fold(text: str | None) -> str:
    """" word word " with one space between words and at both ends."""
    text = (text or "").lower()
    if "!" in text or "$" in text or "@" in text:
        text = _MARKS_AFTER_WORD.sub(" ", text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def is_held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...], fit: np.ndarray):
        self.weights, self.exceptions, self.fit = weights, exceptions, fit

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a

    def features(self, a, folded: str) -> list[float]:
        best, spared = {}, []
        if len(a):
            for end, (size, w) in a.iter(folded):
                at = end - size + 1
                if w is None:
                    spared.append((at, end))
                elif size > best.get(at, (0, 0))[0]:
                    best[at] = size, w
        if spared:  # ends ascend; of overlapping phrases the reach counts
            starts, reach = zip(*sorted(spared))
            reach = list(accumulate(reach, max))
            hits = [w for at, (_, w) in best.items() if not ((k := bisect_right(starts, at)) and at < reach[k - 1])]
        else:
            hits = [w for _, w in best.values()]
        n = folded.count(" ") - 1
        total = sum(hits)
        return [1.0, np.log1p(total), 10 * total / (n + 20), max(hits, default=0.0), np.log1p(len(hits))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and fit from labelled rows that are not held out. All that reaches the driver is bounded by that limit: terms and phrases come from so many texts."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    rows = materialize(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic"), "labelled")  # read four times
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon({}, exceptions, np.zeros(0))

    def terms(batches):
        counts = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts]), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "n"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set()
                for w in set(fold(text).split()):
                    own.add(f" {w} ")
                    own.update(" " + w[:k] for k in BEGINNINGS if k < len(w))
                counts.update((t, y) for t in own)
            if len(counts) > 500_000:
                yield flush()
                counts = Counter()
        if counts:
            yield flush()

    odds = (
        rows.mapInArrow(terms, "term string, toxic int, n long").groupBy("term")
        .agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("b"))
        .withColumn("w", F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1)))
        .withColumn("sure", F.col("w") - 2.5 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
        .filter("a >= 3 and sure > 0.5").orderBy("term")
    )
    weights = {r.term: float(r.w) for r in odds.collect()}

    def pairs(batches):
        a = Lexicon(weights, (), np.zeros(0)).automaton()
        for b in batches:
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, folded = set(), fold(text)
                for end, (size, _) in a.iter(folded) if len(a) else ():
                    at = end - size + 1
                    before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
                    stop = folded.find(" ", at + 1)
                    after = folded[stop + 1 : max(stop, folded.find(" ", stop + 1))]
                    word = folded[at + 1 : stop]
                    own |= {x for x in (f"{before} {word}", f"{word} {after}") if x[0] != " " and x[-1] != " "}
                out += [(x, y) for x in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out], pa.int32())], ["phrase", "toxic"])

    harmless = rows.mapInArrow(pairs, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.count("toxic").alias("n")).filter("n >= 8 and a * 20 < n")
    learned = tuple(r[0] for r in harmless.orderBy(F.desc("n"), "phrase").collect())
    lexicon = Lexicon(weights, tuple(dict.fromkeys(exceptions + learned)), np.zeros(0))

    def measure(batches):
        a = lexicon.automaton()
        for b in batches:
            x = [lexicon.features(a, fold(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    data = rows.select("text", F.col("toxic").cast("int")).mapInArrow(measure, "x array<double>, y int").collect()
    lexicon.fit = _logistic(np.array([r[0] for r in data]), np.array([r[1] for r in data], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches of each row of ``docs``."""

    def run(batches):
        a = lexicon.automaton()
        for b in batches:
            x = np.array([lexicon.features(a, fold(t.as_py())) for t in b.column(2)]).reshape(b.num_rows, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ lexicon.fit, -30, 30))) if len(lexicon.fit) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "n_matches"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_matches long")


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
