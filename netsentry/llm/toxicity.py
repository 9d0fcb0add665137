"""Toxicity by the nearest labelled examples.

Examples: at most ``PER_CLASS`` labelled texts of each class, the first by the
hash of their id (a documented bound; learning rows only). Of examples with the
same least shingle key (copies, mostly) one stays, or copied texts would make
terms of their rare words. Terms: words that
stand in more toxic examples than chance allows (one-sided G-square test, the
level ``ALPHA`` divided by the number of words tested), at most ``MAX_TERMS`` of
them. A text is its TF-IDF vector
over the terms.

Search: examples are numbered and cut into blocks of ``BLOCK``. For each term the
index has its postings and, per block, the largest weight in it. A query's
products with the block maxima bound every cosine in a block; blocks are
scored exactly from the highest bound down, until the k-th best cosine found
is at least the next bound. The k nearest are exact, ties by example number.

Score: the neighbours' labels are averaged with weights 1 / (distance +
``SOFT``); a logistic curve, fitted to the leave-one-out votes of the examples
with weights that restore the classes' real shares, makes it a probability.
A text without any term has no neighbours; its score is the share of toxic
rows among such learning rows. The nearest toxic examples and the terms found
are given as evidence.

The documents are read once for the score, in Arrow batches, with no shuffle; the
example texts are joined by their few ids. Index and terms are bounded by the
parameters and are broadcast.

Defined results: null and empty texts have no terms; very long texts are used
whole; repeated rows each get their row; with no labelled rows of either
class the score is 0 (1 if all labelled rows are toxic); an empty table gives an
empty table; lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import id_remainder, regroup, set_aside, shingle_set, staged, word_hashes
from netsentry.llm.decontaminate import words_of

PER_CLASS = 4000
MAX_TERMS = 4096
ALPHA = 0.05
NEIGHBOURS = 25
BLOCK = 64
SOFT = 0.05


class Index:
    """Block-max inverted index over the examples' unit TF-IDF vectors."""

    def __init__(self, idf: dict[bytes, float], examples: list[tuple[int, int, dict[bytes, int]]], weights: tuple[float, float],
                 k: int = NEIGHBOURS, empty_score: float = 0.0):
        """``examples``: (doc_id, label, counts of its words); ``weights``: of
        an example of class 0 and 1 in the fitted curve."""
        self.idf, self.k, self.empty_score = idf, k, empty_score
        self.number = {t: n for n, t in enumerate(idf)}
        self.doc_ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.float64)
        postings: list[list[tuple[int, float]]] = [[] for _ in idf]
        vectors = [self.vector(e[2]) for e in examples]
        for n, (terms, values) in enumerate(vectors):
            for t, v in zip(terms.tolist(), values.tolist()):
                postings[t].append((n, v))
        self.blocks = -(-len(examples) // BLOCK)
        self.post = [(np.array([p[0] for p in ps], np.int64), np.array([p[1] for p in ps])) for ps in postings]
        self.begin = [np.searchsorted(n, np.arange(self.blocks + 1) * BLOCK) for n, _ in self.post]
        self.most = np.zeros((len(idf), self.blocks))
        for t, (n, v) in enumerate(self.post):
            np.maximum.at(self.most[t], n // BLOCK, v)
        self.curve = (0.0, 0.0)
        has = [i for i, v in enumerate(vectors) if len(v[0])]
        votes = np.array([self.vote(*self.nearest(*vectors[i], leave=i)) for i in has])
        self.curve = fit_curve(votes, self.labels[has], np.where(self.labels[has] > 0, weights[1], weights[0]))

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of the words that are terms."""
        got = sorted((self.number[w], (1 + math.log(c)) * self.idf[w]) for w, c in counts.items() if w in self.number)
        values = np.array([v for _, v in got])
        return np.array([t for t, _ in got], np.int64), values / (np.sqrt((values * values).sum()) if len(got) else 1.0)

    def nearest(self, terms: np.ndarray, values: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact (example numbers, cosines) of the k nearest; cosine over 0."""
        bound = values @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        best_n, best_s = np.zeros(0, np.int64), np.zeros(0)
        for b in order.tolist():
            if bound[b] <= 0 or len(best_n) >= self.k and best_s[-1] > bound[b] + 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, v in zip(terms.tolist(), values.tolist()):
                lo, hi = self.begin[t][b], self.begin[t][b + 1]
                n, w = self.post[t]
                score[n[lo:hi] - b * BLOCK] += v * w[lo:hi]
            at = np.flatnonzero(score)
            n, s = np.concatenate([best_n, at + b * BLOCK]), np.concatenate([best_s, score[at]])
            n, s = n[n != leave], s[n != leave]
            top = np.lexsort((n, -np.round(s, 12)))[:self.k]
            best_n, best_s = n[top], s[top]
        return best_n, best_s

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1.0 / (np.maximum(0.0, 1.0 - cosines) + SOFT)
        return float((weight * self.labels[numbers]).sum() / weight.sum()) if len(numbers) else 0.0

    def score(self, counts: dict[bytes, int]) -> tuple[float, list[int], list[str]]:
        """Probability of toxic, nearest toxic examples, terms found."""
        terms, values = self.vector(counts)
        if not len(terms):
            return self.empty_score, [], []
        n, s = self.nearest(terms, values)
        a, b = self.curve
        p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * self.vote(n, s)))))
        names = list(self.number)
        return p, self.doc_ids[n[self.labels[n] > 0][:3]].tolist(), [names[t].decode("utf-8", "replace") for t in terms[np.argsort(-values)][:5].tolist()]


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x, slightly ridged, by Newton steps."""
    a = b = 0.0
    if not len(x):
        return -30.0, 0.0
    w = w / w.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        r, h = w * (y - p), w * p * (1 - p) + 1e-9
        g = np.array([r.sum() - 1e-3 * a, (r * x).sum() - 1e-3 * b])
        m = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(m, g), -4, 4)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def choose_terms(df: dict[bytes, tuple[int, int]], n0: int, n1: int, max_terms: int = MAX_TERMS, alpha: float = ALPHA) -> dict[bytes, float]:
    """IDF of the words that mark toxic examples; ``df``: per word its
    documents of class 0 and 1."""
    def g2(d0: int, d1: int) -> float:
        if d1 * n0 <= d0 * n1:
            return 0.0
        total = 0.0
        for seen, n, all_ in ((d0, n0, d0 + d1), (d1, n1, d0 + d1), (n0 - d0, n0, n0 + n1 - d0 - d1), (n1 - d1, n1, n0 + n1 - d0 - d1)):
            if seen:
                total += seen * math.log(seen * (n0 + n1) / (n * all_))
        return 2 * total

    ranked = sorted((-g2(d0, d1), t) for t, (d0, d1) in df.items())
    chosen = sorted(t for g, t in ranked[:max_terms] if g < 0 and math.erfc(math.sqrt(-g / 2)) / 2 * len(ranked) <= alpha)
    return {t: math.log((n0 + n1 + 1) / (sum(df[t]) + 1)) + 1 for t in chosen}


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS, held_out=None) -> Index:
    """The index from the labelled learning rows. ``held_out``: a condition on
    doc_id; such rows are left out (default: crc32 of the id modulo 5 is 0)."""
    held_out = id_remainder(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = dict(known.groupBy("toxic").count().collect())
    wanted = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not (shares.get(0) and shares.get(1)):
        return Index({}, [], (1.0, 1.0), k, 1.0 if shares.get(1) else 0.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame(wanted, "doc_id long, toxic int")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regroup(batches):
            words = [words_of(t) for t in part.column("text").to_pylist()]
            counts = [Counter(w) for w in words]
            families = [int(shingle_set(word_hashes(w), 3)[:1].view(np.int64).sum()) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), part.column("toxic").combine_chunks(), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())), pa.array(families, pa.int64())],
                names=["doc_id", "toxic", "words", "counts", "family"])

    cut = chosen.mapInArrow(words, "doc_id long, toxic int, words array<binary>, counts array<long>, family long")
    seen = staged(cut.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "words", "counts")).alias("e"))
                  .select("e.doc_id", "toxic", "e.words", "e.counts"), "examples")
    marks = seen.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("toxic") == 0).alias("d0"), F.count_if(F.col("toxic") == 1).alias("d1")).where("d1 >= 2")
    found = dict(seen.groupBy("toxic").count().collect())
    n0, n1 = found.get(0, 0), found.get(1, 0)
    # Only words that pass a plain necessary condition of the threshold come to the driver; the examples bound their number.
    df = {bytes(r[0]): (r[1], r[2]) for r in marks.where(F.col("d1") * max(n0, 1) > 2 * F.col("d0") * max(n1, 1)).collect()}
    idf = choose_terms(df, n0, n1)
    kept = spark.sparkContext.broadcast(set(idf))

    def only_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [[(w, c) for w, c in zip(ws, cs) if w in kept.value] for ws, cs in zip(b.column("words").to_pylist(), b.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([[w for w, _ in p] for p in pairs], pa.list_(pa.binary())),
                                              pa.array([[c for _, c in p] for p in pairs], pa.list_(pa.int64()))], names=["doc_id", "toxic", "words", "counts"])

    rows = seen.mapInArrow(only_terms, seen.schema).orderBy("doc_id").collect()
    examples = [(r[0], r[1], {bytes(w): c for w, c in zip(r[2], r[3])}) for r in rows]
    weights = (shares[0] / max(1, n0), shares[1] / max(1, n1))
    empty = [sum(weights[e[1]] for e in examples if not e[2] and e[1] == c) for c in (0, 1)]
    return Index(idf, examples, weights, k, empty[1] / sum(empty) if sum(empty) else shares[1] / (shares[0] + shares[1]))


def scored_table(part: pa.Table, index: Index, text: str) -> tuple[list[float], list[list[int]], list[list[str]]]:
    terms = index.number
    scores, near, found = [], [], []
    for t in part.column(text).to_pylist():
        counts = Counter(filter(terms.__contains__, words_of(t)))
        s, n, f = index.score(counts)
        scores.append(s)
        near.append(n)
        found.append(f)
    return scores, near, found


def score_toxicity(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1), ``toxic_examples`` (ids of the
    nearest toxic examples) and ``toxic_terms``. Columns of ``docs`` with these names are replaced."""
    docs = docs.drop("toxic_score", "toxic_examples", "toxic_terms")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(index if index is not None else learn(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regroup(batches):
            made = [pa.array(x, t) for x, t in zip(scored_table(part, shared.value, "text"), (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in part.columns] + made, names=[*names, "toxic_score", "toxic_examples", "toxic_terms"])

    schema = docs.select("*", F.lit(None).cast("double").alias("toxic_score"), F.lit(None).cast("array<long>").alias("toxic_examples"),
                         F.lit(None).cast("array<string>").alias("toxic_terms")).schema
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored ``least`` or more. Every column stays, whatever
    its name; null and empty texts are scored as empty."""
    plain, back = set_aside(docs, "doc_id", "text")
    return back(score_toxicity(plain, labels).where(F.col("toxic_score") < least))
