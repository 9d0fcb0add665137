"""Word vectors trained in shards."""

import collections
import pathlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from netsentry.operators import text, word_vectors


def corpus(seed=1, n=400):
    """Two topics; ``twin_a`` and ``twin_b`` stand in the same places of the first."""
    r = random.Random(seed)
    topics = [[f"{t}{i}" for i in range(12)] for t in "xy"]
    out = []
    for _ in range(n):
        t = r.randrange(2)
        words = [r.choice(topics[t]) for _ in range(12)]
        if t == 0:
            words[r.randrange(12)] = r.choice(["twin_a", "twin_b"])
        out.append(words)
    return out + [None, [], ["rare"], [None, "x0", None, "x1"]]


def frame(spark, lists):
    return spark.createDataFrame([(x,) for x in lists], "tokens array<string>")


def test_pairs_are_those_of_the_windows(spark):
    lists = corpus(n=30)
    want = collections.Counter()
    counts = collections.Counter(w for s in lists for w in s or [] if w)
    words = {w for w, n in counts.items() if n >= 5}
    for s in lists:
        for part in ([(s or [])[i:i + 5] for i in range(0, len(s or []), 5)]):
            for i, a in enumerate(part):
                for d in range(1, 4):
                    if i + d < len(part) and a in words and part[i + d] in words:
                        want[a, part[i + d]] += (4 - d) / 3
                        if a != part[i + d]:
                            want[part[i + d], a] += (4 - d) / 3
    vocabulary = text.vocabulary(frame(spark, lists), "tokens", 5).where("word is not null")
    got = word_vectors.word_pairs(frame(spark, lists).repartition(4), "tokens", vocabulary, 3, 5)
    got = {(r["word"], r["beside"]): r["weight"] for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors_and_twins(spark):
    lists = corpus()
    fit = dict(size=16, min_count=5, window=5, epochs=2, passes=5, shards=3, negatives=1)
    vectors = word_vectors.fit_word_vectors(frame(spark, lists).repartition(5), **fit)
    rows = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
    counts = collections.Counter(w for s in lists for w in s or [] if w)
    assert set(rows) == {w for w, n in counts.items() if n >= 5}
    assert all(len(v) == 16 and np.isfinite(v).all() and np.linalg.norm(v) > 0.05 for v in rows.values())
    assert text.top_similar(vectors.withColumn("vector", F.col("vector").cast("array<double>")), "word", "vector", "twin_a", 1).first()["word"].startswith(("twin_b", "x"))
    unit = {w: v / np.linalg.norm(v) for w, v in rows.items()}
    inside = np.mean([unit[f"x{i}"] @ unit[f"x{j}"] for i in range(12) for j in range(i)])
    across = np.mean([unit[f"x{i}"] @ unit[f"y{j}"] for i in range(12) for j in range(12)])
    assert inside > across + 0.3
    assert unit["twin_a"] @ unit["twin_b"] > across + 0.3
    again = {r["word"]: np.array(r["vector"]) for r in word_vectors.fit_word_vectors(frame(spark, lists).repartition(2), **fit).collect()}
    assert all(np.allclose(again[w], rows[w], atol=1e-4) for w in rows)


def test_empty_corpus(spark):
    assert word_vectors.fit_word_vectors(frame(spark, [None, []]), shards=2).collect() == []


def test_pairs_do_not_depend_on_the_pieces(spark, monkeypatch):
    lists = corpus(n=40)
    frames = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.string()))], ["tokens"]) for x in (lists[:25], lists[25:])]

    def counted(words_at_once):
        monkeypatch.setattr(word_vectors, "WORDS_AT_ONCE", words_at_once)
        total, most = collections.Counter(), 0
        for batch in word_vectors._pairs(3, 1000)([frames[0], frames[1].slice(3), frames[1].slice(0, 3), frames[0].slice(0, 0)]):
            most = max(most, batch.num_rows)
            for r in batch.to_pylist():
                total[tuple(sorted((r["word"], r["beside"])))] += r["weight"]
        return {k: round(v, 9) for k, v in total.items()}, most

    whole, most = counted(1 << 18)
    few, least = counted(30)
    assert few == whole and least < most and least <= 3 * 30


def test_pairs_are_stored_as_numbers(spark):
    words = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (1, 1, "c")], "shard int, row int, word string")
    pairs = spark.createDataFrame([("a", "b", 1.5), ("c", "a", 2.0), ("b", "c", 1.0)], "word string, beside string, weight double")
    got = word_vectors.numbered_pairs(pairs, words, 2)
    assert all(t in ("int", "float") for _, t in got.dtypes)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 0, 1.5), (1, 0, 0, 1, 1.0), (1, 1, 1, 0, 2.0)]


def test_the_parallel_fit_needs_no_vocabulary_on_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    def whole(*_):
        raise AssertionError("the library's fit holds the model on the driver")

    monkeypatch.setattr(Word2Vec, "_fit", whole)
    lists = corpus()
    model = text.parallel_word2vec(frame(spark, lists), "tokens", num_partitions=3, vector_size=12, min_count=5, max_iter=5).fit(frame(spark, lists))
    counts = collections.Counter(w for s in lists for w in s or [] if w)
    assert {r["word"] for r in model.getVectors().collect()} == {w for w, n in counts.items() if n >= 5}
    near = text.synonyms(model, "x0", 8).collect()
    assert [r["similarity"] for r in near] == sorted((r["similarity"] for r in near), reverse=True)
    assert sum(r["word"].startswith(("x", "twin")) for r in near) >= 7


def size_of(path):
    return sum(p.stat().st_size for p in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_the_weights_lie_on_disk_once(spark, scratch, monkeypatch):
    r = random.Random(3)
    lists = [[f"w{r.randrange(600)}" for _ in range(30)] for _ in range(500)]
    sizes, delete = [], word_vectors.fs.delete

    def watched(session, path):
        sizes.append(size_of(scratch))
        return delete(session, path)

    monkeypatch.setattr(word_vectors, "scratch_path", lambda *_: scratch)
    monkeypatch.setattr(word_vectors.fs, "delete", watched)
    before = {k: spark.conf.get(k, None) for k in word_vectors.SETTINGS}
    vectors = word_vectors.fit_word_vectors(frame(spark, lists).repartition(3), size=100, window=3, negatives=1, passes=1, shards=4)
    assert vectors.count() == 600
    weights = 600 * 2 * 2 * 100 * 4  # own vectors and contexts with their squares
    assert len(sizes) >= 2 * 4 * 4 and max(sizes) < 1.75 * weights and size_of(scratch) < weights
    assert {k: spark.conf.get(k, None) for k in word_vectors.SETTINGS} == before


def test_stored_pairs_are_those_of_the_windows(spark, scratch):
    lists = corpus(n=60) + [[None], ["x1", None, "x2"]]
    df = frame(spark, lists).repartition(3)
    words = word_vectors.stored_pairs(spark, scratch, df, 5, 3, 3, 5)
    named = {(r["shard"], r["row"]): r["word"] for r in words.collect()}
    counts = collections.Counter(w for s in lists for w in s or [] if w)
    assert {r["word"]: r["n"] for r in words.collect()} == {w: n for w, n in counts.items() if n >= 5}
    got = {}
    for r in spark.read.parquet(f"{scratch}/pairs").collect():
        at = np.cumsum(word_vectors._unpacked(bytes(r["keys"]), r["n"], np.int64))
        for k, n in zip(at.tolist(), word_vectors._unpacked(bytes(r["weights"]), r["n"], np.int64).tolist(), strict=True):
            a, b = named[r["a"], k // r["width"]], named[r["b"], k % r["width"]]
            assert r["a"] <= r["b"] and (a, b) not in got and (b, a) not in got
            got[a, b] = got[b, a] = n / 3
    want = word_vectors.word_pairs(df, "tokens", words, 3, 5).collect()
    assert set(got) == {(r["word"], r["beside"]) for r in want} and all(abs(got[r["word"], r["beside"]] - r["weight"]) < 1e-9 for r in want)


def test_a_corpus_without_pairs(spark):
    vectors = word_vectors.fit_word_vectors(frame(spark, [["alone"]] * 5 + [["rare", "too"]]).repartition(2), size=8, shards=2).collect()
    assert [r["word"] for r in vectors] == ["alone"] and len(vectors[0]["vector"]) == 8


def test_totals_are_those_of_reduceat():
    r = np.random.default_rng(2)
    rows = np.concatenate([r.integers(0, 900, 1500), r.integers(0, 20, 300), np.full(40, 7)])
    gradient = r.standard_normal((len(rows), 9)).astype(np.float32)
    at, total = word_vectors._totals(rows, lambda o, to=None: np.take(gradient, o, axis=0, out=to, mode="clip"), np.empty_like(gradient))
    order = np.argsort(rows, kind="stable")
    want, first = np.unique(rows[order], return_index=True)
    assert (at == want).all() and (total == np.add.reduceat(gradient[order], first, axis=0)).all()
