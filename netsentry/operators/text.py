"""Word vectors and similarity search."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.functions import vectors as V
from netsentry.functions.parse import tokenize


def tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokenize(text))


def word2vec(input_col: str = "tokens", vector_size: int = 100, min_count: int = 5, max_iter: int = 1,
             step_size: float = 0.025, seed: int = 42, num_partitions: int = 1,
             max_sentence_length: int = 1000, window_size: int = 5) -> Word2Vec:
    """Word2Vec with the library's defaults (size 100, min count 5, one
    iteration, step 0.025). ``num_partitions`` > 1 trains that many
    partitions in parallel and merges their updates; each holds the whole
    model (``parallel_word2vec`` does not). The vocabulary is
    counted with a distributed aggregate; the vocabulary x size weight
    matrices are broadcast, so ``min_count`` bounds what is shipped.
    Sentences longer than ``max_sentence_length`` are cut into consecutive
    chunks, all of them used."""
    return Word2Vec(inputCol=input_col, outputCol="_w2v", vectorSize=vector_size, minCount=min_count,
                    maxIter=max_iter, stepSize=step_size, seed=seed, numPartitions=num_partitions,
                    maxSentenceLength=max_sentence_length, windowSize=window_size)


#: Shards of ``parallel_word2vec`` unless the caller names another number: the
#: fitted vectors depend on it, so it is not taken from the cluster at hand.
TRAIN_PARTITIONS = 8


def parallel_word2vec(df: DataFrame, input_col: str = "tokens", num_partitions: int = TRAIN_PARTITIONS, **kw):
    """An estimator of word vectors (``fit(df).getVectors()``) for corpora of any vocabulary. The library's own fit (``word2vec``)
    keeps the vocabulary and both weight matrices on the driver and in each task, in whatever number of partitions
    it trains; this one trains ``num_partitions`` shards (``operators.word_vectors``)."""
    from netsentry.operators.word_vectors import ShardedWord2Vec
    return ShardedWord2Vec(input_col, shards=num_partitions, **kw)


def vocabulary(df: DataFrame, tokens_col: str = "tokens", min_count: int = 5) -> DataFrame:
    """The words Word2Vec keeps: (word, n) with n >= min_count. A grouped
    count with map-side partials."""
    return df.select(F.explode(tokens_col).alias("word")).groupBy("word") \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def top_similar(df: DataFrame, key: str, vec: str, query, n: int = 5) -> DataFrame:
    """The ``n`` rows most cosine-similar to the row whose ``key`` is
    ``query``, the row itself excluded; ties broken by key.

    The query vector is looked up with a filter (one row), then every row is
    scored by a native expression and ``orderBy(..).limit(n)`` runs as a
    per-partition top-n plus a merge of n rows per partition - no sort of the
    whole table, no shuffle of it.
    """
    arr = V.as_double_array(df, vec)
    base = df.select(F.col(key), arr.alias("_ns_v"))
    qrows = base.filter(F.col(key) == F.lit(query)).select("_ns_v").take(2)
    if len(qrows) != 1:
        raise KeyError(f"{query!r} must match exactly one row, found {len(qrows)}")
    q = [float(x) for x in qrows[0][0]]
    qn = sum(x * x for x in q) ** 0.5
    dotq = V.dot_literal("_ns_v", q)
    sim = F.when((qn == 0) | (V.norm("_ns_v") == 0), F.lit(0.0)).otherwise(dotq / (F.lit(qn) * V.norm("_ns_v")))
    return base.filter(F.col(key) != F.lit(query)).select(F.col(key), sim.alias("similarity")) \
        .orderBy(F.col("similarity").desc(), F.col(key).asc()).limit(n)


def synonyms(model, word: str, n: int = 5) -> DataFrame:
    """Word-level form over a fitted Word2Vec model: (word, similarity) of the ``n`` words most similar to ``word``, by a
    distributed top-n over the model's vectors. A word that the model does not hold raises ``KeyError``."""
    vectors = model.getVectors()
    return top_similar(vectors.select("word", V.as_double_array(vectors, "vector").alias("vector")), "word", "vector", word, n)
