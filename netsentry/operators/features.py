"""Feature transformers.

Fitted stages are ``pyspark.ml`` estimators: their fits are distributed
aggregates (value counts, column moments) whose results are small (one label
list per symbolic column, one std per slot) and their transforms are
map-only. The only shuffle here is A1's, of distinct (column, value) pairs
after map-side de-duplication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (IndexToString, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions import records as R

INDEX_SUFFIX = "_index"
VEC_SUFFIX = "_Vec"


# --------------------------------------------------------------------- A1
def symbolic_cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False,
                         rsd: float = 0.05) -> DataFrame:
    """Distinct values per column, nulls counted as one more value.

    Exact form: the columns are stacked into (column, value) pairs, made
    distinct with a map-side partial aggregate (each partition emits each
    pair once, so a hot value costs nothing extra), then counted per column:
    one scan for all columns instead of one job per column.
    Approximate form: one ``approx_count_distinct`` per column plus a null
    flag, a single aggregate with fixed-size sketches. Spark's default
    ``rsd=0.05`` keeps each sketch at 512 registers; much smaller ``rsd``
    makes the buffer thousands of fields wide and the aggregate several
    times slower (measured 4x at 0.01).
    """
    if approx:
        aggs = []
        for c in cols:
            aggs.append((F.approx_count_distinct(c, rsd)
                         + F.max(F.col(c).isNull().cast("long"))).alias(c))
        wide = df.agg(*aggs)
        return wide.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("long") for c in cols]))
        ).alias("column", "n"))
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.column", "p.value")
    return pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- F1
def string_indexer(cols: Sequence[str], out_cols: Sequence[str] | None = None,
                   handle_invalid: str = "error", order: str = "frequencyDesc") -> StringIndexer:
    """Index by descending frequency (ties alphabetical); unseen values fail
    by default (``keep`` gives them index = number of labels, ``skip`` drops
    the row). One fit pass covers all columns."""
    out_cols = list(out_cols or [c + INDEX_SUFFIX for c in cols])
    return StringIndexer(inputCols=list(cols), outputCols=out_cols, handleInvalid=handle_invalid,
                         stringOrderType=order)


# --------------------------------------------------------------------- F2
def one_hot_encoder(index_cols: Sequence[str], out_cols: Sequence[str] | None = None,
                    drop_last: bool = True, handle_invalid: str = "error") -> OneHotEncoder:
    """Sparse one-hot, last category dropped by default."""
    out_cols = list(out_cols or [c[:-len(INDEX_SUFFIX)] + VEC_SUFFIX if c.endswith(INDEX_SUFFIX)
                                 else c + VEC_SUFFIX for c in index_cols])
    return OneHotEncoder(inputCols=list(index_cols), outputCols=out_cols, dropLast=drop_last,
                         handleInvalid=handle_invalid)


# --------------------------------------------------------------------- F3, F4
def assembler(inputs: Sequence[str], out: str = R.FEATURES, handle_invalid: str = "error") -> VectorAssembler:
    """Concatenate numbers and vectors; a null input fails the job by default."""
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid=handle_invalid)


# --------------------------------------------------------------------- F5
def std_scaler(inp: str = R.FEATURES, out: str = R.SCALED_FEATURES) -> StandardScaler:
    """Divide each slot by its sample std, no centring; a zero-variance slot
    becomes 0.0."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=False, withStd=True)


# --------------------------------------------------------------------- F6
def index_to_label(inp: str, labels: Sequence[str], out: str = R.PREDICTED_LABEL) -> IndexToString:
    return IndexToString(inputCol=inp, outputCol=out, labels=list(labels))


# --------------------------------------------------------------------- F9
def feature_pipeline(symbolic: Sequence[str], assembler_inputs: Sequence[str],
                     label: str | None = None, handle_invalid: str = "error",
                     scale: bool = True) -> Pipeline:
    """Index + one-hot the symbolic columns, assemble ``assembler_inputs``
    (which name the one-hot outputs ``<col>_Vec``), index the label if given,
    then scale. Stages are found later by type or output column, never by
    position."""
    symbolic = list(symbolic)
    stages = [string_indexer(symbolic, handle_invalid=handle_invalid),
              one_hot_encoder([c + INDEX_SUFFIX for c in symbolic]),
              assembler(assembler_inputs)]
    if label:
        stages.append(string_indexer([label], [R.INDEXED_LABEL]))
    if scale:
        stages.append(std_scaler())
    return Pipeline(stages=stages)


def find_stage(model, kind=None, output_col: str | None = None):
    """First stage of a fitted pipeline matching a type and/or output column."""
    for st in model.stages:
        if kind is not None and not isinstance(st, kind):
            continue
        if output_col is not None:
            outs = []
            for p in ("outputCol", "outputCols", "predictionCol"):
                if st.hasParam(p) and st.isDefined(st.getParam(p)):
                    v = st.getOrDefault(st.getParam(p))
                    outs.extend(v if isinstance(v, list) else [v])
            if output_col not in outs:
                continue
        return st
    raise KeyError(f"no stage of type {kind} with output {output_col}")


def labels_of(model, output_col: str) -> list[str]:
    """Label list of the fitted indexer that writes ``output_col``."""
    from pyspark.ml.feature import StringIndexerModel
    st = find_stage(model, StringIndexerModel, output_col)
    outs = st.getOutputCols() if st.isDefined(st.getParam("outputCols")) else [st.getOutputCol()]
    return list(st.labelsArray[outs.index(output_col)])


# --------------------------------------------------------------------- F8
def hash_bucket(key, buckets: int = 10000) -> Column:
    """Stable bucket of a key: the first 7 hex digits of ``md5(key)`` as a
    number, modulo ``buckets``. Depends only on the key, so it survives
    re-partitioning, re-runs and lost executors."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 7), 16, 10).cast("long"),
                  F.lit(buckets))


def hash_split_column(key, weights: Sequence[float], buckets: int = 10000) -> Column:
    """Split number (0-based) of each row for ``weights`` (normalised)."""
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative with a positive sum")
    b = hash_bucket(key, buckets)
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(int(round(acc * buckets)))
    expr = F.lit(len(weights) - 1)
    for i in range(len(bounds) - 1, -1, -1):
        expr = F.when(b < bounds[i], F.lit(i)).otherwise(expr)
    return expr.cast("int")


def hash_split(df: DataFrame, key: str, weights: Sequence[float], buckets: int = 10000) -> list[DataFrame]:
    """Deterministic ``randomSplit`` replacement keyed on ``key``."""
    tagged = df.withColumn("_ns_split", hash_split_column(key, weights, buckets))
    return [tagged.filter(F.col("_ns_split") == i).drop("_ns_split") for i in range(len(weights))]
