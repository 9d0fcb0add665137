"""Row parsing as column expressions.

JVM ``String.split`` drops trailing empty fields; Spark's ``split`` keeps
them. Every splitter here strips trailing separators first, so field counts
equal the original job's. Numbers follow JVM rules, which Spark's casts
share: surrounding blanks and a ``d`` suffix are accepted, ``''`` is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Spark inlines a column expression wherever it is referenced, and inside a
    lambda a reference is re-evaluated per element; binding the value as the
    single element of an array keeps each of those references a variable
    lookup.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def jvm_split(c, sep: str) -> Column:
    """``split`` with JVM semantics for one literal separator character:
    trailing empty pieces are dropped, and a string made only of separators
    gives an empty array; ``''`` gives ``['']``."""
    s = _col(c)
    esc = "\\" + sep if sep in ".[]()*+?^$|\\{}" else sep
    stripped = F.rtrim(s, F.lit(sep))
    return F.when((F.length(stripped) == 0) & (F.length(s) > 0), F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, esc))


# --------------------------------------------------------------------- P1
def explode_records(df: DataFrame, col: str = "value", out: str = "line",
                    pos: str | None = "line_no") -> DataFrame:
    """One row per ``\\n``-separated record of a message; other columns kept."""
    others = [c for c in df.columns if c != col]
    if pos:
        return df.select(*others, F.posexplode(jvm_split(col, "\n")).alias(pos, out)) \
            .withColumn(pos, F.col(pos).cast("int"))
    return df.select(*others, F.explode(jvm_split(col, "\n")).alias(out))


# ------------------------------------------------------------------ P2, P3
def parse_records(df: DataFrame, schema: T.StructType, col: str = "line", mode: str = "strict",
                  sep: str = ",", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Split ``col`` on ``sep`` and cast by position into ``schema``.

    * ``strict``: a short row or a bad number fails the job (like the
      original's exceptions), whichever columns the caller goes on to use;
      extra fields are ignored. Returns (rows, None).
    * ``lenient``: failing rows are dropped from the result and returned
      as a second frame (``keep`` columns + the raw line + a reason) instead
      of being logged. Returns (rows, rejects).
    * ``tagged``: all rows with the line and the reason (null: a good row), for callers that keep
      them before ``split_tagged`` parts them. Returns (tagged rows, None).
    """
    keep = keep or []
    n = len(schema.fields)
    parts = "_ns_parts"
    base = df.select(*keep, F.col(col).alias("_ns_line"), jvm_split(col, sep).alias(parts))
    fields = []
    for i, f in enumerate(schema.fields):
        raw = F.get(F.col(parts), i)  # null past the end, whatever the ANSI setting
        val = raw if isinstance(f.dataType, T.StringType) else raw.try_cast(f.dataType)
        fields.append(val.alias(f.name))
    if mode not in ("strict", "lenient", "tagged"):
        raise ValueError(f"mode must be strict, lenient or tagged, not {mode}")
    # One pass over the pieces decides the row: the check references the
    # split array once, so a filter pushed below the projection re-splits
    # the line once, not once per field.
    types = list(dict.fromkeys(f.dataType for f in schema.fields if not isinstance(f.dataType, T.StringType)))
    kinds = F.array(*[F.lit(0 if isinstance(f.dataType, T.StringType) else 1 + types.index(f.dataType)) for f in schema.fields])

    def unreadable(p: Column, k: Column) -> Column:
        bad = F.lit(False)
        for i, t in enumerate(types):  # each field by its own type
            bad = bad | ((k == i + 1) & p.try_cast(t).isNull())
        return bad

    reason = F.aggregate(
        F.zip_with(F.col(parts), kinds, lambda p, k: F.when(k.isNull(), F.lit(0))
                   .when(p.isNull(), F.lit(2))
                   .when(unreadable(p, k), F.lit(1)).otherwise(F.lit(0))),
        F.lit(0), lambda acc, x: F.greatest(acc, x))
    # code 0 ok / 1 bad number / 2 short (a null line has no pieces: short),
    # mapped through a literal so the split is still referenced once
    reason = F.element_at(F.array(F.lit(None).cast("string"), F.lit("bad_number"), F.lit("short")),
                          F.coalesce(reason, F.lit(2)) + 1)
    if mode == "strict":
        # A filter, which column pruning cannot take away.
        message = F.concat(F.lit("cannot read the record ("), reason, F.lit(f"; {n} fields wanted): "), F.coalesce(F.col("_ns_line"), F.lit("<null>")))
        return base.filter(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*keep, *fields), None
    tagged = base.withColumn("_ns_reason", reason).select(*keep, "_ns_line", "_ns_reason", *fields)
    if mode == "tagged":
        return tagged, None
    return split_tagged(tagged, schema, keep)


def split_tagged(tagged: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a frame of ``keep`` columns, line, reason (null: a good row) and the schema's fields."""
    keep = keep or []
    good = tagged.filter(F.col("_ns_reason").isNull()).select(*keep, *[f.name for f in schema.fields])
    rejects = tagged.filter(F.col("_ns_reason").isNotNull()).select(
        *keep, F.col("_ns_line").alias("line"), F.col("_ns_reason").alias("reason"))
    return good, rejects


# --------------------------------------------------------------------- P6
def parse_dense_vector(c, sep: str = " ", mode: str = "strict") -> Column:
    """``'1.0 2.0 3.0'`` to ``array<double>``; a bad number fails the job (``strict``) or makes the
    whole vector null (``lenient``)."""
    parts = jvm_split(c, sep)
    if mode == "lenient":
        return _let(F.transform(parts, lambda x: x.try_cast("double")), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a))
    return F.transform(parts, lambda x: F.when(x.try_cast("double").isNotNull(), x.try_cast("double"))
                       .otherwise(F.raise_error(F.concat(F.lit("not a number: "), x))))


# --------------------------------------------------------------------- P7
_SPARSE_RE = r"^\(\s*(\d+)\s*,\s*\[([^\]]*)\]\s*,\s*\[([^\]]*)\]\s*\)$"


_SPARSE_JSON = '{"n":$1,"i":[$2],"v":[$3]}'


def parse_vector(c, mode: str = "strict") -> Column:
    """ml/mllib vector text to a dense ``array<double>``.

    A dense ``[x1,..,xn]`` text is a JSON array of numbers (``1.0E-5``,
    ``NaN`` and ``Infinity`` included), so it goes through ``from_json`` -
    the JVM's JSON parser, no per-element lambda. A sparse
    ``(n,[i1,..],[v1,..])`` text is rewritten to a JSON object, parsed the
    same way and densified with a map lookup per slot. Any other text, a null
    component, and sparse indices outside the width or not one per value fail the job
    (``strict``) or give null (``lenient``). A null text gives null.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode}")
    bad = F.lit(None).cast("array<double>")

    def from_sparse(sp: Column) -> Column:
        sparse = F.when(sp["n"] == 0, F.array().cast("array<double>")).otherwise(_let(
            F.map_from_arrays(sp["i"], sp["v"]),
            lambda m: F.transform(F.sequence(F.lit(0), sp["n"] - 1),
                                  lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))))
        inside = (F.size(sp["i"]) == F.size(sp["v"])) & F.forall(sp["i"], lambda i: i.isNotNull() & (i >= 0) & (i < sp["n"]))
        return F.when(inside, sparse)

    def parse(s: Column) -> Column:
        dense = F.from_json(s, "array<double>", {"allowNonNumericNumbers": "true"})
        sp = F.from_json(F.regexp_replace(s, _SPARSE_RE, _SPARSE_JSON), "struct<n:int,i:array<int>,v:array<double>>")
        # the text is read once: every mention of ``sp`` outside a ``_let`` would read it again, inside a lambda for each element
        parsed = F.when(s.startswith("["), dense).when(s.rlike(_SPARSE_RE), _let(sp, from_sparse))
        wrong = F.when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a vector: "), s)).cast("array<double>")) if mode == "strict" else bad
        return _let(parsed, lambda x: F.when(x.isNull() | F.exists(x, lambda v: v.isNull()), wrong).otherwise(x))

    return _let(F.trim(_col(c)), parse)


# --------------------------------------------------------------------- P8
def parse_labeled_point(c, mode: str = "strict") -> Column:
    """Labelled point text to ``struct<label double, features array<double>>``.

    Accepts ``(y,[x..])``, ``(y,(n,[i..],[v..]))``, the legacy
    ``y,x1 x2 ..`` form and the ``(y), [x..]`` variant. A label or vector
    that is not one fails the job (``strict``) or is null (``lenient``); a null text gives nulls.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode}")

    def parse(s):
        variant = s.rlike(r"^\([^,]*\)\s*,")
        wrapped = s.startswith("(") & s.endswith(")") & ~variant
        label = F.when(wrapped, F.regexp_extract(s, r"^\(([^,]*),", 1)) \
            .when(variant, F.regexp_extract(s, r"^\(([^,]*)\)", 1)) \
            .otherwise(F.regexp_extract(s, r"^([^,]*),", 1))
        vec_txt = F.when(wrapped, F.regexp_extract(s, r"^\([^,]*,(.*)\)$", 1)) \
            .when(variant, F.regexp_extract(s, r"^\([^,]*\)\s*,(.*)$", 1)) \
            .otherwise(F.regexp_extract(s, r"^[^,]*,(.*)$", 1))
        features = F.when(wrapped | variant, parse_vector(vec_txt, mode)) \
            .otherwise(parse_dense_vector(F.trim(vec_txt), mode=mode))
        number = F.trim(label).try_cast("double")
        if mode == "strict":
            number = F.coalesce(number, F.raise_error(F.concat(F.lit("not a labelled point: "), s)).cast("double"))
        return F.struct(F.when(s.isNotNull(), number).alias("label"), features.alias("features"))
    return _let(F.trim(_col(c)), parse)


# --------------------------------------------------------------------- P9
def split_key_vector(c, key: str = "key", vec: str = "vector_text") -> list[Column]:
    """Last space-separated token is the vector text, the rest re-joined is
    the key (the text before the last space, trailing spaces dropped as the
    JVM split does). A one-token line has no key (null), which callers
    reject. Plain string functions, compiled by codegen."""
    stripped = F.rtrim(_col(c), F.lit(" "))
    last = F.substring_index(stripped, " ", -1)
    has_key = F.instr(stripped, " ") > 0
    before = F.substring(stripped, F.lit(1), F.length(stripped) - F.length(last) - 1)
    return [F.when(has_key, before).alias(key), F.when(has_key, last).alias(vec)]


# -------------------------------------------------------------------- P10
def vector_text(arr, sparse: bool | str = False) -> Column:
    """Dense ``[x1,..]`` or sparse ``(n,[i..],[v..])`` text of an array.

    ``sparse="auto"`` picks per row the form an ml vector would be stored
    (and printed) in after the assembler's ``compressed``: sparse when
    ``1.5 * (nonzeros + 1) < size``, else dense.
    """
    if sparse == "auto":
        return _let(_col(arr), lambda a: F.when(
            F.size(F.filter(a, lambda x: x != 0)) * 1.5 + 1.5 < F.size(a), vector_text(a, True))
            .otherwise(vector_text(a, False)))
    if not sparse:
        return F.concat(F.lit("["), F.array_join(F.transform(_col(arr), lambda x: x.cast("string")), ","),
                        F.lit("]"))

    def fmt(a):
        pairs = F.filter(F.zip_with(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), a,
                                    lambda i, x: F.struct(i.alias("i"), x.alias("x"))),
                         lambda e: e["x"].isNotNull() & (e["x"] != 0))
        return _let(pairs, lambda nz: F.concat(
            F.lit("("), F.size(a).cast("string"), F.lit(",["),
            F.array_join(F.transform(nz, lambda e: e["i"].cast("string")), ","), F.lit("],["),
            F.array_join(F.transform(nz, lambda e: e["x"].cast("string")), ","), F.lit("])")))
    return _let(_col(arr), fmt)


def format_vector_message(id_cols: list, vec, sparse: bool | str = False) -> Column:
    """``id1 id2 .. vectorText`` as one space-separated message."""
    return F.concat_ws(" ", *[_col(c).cast("string") for c in id_cols], vector_text(vec, sparse))


# -------------------------------------------------------------------- P11
def format_assignment(key, cluster) -> Column:
    return F.concat_ws(" ", _col(key), _col(cluster).cast("string"))


def format_weights(weights) -> Column:
    return F.array_join(F.transform(_col(weights), lambda x: x.cast("string")), ",")


# -------------------------------------------------------------------- P12
def tokenize(c) -> Column:
    """Split on single spaces (interior empty tokens kept, JVM style)."""
    return jvm_split(c, " ")
