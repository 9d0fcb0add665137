"""S3: a ``StructType`` computed from a column-spec text.

Spec format: line 1 is the class list and is skipped; every other non-blank
line is ``name: type.`` where type is ``continuous.`` (numeric) or
``symbolic.`` (string). A string ``label`` column is appended. Any other type
word is an error, as in the original job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

_NUMERIC = {"float": T.FloatType, "double": T.DoubleType}


def parse_spec(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(name, kind) pairs, kind in {"continuous", "symbolic"}."""
    out = []
    it = iter(lines)
    next(it, None)  # class-list line
    for raw in it:
        if not raw.strip():
            continue
        parts = [p.strip() for p in raw.split(":")]
        if len(parts) < 2:
            raise ValueError(f"spec line without a type: {raw!r}")
        name, kind = parts[0], parts[1]
        if kind == "continuous.":
            out.append((name, "continuous"))
        elif kind == "symbolic.":
            out.append((name, "symbolic"))
        else:
            raise ValueError(f"unknown column type {kind!r} for {name!r}")
    return out


def schema_from_spec(lines: Iterable[str] | str, numeric_type: str = "double",
                     label: str | None = "label") -> T.StructType:
    """Spec lines (or the whole text) to a schema.

    ``numeric_type="float"`` reproduces 32-bit training reads; the default
    ``double`` matches the streamed records, so training and serving agree.
    """
    if isinstance(lines, str):
        lines = lines.splitlines()
    num = _NUMERIC[numeric_type]
    fields = [T.StructField(n, num() if k == "continuous" else T.StringType(), True)
              for n, k in parse_spec(lines)]
    if label:
        fields.append(T.StructField(label, T.StringType(), True))
    return T.StructType(fields)


def symbolic_columns(lines: Iterable[str] | str) -> list[str]:
    if isinstance(lines, str):
        lines = lines.splitlines()
    return [n for n, k in parse_spec(lines) if k == "symbolic"]
