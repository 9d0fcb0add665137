"""Physical-plan properties the performance work relies on."""

import contextlib
import io

from conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _q(spark, name):
    import __spark_entry__ as E
    return E.queries()[name](spark, SF001)


def test_scans_read_only_used_columns(spark):
    p = _plan(_q(spark, "symbolic_cardinality"))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in p
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in p \
        or "ReadSchema: struct<o_orderpriority:string,o_orderstatus:string>" in p


def test_partial_aggregation_before_shuffle(spark):
    p = _plan(_q(spark, "symbolic_cardinality"))
    first_exchange = p.index("Exchange")
    assert "HashAggregate" in p[:p.index("(1)")]  # aggregates on both sides of exchanges
    assert p.count("HashAggregate (") >= 2 * p.count("Exchange (") - 2 and first_exchange > 0


def test_limits_are_top_n(spark):
    for name in ["first_n", "top_similar"]:
        p = _plan(_q(spark, name))
        assert "TakeOrderedAndProject" in p and "Sort (" not in p


def test_one_python_pass_per_assignment(spark):
    assert _plan(_q(spark, "lloyd_step")).count("ArrowEvalPython (") == 1
    assert _plan(_q(spark, "nearest_center")).count("ArrowEvalPython (") == 1


def test_parsing_stays_in_the_jvm(spark):
    for name in ["parse_lenient", "parse_strict", "split_key_vector", "parse_vector_text", "csv_scan"]:
        p = _plan(_q(spark, name))
        assert "EvalPython" not in p, name


def test_lenient_filter_splits_once(spark):
    p = _plan(_q(spark, "parse_lenient"))
    cond = [l for l in p.splitlines() if l.startswith("Condition")]
    assert cond and all(c.count("split(") <= 1 for c in cond)
