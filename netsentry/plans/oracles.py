"""SQL twins of the registered queries (DuckDB dialect, ANSI where it can
be). Tables are the pre-registered test views. Literals are cast to DOUBLE
(DuckDB reads ``1.0`` as DECIMAL); vectors are unnested to (slot, value)."""

from __future__ import annotations

from netsentry.operators import forest
from netsentry.plans import standins as S

K = S.K_EMBED

# --- embeddings: points, first-k centres, distances, nearest ---------------
_EMB = f"""
pts AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS slot,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
ctr_ids AS (SELECT vec_id AS cid, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster
            FROM embeddings ORDER BY vec_id LIMIT {K}),
ctr AS (SELECT c.cluster, p.slot, p.x AS c FROM ctr_ids c JOIN pts p ON p.vec_id = c.cid),
dist AS (SELECT p.vec_id, c.cluster, sum((p.x - c.c) * (p.x - c.c)) AS d
         FROM pts p JOIN ctr c ON p.slot = c.slot GROUP BY p.vec_id, c.cluster),
near AS (SELECT vec_id, cluster, d FROM (
           SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM dist) WHERE rn = 1)
"""

NEAREST_CENTER = f"WITH {_EMB} SELECT vec_id, cluster FROM near"
DISTANCE_TO_CENTERS = f"WITH {_EMB} SELECT vec_id, cluster AS center, round(d, 9) AS dist FROM dist"
WSSSE = f"WITH {_EMB} SELECT round(coalesce(sum(d), 0), 6) AS wssse, count(*) AS n FROM near"
CLUSTER_COST = f"WITH {_EMB} SELECT cluster, count(*) AS n, round(sum(d), 6) AS cost FROM near GROUP BY cluster"
LLOYD_STEP = f"""WITH {_EMB},
m AS (SELECT n.cluster, p.slot, sum(p.x) AS s, count(*) AS cnt
      FROM near n JOIN pts p ON p.vec_id = n.vec_id GROUP BY n.cluster, p.slot)
SELECT c.cluster, CAST(coalesce(m.cnt, 0) AS BIGINT) AS n, c.slot,
       round(CASE WHEN m.cnt > 0 THEN m.s / m.cnt ELSE c.c END, 9) AS value
FROM ctr c LEFT JOIN m ON m.cluster = c.cluster AND m.slot = c.slot"""
TOP_SIMILAR = f"""WITH {_EMB},
q0 AS (SELECT min(vec_id) AS qid FROM embeddings),
q AS (SELECT slot, x AS qx FROM pts WHERE vec_id = (SELECT qid FROM q0)),
qn AS (SELECT sqrt(sum(qx * qx)) AS n FROM q),
sims AS (SELECT p.vec_id, sum(p.x * q.qx) AS dt, sqrt(sum(p.x * p.x)) AS pn
         FROM pts p JOIN q ON p.slot = q.slot WHERE p.vec_id <> (SELECT qid FROM q0) GROUP BY p.vec_id),
sc AS (SELECT vec_id, CASE WHEN pn = 0 OR (SELECT n FROM qn) = 0 THEN 0.0::DOUBLE
                           ELSE dt / ((SELECT n FROM qn) * pn) END AS s FROM sims)
SELECT vec_id, round(s, 9) AS similarity FROM sc ORDER BY s DESC, vec_id LIMIT 5"""

# --- event record lines ----------------------------------------------------
_REST = ",\n".join(f"CAST(event_id % {m} AS DOUBLE) AS {name}" for m, name in zip(
    range(2, 23), ["wrong_fragment", "urgent", "count", "srv_count", "serror_rate", "srv_serror_rate",
                   "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
                   "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
                   "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
                   "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate"]))

_LINES = """
lines AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS line_no, 't' || event_id AS ts,
                 user_id, event_type, value FROM events
          UNION ALL
          SELECT event_id, 1, 't' || event_id || 'b', user_id, event_type, value FROM events
          WHERE event_id % 5 = 0 AND event_id % 23 <> 0)
"""

_RECORD_FIELDS = f"""ts AS "timeStamp", 'u' || user_id AS "srcIp",
event_type AS "desIp", CAST(value AS DOUBLE) AS duration, event_type AS protocol_type,
'svc' || (user_id % 7) AS service, CASE WHEN value > 100 THEN 'S0' ELSE 'SF' END AS flag,
CAST(value * 10 AS DOUBLE) AS src_bytes, CAST(user_id AS DOUBLE) AS dst_bytes,
CASE WHEN user_id % 2 = 0 THEN '0' ELSE '1' END AS land,
{_REST}"""
_RECORD_COLS = f"event_id, CAST(line_no AS INTEGER) AS line_no, {_RECORD_FIELDS}"

PARSE_STRICT = f"WITH {_LINES} SELECT {_RECORD_COLS} FROM lines"
PARSE_LENIENT = f"WITH {_LINES} SELECT {_RECORD_COLS} FROM lines WHERE event_id % 19 <> 0 AND event_id % 17 <> 0"
# the same records after a trip through a message stream (no ids kept)
STREAM_LINES = f"WITH {_LINES} SELECT {_RECORD_FIELDS} FROM lines WHERE event_id % 19 <> 0 AND event_id % 17 <> 0"
PARSE_REJECTS = """SELECT event_id, CAST(line_no AS INTEGER) AS line_no, reason FROM (
  SELECT event_id, 0 AS line_no, 'short' AS reason FROM events WHERE event_id % 23 = 0
  UNION ALL
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END,
         CASE WHEN event_id % 19 = 0 THEN 'short' WHEN event_id % 17 = 0 THEN 'bad_number' END FROM events
  UNION ALL
  SELECT event_id, 1, CASE WHEN event_id % 19 = 0 THEN 'short' WHEN event_id % 17 = 0 THEN 'bad_number' END
  FROM events WHERE event_id % 5 = 0 AND event_id % 23 <> 0) WHERE reason IS NOT NULL"""
EXPLODE_RECORDS = """SELECT event_id, CAST(line_no AS INTEGER) AS line_no, head, CAST(n_fields AS INTEGER) AS n_fields FROM (
  SELECT event_id, 0 AS line_no, '' AS head, 1 AS n_fields FROM events WHERE event_id % 23 = 0
  UNION ALL
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END, 't' || event_id,
         CASE WHEN event_id % 19 = 0 THEN 20 ELSE 31 END FROM events
  UNION ALL
  SELECT event_id, 1, 't' || event_id || 'b', CASE WHEN event_id % 19 = 0 THEN 20 ELSE 31 END
  FROM events WHERE event_id % 5 = 0 AND event_id % 23 <> 0)"""

# --- vector texts ----------------------------------------------------------
_EMB_PTS = """pts AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS slot,
                        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
_SPARSE_X = "CASE WHEN vec_id % 2 = 1 AND abs(x) < 0.05 THEN 0.0::DOUBLE ELSE x END"
PARSE_DENSE_VECTOR = f"WITH {_EMB_PTS} SELECT vec_id, slot, x AS value FROM pts"
PARSE_VECTOR_TEXT = f"WITH {_EMB_PTS} SELECT vec_id, slot, {_SPARSE_X} AS value FROM pts"
PARSE_LABELED_POINT = f"WITH {_EMB_PTS} SELECT vec_id, CAST(label AS DOUBLE) AS label, slot, {_SPARSE_X} AS value FROM pts"
SPLIT_KEY_VECTOR = f"WITH {_EMB_PTS} SELECT vec_id, 't' || vec_id || ' src' || label || ' dst' AS key, slot, x AS value FROM pts"
HOP2_REJECTS = """SELECT vec_id, CASE WHEN vec_id % 7 = 2 THEN 'no_key' ELSE 'bad_vector' END AS reason,
       CASE vec_id % 7 WHEN 0 THEN 'k' || vec_id || ' [1.0,x]' WHEN 1 THEN 'k' || vec_id || ' (3,[5],[1.0])' END AS value
FROM embeddings WHERE vec_id % 7 IN (0, 1, 2)"""
HOP2_VECTORS = SPLIT_KEY_VECTOR + " WHERE vec_id % 7 NOT IN (0, 1, 2)"
FORMAT_VECTOR_MESSAGE = """SELECT vec_id, CAST(4 AS INTEGER) AS n_tokens, 't' || vec_id || ' src' || label || ' dst' AS head,
       CAST(len(embedding) AS INTEGER) AS width FROM embeddings"""
TOKENIZE = """SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token
FROM (SELECT doc_id, string_split(rtrim(text, ' '), ' ') AS t FROM documents)"""
TEXT_SCAN = """SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS line_no, CAST(length(unnest(t)) AS INTEGER) AS n_chars
FROM (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS t FROM documents)"""
_CSV_LABEL = """CASE WHEN l_discount >= 0.06 THEN 'discounted.' WHEN l_quantity >= 40 THEN 'bulk.'
       WHEN l_returnflag = 'R' THEN 'returned.' ELSE 'normal.' END"""
CSV_SCAN = """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_discount >= 0.06 THEN 'discounted.' WHEN l_quantity >= 40 THEN 'bulk.'
       WHEN l_returnflag = 'R' THEN 'returned.' ELSE 'normal.' END AS label
FROM lineitem"""
# the numbers of a spoiled line as Spark writes doubles: small, so plain decimals
CSV_REJECTS = f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN l_orderkey || ',' || l_linenumber || ',' || l_returnflag
  ELSE concat_ws(',', l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, 'n/a', {_CSV_LABEL}) END AS line
FROM lineitem WHERE l_orderkey % 11 = 0 OR l_orderkey % 13 = 0"""
_AUTO_X = "CASE WHEN vec_id % 2 = 1 AND abs(x) < 0.15 THEN 0.0::DOUBLE ELSE x END"
FORMAT_SPARSE_MESSAGE = f"""WITH {_EMB_PTS},
v AS (SELECT vec_id, slot, {_AUTO_X} AS x FROM pts),
f AS (SELECT vec_id, count(*) AS n, 1.5 * (sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END) + 1) < count(*) AS sparse FROM v GROUP BY vec_id)
SELECT vec_id, CASE WHEN sparse THEN 'sparse' ELSE 'dense' END AS form, CAST(n AS INTEGER) AS width, slot, x AS value
FROM v JOIN f USING (vec_id) WHERE NOT sparse OR x <> 0"""

# --- features ----------------------------------------------------------------
SYMBOLIC_CARDINALITY = """
SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS n FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) + max(CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END) FROM lineitem
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) + max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) FROM orders"""
FIRST_N = """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20"""

_IDX = """
rf AS (SELECT l_returnflag AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS DOUBLE) AS idx
       FROM lineitem GROUP BY l_returnflag),
ls AS (SELECT l_linestatus AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS DOUBLE) AS idx
       FROM lineitem GROUP BY l_linestatus),
li AS (SELECT l.*, rf.idx AS rfi, ls.idx AS lsi FROM lineitem l JOIN rf ON l.l_returnflag = rf.v
       JOIN ls ON l.l_linestatus = ls.v)
"""
STRING_INDEX = f"WITH {_IDX} SELECT l_orderkey, l_linenumber, rfi AS l_returnflag_index, lsi AS l_linestatus_index FROM li"
STRING_INDEX_UNSEEN = """WITH ls AS (SELECT l_linestatus AS v,
    CAST(row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS DOUBLE) AS idx FROM lineitem GROUP BY l_linestatus)
SELECT o_orderkey, coalesce(ls.idx, CAST((SELECT count(*) FROM ls) AS DOUBLE)) AS status_index
FROM orders LEFT JOIN ls ON orders.o_orderstatus = ls.v"""
ONE_HOT = f"""WITH {_IDX}
SELECT l_orderkey, l_linenumber, CAST(s.idx AS INTEGER) AS slot,
       CASE WHEN li.rfi = s.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, 'l_returnflag_Vec' AS feature
FROM li JOIN (SELECT idx FROM rf WHERE idx < (SELECT max(idx) FROM rf)) s ON true
UNION ALL
SELECT l_orderkey, l_linenumber, CAST(s.idx AS INTEGER),
       CASE WHEN li.lsi = s.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'l_linestatus_Vec'
FROM li JOIN (SELECT idx FROM ls WHERE idx < (SELECT max(idx) FROM ls)) s ON true"""
INDEX_TO_LABEL = f"""WITH {_IDX}
SELECT li.l_orderkey, li.l_linenumber, r2.v AS next_label
FROM li JOIN rf r2 ON r2.idx = (li.rfi + 1) % (SELECT count(*) FROM rf)"""

# assembler order: l_quantity, l_returnflag_Vec (2), l_extendedprice, l_linestatus_Vec (1), l_discount, l_tax
_FEAT = f"""{_IDX},
feat AS (
  SELECT l_orderkey, l_linenumber, 0 AS slot, CAST(l_quantity AS DOUBLE) AS v FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 1, CASE WHEN rfi = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 2, CASE WHEN rfi = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 3, CAST(l_extendedprice AS DOUBLE) FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 4, CASE WHEN lsi = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 5, CAST(l_discount AS DOUBLE) FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, 6, CAST(l_tax AS DOUBLE) FROM li),
sd AS (SELECT slot, stddev_samp(v) AS s FROM feat GROUP BY slot),
scaled AS (SELECT f.l_orderkey, f.l_linenumber, f.slot,
                  CASE WHEN sd.s = 0 OR sd.s IS NULL THEN 0.0::DOUBLE ELSE f.v * (1.0::DOUBLE / sd.s) END AS v
           FROM feat f JOIN sd ON f.slot = sd.slot)
"""
ASSEMBLE_FEATURES = f"WITH {_FEAT} SELECT l_orderkey, l_linenumber, CAST(slot AS INTEGER) AS slot, round(v, 6) AS value FROM feat"
PIPELINE_FEATURES = f"WITH {_FEAT} SELECT l_orderkey, l_linenumber, CAST(slot AS INTEGER) AS slot, round(v, 6) AS value FROM scaled"
STANDARD_SCALE = """WITH feat AS (
  SELECT l_orderkey, l_linenumber, 0 AS slot, l_quantity AS v FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem),
sd AS (SELECT slot, stddev_samp(v) AS s FROM feat GROUP BY slot)
SELECT f.l_orderkey, f.l_linenumber, CAST(f.slot AS INTEGER) AS slot,
       round(CASE WHEN sd.s = 0 OR sd.s IS NULL THEN 0.0::DOUBLE ELSE f.v * (1.0::DOUBLE / sd.s) END, 6) AS value
FROM feat f JOIN sd ON f.slot = sd.slot"""
def _assemble_stage2() -> str:
    k = S.K_LINEITEM
    f = ["CAST(l_quantity AS DOUBLE)", "CASE WHEN rfi = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
         "CASE WHEN rfi = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "CAST(l_extendedprice AS DOUBLE)",
         "CASE WHEN lsi = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "CAST(l_discount AS DOUBLE)",
         "CAST(l_tax AS DOUBLE)"]
    n = len(f)
    order = ", ".join(S.LI_ORDER)
    feats = ", ".join(f"{e} AS f{i}" for i, e in enumerate(f))
    sds = ", ".join(f"stddev_samp(f{i}) AS s{i}" for i in range(n))
    xs = ", ".join(f"CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 0.0::DOUBLE ELSE f{i} * (1.0::DOUBLE / s{i}) END AS x{i}"
                   for i in range(n))
    cj = ",\n".join(f"c{j} AS (SELECT * FROM ctr WHERE cl = {j})" for j in range(k))
    ds = ", ".join("(" + " + ".join(f"(sc.x{i} - c{j}.x{i}) * (sc.x{i} - c{j}.x{i})" for i in range(n)) + f") AS d{j}"
                   for j in range(k))
    near = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'd{j} <= d{m}' for m in range(j + 1, k))} THEN {j}" for j in range(k - 1)) \
        + f" ELSE {k - 1} END"
    outs = [f"x{i}" for i in range(n)] + [f"d{j}" for j in range(k)] + [f"CAST({near} AS DOUBLE)"]
    unpivot = "\nUNION ALL ".join(f"SELECT l_orderkey, l_linenumber, {i} AS slot, {e} AS v FROM dd"
                                  for i, e in enumerate(outs))
    return f"""WITH {_IDX},
w AS (SELECT {order}, {feats} FROM li),
sd AS (SELECT {sds} FROM w),
sc AS (SELECT w.*, {xs} FROM w, sd),
ctr AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS cl, * FROM sc ORDER BY {order} LIMIT {k}),
{cj},
dd AS (SELECT sc.*, {ds} FROM sc, {", ".join(f"c{j}" for j in range(k))}),
allv AS ({unpivot})
SELECT l_orderkey, l_linenumber, CAST(slot AS INTEGER) AS slot, round(v, 6) AS value FROM allv"""


ASSEMBLE_STAGE2 = _assemble_stage2()
HASH_SPLIT = """SELECT o_orderkey,
  CAST(CASE WHEN (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7))::BIGINT % 10000) < 7000 THEN 0 ELSE 1 END AS INTEGER) AS split
FROM orders"""
ACCURACY = """WITH t AS (SELECT
  CASE WHEN l_discount >= 0.06 THEN 'discounted.' WHEN l_quantity >= 40 THEN 'bulk.'
       WHEN l_returnflag = 'R' THEN 'returned.' ELSE 'normal.' END AS label,
  CASE WHEN l_discount >= 0.06 THEN 'discounted.' WHEN l_quantity >= 45 THEN 'bulk.' ELSE 'normal.' END AS pred
  FROM lineitem)
SELECT round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, count(*) AS n,
       round(1.0::DOUBLE - avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS test_error FROM t"""


# --- streaming k-means: events.value, k = 2, batches event_id % 3 -------------
def _kmeans_cte(c0: float, c1: float, w0: float, w1: float, decay: float, batches: int, batch_expr: str) -> str:
    """Recursive fold of the decayed k-means update (k = 2, one dimension)."""
    return f"""
ev AS (SELECT {batch_expr} AS b, CAST(value AS DOUBLE) AS v FROM events),
st(step, c0, c1, w0, w1) AS (
  SELECT 0, {c0}::DOUBLE, {c1}::DOUBLE, {w0}::DOUBLE, {w1}::DOUBLE
  UNION ALL
  SELECT step + 1,
    CASE WHEN least(u0, u1) < 1e-8 * greatest(u0, u1)
         THEN (CASE WHEN u0 >= u1 THEN (CASE WHEN u0 >= u1 THEN n0 ELSE n1 END) + 1e-14 * greatest(abs(CASE WHEN u0 >= u1 THEN n0 ELSE n1 END), 1)
                    ELSE (CASE WHEN u0 >= u1 THEN n0 ELSE n1 END) - 1e-14 * greatest(abs(CASE WHEN u0 >= u1 THEN n0 ELSE n1 END), 1) END)
         ELSE n0 END,
    CASE WHEN least(u0, u1) < 1e-8 * greatest(u0, u1)
         THEN (CASE WHEN u0 >= u1 THEN (CASE WHEN u0 >= u1 THEN n0 ELSE n1 END) - 1e-14 * greatest(abs(CASE WHEN u0 >= u1 THEN n0 ELSE n1 END), 1)
                    ELSE (CASE WHEN u0 >= u1 THEN n0 ELSE n1 END) + 1e-14 * greatest(abs(CASE WHEN u0 >= u1 THEN n0 ELSE n1 END), 1) END)
         ELSE n1 END,
    CASE WHEN least(u0, u1) < 1e-8 * greatest(u0, u1) THEN (u0 + u1) / 2 ELSE u0 END,
    CASE WHEN least(u0, u1) < 1e-8 * greatest(u0, u1) THEN (u0 + u1) / 2 ELSE u1 END
  FROM (
    SELECT step,
      CASE WHEN m0 > 0 THEN (1.0::DOUBLE - m0 / greatest(d0 + m0, 1e-16)) * c0 + (m0 / greatest(d0 + m0, 1e-16) / m0) * s0 ELSE c0 END AS n0,
      CASE WHEN m1 > 0 THEN (1.0::DOUBLE - m1 / greatest(d1 + m1, 1e-16)) * c1 + (m1 / greatest(d1 + m1, 1e-16) / m1) * s1 ELSE c1 END AS n1,
      d0 + m0 AS u0, d1 + m1 AS u1
    FROM (
      SELECT st.step, st.c0, st.c1, st.w0 * {decay} AS d0, st.w1 * {decay} AS d1,
        CAST((SELECT count(*) FROM ev WHERE ev.b = st.step AND (ev.v - st.c0) * (ev.v - st.c0) <= (ev.v - st.c1) * (ev.v - st.c1)) AS DOUBLE) AS m0,
        CAST((SELECT count(*) FROM ev WHERE ev.b = st.step AND (ev.v - st.c0) * (ev.v - st.c0) > (ev.v - st.c1) * (ev.v - st.c1)) AS DOUBLE) AS m1,
        (SELECT coalesce(sum(ev.v), 0) FROM ev WHERE ev.b = st.step AND (ev.v - st.c0) * (ev.v - st.c0) <= (ev.v - st.c1) * (ev.v - st.c1)) AS s0,
        (SELECT coalesce(sum(ev.v), 0) FROM ev WHERE ev.b = st.step AND (ev.v - st.c0) * (ev.v - st.c0) > (ev.v - st.c1) * (ev.v - st.c1)) AS s1
      FROM st WHERE st.step < {batches})))
"""


_FOLD = _kmeans_cte(0.0, 50.0, 0.0, 0.0, 0.95, S.N_BATCHES, f"event_id % {S.N_BATCHES}")
_UNPIVOT = """SELECT step, 0 AS cluster, w0 AS weight, c0 AS center FROM st
              UNION ALL SELECT step, 1, w1, c1 FROM st"""
STREAM_KMEANS_FOLD = f"""WITH RECURSIVE {_FOLD}
SELECT CAST(cluster AS INTEGER) AS cluster, round(weight, 6) AS weight, round(center, 6) AS center
FROM ({_UNPIVOT}) WHERE step = {S.N_BATCHES}"""
STREAM_KMEANS_WEIGHTS = f"""WITH RECURSIVE {_FOLD}
SELECT CAST(step - 1 AS BIGINT) AS batch, CAST(cluster AS INTEGER) AS cluster, round(weight, 6) AS weight
FROM ({_UNPIVOT}) WHERE step >= 1"""
STREAM_KMEANS_ASSIGN = f"""WITH RECURSIVE {_FOLD}
SELECT e.event_id, CAST(CASE WHEN (e.value - st.c0) * (e.value - st.c0) <= (e.value - st.c1) * (e.value - st.c1)
                        THEN 0 ELSE 1 END AS INTEGER) AS cluster
FROM events e JOIN st ON st.step = e.event_id % {S.N_BATCHES} + 1"""
TWO_HOP_CLUSTER = f"""WITH RECURSIVE {_FOLD}
SELECT 't' || e.event_id || ' u' || e.user_id || ' ' || e.event_type AS key,
       CAST(CASE WHEN (e.value - st.c0) * (e.value - st.c0) <= (e.value - st.c1) * (e.value - st.c1)
            THEN 0 ELSE 1 END AS INTEGER) AS cluster
FROM events e JOIN st ON st.step = e.event_id % {S.N_BATCHES} + 1"""
ASSIGNMENT_LINES = f"SELECT key || ' ' || cluster AS value FROM ({TWO_HOP_CLUSTER})"
_STEP = _kmeans_cte(0.0, 50.0, 1.0, 1.0, 0.5, 1, "0")
STREAM_KMEANS_STEP = f"""WITH RECURSIVE {_STEP}
SELECT CAST(cluster AS INTEGER) AS cluster, round(weight, 6) AS weight, round(center, 6) AS center
FROM ({_UNPIVOT}) WHERE step = 1"""

# --- streaming linear regression: lineitem, 3 features, batches l_orderkey % 3 ---
_LR = f"""
d AS (SELECT l_orderkey % {S.N_BATCHES} AS b, l_quantity / 50.0::DOUBLE AS x0, l_discount * 10.0::DOUBLE AS x1,
             l_tax * 10.0::DOUBLE AS x2, l_extendedprice / 100000.0::DOUBLE AS y FROM lineitem),
sm AS (SELECT b, CAST(count(*) AS DOUBLE) AS n,
              sum(x0 * x0) AS a00, sum(x0 * x1) AS a01, sum(x0 * x2) AS a02,
              sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
              sum(x0 * y) AS y0, sum(x1 * y) AS y1, sum(x2 * y) AS y2 FROM d GROUP BY b),
it(b, i, w0, w1, w2, conv) AS (
  SELECT 0, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false
  UNION ALL
  SELECT CASE WHEN go THEN b ELSE b + 1 END, CASE WHEN go THEN i + 1 ELSE 0 END,
         CASE WHEN go THEN v0 ELSE w0 END, CASE WHEN go THEN v1 ELSE w1 END, CASE WHEN go THEN v2 ELSE w2 END,
         CASE WHEN go THEN i + 1 >= 2 AND sqrt((v0 - w0) * (v0 - w0) + (v1 - w1) * (v1 - w1) + (v2 - w2) * (v2 - w2))
                           < 0.001 * greatest(sqrt(v0 * v0 + v1 * v1 + v2 * v2), 1.0::DOUBLE) ELSE false END
  FROM (
    SELECT it.b, it.i, it.w0, it.w1, it.w2, (NOT it.conv AND it.i < 50 AND sm.n > 0) AS go,
      it.w0 - (0.1::DOUBLE / sqrt(it.i + 1)) * ((sm.a00 * it.w0 + sm.a01 * it.w1 + sm.a02 * it.w2 - sm.y0) / sm.n) AS v0,
      it.w1 - (0.1::DOUBLE / sqrt(it.i + 1)) * ((sm.a01 * it.w0 + sm.a11 * it.w1 + sm.a12 * it.w2 - sm.y1) / sm.n) AS v1,
      it.w2 - (0.1::DOUBLE / sqrt(it.i + 1)) * ((sm.a02 * it.w0 + sm.a12 * it.w1 + sm.a22 * it.w2 - sm.y2) / sm.n) AS v2
    FROM it JOIN sm ON sm.b = it.b)),
fin AS (SELECT w0, w1, w2 FROM it WHERE b = {S.N_BATCHES})
"""
STREAM_LINREG_FOLD = f"""WITH RECURSIVE {_LR}
SELECT CAST(0 AS INTEGER) AS slot, round(w0, 9) AS weight FROM fin
UNION ALL SELECT 1, round(w1, 9) FROM fin UNION ALL SELECT 2, round(w2, 9) FROM fin"""
LINREG_PREDICT = f"""WITH RECURSIVE {_LR}
SELECT l.l_orderkey, l.l_linenumber, round(l.l_extendedprice / 100000.0::DOUBLE, 9) AS label,
       round(fin.w0 * (l.l_quantity / 50.0::DOUBLE) + fin.w1 * (l.l_discount * 10.0::DOUBLE)
             + fin.w2 * (l.l_tax * 10.0::DOUBLE), 9) AS prediction
FROM lineitem l, fin"""

# --- streams ------------------------------------------------------------------
STREAM_KMEANS_PREDICT = f"""WITH RECURSIVE {_FOLD}
SELECT e.event_id, CAST(CASE WHEN (e.value - st.c0) * (e.value - st.c0) <= (e.value - st.c1) * (e.value - st.c1)
                        THEN 0 ELSE 1 END AS INTEGER) AS cluster, CAST(st.step - 1 AS BIGINT) AS version
FROM events e JOIN st ON st.step = CASE WHEN e.event_id % 2 = 0 THEN 1 ELSE {S.N_BATCHES} END"""
STREAM_LINREG_PREDICT = f"""WITH RECURSIVE {_LR},
w AS (SELECT b, w0, w1, w2 FROM it WHERE i = 0)
SELECT round(l.l_extendedprice / 100000.0::DOUBLE, 9) AS label,
       round(w.w0 * (l.l_quantity / 50.0::DOUBLE) + w.w1 * (l.l_discount * 10.0::DOUBLE) + w.w2 * (l.l_tax * 10.0::DOUBLE), 9) AS prediction,
       CAST(w.b - 1 AS BIGINT) AS version
FROM lineitem l JOIN w ON w.b = CASE WHEN l.l_orderkey % 2 = 0 THEN 1 ELSE {S.N_BATCHES} END"""
STREAM_TEXT_VECTORS = f"""WITH {_EMB_PTS},
v AS (SELECT vec_id, slot, {_SPARSE_X} AS x FROM pts)
SELECT CAST(count(*) AS INTEGER) AS n, arg_min(x, slot) AS first, arg_max(x, slot) AS last, CAST(NULL AS VARCHAR) AS line FROM v WHERE vec_id % 7 > 1 GROUP BY vec_id
UNION ALL SELECT NULL, NULL, NULL, CASE vec_id % 7 WHEN 0 THEN '[1.0,x' || vec_id || ']' ELSE '(3,[5],[' || vec_id || '])' END FROM embeddings WHERE vec_id % 7 <= 1"""
STREAM_TEXT_POINTS = f"""WITH {_EMB_PTS}
SELECT vec_id, slot, x AS value, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS reason FROM pts WHERE vec_id % 9 > 1
UNION ALL SELECT NULL, NULL, NULL, CASE vec_id % 9 WHEN 0 THEN '(x' || vec_id || ',[1.0])' ELSE '(' || vec_id || ',[1.0,])' END,
                 CASE vec_id % 9 WHEN 0 THEN 'bad_label' ELSE 'bad_vector' END FROM embeddings WHERE vec_id % 9 <= 1"""
SCORE_STREAM = f"""WITH {_LINES} SELECT ts AS "timeStamp", 'u' || user_id AS "srcIp", event_type AS "desIp", true AS as_in_batch
FROM lines WHERE event_id % 19 <> 0 AND event_id % 17 <> 0"""
TWO_HOP_STREAM = "SELECT 't' || event_id || ' u' || user_id || ' ' || event_type AS key, true AS nearest FROM events"

# --- k-means on the vectors: iterations unrolled -------------------------------
_E = "e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _sq(x: str, c: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {c}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _near(name: str, centers: str, rows: str = "e") -> str:
    """name(vec_id, x, m): m = (squared distance, cluster) of the nearest row of centers(cluster, center)."""
    return f"""{name} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := cluster)) AS m
  FROM (SELECT r.vec_id, r.x, t.cluster, {_sq('r.x', 't.center')} AS d FROM {rows} r, {centers} t) GROUP BY vec_id)"""


def _sums(name: str, near: str) -> str:
    """name(c, n, s): count and slot sums of the rows nearest to each cluster."""
    return f"""{name} AS MATERIALIZED (SELECT c, any_value(n) AS n, list(s ORDER BY slot) AS s FROM (
  SELECT c, slot, sum(v) AS s, count(*) AS n FROM (SELECT m.c AS c, generate_subscripts(x, 1) AS slot, unnest(x) AS v FROM {near}) GROUP BY c, slot) GROUP BY c)"""


def _lloyd(prefix: str, start: str, steps: int) -> tuple[str, str]:
    """CTEs of ``steps`` Lloyd iterations, and the name of the last centres."""
    ctes, old = [], start
    for i in range(steps):
        ctes += [_near(f"{prefix}n{i}", old), _sums(f"{prefix}s{i}", f"{prefix}n{i}"),
                 f"{prefix}c{i} AS MATERIALIZED (SELECT o.cluster, CASE WHEN g.n > 0 THEN list_transform(g.s, lambda v: v / g.n) ELSE o.center END AS center "
                 f"FROM {old} o LEFT JOIN {prefix}s{i} g ON g.c = o.cluster)"]
        old = f"{prefix}c{i}"
    return ",\n".join(ctes), old


def _draw(draw: int) -> str:
    return f"('0x' || substr(md5(vec_id::VARCHAR || '/{draw}/1'), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE"


def _kmeans_fit(k: int, init: int, steps: int) -> str:
    ctes = [_E, f"f0 AS MATERIALIZED (SELECT 0 AS step, vec_id, x FROM e ORDER BY {_draw(0)}, vec_id LIMIT 1)"]
    for r in range(1, init + 1):
        ctes += [f"h{r} AS MATERIALIZED (SELECT e.vec_id, any_value(e.x) AS x, min({_sq('e.x', 't.x')}) AS d FROM e, f{r - 1} t GROUP BY e.vec_id)",
                 f"f{r} AS MATERIALIZED (SELECT * FROM f{r - 1} UNION ALL SELECT {r}, vec_id, x FROM h{r} WHERE {_draw(r)} < {2.0 * k}::DOUBLE * d / (SELECT sum(d) FROM h{r}))"]
    ctes += [f"cand AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY step, vec_id) - 1 AS INTEGER) AS cluster, x AS center FROM f{init})",
             _near("cn", "cand"), "cw AS MATERIALIZED (SELECT cluster, center, count(cn.vec_id) AS w FROM cand LEFT JOIN cn ON cn.m.c = cluster GROUP BY cluster, center)",
             "p0 AS MATERIALIZED (SELECT 0 AS pick, cluster, center FROM cw ORDER BY w DESC, cluster LIMIT 1)"]
    for j in range(1, k):
        ctes += [f"q{j} AS (SELECT cw.cluster, any_value(cw.center) AS center, any_value(w) * min({_sq('cw.center', 't.center')}) AS far FROM cw, p{j - 1} t GROUP BY cw.cluster)",
                 f"p{j} AS MATERIALIZED (SELECT * FROM p{j - 1} UNION ALL (SELECT {j}, cluster, center FROM q{j} WHERE far > 0 ORDER BY far DESC, cluster LIMIT 1))"]
    ctes.append(f"start AS MATERIALIZED (SELECT CAST(pick AS INTEGER) AS cluster, center FROM p{k - 1})")
    iterations, last = _lloyd("l", "start", steps)
    ctes += [iterations, _near("final", last)]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, m.c AS cluster, round(m.d, 6) AS cost FROM final"


def _elbow(ks: list[int], steps: int) -> str:
    ctes, out = [_E], []
    for k in ks:
        p = f"k{k}"
        iterations, last = _lloyd(p, f"{p}start", steps)
        ctes += [f"{p}start AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x AS center FROM e ORDER BY vec_id LIMIT {k})",
                 iterations, _near(f"{p}f", last), _sums(f"{p}g", f"{p}f"),
                 f"{p}q AS (SELECT m.c AS c, sum(list_sum(list_transform(x, lambda v: v * v))) AS q FROM {p}f GROUP BY m.c)",
                 f"{p}m AS MATERIALIZED (SELECT c, n, list_transform(s, lambda v: v / n) AS mean, q / n - list_sum(list_transform(s, lambda v: (v / n) * (v / n))) AS spread FROM {p}g JOIN {p}q USING (c))",
                 f"{p}d AS (SELECT f.vec_id, f.m.c AS own, f.m.d AS cost, t.c, t.n, {_sq('f.x', 't.mean')} + t.spread AS d FROM {p}f f, {p}m t)",
                 f"{p}s AS (SELECT vec_id, any_value(cost) AS cost, max(CASE WHEN c = own THEN n END) AS n, max(CASE WHEN c = own THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> own THEN d END) AS b FROM {p}d GROUP BY vec_id)"]
        out.append(f"SELECT CAST({k} AS INTEGER) AS k, round(sum(cost), 6) AS wssse, round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM {p}s")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(out)


def _random_centers(k: int, seed: int) -> str:
    def uniform(at: int) -> str:
        return f"(('0x' || substr(md5(cluster || '/' || slot || '/{seed}'), {at}, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE)"

    return f"""WITH {_E},
r AS (SELECT cluster, slot, sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform(1)})) * cos(2.0::DOUBLE * pi() * {uniform(14)}) AS v
      FROM (SELECT unnest(range({k})) AS cluster), (SELECT unnest(range((SELECT max(len(x)) FROM e))) AS slot)),
c AS MATERIALIZED (SELECT CAST(cluster AS INTEGER) AS cluster, list(v ORDER BY slot) AS center FROM r GROUP BY cluster),
{_near("f", "c")}
SELECT vec_id, m.c AS cluster, round(m.d, 6) AS cost FROM f"""


def _kmeans_fold_embeddings(k: int, batches: int, decay: float) -> str:
    """The decayed update with its split of a dying cluster, batch after batch."""
    ctes = [_E, f"t0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x AS center, 0.0::DOUBLE AS weight FROM e ORDER BY vec_id LIMIT {k})"]
    out = []
    for b in range(batches):
        ctes += [f"e{b} AS MATERIALIZED (SELECT * FROM e WHERE vec_id % {batches} = {b})", _near(f"n{b}", f"t{b}", f"e{b}"), _sums(f"s{b}", f"n{b}"),
                 f"""u{b} AS MATERIALIZED (SELECT t.cluster, t.weight * {decay}::DOUBLE + coalesce(g.n, 0) AS weight,
  CASE WHEN g.n > 0 THEN list_transform(list_zip(t.center, g.s), lambda p: (1.0::DOUBLE - g.n / greatest(t.weight * {decay}::DOUBLE + g.n, 1e-16::DOUBLE)) * p[1]
       + (g.n / greatest(t.weight * {decay}::DOUBLE + g.n, 1e-16::DOUBLE) / g.n) * p[2]) ELSE t.center END AS center
  FROM t{b} t LEFT JOIN s{b} g ON g.c = t.cluster)""",
                 f"hi{b} AS (SELECT * FROM u{b} ORDER BY weight DESC, cluster LIMIT 1)", f"lo{b} AS (SELECT * FROM u{b} ORDER BY weight, cluster LIMIT 1)",
                 f"""t{b + 1} AS MATERIALIZED (SELECT u.cluster,
  CASE WHEN l.weight < 1e-8 * h.weight AND u.cluster = h.cluster THEN list_transform(h.center, lambda v: v + 1e-14 * greatest(abs(v), 1.0))
       WHEN l.weight < 1e-8 * h.weight AND u.cluster = l.cluster THEN list_transform(h.center, lambda v: v - 1e-14 * greatest(abs(v), 1.0)) ELSE u.center END AS center,
  CASE WHEN l.weight < 1e-8 * h.weight AND u.cluster IN (h.cluster, l.cluster) THEN (h.weight + l.weight) / 2 ELSE u.weight END AS weight
  FROM u{b} u, hi{b} h, lo{b} l)"""]
        out.append(f"SELECT CAST({b} AS BIGINT) AS batch, cluster, round(weight, 6) AS weight, CAST(generate_subscripts(center, 1) - 1 AS INTEGER) AS slot, round(unnest(center), 6) AS value FROM t{b + 1}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(out)


KMEANS_FIT = _kmeans_fit(S.K_EMBED, 2, 20)
ELBOW_SWEEP = _elbow([2, 3, 4, 5, 6], 5)
RANDOM_CENTERS = _random_centers(30, 7)
KMEANS_FOLD_EMBEDDINGS = _kmeans_fold_embeddings(S.K_EMBED, S.N_BATCHES, 0.9)

LINREG_EMBEDDINGS = f"""WITH RECURSIVE {_E},
p AS (SELECT vec_id % {S.N_BATCHES} AS b, vec_id, label / 10.0::DOUBLE + (vec_id % 7) / 20.0::DOUBLE AS y, generate_subscripts(x, 1) AS slot, unnest(x) AS v FROM e),
col AS MATERIALIZED (SELECT b, slot, list(v ORDER BY vec_id) AS vs, list(y ORDER BY vec_id) AS ys FROM p GROUP BY b, slot),
sm AS MATERIALIZED (SELECT b, any_value(n) AS n, list(row ORDER BY i) AS xx, list(xy ORDER BY i) AS xy FROM (
  SELECT l.b, l.slot AS i, any_value(len(l.ys))::DOUBLE AS n, list(list_dot_product(l.vs, r.vs) ORDER BY r.slot) AS row, any_value(list_dot_product(l.vs, l.ys)) AS xy
  FROM col l JOIN col r ON r.b = l.b GROUP BY l.b, l.slot) GROUP BY b),
it(b, i, w, conv) AS (
  SELECT 0, 0, (SELECT list_transform(any_value(x), lambda v: 0.0::DOUBLE) FROM e), false
  UNION ALL
  SELECT CASE WHEN go THEN b ELSE b + 1 END, CASE WHEN go THEN i + 1 ELSE 0 END, CASE WHEN go THEN v ELSE w END,
         CASE WHEN go THEN i + 1 >= 2 AND sqrt({_sq('v', 'w')}) < 0.001 * greatest(sqrt(list_dot_product(v, v)), 1.0::DOUBLE) ELSE false END
  FROM (SELECT it.b, it.i, it.w, (NOT it.conv AND it.i < 50) AS go,
               list_transform(list_zip(it.w, sm.xx, sm.xy), lambda p: p[1] - (0.1::DOUBLE / sqrt(it.i + 1)) * ((list_dot_product(p[2], it.w) - p[3]) / sm.n)) AS v
        FROM it JOIN sm ON sm.b = it.b))
SELECT CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS slot, round(unnest(w), 9) AS weight FROM it WHERE b = {S.N_BATCHES}"""

# --- forest: levels unrolled ------------------------------------------------------
def _forest(trees: int, depth: int, bins: int, seed: int, what: str) -> str:
    features = S.LI_NUMERIC
    width, size = len(features), forest.subset_size(len(features), trees)
    label = "CASE WHEN l_discount >= 0.06 THEN 1 WHEN l_quantity >= 40 THEN 0 WHEN l_returnflag = 'R' THEN 3 ELSE 2 END"
    draw = "('0x' || substr(md5(l_orderkey || '-' || l_linenumber || '/{t}/{seed}'), 1, 13))::BIGINT::DOUBLE / {whole}::DOUBLE"
    weights = []
    for t in range(trees):
        u = draw.format(t=t, seed=seed, whole=1 << 52)
        weights.append("(" + " + ".join(f"({u} >= {end!r}::DOUBLE)::INTEGER" for end in forest.POISSON) + ")" if trees > 1 else "1")
    cut = "(lo{i} + (hi{i} - lo{i}) * {j} / {bins}::DOUBLE)"
    ctes = ["mm AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS lo{i}, max({c})::DOUBLE AS hi{i}" for i, c in enumerate(features)) + " FROM lineitem)",
            "b AS MATERIALIZED (SELECT l_orderkey, l_linenumber, " + label + " AS y, "
            + ", ".join(f"len(list_filter(range(1, {bins}), lambda j: {cut.format(i=i, j='j', bins=bins)} < {c})) AS f{i}" for i, c in enumerate(features)) + ", "
            + ", ".join(f"{w} AS w{t}" for t, w in enumerate(weights)) + " FROM lineitem, mm)"]
    out, routed = [], []
    for t in range(trees):
        rows = f"r{t}_0"
        ctes.append(f"{rows} AS (SELECT *, 1 AS node FROM b)")
        for level in range(depth):
            moves = []
            for n in range(1 << level, 2 << level):
                p = f"t{t}n{n}"
                stacked = " UNION ALL ".join(f"SELECT {f} AS f, f{f} AS bin, y, w{t} AS w FROM {rows} WHERE node = {n}" for f in forest.node_features(t, n, width, size, seed))
                ctes += [f"{p}h AS (SELECT f, bin, y, sum(w)::DOUBLE AS c FROM ({stacked}) GROUP BY ALL)",
                         f"{p}g AS (SELECT f, j, y, sum(CASE WHEN bin <= j THEN c ELSE 0 END) AS l, sum(c) AS a FROM {p}h, (SELECT unnest(range({bins - 1})) AS j) GROUP BY ALL)",
                         f"{p}s AS (SELECT f, j, sum(l * l) / sum(l) + sum((a - l) * (a - l)) / sum(a - l) AS score, sum(a) AS w, sum(a * a) AS s FROM {p}g GROUP BY f, j HAVING sum(l) > 0 AND sum(a - l) > 0)",
                         f"{p} AS MATERIALIZED (SELECT f, j, score / w - s / (w * w) AS gain FROM {p}s WHERE score > s / w ORDER BY score DESC, f, j LIMIT 1)"]
                value = "CASE f " + " ".join(f"WHEN {i} THEN {cut.format(i=i, j='(j + 1)', bins=bins)}" for i in range(width)) + " END"
                out.append(f"SELECT {t}::INTEGER AS tree, {n}::INTEGER AS node, f::INTEGER AS feature, round({value}, 6) AS threshold, round(gain, 9) AS gain FROM {p}, mm")
                bin_of = f"CASE (SELECT f FROM {p}) " + " ".join(f"WHEN {i} THEN f{i}" for i in range(width)) + " END"
                moves.append(f"WHEN node = {n} AND (SELECT count(*) FROM {p}) = 1 THEN {2 * n} + ({bin_of} > (SELECT j FROM {p}))::INTEGER")
            new = f"r{t}_{level + 1}"
            ctes.append(f"{new} AS MATERIALIZED (SELECT * EXCLUDE (node), CASE {' '.join(moves)} ELSE node END AS node FROM {rows})")
            rows = new
        ctes += [f"leaf{t} AS MATERIALIZED (SELECT node, [{', '.join(f'(sum(CASE WHEN y = {y} THEN w{t} ELSE 0 END)::DOUBLE / sum(w{t}))' for y in range(4))}] AS p FROM {rows} GROUP BY node)"]
        routed.append(rows)
    if what == "splits":
        return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(out)
    # the trees' rows are the rows of b in each, joined by what routes them
    ctes.append("grid AS MATERIALIZED (SELECT DISTINCT " + ", ".join(f"f{i}" for i in range(width)) + " FROM b)")
    same = " AND ".join(f"x.f{i} = grid.f{i}" for i in range(width))
    ctes.append("shares AS MATERIALIZED (SELECT grid.*, list_transform(list_zip(" + ", ".join(f"(SELECT any_value(p) FROM {r} x JOIN leaf{t} USING (node) WHERE {same})" for t, r in enumerate(routed))
                + "), lambda p: " + " + ".join(f"p[{t + 1}]" for t in range(trees)) + ") AS p FROM grid)")
    names = "['bulk.', 'discounted.', 'normal.', 'returned.']"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT l_orderkey, l_linenumber, {names}[list_position(p, list_max(p))] AS predicted FROM b JOIN shares USING ({', '.join(f'f{i}' for i in range(width))})"


FOREST_SPLITS = _forest(3, 2, 16, 1, "splits")
FOREST_PREDICT = _forest(3, 2, 16, 1, "predict")

# --- text -----------------------------------------------------------------
_TOKENS = "(SELECT unnest(string_split(rtrim(text, ' '), ' ')) AS token FROM documents)"
VOCABULARY = f"SELECT token AS word, count(*) AS n FROM {_TOKENS} GROUP BY token HAVING count(*) >= 5"
WORD2VEC_FIT = f"SELECT token AS word FROM {_TOKENS} GROUP BY token HAVING count(*) >= 5"

WORD_VECTORS = f"SELECT token AS word, 100::INTEGER AS width, true AS finite, true AS moved FROM {_TOKENS} GROUP BY token HAVING count(*) >= 5"

ORACLES = {
    "nearest_center": NEAREST_CENTER,
    "distance_to_centers": DISTANCE_TO_CENTERS,
    "wssse": WSSSE,
    "cluster_cost": CLUSTER_COST,
    "lloyd_step": LLOYD_STEP,
    "top_similar": TOP_SIMILAR,
    "csv_scan": CSV_SCAN,
    "text_scan": TEXT_SCAN,
    "explode_records": EXPLODE_RECORDS,
    "parse_strict": PARSE_STRICT,
    "parse_lenient": PARSE_LENIENT,
    "parse_rejects": PARSE_REJECTS,
    "stream_lines": STREAM_LINES,
    "stream_union": STREAM_LINES,
    "parse_dense_vector": PARSE_DENSE_VECTOR,
    "parse_vector_text": PARSE_VECTOR_TEXT,
    "parse_labeled_point": PARSE_LABELED_POINT,
    "format_vector_message": FORMAT_VECTOR_MESSAGE,
    "split_key_vector": SPLIT_KEY_VECTOR,
    "hop2_rejects": HOP2_REJECTS,
    "hop2_vectors": HOP2_VECTORS,
    "tokenize": TOKENIZE,
    "symbolic_cardinality": SYMBOLIC_CARDINALITY,
    "symbolic_cardinality_approx": SYMBOLIC_CARDINALITY,
    "first_n": FIRST_N,
    "string_index": STRING_INDEX,
    "string_index_unseen": STRING_INDEX_UNSEEN,
    "one_hot": ONE_HOT,
    "index_to_label": INDEX_TO_LABEL,
    "assemble_features": ASSEMBLE_FEATURES,
    "standard_scale": STANDARD_SCALE,
    "pipeline_features": PIPELINE_FEATURES,
    "model_roundtrip": PIPELINE_FEATURES,
    "assemble_stage2": ASSEMBLE_STAGE2,
    "hash_split": HASH_SPLIT,
    "accuracy": ACCURACY,
    "stream_kmeans_step": STREAM_KMEANS_STEP,
    "stream_kmeans_fold": STREAM_KMEANS_FOLD,
    "stream_kmeans_weights": STREAM_KMEANS_WEIGHTS,
    "stream_kmeans_assign": STREAM_KMEANS_ASSIGN,
    "stream_kmeans_stream": STREAM_KMEANS_ASSIGN,
    "two_hop_cluster": TWO_HOP_CLUSTER,
    "assignment_lines": ASSIGNMENT_LINES,
    "stream_linreg_fold": STREAM_LINREG_FOLD,
    "stream_linreg_stream": STREAM_LINREG_FOLD,
    "linreg_predict": LINREG_PREDICT,
    "forest_splits": FOREST_SPLITS,
    "forest_predict": FOREST_PREDICT,
    "kmeans_fit": KMEANS_FIT,
    "elbow_sweep": ELBOW_SWEEP,
    "random_centers": RANDOM_CENTERS,
    "kmeans_fold_embeddings": KMEANS_FOLD_EMBEDDINGS,
    "linreg_embeddings": LINREG_EMBEDDINGS,
    "csv_rejects": CSV_REJECTS,
    "format_sparse_message": FORMAT_SPARSE_MESSAGE,
    "weight_lines": STREAM_KMEANS_WEIGHTS,
    "stream_kmeans_predict": STREAM_KMEANS_PREDICT,
    "stream_linreg_predict": STREAM_LINREG_PREDICT,
    "stream_text_vectors": STREAM_TEXT_VECTORS,
    "stream_text_points": STREAM_TEXT_POINTS,
    "score_stream_as_batch": SCORE_STREAM,
    "two_hop_nearest": TWO_HOP_STREAM,
    "word2vec_fit": WORD2VEC_FIT,
    "word_vectors": WORD_VECTORS,
    "vocabulary": VOCABULARY,
}
