"""Repeated-substring removal by hash winnowing with induced marking.

Every byte that lies in a ``LENGTH``-byte string which also starts anywhere else
(any document, any place) is found, whatever the size of the corpus.

Sampling. A position is an anchor if the key of the ``GRAM`` bytes from it is the
least of some window of LENGTH - GRAM + 1 neighbouring positions. Equal
LENGTH-byte strings have their anchors at equal offsets, so equal strings are found by
grouping the anchors, 1-2 % of all positions, by 64-bit keys. No suffix is sorted, no
common-prefix value is made, and bytes are not compared directly. Which strings repeat is
then induced from the anchors to all positions in two levels:

1. Anchors with equal bytes on both sides, as far as any string through the
   anchor can reach, repeat in whole: (key, surroundings) is counted, and the whole
   stretch is marked. No bytes are moved.
2. At the borders of repeats, surroundings differ. For those anchors (those whose
   key repeats, with other surroundings) the bytes around are fetched, and the keys of all
   LENGTH-byte strings through the anchor are compared, offset by offset, within the
   anchors of equal key.

The grouping is Spark's shuffle, which spills to disk. Counts are partial aggregates, so
a passage that a third of all documents hold costs a row per task. A key with
over ``HOT`` different surroundings is not gathered in a task: its strings are
counted as rows (key, offset, string key). Removed runs come back to a document
as a few pairs of numbers.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH lose
nothing; one document's own repeats and overlapping ones count; repeated rows are
documents of their own (so they repeat each other); an empty table gives an empty
table; columns not named here are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import mix, regroup, release, set_aside, staged, utf8

LENGTH = 200
GRAM = 64
HOT = 16_384
SLICE_ROWS = 2048
BROADCAST_MB = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


class Stretch:
    """Keys of any stretches of some bytes, from one cumulative sum."""

    def __init__(self, data: np.ndarray):
        powers = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * powers, dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(len(data) + 1, _INVERSE)

    def keys(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours (van Herk's two sweeps)."""
    if width == 1:
        return a
    n = len(a) - width + 1
    rows = -(-len(a) // width)
    fill = np.uint64(0) if pick is np.maximum else np.uint64(2 ** 64 - 1)
    block = np.full(rows * width, fill, np.uint64)
    block[:len(a)] = a
    block = block.reshape(rows, width)
    ahead = pick.accumulate(block, axis=1).reshape(-1)
    back = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[width - 1:width - 1 + n])


def anchors_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, key, left reach, right reach, key of the surroundings) of the
    anchors of one text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    w = length - gram + 1
    s = Stretch(np.frombuffer(data, np.uint8))
    at = np.arange(n - gram + 1)
    key = np.maximum(s.keys(at, at + gram), np.uint64(1))
    least = sliding(key, w, np.minimum)  # of the window from each start
    wide = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    wide[w - 1:w - 1 + len(least)] = least
    pos = np.flatnonzero(sliding(wide, w, np.maximum) == key)
    left, right = np.minimum(pos, w - 1), np.minimum(n - pos, length)
    around = mix(s.keys(pos - left, pos + right) + left.astype(np.uint64) * np.uint64(1 << 32) + right.astype(np.uint64))
    return pos, key[pos], left, right, around


def anchor_rows(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in regroup(batches, 512, 2 << 20):
        out = [[] for _ in range(6)]
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            pos, key, left, right, around = anchors_of(utf8(text), length, gram)
            for column, x in zip(out, (np.full(len(pos), doc, np.int64), pos, left, right, key.view(np.int64), around.view(np.int64))):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()])],
                                         names=["row", "pos", "lft", "rgt", "key", "around"])


def string_keys(bytes_: list[bytes], left: np.ndarray, right: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor and offset (its distance from the string's start): the string's
    key, and whether the string lies within the text."""
    m = np.zeros((len(bytes_), reach + length), np.uint64)
    for k, (b, lf) in enumerate(zip(bytes_, left.tolist())):
        m[k, reach - lf:reach - lf + len(b)] = _SYMBOL[np.frombuffer(b, np.uint8)]
    sums = np.zeros((len(bytes_), reach + length + 1), np.uint64)
    np.cumsum(m * _powers(reach + length), axis=1, dtype=np.uint64, out=sums[:, 1:])
    offset = np.arange(reach + 1)
    start = reach - offset
    keys = sums[:, start + length] - sums[:, start]  # at one offset the powers are the same: keys compare
    return keys, (offset <= left[:, None]) & (length - offset <= right[:, None])


def offset_runs(flags: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, past-last byte) of the runs of marked offsets."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, pos[row] - (past - 1), pos[row] - first + length


def border_runs(key: np.ndarray, row: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, bytes_: list[bytes],
                length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked stretches of anchors with equal keys and different surroundings."""
    strings, inside = string_keys(bytes_, left, right, length, reach)
    at, offset = np.nonzero(inside)
    name = mix(strings[at, offset] + mix(key[at].view(np.uint64) + offset.astype(np.uint64) * _BASE))
    _, back, n = np.unique(name, return_inverse=True, return_counts=True)
    flags = np.zeros(inside.shape, bool)
    flags[at, offset] = n[back] > 1
    r, lo, hi = offset_runs(flags, pos, length)
    return row[r], lo, hi


def merge_runs(runs: list[tuple[int, int]]) -> list[int]:
    """Overlapping and touching stretches as one: flat [first, past-last ...]."""
    out: list[int] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def with_small(big: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int = 64) -> DataFrame:
    """``big`` joined to ``small``: broadcast if its counted size is within the
    bound, else an ordinary join."""
    return big.join(F.broadcast(small) if small.count() * row_bytes <= BROADCAST_MB << 20 else small, on, how)


_RUN = "row long, lo long, hi long"


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(``row``, ``runs``) for each row of ``docs`` (``row``, ``text``) that holds a repeat:
    maximal runs of repeated bytes, flat [first, past-last ...]."""
    spark, reach = docs.sparkSession, length - gram
    anchors = staged(docs.select("row", "text").mapInArrow(lambda b: anchor_rows(b, length, gram), "row long, pos int, lft int, rgt int, key long, around long"), "anchors")
    keys = (anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("around").alias("x"), F.max("around").alias("y")).where("n > 1")
            .select("key", (F.col("x") != F.col("y")).alias("mixed")))
    shared = staged(anchors.join(keys, "key"), "shared")
    classes = staged(shared.groupBy("key", "around", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos", "lft", "rgt")).alias("one")), "classes")
    whole = (shared.join(classes.where("n > 1").select("key", "around"), ["key", "around"], "left_semi")
             .select("row", (F.col("pos") - F.col("lft")).cast("long").alias("lo"), (F.col("pos") + F.col("rgt")).cast("long").alias("hi")))
    # Borders: one anchor of each class of a key that has several.
    borders = classes.where("mixed").select("one.row", F.struct("key", "one.pos", "one.lft", "one.rgt").alias("a"))
    per_row = staged(borders.groupBy("row").agg(F.collect_list("a").alias("marks")), "borders")
    crowded = staged(classes.where("mixed").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("crowded")), "crowded")
    fetched = with_small(docs.select("row", "text"), per_row, "row", "inner", 512)

    def fetch(batches):
        for part in regroup(batches, 256, 2 << 20):
            rows = [(r, m["key"], m["pos"], m["lft"], m["rgt"], data[m["pos"] - m["lft"]:m["pos"] + m["rgt"]])
                    for r, t, ms in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), part.column("marks").to_pylist())
                    for data in [utf8(t)] for m in ms]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                             names=["row", "key", "pos", "lft", "rgt", "data"])

    pieces = staged(fetched.select("row", "text", "marks").mapInArrow(fetch, "row long, key long, pos int, lft int, rgt int, data binary"), "pieces")
    tagged = pieces.join(F.broadcast(crowded) if crowded.count() < 100_000 else crowded, "key", "left")
    tasks = int(pieces.count() // 50_000) + int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbers(t: pa.Table) -> list[np.ndarray]:
        return [t.column(c).to_numpy().astype(np.int64) for c in ("key", "row", "pos", "lft", "rgt")]

    def compare(batches):
        """Rows come sorted by key; a slice ends where a key ends."""
        held: list[pa.Table] = []

        def done(t: pa.Table):
            row, lo, hi = border_runs(*numbers(t), t.column("data").to_pylist(), length, reach)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, lo, hi)], names=["row", "lo", "hi"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) < SLICE_ROWS:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = t.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            lo = 0
            for c in cuts:
                if c - lo >= SLICE_ROWS:
                    yield done(t.slice(lo, c - lo))
                    lo = c
            last = cuts[-1]
            if lo < last:
                yield done(t.slice(lo, last - lo))
            held = [t.slice(last)]
            del t
            release()
        if held:
            yield done(pa.concat_tables(held).combine_chunks())
        del held
        release()

    inner = (tagged.where("crowded is null").select("key", "row", "pos", "lft", "rgt", "data").repartition(tasks, "key")
             .sortWithinPartitions("key").mapInArrow(compare, _RUN))
    found = whole.unionByName(inner)
    if not crowded.isEmpty():
        def strings(batches):
            for b in batches:
                for lo in range(0, b.num_rows, SLICE_ROWS):
                    t = pa.Table.from_batches([b.slice(lo, SLICE_ROWS)])
                    key, row, pos, left, right = numbers(t)
                    names, inside = string_keys(t.column("data").to_pylist(), left, right, length, reach)
                    at, offset = np.nonzero(inside)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], offset, names[at, offset].view(np.int64), row[at], pos[at] - offset)],
                                                     names=["key", "off", "name", "row", "lo"])

        each = tagged.where("crowded").select("key", "row", "pos", "lft", "rgt", "data").mapInArrow(strings, "key long, off long, name long, row long, lo long")
        twice = each.groupBy("key", "off", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        found = found.unionByName(each.join(twice, ["key", "off", "name"]).select("row", "lo", (F.col("lo") + length).alias("hi")))

    def merge(batches):
        for b in batches:
            runs = [merge_runs([(x["lo"], x["hi"]) for x in xs]) for xs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(pa.int64()))], names=["row", "runs"])

    return found.distinct().groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("all")).mapInArrow(merge, "row long, runs array<long>")


def kept_bytes(data: bytes, runs: list[int] | None) -> bytes:
    runs = runs or []
    return b"".join(data[lo:hi] for lo, hi in zip([0, *runs[1::2]], [*runs[::2], len(data)]))


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number of each row: its id where ids are given once, as
    they should be; repeated and null ids get numbers of their own below zero."""
    ids = docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1)
    if ids.isEmpty() and docs.where(F.col(key).isNull() | (F.col(key) < 0)).limit(1).isEmpty():
        return docs.withColumn("row", F.col(key).cast("long"))
    return staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    source = numbered(docs.select(F.col(key), F.col(text).cast("string").alias("text")), key)
    runs = staged(repeated_runs(source, length, gram), "runs")
    joined = with_small(source, runs, "row", "left", 96).select(F.col(key).alias("doc_id"), "text", "runs")

    def report(batches):
        for part in regroup(batches, 1024, 4 << 20):
            data = [utf8(t) for t in part.column("text").to_pylist()]
            runs_ = [r or [] for r in part.column("runs").to_pylist()]
            kept = [kept_bytes(d, r) for d, r in zip(data, runs_)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), *(pa.array(x, pa.int64()) for x in ([len(d) for d in data], [len(d) - len(k) for d, k in zip(data, kept)], [len(r) // 2 for r in runs_])),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("doc_id", key)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without the repeated bytes of its texts; characters cut in part go
    whole, ``n_chars`` is counted anew (null texts and their counts stay null).
    Every other column stays, whatever its name."""
    docs, back = set_aside(docs, "doc_id", "text", "n_chars")
    names = docs.columns
    full = numbered(docs, "doc_id")
    runs = staged(repeated_runs(full.select("row", "text"), length, gram), "runs").withColumnRenamed("runs", "_runs")
    joined = with_small(full, runs, "row", "left", 96).select(*names, "_runs")

    def cut(batches):
        for part in regroup(batches, 1024, 4 << 20):
            out = [t if not r else kept_bytes(utf8(t), r).decode("utf-8", "ignore") for t, r in zip(part.column("text").to_pylist(), part.column("_runs").to_pylist())]
            columns = {n: part.column(n).combine_chunks() for n in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return back(joined.mapInArrow(cut, docs.schema))
