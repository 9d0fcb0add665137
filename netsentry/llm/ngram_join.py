"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A text is its set of distinct word shingles. Two sets of Jaccard similarity t
or more share at least t times the shingles of either, so a set's partners stand
in at least T = ceil(t * size) of its shingles' inverted lists.

1. Lists. Shingle keys are dealt by their leading bits; a bucket sees every
   posting of its shingles and so knows each list's exact length. Postings travel
   as packed arrays (about 5 bytes each). Lists of one document are dropped.
2. Short lists. A set with fewer than T shared shingles has no partner. Of the
   others, the (shared - T + 1) shingles with the shortest lists are its short
   lists: any partner stands in at least one of them. Documents joined by short
   lists form candidate groups (connected components; found with a star per
   list, never with pairs; first within a task, then between the tasks' components).
3. Search. Groups that hold several different sets are searched with DivideSkip:
   the short lists are heap-merged with skips, the long ones are probed by binary
   search for the merge's survivors, and the exact similarity decides. A document
   needs one link to each component it touches, so the merge also skips over
   members of components it is already linked to.
4. Classes. Links and equal sets are joined to connected components.

Scale: equal sets are searched as one. A group of over ``GROUP`` sets is dealt into
chunks that meet pairwise, so a task holds a bounded number of sets. No pair is
written but links, and of those a spanning forest. Keys are 64-bit; the buckets use
32 bits beside the bucket's number, which can only add candidates.

Defined results: null, empty and word-free texts have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle; very long texts
are used whole; repeated rows each get their row; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsentry.llm.common import mix, regroup, release, shingle_set, staged, utf8, word_hashes
from netsentry.llm.components import components

GROUP = 1024
BUCKET_TEXT = 8 << 20
POST_TEXT = 2 << 20  # bytes of text whose postings are made at once
BROADCAST_ROWS = 500_000
MU = 0.01

_MAPPED = "kind int, bucket int, doc_id long, n long, k1 long, k2 long, data binary"
_NAMES = ["kind", "bucket", "doc_id", "n", "k1", "k2", "data"]


def planes(a: np.ndarray) -> bytes:
    """An array's bytes, the first of every value, then the second ...: what is
    alike in sorted values stands together and compresses."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: bytes, at: int, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *map(planes, arrays)])


def unpack_arrays(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds):
        out.append(unplanes(data, at, n, kind))
        at += n * np.dtype(kind).itemsize
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's sorted shingle keys; words are split at ASCII white space."""
    split = [utf8(t).lower().split() for t in texts]
    hashes = word_hashes([w for ws in split for w in ws])
    end = np.cumsum([len(ws) for ws in split])
    return [shingle_set(hashes[e - len(ws):e], width) for ws, e in zip(split, end.tolist())]


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    both = np.array([np.bitwise_xor.reduce(mix(s)), s.sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)
    return tuple(mix(both).view(np.int64).tolist())


def least_overlap(n, num: int, den: int):
    """T: the fewest common shingles of a set of ``n`` and any partner."""
    return -(-num * n // den)


def post(batches: Iterable[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row per document (kind 0), and packed postings per bucket (kind 1)."""
    for part in regroup(batches, size=POST_TEXT):
        ids = part.column(0).to_pylist()
        sets = shingle_sets(part.column(1).to_pylist(), width)
        keys = [set_keys(s) if len(s) else (None, None) for s in sets]
        rows = [(0, 0, i, len(s), *k, None) for i, s, k in zip(ids, sets, keys)]
        # Of equal sets the smallest id is posted: the smallest of all rows, which names the set, always is.
        least = {k: d for d, k in sorted(enumerate(keys), key=lambda x: ids[x[0]] or 0, reverse=True) if k[0] is not None and ids[d] is not None}
        chosen = sorted(least.values())
        doc = np.array([ids[d] for d in chosen], np.int64)
        size = np.array([len(sets[d]) for d in chosen], np.uint32)
        key = np.concatenate([sets[d] for d in chosen]) if chosen else np.zeros(0, np.uint64)
        idx = np.repeat(np.arange(len(chosen), dtype=np.uint16), size)
        order = np.argsort(key, kind="stable")
        key, idx = key[order], idx[order]
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        short = (key >> np.uint64(32 - bits)).astype(np.uint32)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
            # only the documents that occur in the slice go with it
            own, number = np.unique(idx[lo:hi], return_inverse=True)
            rows.append((1, int(bucket[lo]), None, None, None, None, pack_arrays(doc[own], size[own], short[lo:hi], number.astype(np.uint16))))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(
            (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=_NAMES)


def measure_lists(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of the buckets dealt to a task: list lengths; the postings of lists of two
    and more, packed per group of documents (kind 1). Other rows pass."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        t = pa.Table.from_batches([b])
        kind = t.column("kind").to_numpy()
        yield from t.filter(pa.array(kind == 0)).to_batches()
        for k, d in zip(t.column("bucket").to_numpy()[kind == 1].tolist(), t.column("data").filter(pa.array(kind == 1)).to_pylist()):
            held.setdefault(k, []).append(d)
    while held:
        bucket, blobs = held.popitem()
        docs, sizes, keys = [], [], []
        for data in blobs:
            doc, size, key, idx = unpack_arrays(data, np.int64, np.uint32, np.uint32, np.uint16)
            docs.append(doc[idx])
            sizes.append(size[idx])
            keys.append(key)
        doc, size, key = map(np.concatenate, (docs, sizes, keys))
        order = np.argsort(key, kind="stable")
        doc, size, key = doc[order], size[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(begin, len(key)))
        length = np.repeat(length, length)
        two = length > 1
        doc, size, key, length = doc[two], size[two], key[two], np.minimum(length[two], 65535).astype(np.uint16)
        to = (mix(doc) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(doc), np.int64)
        order = np.lexsort((doc, to))
        doc, size, key, length, to = doc[order], size[order], key[order], length[order], to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        data = []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(to)]):
            d, at, n = np.unique(doc[lo:hi], return_index=True, return_counts=True)
            data.append(np.int64(bucket).tobytes() + pack_arrays(d, size[lo:hi][at], n.astype(np.uint32), key[lo:hi], length[lo:hi]))
        none = [None] * len(data)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(data), pa.int32()), pa.array(to[cut], pa.int32()), *(pa.array(none, pa.int64()) for _ in range(4)),
                                          pa.array(data, pa.binary())], names=_NAMES)
        release()
        del blobs, docs, sizes, keys, doc, size, key, length, order, to, data
    release()


def short_lists(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(list, document) for the short lists of documents that can have partners."""
    docs, sizes, keys, lengths, buckets = [], [], [], [], []
    for b in batches:
        for data in b.column(b.schema.get_field_index("data")).to_pylist():
            d, s, n, key, length = unpack_arrays(data[8:], np.int64, np.uint32, np.uint32, np.uint32, np.uint16)
            docs.append(np.repeat(d, n))
            sizes.append(np.repeat(s, n))
            keys.append(key)
            lengths.append(length)
            buckets.append(np.full(len(key), np.frombuffer(data, np.int64, 1)[0]))
    if not docs:
        return
    doc, size, key, length, bucket = map(np.concatenate, (docs, sizes, keys, lengths, buckets))
    order = np.lexsort((key, bucket, length, doc))
    doc, size, name = doc[order], size[order].astype(np.int64), (bucket[order] << 32) | key[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    shared = np.diff(np.append(begin, len(doc)))
    take = np.repeat(shared - least_overlap(size[begin], num, den) + 1, shared)
    rank = np.arange(len(doc)) - np.repeat(begin, shared)
    keep = rank < take
    name, doc = name[keep], doc[keep]
    del order, size, key, length, bucket, docs, sizes, keys, lengths, buckets
    yield from stars(name, doc)
    release()


def stars(name: np.ndarray, doc: np.ndarray, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (list, a, b). The lists of a task join its documents to components: a row (-1, document, root) for each document that is
    no root, and for the other tasks a row (list, root, root) for each list."""
    if not len(name):
        return
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    docs, number = np.unique(doc, return_inverse=True)
    low = np.repeat(number[begin], np.diff(np.append(begin, len(name))))
    forest = _Forest(len(docs))
    edges = np.unique(number.astype(np.int64)[number != low] * len(docs) + low[number != low])
    for e in edges.tolist():
        forest.join(*divmod(e, len(docs)))
    root = docs[np.array([forest.find(x) for x in range(len(docs))], np.int64)]
    a, b = docs[root != docs], root[root != docs]
    of_list = root[number[begin]]
    names = np.concatenate([np.full(len(a), -1), name[begin]])
    a, b = np.concatenate([a, of_list]), np.concatenate([b, of_list])
    for lo in range(0, len(names), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + step]) for x in (names, a, b)], names=["name", "a", "b"])


class _Forest:
    """Components of the documents of one search."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def merge_skip(lists: list[list[int]], need: int, skip) -> Iterator[tuple[int, int]]:
    """(number, lists that hold it) of the numbers in at least ``need`` of the
    sorted lists, ascending. ``skip(x)``: the first number from x on that is
    still of interest."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapify(heap)

    def advance(k: int, to: int) -> None:
        at[k] = bisect_left(lists[k], to, at[k])
        if at[k] < len(lists[k]):
            heappush(heap, (lists[k][at[k]], k))

    while len(heap) >= need:
        x = heap[0][0]
        popped = []
        if (to := skip(x)) == x:
            while heap and heap[0][0] == x:
                popped.append(heappop(heap)[1])
            if len(popped) >= need:
                yield x, len(popped)
                to = x + 1
            else:  # x fails; so does every number below the head that would make up the need
                for _ in range(min(need - 1 - len(popped), len(heap))):
                    popped.append(heappop(heap)[1])
                to = max(x + 1, heap[0][0]) if heap else x + 1
        else:
            while heap and heap[0][0] < to:
                popped.append(heappop(heap)[1])
        for k in popped:
            advance(k, to)


def divide_skip(sets: list[np.ndarray], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets. ``side``: with two
    sides, sets meet those of the other side only."""
    order = sorted(range(len(sets)), key=lambda d: (side[d], len(sets[d]), d))
    two = len(set(side)) > 1
    index: dict[int, list[int]] = {}
    forest, links = _Forest(len(order)), []
    size = [len(sets[d]) for d in order]
    for x, d in enumerate(order):
        keys = sets[d].tolist()
        if not two or side[d] == max(side):
            lists = sorted((index[k] for k in keys if k in index), key=len)
            lowest = least_overlap(size[x], num, den)
            if len(lists) >= lowest:
                long = min(lowest - 1, int(lowest / (MU * log2(len(lists[-1]) + 1) + 1)))
                near, far = lists[:len(lists) - long], lists[len(lists) - long:][::-1]

                def skip(y: int) -> int:
                    own = forest.find(x)
                    while y < x and forest.find(y) == own:
                        y += 1
                    return y

                for y, seen in merge_skip(near, lowest - long, skip):
                    left = len(far)
                    for ls in far:
                        if seen + left < lowest:
                            break
                        left -= 1
                        k = bisect_left(ls, y)
                        seen += k < len(ls) and ls[k] == y
                    if seen + left >= lowest and den * seen >= num * (size[x] + size[y] - seen):
                        forest.join(x, y)
                        links.append((d, order[y]))
        if not two or side[d] == min(side):
            for k in keys:
                index.setdefault(k, []).append(x)
    return links


def similar_groups(docs: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of each document; documents
    link when den * common >= num * all of their shingles."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (int(total) // BUCKET_TEXT).bit_length())
    parts = 1 << bits
    mapped = source.mapInArrow(lambda b: post(b, width, bits), _MAPPED)
    # A bucket's rows meet; document rows are spread by their id.
    dealt = mapped.repartition(parts, F.when(F.col("kind") == 1, F.col("bucket")).otherwise(F.xxhash64("doc_id") % 1_000_003))
    lists = staged(dealt.mapInArrow(lambda b: measure_lists(b, bits), _MAPPED), "lists")
    known = lists.where("kind = 0").select("doc_id", "n", "k1", "k2")
    near = staged(lists.where("kind = 1").select("bucket", "data").repartition(parts, "bucket")
                  .mapInArrow(lambda b: short_lists(b, num, den), "name long, a long, b long"), "short")

    # A list holds one row for each task; two roots are joined once, however many lists they share.
    wide = near.where("name >= 0").select("a", F.min("a").over(Window.partitionBy("name")).alias("b")).where("a <> b").distinct()
    groups = staged(components(near.where("name < 0").select("a", "b").unionByName(wide)), "groups")
    reps = known.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    # One document of each different set is searched.
    several = staged(groups.join(reps.select(F.col("rep").alias("node")).distinct(), "node"), "searched")
    sizes = several.groupBy("component").agg(F.count("*").alias("sets")).where("sets > 1")
    wanted = several.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", F.ceil(F.col("sets") / GROUP).cast("int").alias("chunks"))
    small = wanted.count() <= BROADCAST_ROWS
    chosen = source.join(F.broadcast(wanted) if small else wanted, "doc_id")

    def cut(batches):
        for part in regroup(batches):
            sets = shingle_sets(part.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks() for c in ("component", "doc_id", "chunks")]
                                             + [pa.array([s.tobytes() for s in sets], pa.binary())], names=["component", "doc_id", "chunks", "data"])

    sets = chosen.mapInArrow(cut, "component long, doc_id long, chunks int, data binary")
    met = (sets.withColumn("side", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "data"))

    def search(t: pa.Table) -> pa.Table:
        ids, side = t.column("doc_id").to_pylist(), t.column("side").to_pylist()
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        found = divide_skip([np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()], side if two else [0] * len(ids), num, den)
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})

    comp = components(met.groupBy("component", "i", "j").applyInArrow(search, "a long, b long"))
    classes = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return (known.join(classes, ["k1", "k2"], "left")
            .select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group. Rows that repeat the id
    kept stay with it; rows without an id stay. Every column stays, whatever its name."""
    found = similar_groups(docs, width, num, den)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
