"""Benchmark decontamination: Wu-Manber search for all windows of the test
items, over word ids.

A pattern is a window of 10 consecutive words of an item (a shorter item is
one pattern). Patterns of one length are searched together: a shift table
over two-word blocks says how far a cursor may jump, a block with shift 0
opens the bucket of the patterns that end in it, and the words are compared
directly. Many cursors, each on its own stretch of the text, advance in step
as one numpy array.

Documents are read once, in Arrow batches, and are never shuffled. The items
go to the tasks in shards of at most ``SHARD_BYTES`` of text, measured before:
a larger benchmark makes several shards, searched one after the other with the
hits joined, so no task ever holds more than one shard's tables.

Defined results: null and empty texts have no words and no hits; items that
are null, empty or without words match nothing; equal windows of several items
count for each; repeated rows each get their row; empty tables give empty or
unhit results; columns not named here are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import regroup, set_aside, staged, utf8

WINDOW = 10
SHARD_BYTES = 1 << 20
STRETCH = 512
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and characters above ASCII."""
    return utf8(text).lower().translate(_WORD_BYTES).split()


class Patterns:
    """The windows of some items, by length, with Wu-Manber tables."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            m = min(window, len(seq))
            for lo in range(len(seq) - m + 1 if m else 0):
                owners.setdefault(tuple(seq[lo:lo + m]), set()).add(item)
        self.classes = [_LengthClass([p for p in owners if len(p) == m], len(self.ids) + 1)
                        for m in sorted({len(p) for p in owners})]
        self.owners = owners

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words; 0 for those that no item has."""
        return np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))

    def search(self, ids: np.ndarray) -> list[tuple[int, int, np.ndarray, list]]:
        """Of each length: (length, first word positions, pattern numbers, patterns)."""
        return [(c.m, *c.search(ids), c.patterns) for c in self.classes]


class _LengthClass:
    """Patterns of one length ``m``; blocks are ``b`` words (2, or 1 if m is 1)."""

    def __init__(self, patterns: list[tuple[int, ...]], base: int):
        self.m, self.b, self.base = len(patterns[0]), min(2, len(patterns[0])), base
        rows = np.array(patterns, np.int64)
        shift: dict[int, int] = {}
        for end in range(self.b - 1, self.m):
            for key in np.unique(self._block(rows, end)).tolist():
                shift[key] = self.m - 1 - end  # later blocks overwrite: the least shift stays
        self.keys = np.array(sorted(shift), np.int64)
        self.shift = np.array([shift[k] for k in self.keys.tolist()], np.int64)
        last = np.searchsorted(self.keys, self._block(rows, self.m - 1))
        order = np.argsort(last, kind="stable")
        self.rows, self.patterns = rows[order], [patterns[k] for k in order.tolist()]
        self.bucket = np.searchsorted(last[order], np.arange(len(self.keys) + 1))

    def _block(self, x: np.ndarray, end: int) -> np.ndarray:
        return x[..., end] if self.b == 1 else x[..., end - 1] * self.base + x[..., end]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (start, pattern) of the sequence."""
        starts, found = [], []
        at = np.arange(0, max(0, len(ids) - self.m + 1), STRETCH) + self.m - 1
        stop = np.minimum(at + STRETCH, len(ids))
        while len(at):
            key = ids[at] if self.b == 1 else ids[at - 1] * self.base + ids[at]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[slot] == key
            step = np.where(known, self.shift[slot], self.m - self.b + 1)
            here = np.flatnonzero(step == 0)
            if len(here):
                lo, hi = self.bucket[slot[here]], self.bucket[slot[here] + 1]
                which = np.repeat(np.arange(len(here)), hi - lo)
                pattern = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
                end = at[here][which]
                same = np.ones(len(which), bool)
                for k in range(self.m):
                    same[same] = ids[end[same] - k] == self.rows[pattern[same], self.m - 1 - k]
                starts.append(end[same] - self.m + 1)
                found.append(pattern[same])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(found)) if starts else (none, none)


def hits_of(texts: list[str | None], patterns: Patterns, before: list[list[int]] | None = None) -> tuple[list[int], list[int], list[list[int]], list[list[str]]]:
    """Per text: words, words inside an occurrence, the runs of such words
    (flat list of first, past-last), items that occur. ``before``: runs found
    with other items, joined to these."""
    words: list[bytes] = []
    begin, size = [], []
    for text in texts:
        w = words_of(text)
        begin.append(len(words))
        size.append(len(w))
        words += w
        words.append(b"")  # no item has it: occurrences never cross documents
    begin_ = np.array(begin, np.int64)
    delta = np.zeros(len(words) + 1, np.int64)
    for d, runs in enumerate(before or []):
        delta[[begin[d] + x for x in runs[::2]]] += 1
        delta[[begin[d] + x for x in runs[1::2]]] -= 1
    items: list[set[str]] = [set() for _ in texts]
    for m, start, pattern, rows in patterns.search(patterns.word_ids(words)):
        np.add.at(delta, start, 1)
        np.add.at(delta, start + m, -1)
        doc = np.searchsorted(begin_, start, "right") - 1
        for d, p in set(zip(doc.tolist(), pattern.tolist())):
            items[d] |= patterns.owners[rows[p]]
    inside = np.diff(np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]]))
    first, past = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    doc = np.searchsorted(begin_, first, "right") - 1
    runs: list[list[int]] = [[] for _ in texts]
    for d, lo, hi in zip(doc.tolist(), first.tolist(), past.tolist()):
        runs[d] += [lo - begin[d], hi - begin[d]]
    n_hit = np.bincount(doc, past - first, len(texts)).astype(np.int64).tolist() if len(texts) else []
    return size, n_hit, runs, [sorted(x) for x in items]


def benchmark_shards(benchmark: DataFrame, item: str, text: str, shard_bytes: int):
    """The items as broadcasts of about ``shard_bytes`` of text each, made one
    by one as they are asked for."""
    tests = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null and id is not null")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(total) // shard_bytes
    for k in range(n):
        rows = [(r[0], r[1]) for r in tests.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).collect()]
        yield k == n - 1, benchmark.sparkSession.sparkContext.broadcast(rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
               item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of any
    window), ``hit_runs`` (first and past-last word of each run) and
    ``hit_items`` (sorted ids, as strings, of items with an occurrence).
    Columns of ``docs`` with these names are replaced."""
    extra = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_runs": pa.list_(pa.int64()), "hit_items": pa.list_(pa.string())}
    docs = docs.drop(*extra)
    names, at = docs.columns, docs.columns.index(text)
    out = docs
    for last, shard in benchmark_shards(benchmark, item, item_text, shard_bytes):
        def run(batches: Iterable[pa.RecordBatch], shard=shard, again=len(out.columns) > len(names)) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(shard.value, window)
            for part in regroup(batches, column=text):
                n_words, n_hit, runs, items = hits_of(part.column(at).to_pylist(), patterns, part.column("hit_runs").to_pylist() if again else None)
                if again:
                    items = [sorted({*x, *y}) for x, y in zip(part.column("hit_items").to_pylist(), items)]
                made = [pa.array(x, t) for x, t in zip((n_words, n_hit, runs, items), extra.values())]
                kept = [c.combine_chunks() for c in part.columns[:len(names)]]
                yield pa.RecordBatch.from_arrays(kept + made, names=[*names, *extra])

        schema = docs.select("*", *(F.lit(None).cast("long").alias(x) for x in ("n_words", "n_hit")),
                            F.lit(None).cast("array<long>").alias("hit_runs"), F.lit(None).cast("array<string>").alias("hit_items")).schema
        out = out.mapInArrow(run, schema)
        out = out if last else staged(out, "decontaminate")  # one shard's tables in a task at a time
    return out


def leak_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the production query."""
    return found.select(key, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark:
    one pass, no join. Every column stays, whatever its name; null and empty texts stay."""
    plain, back = set_aside(docs, "text")
    return back(find_leaks(plain, benchmark, window).where("n_hit = 0"))
