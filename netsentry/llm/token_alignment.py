"""Alignment of two tokenizers, with link counts by external spill counting.

Each text is encoded by a byte-level BPE (A) and by a SentencePiece model (B). Byte offsets where
tokens of both end cut them into groups; an A and a B token whose bytes overlap are a link. How often each pair of
ids is linked in the whole corpus is counted out of memory, and every document gets the counts of its own links:

1. A task cuts its texts at spaces that follow something else, where a token of both sides always ends, aligns
   each different piece once, and makes of a batch of documents a *run* of records (pair, document, number), sorted by
   pair with the B side major. Runs are radix-partitioned by B id, compressed by zstd and written below
   the shared folder.
2. The pairs of a partition's runs, each with its sum over the documents of a run, go to one
   task, which merges the runs by a k-way heap. Equal pairs follow each other and give the count; all pairs of a B id
   follow each other and give its highest count. While merging, (count, is highest) is streamed back
   into one answer for each run, in the order of the run's own pairs.
3. Answer and run meet again; the counts of the pairs are added up for the run's documents.

So only one record for each pair of a batch is dealt by pair, however hot the pair is, and what a task
of step 2 holds is the compressed runs of one partition as arrays (partitions grow in number with the text, up to one for
each B id).

Defined results: null and empty texts, and texts whose joined tokens of A or of B differ from a space and the text,
have no tokens: zeros, and '' as digest. Very long texts are used whole; repeated rows and null
ids give a row each; an empty table gives an empty one. All columns but the text pass; a column that already bears the name of a
result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.llm.common import regroup, release, staged
from netsentry.llm.token_automaton import SPACE, ByteBpe, byte_bpe

RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PART_BITS = 26  # a partition of pairs for every 2 ** PART_BITS bytes of text
BATCH = 4 << 20  # bytes of Arrow data whose texts make a run
MAX_WORDS = 1 << 17  # words whose A ids are remembered per worker


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def cumulated(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] steps, then the same for start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class PieceSide:
    """A SentencePiece model that adds a space in front and never joins a space to what stands before it."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode("a b") != self.model.encode("a") + self.model.encode("b"):
            raise ValueError("this model's pieces go over spaces")
        self.size = n
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of text that begin with a space each (the one that the model adds)."""
        ids = self.model.encode([p[1:].decode("utf-8") for p in pieces], num_threads=1)
        return [i if len(p) > 1 else [self.space] for i, p in zip(ids, pieces)]


@dataclass
class Aligned:
    """Aligned pieces of text. A piece whose tokens' bytes are not its own is not ``sound`` and has no tokens."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray  # pair numbers of all pieces, one after the other
    groups: list[bytes]  # the groups of each piece as text, each group with a semicolon after it


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a: ByteBpe = byte_bpe(a_path)
        self.a.max_words = MAX_WORDS
        self.b = PieceSide(b_path)
        self.n_a = len(self.a.automaton.labels)
        self.a_size = np.array([len(x or b"") for x in self.a.automaton.labels])
        self.b_size = np.array([len(x) for x in self.b.bytes])
        numbers = [b"%d," % i for i in range(max(self.n_a, self.b.size))]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.number_size = np.fromiter(map(len, numbers), np.int64)
        self.number_at = np.cumsum(self.number_size) - self.number_size

    def cuts(self, data: bytes, segments: np.ndarray) -> np.ndarray:
        """Where the pieces begin: at segments, and at spaces after something that is no white space."""
        self.a.splitter.starts(data, segments)  # makes the classes of all characters known
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.a.splitter.kind[cp]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.cumsum(width) - width
        inner = byte[1:][(kind[1:] == SPACE) & (kind[:-1] < SPACE)]
        return np.union1d(inner, segments)

    def align(self, pieces: list[bytes]) -> Aligned:
        a_ids, a_at = self.a.encode(pieces, specials=False)
        b_lists = self.b.encode(pieces) if pieces else []
        b_bytes = self.b.bytes.__getitem__
        sound = np.fromiter((b"".join(map(b_bytes, ids)) == p for ids, p in zip(b_lists, pieces)), bool, len(pieces))
        n_a = np.where(sound, np.diff(a_at), 0)
        n_b = np.where(sound, np.fromiter(map(len, b_lists), np.int64, len(pieces)), 0)
        b_at = cumulated(n_b)
        b_ids = np.fromiter(chain.from_iterable(ids for ids, ok in zip(b_lists, sound) if ok), np.int64, int(b_at[-1]))
        begin = cumulated(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        a_end = np.cumsum(self.a_size[a_ids])  # pieces lie one after the other, as their A tokens do
        kept = np.repeat(sound, np.diff(a_at))
        a_ids, a_end, a_at = a_ids[kept].astype(np.int64), a_end[kept], cumulated(n_a)
        a_begin = a_end - self.a_size[a_ids]
        size = self.b_size[b_ids]
        inside = cumulated(size)
        b_begin = inside[:-1] - np.repeat(inside[b_at[:-1]] - begin[:-1], n_b)
        b_end = b_begin + size
        first = np.searchsorted(b_end, a_begin, "right")
        links = np.searchsorted(b_begin, a_end, "left") - first
        pairs = b_ids[spread(first, links)] * self.n_a + np.repeat(a_ids, links)
        a_cut, b_cut = np.isin(a_end, b_end), np.isin(b_end, a_end)  # the last tokens of groups
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        n = int(a_cut.sum())
        of_a, of_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        at = cumulated(of_a + of_b)[:-1]
        token = np.zeros(len(a_ids) + len(b_ids), np.int64)
        token[at[a_group] + np.arange(len(a_ids)) - cumulated(of_a)[a_group]] = a_ids
        token[(at + of_a)[b_group] + np.arange(len(b_ids)) - cumulated(of_b)[b_group]] = b_ids
        shown = cumulated(self.number_size[token])
        text = self.digits[spread(self.number_at[token], self.number_size[token])]
        text[shown[at + of_a] - 1] = ord("|")
        text[shown[at + of_a + of_b] - 1] = ord(";")
        data, bounds = text.tobytes(), shown[a_at + b_at].tolist()
        return Aligned(sound, n_a, n_b, np.diff(cumulated(a_cut)[a_at]), np.diff(cumulated(links)[a_at]), pairs,
                       [data[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned_batches(batches: Iterable[pa.RecordBatch], text: str, a_path: str, b_path: str):
    """(rows, texts' own pieces as numbers and where they begin, alignment of each different piece)."""
    side = aligner(a_path, b_path)
    for rows in regroup(batches, rows=1 << 16, size=BATCH, column=text):
        texts = [b" " + t if t else b"" for t in rows[text].cast(pa.binary()).to_pylist()]
        data = b"".join(texts)
        begin = cumulated(np.fromiter(map(len, texts), np.int64, len(texts)))
        start = side.cuts(data, np.unique(begin[:-1][np.diff(begin) > 0])) if data else np.zeros(0, np.int64)
        offsets = pa.array(np.append(start, len(data)), pa.int64())
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, offsets.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
        yield rows, coded.indices.to_numpy(), np.searchsorted(start, begin), side.align(coded.dictionary.to_pylist())


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", out: str = "groups") -> DataFrame:
    """``docs`` with ``out``, the groups of each text as ``a1,a2|b1;a3|b2,b3`` (ids in order; null: no tokens)."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, code, at, found in aligned_batches(batches, text, a_path, b_path):
            groups = []
            for lo, hi in zip(at[:-1], at[1:]):
                groups.append(b"".join([found.groups[c] for c in code[lo:hi].tolist()])[:-1].decode() if hi > lo and found.sound[code[lo:hi]].all() else None)
            yield from rows.append_column(out, pa.array(groups, pa.string())).combine_chunks().to_batches()

    return docs.select(*(f.name for f in schema if f.name != out)).mapInArrow(run, schema)


def _runs(kept: T.StructType, text: str, a_path: str, b_path: str, parts: int):
    """Batches of documents to a row for each document (part -1) and one for each partition's part of the batch's run."""
    own = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (rows, code, at, found) in enumerate(aligned_batches(batches, text, a_path, b_path)):
            yield from write(task + k, rows, code, at, found)
            del rows, code, at, found
            release()

    def write(number: int, rows: pa.Table, code: np.ndarray, at: np.ndarray, found: Aligned) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        good = (np.diff(cumulated(~found.sound[code])[at]) == 0) & (np.diff(at) > 0)
        doc = np.repeat(np.arange(n), np.diff(at))
        kept = good[doc]
        code_of, doc = code[kept], doc[kept]
        at_of = np.searchsorted(doc, np.arange(n + 1))
        sums = [np.diff(cumulated(each[code_of])[at_of]) for each in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        size = found.n_links
        links = size[code_of]
        text_of = found.groups.__getitem__
        digest = [hashlib.sha256(b"".join(map(text_of, code[lo:hi].tolist()))[:-1]).hexdigest() if ok else "" for ok, lo, hi in zip(good, at[:-1], at[1:])]
        head = pa.Table.from_arrays(
            [*(rows[c] for c in own), pa.array(np.full(n, number)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
             *(pa.array(s) for s in sums), pa.array(digest, pa.string()), *(pa.nulls(n, pa.binary()) for _ in range(5))],
            [*own, "run", "part", "idx", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "sums", "spans", "docs", "times"])
        yield from head.combine_chunks().to_batches()
        key = found.links[spread((np.cumsum(size) - size)[code_of], links)] << 16 | np.repeat(doc, links)
        key, times = np.unique(key, return_counts=True)
        pair = key >> 16
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(first):
            return
        span = np.diff(np.append(first, len(pair)))
        total = np.add.reduceat(times, first)
        pairs, docs = pair[first], (key & 0xFFFF).astype(np.uint16)
        part = pairs // n_a % parts
        rest = {f.name: [] for f in head.schema}
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            records = spread(first[mine], span[mine])
            for name, value in zip(("run", "part", "pairs", "sums", "spans", "docs", "times"),
                                   (number, p, pack(pairs[mine]), pack(total[mine]), pack(span[mine].astype(np.uint32)), pack(docs[records]), pack(times[records].astype(np.uint32)))):
                rest[name].append(value)
        m = len(rest["run"])
        yield pa.RecordBatch.from_arrays([pa.array(rest[f.name] or [None] * m, f.type) for f in head.schema], schema=head.schema)

    n_a = len(byte_bpe(a_path).automaton.labels)
    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], n_a: int) -> list[tuple[list[int], list[bool]]]:
    """Runs of (sorted pairs, sums) to the answers (count of each pair, is it its B id's highest), by a k-way heap merge."""
    counts: list[list[int]] = [[] for _ in runs]
    best: list[list[bool]] = [[] for _ in runs]
    pending: list[tuple[int, list[int]]] = []  # (count, runs that hold it) of the pairs of the B id being read

    def stream(k: int) -> Iterator[tuple[int, int, int]]:
        pairs, sums = runs[k]
        for lo in range(0, len(pairs), 4096):
            yield from zip(pairs[lo:lo + 4096].tolist(), repeat(k), sums[lo:lo + 4096].tolist())

    def answer() -> None:
        top = max(total for total, _ in pending)
        for total, holders in pending:
            for k in holders:
                counts[k].append(total)
                best[k].append(total == top)
        pending.clear()

    last, total, holders = -1, 0, []
    for pair, k, n in heapq.merge(*map(stream, range(len(runs)))):
        if pair != last:
            if holders:
                pending.append((total, holders))
                if pair // n_a != last // n_a:
                    answer()
            last, total, holders = pair, 0, []
        total += n
        holders.append(k)
    if holders:
        pending.append((total, holders))
        answer()
    return list(zip(counts, best))


def _answers(n_a: int):
    """Rows (part, run, pairs, sums), sorted by part, to rows (part, run, counts, best)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and held:
                    yield answered(part, held)
                    held = []
                part = row["part"]
                held.append((row["run"], unpack(row["pairs"], np.int64), unpack(row["sums"], np.int64)))
        if held:
            yield answered(part, held)
        del held
        release()

    def answered(part: int, held: list) -> pa.RecordBatch:
        out = merge_runs([(p, s) for _, p, s in held], n_a)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(held), pa.int32()), pa.array([r for r, _, _ in held], pa.int64()), pa.array([pack(np.array(c, np.int64)) for c, _ in out], pa.binary()),
             pa.array([pack(np.packbits(b)) for _, b in out], pa.binary())], ["part", "run", "counts", "best"])

    return run


def _contributions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run and answer to rows (run, idx, n_best, count_sum), one for each document of the run's part."""
    for batch in batches:
        for row in batch.to_pylist():
            counts, spans = unpack(row["counts"], np.int64), unpack(row["spans"], np.uint32).astype(np.int64)
            docs, times = unpack(row["docs"], np.uint16), unpack(row["times"], np.uint32).astype(np.int64)
            best = np.unpackbits(unpack(row["best"], np.uint8), count=len(counts)).astype(np.int64)
            weight = np.repeat(counts, spans) * times
            low = np.bincount(docs, weight & ((1 << 26) - 1)).astype(np.int64)  # exact: both halves stay below 2 ** 53
            total = low + (np.bincount(docs, weight >> 26).astype(np.int64) << 26)
            highest = np.bincount(docs, np.repeat(best, spans) * times).astype(np.int64)
            idx = np.unique(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), row["run"])), pa.array(idx.astype(np.int32)), pa.array(highest[idx]), pa.array(total[idx])],
                                             ["run", "idx", "n_best", "count_sum"])
    release()


def score_alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", part_bits: int = PART_BITS) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B
    id, ties included), count_sum (of the counts of all links) and groups_sha256 (of ``align_texts``' groups)."""
    kept = T.StructType([f for f in docs.schema if f.name != text and f.name not in RESULT])
    plain = T.StructType([T.StructField(f"_{k}", f.dataType) for k, f in enumerate(kept)])
    docs = docs.select(*(F.col(f.name).alias(p.name) for f, p in zip(kept, plain)), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_a = len(byte_bpe(a_path).automaton.labels)
    parts = min(max(8, size >> part_bits), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    schema = T.StructType([*plain, *T._parse_datatype_string(
        "run long, part int, idx int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, sums binary, spans binary, docs binary, times binary")])
    rows = staged(docs.mapInArrow(_runs(plain, "text", a_path, b_path, parts), schema), "alignment-runs")
    runs = rows.where(F.col("part") >= 0)
    answers = runs.select("part", "run", "pairs", "sums").repartition("part").sortWithinPartitions("part", "run").mapInArrow(
        _answers(n_a), "part int, run long, counts binary, best binary")
    met = runs.select("part", "run", "spans", "docs", "times").join(answers, ["part", "run"])
    sums = met.mapInArrow(_contributions, "run long, idx int, n_best long, count_sum long").groupBy("run", "idx").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    heads = rows.where(F.col("part") < 0).drop("part", "pairs", "sums", "spans", "docs", "times")
    out = heads.join(sums, ["run", "idx"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select(*(F.col(p.name).alias(f.name) for f, p in zip(kept, plain)), *RESULT)
