"""Word vectors without a vocabulary on the driver.

The library's Word2Vec (``operators.text``) collects the vocabulary and broadcasts both weight
matrices. Here words, pairs and weights are tables in the shared folder, dealt to shards by a hash of the word, and
no task holds more than two shards:

1. The text is kept as pieces of at most ``WORDS_AT_ONCE`` words: the words of a piece once, and codes for their places. The words are counted
   from the pieces; those that occur ``min_count`` times get a row in their shard, and the codes are exchanged for these rows.
2. Each task counts the pairs of words up to ``window`` apart within its sentences, a pair at distance d
   with weight ``(window - d + 1) / window`` (what a window of random width expects), each unordered pair once. Pairs go to the block (shard of the
   one, shard of the other) and are summed there, as differences of sorted numbers, so that a pair takes a few bytes of a shuffle or file.
3. Blocks (i, i + s) for one s share no shard, so they are trained at the same time, one job of one task each, by skip-gram with negative sampling:
   batches of pairs in a drawn order, negatives drawn from the block's own context shard by count ** 0.75, steps scaled per word (Adagrad),
   so that a pair's summed weight can be used at once. A block reads its two shards' files and its pairs as they lie, without a shuffle, and
   writes the shards anew; the files before are deleted then. So the disk holds the weights once, and a second time only those of the
   blocks in work (``_at_once``); a lost executor costs a block, a lost driver the fit.

The start of a vector is drawn from a hash of its word and all draws are seeded by epoch and block, so a fit
depends on the seed and the number of shards only. Words are what ``tokens`` holds; null sentences and null words are
left out; an empty corpus gives no vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsentry.functions import vectors as V
from netsentry.session import scratch_path
from netsentry.sources import fs

BATCH = 4096  # pairs whose gradients are taken together
WORDS_AT_ONCE = 1 << 20  # words of whole sentences whose pairs are counted together in a task
PAIRS_A_ROW = 1 << 16
WORDS_A_ROW = 256
#: Text some lists at a time: the words that occur with their counts, each place's word (from 1; 0 for a null) and the lists' lengths.
PIECES = "piece long, words array<string>, counts array<bigint>, many long, codes binary, lists long, sizes binary"
#: Pairs of a block in order, as differences of ``row of the one * width + row of the other``, with whole weights (times the window).
PAIRS = "a int, b int, n long, width long, keys binary, weights binary"
#: What a block reads and writes: rows ``at`` and following of the words' own vectors (part own) or of their vectors as contexts (part context), ``of`` in the
#: shard, with the squares their steps are scaled by; or its pairs (part pairs), ``of`` their width.
PARTS = "part string, at long, n long, of long, one binary, two binary, words array<string>, counts array<bigint>"
#: For the jobs of a fit: what they shuffle goes when they end, large rows are handed over some at a time, own vectors and contexts are written without a sort.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.maxConcurrentOutputFileWriters": "2"}


def _some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """The lists some at a time: up to ``WORDS_AT_ONCE`` words, or one list."""
    for batch in batches:
        lists = batch.column(0).drop_null()
        ends = lists.offsets.to_numpy()[1:] if len(lists) else np.zeros(0, np.int64)
        lo, begin = 0, lists.offsets[0].as_py() if len(lists) else 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, begin + WORDS_AT_ONCE, side="right")))
            yield lists.slice(lo, hi - lo)
            lo, begin = hi, int(ends[hi - 1])


def _sentences(size: np.ndarray, longest: int) -> np.ndarray:
    """A number for each word, alike for the words of one sentence."""
    return np.repeat(np.arange(len(size)) << 32, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)) // longest


def _pairs(window: int, longest: int):
    """Arrow batches of token lists to rows (word, beside, weight): each unordered pair once, words of a pair in order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _some(batches):
            words = lists.flatten().dictionary_encode()
            size = np.diff(lists.offsets.to_numpy())
            known = len(words.dictionary)
            code = words.indices.fill_null(-1).to_numpy().astype(np.int64)
            sentence = _sentences(size, longest)
            keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
            for d in range(1, min(window, len(code) - 1) + 1):
                a, b = code[:-d], code[d:]
                near = (sentence[:-d] == sentence[d:]) & (a >= 0) & (b >= 0)
                key, n = np.unique(np.minimum(a, b)[near] * known + np.maximum(a, b)[near], return_counts=True)
                keys.append(key)
                weights.append(n * (window - d + 1) / window)
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(weights), len(key))
            if len(key):
                a, b = np.divmod(key, known)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(a)), words.dictionary.take(pa.array(b)), pa.array(total)], ["word", "beside", "weight"])

    return run


def word_pairs(df: DataFrame, tokens: str, words: DataFrame, window: int = 5, longest: int = 1000) -> DataFrame:
    """(word, beside, weight) in both directions, of the words of ``words``. Sentences over ``longest`` words are cut into
    consecutive ones."""
    once = df.select(tokens).mapInArrow(_pairs(window, longest), "word string, beside string, weight double")
    once = once.select(F.least("word", "beside").alias("word"), F.greatest("word", "beside").alias("beside"), "weight").groupBy("word", "beside").agg(F.sum("weight").alias("weight"))
    kept = words.select("word")
    once = once.join(kept, "word", "left_semi").join(kept.withColumnRenamed("word", "beside"), "beside", "left_semi")
    there, back = F.struct("word", "beside"), F.struct(F.col("beside").alias("word"), F.col("word").alias("beside"))
    both = F.when(F.col("word") == F.col("beside"), F.array(there)).otherwise(F.array(there, back))  # not a union, which would count the pairs twice over
    return once.select(F.explode(both).alias("p"), "weight").select("p.word", "p.beside", "weight")


def numbered_pairs(pairs: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """Pairs as (block, turn, row, beside_row, weight): the words' rows in their shards. ``words`` has (shard, word, row)."""
    own = words.select("word", F.col("shard").alias("block"), "row")
    other = words.select(F.col("word").alias("beside"), F.col("shard").alias("_beside_shard"), F.col("row").alias("beside_row"))
    dealt = pairs.join(own, "word").join(other, "beside")
    return dealt.select("block", F.pmod(F.col("_beside_shard") - F.col("block"), F.lit(shards)).alias("turn"), "row", "beside_row", F.col("weight").cast("float").alias("weight"))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second bytes and so on, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T), "zstd", asbytes=True)


def _unpacked(packed: pa.Buffer | bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, n * width, "zstd"), np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of token lists to ``PIECES``."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    for k, lists in enumerate(_some(batches)):
        words = lists.flatten().dictionary_encode()
        code = words.indices.cast(pa.int32()).fill_null(-1).to_numpy() + np.int32(1)
        if not len(words.dictionary):
            continue
        counts = np.bincount(code, minlength=len(words.dictionary) + 1)[1:]
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        one = pa.array([0, len(counts)], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()), pa.ListArray.from_arrays(one, words.dictionary), pa.ListArray.from_arrays(one, pa.array(counts, pa.int64())),
                                          pa.array([len(code)], pa.int64()), pa.array([_packed(code)], pa.binary()), pa.array([len(size)], pa.int64()), pa.array([_packed(size)], pa.binary())], names)


def _numbered(key: tuple, piece: pa.Table, ids: pa.Table) -> pa.Table:
    """A piece with the ids of its words in place of codes, 0 for words without one."""
    p = piece.to_pylist()[0]
    code = _unpacked(p["codes"], p["many"], np.int32)
    known = np.zeros(int(code.max(initial=0)) + 1, np.int64)
    known[ids["code"].to_numpy() + 1] = ids["id"].to_numpy()
    return pa.table({"many": [p["many"]], "ids": [_packed(known[code])], "lists": [p["lists"]], "sizes": [p["sizes"]]})


def _block_pairs(window: int, longest: int):
    """Numbered pieces to ``PAIRS``, a row for each block that has some in the piece."""
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (r for batch in batches for r in batch.to_pylist()):
            known, code = np.unique(_unpacked(p["ids"], p["many"], np.int64), return_inverse=True)  # in the order of shard and row
            sentence, keys = _sentences(_unpacked(p["sizes"], p["lists"], np.int64), longest), [np.zeros(0, np.int64)]
            there = known[code] > 0
            for d in range(1, min(window, len(code) - 1) + 1):
                near = (sentence[:-d] == sentence[d:]) & there[:-d] & there[d:]
                x, y = code[:-d][near], code[d:][near]
                keys.append((np.minimum(x, y) * len(known) + np.maximum(x, y)) * window + (d - 1))
            key = np.sort(np.concatenate(keys))
            del keys, sentence, there, code
            if not len(key):
                continue
            key, d = np.divmod(key, window)
            first = _firsts(key)
            weight = np.add.reduceat(window - d, first)
            x, y = np.divmod(key[first], len(known))
            shard, row = known - 1 >> 32, known - 1 & 0xFFFFFFFF
            block = shard[x] << 32 | shard[y]
            order = np.argsort(block, kind="stable")
            x, y, weight, block = x[order], y[order], weight[order], block[order]
            begin = _firsts(block)
            for lo, hi in zip(begin, [*begin[1:], len(block)], strict=True):
                width = int(row[y[lo:hi]].max()) + 1
                at = row[x[lo:hi]] * width + row[y[lo:hi]]
                yield pa.RecordBatch.from_arrays([pa.array([block[lo] >> 32], pa.int32()), pa.array([block[lo] & 0xFFFFFFFF], pa.int32()), pa.array([hi - lo], pa.int64()), pa.array([width], pa.int64()),
                                                  pa.array([_packed(np.diff(at, prepend=0))], pa.binary()), pa.array([_packed(weight[lo:hi])], pa.binary())], names)

    return run


def _summed(key: tuple, parts: pa.Table) -> pa.Table:
    """A block's pairs of all pieces, summed, ``PAIRS_A_ROW`` in a row."""
    width, keys, weights = max(parts["width"].to_pylist()), [], []
    for n, w, k, v in zip(*(parts[c] for c in ("n", "width", "keys", "weights")), strict=True):
        at = np.cumsum(_unpacked(k.as_buffer(), n.as_py(), np.int64))
        if w.as_py() != width:
            x, y = np.divmod(at, w.as_py())
            at = x * width + y
        keys.append(at)
        weights.append(_unpacked(v.as_buffer(), n.as_py(), np.int64))
    at, weight = np.concatenate(keys), np.concatenate(weights)
    del keys, weights
    order = np.argsort(at)
    at, weight = at[order], weight[order]
    del order
    first = _firsts(at)
    at, weight = at[first], np.add.reduceat(weight, first)
    rows = [(at[lo:lo + PAIRS_A_ROW], weight[lo:lo + PAIRS_A_ROW]) for lo in range(0, len(at), PAIRS_A_ROW)]
    return pa.table({"a": pa.array([key[0].as_py()] * len(rows), pa.int32()), "b": pa.array([key[1].as_py()] * len(rows), pa.int32()), "n": [len(k) for k, _ in rows], "width": [width] * len(rows),
                     "keys": [_packed(np.diff(k, prepend=0)) for k, _ in rows], "weights": [_packed(v) for _, v in rows]})


def _start(size: int, seed: int):
    """A shard's words (shard, row, word, n) to its first ``PARTS``: small hash-drawn vectors, and contexts, which begin as zeros."""
    def run(words: pa.Table) -> pa.Table:
        words, rows = words.sort_by("row"), []
        for lo in range(0, words.num_rows, WORDS_A_ROW):
            t = words.slice(lo, WORDS_A_ROW)
            names, row = t["word"].to_pylist(), {"shard": t["shard"][0].as_py(), "at": lo, "n": t.num_rows, "of": words.num_rows, "two": None}
            drawn = [np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}/{w}".encode()).digest()[:8], "big")).uniform(-0.5, 0.5, size) / size for w in names]
            rows += [row | {"part": "own", "one": _packed(np.array(drawn).astype(np.float32)), "words": names, "counts": None},
                     row | {"part": "context", "one": None, "words": None, "counts": t["n"].to_pylist()}]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
        return pa.table({c: pa.array([r[c] for r in rows], kinds[kind]) for c, kind in (x.split() for x in ("shard int, " + PARTS).split(", "))})

    return run


def _totals(rows: np.ndarray, gradient: Callable[..., np.ndarray], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order and, in ``out``, the sums of their gradients (``gradient`` gives those of the places it is asked for), added in the order in which ``np.add.reduceat`` adds: to a row's first the sum of its
    others. ``reduceat`` itself takes a step for every row and column, so it is left those rows that come more than eight times."""
    bits = len(rows).bit_length()
    ordered = np.sort(rows.astype(np.int64) << bits | np.arange(len(rows)))  # rows in order, those of a row as they came
    order, there = ordered & (1 << bits) - 1, ordered >> bits
    first = _firsts(there)
    counts = np.diff(first, append=len(rows))
    total = gradient(order[first], out[:len(first)])
    few = np.flatnonzero((counts > 1) & (counts <= 8))
    others = gradient(order[first[few] + 1])
    for k in range(2, 8):
        more = np.flatnonzero(counts[few] > k)
        others[more] += gradient(order[first[few[more]] + k])
    total[few] += others
    often = counts > 8
    if often.any():
        total[often] = np.add.reduceat(gradient(order[np.repeat(often, counts)]), np.cumsum(counts[often]) - counts[often], axis=0)
    return there[first], total


def train_block(word: np.ndarray, beside: np.ndarray, weight: np.ndarray, own: np.ndarray, context: np.ndarray, own_sq: np.ndarray, context_sq: np.ndarray,
                counts: np.ndarray, negatives: int, step: float, passes: int, rng: np.random.Generator) -> None:
    """Skip-gram with negative sampling over pairs of row numbers; the vectors are changed in place."""
    chance = np.cumsum(counts.astype(float) ** 0.75)
    chance /= chance[-1]

    width = own.shape[1]
    wide = min(BATCH, len(word)) * (negatives + 1)
    totals, squared, moved, of_context = (np.empty((wide, width), np.float32) for _ in range(4))  # used again and again, as new memory costs more than the sums
    of_own = np.empty((min(BATCH, len(word)), width), np.float32)

    def taken(vectors: np.ndarray, rows: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        return np.take(vectors, rows, axis=0, out=None if to is None else to[:len(rows)], mode="clip")

    def move(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: Callable[..., np.ndarray]) -> None:
        at, total = _totals(rows, gradient, totals)
        square, vector = taken(squares, at, squared), moved[:len(at)]
        square += np.multiply(total, total, out=vector)
        squares[at] = square
        np.sqrt(square, out=square)
        square += 1e-6
        total *= step
        total /= square
        vectors[at] = np.subtract(taken(vectors, at, moved), total, out=vector)

    for _ in range(passes):
        order = rng.permutation(len(word))
        for lo in range(0, len(order), BATCH):
            b = order[lo:lo + BATCH]
            other = np.concatenate([beside[b][:, None], np.searchsorted(chance, rng.random((len(b), negatives)))], axis=1)
            place = np.repeat(np.arange(len(b)), negatives + 1)
            v, u = taken(own, word[b], of_own), taken(context, other.ravel(), of_context).reshape(len(b), negatives + 1, width)
            goal = np.zeros(other.shape, np.float32)
            goal[:, 0] = 1.0
            error = (1.0 / (1.0 + np.exp(-np.clip(np.einsum("bd,bkd->bk", v, u), -30, 30))) - goal) * weight[b][:, None].astype(np.float32)
            to_own, each = np.einsum("bk,bkd->bd", error, u).astype(np.float32, copy=False), error.astype(np.float32, copy=False).reshape(-1, 1)

            def to_context(o: np.ndarray, to: np.ndarray | None = None, v: np.ndarray = v, each: np.ndarray = each, place: np.ndarray = place) -> np.ndarray:
                found = taken(v, place[o], to)
                found *= each[o]
                return found

            move(own, own_sq, word[b], lambda o, to=None, g=to_own: taken(g, o, to))
            move(context, context_sq, other.ravel(), to_context)


def _directed(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int, other: int) -> list[np.ndarray]:
    """(row, row beside, weight) of a block in order, from the unordered pairs of its shards; ``pairs`` is emptied, so that they are held once."""
    columns = [np.concatenate(c) for c in zip(*pairs, strict=True)]
    pairs.clear()
    if block > other:
        columns[:2] = columns[1::-1]
    elif block == other:
        back = columns[0] != columns[1]
        columns = [np.concatenate([c, columns[k][back]]) for c, k in zip(columns, (1, 0, 2), strict=True)]
    key = columns[0].astype(np.int64)
    key *= int(columns[1].max()) + 1
    key += columns[1]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)  # so that the drawn order means the same pairs in every run
        del key
        for k in range(3):
            columns[k] = columns[k][order]
    return columns


def _train(size: int, window: int, negatives: int, step: float, passes: int, seed: tuple[int, ...], block: int, other: int, last: bool):
    """``PARTS`` of a block (own vectors, contexts, pairs) to those after it; after the last only own vectors are wanted."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        about: dict[str, list[tuple]] = {"own": [], "context": []}
        pairs: list[tuple] = []
        for batch in batches:
            for part, at, n, of, one, two, words, counts in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
                part, at, n, of = part.as_py(), at.as_py(), n.as_py(), of.as_py()
                if part == "pairs":
                    x, y = np.divmod(np.cumsum(_unpacked(one.as_buffer(), n, np.int64)), of)
                    pairs.append((x.astype(np.int32), y.astype(np.int32), (_unpacked(two.as_buffer(), n, np.int64) / window).astype(np.float32)))
                    continue
                if part not in sides:
                    sides[part] = np.zeros((of, size), np.float32), np.zeros((of, size), np.float32)
                about[part].append((at, n, words.values, counts.values))
                for matrix, packed in zip(sides[part], (one, two), strict=True):
                    if packed.is_valid:
                        matrix[at:at + n] = _unpacked(packed.as_buffer(), n * size, np.float32).reshape(n, size)
        for side in about.values():
            side.sort(key=lambda x: x[0])
        word, beside, weight = _directed(pairs, block, other)
        (own, own_sq), (context, context_sq) = sides["own"], sides["context"]
        train_block(word, beside, weight, own, context, own_sq, context_sq, np.concatenate([c.to_numpy() for *_, c in about["context"]]), negatives, step, passes, np.random.default_rng([*seed, block]))
        for part in ("own",) if last else ("own", "context"):
            for at, n, words, counts in about[part]:
                packed = [None if last and k else _packed(m[at:at + n]) for k, m in enumerate(sides[part])]
                listed = [pa.array([None], pa.list_(kind)) if x is None else pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x, kind in ((words, pa.string()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x], pa.int64()) for x in (at, n, len(sides[part][0]))), *(pa.array([x], pa.binary()) for x in packed), *listed],
                                                 [c.split()[0] for c in PARTS.split(", ")])

    return run


def _vectors(size: int):
    """``PARTS`` of own vectors to rows (word, vector)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, one, words in zip(batch["n"], batch["one"], batch["words"], strict=True):
                at = pa.array(np.arange(n.as_py() + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([words.values, pa.ListArray.from_arrays(at, pa.array(_unpacked(one.as_buffer(), n.as_py() * size, np.float32)))], ["word", "vector"])

    return run


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` for what runs within; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _at_once(shards: int) -> int:
    """Blocks in work at once: while they are written, their shards (of ``shards``) lie on disk twice."""
    return max(1, shards // 2)


def fit_word_vectors(df: DataFrame, tokens: str = "tokens", size: int = 100, min_count: int = 5, window: int = 5, negatives: int = 5, epochs: int = 1,
                     step: float = 0.05, passes: int = 3, shards: int = 8, seed: int = 42) -> DataFrame:
    """(word, vector) of the words that occur ``min_count`` times or more. ``shards`` bounds what a task holds:
    two shards of words with their vectors, and one of shards x shards blocks of pairs."""
    spark = df.sparkSession
    base = scratch_path(spark, "word-vectors")
    with _settings(spark):
        return _fitted(spark, base, df.select(tokens), size, min_count, window, negatives, epochs, step, passes, shards, seed)


def stored_pairs(spark: SparkSession, base: str, lists: DataFrame, min_count: int, window: int, shards: int, longest: int = 1000) -> DataFrame:
    """The words (shard, row, word, n) that occur ``min_count`` times; below ``base`` the pairs of each block of shards (a, b). Sentences over ``longest``
    words are cut into consecutive ones."""
    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    pieces = kept(lists.mapInArrow(_pieces, PIECES), "pieces")
    known = pieces.select(F.inline(F.arrays_zip("words", "counts"))).groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n")).where(F.col("n") >= min_count)
    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")
    row = F.row_number().over(Window.partitionBy("shard").orderBy("word")) - 1
    words = kept(known.select(shard.alias("shard"), "word", "n").select("shard", row.alias("row"), "word", "n"), "words")
    ids = pieces.select("piece", F.posexplode("words").alias("code", "word")).join(words, "word").select("piece", "code", (F.shiftleft(F.col("shard").cast("long"), 32) + F.col("row") + 1).alias("id"))
    coded = spark.read.schema(PIECES).parquet(f"{base}/pieces").select("piece", "many", "codes", "lists", "sizes").groupBy("piece")
    numbered = kept(coded.cogroup(ids.groupBy("piece")).applyInArrow(_numbered, "many long, ids binary, lists long, sizes binary"), "numbered")
    fs.delete(spark, f"{base}/pieces")
    numbered.mapInArrow(_block_pairs(window, longest), PAIRS).groupBy("a", "b").applyInArrow(_summed, PAIRS).write.partitionBy("a", "b").parquet(f"{base}/pairs")
    fs.delete(spark, f"{base}/numbered")
    return words


def _fitted(spark: SparkSession, base: str, lists: DataFrame, size: int, min_count: int, window: int, negatives: int, epochs: int, step: float, passes: int, shards: int, seed: int) -> DataFrame:
    words = stored_pairs(spark, base, lists, min_count, window, shards)

    def written(parts: DataFrame, to: str, *by: str) -> None:
        parts.withColumn("kind", F.col("part")).write.option("parquet.block.size", 8 << 20).partitionBy(*by, "kind").parquet(to)

    written(words.groupBy("shard").applyInArrow(_start(size, seed), "shard int, " + PARTS), f"{base}/start", "shard")
    there = {int(x.partition("=")[2]) for x in fs.list_dirs(spark, f"{base}/start") if "=" in x}
    files = {(part, i): f"{base}/start/shard={i}/kind={part}" for part in ("own", "context") for i in there}
    paired = {(int(a.partition("=")[2]), int(b.partition("=")[2])) for a in fs.list_dirs(spark, f"{base}/pairs") if "=" in a for b in fs.list_dirs(spark, f"{base}/pairs/{a}")}

    def train(epoch: int, turn: int, block: int, before: list[Future]) -> None:
        for f in before:
            f.result()
        other, last = (block + turn) % shards, (epoch, turn) == (epochs - 1, shards - 1)
        a, b = min(block, other), max(block, other)
        if (a, b) not in paired:
            return
        weights = spark.read.schema(PARTS).parquet(files["own", block], files["context", other])
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("words", "array<string>"), ("counts", "array<bigint>"))]
        pairs = spark.read.schema(PAIRS).parquet(f"{base}/pairs/a={a}/b={b}").select(F.lit("pairs").alias("part"), F.lit(0).cast("long").alias("at"), "n", F.col("width").alias("of"), F.col("keys").alias("one"), F.col("weights").alias("two"), *none)
        to = f"{base}/weights-{epoch}-{turn}-{block}"
        written(weights.union(pairs).coalesce(1).mapInArrow(_train(size, window, negatives, step, passes, (seed, epoch, turn), block, other, last), PARTS), to)
        for part, i in (("own", block), ("context", other)):
            fs.delete(spark, files[part, i])
            files[part, i] = f"{to}/kind={part}"

    with ThreadPoolExecutor(_at_once(shards)) as pool:
        now: list[Future] = []
        for epoch in range(epochs):
            for turn in range(shards):
                # the block of shard i needs that shard after its last block, and as contexts those of shard i + turn, which the block after it had last
                now = [pool.submit(train, epoch, turn, i, [now[j] for j in dict.fromkeys((i, (i + 1) % shards))] if now else []) for i in range(shards)]
        for f in now:
            f.result()
    if not there:
        return spark.createDataFrame([], "word string, vector array<float>")
    return spark.read.schema(PARTS).parquet(*(files["own", i] for i in sorted(there))).mapInArrow(_vectors(size), "word string, vector array<float>")


class ShardedWord2VecModel:
    """A fitted model whose vectors are a table in the shared folder."""

    def __init__(self, vectors: DataFrame):
        self._vectors = vectors

    def getVectors(self) -> DataFrame:
        """(word, vector), as the library's model gives them."""
        return self._vectors.select("word", V.to_vector(F.col("vector").cast("array<double>")).alias("vector"))


@dataclass(frozen=True)
class ShardedWord2Vec:
    """An estimator with the library's names whose vocabulary and weights are never on the driver nor whole in a task."""

    tokens: str = "tokens"
    vector_size: int = 100
    min_count: int = 5
    max_iter: int = 1
    window_size: int = 5
    negatives: int = 2
    shards: int = 8
    seed: int = 42

    def fit(self, df: DataFrame) -> ShardedWord2VecModel:
        return ShardedWord2VecModel(fit_word_vectors(df, self.tokens, self.vector_size, self.min_count, self.window_size, self.negatives,
                                                     epochs=self.max_iter, passes=1, shards=self.shards, seed=self.seed))
