"""Language-model scoring by online logistic context mixing.

A text is its lower-cased (A-Z) words at ASCII white space, then one end. A word is coded
as its bytes and a closing space, bit by bit. Six predictors, each a hashed context
(position; the last 1, 2, 3, 4 bytes; all bytes of the word so far) together with the bits
of the byte so far, give counts of 0 and 1. Their stretched probabilities are combined by a
logistic mixer whose weights are chosen by gates (how often the word's beginning and
its last three bytes have been seen), learned online over the training words in small
steps, each bit predicted from counts without its own occurrence. Counts, steps and map take each
different word with the weight of its occurrences in training. An adaptive map of (gate,
probability) refines the result. A word's bits and its plain frequency are then mixed at the
rate at which new words turn up (words seen once, over all): frequent words get their
frequency, new ones are spelled. Within a document, two last stages adapt. The word
frequencies of ``KINDS`` kinds of training documents (a kind: the same two most frequent words,
so mostly a language), those of all and the word's probability after the word before are mixed by
weights that follow how well each foretold the document so far. And the probability is mixed with that of a repeat of one of the document's
earlier words, at a rate that follows the repeats seen so far. All probabilities use only what came before, so the
score is the logarithm of a proper probability of the word sequence.

The probability after the word before is mixed from bits, too: a word is coded as one bit (whether it is
none of the ``FREQUENT`` most frequent) and the bits of its rank. A bit's contexts are the bits before
it, alone and together with the class of the word before in the text, across the ends of words. Classes: the
``OWN`` most frequent words have their own, all others one by their last byte. Both contexts are counted
over the training texts, each occurrence; gates, mixer and map are as above, learned per class and averaged.

What is learned: words and their counts of all training documents (a distributed
aggregate, written to the shared folder); the predictors' counts over all those words, summed in
one table of 2^SLOT_BITS slots; mixer weights, averaged over the tasks' online runs; the map.
The table has a fixed size and is broadcast; so are the ``FREQUENT`` most frequent words. All
other words meet their counts and probabilities in an ordinary join. The counts after the classes have a
fixed size too (``CLASSES`` times ``FREQUENT``); texts are split into words' numbers once, kept in the shared folder.

Defined results: null and empty texts are the end alone; very long texts are scored whole;
without training documents every count is 0; repeated rows each get their row; an empty table
gives an empty table; columns not named here are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import id_remainder, regroup, staged, utf8
from netsentry.llm.substring_dedup import numbered

SLOT_BITS = 22
RANGE_BITS = 16
FREQUENT = 1 << 17
WORDS_AT_ONCE = 20_000
PREDICTORS = 6
GATES = 16
STEPS = 33  # of the adaptive map, over stretched probabilities of -8 to 8
REPEAT_SHARE = 0.35
RATE = 0.02
KINDS = 8
KIND_PRIOR = 200.0
CLASSES = 32
OWN = 16
CLASS_BIT = 27  # a text's numbers: the word's in the lower bits, its class above
END = b"\n"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Bits:
    """The bits of some words and the slots of their contexts. Contexts begin with the word, so
    a byte that continues the same beginning as in the word before is kept once: of sorted
    words, every beginning once. ``node``: per byte of the words, which kept byte it is."""

    def __init__(self, words: list[bytes]):
        coded = [w if w == END else w + b" " for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.start = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(coded)), size)
        data = np.frombuffer(b"".join(coded), np.uint8)
        pos = np.arange(len(data)) - self.start[self.word]
        before = np.maximum(np.arange(len(data)) - np.concatenate([[0], size[:-1]])[self.word], 0)  # this place in the word before
        same = (data[before] == data) & (pos < np.concatenate([[0], size[:-1]])[self.word])
        new = pos >= np.minimum.reduceat(np.where(same, int(size.max()), pos), self.start)[self.word]
        kept = np.flatnonzero(new)
        order = np.argsort(pos, kind="stable")  # in a column of places, a byte not kept is the last kept one
        self.node = np.empty(len(data), np.int64)
        self.node[order] = np.maximum.accumulate(np.where(new, np.arange(len(data)), 0)[order] + pos[order] * len(data)) - pos[order] * len(data)
        self.node = (np.cumsum(new) - 1)[self.node]
        value = data.astype(np.uint64) + np.uint64(1)
        first = np.minimum(pos[kept], 7).astype(np.uint64)
        contexts, last = [first], np.zeros(len(kept), np.uint64)
        for k in range(1, 5):
            last = last * np.uint64(257) + np.where(pos[kept] >= k, value[np.maximum(kept - k, 0)], np.uint64(0))
            contexts.append(last)
        power = np.cumprod(np.full(int(size.max()), _A), dtype=np.uint64)
        part = value * power[pos]
        sums = np.cumsum(part, dtype=np.uint64) - part  # up to, not with, this byte
        contexts.append((sums - sums[self.start][self.word])[kept] + pos[kept].astype(np.uint64) * _B)
        self.data = data[kept]
        self.contexts = np.stack([(c + np.uint64(j + 1)) * _A for j, c in enumerate(contexts)])
        self.contexts ^= self.contexts >> np.uint64(29)

    def occurrences(self, n: np.ndarray) -> np.ndarray:
        """Of each kept byte, from the words' occurrences."""
        return np.bincount(self.node, n.astype(np.float64)[self.word], len(self.data))

    def bit(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots by predictor, value) of bit ``k`` of every byte."""
        node = np.uint64(1 << k) | (self.data.astype(np.uint64) >> np.uint64(8 - k))
        slots = ((self.contexts + node * _A) * _B) >> np.uint64(64 - SLOT_BITS)
        return slots.astype(np.int64), (self.data >> (7 - k)) & 1


def in_order(words: list[bytes], n: np.ndarray) -> tuple[Bits, np.ndarray]:
    """The bits of the sorted words, and their occurrences in that order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    return Bits([words[k] for k in order]), n[order]


def stretch_counts(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


def gates_of(total: np.ndarray) -> np.ndarray:
    """Gate from the occurrences of the word's beginning and its last three bytes."""
    level = (total > 0.5).astype(np.int64) + (total > 3.5) + (total > 31.5)
    return level[0] * 4 + level[1]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -16, 16)))


def map_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(x, -8, 8) + np.float32(8)) * np.float32((STEPS - 1) / 16)
    low = np.minimum(place.astype(np.int32), STEPS - 2)
    return low, place - low.astype(np.float32)


class Model:
    """Counts per slot, mixer weights and the adaptive map."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, refined: np.ndarray):
        self.stretched = stretch_counts(counts[:, 0], counts[:, 1]).astype(np.float32)
        self.total = counts.sum(1)
        self.weights, self.refined = np.ascontiguousarray(weights.T, np.float32), refined.astype(np.float32)

    def log10_words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's bits."""
        out = np.zeros(len(words))
        for lo in range(0, len(words), WORDS_AT_ONCE):
            bits = Bits(words[lo:lo + WORDS_AT_ONCE])
            lp = np.zeros(len(bits.data))
            for k in range(8):
                slots, value = bits.bit(k)
                gate = gates_of(self.total[slots[[5, 3]]])
                x = np.einsum("ji,ji->i", self.weights[:, gate], self.stretched[slots])
                low, share = map_place(x)
                p = (squash(x) + self.refined[gate, low] * (1 - share) + self.refined[gate, low + 1] * share) / 2
                lp += np.log10(np.clip(np.where(value == 1, p, 1 - p), 1e-6, 1 - 1e-6))
            out[lo:lo + WORDS_AT_ONCE] = np.add.reduceat(lp[bits.node], bits.start)
        return out


def count_slots(words: list[bytes], n: np.ndarray, table: np.ndarray) -> None:
    """Add the bits of each word, ``n`` times, to the counts."""
    bits, flat = Bits(words), table.reshape(-1)
    weight = np.tile(bits.occurrences(n), PREDICTORS)
    for k in range(8):
        slots, value = bits.bit(k)
        np.add.at(flat, (slots * 2 + value).reshape(-1), weight)


def mixer_step(weights: np.ndarray, seen: np.ndarray, x: np.ndarray, gate: np.ndarray, value: np.ndarray, c: np.ndarray) -> None:
    """Take some bits, ``c`` times each, into the map's counts and the weights."""
    mixed = np.einsum("ji,ji->i", weights.T.astype(np.float32)[:, gate], x)
    low, share = map_place(mixed)
    seen += np.bincount(((gate * STEPS + low + (share >= 0.5)) * 2 + value), c, len(seen))
    error = c * (value - squash(mixed))
    change = np.stack([np.bincount(gate, error * row, GATES) for row in x], 1)
    weights += RATE * change / (np.bincount(gate, c, GATES)[:, None] + 1)


def learn_mixer(batches: Iterable[tuple[list[bytes], np.ndarray]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One online run over words and their occurrences: (weights, map counts, tokens seen)."""
    weights, seen, tokens = np.full((GATES, PREDICTORS), 0.3), np.zeros(GATES * STEPS * 2), 0.0
    step, pairs = WORDS_AT_ONCE // 10, np.ascontiguousarray(counts, np.float32).view(np.float64).reshape(-1)
    for words, n in batches:
        tokens += float(n.sum())
        for lo in range(0, len(words), step):
            bits, of = in_order(words[lo:lo + step], n[lo:lo + step])
            c = bits.occurrences(of)
            for k in range(8):
                slots, value = bits.bit(k)
                both = pairs.take(slots).view(np.float32).reshape(*slots.shape, 2)
                one = value.astype(np.float32)
                n0 = np.maximum(both[..., 0] - (1 - one), np.float32(0))  # without this very occurrence
                n1 = np.maximum(both[..., 1] - one, np.float32(0))
                x, gate = stretch_counts(n0, n1), gates_of((n0 + n1)[[5, 3]])
                mixer_step(weights, seen, x, gate, value, c)
    return weights, seen.reshape(GATES, STEPS, 2), tokens


def refine(seen: np.ndarray) -> np.ndarray:
    """The adaptive map from its counts."""
    prior = squash(np.linspace(-8, 8, STEPS))
    return (seen[..., 1] + 8 * prior) / (seen.sum(2) + 8)


def tree(n: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 at each bit of the words' numbers. ``n``: of each frequent word and, last, of all
    others. Row 0: whether it is one of the others; from row 2^d: bit d of the rank, by the bits before."""
    depth = max(len(n) - 2, 0).bit_length()
    ranks = np.zeros(1 << depth)
    ranks[:len(n) - 1] = n[:-1]
    return np.concatenate([[[ranks.sum(), n[-1]]]] + [ranks.reshape(1 << d, 2, -1).sum(2) for d in range(depth)])


def learn_next(n: np.ndarray, everywhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One online run over the words after one class: (weights, map counts, tokens seen)."""
    weights, seen, step = np.full((GATES, 2), 0.5), np.zeros(GATES * STEPS * 2), WORDS_AT_ONCE // 10
    counts, sides = np.stack([tree(n), tree(everywhere)]), tree(np.ones(len(n)))
    for lo in range(0, len(sides), step):
        for bit in (0, 1):
            at = lo + np.flatnonzero((counts[0, lo:lo + step, bit] > 0) & (sides[lo:lo + step] > 0).all(1))
            left = counts[:, at].copy()
            left[..., bit] = np.maximum(left[..., bit] - 1, 0)  # without this very occurrence
            x = stretch_counts(left[..., 0], left[..., 1]).astype(np.float32)
            mixer_step(weights, seen, x, gates_of(left.sum(2)), np.full(len(at), bit), counts[0, at, bit])
    return weights, seen.reshape(GATES, STEPS, 2), float(n.sum())


def log_next(n: np.ndarray, everywhere: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Log probability of each frequent word and, last, of any other, after one class."""
    counts, sides = np.stack([tree(n), tree(everywhere)]), tree(np.ones(len(n)))
    gate = gates_of(counts.sum(2))
    x = np.einsum("ji,ji->i", weights.T[:, gate], stretch_counts(counts[..., 0], counts[..., 1]))
    low, share = map_place(x)
    p = np.clip((squash(x) + refined[gate, low] * (1 - share) + refined[gate, low + 1] * share) / 2, 1e-6, 1 - 1e-6)
    p = np.where(sides[:, 1] == 0, 0.0, np.where(sides[:, 0] == 0, 1.0, p))  # no words, no probability
    with np.errstate(divide="ignore"):
        log = np.log(np.column_stack([1 - p, p]))
    out = log[0, :1]
    for d in range((len(log) - 1).bit_length()):
        out = (out[:, None] + log[1 << d:2 << d]).reshape(-1)
    return np.append(out[:len(n) - 1], log[0, 1])


def classes_of(words: list[bytes], rank: np.ndarray) -> np.ndarray:
    """Each word's class as the word before another."""
    last = np.fromiter((w[-1] for w in words), np.int64, len(words))
    return np.where(rank < OWN, rank, OWN + (last * 40503 >> 8) % (CLASSES - OWN))


def numbered_words(part: pa.Table, frequent: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens by document, tokens' numbers in the document, their ranks, the class of the word before); ``end``:
    the class of an end, which comes before a text."""
    raw = part.column("ids").to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    ids = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    before = np.roll(ids >> CLASS_BIT, 1)
    before[np.cumsum(size) - size] = end
    ids &= (1 << CLASS_BIT) - 1
    return size, ids, np.minimum(ids, frequent), before


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def kind_of(counts: Counter) -> str:
    """A document's two most frequent words (ties: the first)."""
    return " ".join(sorted(w.decode("utf-8", "replace") for w, _ in counts.most_common(2)))


def count_words(docs: DataFrame) -> DataFrame:
    """(``word``, ``kind``, ``n``): occurrences in training rows, ends counted as a word; words
    of other rows come with 0 and no kind. ``docs``: ``text``, ``train``."""
    def run(batches):
        for part in regroup(batches, size=8 << 20):
            seen: dict[str, Counter] = {}
            other: set[bytes] = {END}
            for text, train in zip(part.column("text").to_pylist(), part.column("train").to_pylist()):
                words = words_of(text)
                if train:
                    kind = seen.setdefault(kind_of(Counter(words)), Counter())
                    kind.update(words)
                    kind[END] += 1
                else:
                    other.update(words)
            word = chain(*seen.values(), other)
            kind = chain(*(repeat(k, len(c)) for k, c in seen.items()), repeat(None, len(other)))
            n = chain(*(c.values() for c in seen.values()), repeat(0, len(other)))
            yield pa.RecordBatch.from_arrays([pa.array(list(word), pa.binary()), pa.array(list(kind), pa.string()), pa.array(list(n), pa.int64())], names=["word", "kind", "n"])

    return docs.mapInArrow(run, "word binary, kind string, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


class Kinds:
    """Word frequencies of all documents (column 0), of each kind, and after each class, for the
    frequent words; and what a rarer word's probability is multiplied with."""

    def __init__(self, p: np.ndarray, counts: np.ndarray, by_kind: np.ndarray, totals: np.ndarray, after: np.ndarray):
        """``p``: probability of each frequent word; ``counts``: its occurrences in all
        and ``by_kind`` in each kind; ``totals``: tokens of each kind; ``after``: log probability
        after each class, of any rarer word in the last column."""
        inside = by_kind.sum(0)
        rare = (totals - inside + 1) / (totals + 2)
        shape = (by_kind + KIND_PRIOR * (counts / max(1, counts.sum()))[:, None]) / (inside + KIND_PRIOR)
        self.words = np.column_stack([p, (1 - rare) * shape])
        rest = max(1e-12, 1 - p.sum())
        self.words = np.vstack([self.words, np.concatenate([[1.0], rare / rest])])  # the last row: any other word
        self.after = after
        self.after[:, -1] -= math.log(rest)
        self.words = np.maximum(self.words, 1e-300)
        self.logs = np.log(self.words)
        self.start = np.log(np.full(len(totals) + 2, 1 / (len(totals) + 2)))

    def mixed(self, begin: np.ndarray, size: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Per token its probability (of a rarer word: the factor to its own), the
        columns weighted by how well they foretold the document's earlier tokens."""
        out = np.empty(len(at))
        for d in range(0, len(size), 32):  # a few documents at a time stay in the processor's cache
            lo, hi = int(begin[d]), int(begin[d:d + 32][-1] + size[d:d + 32][-1])
            after = self.after[before[lo:hi], at[lo:hi]].astype(np.float64)[:, None]
            p, log = np.hstack([self.words[at[lo:hi]], np.exp(after)]), np.hstack([self.logs[at[lo:hi]], after])
            weight = np.cumsum(log, axis=0)
            weight -= log
            weight += self.start - np.repeat(weight[begin[d:d + 32] - lo], size[d:d + 32], axis=0)
            weight -= weight.max(1, keepdims=True)
            np.exp(weight, out=weight)
            out[lo:hi] = np.einsum("ij,ij->i", weight, p) / weight.sum(1)
        return out


def word_log10(lp_bits: np.ndarray, n: np.ndarray, total: int, once: int) -> np.ndarray:
    """log10 of new * (the bits' probability) + (1 - new) * (the word's frequency)."""
    new = (once + 1) / (total + once + 1)
    with np.errstate(divide="ignore"):  # in logarithms: a long word's probability is below any float
        return np.logaddexp(math.log(new) + lp_bits * math.log(10), np.log((1 - new) * n / max(total, 1))) / math.log(10)


def log10_sum(r: Column, lp: Column) -> Column:
    """log10(r + 10^lp), also where 10^lp is below any float."""
    log = F.log10(r)
    return F.when(r > 0, F.greatest(log, lp) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(log - lp)))).otherwise(lp)


def sorted_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """``WORDS_AT_ONCE`` words at a time, sorted within some megabytes of them."""
    for part in regroup(batches, rows=1 << 18, size=16 << 20, column="word"):
        part = part.sort_by("word")
        for lo in range(0, part.num_rows, WORDS_AT_ONCE):
            yield part.slice(lo, WORDS_AT_ONCE)


_COUNTS = "r int, at binary, n binary"


def add_rows(parts: DataFrame, shape: tuple[int, ...], places: type) -> DataFrame:
    """(``r``, ``n``): each row of counts, from the tasks' counts at the places that have any."""
    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, at, n in zip(*(c.to_pylist() for c in b.columns)):
                sums.setdefault(r, np.zeros(shape))[np.frombuffer(at, places)] += np.frombuffer(n).reshape(-1, *shape[1:])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["r", "n"])

    return parts.repartition(16, "r").mapInArrow(total, "r int, n binary")


def learn_after(coded: DataFrame, everywhere: np.ndarray, end: int) -> np.ndarray:
    """Log probability after each class (rows) of each frequent word and, last, of any other. ``coded``: texts
    as numbers, of which those with ``train`` are learned; ``everywhere``: the words' occurrences."""
    width = len(everywhere)

    def follow(batches):
        table = np.zeros((CLASSES, width))
        for part in regroup(batches, size=2 << 20, column="ids"):
            _, _, at, before = numbered_words(part, width - 1, end)
            np.add.at(table.reshape(-1), before * width + at, 1.0)
        for r in range(CLASSES):
            at = np.flatnonzero(table[r])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()),
                                                  pa.array([table[r, at].tobytes()], pa.binary())], names=["r", "at", "n"])

    rows = staged(add_rows(coded.where("train").select("ids").mapInArrow(follow, _COUNTS), (width,), np.uint32), "after")
    counts_of = lambda b: (np.frombuffer(n, np.float32).astype(np.float64) for n in b.column(1).to_pylist())

    def mixer(batches):
        for b in batches:
            runs = [learn_next(n, everywhere) for n in counts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[k].tobytes() for r in runs], pa.binary()) for k in (0, 1)] + [pa.array([r[2] for r in runs], pa.float64())], names=["r", "w", "s", "t"])

    # A few kB of each of the CLASSES classes, then FREQUENT numbers of each: the model, not the corpus.
    runs = sorted(rows.mapInArrow(mixer, "r int, w binary, s binary, t double").collect())
    tokens = sum(t for *_, t in runs)
    weights = sum(t / tokens * np.frombuffer(bytes(w)).reshape(GATES, 2) for _, w, _, t in runs) if tokens else np.full((GATES, 2), 0.5)
    refined = refine(sum((np.frombuffer(bytes(s)).reshape(GATES, STEPS, 2) for _, _, s, _ in runs), np.zeros((GATES, STEPS, 2))))

    def price(batches):
        for b in batches:
            logs = [log_next(n, everywhere, weights, refined).astype(np.float32).tobytes() for n in counts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logs, pa.binary())], names=["r", "lp"])

    out = np.tile(log_next(np.zeros(width), everywhere, weights, refined).astype(np.float32), (CLASSES, 1))
    for r, lp in rows.mapInArrow(price, "r int, lp binary").collect():
        out[r] = np.frombuffer(bytes(lp), np.float32)
    return out


def learn(types: DataFrame) -> Model:
    """The model from all training words and their counts."""
    spark = types.sparkSession
    known = types.where("n > 0")

    def slots(batches):
        table = np.zeros((1 << SLOT_BITS, 2))
        for b in sorted_words(batches):
            count_slots(b.column(0).to_pylist(), b.column(1).to_numpy(), table)
        for r in range(1 << (SLOT_BITS - RANGE_BITS)):
            part = table[r << RANGE_BITS:(r + 1) << RANGE_BITS]
            at = np.flatnonzero(part.any(1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                                  pa.array([part[at].tobytes()], pa.binary())], names=["r", "at", "n"])

    counts = np.zeros((1 << (SLOT_BITS - RANGE_BITS), 1 << RANGE_BITS, 2), np.float32)
    # A fixed number of ranges of fixed size: the model, not the corpus.
    for r, n in add_rows(known.mapInArrow(slots, _COUNTS), (1 << RANGE_BITS, 2), np.uint16).collect():
        counts[r] = np.frombuffer(bytes(n), np.float32).reshape(-1, 2)
    counts = counts.reshape(-1, 2)
    shared = spark.sparkContext.broadcast(counts)

    def mixer(batches):
        weights, seen, tokens = learn_mixer(((b.column(0).to_pylist(), b.column(1).to_numpy()) for b in batches), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()), pa.array([tokens])], names=["w", "s", "t"])

    weights, seen, tokens = np.zeros((GATES, PREDICTORS)), np.zeros((GATES, STEPS, 2)), 0.0
    runs = staged(known.mapInArrow(mixer, "w binary, s binary, t double"), "mixers")
    for w, s, t in runs.toLocalIterator():  # a few kB per task, one file at a time
        weights += t * np.frombuffer(bytes(w)).reshape(GATES, PREDICTORS)
        seen += np.frombuffer(bytes(s)).reshape(GATES, STEPS, 2)
        tokens += t
    shared.destroy()
    weights = weights / tokens if tokens else np.full((GATES, PREDICTORS), 0.3)
    return Model(counts, weights, refine(seen))


def adaptive_terms(begin: np.ndarray, size: np.ndarray, ids: np.ndarray, share: float = REPEAT_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Per token: 1 - rate, and rate times the share of the earlier tokens that are the same
    word; ``rate`` = share * (repeats so far + 1/2) / (tokens so far + 1), 0 at the first."""
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(ids)) - begin[doc]
    key = doc * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    before = np.empty(len(ids), np.int64)
    before[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    again = (before > 0).astype(np.int64)
    sofar = np.cumsum(again) - again
    sofar -= sofar[begin[doc]] if len(ids) else 0
    rate = np.where(at > 0, share * (sofar + 0.5) / (at + 1), 0.0)
    return 1 - rate, rate * before / np.maximum(at, 1)


_CODED = "row long, train boolean, ids binary, n_bytes long, rare binary"
_DOC = "row long, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<word:binary,r:double>>"


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10) and
    ``bits_per_byte`` of each document. ``train``: condition for the rows to learn from."""
    spark = docs.sparkSession
    source = numbered(docs.select(F.col(key), F.col(text).cast("string").alias("text"), train.alias("train")), key)
    by_kind = staged(count_words(source.select("text", "train")), "words")
    types = staged(by_kind.groupBy("word").agg(F.sum("n").alias("n")), "types")
    total, distinct, once = map(int, types.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first())
    model = spark.sparkContext.broadcast(learn(types))

    def price(batches):
        for b in sorted_words(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).combine_chunks(), b.column(1).combine_chunks(), pa.array(word_log10(model.value.log10_words(b.column(0).to_pylist()), b.column(1).to_numpy(), total, once))], names=["word", "n", "lp"])

    priced = staged(types.mapInArrow(price, "word binary, n long, lp double"), "priced")
    model.destroy()  # used up; its files would stay on every executor's disk
    floor = math.log10(total + distinct + 1)
    # Bounded by parameters: FREQUENT words, KINDS kinds. They come as Arrow columns.
    few = staged(priced.where("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT), "frequent")
    kinds = by_kind.where("n > 0").groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind").limit(KINDS).collect()
    names = F.array(*(F.lit(r[0]) for r in kinds)).cast("array<string>")
    top = few.toArrow()
    number, counts = {w: k for k, w in enumerate(top.column("word").to_pylist())}, top.column("n").to_numpy()
    shares = np.zeros((len(number), len(kinds)))
    parts = by_kind.where(F.array_contains(names, F.col("kind"))).join(F.broadcast(few.select("word")), "word").select("word", F.array_position(names, F.col("kind")).alias("k"), F.col("n")).toArrow()
    rows = np.fromiter(map(number.__getitem__, parts.column("word").to_pylist()), np.int64, len(parts))
    shares[rows, parts.column("k").to_numpy() - 1] = parts.column("n").to_numpy()
    by_kinds = shares, np.array([r[1] for r in kinds], np.float64)
    ranks = spark.sparkContext.broadcast(number)
    end = int(classes_of([END], np.array([number.get(END, len(number))]))[0])

    def code(batches):
        number = ranks.value
        for part in regroup(batches, size=2 << 20):
            split = [words_of(t) + [END] for t in part.column("text").to_pylist()]
            size = np.fromiter(map(len, split), np.int64, len(split))
            begin = np.cumsum(size) - size
            words = [w for ws in split for w in ws]
            coded = pa.array(words, pa.binary()).dictionary_encode()
            ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            rank = np.fromiter(map(number.get, names, repeat(len(number))), np.int64, len(names))
            own = np.where(rank < len(number), rank, len(number) + np.arange(len(names))) | classes_of(names, rank) << CLASS_BIT
            raw = own.astype(np.uint32)[ids].tobytes()
            other = ids[rank[ids] == len(number)]
            far = [names[w] for w in other.tolist()]
            upto = np.cumsum(np.add.reduceat((rank[ids] == len(number)).astype(np.int64), begin)).tolist()
            length = np.fromiter(map(len, names), np.int64, len(names))[ids] + 1
            yield pa.RecordBatch.from_arrays(
                [part.column("row").combine_chunks(), part.column("train").combine_chunks(),
                 pa.array([raw[4 * b:4 * (b + n)] for b, n in zip(begin.tolist(), size.tolist())], pa.binary()), pa.array(np.add.reduceat(length, begin)),
                 pa.array([b" ".join(far[lo:hi]) for lo, hi in zip([0] + upto, upto)], pa.binary())],
                names=["row", "train", "ids", "n_bytes", "rare"])

    coded = staged(source.select("row", "train", "text").mapInArrow(code, _CODED), "coded")
    ranks.destroy()
    after = learn_after(coded, np.append(counts, total - counts.sum()).astype(np.float64), end)
    frequent = spark.sparkContext.broadcast((np.append(counts, 0), Kinds(10.0 ** top.column("lp").to_numpy(), counts, *by_kinds, after)))
    del top, parts, rows, shares, by_kinds, after

    def score(batches):
        counts, kinds = frequent.value
        base_of = np.log10(counts + 1) - floor
        for part in regroup(batches, size=2 << 20, column="ids"):
            size, ids, at, before = numbered_words(part, len(counts) - 1, end)
            begin = np.cumsum(size) - size
            other, same = adaptive_terms(begin, size, ids)
            rare = at == len(counts) - 1
            other = other * kinds.mixed(begin, size, at, before)
            lp = np.log10(np.where(rare, other, same + other))
            names = [w for ws in part.column("rare").to_pylist() if ws for w in ws.split(b" ")]
            far = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(same[rare] / other[rare])], names=["word", "r"])
            far = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), begin))]), pa.int32()), far)
            known = ~rare & (counts[at] > 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("row").combine_chunks(), pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.add.reduceat(np.where(rare, 0.0, base_of[at]), begin)),
                 pa.array(np.add.reduceat(lp, begin)), part.column("n_bytes").combine_chunks(),
                 far],
                names=["row", "n_tokens", "known", "base", "score", "n_bytes", "rare"])

    scored = staged(coded.select("row", "ids", "n_bytes", "rare").mapInArrow(score, _DOC), "scored")
    frequent.destroy()
    rest = (scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.r").join(priced, "word")
            .groupBy("row").agg(F.count_if(F.col("n") > 0).alias("known2"),
                                F.sum(F.log10(F.col("n") + 1) - floor).alias("base2"),
                                F.sum(log10_sum(F.col("r"), F.col("lp"))).alias("score2")))
    zero = F.lit(0.0)
    out = scored.drop("rare").join(rest, "row", "left")
    ids = source.select(F.col(key), "row", "train")
    return (ids.join(out, "row").select(
        F.col(key), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("score2", zero)).alias("score"), "n_bytes")
        .withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes")))
