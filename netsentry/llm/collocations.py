"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

A suffix is a word position and the words after it in its piece, up to the longest phrase. Suffixes
are dealt over the cluster by their leading words, so that all that begin alike meet; there
they are sorted as pointers into a table of word numbers, one word deeper at each level:
a pivot word parts the pointers into smaller, equal and larger ones, the size of the equal part is the count of
the phrase read so far, and a part of fewer pointers than the least count is abandoned.

1. Words are counted per language in each batch and summed by Spark. From these counts come ``n``, the words that
   a phrase can hold (as a bitmap of fixed size: hashes of words that occur often enough; a word that is let through by
   chance only costs time), and the *frequent* words, fewer than ``2 ** SHARE_BITS`` of them.
2. A suffix ends before the first word that cannot be in a phrase. It is dealt by its first word;
   while the words read so far are all frequent ones, by one word more. So a group of suffixes
   holds no more than the count of a word that is not frequent (one in ``2 ** SHARE_BITS`` of all; raise it for corpora whose
   groups would not fit a task), or suffixes that are all alike, which are sent as a number. The counts of phrases that are shorter than what they were dealt by are sums over groups.
3. Spark sorts the groups (its sort spills to disk); a task reads group after group, a few
   megabytes at a time, and sorts each by the multikey quicksort.
4. Phrases are scored by joins with the counts of their parts. A phrase inside a longer one can only be dropped for
   one of the phrases a word longer, whose counts are no smaller than those of still longer ones.

Words and pieces: A-Z are lower-cased; texts are split into pieces at ``.,;:!?`` and the characters from U+000A
to U+000D, pieces into words at spaces and tabs. All is bytes of UTF-8.

Defined results: null and empty texts have no words; a null language is ``und``; very long texts
are used whole; repeated rows count each; ties are broken as ``rank_phrases`` says; an empty table
gives an empty one; no other column is read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsentry.llm.common import regroup, release, staged

MAX_WORDS = 4  # words of the longest phrase
FILTER_BITS = 25  # the bitmap of words that occur often enough has 2 ** FILTER_BITS bits
SHARE_BITS = 10  # a frequent word is more than one in 2 ** SHARE_BITS words, so there are fewer than that
BATCH = 8 << 20  # bytes of text that are cut into words at once
CHUNK = 8 << 20  # bytes of suffixes that are sorted at once, beyond a whole group
SLICE = 1 << 17  # suffixes that are copied at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


def binary_array(data: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings of the given sizes that lie one after the other in ``data``."""
    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] steps, then the same for start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Words:
    """The words of a batch of texts: ``data`` holds them one after the other, each with a space after it."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        joined = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
        kind = _KIND[joined]
        word = kind == 0
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.size = end - start
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        spaced = word.copy()
        spaced[end[end < len(joined)]] = True  # the byte after a word becomes its space
        self.data = _LOWER[joined[spaced]]
        if len(end) and end[-1] == len(joined):
            self.data = np.append(self.data, np.uint8(32))
        self.at = np.append(0, np.cumsum(self.size + 1))
        self.data[self.at[1:] - 1] = 32
        begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])[:-1]
        self.lang_names, lang = np.unique(np.array([la.encode("utf-8") for la in langs] or [b""], object), return_inverse=True)
        of_text = np.searchsorted(begin, start, "right") - 1
        coded = binary_array(_LOWER[joined[word]], self.size).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        key = lang[of_text].astype(np.int64) * max(len(self.words), 1) + coded.indices.to_numpy()
        #: Each distinct pair of language and word has a number; ``code`` is that of each word.
        self.pairs, self.code = np.unique(key, return_inverse=True)
        self.pair_lang, self.pair_word = np.divmod(self.pairs, max(len(self.words), 1))

    def named(self) -> Iterator[tuple[bytes, bytes]]:
        """(language, word) of each pair."""
        for la, w in zip(self.pair_lang.tolist(), self.pair_word.tolist()):
            yield self.lang_names[la], self.words[w]


def text_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[Words]:
    for rows in regroup(batches, rows=1 << 20, size=BATCH):
        yield Words(rows["text"].cast(pa.binary()).to_pylist(), rows["lang"].to_pylist())


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words in text_batches(batches):
        n = np.bincount(words.code, minlength=len(words.pairs))
        names = list(words.named())
        yield pa.RecordBatch.from_arrays([pa.array([la.decode() for la, _ in names], pa.string()), pa.array([w for _, w in names], pa.binary()).cast(pa.string()),
                                          pa.array(n, pa.int64())], ["lang", "word", "n"])


def deal_suffixes(bitmap: np.ndarray, frequent: set[tuple[bytes, bytes]], longest: int):
    """Batches of texts to rows (lang, lead, same, tails): the suffixes that begin with the words ``lead``, ``tails`` the
    words after it, a line for each suffix, and ``same`` the number of those that end with it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in text_batches(batches):
            yield from deal(words)
        release()

    def deal(words: Words) -> Iterator[pa.RecordBatch]:
        names = list(words.named())
        bits = np.fromiter((crc32(la + b" " + w) for la, w in names), np.int64, len(names)) >> (32 - FILTER_BITS)
        usual = (bitmap[bits >> 3] >> (bits & 7) & 1).astype(bool)[words.code]
        hot = np.fromiter((p in frequent for p in names), bool, len(names))[words.code]
        n = len(words.code)
        size = usual.astype(np.int64)  # words of the suffix
        deep = np.where(usual, hot, False).astype(np.int64)  # frequent words it begins with
        for k in range(1, longest):
            on = np.zeros(n, bool)
            on[:n - k] = usual[k:] & (words.piece[k:] == words.piece[:n - k]) & (size[:n - k] == k)
            size += on
            on[:n - k] &= hot[k:] & (deep[:n - k] == k)
            deep += on
        at = np.flatnonzero(size > 1)
        if not len(at):
            return
        size, lead = size[at], np.minimum(deep[at] + 1, size[at])
        group, base = words.code[at].astype(np.int64), len(words.pairs)
        for k in range(1, longest):
            more = np.flatnonzero(lead > k)
            pair = group[more] * len(words.pairs) + words.code[at[more] + k]
            distinct, number = np.unique(pair, return_inverse=True)
            group[more] = base + number
            base += len(distinct)
        order = np.argsort(group, kind="stable")
        at, size, lead, group = at[order], size[order], lead[order], group[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ended = size == lead
        same = np.add.reduceat(ended.astype(np.int64), first)
        tail_size = np.where(ended, 0, words.at[at + size] - words.at[at + lead])
        parts = [np.zeros(0, np.uint8)]
        for lo in range(0, len(at), SLICE):
            part, length = at[lo:lo + SLICE] + lead[lo:lo + SLICE], tail_size[lo:lo + SLICE]
            bytes_ = words.data[spread(words.at[part], length)]
            bytes_[np.cumsum(length)[length > 0] - 1] = 10
            parts.append(bytes_)
        head = at[first]
        lead_size = words.at[head + lead[first]] - words.at[head] - 1
        yield from pa.Table.from_arrays(
            [pa.array([words.lang_names[la].decode() for la in words.pair_lang[words.code[head]].tolist()], pa.string()),
             binary_array(words.data[spread(words.at[head], lead_size)], lead_size).cast(pa.binary()).cast(pa.string()),
             pa.array(same, pa.int64()), binary_array(np.concatenate(parts), np.add.reduceat(tail_size, first)).cast(pa.binary())],
            ["lang", "lead", "same", "tails"]).to_batches(max_chunksize=1 << 14)

    return run


def partition(table: np.ndarray, pointers: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Multikey three-way quicksort of rows of word numbers (-1: no word): each sequence of first words that at least
    ``least`` of the pointers share, with their number. Parts with fewer pointers are abandoned."""
    todo = [(pointers, 0, ())]
    while todo:
        part, depth, words = todo.pop()
        key = table[part, depth]
        a, b, c = sorted((int(key[0]), int(key[len(key) // 2]), int(key[-1])))
        small, large = key < b, key > b
        equal = part[~(small | large)]
        if b >= 0 and len(equal) >= least:
            yield (*words, b), len(equal)
            if depth + 1 < table.shape[1]:
                todo.append((equal, depth + 1, (*words, b)))
        for side in (part[small], part[large]):
            if len(side) >= least:
                todo.append((side, depth, words))


def count_phrases(frequent: set[tuple[bytes, bytes]], least: int, longest: int):
    """Sorted groups of suffixes to rows (lang, phrase, f). Phrases of frequent words only that are no longer than what
    their group was dealt by come with the share that a chunk of groups has of their count."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            key = list(zip(batch["lang"].to_pylist(), batch["lead"].to_pylist()))
            tails = np.append(0, np.cumsum(pc.binary_length(batch["tails"]).to_numpy(zero_copy_only=False), dtype=np.int64))
            lo = 0
            for k, this in enumerate(key):
                if this != last and size + tails[k] - tails[lo] >= CHUNK:
                    held.append(batch.slice(lo, k - lo))
                    yield from count(pa.Table.from_batches(held))
                    held, size, lo = [], 0, k
                last = this
            held.append(batch.slice(lo))
            size += int(tails[-1] - tails[lo])
        if held:
            yield from count(pa.Table.from_batches(held))
        del held
        release()

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, leads = rows["lang"].to_pylist(), rows["lead"].to_pylist()
        data = np.frombuffer(b"".join(tails := rows["tails"].to_pylist()), np.uint8)
        end = np.flatnonzero((data == 10) | (data == 32))
        start = np.append(0, end + 1)[:len(end)]
        coded = binary_array(data[(data != 10) & (data != 32)], end - start).dictionary_encode()
        known = coded.dictionary.to_pylist()
        line_end = np.flatnonzero(data == 10)
        line = np.searchsorted(line_end, start)
        first_word = np.searchsorted(start, np.append(0, line_end[:-1] + 1)) if len(line_end) else np.zeros(0, np.int64)
        table = np.full((len(line_end), longest), -1, np.int32)
        table[line, np.arange(len(start)) - first_word[line]] = coded.indices.to_numpy()
        lines = np.searchsorted(line_end, np.cumsum([0, *map(len, tails)]))  # lines before each row
        same = rows["same"].to_numpy()
        out: tuple[list, list, list] = ([], [], [])

        def put(lang: str, phrase: str, f: int) -> None:
            for column, value in zip(out, (lang, phrase, f)):
                column.append(value)

        shares: dict[tuple[str, str], int] = {}
        lo = 0
        while lo < len(leads):
            hi = lo + 1
            while hi < len(leads) and (langs[hi], leads[hi]) == (langs[lo], leads[lo]):
                hi += 1
            lang, lead = langs[lo], leads[lo].split(" ")
            total = int(same[lo:hi].sum() + lines[hi] - lines[lo])
            deep = len(lead) if (lang.encode(), lead[-1].encode()) in frequent else len(lead) - 1
            for k in range(2, deep + 1):
                of = lang, " ".join(lead[:k])
                shares[of] = shares.get(of, 0) + total
            if total >= least and deep < len(lead) and len(lead) > 1:
                put(lang, leads[lo], total)
            if lines[hi] - lines[lo] >= least:
                for words, f in partition(table, np.arange(lines[lo], lines[hi]), least):
                    put(lang, b" ".join([leads[lo].encode(), *(known[w] for w in words)]).decode(), f)
            lo = hi
        for (lang, phrase), f in shares.items():
            put(lang, phrase, f)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = MAX_WORDS, share_bits: int = SHARE_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, (lang, n))."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = staged(rows.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    place = F.shiftright(F.crc32(F.concat_ws(" ", "lang", "word")), 32 - FILTER_BITS)
    cells = often.select(place.alias("place")).groupBy(F.shiftright("place", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(place & 7 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << max(FILTER_BITS - 3, 0), np.uint8)
    bitmap[cells["byte"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint8)
    everything = words.agg(F.sum("f")).first()[0] or 0
    bound = (everything >> share_bits) + 1
    frequent = {(r["lang"].encode(), r["word"].encode()) for r in words.where(F.col("f") >= bound).select("lang", "word").collect()}
    dealt = rows.mapInArrow(deal_suffixes(bitmap, frequent, longest), "lang string, lead string, same long, tails binary")
    sorted_ = dealt.repartition("lang", "lead").sortWithinPartitions("lang", "lead")
    phrases = sorted_.mapInArrow(count_phrases(frequent, least, longest), "lang string, phrase string, f long")
    phrases = phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return staged(phrases.unionByName(often.select("lang", F.col("word").alias("phrase"), "f")), "collocation-phrases"), totals


def score_phrases(counts: DataFrame, covered: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and more words that no phrase a word longer covers.

    ``score`` is floor(2000000 * a / (l + r)) at the cut that gives least (ties: the first)."""
    num, den = covered
    split = F.split("phrase", " ")
    many = counts.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).where(F.size("w") > 1)
    longer = many.where(F.size("w") > 2).select(
        "lang", "a", F.explode(F.array(F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " "), F.array_join(F.expr("slice(w, 2, size(w) - 1)"), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = many.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * den < F.col("a") * num))
    cut = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("rest"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0)) as long)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def rank_phrases(scored: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The ``top`` phrases of each language by score and count, both descending, then by the phrase's bytes: first of each
    of ``parts`` parts of a language, then of what these leave, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    kept = scored.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_part")


def mine_collocations(docs: DataFrame, least: int = 30, top: int = 2000, share_bits: int = SHARE_BITS) -> DataFrame:
    """The best phrases of two to ``MAX_WORDS`` words of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, least, share_bits=share_bits)
    return rank_phrases(score_phrases(counts), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
