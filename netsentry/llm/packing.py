"""Hierarchical multi-length packing of tokenised documents.

1. Routing. A document longer than the longest window is cut into whole
   windows; what is left, and every shorter document, goes to the smallest
   tier (512, 1024, 2048, 4096 tokens) that holds it.
2. Packing. Tier by tier, longest first, pieces open a window of the tier's
   length. The gap that a piece leaves in its window is filled with whole pieces
   of the same and of shorter tiers, best fit first.
3. What is then still open is filled exactly by cutting one more short piece,
   so that all but the last windows of a task hold no padding at all.
4. The last windows are cut into power-of-two lengths, the tiers below the
   shortest included, so they need no padding either.
5. Sequences of one tier are dealt to step groups of equal token counts.

A task tokenises and packs the rows of its own scan partition, ``BUFFER``
documents at a time: nothing is shuffled, memory is bounded by the buffer,
and a task that is run again packs the same rows in the same way. Sequence
ids are (partition, counter).

Tokenising: the tokenizer drops white space and never joins across it, so a
text is the sequence of its white-space-free pieces; a distinct piece is encoded
once and remembered.

Defined results: null and empty texts are the end token alone; very long
texts become many windows; equal documents are packed each for itself;
repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import batch_of, regroup, utf8

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BUFFER = 2048
STEP_TOKENS = 1 << 16
_LETTERS = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("sequence_length", pa.int64()), ("tier", pa.int64()), ("step", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step long"


class WordTokenizer(dict):
    """Ids (little-endian unsigned 32-bit) of each white-space-free piece of a
    text. Pieces of letters with closing punctuation, the great majority, are
    two words to the tokenizer's own splitter and go straight to its BPE
    model; all others go through the whole tokenizer."""

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model, self.alphabet = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.id_bytes = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[bytes, bytes] = {}
        self.letters: dict[str, str] = {}
        self.end = END_ID.to_bytes(4, "little")

    def whole(self, piece: bytes) -> bytes:
        return b"".join([self.id_bytes[n] for n in self.tokenizer.encode(piece.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids])

    def part(self, word: bytes) -> bytes:
        """Ids of a run of letters."""
        got = self.parts.get(word)
        if got is None:
            text = word.decode()
            if word.isascii():
                mapped = text
            elif text.lower() == text and is_normalized("NFC", text):
                mapped = "".join([self.letters.get(c) or self.letters.setdefault(c, self.alphabet.pre_tokenize_str(c)[0][0]) for c in text])
            else:
                mapped = None
            got = self.whole(word) if mapped is None else b"".join([self.id_bytes[t.id] for t in self.model.tokenize(mapped)])
            self.parts[word] = got
        return got

    def __missing__(self, piece: bytes) -> bytes:
        m = _LETTERS.fullmatch(piece)
        if m and (piece.isascii() or m[1].decode().isalpha()):
            ids = self.part(m[1]) + (self.get(m[2]) or self.setdefault(m[2], self.whole(m[2])) if m[2] else b"")
        else:
            ids = self.whole(piece)
        self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) + len(self.parts) > self.keep:
            self.clear()
            self.parts.clear()
        out = []
        for text in texts:
            data = utf8(text)
            if b"<|" not in data:  # special tokens are found before letters are lowered
                data = data.lower()
            out.append(np.frombuffer(b"".join([*map(self.__getitem__, data.split()), self.end]), "<u4"))
        return out


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: the pieces it knows serve the worker's next tasks."""
    return WordTokenizer(path)


class Packer:
    """Packs the pieces of one buffer into sequences (lists of pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers

    def route(self, lengths: list[int]) -> tuple[list[list], dict[int, list]]:
        """Whole windows of long documents, and per tier its (length, doc, start)."""
        top = self.tiers[-1]
        whole, by_tier = [], {t: [] for t in self.tiers}
        for doc, n in enumerate(lengths):
            cut = n - n % top if n > top else 0
            whole += [[(top, doc, s)] for s in range(0, cut, top)]
            if n > cut:
                by_tier[next(t for t in self.tiers if t >= n - cut)].append((n - cut, doc, cut))
        return whole, by_tier

    def pack(self, lengths: list[int]) -> list[list]:
        whole, by_tier = self.route(lengths)
        done, open_ = whole, []
        pool = sorted(p for pieces in by_tier.values() for p in pieces)  # the longest last
        while pool:
            piece = pool.pop()
            tier = next(t for t in self.tiers if t >= piece[0])
            window, gap = [piece], tier - piece[0]
            while gap and pool and (k := bisect_right(pool, (gap, len(lengths), 0))):
                fit = pool.pop(k - 1)
                window.append(fit)
                gap -= fit[0]
            if gap and pool:  # nothing whole fits: cut the shortest piece to fill the gap
                n, doc, start = pool.pop(0)
                window.append((gap, doc, start))
                insort(pool, (n - gap, doc, start + gap))
                gap = 0
            (open_ if gap else done).append(window)
        return done + [part for window in open_ for part in self.split(window)]

    @staticmethod
    def split(window: list) -> Iterator[list]:
        """A window with a gap as full windows of power-of-two lengths."""
        left = sum(p[0] for p in window)
        queue = list(window)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            part = []
            while room:
                n, doc, start = queue.pop(0)
                part.append((min(n, room), doc, start))
                if n > room:
                    queue.insert(0, (n - room, doc, start + room))
                room -= min(n, room)
            left -= size
            yield part


def pack_batches(batches: Iterable[pa.RecordBatch], path: str, tiers: tuple[int, ...], partition: int) -> Iterator[pa.RecordBatch]:
    tokenizer, packer, serial = word_tokenizer(path), Packer(tiers), 0
    tokens_of_tier: dict[int, int] = {}
    for part in regroup(batches, BUFFER):
        doc_ids = part.column(0).to_pylist()
        ids = tokenizer.encode(part.column(1).to_pylist())
        rows: dict[str, list] = {name: [] for name in SCHEMA.names}
        for window in packer.pack([len(x) for x in ids]):
            size = sum(p[0] for p in window)
            tier = next(t for t in tiers if t >= size)
            step = tokens_of_tier.get(tier, 0) // STEP_TOKENS
            tokens_of_tier[tier] = tokens_of_tier.get(tier, 0) + size
            offset = 0
            for n, doc, start in window:
                values = (doc_ids[doc], start, n, zlib.crc32(ids[doc][start:start + n].tobytes()), len(ids[doc]),
                          (partition << 32) + serial, offset, size, tier, step)
                for column, v in zip(rows.values(), values):
                    column.append(v)
                offset += n
            serial += 1
        yield batch_of(SCHEMA, **rows)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row per piece: its document, place in the document, checksum of its
    ids, sequence and place there, and the sequence's length, tier and step."""
    def run(batches):
        yield from pack_batches(batches, tokenizer_path, tiers, TaskContext.get().partitionId())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)
