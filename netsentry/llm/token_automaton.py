"""BPE encoding and decoding by a tokenization automaton.

The ordered merges of a byte-level BPE are compiled into one deterministic automaton over
tokens, whose paths are exactly the token sequences that the merges leave behind. It starts as
a single state with an arc for every byte. Each merge ``u v -> w`` then puts in its gadget: all
arcs ``u`` lead to a new state, a copy of the one they led to, without the arc ``v``; every state
with an arc ``u`` gets an arc ``w`` to where ``v`` led. All arcs with one label lead to one state, so
there is one state a merge at most, and a state is kept as its parent, the label it lost and when.

* *Arcs*: a state has an arc ``t`` unless it (or a state that it is a copy of) lost a
  token of ``t``'s left spine before that token was merged onwards. States lie in a tree, so this is
  one search per spine token in a sorted table of tree intervals. Arcs that were used are kept in a
  transition table (bounded, filled anew when full).
* *Encoding* a pre-split word follows the arcs that spell its next bytes, the longest first. A position can be
  reached by one path only, so one from which the end is not reached is marked and never tried
  again: steps grow with the word's bytes.
* *Decoding* emits the labels of the arcs.

Texts are split into words as the byte-level rule does, a few million characters at a time: a character's
class (letter, number, white space, other) is asked of the tokenizers library's own splitter when the
character is first met, so that no second Unicode version decides. Equal words of a batch are encoded once.

Defined results: null and empty texts have no ids; very long texts and words are used whole (a
word takes time in proportion to its bytes); repeated rows and null ids of rows give a row each;
an empty table gives an empty one. ``encode_texts`` puts the ids in the text column's place, and
``decode_ids`` adds the text; a column that already bears the name made is replaced, others pass.
Ids out of the vocabulary or null fail the job; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from netsentry.llm.common import regroup

MAX_ARCS = 1 << 19  # arcs in the transition table
MAX_WORDS = 1 << 19  # words whose ids are remembered per worker
MAX_REMEMBERED = 64  # bytes of such a word

_FOREVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 characters stand
    for themselves, the other bytes for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of ordered merges.

    ``labels[t]`` is the byte string of token ``t`` (None: no token), ``merges`` are ``(u, v, w)`` in order of
    priority. Each token of several bytes is made by one merge of tokens made before, each
    byte has a token of its own.
    """

    def __init__(self, labels: Sequence[bytes | None], merges: Sequence[tuple[int, int, int]]):
        n = len(labels)
        self.labels = labels
        made = {t for t, label in enumerate(labels) if label is not None and len(label) == 1}
        self.left, self.made_at = [-1] * n, [-1] * n
        self.after = [0] * n  # the state that arcs of a token lead to
        parent, lost, since, before = [-1], [-1], [-1], []
        for time, (u, v, w) in enumerate(merges):
            if u not in made or v not in made or w in made or labels[w] != labels[u] + labels[v]:
                raise ValueError(f"merge {time} does not make a new token of two tokens made before")
            made.add(w)
            self.left[w], self.made_at[w] = u, time
            old = self.after[u]
            before.append(old)
            self.after[w] = self.after[v]
            self.after[u] = len(parent)
            parent.append(old), lost.append(v), since.append(time)
        self._index(parent, lost, since)
        self.live = [label is not None for label in labels]
        for (u, v, w), old in zip(merges, before):  # a merge whose tokens never meet makes no arcs
            self.live[w] = self.live[u] and self.live[v] and self._has_arc(old, v)
        self.next: dict[int, dict[int, int]] = {}
        self.n_arcs = 0
        self.trie: dict = {}
        for t in made:
            if self.live[t]:
                node = self.trie
                for b in labels[t][:-1]:
                    node = node.setdefault(b, ({}, -1))[0]
                b = labels[t][-1]
                node[b] = (node[b][0] if b in node else {}, t)
        self.longest = max(map(len, (labels[t] for t in made)), default=1)

    def _index(self, parent: list[int], lost: list[int], since: list[int]) -> None:
        """Number the tree of copies so that a state's copies follow it, and keep for each token the
        outermost states that lost it."""
        n = len(parent)
        size = [1] * n
        for s in range(n - 1, 0, -1):
            size[parent[s]] += size[s]
        first, free = [0] * n, [1] * n
        for s in range(1, n):  # a copy is made after the state it copies
            p = parent[s]
            first[s] = first[p] + free[p]
            free[p] += size[s]
        self.first = first
        spans: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for s in sorted(range(1, n), key=first.__getitem__):
            lo, hi, when = spans.setdefault(lost[s], ([], [], []))
            if not hi or first[s] >= hi[-1]:
                lo.append(first[s]), hi.append(first[s] + size[s]), when.append(since[s])
        self.spans = spans

    def _has_arc(self, state: int, token: int) -> bool:
        at, until = self.first[state], _FOREVER
        while token >= 0:
            span = self.spans.get(token)
            if span:
                k = bisect_right(span[0], at) - 1
                if k >= 0 and at < span[1][k] and span[2][k] <= until:
                    return False
            until, token = self.made_at[token], self.left[token]
        return True

    def _fill(self, state: int, token: int) -> int:
        if self.n_arcs >= MAX_ARCS:
            self.next.clear()
            self.n_arcs = 0
        to = self.after[token] if self._has_arc(state, token) else -1
        self.next.setdefault(state, {})[token] = to
        self.n_arcs += 1
        return to

    def _spelled(self, word: bytes, at: int) -> list[int]:
        """The tokens that begin at a position, shortest first."""
        found, node = [], self.trie
        for b in word[at:at + self.longest]:
            hit = node.get(b)
            if hit is None:
                break
            node, token = hit
            if token >= 0:
                found.append(token)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids of a pre-split word."""
        n, at, state = len(word), 0, 0
        dead = bytearray(n + 1)
        table, labels = self.next, self.labels
        path, states, todo = [], [], [self._spelled(word, 0)]
        while at < n:
            options = todo[-1]
            arcs = table.get(state)
            if arcs is None:
                arcs = table[state] = {}
            while options:
                token = options.pop()
                to = arcs.get(token)
                if to is None:
                    to = self._fill(state, token)
                if to >= 0 and not dead[at + len(labels[token])]:
                    path.append(token), states.append(state)
                    at += len(labels[token])
                    state = to
                    if at < n:
                        todo.append(self._spelled(word, at))
                    break
            else:  # no path from here
                dead[at] = 1
                todo.pop()
                at -= len(labels[path.pop()])
                state = states.pop()
        return path


class Words(dict):
    """Ids of words met before."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = tuple(self.automaton.encode(word))
        if len(word) <= MAX_REMEMBERED:
            self[word] = ids
        return ids


LETTER, NUMBER, OTHER, SPACE, WHITE, UNKNOWN = range(6)  # SPACE is U+0020, WHITE all other white space


class Splitter:
    """The byte-level splitting rule: ``'s 't 're 've 'm 'll 'd``, runs of letters, of numbers or of
    others with one space before them, and white space up to its last character before a word."""

    def __init__(self):
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[0x20] = SPACE

    def _ask(self, c: str) -> int:
        for kind, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.library.pre_tokenize_str(like + c)) == 1:
                return kind
        return WHITE

    def starts(self, data: bytes, segments: np.ndarray) -> np.ndarray:
        """Byte offsets of the words of ``data``; none goes over a segment's start (byte offsets, the first 0)."""
        if not data:
            return np.zeros(0, np.int64)
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        if (kind == UNKNOWN).any():
            for c in np.unique(cp[kind == UNKNOWN]).tolist():
                self.kind[c] = self._ask(chr(c))
            kind = self.kind[cp]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.cumsum(width) - width
        n = len(cp)
        first = np.zeros(n + 1, bool)
        at = np.searchsorted(byte, segments)
        first[at[segments < len(data)]] = True
        first[n] = True
        white = kind >= SPACE
        run = np.minimum(kind, SPACE)
        start = first[:n].copy()
        start[1:] |= run[1:] != run[:-1]
        spaced = ~first[1:n] & (kind[:-1] == SPACE) & ~white[1:]  # the space goes with the word
        start[1:] &= ~spaced
        start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
        quote = np.flatnonzero((cp == 0x27) & start)
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1]]
        one = np.isin(cp[quote + 1], [ord(c) for c in "stmd"])
        two = quote[~one & (quote + 2 < n)]
        two = two[~first[two + 2]]
        pair = cp[two + 1].astype(np.int64) << 8 | cp[two + 2]
        two = two[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
        for found, size in ((quote[one], 2), (two, 3)):
            start[found + 1] = False
            end = found + size
            start[end[end < n]] = True
        return byte[start]


def read_tokenizer(path: str) -> tuple[list[bytes | None], list[tuple[int, int, int]], dict[bytes, int]]:
    """(labels of the tokens without the special ones, merges in order, special tokens) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        raise ValueError("not a byte-level BPE tokenizer without normaliser and prefix space")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take white space or whole words are not known here")
    specials = {t["content"].encode("utf-8"): t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    vocabulary = model["vocab"]
    labels: list[bytes | None] = [None] * (max([*vocabulary.values(), *specials.values()]) + 1)
    for token, t in vocabulary.items():
        if token.encode("utf-8") not in specials:
            labels[t] = bytes(letters[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return labels, [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs], specials


class ByteBpe:
    """A byte-level BPE tokenizer file as an automaton."""

    def __init__(self, path: str):
        labels, merges, self.specials = read_tokenizer(path)
        self.automaton = Automaton(labels, merges)
        self.words = Words(self.automaton)
        self.max_words = MAX_WORDS
        self.splitter = Splitter()
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def encode(self, texts: Sequence[bytes], specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last end). The strings of special
        tokens become their ids, or with ``specials=False`` those of plain text."""
        data = b"".join(texts)
        begin = np.cumsum([0, *map(len, texts)], dtype=np.int64)
        cuts = [begin[:-1]]
        marks: dict[int, bytes] = {}
        if specials and self.special and self.special.search(data):
            for lo, text in zip(begin.tolist(), texts):
                marks |= {lo + m.start(): m.group() for m in self.special.finditer(text)}
            cuts += [np.fromiter(marks, np.int64), np.array([at + len(s) for at, s in marks.items()])]
        start = self.splitter.starts(data, np.unique(np.concatenate(cuts)))
        if marks:
            at = np.fromiter(marks, np.int64)
            inside = np.searchsorted(at, start, "right") - 1
            ends = at + np.fromiter(map(len, marks.values()), np.int64)
            start = start[(inside < 0) | (start >= ends[inside]) | (start == at[inside])]
        offsets = pa.array(np.append(start, len(data)), pa.int64())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, offsets.buffers()[1], pa.py_buffer(data)])
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        lookup = self.words.__getitem__
        if marks:
            ids = [lookup(w) if w not in self.specials else (self.specials[w],) for w in known]
        else:
            ids = list(map(lookup, known))
        if len(self.words) > self.max_words:
            self.words.clear()
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        code = coded.indices.to_numpy()
        each = size[code]
        ends = np.cumsum(each)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[code] - (ends - each), each)
        return flat[where], np.append(0, ends)[np.searchsorted(start, begin)]

@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """The automaton of a tokenizer file, compiled once per worker."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def arc_labels(path: str) -> list[bytes | None]:
    """What each id spells, special tokens included."""
    labels, _, specials = read_tokenizer(path)
    for text, t in specials.items():
        labels[t] = text
    return labels


def spell(labels: Sequence[bytes | None], ids: Iterable[int]) -> str:
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def _kept(df: DataFrame, *without: str) -> list[str]:
    return [c for c in df.columns if c not in without]


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids", specials: bool = True) -> DataFrame:
    """``docs`` with ``out``, the token ids, in the place of the text column. The strings of special
    tokens become their ids, or with ``specials=False`` those of plain text."""
    kept = _kept(docs, text, out)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for rows in regroup(batches, column=text):
            ids, ends = bpe.encode([t or b"" for t in rows[text].cast(pa.binary()).to_pylist()], specials)
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield from rows.select(kept).append_column(out, column).combine_chunks().to_batches()

    return docs.select(*kept, F.col(text)).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with ``out``, the text that the ids spell (special tokens as their strings)."""
    kept = _kept(docs, out)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(path)
        for rows in regroup(batches, column=ids):
            column = rows[ids].combine_chunks()
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("a token id is null")
            flat = flat.to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= len(labels)):
                raise ValueError("a token id is not in the vocabulary")
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())])
            texts = [spell(labels, flat[lo:hi].tolist()) for lo, hi in zip(ends[:-1], ends[1:])]
            yield from rows.select(kept).append_column(out, pa.array(texts, pa.string())).combine_chunks().to_batches()

    return docs.select(*kept).mapInArrow(run, schema)
