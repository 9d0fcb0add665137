"""The tokenization automaton against plain merging, the tokenizers library and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsentry.llm import token_automaton
from netsentry.llm.queries import op12_token_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


def merged(word, labels, merges):
    """Merge by merge in order, each from left to right."""
    ids = [labels.index(bytes([b])) for b in word]
    for u, v, w in merges:
        k = 0
        while k + 1 < len(ids):
            if (ids[k], ids[k + 1]) == (u, v):
                ids[k:k + 2] = [w]
            k += 1
    return ids


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_merging_in_order(seed):
    r = random.Random(seed)
    labels, merges, seen = [b"a", b"b", b"c"], [], {b"a", b"b", b"c"}
    while len(merges) < 25:
        u, v = r.randrange(len(labels)), r.randrange(len(labels))
        if labels[u] + labels[v] not in seen:
            seen.add(labels[u] + labels[v])
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    machine = token_automaton.Automaton(labels, merges)
    for _ in range(300):
        word = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40)))
        assert machine.encode(word) == merged(word, labels, merges), word


def test_bad_merges_are_refused():
    with pytest.raises(ValueError):
        token_automaton.Automaton([b"a", b"b", b"ab", b"abb"], [(2, 1, 3), (0, 1, 2)])


def odd_texts():
    r = random.Random(4)
    parts = ["'s", "'re", "'ll", "'", "''s", "a", "th", "ing", " ", "  ", "\n", "\t", "1", "é", "日", "\U0001f600", "\x85", " ", "<|endoftext|>", "<|endo", "!?"]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(800)]
    out += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(300)]
    return out + ["", None, "<|endoftext|>" * 2, "a" * 3000, "ab" * 2000, " " * 3000, "same", "same"]


def test_ids_and_round_trip(spark):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, "x", "y", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, name string, ids array<int>").coalesce(1)
    for specials in (True, False):
        library = Tokenizer.from_file(PATH)
        library.encode_special_tokens = not specials
        coded = token_automaton.encode_texts(docs, PATH, specials=specials)
        assert coded.columns == ["doc_id", "row", "name", "ids"]
        back = token_automaton.decode_ids(coded, PATH).collect()
        for row, text in zip(back, texts, strict=True):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert row["ids"] == ids and row["text"] == library.decode(ids, skip_special_tokens=False) == (text or "")


def test_decoding_any_ids(spark):
    r = random.Random(2)
    ids = [[r.randrange(50257) for _ in range(r.randrange(40))] for _ in range(300)]
    library = Tokenizer.from_file(PATH)
    out = token_automaton.decode_ids(spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(-1, None)], "n int, ids array<int>"), PATH)
    got = {row["n"]: row["text"] for row in out.collect()}
    assert got.pop(-1) == ""
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}
    with pytest.raises(Exception, match="vocabulary"):
        token_automaton.decode_ids(spark.createDataFrame([([60000],)], "ids array<int>"), PATH).collect()


def test_query_over_the_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_token_automaton(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_automaton.decode_ids(token_automaton.encode_texts(docs, PATH), PATH).collect() == []
