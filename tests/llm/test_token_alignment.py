"""Token alignment against whole texts encoded by the libraries and counted in plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from netsentry.llm import token_alignment
from netsentry.llm.queries import op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {c: b for c, b in zip((chr(b) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b else None for b in range(256)), range(256)) if c}
LETTERS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS.values())}


def both(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for text in texts:
        if not text:
            yield None
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        yield (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None


def ends(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def expected(texts):
    rows, corpus = [], collections.Counter()
    for pair in both(texts):
        if pair is None:
            rows.append(None)
            continue
        a, b = map(ends, pair)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [f"{','.join(str(i) for i, _, e in a if lo < e <= hi)}|{','.join(str(i) for i, _, e in b if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e]
        corpus.update(links)
        rows.append((len(a), len(b), groups, links))
    top = collections.Counter()
    for (_, j), n in corpus.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(corpus[p] == top[p[1]] for p in r[3]), sum(corpus[p] for p in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
            for r in rows]


def odd_texts():
    r = random.Random(8)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "'s", "é", "日本", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", ".", "12", "x\ny", "\x85", "ſ", "\x01"]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(150)]
    return out + [None, "", " ", "   ", "a▁b", "▁", "a ", "a  b ", " lead", "same text twice", "same text twice", "\n", "ab" * 400, " \n "]


def test_against_whole_texts(spark):
    texts = odd_texts()
    rows = [(None if i % 11 == 0 else i, t, i, [1], "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run long, part array<int>, n_a string").repartition(4)
    scored = token_alignment.score_alignment(docs, A, B, part_bits=6)
    assert scored.columns == ["doc_id", "run", "part", *token_alignment.RESULT]
    got = {r["run"]: tuple(r[c] for c in token_alignment.RESULT) for r in scored.collect()}
    want = expected(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], t
    groups = {r["run"]: r["groups"] for r in token_alignment.align_texts(docs, A, B).collect()}
    for i, w in enumerate(want):
        assert hashlib.sha256(groups[i].encode()).hexdigest() == w[-1] if w[0] else groups[i] is None


@pytest.mark.parametrize("seed", range(10))
def test_merging_runs(seed):
    r = random.Random(seed)
    data = [{r.randrange(5) * 100 + r.randrange(6): r.randrange(1, 4) for _ in range(r.randrange(12))} for _ in range(7)]
    runs = [(np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64)) for d in data]
    total = collections.Counter()
    for d in data:
        total.update(d)
    top = {p // 100: max(n for q, n in total.items() if q // 100 == p // 100) for p in total}
    assert token_alignment.merge_runs(runs, 100) == [([total[p] for p in sorted(d)], [total[p] == top[p // 100] for p in sorted(d)]) for d in data]


def test_query_over_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    short = [(i, t) for i, t in rows]
    want = expected_fast([t for _, t in short])
    assert got == {i: w for (i, _), w in zip(short, want)}


def expected_fast(texts):
    """``expected`` with links found by offsets instead of all pairs of a document."""
    rows, corpus = [], collections.Counter()
    for pair in both(texts):
        if pair is None:
            rows.append(None)
            continue
        a, b = map(ends, pair)
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        owner = [j for j, s, e in b for _ in range(s, e)]
        place = [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
        links = [(i, b[k][0]) for i, s, e in a for k in sorted(set(place[s:e]))]
        assert len(owner) == b[-1][2]
        texts_of = []
        for side in (a, b):
            parts, held = [], []
            for i, _, e in side:
                held.append(str(i))
                if e in cuts:
                    parts.append(",".join(held))
                    held = []
            texts_of.append(parts)
        groups = [f"{x}|{y}" for x, y in zip(*texts_of, strict=True)]
        corpus.update(links)
        rows.append((len(a), len(b), groups, links))
    top = collections.Counter()
    for (_, j), n in corpus.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(corpus[p] == top[p[1]] for p in r[3]), sum(corpus[p] for p in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
            for r in rows]


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert token_alignment.score_alignment(spark.createDataFrame([], schema), A, B).collect() == []
    assert tuple(token_alignment.score_alignment(spark.createDataFrame([(1, None)], schema), A, B).first()) == (1, 0, 0, 0, 0, 0, 0, "")
