"""Phrase mining against counting every phrase in plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from netsentry.llm import collocations

SCHEMA = "doc_id long, text string, lang string, f long, phrase string"
WORD = re.compile(rb"[^\x20\x09]+")
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")


def phrases(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in BREAK.split(lowered):
            words = WORD.findall(piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    return {p: c for p, c in f.items() if c >= least}, {la: c for la, c in n.items() if c}


def mined(rows, least, top):
    f, n = phrases(rows, least)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(la == lang and len(q) > len(p) and 100 * c >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                             for (la, q), c in f.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    rank, got = collections.Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "cat", "sat", "on", "mat", "é", "日本", "x-y", "rare%d" % seed]
    fixed = ["the cat sat on the mat", "of the of the of the", "cat  sat\ton, mat", "one two three four five six"]
    out = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choices(words, [9, 2, 7, 3, 3, 2, 2, 1, 1, 1, 1])[0] for _ in range(r.randrange(30))]
        out.append((r.choice([" ", "  ", " ", ". ", "\n"]).join(parts) + r.choice(["", "!", " ", "\n\n"]), r.choice(["en", "en", "de", None, ""])))
    return out + [(None, "en"), ("", None), ("...!?", "de"), ("the the the the the the the the the the", "en"), ("same words here again", "fr")] + [("same words here again", "fr")] * 40


@pytest.mark.parametrize("seed,least,share_bits,top", [(1, 3, 0, 2000), (2, 3, 6, 2000), (3, 2, 13, 2000), (4, 5, 4, 7)])
def test_mined_phrases(spark, monkeypatch, seed, least, share_bits, top):
    monkeypatch.setattr(collocations, "FILTER_BITS", 12 if seed % 2 else 25)
    rows = texts(seed)
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, t, la, 1, "z") for i, (t, la) in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in collocations.mine_collocations(docs, least, top, share_bits).collect())
    assert got == mined(rows, least, top)
    assert got


def test_long_text_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    monkeypatch.setattr(collocations, "SLICE", 100)
    r = random.Random(5)
    long = " ".join(r.choice(["a", "b", "c", "d e f", "g,", "%d" % r.randrange(3000)]) for _ in range(40000))
    rows = [(long, "en"), ("a b c d", "en")]
    got = sorted(tuple(x) for x in collocations.mine_collocations(spark.createDataFrame([(1, *x, 1, "z") for x in rows], SCHEMA), 30, 2000, 5).collect())
    assert got == mined(rows, 30, 2000)


def test_counts_are_whole(spark):
    rows = texts(9)
    f, n = phrases(rows, 4)
    counts, totals = collocations.phrase_counts(spark.createDataFrame([(1, *x, 1, "z") for x in rows], SCHEMA), 4, share_bits=5)
    assert {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()} == {(la, b" ".join(p).decode()): c for (la, p), c in f.items()}
    assert {r["lang"]: r["n"] for r in totals.collect()} == n


def test_score_is_exact_beyond_64_bits(spark):
    big = 10 ** 13 + 7
    counts = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 3 * big + 1), ("en", "a b", big)], "lang string, phrase string, f long")
    assert collocations.score_phrases(counts).first()["score"] == 2000000 * big // (6 * big + 1)


@pytest.mark.parametrize("seed", range(20))
def test_partition_counts_prefixes(seed):
    r = random.Random(seed)
    table = np.array([[r.randrange(4) if k < depth else -1 for k in range(3)] for depth in [r.randrange(1, 4) for _ in range(300)]], np.int32)
    rows = np.array(r.sample(range(300), 200))
    want = collections.Counter(tuple(row[:k].tolist()) for row in table[rows] for k in (1, 2, 3) if row[k - 1] >= 0)
    assert dict(collocations.partition(table, rows, 5)) == {p: c for p, c in want.items() if c >= 5}


def test_empty_tables(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([(1, None, None, 1, "z")], SCHEMA)).collect() == []
