"""The pipeline's stages, one after the other, against brute force, and what they do
with nulls, repeated rows, clashing column names and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

#: Extra columns under names that the operators make themselves.
CLASHING = ("row", "_runs", "n_hit", "hit_items", "toxic_score", "toxic_terms", "component_id", "n_shingles", "runs", "_4")
NAMES = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{k}" for k in range(400) for a in ("wor", "élan", "Mot")]

    def prose(n):
        return [rnd.choice(words) for _ in range(n)]

    texts, toxic = [" ".join(prose(rnd.randint(20, 80))) for _ in range(150)], {}
    for k in range(150):
        if k % 4 == 0:
            texts[k] += " vile Slur"
        toxic[k] = int(k % 4 == 0)
    clean = len(texts)
    base = prose(120)
    for _ in range(12):  # near and exact copies
        t = list(base)
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(120)] = rnd.choice(words)
        texts.append(" ".join(t))
    passage = " ".join(prose(60))
    texts += [" ".join([*prose(30), passage, *prose(25)]) for _ in range(6)]
    item = prose(14)
    texts += [" ".join([*prose(20), *item[2:13], *prose(20)]), " ".join([*prose(20), *item[:9], *prose(20)])]
    texts += ["", None, " \n", "one", "Long words, " * 3000]
    return texts, toxic, [" ".join(item), None, ""], clean


def jaccard_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    return low


def without_repeats(texts, n=200):
    seen = Counter(d[k:k + n] for t in texts.values() for d in [(t or "").encode()] for k in range(len(d) - n + 1))
    out = {}
    for i, t in texts.items():
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        out[i] = None if t is None else bytes(c for c, g in zip(d, gone) if not g).decode("utf-8", "ignore")
    return out


def leaks(text, items):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    w = cut(text)
    windows = {tuple(p[k:k + min(10, len(p))]) for p in map(cut, items) if p for k in range(max(1, len(p) - 9))}
    return any(tuple(w[k:k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    texts, toxic, items, clean = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "xx", None, None if t is None else len(t), *(["kept"] * len(CLASHING))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*toxic.items(), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, dict(enumerate(texts)), toxic, items


def test_stages(spark, tables):
    at, texts, toxic, items = tables
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{at}/documents.parquet")
    assert list(stages) == ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "packing"]

    def after(name):
        nonlocal docs
        docs = stages[name](spark, docs, at).cache()
        assert docs.columns == NAMES and all(r[c] == "kept" for r in docs.select(*CLASHING).collect() for c in CLASHING)
        return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

    texts = {i: t for i, t in texts.items() if not toxic.get(i)}
    assert after("toxicity") == texts
    low = jaccard_classes(texts)
    texts = {i: t for i, t in texts.items() if low[i] == i}
    assert after("ngram_join") == texts
    texts = without_repeats(texts)
    assert after("suffix_dedup") == texts
    assert {r.doc_id: r.n_chars for r in docs.collect()} == {i: None if t is None else len(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not leaks(t, items)}
    assert after("decontamination") == texts
    packed(stages["packing"](spark, docs, at).collect(), texts)


def packed(rows, texts):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences[r.sequence_id]
        sequences[r.sequence_id] += r.length
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts) and max(sequences.values()) <= 4096
    for i, t in texts.items():
        ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)


def test_run(spark, tables):
    at, texts, toxic, items = tables
    texts = {i: t for i, t in texts.items() if not toxic.get(i)}
    low = jaccard_classes(texts)
    texts = without_repeats({i: t for i, t in texts.items() if low[i] == i})
    packed(corpus_pipeline.run(spark, at).collect(), {i: t for i, t in texts.items() if not leaks(t, items)})


def test_null_and_repeated_rows(spark, tables):
    at = tables[0]
    odd = [(None, "a text of some words", None, None, 20), (900, "another text of more words", "x", "y", 26),
           (900, "another text of more words", "x", "y", 26), (901, None, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, at)
        assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(odd), name
    pieces, tokens = corpus_pipeline.pack(spark, docs, at).collect(), Counter()
    for r in pieces:  # a document may be cut into several pieces
        tokens[r.doc_id] += r.length / r.doc_tokens
    assert {i: round(n, 9) for i, n in tokens.items()} == Counter(r[0] for r in odd)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[0])
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
