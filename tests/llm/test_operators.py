"""The training-data operators against brute force on small fixtures, with
nulls, empty texts, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netsentry.llm import (context_mixing, decontaminate, embedding_join, html_text, licenses, ngram_join, packing,
                           substring_dedup, toxicity, url_filter)

DOCS = "doc_id long, text string, row string, name string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sample_texts(seed=1, n=60, words=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(words)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))] for _ in range(8)]
    out = [None, "", "  \t\n", "one", "one two", "One two"]
    for _ in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_ngram_join(spark, width, num, den, monkeypatch):
    texts = sample_texts(words=60 if width == 1 else 400)
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = classes(range(len(sets)), links)
    for group in (ngram_join.GROUP, 5):  # whole groups, and groups dealt into chunks
        monkeypatch.setattr(ngram_join, "GROUP", group)
        got = {r.doc_id: r for r in ngram_join.similar_groups(documents(spark, texts), width, num, den).collect()}
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(sets))] == [(len(s), want[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("order", ["descending", "random"])
def test_ngram_join_in_any_row_order(spark, order):
    texts = sample_texts(9)
    texts += texts[6:] * 2  # exact copies beside near copies
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    ids = list(range(len(texts)))[::-1]
    if order == "random":
        random.Random(10).shuffle(ids)
    docs = spark.createDataFrame([(i, texts[i], "x", "y") for i in ids], DOCS).coalesce(1)  # all in one batch
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, 5, 4, 5).collect()}
    assert got == classes(range(len(texts)), links)


def test_ngram_join_edges_do_not_grow_with_buckets(spark, monkeypatch):
    texts = [t for t in sample_texts(seed=3) for _ in range(2)]
    real, edges, found = ngram_join.components, [], []

    def counted(pairs):
        edges.append(pairs.count())
        return real(pairs)

    monkeypatch.setattr(ngram_join, "components", counted)
    for size in (8 << 20, 1 << 13):
        monkeypatch.setattr(ngram_join, "BUCKET_TEXT", size)
        found.append({r.doc_id: r.component_id for r in ngram_join.similar_groups(documents(spark, texts), 3, 9, 10).collect()})
    assert found[0] == found[1]
    assert edges[2] <= 2 * edges[0] + len(texts)


def test_ngram_join_of_very_long_near_copies(spark):
    words = [f"w{k}" for k in range(100_000)]  # more shingles in one bucket than 16 bits count
    docs = documents(spark, [" ".join(words), "one two three four", " ".join([*words[:50_000], "x", *words[50_001:]])])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, 3, 9, 10).collect()}
    assert got == {0: (99_998, 0), 1: (2, 1), 2: (99_998, 0)}


def test_embedding_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 64))
    rows = [(i, [float(x) for x in base[i % 30] + rng.standard_normal(64) * 0.25], i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 64, 0), (303, [float("nan")] * 64, 0), (304, rows[0][1], None), (305, rows[0][1][:3], 0), (306, [], 0)]
    u = np.array([r[1] for r in rows[:301]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:301]])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = classes(range(307), list(zip(*np.nonzero(near))))
    for cell in (2048, 7):
        monkeypatch.setattr(embedding_join, "CELL_ROWS", cell)
        got = {r.vec_id: r for r in embedding_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert [got[i].n_links for i in range(301)] == near.sum(1).tolist()
        assert {i: got[i].component_id for i in got} == want and all(got[i].n_links == 0 for i in range(301, 307))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_substring_dedup(spark, hot):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé \n") for _ in range(300)) for _ in range(4)]
    texts = [None, "", "a" * 300, "xy" * 90, "z" * 39, "q" * 40, "p" * 41]
    for _ in range(30):
        texts.append("".join((b := rnd.choice(base))[(a := rnd.randint(0, 200)):a + rnd.randint(10, 90)] + str(rnd.random()) for _ in range(rnd.randint(0, 4))))
    texts.append(texts[10])
    n, data = 40, [(t or "").encode() for t in texts]
    seen = collections.Counter(d[k:k + n] for d in data for k in range(len(d) - n + 1))
    docs = documents(spark, texts).select("doc_id", "text")
    runs = {r.row: r.runs for r in substring_dedup.repeated_runs(docs.withColumnRenamed("doc_id", "row"), n, 16, hot).collect()}
    report = {r.doc_id: r for r in substring_dedup.removal_report(docs, n, 16).collect()}
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(d, gone) if not g)
        assert substring_dedup.kept_bytes(d, runs.get(i)) == kept
        assert (report[i].n_removed, report[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())


def test_decontamination(spark):
    rnd = random.Random(4)
    vocabulary = ["ab", "Cd", "é9", "f", "g1"]
    texts = [None, "", "...", *(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(80))]
    items = [(i, t) for i, t in enumerate([None, "", "--", "f", "ab, Cd", *(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 8))) for _ in range(6))])]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1 << 20, 20):
        got = {r.doc_id: r for r in decontaminate.leak_report(decontaminate.find_leaks(documents(spark, texts), bench, 5, shard_bytes=shard)).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for item, q in items:
                p = words(q)
                m = min(5, len(p))
                for s in range(len(p) - m + 1 if m else 0):
                    for k in range(len(w) - m + 1):
                        if w[k:k + m] == p[s:s + m]:
                            hit |= set(range(k, k + m))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


def test_packing(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", "  ", "<|endoftext|> x", "a<|startoftext|>B", "don't 'S it's", "ΑΣ İ é ́a", "日本語 🙂—.", *sample_texts(5, 40), "Long words, " * 6000]
    rows = packing.pack_documents(documents(spark, texts), path).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_context_mixing(spark):
    texts = sample_texts(6, 40)
    got = {r.doc_id: r for r in context_mixing.score_texts(documents(spark, texts).select("doc_id", "text"), F.col("doc_id") % 4 != 0).collect()}
    split = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    c = collections.Counter(w for i, ws in enumerate(split) if i % 4 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(split):
        assert got[i].train_tokens == n and got[i].n_tokens == len(ws) and got[i].n_known == sum(c[w] > 0 for w in ws)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0 and got[i].held_out == (i % 4 == 0)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_context_mixing_prices_very_long_unseen_words(spark, monkeypatch):
    # Without counts every bit has the probability 1/2.
    flat = context_mixing.Model(np.zeros((1 << context_mixing.SLOT_BITS, 2), np.float32), np.full((context_mixing.GATES, context_mixing.PREDICTORS), 0.3),
                                np.tile(context_mixing.squash(np.linspace(-8, 8, context_mixing.STEPS)), (context_mixing.GATES, 1)))
    monkeypatch.setattr(context_mixing, "learn", lambda types: flat)
    texts = ["a b a", "b c", "x" * 5000, "y" * 5, "a " + "x" * 5000 + " " + "x" * 5000, "a yyyyy yyyyy"]
    got = {r.doc_id: r.score for r in context_mixing.score_texts(documents(spark, texts).select("doc_id", "text"), F.col("doc_id") < 2).collect()}
    for long, short in ((2, 3), (4, 5)):
        assert math.isclose(got[short] - got[long], 4995 * 8 * math.log10(2), rel_tol=1e-6)


def test_context_mixing_learns_from_all_occurrences():
    words, n = [b"ab", b"abc", b"d", context_mixing.END], np.array([5, 2, 1, 3])
    once, each = np.zeros((1 << context_mixing.SLOT_BITS, 2)), np.zeros((1 << context_mixing.SLOT_BITS, 2))
    context_mixing.count_slots(words, n, once)
    context_mixing.count_slots(np.repeat(np.array(words, object), n).tolist(), np.ones(n.sum()), each)
    assert (once == each).all() and once.sum() == 8 * context_mixing.PREDICTORS * (5 * 3 + 2 * 4 + 2 + 3)
    _, seen, tokens = context_mixing.learn_mixer([(words, n)], once.astype(np.float32))
    assert tokens == n.sum() and seen.sum() == once.sum() / context_mixing.PREDICTORS


def test_context_mixing_keeps_each_beginning_once():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))).encode() for _ in range(400)] + [context_mixing.END]
    for some in (words, sorted(words)):
        bits = context_mixing.Bits(some)
        coded = [w if w == context_mixing.END else w + b" " for w in some]
        assert (bits.data[bits.node] == np.frombuffer(b"".join(coded), np.uint8)).all()
        for j, w in enumerate(some):  # the same contexts as alone
            assert (bits.contexts[:, bits.node[bits.start[j]:][:len(coded[j])]] == context_mixing.Bits([w]).contexts).all()
    assert len(bits.data) == len({w[:k + 1] for w in coded for k in range(len(w))})


def test_context_mixing_learns_the_order_of_words(spark):
    # Words once each, the same in both orders: only contexts across words tell the two apart.
    rnd = random.Random(5)
    pairs = [(f"first{k}", f"second{k % 3}") for k in range(12)]
    texts = [" ".join(" ".join(p) for p in rnd.sample(pairs, 6)) for _ in range(200)]
    ahead, back = "first0 second0 first1 second1 first2 second2", "second2 first2 second1 first1 second0 first0"
    held = len(texts)
    got = {r.doc_id: r.score for r in context_mixing.score_texts(documents(spark, [*texts, ahead, back]).select("doc_id", "text"), F.col("doc_id") < held).collect()}
    assert got[held] > got[held + 1] + 0.3


def test_context_mixing_after_a_class():
    # Bit by bit against the words' numbers, and all words together have the probability 1.
    rnd = np.random.default_rng(4)
    for k in (0, 1, 2, 5, 64, 77):
        n, everywhere = rnd.integers(0, 9, k + 1) * 1.0, rnd.integers(9, 90, k + 1) * 1.0
        counts, depth = context_mixing.tree(n), max(k - 1, 0).bit_length()
        for row, both in enumerate(counts):
            for bit in (0, 1):
                if row == 0:
                    want = n[-1] if bit else n[:-1].sum()
                else:
                    d = row.bit_length() - 1
                    want = sum(n[w] for w in range(k) if (w >> (depth - 1 - d)) == (row - (1 << d)) * 2 + bit)
                assert both[bit] == want
        weights, seen, tokens = context_mixing.learn_next(n, everywhere)
        assert tokens == n.sum() and seen.sum() <= n.sum() * (depth + 1)
        lp = context_mixing.log_next(n, everywhere, weights, context_mixing.refine(seen))
        assert len(lp) == k + 1 and math.isclose(np.exp(lp).sum(), 1, rel_tol=1e-6)


def test_toxicity_search_is_exact():
    rnd = random.Random(7)
    idf = {f"t{k}".encode(): 1 + k / 10 for k in range(20)}
    examples = [(i, i % 2, {f"t{rnd.randrange(20)}".encode(): rnd.randint(1, 4) for _ in range(rnd.randint(0, 5))}) for i in range(500)]
    index = toxicity.Index(idf, examples, (1.0, 1.0), k=9)
    dense = np.zeros((500, 20))
    for i, e in enumerate(examples):
        t, v = index.vector(e[2])
        dense[i, t] = v
    for i in range(0, 500, 11):
        t, v = index.vector(examples[i][2])
        if len(t):
            cosine = np.round(dense[:, t] @ v, 12)
            want = sorted(np.flatnonzero(cosine > 0), key=lambda n: (-cosine[n], n))[:9]
            assert index.nearest(t, v)[0].tolist() == want


def test_toxicity_learns(spark):
    rnd = random.Random(8)
    words = [f"n{k}" for k in range(300)]
    texts = [" ".join([rnd.choice(words) for _ in range(40)] + (["Slur!"] * 2 if i % 5 == 0 else [])) for i in range(300)] + [None, ""]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300)) and got[300] == got[301] < 0.5
    assert [c for c in toxicity.drop_toxic(docs, labels).columns] == docs.columns


ARTICLE = "Rivers carry sand and stones down to the sea, where the waves sort them by size over many years of slow and steady work along the coast."


@pytest.fixture(scope="module")
def page_tree(spark):
    return html_text.fit_tree(spark)


@pytest.mark.parametrize("name", ["content has-sidebar", "entry-content related-on", "article-body share-count-3", "post with-comments", "story"])
def test_html_containers_of_the_article(page_tree, name):
    page = f"<html><body><ul class='menu'><li><a href='/'>Home</a></li></ul><div class='{name}'><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body></html>"
    assert html_text.main_text(page, page_tree) == f"{ARTICLE}\n{ARTICLE}"


@pytest.mark.parametrize("name", ["sidebar", "main-nav", "post-comments", "comment-content", "share-buttons", "article-footer"])
def test_html_containers_beside_the_article(page_tree, name):
    page = f"<html><body><article><p>{ARTICLE}</p></article><div class='{name}'><p>Read these other words here too.</p></div></body></html>"
    assert html_text.main_text(page, page_tree) == ARTICLE


def test_html_parts_inside_sentences_and_unclosed_containers(page_tree):
    formula = "Let <math><mi>x</mi></math> be a number and <object>a picture</object> of it, and think of all the numbers that come after it for a long while."
    page = f"<html><body><article><p>{formula}</p><select><option>one</select><noscript>Please turn it on.</noscript><p>{ARTICLE}</p></article></body></html>"
    assert html_text.main_text(page, page_tree) == "Let x be a number and a picture of it, and think of all the numbers that come after it for a long while.\n" + ARTICLE
    page = f"<html><body><article><div><noscript>Turn it on.</div><p>{ARTICLE}</p></article></body></html>"
    assert html_text.main_text(page, page_tree) == ARTICLE


@pytest.mark.parametrize("factor", [1e200, 1e-200, 1e-310])
def test_vectors_of_any_length_are_linked(spark, factor):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [factor * x for x in (1.0, 2.0, 3.0)], 0), (3, [factor * x for x in (-1.0, 2.0, 3.0)], 0)]
    got = embedding_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(1, 1), (1, 1), (0, 3)]


def test_html_text(spark):
    page = ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now and save a lot today.</div><article><h1>A &amp; B</h1>"
            "<p>First <b>line</b>\n of   text, long enough to be read as an article's own.<p>Short.</p><script>x</script><div id='comments'><p>I disagree with all of this.</p></div></article>"
            "<footer>&copy; us</footer></body></html>")
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    rows = html_text.extract_text(pages).orderBy("page_id").collect()
    want = "A & B\nFirst line of text, long enough to be read as an article's own.\nShort."
    assert [(r.text, r.n_chars) for r in rows] == [(want, len(want)), (want, len(want)), ("", 0), ("", 0)]


def test_url_filter(spark):
    urls = [None, "", "x", "http://a.COM", "http://a.com/", "https://www.example.com/en/1?x", "http://m.example.com/en/", "http://notexample.com/en/", "http://b.net/fr/2#a", "http://b.net?/fr/", "http://net/es/x"]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [(None, "allow")] * 4 + [("com/", "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/fr/", "block"), (None, "allow"), ("net/es/", "block")]


def test_license_scan(spark):
    texts = [None, "", "MIT", "x\nReleased under the MIT license\ny z", "released under a MIT Licence by us and many others"]
    got = {r.doc_id: (r.n_lines, r.license) for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == [(0, None)] * 3 + [(1, "MIT"), (0, None)]


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    plain = docs.select("doc_id", "text")
    assert ngram_join.similar_groups(docs, 3, 9, 10).count() == 0
    assert substring_dedup.removal_report(plain).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    assert context_mixing.score_texts(plain, F.lit(True)).count() == 0
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert licenses.scan_licenses(docs).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert embedding_join.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(pages).count() == 0 and url_filter.judge_urls(pages, url_filter.RULES).count() == 0


def test_clashing_names_are_replaced(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    docs = documents(spark, ["a b", None]).withColumns({c: F.lit("old") for c in ("toxic_score", "n_hit", "hit_items")})
    assert dict(toxicity.score_toxicity(docs, labels).dtypes)["toxic_score"] == "double"
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert found.columns.count("n_hit") == 1 and {r.doc_id: (r.n_hit, r.name) for r in found.collect()} == {0: (1, "y"), 1: (0, "y")}
