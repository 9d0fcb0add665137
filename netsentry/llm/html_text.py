"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block has its number of
words and its link density (share of its words inside links), the same of the
blocks before and after it, and whether it stands inside the page's article or
inside a container that says by its tag, role, class or id that it is
something else (menu, footer, advert, form, comments ...). A decision tree over
these numbers, fitted on the blocks of the small labelled pages in
``html_training.py``, says which blocks are main text.

The fit is a Spark ML tree over about a hundred rows; its nodes go to the
tasks as nested tuples. Pages are read once in Arrow batches and never
shuffled.

Only scripts, styles, text areas, titles and templates are skipped unread; what stands in a formula is part of its
sentence, and lists to choose from, frames and no-script notices are containers like a menu.

Defined results: null, empty and text-free pages give an empty text; broken
markup (unclosed or stray tags) is read as far as it goes; very long pages are read whole; repeated rows each
get their row; columns beside key, url and page are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.llm.common import regroup
from netsentry.llm.html_training import labelled_pages

#: HTML element names and container words.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo mrow ms mtext msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template".split())
OTHER_TAGS = set("head nav header footer aside form menu dialog button fieldset select noscript iframe svg".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OTHER_WORDS = set("ad ads advert advertisement adverts sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer foot masthead topbar header comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular widget pagination pager tags copyright legal disclaimer skip".split())
MAIN_WORDS = set("article main content post entry story".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
_PART = re.compile(r"[a-z]+")

FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_article", "in_other", "page_has_article"]


def name_says(name: str) -> int:
    """What a class name or id says of its element, as ``container``. ``has-sidebar`` says nothing of it; of a name of several words the
    side ones count (``comment-content``, ``main-nav``), but an article's own header is not the page's."""
    parts = _PART.findall(name)
    if not parts or parts[0] in ("has", "with", "no", "without", "is", "not"):
        return 0
    main, other = [p for p in parts if p in MAIN_WORDS], [p for p in parts if p in OTHER_WORDS]
    if main and other == ["header"]:
        return 0
    return -1 if other else int(bool(main))


def container(tag: str, attr: str, inside_article: bool) -> int:
    """1: the article; -1: something else; 0: nothing is said. A class name or id that says article wins over others that say
    something else."""
    values = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(attr)} if attr else {}
    says = {name_says(n) for n in f"{values.get('class', '')} {values.get('id', '')}".split()}
    if tag in ("html", "body"):
        return 0
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return -1
    if tag == "header" and inside_article:
        return 0
    if tag in OTHER_TAGS or values.get("role") in OTHER_ROLES or (-1 in says and 1 not in says):
        return -1
    return int(tag in ("article", "main") or values.get("role") in ("main", "article") or 1 in says)


def blocks_of(page: str | None) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, in article, in something else) of each block."""
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    link_pieces: list[str] = []
    article = other = links = 0

    def close() -> None:
        words = html.unescape("".join(pieces)).split() if pieces else []
        if words:
            linked = len(html.unescape(" ".join(link_pieces)).split())
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), int(article > 0), int(other > 0)))
        pieces.clear()
        link_pieces.clear()

    def text(s: str) -> None:
        if s:
            pieces.append(s)
            if links:
                link_pieces.append(s)

    def leave(tag: str) -> None:
        nonlocal article, other
        while stack:
            t, kind = stack.pop()
            article -= kind > 0
            other -= kind < 0
            if t == tag:
                break

    page = page or ""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text(page[at:m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = m["tag"] and m["tag"].lower()
        if not tag:
            continue
        if tag == "br":
            text(" ")
        elif tag in RAW and not m["end"]:
            if tag not in ("script", "style"):
                close()
            if not m["attr"].endswith("/"):
                gone = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = gone.end() if gone else len(page)
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag in INLINE:
            continue
        else:
            close()
            links = 0
            if tag in VOID or (m["attr"] or "").endswith("/"):
                continue
            if not m["end"]:
                if tag not in ("option", "optgroup") and any(t == "select" for t, _ in stack):  # nothing else stands in a list to choose from
                    leave("select")
                kind = container(tag, m["attr"], article > 0)
                if tag == "p" and not kind:
                    continue
                stack.append((tag, kind))
                article += kind > 0
                other += kind < 0
            elif any(t == tag for t, _ in stack):
                leave(tag)
    close()
    return out


def features_of(blocks: list[tuple[str, int, float, int, int]]) -> list[list[float]]:
    edge = ("", 0, 0.0, 0, 0)
    page_has = float(any(b[3] and not b[4] for b in blocks))
    return [[float(b[1]), b[2], float(a[1]), a[2], float(c[1]), c[2], float(b[3]), float(b[4]), page_has]
            for a, b, c in zip([edge, *blocks], blocks, [*blocks[1:], edge])]


def fit_tree(spark: SparkSession, max_depth: int = 5):
    """The tree as nested (feature, threshold, left, right) or a class."""
    pages = [(blocks_of(page), main) for page, main in labelled_pages()]
    rows = [(Vectors.dense(f), float(b[0] in main)) for blocks, main in pages for b, f in zip(blocks, features_of(blocks))]
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, seed=1).fit(spark.createDataFrame(rows, ["features", "label"]))

    def plain(node):
        if node.numDescendants() == 0:
            return int(node.prediction())
        return (node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild()))

    return plain(model._java_obj.rootNode())


def is_main(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return bool(tree)


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page)
    return "\n".join(b[0] for b, f in zip(blocks, features_of(blocks)) if is_main(tree, f))


def extract_text(pages: DataFrame, tree=None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of each page."""
    tree = tree if tree is not None else fit_tree(pages.sparkSession)
    source = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regroup(batches, column="html"):
            texts = [main_text(x, tree) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), part.column(1).combine_chunks(), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out = source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": key, "url": url})
