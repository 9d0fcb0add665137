"""URL rules looked up by their rarest literal token.

A rule is ``host/path-prefix``: it fits that host and all its subdomains when
the url's path starts with the prefix; of several fitting rules the longest
wins (then the first in text order). Each rule is filed under the literal
token of it that is rarest among the urls at hand. A url's own tokens fetch
the few rules filed under them, and only those run their regular expression.

Everything is one projection over the scan: no shuffle and no Python. The
rule list belongs to the caller and is held in the plan, ``PER_MAP`` rules at
a time; longer lists are looked up slice by slice with the same result.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits nothing and gets the method's verdict; repeated rows each get
their row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import ascii_lower

#: The rules of the production query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
DEFAULT_VERDICT = "allow"
PER_MAP = 500


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal_tokens(rule: str) -> list[str]:
    """Tokens that stand whole in every url the rule fits: each is closed by a
    delimiter within the rule and opened by one, or by the rule's start (where
    the url has its start or a dot)."""
    return sorted(set(re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", rule)))


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.split(address, "[^A-Za-z0-9]+"))


def rule_index(urls: DataFrame, rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Rules by their rarest token; those without one are filed under ``""``.
    The counts are one aggregate over all urls, with a row per rule token."""
    known = sorted({t for _, r in rules for t in literal_tokens(r)})
    seen = F.array_intersect(url_tokens(F.concat("host", "path")), F.array(*map(F.lit, known)).cast("array<string>"))
    count = dict(urls.select(F.explode(seen).alias("t")).groupBy("t").count().collect()) if known else {}
    index: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        token = min(literal_tokens(rule), key=lambda t: (count.get(t, 0), t), default="")
        index.setdefault(token, []).append((verdict, rule))
    return index


def rule_regex(rule: str) -> str:
    return r"^(?:[^/?#]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", rule)


def _best(index: dict[str, list[tuple[str, str]]]) -> Column:
    """Of one slice of the index: (length, rule, verdict) of the best rule."""
    kind = "array<struct<n:int,rule:string,verdict:string,regex:string>>"
    entries = [F.array(*(F.struct(F.lit(-len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"),
                                  F.lit(rule_regex(r)).alias("regex")) for v, r in rules)) for rules in index.values()]
    filed = F.map_from_arrays(F.array(*map(F.lit, index)), F.array(*entries))
    address = F.concat("host", "path")
    tokens = F.array_union(F.filter(url_tokens(address), lambda t: F.map_contains_key(filed, t)),
                           F.array(*([F.lit("")] if "" in index else [])).cast("array<string>"))
    fetched = F.flatten(F.transform(tokens, lambda t: F.try_element_at(filed, t))).cast(kind)
    fits = F.filter(fetched, lambda x: F.regexp_like(address, x["regex"]))
    return F.array_min(F.transform(fits, lambda x: F.struct(x["n"].alias("n"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT_VERDICT,
               key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``."""
    urls = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = []
    if rules:
        filed = [(t, vr) for t, list_ in rule_index(urls, rules).items() for vr in list_]
        for lo in range(0, len(filed), PER_MAP):
            part: dict[str, list] = {}
            for t, vr in filed[lo:lo + PER_MAP]:
                part.setdefault(t, []).append(vr)
            found.append(_best(part))
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    best = F.least(*found) if len(found) > 1 else found[0] if found else none
    return urls.withColumn("best", best).select(
        F.col("page_id").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
