"""DuckDB SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

from netsentry.llm import licenses, url_filter

_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_filter() -> str:
    rules = ", ".join(f"('{v}', '{r}')" for v, r in url_filter.RULES)
    return f"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_CHARS}), '') as host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
     r(verdict, rule) as (values {rules}),
     s as (select verdict, rule, split_part(rule, '/', 1) as h, substr(rule, strpos(rule, '/')) as p from r)
select page_id, host, path,
       (select rule from s where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        order by length(rule) desc, rule limit 1) as rule,
       coalesce((select verdict from s where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        order by length(rule) desc, rule limit 1), '{url_filter.DEFAULT_VERDICT}') as verdict
from u"""


def _license_scan() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    grams = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, licenses.template_bigrams(t)))}])" for n, t in licenses.TEMPLATES.items())
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    least = licenses.MIN_DICE
    return f"""
with t(license, tg) as (values {grams}),
     l as (select r, unnest(range(1, len(ls) + 1)) as k, unnest(ls) as line
           from (select row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
     w as (select r, k, regexp_extract_all(translate(line, {_CHARS}), '{word}') as w from l),
     b as (select r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
     d as (select r, k, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice from b, t
           where len(g) between len(tg) * {least} / (2 - {least}) and len(tg) * (2 - {least}) / {least}),
     m as (select r, k, min(license) filter (where dice = top) as license, max(dice) as dice
           from (select *, max(dice) over (partition by r, k) as top from d where dice >= {least}) group by r, k),
     x as (select r, count(*) as n_lines, max(dice) as dice, string_agg(distinct license, ',' order by license) as licenses,
                  min(license) filter (where dice = top) as license
           from (select *, max(dice) over (partition by r) as top from m) group by r)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, license, dice, coalesce(licenses, '') as licenses
from (select row_number() over () as r, doc_id from documents) left join x using (r)"""


def _collocations() -> str:
    return f"""
with w as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {_CHARS}), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
     p as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as ws from w),
     g as (select lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as phrase
           from p, (select unnest([1, 2, 3, 4]) as size)),
     f as (select lang, phrase, size, count(*) as a from g group by all),
     n as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
     c as (select lang, phrase, size, a, string_split(phrase, ' ') as ws from f where size > 1 and a >= 30),
     inner_ as (select lang, unnest(flatten(list_transform(range(2, size), lambda k: list_transform(range(1, size - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))))) as phrase, a as over from c),
     o as (select lang, phrase, max(over) as over from inner_ group by all),
     kept as (select c.* from c left join o using (lang, phrase) where over is null or 100 * over < 80 * a),
     cut as (select lang, phrase, a, k, array_to_string(ws[:k], ' ') as first, array_to_string(ws[k + 1:], ' ') as rest from (select *, unnest(range(1, size)) as k from kept)),
     s as (select cut.lang, cut.phrase, cut.a, k, x.a as l, y.a as r, ((2000000::hugeint * cut.a) // (x.a + y.a))::bigint as score
           from cut join f x on x.lang = cut.lang and x.phrase = first join f y on y.lang = cut.lang and y.phrase = rest),
     b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
     r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select r.lang, rank, phrase, a, l, r.r as r, n, score from r join n on n.lang = r.lang where rank <= 2000"""


ORACLES = {"op3_license_scan": _license_scan(), "op8_url_filter": _url_filter(), "op13_collocations": _collocations()}
