"""URL filter with redirect equivalence, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path starts with
the rule's; the longest fitting rule wins.  Pages without a fitting rule take the
decision of their aliases: all canonical links and refresh redirects in the html, and
a redirect table where one is given, are edges between urls; within a connected
component an explicitly allowed url makes the others allowed, else a blocked
one makes them blocked, else they are allowed.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule,
has no aliases and is allowed; edges from or to such urls are ignored; fragments
do not distinguish urls, queries do; targets in html have their entities decoded (those that end with
a semicolon) and are resolved against the page's url, or its <base>; other schemes without // are no urls; pages that repeat a url or a page_id are each judged;
of fitting rules of equal length the one first in string order wins; no pages give no rows.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, table
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _after(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The url as a node of the alias graph: host, path and query; null without a host."""
    rest = F.regexp_extract(_after(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host_ == h) | host_.endswith("." + h)) & path_.startswith(p) for h, p, _ in ordered]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return F.coalesce(*[F.when(f, m) for f, m in zip(fits, made, strict=True)], F.lit(None))


def _let(value: Column, then) -> Column:
    """then(value), where value is worked out once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _decoded(text: Column) -> Column:
    """text with its html entities replaced, in one pass."""
    named = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    parts = F.regexp_extract_all(text, F.lit(r"(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), 1)

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"\A&#[xX]?([0-9a-fA-F]+);\z", 1)
        number = F.when(part.rlike(r"\A&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        char = _let(number, lambda code: F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�")))
        return F.when(part.rlike(r"\A&#.+;\z"), char).when(part.rlike(r"\A&.+;\z"), F.coalesce(F.try_element_at(named, part), part)).otherwise(part)

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _undotted(path_: Column) -> Column:
    """path_ without its segments . and .."""
    steps = F.slice(F.split(path_, "/"), 2, F.size(F.split(path_, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    kept = F.when(path_.rlike(r"/\.\.?\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path_.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path_)


def _resolved(base: Column, target: Column) -> Column:
    """target as seen from the url base, made absolute; null where it is empty or no url."""
    return _let(F.struct(base.alias("base"), target.alias("target")), lambda x: _let(_joined(x["base"], x["target"]), _plain))


def _joined(base: Column, target: Column) -> Column:
    part = lambda p: F.regexp_extract(base, p, 1)
    origin, scheme = part(r"\A([^:/?#]+://[^/?#]*)"), part(r"\A([^:/?#]+:)//")
    own, query = part(r"\A[^:/?#]+://[^/?#]*([^?#]*)"), part(r"\A[^?#]*(\?[^#]*)")
    folder = F.regexp_extract(own, r"\A(.*/)", 1)
    return (
        F.when(target == "", None).when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, own, target)).when(target.startswith("#"), F.concat(origin, own, query, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def _plain(whole: Column) -> Column:
    """An absolute url without the segments . and .. in its path."""
    cut = lambda p: F.regexp_extract(whole, p, 1)
    return F.concat(cut(r"\A([^:/?#]+://[^/?#]*)"), _let(cut(r"\A[^:/?#]+://[^/?#]*([^?#]*)"), _undotted), cut(r"\A[^?#]*([?#](?s:.*))"))


def _links(url: Column, html: Column) -> Column:
    """Array of the urls that a page's html names as its canonical form or refreshes to, made absolute."""
    value = lambda tag, name: _let(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1), _decoded)
    tags = lambda name, marked: F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b[^>]*>)"), 1), lambda x: x.rlike(marked))
    quoted = lambda name, word: rf"(?i)\b{name}\s*=\s*(\"[^\"]*\b{word}\b[^\"]*\"|'[^']*\b{word}\b[^']*'|{word}\b)"
    canonical = F.transform(tags("link", quoted("rel", "canonical")), lambda x: value(x, "href"))
    refresh = F.transform(tags("meta", quoted("http-equiv", "refresh")), lambda x: value(x, "url"))
    named = value(F.regexp_extract(html, r"(?i)<base\b[^>]*\bhref\s*=[^>]*>", 0), "href")
    base = F.coalesce(_resolved(url, named), url)
    return F.array_compact(_let(base, lambda b: F.transform(F.concat(canonical, refresh), lambda x: _resolved(b, x))))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html); redirects: (from_url, to_url)."""
    scratch = Scratch(pages.sparkSession)
    linked = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).select(node(F.col("url")).alias("a"), F.explode(_links(F.col("url"), F.col("html"))).alias("to"))
    edges = linked.select("a", node(F.col("to")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    edges = scratch.save(edges.where("a is not null and b is not null and a <> b").distinct())
    url = F.col("url")
    judged = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), node(url).alias("node_"))
    judged = judged.withColumn("own", rule(F.col("host"), F.col("path"), rules))
    if not edges.limit(1).count():
        return judged.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    parts = scratch.save(connected_components(edges, scratch))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    decided = parts.withColumn("v", rule(host(as_url), path(as_url), rules)["verdict"])
    group = decided.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("yes"), F.bool_or(F.col("v") == "block").alias("no"))
    group = scratch.save(group.select("component", F.when(F.coalesce("yes", F.lit(False)), "allow").when(F.coalesce("no", F.lit(False)), "block").otherwise("allow").alias("inherited")))
    alias = scratch.save(parts.join(group, "component").select("node", "inherited"))
    return judged.join(alias, F.col("node_") == F.col("node"), "left").select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"))


def op1(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _fit_sql(h: str, p: str) -> str:
    return f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"


_ORDERED = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
#: The pages of the test tables have no aliases, so that the rules alone decide there.
ORACLE = f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
part as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)
select page_id, host, path,
  case {" ".join(f"when {_fit_sql(h, p)} then '{h}{p}'" for h, p, _ in _ORDERED)} end as rule,
  case {" ".join(f"when {_fit_sql(h, p)} then '{v}'" for h, p, v in _ORDERED)} else 'allow' end as verdict
from part
"""
