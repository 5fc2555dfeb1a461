"""URL block and allow rules, carried over redirects and canonical links.

A page whose URL fits a rule takes the longest rule's verdict. A page without a rule takes the method's:
URLs that redirect to each other, name each other as canonical, or differ only in what never selects
another resource (scheme, fragment, tracking parameters, a trailing slash, ``.html``) are aliases. The
alias classes are connected components; a class with a blocked page is blocked, unless one of its pages
is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.components import components
from undula.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``canonical`` may stand anywhere among the values of rel.
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical[\s/>])[^>]*>?"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_parts(url: Column) -> Column:
    """Struct of host, path and query.

    Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or the end; query: after the first ``?`` up to ``#``. Null or no ``://``: all empty.
    """
    def cut(rest: Column) -> Column:
        host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
        return F.struct(host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"))

    return _let(_after_scheme(F.coalesce(url, F.lit(""))), cut)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES, limit: int = 1000) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null where none fits. The rules are part of the plan."""
    if len(rules) > limit:
        raise ValueError(f"{len(rules)} rules; up to {limit} fit into one expression")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def alias_key(parts: Column) -> Column:
    """What aliases by form share, from the parts of a URL; null where there is no host."""
    query = F.regexp_replace(F.regexp_replace(parts["query"], TRACKING, ""), "^&", "")
    bare = F.regexp_replace(F.regexp_replace(parts["path"], r"(?i)(/index)?\.html?$", ""), "/+$", "")
    return F.when(parts["host"] != "", _let(query, lambda q: F.concat(parts["host"], bare, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))))


def absolute(link: Column, host: Column, path: Column) -> Column:
    """``link`` as found on a page at ``host`` and ``path``, with host and path of its own."""
    folder = F.regexp_extract(path, "^(.*/)", 1)
    here = F.concat(F.lit("http://"), host)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .when(link != "", F.concat(here, F.when(folder == "", "/").otherwise(folder), link))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias keys that a redirect or a canonical link of a page joins, each once. All links of a page count."""
    h = F.col(html)
    tags = lambda tag, link: F.transform(F.regexp_extract_all(h, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))
    found = F.concat(tags(CANONICAL, HREF), tags(REFRESH, TARGET))
    e = pages.select(F.col(url).alias("u"), F.explode(found).alias("link")).filter("link <> ''")
    here = url_parts(F.col("u"))
    to = _let(here, lambda p: absolute(F.replace("link", F.lit("&amp;"), F.lit("&")), p["host"], p["path"]))
    return e.select(_let(here, alias_key).alias("a"), _let(url_parts(to), alias_key).alias("b")).distinct()


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Null URLs and URLs without ``://`` have an empty host and path, no rule and no alias; they are allowed.
    Null or empty html has no links. Repeated rows give repeated rows; an empty table gives no rows.

    URLs are counted once per alias key before anything is joined, so a URL with a third of all rows
    costs one row in the components; the last join is one that adaptive execution can split.
    """
    p = pages.select(F.col(page_id).alias("page_id"), url_parts(F.col(url)).alias("u"))
    p = p.select("page_id", "u.host", "u.path", _let(F.col("u"), alias_key).alias("key"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("own"))
    classes = components(links(pages, url, html))
    ruled = p.filter("key IS NOT NULL AND own IS NOT NULL").groupBy("key").agg(F.max(F.expr("own = 'block'")).alias("blocked"), F.max(F.expr("own = 'allow'")).alias("allowed"))
    ruled = ruled.join(classes, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("root"), "blocked", "allowed")
    ruled = ruled.groupBy("root").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed")).filter("blocked AND NOT allowed").select("root")
    # keys of blocked classes: the roots themselves and their members
    blocked = stage(ruled.select(F.col("root").alias("key")).unionByName(classes.join(ruled, "root").select(F.col("node").alias("key"))).distinct(), "blocked").withColumn("hit", F.lit(True))
    out = p.join(blocked, "key", "left")
    verdict = F.coalesce("own", F.when(F.col("hit"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
