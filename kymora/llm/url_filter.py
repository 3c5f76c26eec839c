"""URL filter by redirect equivalence: block decisions reach all aliases of a page, explicit allows come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import stored
from kymora.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"

#: Action, host and path of the rules in force.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(behind_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme, a leading ``www.``, a last ``/``, fragment and utm_ parameters dropped; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    asked = F.regexp_replace(F.regexp_replace(F.regexp_extract(behind_scheme(url), r"^[^?#]*\?([^#]*)", 1), r"(^|&)utm_[^&]*", ""), "^&", "")
    whole = F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(host != "", whole)


def resolved(target: Column, url: Column) -> Column:
    """Absolute form of a link target on the page ``url``."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


#: First character of a node that is a url, and of one that is a canonical form: the same text may be both.
_URL, _FORM = "0", "1"


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges a - b between urls that lead to the same page: canonical links, redirects, and each url's canonical form."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    target = lambda tag, inner: F.regexp_extract(F.regexp_extract(html, tag, 0), inner, 1)
    links = F.array(*[F.when(t != "", resolved(t, url)) for t in (target(_LINK, _HREF), target(_REFRESH, _TARGET))])
    said = pages.where(url.isNotNull()).select("url", F.explode(links).alias("b")).where(F.col("b").isNotNull()).select(url.alias("a"), "b").distinct()
    ends = pages.select("url").union(said.select("b")).where(url.isNotNull()).distinct()
    as_url = lambda c: F.concat(F.lit(_URL), c)
    forms = ends.select(as_url(url).alias("a"), F.concat(F.lit(_FORM), canonical(url)).alias("b")).where(F.col("b").isNotNull())
    return said.select(as_url(F.col("a")).alias("a"), as_url(F.col("b")).alias("b")).union(forms)


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each url of column ``url``: adds rule and action, null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's; of equally long ones an allow wins.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    each = parts.where("host != ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("size"), (F.col("action") == "allow").alias("allow"), rule.alias("rule"))).alias("best"))
    return best.select("url", F.col("best.rule").alias("rule"), F.when(F.col("best.allow"), "allow").otherwise("block").alias("action"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge ``pages`` (page_id, url, html) by ``rules`` (action allow or block, host, path).

    Returns page_id, host, path, rule, verdict and alias (the class of urls, by its smallest url). A url's own
    rule decides. A url without one is blocked if a url of its class is blocked by a rule and none is allowed by
    one; else it is allowed. Classes are the connected components over canonical links and refreshes in
    ``html`` (resolved against the page) and over each url's canonical form. Null urls, and those without
    ``://``, have an empty host and path, fit no rule and are allowed unless a link makes them aliases; null html has no links.
    Repeated rows are judged each for itself; other columns are ignored; no pages give no rows.
    """
    edges = stored(alias_edges(pages))
    bare = lambda c: F.substring(c, F.lit(2), F.length(c))
    classes = stored(components(edges).where(F.col("node").startswith(_URL)).select(bare(F.col("node")).alias("node"), bare(F.col("component")).alias("component")))
    ends = edges.select("a").union(edges.select("b")).where(F.col("a").startswith(_URL)).select(bare(F.col("a")).alias("url"))
    urls = ends.union(pages.select("url")).where("url is not null").distinct()
    ruled = stored(matched_rules(urls, rules))
    inside = ruled.join(classes.withColumnRenamed("node", "url"), "url")
    held = inside.groupBy("component").agg(F.bool_or(F.col("action") == "block").alias("blocks"), F.bool_or(F.col("action") == "allow").alias("allows"))
    spread = stored(classes.join(held.where("blocks and not allows"), "component", "left").select(F.col("node").alias("url"), F.col("component").alias("alias"), F.col("blocks").isNotNull().alias("tainted")))
    method = F.when(F.coalesce("tainted", F.lit(False)), "block").otherwise("allow")
    return (
        pages.select("page_id", "url")
        .join(ruled, "url", "left")
        .join(spread, "url", "left")
        .select(
            "page_id",
            F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
            F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
            "rule",
            F.coalesce("action", method).alias("verdict"),
            F.coalesce("alias", "url").alias("alias"),
        )
    )
