"""URL filters with redirect equivalence.

Rules (host, path) judge a page by its own url: a rule fits its host and all subdomains when the url's path starts with
the rule's path, and the longest rule that fits wins. A page without a fitting rule takes the decision of its aliases:
pages are linked to the targets of their redirects (``<meta http-equiv=refresh>``) and canonical links
(``<link rel=canonical>``), connected components over these edges are found by distributed contraction, and a component
that holds a blocked url is blocked unless one of its urls is explicitly allowed. Without aliases a page is allowed.

An alias is a whole url without its fragment. Targets may be absolute, ``//host/path`` or ``/path``; other targets are
taken as relative to the page's folder. A target need not be a page of the table: rules judge it as well.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and has no aliases; a null
html has no links; repeated pages are judged alike; an empty table gives an empty result; other columns never matter.
Only DataFrame and SQL functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import components, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) rule that fits; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's url and the target of its redirect or canonical link, both without fragments."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = lambda c: F.trim(F.regexp_replace(c, "^[\"']|[\"']$", ""))
    tags = (pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
            .select(F.regexp_replace("url", "(?s)#.*", "").alias("url"),
                    F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag")))
    canonical = F.when(F.lower(bare(attr("tag", "rel"))).rlike(r"(^|\s)canonical(\s|$)"), bare(attr("tag", "href")))
    refresh = F.when(F.lower(bare(attr("tag", "http-equiv"))) == "refresh",
                     F.regexp_extract(bare(attr("tag", "content")), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    links = tags.select("url", F.regexp_replace(F.trim(F.coalesce(canonical, refresh)), "(?s)#.*", "").alias("to")).where("to != ''")
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace("url", r"(?s)\?.*", ""), r"(?s)^(.*?://[^/]*(?:/.*(?=/))?)", 1)
    target = (F.when(F.col("to").contains("://"), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(scheme, "to"))
              .when(F.startswith("to", F.lit("/")), F.concat(site, "to")).otherwise(F.concat(folder, F.lit("/"), "to")))
    return links.select(F.col("url").alias("u"), target.alias("v"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, via_alias."""
    edges = stored(alias_edges(pages), "aliases")
    groups = components(edges)
    _, by_rule = best_rule(host(F.col("node")), path(F.col("node")), rules)
    decided = (groups.select("root", by_rule.alias("verdict")).groupBy("root")
               .agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"),
                    F.max((F.col("verdict") == "block").cast("int")).alias("blocked")))
    blocked = (groups.join(decided.where("blocked = 1 and coalesce(allowed, 0) = 0"), "root", "left_semi")
               .select(F.col("node").alias("__alias"), F.lit(True).alias("__blocked")))
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = best_rule(h, p, rules)
    own = pages.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), verdict.alias("__own"),
                       F.when(F.col("url").contains("://"), F.regexp_replace("url", "(?s)#.*", ""))
                       .otherwise(F.concat(F.lit("no url "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("__alias"))
    # pages with a rule of their own don't need the aliases, so only the others are shuffled
    done = own.where("__own is not null").select("page_id", "host", "path", "rule", F.col("__own").alias("verdict"), F.lit(False).alias("via_alias"))
    rest = (own.where("__own is null").join(blocked, "__alias", "left")
            .select("page_id", "host", "path", "rule", F.when(F.col("__blocked"), "block").otherwise("allow").alias("verdict"),
                    F.coalesce("__blocked", F.lit(False)).alias("via_alias")))
    return done.unionByName(rest)
