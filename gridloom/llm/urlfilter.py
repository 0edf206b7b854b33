"""URL verdicts with redirect equivalence.

A rule (host, path) decides for the urls on its host and all subdomains whose path starts with its path; the longest
rule wins. Canonical links and redirects between pages are edges; the distributed connected components over them are
classes of aliases. A url without a rule of its own takes its class's decision: allow if any alias has an explicit allow,
else block if any alias is blocked, else allow.

Cases: a null url, or one without `://`, has an empty host and path, no rule, no aliases and the verdict allow; a null
page has no edges; links that name no other url are dropped; repeated rows get the same verdict; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        """`allow example.org/es/`"""
        verdict, _, where = text.partition(" ")
        host, slash, path = where.partition("/")
        return cls(verdict, host, slash + path)


RULES = tuple(map(Rule.parse, ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and node, which stands for the url without scheme and fragment."""
    out = df.withColumn("url", F.coalesce(F.col(url), F.lit(""))).withColumn("_rest", _after_scheme(F.col("url")))
    out = out.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0)).withColumn("host", F.translate("_host", _UPPER, _LOWER))
    out = out.withColumn("_tail", F.expr("substring(_rest, length(_host) + 1)")).withColumn("path", F.regexp_extract("_tail", r"^[^?#]*", 0))
    node = F.concat("host", F.regexp_extract("_tail", r"^[^#]*", 0))
    return out.withColumn("node", F.when(F.col("host") != "", node)).drop("_rest", "_host", "_tail")


def ruled(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule and decision, null where no rule fits. A list of rules is part of the plan and should stay below some hundreds."""
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, decision = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(decision)
    return df.withColumn("rule", rule).withColumn("decision", decision)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of canonical links and of redirects that pages make themselves, resolved against the page's url."""
    canonical = F.regexp_extract(F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = parsed(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("html is not null and url is not null"))
    found = found.where("node is not null").select("url", "host", "path", F.col("node").alias("src"), F.explode(F.array(canonical, refresh)).alias("to")).where("`to` <> ''")
    scheme = F.expr("substring_index(url, '://', 1)")
    full = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), F.col("host"), F.col("to")))
        .otherwise(F.concat(scheme, F.lit("://"), F.col("host"), F.regexp_extract("path", r"^(.*/)", 1), F.col("to")))
    )
    to = parsed(found.select("src", full.alias("url")))
    return to.where("node is not null and node <> src").select("src", F.col("node").alias("dst")).distinct()


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, alias_of) of every page. redirects: more edges, as (src, dst) urls."""
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        known = parsed(redirects.select(F.col("src").alias("url"), "dst")).select(F.col("node").alias("src"), F.col("dst").alias("url"))
        edges = edges.unionAll(parsed(known).where("node is not null and src is not null").select("src", F.col("node").alias("dst")))
    edges = written(edges, "aliases")
    own = ruled(parsed(pages.select(id_col, F.col(url_col).alias("url"))), rules)
    if edges.isEmpty():
        own = own.withColumn("component", F.lit(None).cast("string")).withColumn("held", F.lit(None).cast("string"))
    else:
        found = components(edges, "src", "dst")
        judged = ruled(parsed(found.select("node", "component", F.concat(F.lit("x://"), "node").alias("url")).drop("node")), rules)
        classes = judged.groupBy("component").agg(F.max((F.col("decision") == "allow").cast("int")).alias("allow"), F.max((F.col("decision") == "block").cast("int")).alias("block"))
        held = F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block")
        own = own.join(found.join(classes.select("component", held.alias("held")), "component"), "node", "left")
    return own.select(id_col, "host", "path", "rule", F.coalesce("decision", "held", F.lit("allow")).alias("verdict"), F.col("component").alias("alias_of"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL."""

    def parts(url: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"SELECT *, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(t, '^[^?#]*') AS path, CASE WHEN h <> '' THEN translate(h, '{_UPPER}', '{_LOWER}') || regexp_extract(t, '^[^#]*') END AS node FROM (SELECT *, substr(r, length(h) + 1) AS t FROM (SELECT *, regexp_extract(r, '^[^/?#]*') AS h FROM (SELECT *, {rest} AS r"

    longest = sorted(rules, key=lambda r: -len(r.host + r.path))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in longest]
    rule = "CASE " + " ".join(f"{f} '{r.host}{r.path}'" for f, r in zip(fits, longest, strict=True)) + " END"
    decision = "CASE " + " ".join(f"{f} '{r.verdict}'" for f, r in zip(fits, longest, strict=True)) + " END"
    tag = lambda t, a: f"regexp_extract(html, '(?is)<{t}\\b[^>]*\\b{a}\\b[^>]*>')"
    quote = "[\"'']?"
    canonical = f"regexp_extract({tag('link', f'rel\\s*=\\s*{quote}canonical')}, '(?is)\\bhref\\s*=\\s*{quote}([^\"''\\s>]+)', 1)"
    refresh = f"regexp_extract({tag('meta', f'http-equiv\\s*=\\s*{quote}refresh')}, '(?is)\\burl\\s*=\\s*{quote}([^\"''\\s>]+)', 1)"
    return f"""
WITH RECURSIVE own AS ({parts("u")} FROM (SELECT page_id, coalesce(url, '') AS u, html FROM pages))))),
judged AS (SELECT page_id, u, html, host, path, node, {rule} AS rule, {decision} AS decision FROM own),
links AS (SELECT u, host AS page_host, path AS page_path, node AS src, unnest([{canonical}, {refresh}]) AS link FROM own WHERE node IS NOT NULL AND html IS NOT NULL),
full_links AS (SELECT src, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN split_part(u, '://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN split_part(u, '://', 1) || '://' || page_host || link
    ELSE split_part(u, '://', 1) || '://' || page_host || regexp_extract(page_path, '^(.*/)', 1) || link END AS u FROM links WHERE link <> ''),
targets AS ({parts("u")} FROM full_links)))),
edges AS (SELECT src AS a, node AS b FROM targets WHERE node IS NOT NULL AND node <> src),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
classes AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
members AS (SELECT component, {decision} AS decision FROM (SELECT component, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(substr(node, length(regexp_extract(node, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM classes)),
held AS (SELECT component, CASE WHEN bool_or(decision = 'allow') THEN 'allow' WHEN bool_or(decision = 'block') THEN 'block' END AS held FROM members GROUP BY component)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.decision, h.held, 'allow') AS verdict
FROM judged j LEFT JOIN classes c USING (node) LEFT JOIN held h USING (component)
"""
