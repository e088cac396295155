"""URL filters (7): block and allow rules, and redirect equivalence by distributed connected components.

DataFrame functions only. A rule names a host, its subdomains and a path prefix; the longest that fits decides. A url
without a rule takes the decision of its aliases: urls joined by redirects (meta refresh, or a redirect table) and
canonical links form components; an explicit allow anywhere in a component precedes its blocks. Components come from
alternating large-star and small-star passes over the edges (each vertex keeps only its least neighbour), with each
pass written to the shared folder; a pass costs the size of the edge list, not of a component squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
TAG = r"(?i)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_node(df: DataFrame, url_col: str, name: str) -> DataFrame:
    """Adds the url's identity among aliases: host, path (/ where empty) and query; scheme and fragment don't count. Null without a host.

    Each part is a column of its own, so that no expression is repeated in the generated code.
    """
    url = F.col(url_col)
    parts = df.withColumns({"_h": host_of(url), "_p": path_of(url), "_q": F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)})
    return parts.withColumn(name, F.when(F.col("_h") != "", F.concat("_h", F.when(F.col("_p") == "", "/").otherwise(F.col("_p")), "_q"))).drop("_h", "_p", "_q")


def with_resolved(df: DataFrame, link_col: str, base_col: str, name: str) -> DataFrame:
    """Adds the absolute url of a link found on base: absolute, protocol-relative, root-relative, query or document-relative."""
    base, link = F.col(base_col), F.col("_link")
    parts = df.withColumns({
        "_scheme": F.regexp_extract(base, r"(?s)^(.*?)://", 1), "_root": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1),
        "_page": F.regexp_extract(base, r"(?s)^([^?#]*)", 1), "_link": F.regexp_replace(F.replace(F.col(link_col), F.lit("&amp;"), F.lit("&")), r"^[\s]+|[\s]+$", ""),
    }).withColumn("_folder", F.when(F.col("_page") == F.col("_root"), F.concat("_root", F.lit("/"))).otherwise(F.regexp_extract("_page", r"(?s)^(.*/)", 1)))
    made = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat("_scheme", F.lit(":"), link)).when(link.startswith("/"), F.concat("_root", link))
        .when(link.startswith("?"), F.concat("_page", link)).when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat("_folder", link))
    )
    return parts.withColumn(name, made).drop("_scheme", "_root", "_page", "_link", "_folder")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: node pairs of pages and the targets of their canonical links and meta refreshes."""
    html = F.col(html_col)
    some = pages.where(html.rlike(r"(?i)\bcanonical\b|http-equiv\s*=\s*[\"']?refresh")).select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("tag"))
    attr = r"""(?i)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(name: str) -> Column:
        return F.concat(*[F.regexp_extract("tag", attr.format(name), i) for i in (1, 2, 3)])

    read = some.withColumns({"rel": F.lower(value("rel")), "equiv": F.lower(value("http-equiv")), "href": value("href"), "content": value("content")})
    # written between the steps: a filter would otherwise be pushed through them all, with every expression repeated
    read = materialize(read.select("url", "rel", "equiv", "href", "content"), "tags")
    canonical, refresh = F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("equiv") == "refresh"
    later = F.regexp_extract("content", r"""(?i)^\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)['"]?([^'"]*)""", 1)
    found = read.select("url", F.when(canonical, F.col("href")).when(refresh, later).alias("link"))
    found = materialize(found, "links").where("link <> ''")
    ends = with_node(with_node(with_resolved(found, "link", "url", "to"), "url", "a"), "to", "b")
    return materialize(ends.select("a", "b"), "ends").where("a is not null and b is not null and a <> b").distinct()


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of name, verdict; null if none. rules: (host, path prefix, verdict), a small given list."""
    rows = sorted(({(h.translate(str.maketrans(UPPER, LOWER)), p): v for h, p, v in rules}).items(), key=lambda r: (-len(r[0][0] + r[0][1]), r[0]))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for (h, p), v in reversed(rows):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, component (null outside aliases): one row per page.

    Null urls and urls without :// have an empty host and path, no rule and no aliases; null html has no links; redirects
    (from_url, to_url) may add edges; repeated pages are judged each. Of rules that are equally long the lesser host and path
    counts, of equal rules the last. Texts of any length are searched whole; other columns, whatever their names, are left
    out; an empty table gives an empty result.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        more = with_node(with_node(redirects.select("from_url", "to_url"), "from_url", "a"), "to_url", "b").select("a", "b")
        edges = edges.union(materialize(more, "redirects").where("a is not null and b is not null and a <> b"))
    groups = components(edges)
    groups = materialize(groups, "aliases")
    split = groups.withColumn("at", F.concat(F.lit("x://"), F.col("node")))
    split = split.withColumns({"host": host_of(F.col("at")), "path": path_of(F.col("at"))})
    marked = split.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    votes = marked.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    passed = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block")
    alias = materialize(groups.join(votes, "component").select("node", "component", passed.alias("passed")), "alias-verdicts")
    base = with_node(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url", "node")
    base = base.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    out = base.withColumn("_own", rule_for(F.col("host"), F.col("path"), rules)).join(bounded_broadcast(alias), "node", "left")
    verdict = F.coalesce("_own.verdict", "passed", F.lit(default))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_own.name").alias("rule"), verdict.alias("verdict"), "component")


def _attribute(name: str) -> str:
    pattern = rf"(?i)\\b{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))".replace("\\\\", "\\")
    return " || ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3))


def _url_parts(url: str) -> str:
    u = f"coalesce({url}, '')"
    return f"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host, regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract({u}, '^.*?://[^?#]*(\\?[^#]*)', 1, 's') AS q"


_NODE = "CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || q END"
_FITS = "(host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)"

#: Rules, links and the closure of aliases in DuckDB's SQL.
ORACLE = f"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT row_number() OVER () AS row, page_id, url, html, {_url_parts("url")} FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM u),
named AS (SELECT url, lower({_attribute("rel")}) AS rel, lower({_attribute("http-equiv")}) AS equiv, {_attribute("href")} AS href, {_attribute("content")} AS content FROM tags),
links AS (SELECT url, CASE WHEN regexp_matches(rel, '(^|\\s)canonical(\\s|$)') THEN href WHEN equiv = 'refresh' THEN regexp_extract(content, '(?i)^\\s*[\\d.]*\\s*[;,]?\\s*(?:url\\s*=\\s*)[''"]?([^''"]*)', 1) END AS raw FROM named),
based AS (SELECT url, regexp_replace(replace(raw, '&amp;', '&'), '^\\s+|\\s+$', '', 'g') AS link, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS root, regexp_extract(url, '^([^?#]*)', 1, 's') AS page FROM links WHERE raw <> ''),
resolved AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN root || link WHEN starts_with(link, '?') THEN page || link
  WHEN link = '' OR starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE CASE WHEN page = root THEN root || '/' ELSE regexp_extract(page, '^(.*/)', 1, 's') END || link END AS target FROM based),
ends AS (SELECT (SELECT {_NODE} FROM (SELECT {_url_parts("url")})) AS a, (SELECT {_NODE} FROM (SELECT {_url_parts("target")})) AS b FROM resolved),
edges AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
nodes AS (SELECT b AS node, min(a) AS component FROM (SELECT a, b FROM reach UNION SELECT a, a FROM edges) GROUP BY b),
split AS (SELECT node, component, {_url_parts("'x://' || node")} FROM nodes),
own AS (SELECT component, node, min_by(rv, struct_pack(l := -length(rh || rp), h := rh, p := rp)) AS v FROM split JOIN rules ON {_FITS} GROUP BY component, node),
passed AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM own GROUP BY component),
best AS (SELECT row, min_by(struct_pack(n := rh || rp, v := rv), struct_pack(l := -length(rh || rp), h := rh, p := rp)) AS r FROM u JOIN rules ON {_FITS} GROUP BY row)
SELECT page_id, host, path, r.n AS rule, coalesce(r.v, passed.v, 'allow') AS verdict FROM u LEFT JOIN best USING (row) LEFT JOIN nodes ON nodes.node = {_NODE} LEFT JOIN passed ON passed.component = nodes.component
"""
