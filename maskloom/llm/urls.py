"""URL filters with redirect equivalence.

Rules block or allow a host with its subdomains below a path. URLs that lead to each other
by a canonical link or a redirect are one resource: the connected components of these edges
carry a block decision to every alias that no rule names, unless an alias is allowed by a
rule of its own. Everything is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.common import carried, components, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for a URL without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL as a node: host, path and query; scheme and fragment do not tell resources
    apart. Null where there is no host."""
    after = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.nullif(host_of(url), F.lit("")), after)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, null if none fits; an allow
    rule goes first among equally long ones. Rules are ``(verdict, host/path)``, at most a
    few hundred, since they become one expression."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    chosen = []
    for verdict, rule in order:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*chosen, F.lit(None).cast("struct<rule:string,verdict:string>"))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(a, b)`` between nodes: canonical links and refresh redirects of each page.

    Comments and scripts are left out. Targets may be absolute, without scheme, or relative
    to the page; one that is no address gives a null end, as does a page without a host. Null
    pages have no edges.
    """
    lower = F.lower(F.col("html"))
    some = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")).where(
        lower.contains("canonical") | lower.contains("http-equiv")
    )
    seen = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", "")
    tags = some.select("url", F.explode(F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> Column:
        found = [F.nullif(F.regexp_extract("tag", rf"(?is)\s{name}{value}", i), F.lit("")) for i in (1, 2, 3)]
        return F.coalesce(*found)

    tags = tags.select("url", *[attribute(n).alias(k) for n, k in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))])
    canonical = F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    target = F.when(canonical, F.col("href")).when(
        F.lower("equiv") == "refresh", F.regexp_extract("content", r"""(?is)url\s*=\s*["']?([^"']+)""", 1)
    )
    found = saved(tags.select("url", F.trim(F.regexp_replace(target, "&amp;", "&")).alias("target")), "targets")
    found = found.where("target is not null").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    scheme = F.regexp_extract("url", r"^[^:/?#]*:", 0)
    origin = F.concat(scheme, F.lit("//"), F.col("host"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    absolute = (
        F.when(F.col("target").rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.col("target"))
        .when(F.col("target").startswith("//"), F.concat(scheme, F.col("target")))
        .when(F.col("target").startswith("/"), F.concat(origin, F.col("target")))
        .when(F.col("target").rlike(r"^(?:[?#]|[A-Za-z][A-Za-z0-9+.-]*:|$)"), F.lit(None))
        .otherwise(F.concat(origin, folder, F.col("target")))
    )
    found = found.select(node_of(F.col("url")).alias("a"), absolute.alias("goal"))
    return found.select("a", node_of(F.col("goal")).alias("b"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", html: str = "html", edges: DataFrame | None = None
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    A fitting rule decides (``rule_of``). Without one, the aliases of the URL decide: block if
    a rule blocks any of them and none allows any of them; else allow. ``edges`` (``a``, ``b``:
    URLs) adds known redirects. Null URLs and URLs without ``://`` have empty host and path, no
    rule and the verdict allow. Repeated rows are judged alike; a page of any length and a URL
    that a third of the rows share are ordinary rows of a join that adaptive execution may split.
    Columns of the caller but the page come back; those that have one of the added names are
    replaced. Empty tables give an empty table.
    """
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.union(edges.select(node_of(F.col("a")), node_of(F.col("b"))))
    label = components(links)
    address = F.concat(F.lit("://"), F.col("node"))
    decided = label.select("node", "root", host_of(address).alias("host"), path_of(address).alias("path"))
    decided = decided.select("root", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("own"))
    of_root = decided.groupBy("root").agg(
        F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"),
        F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"),
    )
    spread = of_root.where("blocked and not allowed").join(label, "root").select("node", F.lit(True).alias("by_alias"))
    added = ["host", "path", "rule", "verdict"]
    own, _, names = carried(pages, [*added, html])
    source = F.col(f"`{url}`")
    rows = pages.select(
        *own, host_of(source).alias("host"), path_of(source).alias("path"), node_of(source).alias("node")
    ).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("by_alias"), F.lit("block")), F.lit("allow"))
    rows = rows.join(spread, "node", "left").withColumn("rule", F.col("found.rule")).withColumn("verdict", verdict)
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()], *added)
