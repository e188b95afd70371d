"""URL rules with redirect equivalence, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with
the rule's path; the longest fitting rule decides. Hosts meet the rules once
each: every distinct host is split into its suffixes and joined with the rules.

Pages without a rule inherit. Urls that differ only in scheme, fragment, capitals of
the host, tracking parameters or a final slash are one node; redirects and canonical links
are edges between nodes, and the connected components of these are aliases of one page. If a
rule allows some page of a component, its ruleless pages are allowed; else, if a rule
blocks one, they are blocked; else they are allowed. Targets of links are resolved as browsers do:
against the page's url, or its ``<base href>``, with ``&amp;`` decoded.

Definitions: a url that is null or without ``://`` has an empty host and path, fits no
rule and has no alias; pages are independent rows (repeats and null ids stay); of rules that
are equally long the blocking one wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.graph import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Key of all spellings of a url; null where there is no ``://``."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.when(F.instr(url, "://") > 0, F.md5(F.concat(host_of(url), F.rtrim(path_of(url), F.lit("/")), F.lit("?"), kept)))


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")
    steps = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    kept = F.aggregate(
        steps,
        none,
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .when(x == ".", a)
        .otherwise(F.concat(a, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(target: Column, base: Column) -> Column:
    """The absolute url that ``target``, as written in an attribute, means on a page at ``base``; null if there is none."""
    to = F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&")
    origin, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, "^/(.*/)?", 1))
    own, rest = F.regexp_extract(to, "^[^?#]*", 0), F.regexp_extract(to, "^[^?#]*(.*)$", 1)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(origin, _without_dots(own), rest))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): nodes joined by a canonical link or a refresh redirect in a page."""
    u, h = F.col(url), F.col(html)
    targets = F.array(F.regexp_extract(h, _CANONICAL, 1), F.regexp_extract(h, _REFRESH, 1))
    found = pages.filter(h.isNotNull()).select(u.alias("url"), F.regexp_extract(h, _BASE, 1).alias("base"), F.explode(targets).alias("to"))
    found = found.filter("to != ''")
    base = F.when(F.col("base") != "", F.coalesce(resolve(F.col("base"), F.col("url")), "url")).otherwise(F.col("url"))
    found = found.withColumn("base", base)
    found = found.withColumn("to", resolve(F.col("to"), F.col("base")))
    return found.select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) and ``rule``, a struct (length, verdict, text) or null."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hosts = pages.select("host").filter("host != ''").distinct()
    fits = (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), "rule_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct("rule_host", "rule_path", "verdict")).alias("fits"))
    )
    starting = F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    text = F.transform(
        starting,
        lambda r: F.struct(
            F.length(F.concat(r["rule_host"], r["rule_path"])).alias("length"),
            r["verdict"].alias("verdict"),
            F.concat(r["rule_host"], r["rule_path"]).alias("text"),
        ),
    )
    return pages.join(fits, "host", "left").withColumn("rule", F.array_max(text)).drop("fits")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` without ``url``, with host, path, rule (text or null) and verdict.

    ``edges`` are (u, v) pairs of ``node_of`` keys. Columns of the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    others = [c for c in pages.columns if c != url and c not in added]
    u = F.col(url)
    rows = pages.select(
        F.struct(F.lit(0).alias("_"), *others).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node")
    ).withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    rows = matched(rows, rules)
    rows = rows.join(connected_components(edges), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    decided = (
        rows.filter("component is not null and rule is not null")
        .groupBy("component")
        .agg(F.min("rule.verdict").alias("alias_verdict"))  # allow before block
    )
    rows = rows.join(decided, "component", "left")
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in others],
        "host",
        "path",
        F.col("rule.text").alias("rule"),
        F.coalesce("rule.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
    )
