"""URL filter by host and path rules, with decisions passed on to redirect and canonical-link aliases.

A rule (host, path, action) fits a url if the url's host is the rule's or a subdomain of it and the
url's path starts with the rule's; the longest rule wins, and allow wins between equally long ones. A url
that some rule fits keeps that rule's verdict. All others get the verdict of their aliases: pages
that redirect to each other (``<meta http-equiv=refresh>`` or a table of redirects) or name a
canonical address (``<link rel=canonical>``) are connected, and a component is allowed if any
member is explicitly allowed, else blocked if any is blocked, else allowed.

All of it is DataFrame functions: a few rules are part of the expression, many are joined by the suffixes of distinct
hosts; components come from :mod:`docspark.llm.components`. A url's address in the graph is its host,
path and query, without scheme and fragment; targets are resolved against their page, with dot segments removed
and character references decoded, and count as members too where they are no page. Joins deal the rows
of one host, address or component over salts.

Defined cases: a null url, or one without ``://``, has an empty host and path, no aliases and
is allowed; a null page has no edges; repeated rows get equal verdicts; an empty table gives no rows;
further columns stay unless named like an added one, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.components import connected_components
from docspark.llm.names import free
from docspark.llm.skew import salted_join
from docspark.storage import Workspace

ADDED = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_ATTRIBUTE = r"(?is)\s{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between ``://`` and the first ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The node of a url: host, path and query; null where there is no host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name)
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


# Named character references that may stand in a web address.
_NAMED = {
    "amp": "&", "apos": "'", "ast": "*", "colon": ":", "comma": ",", "commat": "@", "dollar": "$", "equals": "=", "excl": "!", "gt": ">", "lowbar": "_", "lpar": "(", "lt": "<",
    "num": "#", "percnt": "%", "period": ".", "plus": "+", "quest": "?", "quot": '"', "rpar": ")", "semi": ";", "sol": "/",
}
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|" + "|".join(sorted(_NAMED)) + ");"


def _unescaped(value: Column) -> Column:
    """Numeric references and those of ``_NAMED`` as characters, without blanks at either end."""
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def said(reference: Column) -> Column:
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(code.isNull(), names[name]).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    between, found = F.split(value, _REFERENCE, -1), F.regexp_extract_all(value, F.lit(_REFERENCE), 0)
    return F.trim(F.array_join(F.zip_with(between, found, lambda x, r: F.concat(x, F.coalesce(said(r), F.lit("")))), ""))


def _without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    joined = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.regexp_replace(held, "/[^/]*$", "")).otherwise(F.concat(held, F.lit("/"), x)),
    )
    return F.concat(joined, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def _absolute(base: Column, href: Column) -> Column:
    """``href`` as an absolute url; null where it is no web address."""
    scheme = F.regexp_extract(base, r"^(.*?://)", 1)
    site = F.concat(scheme, F.regexp_extract(_after_scheme(base), r"^([^/?#]*)", 1))
    folder = F.concat(site, F.regexp_replace(path_of(base), r"[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href == "", None)
        .when(href.rlike(r"(?i)^https?://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(site, path_of(base), href))
        .otherwise(F.concat(folder, href))
    )


def page_targets(pages: DataFrame) -> DataFrame:
    """``(url, raw)``: pages of ``pages(url, html)`` and what their canonical and refresh tags name, as written there."""
    tags = pages.where(F.col("html").isNotNull() & (F.instr("url", "://") > 0)).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0)).alias("tag"))
    canonical = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*)", 1)
    href = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, moved)
    return tags.select("url", href.alias("raw")).where("raw is not null")


def target_edges(targets: DataFrame, references: bool = True, dots: bool = True) -> DataFrame:
    """``(a, b)``: the addresses of both ends of ``targets(url, raw)``; steps that no row needs can be left out of the plan."""
    # one column a step: each step reads the one before several times
    found = targets.select("url", (_unescaped(F.col("raw")) if references else F.trim("raw")).alias("href"))
    whole = found.select(address(F.col("url")).alias("a"), _absolute(F.col("url"), F.col("href")).alias("target")).where("target is not null")
    cut = whole.select("a", "target", host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    query = F.regexp_extract("target", r"^.*?://[^?#]*(\?[^#]*)", 1)
    return cut.where("host <> ''").select("a", F.concat("host", _without_dots(F.col("path")) if dots else F.col("path"), query).alias("b"))


_SUFFIXES = "transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))"


def _rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: the rules that fit each host of ``hosts(host)``, longest first."""
    listed = hosts.where("host <> ''").select("host", F.explode(F.expr(_SUFFIXES)).alias("suffix"))
    kind = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("shorter"), (F.col("action") != "allow").alias("block"), "rule_host", "rule_path", "action")
    fitting = listed.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"), F.col("suffix") == F.col("rule_host"))
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(kind)).alias("rules"))


def _judged(rows: DataFrame, rules: DataFrame, most_literal: int, action: str = "action") -> DataFrame:
    """``rows(host, path, ...)`` with the fitting rule and its ``action``, null where none fits.

    Up to ``most_literal`` rules become part of the expression and no row moves; more of them are joined by
    host, a host's rows dealt over salts.
    """
    suffixes, best_rule, fitting = free(rows.columns, "suffixes", "best", "fitting")
    few = rules.select("host", "path", "action").where("host is not null and path is not null").limit(most_literal + 1).collect()
    if len(few) <= most_literal:
        listed = sorted({(-len(r["host"] + r["path"]), r["action"] != "allow", r["host"], r["path"], r["action"]) for r in few})
        every = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("shorter", "block", "rule_host", "rule_path", "action"), r, strict=True)]) for r in listed])
        fits = lambda r: F.array_contains(F.col(suffixes), r["rule_host"]) & F.startswith(F.col("path"), r["rule_path"])
        best = F.get(F.filter(every, fits), F.lit(0)) if listed else F.lit(None).cast("struct<rule_host:string,rule_path:string,action:string>")
        joined = rows.withColumn(suffixes, F.when(F.col("host") != "", F.expr(_SUFFIXES)).otherwise(F.array().cast("array<string>"))).withColumn(best_rule, best).drop(suffixes)
    else:
        of = _rules_of_hosts(rows.select("host").distinct(), rules).withColumnRenamed("rules", fitting)
        joined = salted_join(rows, of, ["host"], [F.monotonically_increasing_id()], "left").withColumn(best_rule, F.expr(f"get(filter(`{fitting}`, r -> startswith(path, r.rule_path)), 0)")).drop(fitting)
    return joined.withColumn("rule", F.concat(f"{best_rule}.rule_host", f"{best_rule}.rule_path")).withColumn(action, F.col(f"{best_rule}.action")).drop(best_rule)


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, most_literal: int = 200) -> DataFrame:
    """``pages(url[, html])`` with host, path, rule and verdict.

    ``rules(host, path, action)`` has actions ``allow`` and ``block``; ``redirects(source, target)`` are further
    edges between urls.
    """
    work = Workspace(pages.sparkSession, "urls")
    edges = None
    if "html" in pages.columns:
        targets = work.table(page_targets(pages), "targets")
        said = targets.agg(F.count("*").alias("n"), F.bool_or(F.instr("raw", "&") > 0).alias("references"), F.bool_or((F.instr("raw", ".") > 0) | (F.instr("url", "/.") > 0)).alias("dots")).first()
        edges = target_edges(targets, said["references"], said["references"] or said["dots"]) if said["n"] else None
    if redirects is not None:
        more = redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    own = pages.drop(*ADDED).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    action, node, blocking = free([*own.columns, "rule"], "action", "node", "blocking")
    judged = _judged(own, rules, most_literal, action)
    if edges is None:
        verdict = F.coalesce(action, F.lit("allow"))
        return judged.withColumn("verdict", verdict).drop(action)
    edges = work.table(edges.where("a is not null and b is not null").distinct(), "edges")
    member = connected_components(edges, work)
    cut = F.regexp_extract("node", r"^([^/?]*)([^?]*)", 1).alias("host"), F.regexp_extract("node", r"^([^/?]*)([^?]*)", 2).alias("path")
    known = _judged(member.select("node", "root", *cut), rules, most_literal)
    passed = known.groupBy("root").agg(F.bool_or(F.col("action") == "allow").alias("allowed"), F.bool_or(F.col("action") == "block").alias("blocked"))
    passed = passed.where("blocked and not coalesce(allowed, false)").select("root")
    blocked = work.table(salted_join(member, passed, ["root"], ["node"], "left_semi").select(F.col("node").alias(node)), "blocked")
    out = judged.withColumn(node, address(F.col("url")))
    out = salted_join(out, blocked.withColumn(blocking, F.lit(True)), [node], [F.monotonically_increasing_id()], "left")
    verdict = F.coalesce(action, F.when(F.col(blocking), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop(node, action, blocking)


#: Rules (host, path, action) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


#: The same in DuckDB SQL: rules as cases, components by a recursive query over the edges of pages.
ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') + 2) ELSE '' END AS scheme FROM pages
), q AS (
  SELECT page_id, html, scheme, coalesce(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1), '') AS query FROM p
), tags AS (
  SELECT *, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM q WHERE host <> ''
), raw AS (
  SELECT *, CASE WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?(?:[^"''>]*\s)?canonical[\s"''>]') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^\s"''>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)\scontent\s*=\s*["'']?[0-9.\s]*[;,]\s*(?:url\s*=\s*)?["'']?([^"''>]*)', 1) END AS said FROM tags
), cuts AS (
  SELECT *, regexp_split_to_array(said, '&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|NAMES);') AS between, regexp_extract_all(said, '&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|NAMES);') AS refs FROM raw
), hrefs AS (
  SELECT *, trim(array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || CASE WHEN i > len(refs) THEN '' WHEN regexp_matches(refs[i], '^&#[xX]')
    THEN chr(('0x' || substr(refs[i], 4, length(refs[i]) - 4))::INTEGER) WHEN starts_with(refs[i], '&#') THEN chr(substr(refs[i], 3, length(refs[i]) - 3)::INTEGER)
    ELSE MAP {TABLE}[substr(refs[i], 2, length(refs[i]) - 2)] END), '')) AS href FROM cuts
), targets AS (
  SELECT host || path || query AS a, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN substr(href, instr(href, '://') + 3)
    WHEN starts_with(href, '//') THEN substr(href, 3) WHEN starts_with(href, '/') THEN host || href
    WHEN href <> '' AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || href END AS target FROM hrefs
), e AS (
  SELECT DISTINCT a, lower(regexp_extract(target, '^([^/?#]*)', 1)) || CASE WHEN regexp_matches(target, '^[^/?#]*/') THEN
    list_reduce(string_split(regexp_extract(target, '^[^/?#]*([^?#]*)', 1), '/'), lambda held, x: CASE WHEN x = '.' THEN held WHEN x = '..' THEN regexp_replace(held, '/[^/]*$', '') ELSE held || '/' || x END)
    || CASE WHEN regexp_matches(target, '^[^?#]*/[.][.]?([?#]|$)') THEN '/' ELSE '' END ELSE '' END || regexp_extract(target, '^[^?#]*([?][^#]*)', 1) AS b FROM targets WHERE target IS NOT NULL
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
urls AS (
  SELECT host || path || query AS node, host, path FROM q UNION
  SELECT b, regexp_extract(b, '^([^/?]*)', 1), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM e
), ruled AS (
  SELECT node, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls
), verdicts AS (
  SELECT DISTINCT node, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled
), passed AS (
  SELECT r.a AS node, bool_or(v.said = 'allow') AS allowed, bool_or(v.said = 'block') AS blocked FROM reach r JOIN verdicts v ON v.node = r.b GROUP BY r.a
)
SELECT q.page_id, q.host, q.path, v.rule, coalesce(v.said, CASE WHEN x.blocked AND NOT coalesce(x.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN verdicts v ON v.node = q.host || q.path || q.query AND v.host = q.host AND v.path = q.path LEFT JOIN passed x ON x.node = q.host || q.path || q.query
""".replace("NAMES", "|".join(sorted(_NAMED))).replace("TABLE", ", ".join(f"'{k}': '{v.replace(chr(39), 2 * chr(39))}'" for k, v in _NAMED.items()))
