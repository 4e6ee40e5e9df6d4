"""URL filters: rules on hosts and paths, and block decisions that follow redirects and canonical links to all aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import lookup, written
from ragloom.llm.components import connected_components

#: Rules of the registered query: longest fitting rule wins (fixed values).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: A rule list up to this many rows goes to every task as literals; a longer one is joined.
LITERAL_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """The node of a url: host, path and query; scheme and fragment make no difference. Null for null or without ://."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))))


def apply_rules(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """df with rule and rule_verdict (both null where no rule fits).

    A rule (``host/path``) fits its host and all subdomains where the path starts with the rule's, of which the first character is
    the slash; a rule without a slash fits every path of its host, the empty one too. Rules without a host fit nothing. The longest
    wins; at equal length the smaller in order. ``rules`` may be a list or a DataFrame (rule, verdict); they mean the same.
    """
    if isinstance(rules, list) and len(rules) <= LITERAL_RULES:
        chosen_rule = chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), *r)):
            rule_host, slash, rest = rule.partition("/")
            if rule_host:
                fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(slash + rest)
                chosen_rule, chosen = chosen_rule.when(fits, rule), chosen.when(fits, verdict)
        return df.withColumns({"rule": chosen_rule, "rule_verdict": chosen})
    spark = df.sparkSession
    table = spark.createDataFrame(rules, "rule string, verdict string") if isinstance(rules, list) else rules
    table = table.select(F.substring_index("rule", "/", 1).alias("__rh"), F.regexp_extract("rule", r"(?s)\A[^/]*(/.*)?\z", 1).alias("__rp"), "rule", F.col("verdict").alias("rule_verdict")).where("__rh != ''")
    # Hosts and paths repeat, so each place is judged once.
    places = df.groupBy(F.col(host).alias("__h"), F.col(path).alias("__p")).agg(F.count("*").alias("__n"))
    labels = F.split(F.col("__h"), r"\.")
    suffixes = places.withColumn("__rh", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fitting = suffixes.join(table, "__rh").where(F.col("__p").startswith(F.col("__rp")))
    best = fitting.groupBy("__h", "__p").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "rule_verdict")).alias("b"), F.max("__n").alias("__n"))
    place = F.concat(F.length(host).cast("string"), F.lit(":"), host, F.lit(":"), path)
    best = best.select(F.concat(F.length("__h").cast("string"), F.lit(":"), "__h", F.lit(":"), "__p").alias("__place"), "b.rule", "b.rule_verdict", "__n")
    return lookup(df.withColumn("__place", place), written(best, "url-rules"), "__place", "__n").drop("__place")


def without_dots(path: Column) -> Column:
    """A path with ``.`` and ``..`` steps taken; one that climbs over the root stays there."""
    last = F.regexp_extract(path, r"/(\.{1,2})\z", 1) != ""
    steps = F.split(F.concat(path, F.when(last, "/").otherwise("")), "/")
    folded = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(1))), F.lit(""), lambda done, step: F.when(step == "..", F.regexp_replace(done, r"/[^/]*\z", "")).when(step == ".", done).otherwise(F.concat(done, F.lit("/"), step)))
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), folded).otherwise(path)


def _resolved(base: Column, target: Column) -> Column:
    """Absolute form of a link found on the page ``base``, with ``.`` and ``..`` steps taken."""
    scheme = F.regexp_extract(base, r"\A(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    whole = (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    plain = F.concat(F.regexp_extract(whole, r"\A(.*?://)", 1), host_of(whole), without_dots(path_of(whole)), F.regexp_extract(whole, _URL, 3))
    return F.when((target == "") | target.startswith("#"), base).when(target.startswith("?"), F.concat(root, path_of(base), target)).otherwise(plain)


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the equivalences that pages declare, by all rel=canonical links and meta refresh redirects."""
    tags = lambda name, attribute, value: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b(?=[^>]*\b{attribute}\s*=\s*{value})[^>]*>"), F.lit(0))
    unescaped = lambda c: F.replace(F.trim(c), F.lit("&amp;"), F.lit("&"))
    canonical = F.transform(tags("link", "rel", r"(?:\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical(?=[\s>/]))"), lambda t: unescaped(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)", 1)))
    refresh = F.transform(tags("meta", "http-equiv", r"[\"']?refresh\b"), lambda t: unescaped(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'>\s]+)", 1)))
    found = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh")).select("url", F.explode(F.concat(canonical, refresh)).alias("target")).where("target != ''")
    return found.select(key_of(F.col("url")).alias("src"), key_of(_resolved(F.col("url"), F.col("target"))).alias("dst")).where("src is not null and dst is not null and src != dst").distinct()


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, component.

    The page's own rule decides first. Otherwise its aliases do: urls joined by redirects, canonical links or the same
    host, path and query. An alias that a rule allows keeps the whole component allowed; else one that a rule blocks blocks
    it; else the default. Null urls and urls without :// have empty host and path and no alias. Repeated pages get repeated
    results. ``redirects`` (src, dst: urls) adds links known from a crawl log. component: the smallest alias, null without links.
    """
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst")))
    nodes = connected_components(links)
    absolute = F.concat(F.lit("x://"), F.col("node"))
    judged = apply_rules(nodes.withColumns({"__host": host_of(absolute), "__path": path_of(absolute)}), rules, "__host", "__path").drop("__host", "__path", "rule")
    judged = written(judged, "url-nodes")
    decided = judged.groupBy("component").agg(
        F.when(F.max((F.col("rule_verdict") == "allow").cast("int")) == 1, "allow").when(F.max((F.col("rule_verdict") == "block").cast("int")) == 1, "block").alias("alias_verdict"), F.count("*").alias("n")
    )
    known = lookup(judged.drop("rule_verdict"), written(decided, "url-components"), "component", "n")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("node"))
    visits = own.groupBy("node").agg(F.count("*").alias("n"))
    known = written(known.join(visits, "node"), "url-verdicts")
    joined = lookup(apply_rules(own, rules), known, "node", "n")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit(default)).alias("verdict"), "component")


def oracle_sql(rules: list[tuple[str, str]] = RULES, default: str = "allow") -> str:
    """DuckDB SQL of url_verdicts over ``pages``: links by patterns, components by recursive reachability."""
    host = r"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '')".replace("\\\\", "\\")
    key = "case when contains({u}, '://') then concat(" + ", ".join((host, path, query)) + ") end"
    case_rule, case_verdict = "case", "case"
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), *r)):
        rule_host, slash, rest = rule.partition("/")
        fits = f"((host = '{rule_host}' or ends_with(host, '.{rule_host}')) and starts_with(path, '{slash}{rest}'))"
        case_rule += f" when {fits} then '{rule}'"
        case_verdict += f" when {fits} then '{verdict}'"
    steps = "list_reduce(list_prepend('', list_slice(string_split(concat(pt, case when regexp_matches(pt, '/[.]{1,2}$') then '/' else '' end), '/'), 2, 1000000)), lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') when x = '.' then a else concat(a, '/', x) end)"
    node = {"host": host.format(u="concat('x://', node)"), "path": path.format(u="concat('x://', node)")}
    return rf"""
        with recursive tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages where contains(url, '://')),
        targets as (select url, replace(trim(case when regexp_matches(tag, '(?is)^<link\b') and regexp_matches(tag, '(?is)\brel\s*=\s*(?:"(?:[^">]*\s)?canonical[\s"]|''(?:[^''>]*\s)?canonical[\s'']|canonical[\s>/])') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)
            when regexp_matches(tag, '(?is)^<meta\b') and regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''>\s]+)', 1) end), '&amp;', '&') as target from tags),
        bases as (select url, target, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, {host.format(u="url")} as h, {path.format(u="url")} as bp from targets where target <> '' and not starts_with(target, '#')),
        whole as (select url, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target when starts_with(target, '//') then concat(scheme, ':', target) when starts_with(target, '/') then concat(scheme, '://', h, target)
            else concat(scheme, '://', h, coalesce(nullif(regexp_replace(bp, '[^/]*$', ''), ''), '/'), target) end as w, target, h, bp from bases),
        split as (select url, starts_with(target, '?') as same, h, bp, target, {host.format(u="w")} as wh, {path.format(u="w")} as pt, {query.format(u="w")} as wq from whole),
        pairs as (select {key.format(u="url")} as src, case when same then concat(h, bp, regexp_replace(target, '#.*$', '')) else concat(wh, case when regexp_matches(pt, '/[.]{{1,2}}(/|$)') then {steps} else pt end, wq) end as dst from split),
        edges as (select src, dst from pairs where src <> dst union select dst, src from pairs where src <> dst),
        reach as (select src as node, dst as other from edges union select r.node, e.dst from reach r join edges e on e.src = r.other),
        parts as (select node, least(node, min(other)) as component from reach group by node),
        ruled as (select node, component, {node["host"]} as host, {node["path"]} as path from parts),
        decided as (select component, case when bool_or(coalesce({case_verdict} end = 'allow', false)) then 'allow' when bool_or(coalesce({case_verdict} end = 'block', false)) then 'block' end as alias_verdict from ruled group by component),
        p as (select page_id, {host.format(u="url")} as host, {path.format(u="url")} as path, {key.format(u="url")} as node from pages)
        select page_id, host, path, {case_rule} end as rule, coalesce({case_verdict} end, alias_verdict, '{default}') as verdict, parts.component as component
        from p left join parts on parts.node = p.node left join decided on decided.component = parts.component
    """


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """The rules as a DataFrame, for lists that are joined."""
    return spark.createDataFrame(rules, "rule string, verdict string")
