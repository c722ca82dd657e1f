"""URL filters: host and path rules, and block decisions that spread over redirects and canonical links.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest fitting rule of a
url decides.  Pages name aliases of themselves by canonical links and by immediate refreshes.  Those edges' connected
components are found by ``min_components``; a url without a rule of its own is blocked if a rule blocks any url of its
component, unless a rule allows one of them, for an explicit allow goes before a block that is only inherited.  Every
other url is allowed.

All canonical links and refreshes of a page count.  A link is resolved against the page's url: dot segments go, and one
without a scheme takes what it lacks from the page.  Urls are told apart without fragment and with the host in lower
case.  Edges are short rows, hosts and components of any size are joined by key only.  All of it is column expressions,
and ``ORACLE`` says the same in SQL.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; links that can't be
resolved to a url with ``://`` are ignored; repeated rows give repeated result rows; a null page_id is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import min_components, written
from .html import host_of

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Tags, what makes them name an alias, and where they say it.  A tag is read to the next angle bracket, in linear time.
_TAGS = r"(?is)<(?:link|meta)\b[^<>]*>"
_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]{0,200}?\bcanonical\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
_TO = r"""(?is)\bcontent\s*=\s*["'][^"'>]{0,200}?url\s*=\s*["']?([^"'\s>]+)"""
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; nulls if none fits."""
    text = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = (F if text is None else text).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


def name_of(url: Column) -> Column:
    """The url without its fragment and with its host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*", "")
    return F.when(bare.contains("://"), F.concat(F.regexp_extract(bare, r"(?s)^(.*?://)", 1), host_of(bare), F.regexp_extract(bare, r"(?s)://[^/?#]*(.*)", 1)))


def _straight(path: Column) -> Column:
    """A path that begins with a slash, without dot segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    done = F.aggregate(parts, F.lit(""), lambda so_far, x: F.when(x == "..", F.regexp_replace(so_far, "/[^/]*$", "")).when(x == ".", so_far).otherwise(F.concat(so_far, F.lit("/"), x)))
    return F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.lit("/"))).otherwise(done)


def resolved(url: Column, link: Column) -> Column:
    """The url that a link on the page of ``url`` leads to, without fragment; null for a link to the page itself."""
    link = F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), "(?s)#.*", "")
    head, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own_path, query = F.regexp_extract(link, r"(?s)^[^?]*", 0), F.regexp_extract(link, r"(?s)\?.*", 0)
    return (
        F.when(link == "", None)
        .when(link.rlike(_SCHEME), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("?"), F.concat(head, path, link))
        .when(link.startswith("/"), F.concat(head, _straight(own_path), query))
        .otherwise(F.concat(head, _straight(F.concat(folder, own_path)), query))
    )


def aliases(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) of names: a page's own, and those that its html redirects to or calls canonical."""
    tags = F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))

    def said(kind: str, where: str) -> Column:
        return F.transform(F.filter(tags, lambda x: x.rlike(kind)), lambda x: F.regexp_extract(x, where, 1))

    links = F.filter(F.concat(said(_CANONICAL, _HREF), said(_REFRESH, _TO)), lambda x: x != "")
    found = pages.filter("url is not null and html is not null").select("url", F.explode(links).alias("link"))
    edges = found.select(name_of(F.col("url")).alias("src"), name_of(resolved(F.col("url"), F.col("link"))).alias("dst"))
    return edges.filter("src is not null and dst is not null and src <> dst").distinct()


def inherited(edges: DataFrame, rules=RULES) -> DataFrame:
    """name, blocked: for each url of an edge, whether its component passes a block on."""
    edges = written(edges)
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    # Numbers are given once and written, so they stay as they are.
    names = written(names.withColumn("node", F.monotonically_increasing_id()))
    pairs = edges.join(names.selectExpr("name as src", "node as a"), "src").join(names.selectExpr("name as dst", "node as b"), "dst")
    roots = min_components(pairs.selectExpr("a as src", "b as dst"))
    ruled = names.join(roots, "node").withColumn("verdict", rule_of(host_of(F.col("name")), path_of(F.col("name")), rules)[1])
    verdicts = ruled.groupBy("root").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    return ruled.join(verdicts.filter("block and not coalesce(allow, false)"), "root").select("name", F.lit(True).alias("blocked"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    blocked = inherited(aliases(pages), rules)
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), name_of(url).alias("name"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("own", verdict).join(blocked, "name", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"))


query = judged


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle(rules=RULES) -> str:
    """The same in DuckDB."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host = f"translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), {lower})"
    path = "coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '')"

    def name(url: str) -> str:
        bare = f"regexp_replace({url}, '(?s)#.*', '')"
        return f"case when contains({bare}, '://') then regexp_extract({bare}, '(?s)^(.*?://)', 1) || translate(regexp_extract({bare}, '(?s)://([^/?#]*)', 1), {lower}) || regexp_extract({bare}, '(?s)://[^/?#]*(.*)', 1) end"

    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True)
    rule = "case " + " ".join(f"when (host = {_sql(h)} or ends_with(host, {_sql('.' + h)})) and starts_with(path, {_sql(p)}) then {_sql(h + p)}" for _, h, p in ordered) + " end"
    kinds = "case rule " + " ".join(f"when {_sql(h + p)} then {_sql(k)}" for k, h, p in ordered) + " end"
    straight = "list_reduce(list_prepend('', string_split(substr({0}, 2), '/')), lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') when x = '.' then a else a || '/' || x end) || case when regexp_matches({0}, '(^|/)\\.\\.?$') then '/' else '' end"
    said = "list_transform(list_filter(tags, lambda x: regexp_matches(x, {})), lambda x: regexp_extract(x, {}, 1))"
    return f"""with recursive p as (select *, {host} as host, {path} as path, {name("url")} as name from pages),
tagged as (select url, path, regexp_extract_all(html, {_sql(_TAGS)}) as tags from p where url is not null and html is not null),
links as (select url, path, unnest({said.format(_sql(_CANONICAL), _sql(_HREF))} || {said.format(_sql(_REFRESH), _sql(_TO))}) as link from tagged),
bare as (select url, path, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as head, case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end as folder,
  regexp_replace(replace(link, '&amp;', '&'), '(?s)#.*', '') as link from links where link <> ''),
cut as (select *, regexp_extract(link, '(?s)^[^?]*') as own, regexp_extract(link, '(?s)\\?.*') as query from bare),
target as (select url, case when link = '' then null when regexp_matches(link, {_sql(_SCHEME)}) then link when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || link
  when starts_with(link, '?') then head || path || link when starts_with(link, '/') then head || {straight.format("own")} || query else head || {straight.format("(folder || own)")} || query end as link from cut),
linked as (select {name("url")} as src, {name("link")} as dst from target),
edge as (select src, dst from linked where src <> dst union select dst, src from linked where src <> dst),
reach(a, b) as (select src, dst from edge union select r.a, e.dst from reach r join edge e on r.b = e.src),
names as (select b as url, {host} as host, {path} as path from (select distinct b, b as url from reach)),
told as (select url as b, {kinds} as kind from (select url, {rule} as rule from names)),
other as (select a, max(kind = 'block') as block, max(kind = 'allow') as allow from reach join told using (b) group by a),
ruled as (select *, {rule} as rule from p)
select page_id, host, path, rule, coalesce({kinds}, case when o.block and not coalesce(o.allow, false) then 'block' end, 'allow') as verdict from ruled left join other o on ruled.name = o.a"""


ORACLE = _oracle()
