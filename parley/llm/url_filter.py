"""Operator 4: URL block and allow rules over redirect-equivalent pages.

Every page is matched against the rules by host suffix and path prefix (the
longest rule wins).  Pages that are aliases of each other form one class:
connected components over redirect rows, over the canonical and refresh links
in the pages' HTML (every such link, from the page's full URL, relative
targets resolved against it), and over the link from each URL to its plain
form (no scheme, fragment, ``.html`` ending or closing slash of the path; the
query stays), as servers redirect those.  A page that no rule fits is blocked if its class holds a
blocked page and no explicitly allowed one; an explicit rule of its own always
decides first, so allow takes precedence over what is propagated.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule, has no alias and is allowed.  An empty or null HTML gives no
link, nor does a target of another scheme without ``//`` (``mailto:``) or within the
page (``#top``).  Repeated rows and repeated page ids each keep their own result row.
Other columns of the table are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import components

#: (verdict, host, path) of the rules that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Links in a page's head that name another address of the same page.
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its question mark, else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


def plain_form(url: Column) -> Column:
    """Host, path without ending, and query; null when the URL has no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"(\.html?|/)$", ""), query_of(url)))


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments worked off."""
    none = F.array().cast("array<string>")

    def step(done, part):
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))
    closing = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"), closing)


def resolved(target: Column, url: Column) -> Column:
    """The full address that ``target`` names on the page ``url``; null if it names none."""
    site = F.concat(F.regexp_extract(url, r"^[^:]*", 0), F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    own_path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    return (F.when((target == "") | target.startswith("#"), F.lit(None))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(host_of(url) == "", F.lit(None))
            .when(target.startswith("?"), F.concat(site, path_of(url), target))
            .when(target.startswith("/"), F.concat(site, _without_dots(own_path), rest))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, own_path)), rest)))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (name, verdict), else null; equal lengths: allow first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1], r[2]))
    found = F.lit(None)
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def alias_edges(pages: DataFrame, url_col: str, html_col: str | None, redirects: DataFrame | None) -> DataFrame:
    """(a, b): two names of one page.  Names of full URLs begin with ``u:``, plain
    forms with ``p:``; each full URL that is met is joined with its plain form."""
    url = F.col(url_col)

    def full(c: Column) -> Column:
        return F.concat(F.lit("u:"), c)

    def plain(c: Column) -> Column:
        return F.concat(F.lit("p:"), plain_form(c))

    edges = pages.select(full(url).alias("a"), plain(url).alias("b"))
    links = []
    if html_col is not None:
        html = F.col(html_col)
        low = F.lower(html)  # only sorts out pages without such words
        found = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1))
        links.append(pages.filter(low.contains("canonical") | low.contains("refresh"))
                     .select(url.alias("f"), F.explode(found).alias("t"))
                     .select("f", resolved(F.replace("t", F.lit("&amp;"), F.lit("&")), F.col("f")).alias("t")))
    if redirects is not None:
        links.append(redirects.select(F.col("from_url").alias("f"), F.col("to_url").alias("t")))
    for link in links:
        edges = (edges.unionByName(link.select(full(F.col("f")).alias("a"), full(F.col("t")).alias("b")))
                 .unionByName(link.select(full(F.col("t")).alias("a"), plain(F.col("t")).alias("b")))
                 .unionByName(link.select(full(F.col("f")).alias("a"), plain(F.col("f")).alias("b"))))
    return edges.filter("a is not null and b is not null").distinct()


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
               redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict and the alias class."""
    url = F.col(url_col)
    rows = save(pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"),
                             F.concat(F.lit("u:"), url).alias("__name"))
                .withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules)))
    classes = components(alias_edges(pages, url_col, html_col, redirects), "a", "b")
    # Pages without a plain form have no class.
    named = rows.join(classes, rows["__name"] == classes["node"], "left").drop("node")
    votes = (named.filter(F.col("component").isNotNull() & F.col("__rule").isNotNull())
             .groupBy("component").agg(F.max(F.col("__rule.verdict") == "block").alias("__blocks"),
                                       F.max(F.col("__rule.verdict") == "allow").alias("__allows")))
    spread = F.when(F.col("__blocks") & ~F.col("__allows"), F.lit("block")).otherwise(F.lit("allow"))
    return (named.join(votes, "component", "left")
            .select(id_col, "host", "path", F.col("__rule.name").alias("rule"),
                    F.coalesce(F.col("__rule.verdict"), spread).alias("verdict"),
                    F.col("component").alias("alias_class")))


ORACLE = r"""
with p as (
  select page_id, url,
         case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
q as (
  select page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1), '') as query
  from p),
r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
    case when host <> '' then host || regexp_replace(path, '(\.html?|/)$', '') || query end as alias_key
  from q),
v as (
  select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as own from r)
select page_id, host, path, rule,
       coalesce(own, case when alias_key is not null
                           and max(own = 'block') over (partition by alias_key)
                           and not coalesce(max(own = 'allow') over (partition by alias_key), false)
                          then 'block' else 'allow' end) as verdict
from v
"""
