"""URL filters: block decisions spread over redirect and canonical-link equivalence; explicit allows stay (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import read_table, stored

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that may declare an alias, and the base of a page's relative links.
LINKS, METAS, BASES = (rf"(?is)(<{name}\b[^>]*>)" for name in ("link", "meta", "base"))
#: Target in the content of a refresh, with or without ``url=``.
REFRESH = r"""(?is)(?:\burl\s*=\s*|^\s*[0-9.]+\s*[;,]\s*+(?!url\s*=))["']?\s*([^"']+)"""
COMMENTS = r"(?s)<!--.*?(?:-->|\z)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def alias_key(url: Column) -> Column:
    """What aliases are compared by: the url without its fragment, A-Z of scheme and host lower-cased; one without ``://`` as it is."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head == "", url).otherwise(F.concat(F.translate(head, UPPER, LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, an allow before a block of equal length; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    branches = reduce(
        lambda so_far, r: so_far.when(_fits(host, path, r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))),
        ordered[1:],
        F.when(_fits(host, path, ordered[0][1], ordered[0][2]), F.struct(F.lit(ordered[0][1] + ordered[0][2]).alias("rule"), F.lit(ordered[0][0]).alias("verdict"))),
    )
    return branches


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; empty without it."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)))


def _decoded(text: Column) -> Column:
    """Character references as characters; each once."""
    for name, character in NAMED:
        text = F.replace(text, F.lit(name), F.lit(character))
    number = lambda e: F.when(F.lower(e).startswith("x"), F.substring(e, 2, 20)).otherwise(F.conv(e, 10, 16))
    code = lambda e: F.conv(number(e), 16, 10).cast("long")
    codes = F.regexp_extract_all(text, F.lit(r"(?i)&#(x0*[0-9a-f]{1,6}|0*[0-9]{1,7});"), 1)
    codes = F.filter(codes, lambda e: (code(e) != 38) & (code(e) > 0) & (code(e) < 0x110000) & ~code(e).between(0xD800, 0xDFFF))
    character = lambda e: F.decode(F.unhex(F.lpad(F.regexp_replace(number(e), "^0+", ""), 8, "0")), "UTF-32")
    text = F.aggregate(codes, text, lambda so_far, e: F.replace(so_far, F.concat(F.lit("&#"), e, F.lit(";")), character(e)))
    return F.regexp_replace(text, "(?i)&(amp|#0*38|#x0*26);", "&")


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` segments resolved."""
    segments = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _resolved(target: Column, base: Column) -> Column:
    """``target`` as a url; null if it is a part of the page itself or of another kind than ``scheme://``."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    return (
        F.when(target.rlike(SCHEME + "//"), target)
        .when(target.rlike(SCHEME) | target.startswith("#") | (target == ""), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(origin == "", None)
        .when(target.startswith("?"), F.concat(origin, F.when(path_of(base) == "", "/").otherwise(path_of(base)), target))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): all redirects and canonical links that pages declare.

    Attributes may be in any order and in either or no quotes; character references are decoded; what stands in a comment declares
    nothing. Relative targets are resolved against the page's url, or its ``<base>`` where that has a scheme. Both urls are
    given as ``alias_key`` does.
    """
    pages = pages.filter("url is not null and html is not null").filter(F.col("html").rlike(r"(?i)<(link|meta)\b")).select("url", F.regexp_replace("html", COMMENTS, "").alias("html"))
    links = F.filter(F.regexp_extract_all("html", F.lit(LINKS), 1), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all("html", F.lit(METAS), 1), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    hrefs = F.transform(links, lambda t: _decoded(_attribute(t, "href")))
    found = F.concat(hrefs, F.transform(metas, lambda t: F.regexp_extract(_decoded(_attribute(t, "content")), REFRESH, 1)))
    base = F.trim(_decoded(_attribute(F.regexp_extract("html", BASES, 1), "href")))
    return (
        pages.select("url", F.when(base.rlike(SCHEME + "//"), base).otherwise(F.col("url")).alias("base"), F.explode(found).alias("raw"))
        .select(alias_key(F.col("url")).alias("url"), alias_key(_resolved(F.regexp_replace("raw", r"^\s+|\s+$", ""), F.col("base"))).alias("target"))
        .filter("target is not null and target <> url")
        .distinct()
    )


def judge_urls(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` (page_id, url).

    A url takes the verdict of the longest rule that fits it. A url that no rule fits is blocked if any url that its
    redirects and canonical links reach, in any direction, is blocked by a rule; otherwise it takes ``default``. An
    explicit allow therefore always stands, and never clears an alias.

    Returns page_id, host, path, rule (null if none fits), verdict, via_alias (the verdict came from an alias). A null url
    or one without ``://`` has an empty host and path; rows repeat as they do in the input; other columns are not read.
    ``links`` has url and target, which aliases are compared by as ``alias_key`` gives them. Only urls that have a link are shuffled by it, and a component costs its minimum only.
    """
    judged = pages.select("page_id", "url").withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "path": path_of(F.coalesce("url", F.lit("")))})
    judged = judged.withColumn("own", explicit_rule(F.col("host"), F.col("path"), rules))
    links = stored(links.select(alias_key(F.col("url")).alias("url"), alias_key(F.col("target")).alias("target")), "alias-links")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit(default)).alias("verdict"), F.lit(False).alias("via_alias"))
    members = stored(connected_components(links, "url", "target"), "aliases")
    own = explicit_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = members.filter(own["verdict"] == "block").select("component").distinct()
    spread = stored(members.join(blocked, "component", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("aliased")), "blocked-aliases")
    out = judged.withColumn("key", alias_key(F.col("url"))).join(spread, "key", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("aliased"), "block"), F.lit(default))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), (F.col("own").isNull() & F.coalesce("aliased", F.lit(False))).alias("via_alias"))


def op5_url_equivalence(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge_urls(pages, alias_links(pages))


QUERIES = {"op5_url_equivalence": op5_url_equivalence}



def _sql() -> str:
    """The operator's rules as DuckDB SQL, over all pairs of urls that links connect."""
    lower = lambda t: f"translate({t}, '{UPPER}', '{LOWER}')"
    after = lambda u: f"(CASE WHEN position('://' IN {u}) > 0 THEN substr({u}, position('://' IN {u}) + 3) ELSE '' END)"
    host = lambda u: lower(f"regexp_extract({after(u)}, '^[^/?#]*', 0)")
    path = lambda u: f"regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1)"
    head = lambda u: f"regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)"
    key = lambda u: f"(CASE WHEN {head(u)} = '' THEN {u} ELSE {lower(head(u))} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END)"
    attribute = lambda tag, name: "concat(" + ", ".join(f"""regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', {k})""" for k in (1, 2, 3)) + ")"
    code = "(CASE WHEN lower(e[1]) = 'x' THEN list_reduce(list_prepend(0, list_transform(string_split(lower(e[2:]), ''), lambda d: position(d IN '0123456789abcdef') - 1)), lambda m, d: m * 16 + d) ELSE CAST(e AS BIGINT) END)"
    valid = f"{code} NOT IN (0, 38) AND {code} < 1114112 AND {code} NOT BETWEEN 55296 AND 57343"
    rule = lambda u: f"(SELECT arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) FROM rules WHERE ({host(u)} = rhost OR ends_with({host(u)}, '.' || rhost)) AND starts_with({path(u)}, rpath))"

    def decoded(t: str) -> str:
        for name, character in NAMED:
            t = f"replace({t}, '{name}', '{character if character != chr(39) else chr(39) * 2}')"
        codes = f"list_filter(regexp_extract_all({t}, '(?i)&#(x0*[0-9a-f]{{1,6}}|0*[0-9]{{1,7}});', 1), lambda e: {valid})"
        return f"regexp_replace(list_reduce(list_prepend({t}, {codes}), lambda s, e: replace(s, '&#' || e || ';', chr(CAST({code} AS INTEGER)))), '(?i)&(amp|#0*38|#x0*26);', '&', 'g')"

    def dotless(p: str) -> str:
        parts = f"string_split(regexp_replace(substr({p}, 2), '(^|/)(\\.\\.?)$', '\\1\\2/'), '/')"
        return f"('/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda s: [s])), lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE a || x END), '/'))"

    wait = "^\\s*[0-9.]+\\s*[;,]\\s*"
    rest = """["'']?\\s*([^"'']+)"""
    return f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
h AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g') AS html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
b AS (SELECT url, html, trim({decoded(attribute("regexp_extract(html, '(?is)<base[^>]*>', 0)", "href"))}) AS base FROM h),
t AS (SELECT url, base, 'link' AS kind, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag FROM b UNION ALL SELECT url, base, 'meta', unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) FROM b),
c AS (SELECT url, base, kind, CASE kind WHEN 'link' THEN {decoded(attribute('tag', 'href'))} ELSE {decoded(attribute('tag', 'content'))} END AS x FROM t
  WHERE CASE kind WHEN 'link' THEN list_contains(regexp_split_to_array(lower({attribute('tag', 'rel')}), '\\s+'), 'canonical') ELSE lower(trim({attribute('tag', 'http-equiv')})) = 'refresh' END),
r AS (SELECT url, CASE WHEN regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN base ELSE url END AS base, regexp_replace(CASE kind WHEN 'link' THEN x
  ELSE CASE WHEN regexp_matches(x, '(?is){wait}') AND NOT regexp_matches(x, '(?is){wait}url\\s*=') THEN regexp_extract(x, '(?is){wait}{rest}', 1) ELSE regexp_extract(x, '(?is)\\burl\\s*=\\s*{rest}', 1) END END, '^\\s+|\\s+$', '', 'g') AS t FROM c),
o AS (SELECT *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(t, '^[^?#]*', 0) AS tp, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS tr, {path('base')} AS bp FROM r),
s AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(t, '#') OR t = '' THEN NULL WHEN starts_with(t, '//') THEN regexp_extract(base, '^([^:]*:)', 1) || t
  WHEN starts_with(t, '/') THEN origin || {dotless('tp')} || tr WHEN origin = '' THEN NULL WHEN starts_with(t, '?') THEN origin || CASE WHEN bp = '' THEN '/' ELSE bp END || t
  ELSE origin || {dotless("(CASE WHEN regexp_extract(bp, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(bp, '^(.*/)', 1) END || tp)")} || tr END AS target FROM o),
edges AS (SELECT DISTINCT {key('url')} AS a, {key('target')} AS b FROM s WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
bad AS (SELECT b AS node FROM (SELECT DISTINCT b FROM both_ways) WHERE {rule('b')}.verdict = 'block'),
spread AS (SELECT DISTINCT r.a AS key FROM reach r JOIN bad ON bad.node = r.b),
own AS (SELECT page_id, url, {host("coalesce(url, '')")} AS host, {path("coalesce(url, '')")} AS path, {rule("coalesce(url, '')")} AS o FROM pages)
SELECT page_id, host, path, o.rule AS rule, coalesce(o.verdict, CASE WHEN s.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, (o IS NULL AND s.key IS NOT NULL) AS via_alias
FROM own LEFT JOIN spread s ON s.key = {key('own.url')}
"""


ORACLE_SQL = {"op5_url_equivalence": _sql()}
