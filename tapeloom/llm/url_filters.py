"""URL filters: pattern rules found through their rarest literal token (DataFrame functions only).

Each rule is indexed under the rarest of its literal tokens; a URL's tokens look up the few rules that can match, and
only those run their regular expression. Lists of up to INLINE rules are a map literal of the plan, so no row leaves its
partition; longer lists, of whatever length, are a table that the distinct URLs' tokens are joined with. Both ways give
the same result.

Site rules (host, path) decide first, the longest that fits; pattern rules decide what these leave, block before
allow; a URL that nothing fits is allowed. A null URL, or one without '://', has an empty host and path and is allowed.
Repeated rows are judged each on their own; ties cannot arise, as of two site rules that fit one is longer; very long
URLs are read whole; an empty table gives no rows. Columns of other names pass through; host, path, rule and verdict are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import row, table

INLINE = 2000
#: Fixed values: (verdict, host, path), from the contract.
SITE_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that make a host one to block where they are a whole part of a label of it.
HOST_WORDS = "adserver adservice adult betting blackjack camgirls casino clickbait doubleclick escort gambling hookup jackpot keygen phishing poker popunder porn slots spyware torrent tracker viagra warez xxx".split()
#: Words that make a path one to block where they are a whole folder or file name of it.
PATH_WORDS = "ads adverts banner banners beacon cart checkout login logout popup register signin signup sponsored tracking unsubscribe".split()
#: (verdict, regular expression, literal tokens every match contains as whole tokens). Matched against host + path in lower case.
PATTERN_RULES = (
    *(("block", rf"^([^/]*[.-])?{w}([.-][^/]*)?(/|$)", (w,)) for w in HOST_WORDS),
    *(("block", rf"/{w}(\.[a-z0-9]+)?(/|$)", (w,)) for w in PATH_WORDS),
    ("block", r"^([^/]*[.])?spam-farm[.]", ("spam", "farm")),
    ("block", r"(^|[./_-])online-(casino|pharmacy|poker)", ("online",)),
    ("block", r"(^|[./_-])(buy|cheap|free)-(followers|pills|replica)-online([./_-]|$)", ("online",)),
    ("block", r"/wp-content/plugins/[^/]*-ads(/|$)", ("wp", "content", "plugins", "ads")),
    ("block", r"/(tag|author|category)/page/[0-9]+(/|$)", ("page",)),
    ("block", r"/cgi-bin/[^/]*redirect", ("cgi", "bin")),
    ("allow", r"/robots\.txt$", ("robots", "txt")),
    ("allow", r"/sitemap\.xml$", ("sitemap", "xml")),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*(/[^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: list[str], column: str = "url") -> dict[str, int]:
    """How often each of the rules' tokens occurs in the URLs: one row of bounded length, whatever the input."""
    url = F.lower(F.coalesce(F.col(column), F.lit("")))
    row = urls.select(F.split(url, "[^a-z0-9]+").alias("t")).agg(*[F.sum(F.array_contains("t", t).cast("long")).alias(f"c{i}") for i, t in enumerate(tokens)]).first()
    return {t: row[f"c{i}"] or 0 for i, t in enumerate(tokens)}


def _index(rules: dict[str, list[Column]]) -> Column | None:
    if not rules:
        return None
    return F.create_map(*[x for k, v in sorted(rules.items()) for x in (F.lit(k), F.array(*v))])


def _suffixes() -> Column:
    """The host and every domain above it."""
    labels = F.split("host", r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, "[^a-z0-9]+"))


def _inline(d: DataFrame, sites, patterns) -> DataFrame:
    """d (host, path, ...) with `site` (rule, verdict) and the pattern rules' `other`."""
    by_host: dict[str, list[Column]] = {}
    for verdict, host, path in sites:
        by_host.setdefault(host, []).append(F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")))
    by_token: dict[str, list[Column]] = {}
    for verdict, pattern, token in patterns:
        by_token.setdefault(token, []).append(F.struct(F.lit(pattern).alias("pattern"), F.lit(verdict).alias("verdict")))
    site, index = _index(by_host), _index(by_token)
    nothing = "cast(array() as array<struct<n:int,rule:string,path:string,verdict:string>>)"
    fit = F.expr(nothing) if site is None else F.flatten(F.transform(_suffixes(), lambda s: F.coalesce(F.element_at(site, s), F.expr(nothing))))
    fit = F.sort_array(F.filter(fit, lambda r: F.col("path").startswith(r["path"])), asc=False)
    target, none = F.lower(F.concat("host", "path")), "cast(array() as array<struct<pattern:string,verdict:string>>)"
    found = F.expr(none) if index is None else F.flatten(F.transform(_tokens(target), lambda t: F.coalesce(F.element_at(index, t), F.expr(none))))
    hits = F.transform(F.filter(found, lambda r: F.rlike(target, r["pattern"])), lambda r: r["verdict"])
    return d.withColumn("site", F.get(fit, F.lit(0))).withColumn("other", F.when(F.array_contains(hits, "block"), "block").otherwise("allow"))


def _joined(d: DataFrame, sites, patterns) -> DataFrame:
    """The same with the rules as tables; what is joined are the distinct (host, path)."""
    spark = d.sparkSession
    urls = d.select("host", "path").distinct()
    s = spark.createDataFrame([(h, p, v) for v, h, p in sites], "s_host string, s_path string, verdict string")
    site = urls.withColumn("s_host", F.explode(_suffixes())).join(s, "s_host").where(F.col("path").startswith(F.col("s_path")))
    best = F.max(F.struct(F.length(F.concat("s_host", "s_path")).alias("n"), F.concat("s_host", "s_path").alias("rule"), F.col("s_path").alias("path"), "verdict"))
    site = site.groupBy("host", "path").agg(best.alias("site"))
    target = F.lower(F.concat("host", "path"))
    r = spark.createDataFrame([(t, p) for v, p, t in patterns if v == "block"], "token string, pattern string")
    hit = urls.withColumn("token", F.explode(_tokens(target))).join(r, "token").where(F.rlike(target, F.col("pattern"))).select("host", "path").distinct().withColumn("hit", F.lit(True))
    known = urls.join(site, ["host", "path"], "left").join(hit, ["host", "path"], "left")
    return d.join(known, ["host", "path"]).withColumn("other", F.when(F.col("hit"), "block").otherwise("allow"))


def judge(urls: DataFrame, column: str = "url", sites=SITE_RULES, patterns=PATTERN_RULES, counts: dict[str, int] | None = None, inline: int = INLINE) -> DataFrame:
    """urls with `host`, `path`, `rule` (of a site rule, else null) and `verdict`.

    counts: how common tokens are; each pattern rule is indexed by the rarest of its own (ties: the first).
    """
    counts = counts or {}
    indexed = [(v, p, min(ts, key=lambda t: (counts.get(t, 0), ts.index(t)))) for v, p, ts in patterns]
    d = urls.select(row(urls, "host", "path", "rule", "verdict"), host_of(F.col(column)).alias("host"), path_of(F.col(column)).alias("path"))
    d = (_inline if len(sites) + len(patterns) <= inline else _joined)(d, sites, indexed)
    return d.select("row.*", "host", "path", F.col("site.rule").alias("rule"), F.coalesce("site.verdict", "other").alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    counts = token_counts(pages, sorted({t for _, _, ts in PATTERN_RULES for t in ts}))
    return judge(pages, counts=counts).select("page_id", "host", "path", "rule", "verdict")


_CASES = " ".join(f"WHEN ('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2])))
_VERDICTS = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in SITE_RULES)
_BLOCKS = " OR ".join(f"regexp_matches(target, '{p}')" for p in sorted({p for v, p, _ in PATTERN_RULES if v == "block"}))
OP8_SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, lower(host || path) AS target, CASE {_CASES} END AS rule FROM b
)
SELECT page_id, host, path, rule,
  CASE rule {_VERDICTS} ELSE CASE WHEN {_BLOCKS} THEN 'block' ELSE 'allow' END END AS verdict
FROM c
"""
