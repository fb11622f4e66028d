"""URL rules as a sort-merge range join with a stack of nested rules.

A host's canonical key is its labels reversed, each closed by a separator that no
label has (its characters are escaped). A rule's host then covers an interval of
keys: itself and all subdomains. Rule hosts and page hosts are swept together in
key order. Intervals are nested or disjoint, so those open at a host are that of
the last rule host begun before it and the ones around that, without those that
have ended: the sweep's stack, at most one for each label. Path prefixes nest in
the same way: a second sweep, for each rule host in the order of paths, finds the
rules that fit, and the longest of all wins. A stack holds what is nested, never
all rules of a host.

The sweeps run over distinct hosts and distinct paths, so that a hot page is one
row. They are dealt out by top-level label and by rule host; one with many points
is dealt into several parts, each with a copy of its rules.

Defined cases: a null url, or one without "://", has an empty host and path and
fits no rule; so does an empty url path, since every rule's path begins with "/";
a rule without a host fits nothing; of equal rules one stays, block before
allow; very long urls are handled like others; repeated rows are judged one by
one; empty tables give empty results or default verdicts; an input column with
the name of an added one is replaced, other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closes each label of a key; a label's own such characters follow an escape.
_SEP, _ESC = "\x01", "\x02"
#: Points of one group that one partition of a sweep takes.
POINTS = 200_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.coalesce(F.when(at > 0, rest.substr(at, F.length(rest))), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def key_of(host: Column) -> Column:
    plain = F.replace(F.replace(host, F.lit(_ESC), F.lit(_ESC + "2")), F.lit(_SEP), F.lit(_ESC + "1"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), _SEP), F.lit(_SEP))


def nested(rules: DataFrame, group: str, at: str, around: Column, carried: Column) -> DataFrame:
    """(group, at, stack): each rule with those around it, itself included, found by
    an equi-join on the values of `around`; of each, what `carried` says."""
    outer = rules.select(group, at, F.explode(around).alias("outer"))
    own = rules.select(F.col(group).alias("of__"), F.col(at).alias("outer"), carried.alias("one"))
    found = outer.join(own, (F.col(group) == F.col("of__")) & (outer["outer"] == own["outer"]))
    return found.groupBy(group, at).agg(F.collect_list("one").alias("stack"))


def sweep(points: DataFrame, rules: DataFrame, group: str, at: str, most: int) -> DataFrame:
    """(group, at, stack) of the distinct points (group, at) inside an interval:
    the rules open there. Rules are (group, at, stack)."""
    # only groups that have rules; as many parts each as its points ask for
    sizes = points.join(rules.select(group).distinct(), group, "left_semi").groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    begun = rules.join(sizes, group).select(group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), at, "stack", F.lit(0).alias("point"))
    asked = points.join(sizes, group).select(
        group, F.pmod(F.xxhash64(at), F.col("parts").cast("long")).cast("int").alias("part"), at, F.lit(None).cast(rules.schema["stack"].dataType).alias("stack"), F.lit(1).alias("point")
    )
    order = Window.partitionBy(group, "part").orderBy(at, "point").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.filter("stack", lambda r: F.col(at).startswith(r[at]))
    events = begun.unionByName(asked).withColumn("stack", F.last("stack", ignorenulls=True).over(order))
    return events.where("point = 1").select(group, at, open_.alias("stack")).where(F.size("stack") > 0)


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", points: int = POINTS) -> DataFrame:
    """All rows of pages with host, path, rule (host and path of the longest that
    fits, or null) and verdict. rules has the columns verdict, host and path."""
    added = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in added]
    pages = pages.select(*(F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(rest)), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = (
        rules.where("host <> ''")
        .select(key_of(F.col("host")).alias("key"), F.col("path"), F.concat("host", "path").alias("rule"), "verdict")
        .groupBy("key", "path", "rule").agg(F.max("verdict").alias("verdict"))  # block after allow
    )
    top = F.substring_index(F.col("key"), _SEP, 1).alias("top")
    closings = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.col("key").substr(i, F.lit(1)) == _SEP)
    outer_keys = F.transform(closings, lambda i: F.substring("key", F.lit(1), i))
    hosts = pages.where("host <> ''").select("host").distinct().withColumn("key", key_of(F.col("host")))
    begun = nested(rules.select(top, "key").distinct(), "top", "key", outer_keys, F.struct("key"))
    open_ = sweep(hosts.select(top, "key"), begun, "top", "key", points)
    # where a page's host is inside rule hosts: its path, under each of them
    under = hosts.join(open_, "key").select("host", "stack")
    asked = pages.select("host", "path").distinct().join(under, "host").select("host", "path", F.explode("stack.key").alias("key"))
    outer_paths = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))
    verdict = F.struct("path", F.length("rule").alias("n"), F.length("key").alias("h"), "verdict", "rule")
    fits = sweep(asked.select("key", "path").distinct(), nested(rules, "key", "path", outer_paths, verdict), "key", "path", points)
    longest = F.array_max(F.transform("stack", lambda r: F.struct(r["n"].alias("n"), r["h"].alias("h"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    best = asked.join(fits.select("key", "path", longest.alias("best")), ["key", "path"]).groupBy("host", "path").agg(F.max("best").alias("best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(
        *(F.col(f"c{i}__").alias(c) for i, c in enumerate(rest)), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of op8 (verdict, host, path).
OP8_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in OP8_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(regexp_extract(s, '^[^?#]*'), '/.*$', 0, 's'), '') AS path FROM u
), r(verdict, h, pre) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), j AS (
  SELECT p.*, r.verdict AS v, r.h || r.pre AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.pre) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
