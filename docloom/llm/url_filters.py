"""URL filters as a sort-merge range join.

A host is turned into a canonical key by reversing its labels (``www.example.com`` is
``com.example.www.``), so that a rule for a host and all its subdomains is the interval of keys that
start with the rule's key. Path rules are the interval of paths that start with the rule's path. Such
intervals are nested or disjoint. A sweep over rules and urls in key order therefore needs a stack of
the open rules only: each rule carries the stack as it is when the rule opens, a running window hands
the last stack to every url behind it, and the url drops the entries that have closed since (those that
are not a prefix of its key).

There are two sweeps. The first finds the distinct rule paths that start a url's path, the second finds,
for each of these paths, the deepest host rule that has this path. The longest rule string wins.

Scale: only distinct (host, path) pairs are swept, after a pre-aggregated distinct. They are dealt
into slices by hash, so a hot host or path is in all of them, and each slice also gets the rules. There are four slices a
shuffle partition, but no more than keeps the replicated rules below the number of pages (one slice, which Spark
sorts with spilling, if there are more rules than pages). Nothing is broadcast or collected.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; urls
that fit none get ``default``. Among fitting rules of equal length the longer host wins. Rules that are
given twice with different actions block. Rules with a null host or path are ignored. Repeated pages
stay repeated; extra columns of the input stay as they are, except that result columns replace input
columns of the same name. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import partitions, read

#: The rules of the production query: (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the first / after the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Canonical key: labels reversed, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame, group: list[str], key: str) -> DataFrame:
    """For each distinct (group, key): the array of its keys' proper prefixes that are rules, and itself.

    Prefixes are enumerated and met by an equi-join, so a stack is no longer than its key.
    """
    own = rules.select(*group, key).distinct()
    prefixes = own.select(
        *group, F.col(key).alias("__of"), F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda i: F.expr(f"{key}").substr(F.lit(1), i))).alias(key)
    )
    return prefixes.join(own, [*group, key], "left_semi").groupBy(*group, F.col("__of").alias(key)).agg(F.array_sort(F.collect_set(F.col(key))).alias("__stack"))


def _swept(urls: DataFrame, stacks: DataFrame, group: list[str], key: str, slices: int) -> DataFrame:
    """urls with __open: the rule keys of the same group that start the url's key, shortest first."""
    names = urls.columns
    seats = stacks.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("__url", F.lit(0))
    dealt = urls.withColumn("__slice", F.pmod(F.xxhash64(*names), F.lit(slices)).cast("int")).withColumn("__url", F.lit(1))
    order = Window.partitionBy("__slice", *group).orderBy(key, "__url").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(seats, allowMissingColumns=True).withColumn("__last", F.last("__stack", ignorenulls=True).over(order)).where("__url = 1")
    is_open = F.filter(F.coalesce("__last", F.array().cast("array<string>")), lambda k: F.startswith(F.col(key), k))
    return swept.select(*names, is_open.alias("__open"))


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. rules: action ('allow' or 'block'), host, path."""
    spark = pages.sparkSession
    rules = (
        rules.where("host is not null and path is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("__h"), F.col("path").alias("__rp"))
        .agg(F.max(F.when(F.col("action") == "block", "block").otherwise("allow")).alias("__action"))  # block > allow
        .withColumn("__rk", host_key(F.col("__h")))
        .withColumn("__rule", F.concat("__h", "__rp"))
    )
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    n = partitions(spark)
    slices = slices or max(1, min(4 * n, pages.count() // max(1, rules.count())))
    urls = rows.select(F.col("host").alias("__uh"), F.col("path").alias("__up")).distinct()

    # First sweep: rule paths that start the url's path.
    paths = _stacks(rules.select("__rp"), [], "__rp").withColumnRenamed("__rp", "__up")
    at_path = _swept(urls, paths, [], "__up", slices).select("__uh", "__up", F.explode("__open").alias("__rp"))

    # Second sweep: the deepest host rule with such a path.
    hosts = _stacks(rules.select("__rp", "__rk"), ["__rp"], "__rk").withColumnRenamed("__rk", "__uk")
    found = _swept(at_path.withColumn("__uk", host_key(F.col("__uh"))), hosts, ["__rp"], "__uk", slices)
    found = found.where(F.size("__open") > 0).select("__uh", "__up", "__rp", F.element_at("__open", -1).alias("__rk"))

    # The longest rule of each url; the rule's own row gives its string and action.
    size = F.length("__rk") + F.length("__rp")
    best = found.groupBy("__uh", "__up").agg(F.max_by(F.struct("__rp", "__rk"), F.struct(size, F.length("__rk"))).alias("__b")).select("__uh", "__up", "__b.*")
    decided = best.join(rules.select("__rp", "__rk", "__rule", "__action"), ["__rp", "__rk"]).select("__uh", "__up", "__rule", "__action")
    joined = rows.join(decided, (rows["host"] == decided["__uh"]) & (rows["path"] == decided["__up"]), "left")
    return joined.select(*keep, "host", "path", F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A literal table of (action, host, path)."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op1_sql() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
with rules(action, rhost, rpath) as (values {values}),
u as (select row_number() over () as row_id, page_id,
  case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') else '' end as host,
  case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
fit as (select row_id, rhost || rpath as rule, action, row_number() over (partition by row_id order by length(rhost || rpath) desc, length(rhost) desc, action desc) as rn
  from u join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from u left join (select * from fit where rn = 1) using (row_id)"""
