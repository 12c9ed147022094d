"""URL rules by a sort-merge range join, with built-in functions only.

A rule is a host and a path prefix; it fits its host and all subdomains. With the host's labels reversed and each closed
by a dot ("com.example."; no label has one inside), a rule's hosts are one interval of sorted keys. The path goes in front,
its length before it: a url gives one key for each length that some rule's path has (that many first characters of its
path), so a rule is the interval of keys that start with ``length:path reversed host``, whatever characters a path or host
has. Intervals are nested or disjoint, and those around a key have different numbers of labels.

Rules and distinct keys are range-partitioned together and written sorted, a file for each section. One sorted sweep over a
section keeps the stack of active rules: for each number of labels the last rule seen, which holds the key if it is a
prefix of it (any later rule of as many labels would lie inside it, which cannot be). What is open at a section's start
comes from one row per section. The deepest rule that holds the key is the longest for that path; of the lengths'
winners the longest rule wins. Work is linear in rules and keys but for sorting. The verdicts are joined back to the urls
by host and path; that side has one row per key, so a host or url with a third of all rows can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Tables

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, "\\.")


def reversed_host(host: Column) -> Column:
    """www.example.com -> "com.example.www." """
    return F.concat(F.array_join(F.reverse(_labels(host)), "."), F.lit("."))


def _key(path: Column, host: Column) -> Column:
    return F.concat(F.length(path).cast("string"), F.lit(":"), path, reversed_host(host))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (page_id, url), rules (host, path, verdict) -> (page_id, host, path, rule, verdict), a row for each of urls.

    The longest fitting rule (characters of host and path) decides; of equally long ones the least host, then path, and of
    rules that say both, "block". Without a rule the verdict is "allow" and rule is null.

    * Null urls and urls without "://" have empty host and path; no rule fits them. A null page_id is kept.
    * Repeated rows stay repeated. Rules with a null host or path, or an empty host, fit nothing. No rules: all "allow".
    * Other columns are ignored. No urls give no rows.
    """
    tables = Tables(urls.sparkSession)
    pages = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = (
        rules.where("host is not null and path is not null and host <> ''")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    whole = F.concat("host", "path")
    key = _key(F.col("path"), F.col("host"))
    known = known.select(
        key.alias("key"),
        F.length("path").alias("size"),
        F.size(_labels(F.col("host"))).alias("depth"),
        F.struct(key.alias("key"), whole.alias("rule"), F.length(whole).alias("n"), "verdict").alias("r"),
    )
    known = tables.keep(known, "rules")
    # path lengths and label counts of the rules: at most as many as the longest has characters
    sizes, depths = known.agg(F.sort_array(F.collect_set("size")), F.sort_array(F.collect_set("depth"))).first()
    if not sizes:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    sites = pages.select("host", "path").where("host <> ''").distinct()
    fronts = F.transform(F.filter(F.array(*[F.lit(x) for x in sizes]), lambda l: l <= F.length("path")), lambda l: F.substring(F.col("path"), F.lit(1), l))
    fanned = sites.select("host", "path", F.explode(F.transform(fronts, lambda p: _key(p, F.col("host")))).alias("key"))
    points = fanned.select("key").distinct().select("key", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast(known.schema["r"].dataType).alias("r"))
    events = points.unionByName(known.select("key", F.lit(0).alias("kind"), "depth", "r"))
    events = tables.keep(events.repartitionByRange("key", "kind").sortWithinPartitions("key", "kind"), "events")
    events = events.withColumn("section", F.col("_metadata.file_name"))

    def at(depth: int, value: str) -> Column:
        return F.when(F.col("depth") == depth, F.col(value))

    # a row for each section: its last rule of each depth, and those open from the sections before
    ends = events.groupBy("section").agg(F.min(F.struct("key", "kind")).alias("first"), *(F.max_by(at(d, "r"), at(d, "key")).alias(f"end{d}") for d in depths))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("section", *(F.last(f"end{d}", ignorenulls=True).over(before).alias(f"in{d}") for d in depths))
    sweep = Window.partitionBy("section").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumns({f"on{d}": F.last(at(d, "r"), ignorenulls=True).over(sweep) for d in depths}).where("kind = 1")
    stack = F.array(*(F.coalesce(f"on{d}", f"in{d}") for d in depths))
    held = F.filter(stack, lambda r: r.isNotNull() & F.startswith(F.col("key"), r["key"]))
    deepest = swept.join(carried, "section").select("key", F.try_element_at(held, F.lit(-1)).alias("r")).where("r is not null")
    deepest = tables.keep(deepest.select("key", "r.rule", "r.n", "r.verdict"), "deepest")

    # back to distinct sites, then to the urls
    won = (
        fanned.join(deepest, "key")
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.col("n"), "rule")).alias("r"))
        .select("host", "path", "r.*")
    )
    return pages.join(won, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict")
    )
