"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule is a host and the beginning of a path; it fits the host and all its
subdomains.  Hosts are reversed by label, so "a.example.org" ends each of the
canonical keys "org", "org.example" and "org.example.a", and a rule becomes the interval of
the keys (reversed host, path...) that begin with its own.  Rules' begins and ends and the URLs' keys
are sorted together, host by host; the sweep keeps the nested rules
that are active on a stack, one window per level: the rule at depth d is the
last one that was pushed to depth d.

URLs are judged once for each host and path.  The keys of a host are dealt to as
many sweeps as ``SWEEP_ROWS`` asks for, each with all rules of that host.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one host that are swept together, about.
SWEEP_ROWS = 50_000


def url_parts(url) -> tuple:
    """Columns (host, path) of a URL column.

    Host: from the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
    path: from there up to "?", "#" or the end.  Null, or no "://": both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _reversed(host):
    return F.reverse(F.split(host, "[.]", -1))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``pages`` with columns host, path, rule and verdict (columns of these names are replaced).

    ``rules`` has (host, path, verdict).  Of the rules that fit a URL the longest,
    as host + path, wins; of equally long ones the one with the longer host, and of equal ones a
    "block".  ``rule`` is null where none fits, ``verdict`` then ``default``.
    Rules with a null host or path are ignored; an empty host fits nothing.
    """
    host, path = url_parts(F.col(url_col))
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    lowered = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    own = rules.filter("path is not null and host != ''").groupBy(lowered.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(F.array_join(_reversed(F.col("host")), ".").alias("site"), F.encode("path", "utf-8").alias("lo"),
                     F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("rule"))
    labels = _reversed(F.col("host"))
    urls = pages.select("host", "path").filter("host != ''").distinct()
    keys = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))).alias("site"))
    sites = keys.groupBy("site").agg(F.count(F.lit(1)).alias("n")).join(own.select("site").distinct(), "site")
    sites = sites.select("site", F.ceil(F.col("n") / sweep_rows).cast("int").alias("sweeps"))
    none = F.lit(None)
    swept = keys.join(sites, "site").select("site", F.pmod(F.xxhash64("host", "path"), "sweeps").cast("int").alias("sweep"), F.encode("path", "utf-8").alias("key"),
                                            F.lit(1).alias("turn"), F.lit(0).alias("push"), "host", "path", none.cast(own.schema["rule"].dataType).alias("rule"))
    dealt = own.join(sites, "site").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
    # No UTF-8 text has the byte FF: it ends the interval of all paths that begin with the rule's.
    ends = F.array(F.struct(F.col("lo").alias("key"), F.lit(0).alias("turn"), F.lit(1).alias("push")),
                   F.struct(F.concat("lo", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("turn"), F.lit(-1).alias("push")))
    events = dealt.withColumn("e", F.explode(ends)).select("site", "sweep", "e.key", "e.turn", "e.push", none.cast("string").alias("host"), none.cast("string").alias("path"),
                                                           F.when(F.col("e.push") == 1, F.col("rule")).alias("rule"))
    # Of rules that begin at one key the shorter path is pushed first; there is just one of each path.
    order = ["key", "turn"]
    sweep = Window.partitionBy("site", "sweep").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("site", "sweep", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = swept.unionByName(events).withColumn("depth", F.sum("push").over(sweep))
    both = both.withColumn("top", F.last("rule", ignorenulls=True).over(level))
    best = both.filter("turn = 1 and depth > 0").groupBy("host", "path").agg(F.max("top").alias("top"))
    return (pages.join(best, ["host", "path"], "left").withColumn("rule", F.col("top.rule"))
            .withColumn("verdict", F.coalesce("top.verdict", F.lit(default))).drop("top"))
