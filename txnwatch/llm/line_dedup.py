"""Line dedup with DataFrame functions only.

Lines are what stands between line feeds.  Every window of three consecutive
lines is hashed to 128 bits; windows that occur more than once anywhere keep
their first occurrence, by (id, text, position), and the lines of all later ones
are removed, windows merging where they overlap.

One aggregate finds the first occurrence of each window, one join (Spark may
split its hot windows) the later ones; neither gathers a window's occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with columns n_lines (long), removed (array of line numbers from 0) and clean_text added.

    Ids order the documents, null ones first; documents of one id are ordered by a
    hash of their text, and rows equal in both are one document, so they get
    the same result.  Windows of white space only never count.  A text of fewer
    lines than ``window`` has none; a null text stays null with 0 lines.  Where all lines
    go, ``clean_text`` is empty.  Columns of the same names are replaced.
    """
    t, d = F.col(text_col), F.col(id_col)
    docs = docs.drop("n_lines", "removed", "clean_text")
    base = docs.select(d.alias("d"), F.xxhash64(t).alias("x"), F.split(t, "\n", -1).alias("lines")).filter(F.size("lines") >= window)
    grams = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(
        i.alias("p"), F.concat_ws("\n", F.slice("lines", i + 1, window)).alias("w")))
    each = base.select("d", "x", F.explode(grams).alias("g")).filter(F.col("g.w").rlike(r"\S"))
    each = each.select("d", "x", F.col("g.p").alias("p"), F.xxhash64("g.w").alias("h1"), F.xxhash64(F.lit(1), "g.w").alias("h2"))
    at = F.struct("d", "x", "p")
    first = each.groupBy("h1", "h2").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter(~F.col("lo").eqNullSafe(F.col("hi"))).drop("hi")
    later = each.join(first, ["h1", "h2"]).filter(~at.eqNullSafe(F.col("lo")))
    covered = later.groupBy("d", "x").agg(F.collect_set("p").alias("p"))
    covered = covered.select(F.col("d").alias("__d"), F.col("x").alias("__x"), F.array_sort(F.array_distinct(F.flatten(
        F.transform("p", lambda p: F.sequence(p, p + (window - 1)))))).alias("removed"))
    both = docs.join(covered, d.eqNullSafe(F.col("__d")) & (F.xxhash64(t) == F.col("__x")), "left").drop("__d", "__x")
    lines = F.split(t, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    return (both.withColumn("n_lines", F.when(t.isNull(), 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("clean_text", F.when(F.col("removed").isNull(), t).otherwise(F.concat_ws("\n", F.transform(kept, lambda p: F.get(lines, p)))))
            .withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))))
