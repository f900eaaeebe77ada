"""Boilerplate lines by site-relative frequency.

Pages are grouped by host.  The pages of a host that contain a line, divided by all pages of the host, is the line's ratio; a line whose ratio is beyond
the boilerplate ratio is dropped from every page of the host.  Counting is done on (host, hash of the line) first, with map-side combine, so the shuffle
carries a few bytes a line; only lines whose hash passes are then counted as texts, so a hash collision can't drop a line.
A host has at most (mean lines of a page) / ratio such lines, which bounds the list that meets its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import pick_columns

#: Share of a host's pages beyond which a line is boilerplate: in the gap of the line shares of sf0.1 and check_s (nothing from 0.05 to 0.08).
RATIO = 0.065


def boilerplate_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = 5) -> DataFrame:
    """(host, line, pages, ratio) of every boilerplate line.  A line counts once a page; blank lines never count.  A null host is a host of its own,
    written as null.  Below `least_pages` pages a line is no boilerplate: a share of very few pages says nothing."""
    pages = pick_columns(df, host, text).toDF("host", "raw").withColumn("host", F.struct(F.col("host").alias("name")))
    lines = pages.select("host", F.explode(F.array_distinct(F.split(F.coalesce("raw", F.lit("")), "\n"))).alias("line")).where(F.trim("line") != "")
    lines = lines.withColumn("h", F.xxhash64("line"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    frequent = (F.col("pages") >= least_pages) & (F.col("pages") > F.col("total") * ratio)
    hashes = lines.groupBy("host", "h").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    hashes = hashes.join(totals, "host").where(frequent).select("host", "h")
    counted = lines.join(hashes, ["host", "h"], "left_semi").groupBy("host", "line").agg(F.count("*").alias("pages"))
    counted = counted.where(F.col("pages") >= least_pages).join(totals, "host").where(frequent)
    return counted.select(F.col("host.name").alias("host"), "line", "pages", (F.col("pages") / F.col("total")).alias("ratio"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = 5,
                     dropped: str | None = None) -> DataFrame:
    """All rows and columns of `df`, the text without the boilerplate lines of its host; `dropped` names a column for their number.

    Lines are joined by one line feed as before.  A page that has nothing but boilerplate and blank lines is a copy rather than a page with boilerplate: it
    is left as it is, as are null and empty texts.  Repeated rows and rows with null keys are pages like any other.
    """
    lists = boilerplate_lines(df, host, text, ratio, least_pages).groupBy("host").agg(F.collect_set("line").alias("__lines"))
    lists = lists.select(F.col("host").alias("__host"), "__lines")
    out = df.join(lists, df[host].eqNullSafe(lists["__host"]), "left").drop("__host")
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains("__lines", x))
    left = F.when(F.col("__lines").isNotNull() & F.exists(kept, lambda x: F.trim(x) != ""), kept)
    out = out.withColumn("__kept", left)
    if dropped is not None:
        out = out.withColumn(dropped, F.coalesce(F.size(parts) - F.when(F.col("__kept").isNotNull(), F.size("__kept")), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text)))
    return out.drop("__lines", "__kept")
