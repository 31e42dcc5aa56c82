"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host.  The number of a host's pages that contain a line, divided by the host's
page total, is the line's ratio; a line whose ratio is over ``max_ratio`` and which stands on at
least ``min_pages`` of the host's pages is boilerplate, and every copy of it on that host goes.

Cases: lines are compared whole and byte for byte; a line of white space alone is never dropped; a
null text stays null and counts as a page without lines; null hosts form one host; repeated rows are
pages of their own; an empty table gives an empty table.  Input columns other than the text are kept,
``n_lines`` and ``n_dropped`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

MAX_RATIO = 0.1
MIN_PAGES = 3


def _key(line: Column) -> Column:
    """Two 64-bit hashes of a line: 128 bits."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, __lines): the boilerplate of each host that has any.  An array holds fewer than
    1 / max_ratio times the lines of an average page of the host."""
    lines = F.array_distinct(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    counts = (
        pages.select(F.col(host).alias("__host"), F.explode(F.transform(lines, _key)).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= min_pages)
    )
    totals = pages.groupBy(F.col(host).alias("__of")).agg(F.count(F.lit(1)).alias("__pages"))
    return (
        counts.join(totals, F.col("__host").eqNullSafe(F.col("__of")))
        .filter(F.col("__n") > F.lit(max_ratio) * F.col("__pages"))
        .groupBy("__host")
        .agg(F.collect_list("__line").alias("__lines"))
    )


def drop_frequent_lines(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with boilerplate lines cut out of the text; n_lines and n_dropped count lines."""
    found = stage(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    split = F.split(F.col(f"__p.{text}"), "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("__lines"), _key(x)))
    joined = pages.alias("__p").join(found, F.col(f"__p.{host}").eqNullSafe(F.col("__host")), "left")
    rest = [F.col(f"__p.{c}") for c in pages.columns if c not in ("n_lines", "n_dropped", text)]
    both = joined.select(*rest, split.alias("__all"), F.when(F.col("__lines").isNull(), split).otherwise(kept).alias("__kept"))
    return both.select(
        *[c for c in pages.columns if c not in ("n_lines", "n_dropped", text)],
        F.array_join("__kept", "\n").alias(text),
        F.coalesce(F.size("__all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__all") - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumns({c: F.when(F.col(text).isNull(), 0).otherwise(F.col(c)).cast("long") for c in ("n_lines", "n_dropped")})
