"""Relational statistics: entropy, histograms, samples, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

ENTROPY_BYTES = 65536


def entropy_udf(most: int | None = ENTROPY_BYTES):
    """Shannon entropy in bits a byte of the first ``most`` bytes, of all if None. A byte histogram by numpy: exploding bytes into rows is far slower."""

    @pandas_udf("double")
    def entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for raw in batch:
                counts = np.bincount(np.frombuffer((raw or b"")[:most], dtype=np.uint8), minlength=1)
                p = counts[counts > 0] / max(counts.sum(), 1)
                out.append(float(-(p * np.log2(p)).sum()) + 0.0)
            yield pd.Series(out)

    return entropy


def top_n(df: DataFrame, by: list[str], key: str, n: int, count: str = "n") -> DataFrame:
    """The ``n`` most frequent values of ``key`` in each group, the larger key first among equals."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias(count))
    w = Window.partitionBy(*by).orderBy(F.col(count).desc(), F.col(key).desc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_overall(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    """The ``n`` most frequent values of ``key``, ranked. Only ``n`` rows of each task reach the one that ranks them."""
    order = (F.col(count).desc(), F.col(key).desc())
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias(count)).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, order: list[str], into: str = "_no") -> DataFrame:
    """Add a 0-based row number in a global ``order`` (the first column is a number) without bringing all rows to one task.

    Rows fall into buckets between approximate quantiles of the first column, which the driver asks for once, so that
    every pass agrees on them (a range exchange samples anew each time). Each bucket numbers its own rows after the
    counts of those before it, of which there is one row a bucket. Rows that tie in the first column share a bucket.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order[0], [k / parts for k in range(1, parts)], 0.001))) if parts > 1 else []
    edges = F.array(*map(F.lit, bounds)).cast("array<double>")
    bucketed = df.withColumn("_bucket", F.size(F.filter(edges, lambda b: b <= F.col(order[0]))))
    own = Window.partitionBy("_bucket").orderBy(*order)
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    out = bucketed.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(counts), F.col("_bucket") == F.col("_b"))
    return out.withColumn(into, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_own", "_before", "_bucket", "_b")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n ... in a global order."""
    return numbered(df, order).filter(F.col("_no") % n == 0).drop("_no")


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """For each group: covered length, overlaps and largest gap of its intervals; empty ones do not count."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    spans = df.filter(F.col(end) > F.col(start)).withColumn("_reach", F.max(end).over(w))
    fresh = F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start)))
    return spans.groupBy(*by).agg(
        F.sum(F.greatest(fresh, F.lit(0))).alias("covered"),
        F.count_if(F.col(start) < F.col("_reach")).alias("overlaps"),
        F.coalesce(F.max(F.greatest(F.col(start) - F.col("_reach"), F.lit(0))), F.lit(0)).alias("max_gap"),
    )


def contingency(b: Column, c: Column, low: Column) -> list[Column]:
    """Two by two: sizes equal or not, low byte zero or not; and how many shrank."""
    return [
        F.count_if((b == c) & (low == 0)).alias("equal_low0"),
        F.count_if((b == c) & (low != 0)).alias("equal_low"),
        F.count_if((b != c) & (low == 0)).alias("differ_low0"),
        F.count_if((b != c) & (low != 0)).alias("differ_low"),
        F.count_if(b > c).alias("b_above_c"),
    ]


def printable_ratio(raw: Column) -> Column:
    """Share of bytes that are 32 .. 126 or zero; 0 of nothing. Counted on hex pairs, in the JVM."""
    odd = F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[\\x20-\\x7E\\x00]", ""))
    return F.when(F.octet_length(raw) > 0, 1 - odd / F.octet_length(raw)).otherwise(F.lit(0.0))


def first_wins(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each group the least ``order`` (``first``), and how many rows it has (``n``): what comes later is a duplicate. Sums within tasks first."""
    return df.groupBy(*by).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def last_wins(df: DataFrame, by: list[str], value: str, order: str, versions: Column | None = None) -> DataFrame:
    """For each group the ``value`` of the greatest ``order`` (``last``), and on demand the sorted distinct ``versions``."""
    more = [F.sort_array(F.collect_set(versions)).alias("versions")] if versions is not None else []
    return df.groupBy(*by).agg(F.max_by(value, order).alias("last"), *more)


def ordered_distinct(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """``values``: the distinct values of each group that are not empty, in the order of their first places. Repeats are dropped before the shuffle gathers a group."""
    first = df.filter(F.col(value) != "").groupBy(*by, value).agg(F.min(order).alias("_first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    out = first.groupBy(*by).agg(listed.alias("values"))
    none = df.select(*by).distinct()
    return none.join(out, by, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def spread_sample(df: DataFrame, key: str, n: int = 12) -> DataFrame:
    """At most ``n`` rows at even distances over the values 0, 1 ... of ``key``: of every 1 + count // n the first, in order."""
    step = 1 + df.count() // n
    return df.filter(F.col(key) % step == 0).orderBy(key).limit(n)


def two_level(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Counts and sums of ``value`` by outer and inner key, with those of the outer key beside them."""
    both = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"))
    w = Window.partitionBy(outer)
    return both.withColumn("n_outer", F.sum("n").over(w)).withColumn("sum_outer", F.sum("sum").over(w))
