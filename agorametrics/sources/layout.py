"""Layouts that later reads profit from: files clustered along a curve, tables in buckets of a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 8
FILE_ROWS = 1_000_000
BUCKET_ROWS = 500_000  # of a table, on average


class HotKey(ValueError):
    """One key holds too many rows for a bucket."""


def _number(name: str, df: DataFrame):
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.unix_date(name).cast("double") if kind == "date" else F.col(name).cast("double")


def curve_place(df: DataFrame, columns: list[str], bits: int = BITS):
    """Place of a row on a curve that keeps rows together that are near in all ``columns`` (numbers, dates or times): the bits of
    the columns' quantile classes in turn. Nulls are in the lowest class."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(_number(c, df), shares, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    cuts = [np.array(q or []) for q in found]  # a few hundred numbers a column

    @F.pandas_udf("long")
    def place(values: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(values), np.int64)
        for j, edges in enumerate(cuts):
            x = values.iloc[:, j].to_numpy(float)
            rank = np.where(np.isnan(x), 0, np.searchsorted(edges, x, side="right"))
            for b in range(bits):
                out |= (rank >> b & 1) << (b * len(cuts) + len(cuts) - 1 - j)
        return pd.Series(out)

    return place(F.struct(*[_number(c, df).alias(c) for c in columns]))


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None, bits: int = BITS, row_group: int = 16 << 20) -> None:
    """Write files whose statistics say little of many values of ``columns``: a filter on some of them reads few files and row
    groups. Rows of one place on the curve go on by the columns themselves, so a hot value is as many files as it needs."""
    files = files or max(1, -(-df.count() // FILE_ROWS))
    placed = df.withColumn("_curve", curve_place(df, columns, bits))
    ordered = placed.repartitionByRange(files, "_curve", *columns).sortWithinPartitions("_curve", *columns)
    ordered.drop("_curve").write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)


def bucket_count(*tables: DataFrame, least: int = 8) -> int:
    """Buckets for tables that are joined with each other: as many as the longest one asks for, since a bucket is one task. Pass
    stored tables, whose rows are counted from file footers."""
    return max(least, *[-(-t.count() // BUCKET_ROWS) for t in tables])


def write_bucketed(df: DataFrame, path: str, name: str, keys: list[str], buckets: int, most: float = 4.0) -> DataFrame:
    """A table in hash buckets of ``keys``, each one sorted file: joins and aggregations on the keys need no shuffle
    between tables of as many buckets. A bucket is one task, so a key with more than ``most`` times a bucket's
    share of the rows raises ``HotKey``: such tables are joined by a shuffle, which is split."""
    spark = df.sparkSession
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if sizes.top and sizes.top > max(1_000, most * sizes.all / buckets):
        raise HotKey(f"a key of {name} holds {sizes.top} of {sizes.all} rows, too many for one of {buckets} buckets")
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
