"""Upsert tables that cost a batch its own rows: a log of versions, folded when read.

A batch is written as the files of a version, nothing else is touched. Each file is listed in the log with
the range of its keys' hashes and a Bloom filter of them. A reader folds what versions after the base hold
with those base files alone that may share a key with them, by range and filter; all others are
passed on as they are, without a shuffle. ``lookup`` reads the files that may hold given keys. ``compact``
folds the later versions into the base once they have grown to a share of it, and rewrites only base files
that hold their keys.

A version counts from the moment its list, one file, is in the log: a batch that failed leaves nothing that
is read, and one that is repeated under its version's number changes nothing. There is one writer at a
time. Rows with a null in the key never meet others: they are kept, in files of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.operators.ingest import folded_rows
from agorametrics.session import empty, forget_shuffles, materialize

PROBES = 5
CELL = 52  # a hash without these low bits is its cell
LOG = "file string, n bigint, low bigint, high bigint, bloom array<bigint>, level int, keyless boolean, removed boolean"


_schemas: dict[str, T.StructType] = {}


def _second(h: str) -> Column:
    return F.xxhash64(F.col(h), F.lit(1))


def _may_hold(h: str, bloom: str) -> Column:
    """Whether a file's filter lets a hash through."""
    bits = f"(size({bloom}) * 64L)"
    one, other = f"pmod({h}, {bits})", f"pmod(xxhash64({h}, 1), {bits})"
    tests = [f"(shiftright(get({bloom}, cast(({one} + {i}L * {other}) % {bits} div 64 as int)), cast(({one} + {i}L * {other}) % {bits} % 64 as int)) & 1L) = 1L"
             for i in range(PROBES)]
    return F.expr(" and ".join(tests))


def _pack(c: Column) -> Column:
    """Text as bytes, half as many where it is an id in hex digits, as shuffles can't pack those; ``_plain`` gives back any text."""
    short = F.unhex(c)
    return F.when(F.lower(F.hex(short)) == c, F.concat(F.lit(b"\1"), short)).otherwise(F.concat(F.lit(b"\0"), c.cast("binary")))


def _plain(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path``: columns in ``updates`` take the last value of a key, all others keep the first."""

    path: str
    keys: tuple[str, ...]
    updates: tuple[str, ...] = ()
    overwrite_nulls: bool = True
    rows: int = 1_000_000  # of a file
    bits: int = 10  # of a filter for each key

    # --- writing ---------------------------------------------------------------------------
    def create(self, spark: SparkSession, columns: str | T.StructType) -> KeyedTable:
        """An empty table with these columns; one that is there already stays."""
        schema = columns if isinstance(columns, T.StructType) else T.StructType.fromDDL(columns)
        empty(spark, schema).write.mode("ignore").parquet(f"{self.path}/columns")
        empty(spark, LOG).write.mode("ignore").parquet(f"{self.path}/log/version=-1")
        return self

    def append(self, batch: DataFrame, version: int, order: str = "_ord") -> None:
        """Store a batch, rows of one key applied in ``order``. ``version`` is a number above those of earlier batches; a
        batch that comes again under its number is left alone."""
        spark = batch.sparkSession
        if version < 0:
            raise ValueError("versions count from 0")
        same, based = self._log(spark).agg(
            F.coalesce(F.max(F.col("version") == version), F.lit(False)), F.coalesce(F.max(F.expr("not keyless and not removed")), F.lit(False))).first()
        if same:
            return
        level = int(based)
        keyed = F.lit(True)
        for k in self.keys:
            keyed = keyed & F.col(k).isNotNull()
        columns = self._schema(spark).names
        at = self._each(batch.filter(keyed), _pack, F.struct(F.col(order).cast("bigint")).alias("_at"))
        rows = folded_rows(at, columns, self.keys, self.updates, self.overwrite_nulls)
        self._write(rows.withColumn("_version", F.lit(version).cast("bigint")), version, level, batch.filter(~keyed).select(*columns))

    def _each(self, rows: DataFrame, f, *more: Column | str, columns: list[str] | None = None) -> DataFrame:
        """The table's columns, or these, with ``f`` of those that are text, and more columns."""
        text = self._texts(rows.sparkSession)
        return rows.select(*[f(F.col(c)).alias(c) if c in text else F.col(c) for c in columns or self._schema(rows.sparkSession).names], *more)

    def _write(self, rows: DataFrame, version: int, level: int, keyless: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Write packed rows, one a key."""
        spark, folder = rows.sparkSession, f"{self.path}/data/{version}"
        text = self._texts(spark)
        placed = rows.withColumn("_h", F.xxhash64(*[_plain(F.col(k)) if k in text else F.col(k) for k in self.keys])).repartitionByRange("_h").sortWithinPartitions("_h")
        plain = self._each(placed, _plain, "_version", "_h")
        plain.write.mode("overwrite").option("maxRecordsPerFile", self.rows).option("compression", "zstd").parquet(f"{folder}/keyed")
        forget_shuffles()  # before the files' hashes are shuffled
        listed = self._listed(spark.read.schema(self._stored(spark)).parquet(f"{folder}/keyed"), level)
        if keyless is not None:
            keyless.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/keyless")
            names = spark.read.schema(self._schema(spark)).parquet(f"{folder}/keyless").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
            listed = listed.unionByName(names.withColumns({"keyless": F.lit(True), "removed": F.lit(False), "level": F.lit(level)}), allowMissingColumns=True)
        if removed is not None:
            listed = listed.unionByName(removed.select("file").withColumns({"keyless": F.lit(False), "removed": F.lit(True)}), allowMissingColumns=True)
        # one file: it is there or it isn't; what it holds, a row a file, was made by many tasks before
        columns = [f.name for f in T.StructType.fromDDL(LOG)]
        materialize(listed.select(*columns), "listed-files").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")

    def _listed(self, rows: DataFrame, level: int) -> DataFrame:
        """The log's rows of files: range and filter of the hashes, made of one file's hashes at a time. A file goes by a hash of
        its name, as names are longer than the rest of a row."""
        bits = self.bits

        def filters(group: pa.Table) -> pa.Table:
            h, second = group["_h"].to_numpy(), group["_g"].to_numpy()
            m = 64 * max(1, -(-h.size * bits // 64))
            words = np.zeros(m // 64, np.uint64)
            one, other = h % m, second % m
            for i in range(PROBES):
                p = (one + i * other) % m
                np.bitwise_or.at(words, p // 64, np.uint64(1) << (p % 64).astype(np.uint64))
            return pa.table({
                "_f": group["_f"].slice(0, 1), "n": pa.array([h.size], pa.int64()), "low": pa.array([h.min()]), "high": pa.array([h.max()]),
                "bloom": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})

        name = F.col("_metadata.file_path")
        hashes = rows.select(F.xxhash64(name).alias("_f"), "_h", _second("_h").alias("_g"))
        found = hashes.groupBy("_f").applyInArrow(filters, "_f bigint, n bigint, low bigint, high bigint, bloom array<bigint>")
        names = rows.select(name.alias("file")).distinct().withColumn("_f", F.xxhash64("file"))
        return names.join(found, "_f").drop("_f").withColumns({"level": F.lit(level), "keyless": F.lit(False), "removed": F.lit(False)})

    # --- reading ---------------------------------------------------------------------------
    def _schema(self, spark: SparkSession) -> T.StructType:
        # columns of a table never change
        if self.path not in _schemas:
            _schemas[self.path] = spark.read.parquet(f"{self.path}/columns").schema
        return _schemas[self.path]

    def _texts(self, spark: SparkSession) -> set[str]:
        return {f.name for f in self._schema(spark) if isinstance(f.dataType, T.StringType)}

    def _stored(self, spark: SparkSession) -> T.StructType:
        return T.StructType([*self._schema(spark), T.StructField("_version", T.LongType()), T.StructField("_h", T.LongType())])

    def _log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{LOG}, version bigint").parquet(f"{self.path}/log")

    def files(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The log's rows of the files that make up the table, or made it up before a version."""
        log = self._log(spark)
        if before is not None:
            log = log.where(F.col("version") < before)
        return log.where("not removed").join(log.where("removed").select("file"), "file", "left_anti")

    def _names(self, files: DataFrame) -> list[str]:
        # names go through the driver, which lists them for any read
        return sorted(r.file for r in files.select("file").collect())

    def _read(self, spark: SparkSession, names: list[str], schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)

    def _fold(self, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """One packed row a key."""
        both = self._each(rows, _pack, F.struct("_version").alias("_at"), columns=columns)
        return folded_rows(both, both.columns[:-1], self.keys, self.updates, self.overwrite_nulls, newest="_version")

    def _hits(self, hashes: DataFrame, files: DataFrame) -> DataFrame:
        """_h, file: files that may hold a hash, by range and filter."""
        cells = files.withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL), F.shiftright("high", CELL))))
        asked = hashes.select("_h", F.shiftright("_h", CELL).alias("cell"))
        near = asked.join(cells.select("cell", "file", "low", "high"), "cell").where("_h between low and high").select("_h", "file")
        return near.join(files.select("file", "bloom"), "file").where(_may_hold("_h", "bloom")).select("_h", "file")

    def possible(self, hashes: DataFrame, files: DataFrame) -> DataFrame:
        """Those of ``files`` that may hold one of ``hashes`` (column ``_h``), by range and filter."""
        return self._hits(hashes, files).select("file").distinct()

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, one a key, and those without a key."""
        stored, files = self._stored(spark), self.files(spark)
        columns = self._schema(spark).names
        keyless = self._read(spark, self._names(files.where("keyless")), self._schema(spark))
        base, met, later = self._parts(spark, files)
        out = self._read(spark, base, stored).select(*columns).unionByName(keyless)
        return out.unionByName(self._each(self._fold(self._read(spark, met + later, stored)), _plain)) if later else out

    def _parts(self, spark: SparkSession, files: DataFrame) -> tuple[list[str], list[str], list[str]]:
        """Base files nothing later shares a key with, other base files, files of later versions."""
        keyed = files.where("not keyless")
        base, later = self._names(keyed.where("level = 0")), self._names(keyed.where("level = 1"))
        if not later:
            return base, [], []
        hashes = self._read(spark, later, self._stored(spark)).select("_h").distinct()
        met = self._names(self.possible(hashes, keyed.where("level = 0")))
        return [f for f in base if f not in set(met)], met, later

    def lookup(self, wanted: DataFrame, before: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of the keys in ``wanted``, which has the key columns; only files that may hold one are read. ``before``:
        as the table was before a version. ``columns``: the keys and what else is asked for, all columns without it."""
        spark = wanted.sparkSession
        # read twice
        keys = materialize(wanted.select(*self.keys).distinct(), "wanted-keys", "zstd")
        files = self.files(spark, before).where("not keyless")
        names = self._names(self.possible(keys.select(F.xxhash64(*self.keys).alias("_h")), files))
        found = self._read(spark, names, self._stored(spark)).join(keys, list(self.keys), "left_semi")
        return self._each(self._fold(found, columns), _plain, columns=columns)

    def size(self, spark: SparkSession, version: int) -> int:
        """Keys of a stored version."""
        return self._log(spark).where(F.col("version") == version).where("not keyless and not removed").agg(F.sum("n").alias("n")).first().n or 0

    def repeated(self, spark: SparkSession, version: int) -> DataFrame:
        """n: how many keys of a stored version the table held before it. No row but those two sides' keys is read."""
        own = self._names(self._log(spark).where(F.col("version") == version).where("not keyless and not removed"))
        rows = self._read(spark, own, self._stored(spark))
        names = self._names(self.possible(rows.select("_h"), self.files(spark, version).where("not keyless")))
        held = self._each(self._read(spark, names, self._stored(spark)), _pack, columns=list(self.keys))
        return self._each(rows, _pack, columns=list(self.keys)).join(held, list(self.keys), "left_semi").agg(F.count(F.lit(1)).alias("n"))

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the table lacks, or that have none. The filters say which keys it may hold; only files that may
        hold one are read, and of these only rows with such a key are compared."""
        spark = rows.sparkSession
        files = self.files(spark).where("not keyless")
        hashes = rows.select(F.xxhash64(*self.keys).alias("_h")).distinct()
        hits = materialize(self._hits(hashes, files), "possible-keys")
        held = self._read(spark, self._names(hits.select("file").distinct()), self._stored(spark))
        held = held.join(hits.select("_h").distinct(), "_h", "left_semi").select(*self.keys)
        return rows.join(held, list(self.keys), "left_anti").select(*rows.columns)

    # --- upkeep ----------------------------------------------------------------------------
    def compact(self, spark: SparkSession, version: int, share: float = 0.1) -> bool:
        """Fold later versions into the base as ``version`` once they hold ``share`` of its rows; whether it was done."""
        if self._log(spark).where(F.col("version") == version).limit(1).count():
            return False
        files = self.files(spark).where("not keyless")
        sizes = {r.level: r.n for r in files.groupBy("level").agg(F.sum("n").alias("n")).collect()}
        if not sizes.get(1) or sizes[1] < share * sizes.get(0, 0):
            return False
        _, met, later = self._parts(spark, files)
        rows = self._fold(self._read(spark, met + later, self._stored(spark)))
        self._write(rows, version, 0, removed=spark.createDataFrame([(f,) for f in met + later], "file string"))
        return True
