"""Official CSV exports to staging records, and labelled text files."""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions.text import _strip, is_blank, normalize_dataset_label
from agorametrics.functions.timeparse import parse_timestamp_local, to_int
from agorametrics.operators.posts import timestamp
from agorametrics.schemas import COUNT_DEFAULT_ZERO, COUNT_NULLABLE
from agorametrics.session import materialize
from agorametrics.vocab import CSV_PROFILES, DEFAULT_CSV_PROFILE


class MissingColumn(ValueError):
    """A required field has no header in the file."""


def get_profile(profile_id: str | None = None) -> dict:
    name = profile_id or DEFAULT_CSV_PROFILE
    if name not in CSV_PROFILES:
        raise KeyError(f"unknown profile {name!r}: use one of {sorted(CSV_PROFILES)}")
    return CSV_PROFILES[name]


def resolve_columns(headers, profile: dict) -> tuple[dict[str, str], list[str]]:
    """Header per canonical field, and the headers no field uses."""
    present = set(headers)
    found = {}
    for field, candidates in profile["columns"].items():
        header = next((c for c in candidates if c in present), None)
        if header is not None:
            found[field] = header
    missing = [f for f in profile["required"] if f not in found]
    if missing:
        wanted = {f: profile["columns"][f] for f in missing}
        raise MissingColumn(f"no header for {wanted}; the file has {list(headers)}")
    used = set(found.values())
    return found, [h for h in headers if h not in used]


COLUMNS = 20_480  # Spark's own limit; a wider header raises it

# --- records of files that are read in splits ------------------------------------------------
# A line starts outside or inside a quoted value, and leaves a value open or not. Lines are split among
# tasks; every split reports what it makes of both starts, the splits of a file are added up in order, and
# then each reads its records from its true start.


def _left_open(line: Column) -> Column:
    """Whether a line that starts outside a value ends inside one. Doubled quotes must be gone; a quote opens a value at
    its start only, and what follows a closing one belongs to the value up to the comma."""
    return F.regexp_replace(line, '(?:^|,)"[^"]*"[^,]*', ",").rlike('(?:^|,)"')


def _lines(spark: SparkSession, files, sep: str = "\n") -> DataFrame:
    """file, block, value, and whether the line leaves a value open when it starts outside and inside of one."""
    lines = spark.read.option("lineSep", sep).text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    bare = F.replace("value", F.lit('""'), F.lit(""))
    # inside a value all up to the first quote belongs to it
    behind = F.concat(F.lit("x"), F.substr(bare, F.instr(bare, F.lit('"')) + 1))
    return lines.withColumns({
        "outside": F.when(F.col("value").contains('"'), _left_open(bare)).otherwise(False),
        "inside": F.when(bare.contains('"'), _left_open(behind)).otherwise(True),
    })


def _runs(batch: pa.RecordBatch):
    """First and last row of each run of one file and block, and these."""
    n = batch.num_rows
    if not n:
        return
    file, block = batch.column(0), batch.column(1).to_numpy()
    new = (block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield lo, hi, (file[lo].as_py(), int(block[lo]))


def _turns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows that open a value when it is outside of one, and that close it when it is inside."""
    return np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)), np.flatnonzero(~batch.column(3).to_numpy(zero_copy_only=False))


def _next(rows: np.ndarray, at: int, end: int) -> int:
    """The first of ``rows`` from ``at`` on; ``end`` if there is none before."""
    k = int(np.searchsorted(rows, at))
    return min(int(rows[k]), end) if k < rows.size else end


_SPLITS = "file string, block long, outside boolean, inside boolean, through boolean, plain boolean, head string"


def _splits(lines: DataFrame) -> DataFrame:
    """What each split makes of both starts, whether a value open at its start is open all through it, whether no line that
    starts outside a value ends inside one, a file's first record."""
    # only the first split of a file holds its header
    narrow = lines.select("file", "block", "outside", "inside", F.when(F.col("block") == 0, F.col("value")).alias("value"))

    def run(batches):
        at, states, through, plain, head, reading = None, [False, True], True, True, [], True
        names = [c.split()[0] for c in _SPLITS.split(", ")]

        def report():
            first = "\n".join(head) if at[1] == 0 else None
            return pa.RecordBatch.from_arrays([
                pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]]), pa.array([through]), pa.array([plain]),
                pa.array([first], pa.string())], names)

        for batch in batches:
            turns = _turns(batch)
            for lo, hi, now in _runs(batch):
                if now != at:
                    if at is not None:
                        yield report()
                    at, states, through, plain, head, reading = now, [False, True], True, True, [], True
                i, open_value = lo, bool(head)
                while at[1] == 0 and reading and i < hi:
                    line = batch.column(4)[i].as_py()
                    if head or line.strip():
                        head.append(line)
                        open_value = batch.column(3 if open_value else 2)[i].as_py()
                        reading = open_value
                    i += 1
                through = through and _next(turns[1], lo, hi) == hi
                plain = plain and _next(turns[0], lo, hi) == hi
                for k, state in enumerate(states):
                    i = lo
                    while (i := _next(turns[state], i, hi)) < hi:
                        i, state = i + 1, not state
                    states[k] = state
        if at is not None:
            yield report()

    return narrow.mapInArrow(run, _SPLITS)


def _inside(splits: DataFrame) -> DataFrame:
    """file, block, opened, closed: splits that start inside a value, the one it was opened in, whether it ends at all."""
    order = W.partitionBy("file").orderBy("block")
    same = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # splits that end alike from both starts begin a run; in it, each that only turns things round counts
    fixed = F.col("outside") == F.col("inside")
    runs = splits.withColumn("run", F.count_if(fixed).over(order.rowsBetween(W.unboundedPreceding, 0)))
    base = F.first(F.when(fixed, F.col("outside")).otherwise(False)).over(same)
    turned = F.count_if(F.col("outside") & ~F.col("inside")).over(same) % 2 == 1
    ends = runs.withColumn("ends", base != turned)
    starts = ends.withColumn("starts", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    opens = F.when(F.col("ends") & ~(F.col("starts") & F.col("through")), F.col("block"))
    placed = starts.withColumns({
        "opened": F.last(opens, ignorenulls=True).over(before), "left": F.last("ends").over(whole),
        "last": F.last(opens, ignorenulls=True).over(whole)})
    return placed.where("starts").select("file", "block", "opened", (~(F.col("left") & (F.col("opened") == F.col("last")))).alias("closed"))


_PARTS = "file string, block long, row long, part long, whole boolean, record string"


def _records(lines: DataFrame, inside: dict[tuple[str, int], tuple[int, bool]] | None) -> DataFrame:
    """file, block and row of a record's first line, record; a file's first record, its header, is left out.

    ``inside`` says of splits that start inside a value where it was opened and whether it is closed at all. The parts of a
    record that spans splits are put together; if its quote is never closed, each further part is a record. With None
    every line is a record, whatever its quotes say.
    """
    if inside is None:
        lines = lines.withColumns({"outside": F.lit(False), "inside": F.lit(False)})

    def run(batches):
        at, state, row, held, first, heading = None, False, 0, [], (0, 0), False
        names = [c.split()[0] for c in _PARTS.split(", ")]

        def one(whole):
            return pa.RecordBatch.from_arrays([
                pa.array([at[0]]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([at[1]], pa.int64()),
                pa.array([whole]), pa.array(["\n".join(held)])], names)

        for batch in batches:
            turns = _turns(batch)
            for lo, hi, now in _runs(batch):
                if now != at:
                    if held:
                        yield one(False)
                    opened = (inside or {}).get(now)
                    at, row, held, state = now, 0, [], opened is not None
                    first = (opened[0], -1) if opened and opened[1] else (now[1], 0)
                    heading = now[1] == 0
                i = lo
                while i < hi:
                    to = _next(turns[state], i, hi)
                    while heading and not state and i < to:  # blank lines and a header of one line
                        heading = not batch.column(4)[i].as_py().strip()
                        i += 1
                    if not state and to > i:  # lines that are records
                        n = to - i
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.arange(row + i - lo, row + to - lo)),
                            batch.column(1).slice(i, n), pa.array(np.ones(n, dtype=bool)), batch.column(4).slice(i, n).cast(pa.string())], names)
                    if not state and to < hi:
                        held, first = [batch.column(4)[to].as_py()], (at[1], row + to - lo)
                    if state:
                        held += batch.column(4).slice(i, min(to + 1, hi) - i).to_pylist()
                        if to < hi:
                            if not heading:
                                yield one(first[1] >= 0)
                            held, heading = [], False
                    state, i = state ^ (to < hi), to + 1
                row += hi - lo
        if held:
            yield one(False)

    parts = lines.select("file", "block", "outside", "inside", "value").mapInArrow(run, _PARTS)
    whole = parts.where("whole").select("file", "block", "row", "record")
    if inside is None:
        return whole
    # a value that reaches into further splits is one text in any case
    joined = parts.where("not whole").groupBy("file", "block").agg(
        F.max("row").alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined)


def _names(head: str) -> list[str]:
    names = [n.lstrip("\ufeff") for n in next(csv.reader(io.StringIO(head.lstrip("\ufeff"), newline="")), [])]
    while names and not names[-1]:
        names.pop()
    return names


def _layouts(spark: SparkSession, path: str, sep: str = "\n") -> tuple[dict[tuple[str, tuple[str, ...]], list[str]], dict, set[str]]:
    """Files by line end and header, the splits that start inside a value, and the files in which no value holds a line end: one
    pass over the text.

    A row per file comes to the driver, whose file index has them too, and one per split that starts inside a value.
    """
    splits = materialize(_splits(_lines(spark, path, sep)), "csv-splits")
    found: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    old = []
    for file, head in splits.where("block = 0").select("file", "head").orderBy("file").collect():
        head = head.removesuffix("\r")
        if sep == "\n" and "\r" in re.sub('"[^"]*"', "", head):
            old.append(file)  # lines that end with a carriage return alone
        else:
            found.setdefault((sep, tuple(_names(head))), []).append(file)
    inside = {(r.file, r.block): (r.opened, r.closed) for r in _inside(splits).collect()}
    # a file's first line starts outside a value; so does each further one as long as none leaves a value open
    plain = {r.file for r in splits.groupBy("file").agg(F.bool_and("plain").alias("plain")).where("plain").collect()}
    if old:
        more, others, lines = _layouts(spark, old, "\r")
        found |= more
        inside = {k: v for k, v in inside.items() if k[0] not in set(old)} | others
        plain = plain - set(old) | lines
    return found, inside, plain


def export_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a folder by their header."""
    found: dict[tuple[str, ...], list[str]] = {}
    for (_, header), files in _layouts(spark, path)[0].items():
        found.setdefault(header, []).extend(files)
    return found


def _read(spark: SparkSession, path: str, multiline: bool | None, more: str = ""):
    """Frame and column names per header of the files of ``path``; ``_file`` and ``_place`` say where a record starts."""
    layouts, inside, plain = _layouts(spark, path)
    for (sep, header), files in layouts.items():
        names = [n or f"_unnamed_{i}" for i, n in enumerate(header)]
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, *([more] if more else [])])
        # where every line is a record, quotes need not be looked at again
        simple = [f for f in files if multiline is False or f in plain]
        other = sorted(set(files) - set(simple))
        parts = [_records(_lines(spark, simple, sep), None)] if simple else []
        if other:
            parts.append(_records(_lines(spark, other, sep), {k: v for k, v in inside.items() if k[0] in set(other)}))
        records = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        text = F.regexp_replace("record", "\\r\\z", "")
        kept = records.where(F.trim(text) != "")
        options = {"escape": '"', "multiLine": "true", "maxColumns": str(max(COLUMNS, len(names) + 1)), "maxCharsPerColumn": "-1"}
        if more:
            options["columnNameOfCorruptRecord"] = more
        yield names, kept.select(
            F.from_csv(text, schema, options).alias("_r"), F.col("file").alias("_file"), F.struct("file", "block", "row").alias("_place")).select("_r.*", "_file", "_place")


def read_export(spark: SparkSession, path: str, multiline: bool | None = None) -> list[DataFrame]:
    """All columns as text, one frame per header the files of ``path`` have.

    Every file is split among tasks, also where quoted values hold line breaks. With ``multiline=False`` none
    does and every line is a record. ``_place`` orders rows as they stand: file, block, row.
    """
    return [raw.drop("_file") for _, raw in _read(spark, path, multiline)]


def malformed_rows(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """file, record, reason: records with more or fewer columns than their header.

    reason: ``quote_left_open`` or ``column_count``. The scans keep such records: absent columns are null,
    surplus ones have no name and are left out. A quote that is never closed makes the rest of its split a record,
    and every further split of the file.
    """
    out = spark.createDataFrame([], "file string, record string, reason string")
    for names, raw in _read(spark, path, multiline, "_malformed_record"):
        text = F.col("_malformed_record")
        quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
        # a condition on all columns that always holds: Spark counts only those it reads
        every = F.concat_ws("", *[F.col(f"`{n.replace('`', '``')}`") for n in names]) >= ""
        read = raw.filter(text.isNotNull() & every).select(F.col("_file").alias("file"), text.alias("record"),
                          F.when(quotes % 2 == 1, "quote_left_open").otherwise("column_count").alias("reason"))
        out = out.unionByName(read)
    return out


def unmapped_headers(spark: SparkSession, path: str, profile_id: str | None = None) -> DataFrame:
    """file, header: the columns no field of the profile uses."""
    rows = [(f, h) for header, files in export_headers(spark, path).items()
            for h in resolve_columns([c for c in header if not c.startswith("_")], get_profile(profile_id))[1] for f in files]
    return spark.createDataFrame(rows, "file string, header string")


def map_export(raw: DataFrame, profile_id: str | None = None, platform: str | None = None,
               default_account: str | None = None, default_name: str | None = None) -> DataFrame:
    """Export columns under their canonical names, absent ones null, empty cells null.

    Rows without an account drop out. Other columns of the input, such as an ordinal starting
    with an underscore, are kept.
    """
    profile = get_profile(profile_id)
    found, _ = resolve_columns([c for c in raw.columns if not c.startswith("_")], profile)
    platform = platform or profile["platform"]
    if platform is None:
        raise ValueError("this profile has no platform: pass one")

    def cell(field: str) -> Column:
        if field not in found:
            return F.lit(None).cast("string")
        value = raw[f"`{found[field]}`"].cast("string")
        return F.when(value != "", value)

    account = F.coalesce(cell("account_external_id"), F.lit(default_account).cast("string"))
    columns = {f: cell(f) for f in profile["columns"]}
    columns["account_external_id"] = account
    columns["account_name"] = F.coalesce(columns["account_name"], F.lit(default_name).cast("string"))
    extra = [F.col(c) for c in raw.columns if c.startswith("_")]
    mapped = raw.select(*extra, F.lit(platform).alias("platform"),
                        *[c.alias(f) for f, c in columns.items()])
    return mapped.filter(F.col("account_external_id").isNotNull())


def csv_profile_scan(spark: SparkSession, path: str, profile_id: str | None = None, multiline: bool | None = None, **options) -> DataFrame:
    """The rows of all files, each mapped by its own header; ``_place`` is their order."""
    out = None
    for raw in read_export(spark, path, multiline):
        mapped = map_export(raw, profile_id, **options)
        out = mapped if out is None else out.unionByName(mapped, allowMissingColumns=True)
    return out


def csv_to_accounts(mapped: DataFrame, order: str = "_place") -> DataFrame:
    """Distinct accounts; handle and name of the first row."""
    first = F.min_by(F.struct("account_handle", "account_name"), order)
    return mapped.groupBy("platform", "account_external_id").agg(first.alias("_f")).select(
        "platform", F.col("account_external_id").alias("external_id"),
        F.col("_f.account_handle").alias("handle"), F.col("_f.account_name").alias("display_name"),
        F.lit(None).cast("bigint").alias("followers_count"), F.lit(False).alias("is_competitor"))


def _timed(mapped: DataFrame) -> DataFrame:
    """Rows whose time can be read, with a post id made from account and time where none is given."""
    timed = mapped.withColumn("_published", parse_timestamp_local(F.col("published_at")))
    made = F.concat(F.col("account_external_id"), F.lit(":"), _isoformat(F.col("_published")))
    return timed.filter(F.col("_published").isNotNull()).withColumn(
        "_post", F.coalesce("external_id", made))


def _isoformat(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def csv_to_posts(mapped: DataFrame, is_synthetic: bool = False) -> DataFrame:
    kept = [c for c in mapped.columns if c.startswith("_")]
    return _timed(mapped).select(
        *kept, "account_external_id", "platform", F.col("_post").alias("external_id"),
        F.col("_published").alias("published_at"), "content_type", "text_content", "permalink",
        F.lit(0).cast("bigint").alias("media_count"), F.lit(is_synthetic).alias("is_synthetic"))


def csv_to_snapshots(mapped: DataFrame, as_of) -> DataFrame:
    """One snapshot per post, captured at ``as_of``. Interactions default to 0, the rest to null."""
    kept = [c for c in mapped.columns if c.startswith("_")]
    zero = [F.coalesce(to_int(F.col(c)), F.lit(0)).alias(c) for c in COUNT_DEFAULT_ZERO]
    null = [to_int(F.col(c)).alias(c) for c in COUNT_NULLABLE]
    return _timed(mapped).select(
        *kept, F.col("_post").alias("post_external_id"), "account_external_id", "platform",
        timestamp(as_of).alias("captured_at"), *zero, *null)


def labeled_rows(raw: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Text and canonical label; rows with an unknown label or a blank text drop out."""
    kept = [c for c in raw.columns if c.startswith("_")]
    named = raw.select(*kept, _strip(F.col(text)).alias("text"),
                       normalize_dataset_label(F.col(label)).alias("label"))
    return named.filter(F.col("label").isNotNull() & ~is_blank(F.col("text")))


def labeled_csv_scan(spark: SparkSession, path: str, text: str = "text", label: str = "label", multiline: bool | None = None) -> DataFrame:
    out = None
    for raw in read_export(spark, path, multiline):
        rows = labeled_rows(raw, text, label).select("text", "label")
        out = rows if out is None else out.unionByName(rows)
    return out
