"""Delimited text read in splits, with every record's place in its file.

A quoted field may hold line breaks, so whether a line starts a record depends on all lines before it; that is why such files are usually read whole,
by one task each. Here a task reads a split of a file and notes, for each line, where its record starts if the split begins outside quotes and if it
begins inside. What a split does to that state is one of four functions, so one row per split, composed along the file, tells which of the two holds.
Lines that are a whole record by themselves stay where they are; only lines of records that span several meet in a shuffle, by record.

A record's place is the offset of its split plus the number of its line there, which rises along the file and is never shared: a line takes a byte at least."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.session import listed, stage

# a quote opens a field only at its start; two quotes inside are one; what follows the closing quote belongs to the field
_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|)'
_FROM_OUTSIDE = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_FROM_INSIDE = re.compile(rf'(?:[^"]|"")*+"[^,]*(?:,{_FIELD})*+')
#: Tasks that follow lines, or as many as the session shuffles to if that is more.
TASKS = 64
_LINE = "uri string, block bigint, at bigint, value string, start_out bigint, start_in bigint, out_after int, in_after int"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line."""
    if '"' not in line:
        return inside
    return (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is None


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split come together and in order. What is kept from batch to batch is the state under both beginnings."""
    split, n, outer, inner, starts = None, 0, False, True, [None, None]
    for batch in batches:
        out: list[tuple] = []
        for uri, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (uri, block) != split:
                split, n, outer, inner, starts = (uri, block), 0, False, True, [None, None]
            at = block + n + (block > 0)  # a split reads the lines that begin after its first byte, but for the first split
            n += 1
            if not outer:
                starts[0] = at
            if not inner:
                starts[1] = at
            same = outer == inner
            outer = ends_inside(value, outer)
            inner = outer if same else ends_inside(value, inner)
            out.append((at, *starts, int(outer), int(inner)))
        at, first, second, after, after_in = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                                          pa.array(after, pa.int32()), pa.array(after_in, pa.int32())], names=["uri", "block", "at", "value", "start_out", "start_in", "out_after", "in_after"])


def lines(spark: SparkSession, root: str, glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """Every line of the files under root, with where its record starts under both beginnings of its split."""
    raw = listed(spark, lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root))
    raw = raw.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), "value")
    # a scan makes a task of every few dozen small files, and starting Python for it takes far longer than their lines; splits stay whole and in order
    return raw.coalesce(max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_follow, _LINE)


def splits(marked: DataFrame) -> DataFrame:
    """uri, block, inside (a field is open where the split begins), carried (start of the record that is open there), unclosed (the file ends in an open field)."""
    each = marked.groupBy("uri", "block").agg(F.max_by("out_after", "at").alias("f_out"), F.max_by("in_after", "at").alias("f_in"),
                                              F.max("start_out").alias("last_out"), F.max("start_in").alias("last_in"))
    file = Window.partitionBy("uri").orderBy("block")
    sofar, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.when((F.col("f_out") == 1) & (F.col("f_in") == 0), 1).otherwise(0)
    fixed = F.when(F.col("f_out") == F.col("f_in"), F.struct(F.col("f_out").alias("to"), "turns"))  # such a split forgets how it began
    each = each.withColumn("turns", F.sum(swaps).over(sofar)).withColumn("fixed", F.last(fixed, ignorenulls=True).over(sofar))
    each = each.withColumn("after", F.pmod(F.coalesce("fixed.to", F.lit(0)) + F.col("turns") - F.coalesce("fixed.turns", F.lit(0)), F.lit(2)))
    each = each.withColumn("inside", F.coalesce(F.lag("after").over(file), F.lit(0)))
    own = F.when(F.col("inside") == 0, F.col("last_out")).otherwise(F.col("last_in"))
    each = each.withColumn("carried", F.last(own, ignorenulls=True).over(before))
    whole = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.select("uri", "block", "inside", "carried", (F.last("after").over(whole) == 1).alias("unclosed"))


def records(marked: DataFrame, known: DataFrame) -> DataFrame:
    """uri, at, value: whole records of files, header included, blank lines left out. `marked` is a stored result of `lines`, `known` are its splits (with
    any further columns, which are passed on). Lines meet their split by (uri, block), so no join gathers more than a split."""
    more = [c for c in known.columns if c not in ("uri", "block", "inside", "carried", "unclosed")]
    row = marked.join(known, ["uri", "block"])
    out = F.col("inside") == 0
    row = row.withColumn("start", F.coalesce(F.when(out, F.col("start_out")).otherwise(F.col("start_in")), "carried")).withColumn("open", F.when(out, F.col("out_after")).otherwise(F.col("in_after")))
    alone = row.where((F.col("start") == F.col("at")) & (F.col("open") == 0)).select("uri", "at", "value", *more)
    parts = row.where((F.col("start") != F.col("at")) | (F.col("open") == 1)).groupBy("uri", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), *[F.first(c).alias(c) for c in more])
    spanning = parts.select("uri", F.col("start").alias("at"), F.array_join("parts.value", "\n").alias("value"), *more)
    return alone.unionByName(spanning).where(F.trim("value") != "")


def read_records(spark: SparkSession, root: str, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the files in `headers` without their header rows, files that end inside a quoted field). `headers` has uri and path, columns.

    A file that ends inside a quoted field cannot be read by the format's rules. It is left out whole and returned by its path, so a
    record is never longer than a field that is closed again."""
    marked = stage(lines(spark, root), "lines")
    known = stage(splits(marked).join(headers, "uri"), "splits")
    good = records(marked, known.where(~F.col("unclosed"))).where(F.col("at") > 0)
    return good, known.where("unclosed").select("path").distinct()


def fields(record, width: int) -> F.Column:
    """The record's fields as an array of text, `width` of them; missing ones are null and further ones are ignored."""
    names = [f"c{i}" for i in range(width)]
    one = F.from_csv(record, ", ".join(f"{c} string" for c in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "multiLine": "true"})
    return F.transform(F.array(one), lambda s: F.array(*[s[c] for c in names]))[0]  # parsed once, not once a field
