"""File sources: directory listing, header-only discovery, per-participant CSV series, tabular profiling, stored priors."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.labels import extension, file_class
from anchorline.operators.audits import column_profile, extension_summary
from anchorline.session import listed, stage
from anchorline.sources.records import fields, read_records

REQUIRED = ("Timestamp", "Meal Type")
SKIPPED_DIRS = r"/(\.git|__pycache__|\.ipynb_checkpoints|\.DS_Store)(/|$)"
#: A file's stem.
STEM = r"([^/\\]*?)(\.[^./\\]*)?$"
# fixed values: texts that count as missing
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# fixed values: file column -> series column
COLUMNS = {"Dexcom GL": "sensor_a", "Libre GL": "sensor_b", "METs": "activity", "HR": "heart_rate", "Carbs": "dose", "Protein": "protein_g", "Fat": "fat_g",
           "Fiber": "fiber_g", "Calories": "calories"}
TEXT_COLUMNS = {"Meal Type": "anchor_label", "Amount Consumed": "amount_consumed_raw", "Image path": "image_name"}
SERIES_SCHEMA = T.StructType([T.StructField("participant_id", T.StringType()), T.StructField("row_order", T.LongType()), T.StructField("us", T.LongType()),
                              *[T.StructField(c, T.DoubleType()) for c in COLUMNS.values()], *[T.StructField(c, T.StringType()) for c in TEXT_COLUMNS.values()],
                              T.StructField("columns_present", T.ArrayType(T.StringType()))])


def scan_directory(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """path, extension, length of every file under root; contents are never opened."""
    f = listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)).select("path", "length", *more)
    return f.where(~F.col("path").rlike(SKIPPED_DIRS)).withColumn("ext", extension("path")).withColumn("class", file_class("path"))


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First record of each file, read through whatever file system its URI names and no further; an unreadable file is no candidate."""
    from pyarrow import fs
    for pdf in batches:
        names = []
        for path in pdf["uri" if "uri" in pdf else "path"]:
            try:
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as s, io.TextIOWrapper(s, encoding="utf-8-sig", errors="replace", newline="") as text:
                    names.append([c.strip() for c in next(csv.reader(text))])
            except Exception:  # noqa: BLE001
                names.append(None)
        yield pdf.assign(columns=names)


def discover_participant_files(spark: SparkSession, root: str, required=REQUIRED) -> DataFrame:
    """path, uri (as Spark's file metadata spell it), columns of the CSV files whose (trimmed) header holds the required columns, whatever the file is called."""
    csv_files = scan_directory(spark, root, "_metadata.file_path").where(F.col("ext") == "csv").select("path", F.col("file_path").alias("uri"))
    # a scan makes a task of every few dozen small files, and starting Python for it takes far longer than their headers
    h = csv_files.repartition("uri").mapInPandas(_headers, "path string, uri string, columns array<string>")
    need = F.array(*[F.lit(c) for c in required])
    return h.where(F.col("columns").isNotNull() & (F.size(F.array_except(need, "columns")) == 0))


def participant_id_from_path(path, pattern: str = STEM) -> F.Column:
    return F.regexp_extract(path, pattern, 1)


def load_series(spark: SparkSession, root: str, files: DataFrame | None = None, id_pattern: str = STEM) -> DataFrame:
    """All participant files as one series; `row_order` rises along a file. Files are read in splits, whatever their layouts, and a row meets its
    file's header by (file, split). Columns are found by trimmed name (the first of equal names); texts in MISSING are null, numbers and times that cannot
    be read too. An absent column is NULL and also missing from `columns_present`, because an absent channel and an empty one are different facts.

    Files that end inside a quoted field are left out (`refused_files`). No files, no rows."""
    headers = stage(discover_participant_files(spark, root) if files is None else files, "headers")
    width = headers.agg(F.max(F.size("columns"))).first()[0]
    if width is None:
        return spark.createDataFrame([], SERIES_SCHEMA)
    rows, _ = read_records(spark, root, headers)
    row = rows.select("path", "at", "columns", fields("value", width).alias("f"))

    def cell(c):
        at = F.array_position("columns", F.lit(c))
        x = F.when(at > 0, F.get("f", (at - 1).cast("int")))
        return F.when(~x.isin(*MISSING), x)

    time = cell("Timestamp")
    us = F.unix_micros(F.coalesce(F.try_to_timestamp(time), *[F.try_to_timestamp(time, F.lit(f)) for f in ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")]))
    return row.select(participant_id_from_path(F.col("path"), id_pattern).alias("participant_id"), F.col("at").alias("row_order"), us.alias("us"), *[cell(c).try_cast("double").alias(n) for c, n in COLUMNS.items()],
                      *[cell(c).alias(n) for c, n in TEXT_COLUMNS.items()], F.col("columns").alias("columns_present"))


def refused_files(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """path of every participant file that ends inside a quoted field, which `load_series` leaves out."""
    return read_records(spark, root, stage(discover_participant_files(spark, root) if files is None else files, "headers"))[1]


def column_availability(headers: DataFrame) -> DataFrame:
    """column_name, n_files that have it, in_every_file, n_total; names only, so nobody is identified. A name repeated in a header counts once."""
    n = headers.count()
    return (headers.select(F.explode(F.array_distinct("columns")).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_files"))
            .select("column_name", "n_files", (F.col("n_files") == n).alias("in_every_file"), F.lit(n).cast("bigint").alias("n_total")))


def column_sets(headers: DataFrame) -> DataFrame:
    """n_files, n_columns, columns_beyond_common (sorted) of every distinct set of columns. The common columns come to the driver: no more than one header holds."""
    common = [r[0] for r in column_availability(headers).where("in_every_file").select("column_name").collect()]
    return (headers.groupBy(F.array_sort("columns").alias("columns")).agg(F.count(F.lit(1)).alias("n_files"))
            .select("n_files", F.size("columns").cast("bigint").alias("n_columns"), F.array_sort(F.array_except("columns", F.array(*[F.lit(c) for c in common]).cast("array<string>"))).alias("columns_beyond_common")))


def with_channel_flag(series: DataFrame, file_column: str) -> DataFrame:
    """has_channel = the file had the channel's column at all."""
    return series.withColumn("has_channel", F.array_contains("columns_present", file_column))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV by extension; delimited files keep every column as text."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return spark.read.option("header", "true").option("sep", sep).csv(path)


def profile_table(spark: SparkSession, path: str) -> DataFrame:
    """Column profile of a whole stored table: one aggregate."""
    return column_profile(read_table(spark, path))


def dataset_audit(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Listing, extension counts, image summary, document candidates and participant-file headers, each a DataFrame."""
    files = scan_directory(spark, root)
    return {"files": files, "extensions": extension_summary(files),
            "images": files.where(F.col("class") == "image").agg(F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")),
            "documents": files.where(F.col("class") == "doc").select("path"), "participant_files": discover_participant_files(spark, root)}


# ------------------------------------------------------------------ stored priors

PRIOR_FORMAT = "anchorline-prior/1"
_B = "struct<mean:double,variance:double,noise:double,center:double>"
_C = "struct<mean_b:double,mean_g:double,v_bb:double,v_bg:double,v_gb:double,v_gg:double,noise:double,center:double>"
PRIOR_SCHEMA = f"format string, contains_participant_level_data boolean, model_b {_B}, model_c {_C}, provenance struct<prior_scheme:string,fitted_on:string,excluded_participants_count:bigint>, _extra string"
PRIOR_KEYS = ("format", "contains_participant_level_data", "model_b", "model_c", "provenance")


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """Stored priors with the first rule each one breaks (NULL = usable)."""
    lines = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_name"))
    p = lines.withColumn("p", F.from_json("text", PRIOR_SCHEMA.replace(", _extra string", ""))).withColumn("keys", F.expr("json_object_keys(text)"))
    b, c, v = "p.model_b", "p.model_c", "p.provenance"
    ok = lambda x: F.coalesce(F.abs(F.col(x)) < float("inf"), F.lit(False))
    finite_b = ok(f"{b}.mean") & ok(f"{b}.variance") & ok(f"{b}.noise")
    finite_c = ok(f"{c}.mean_b") & ok(f"{c}.mean_g") & ok(f"{c}.v_bb") & ok(f"{c}.v_bg") & ok(f"{c}.v_gg") & ok(f"{c}.noise")
    det = F.col(f"{c}.v_bb") * F.col(f"{c}.v_gg") - F.col(f"{c}.v_bg") * F.col(f"{c}.v_bg")
    allowed = F.array(*[F.lit(k) for k in PRIOR_KEYS])
    why = (F.when(F.col("keys").isNull(), "not a JSON object").when(F.coalesce(F.col("p.format"), F.lit("")) != PRIOR_FORMAT, "unknown format")
           .when(~F.coalesce(F.col("p.contains_participant_level_data") == F.lit(False), F.lit(False)), "must declare no participant-level data")
           .when(F.size(F.array_except("keys", allowed)) > 0, "unexpected keys")
           .when(~finite_b | ~finite_c, "missing or non-finite values").when((F.col(f"{b}.noise") <= 0) | (F.col(f"{c}.noise") <= 0), "noise variance must be positive")
           .when((F.coalesce(F.col(f"{b}.center"), F.lit(0.0)) != 0) | (F.coalesce(F.col(f"{c}.center"), F.lit(0.0)) != 0), "prior must be un-centred")
           .when(F.abs(F.col(f"{c}.v_bg") - F.coalesce(F.col(f"{c}.v_gb"), F.col(f"{c}.v_bg"))) > 1e-8, "covariance is not symmetric")
           .when((F.col(f"{b}.variance") <= 0) | (F.col(f"{c}.v_bb") <= 0) | (det <= 0), "covariance is not positive definite")
           .when(F.col(f"{v}.prior_scheme").isNull() | F.col(f"{v}.fitted_on").isNull() | F.col(f"{v}.excluded_participants_count").isNull(), "provenance is incomplete"))
    return p.select("file_name", "p.*", why.alias("rejected"))
