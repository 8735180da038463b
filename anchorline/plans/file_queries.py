"""Registered queries: participant files found by header and loaded in file order. The files are written by Spark from `events`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.plans.registry import query
from anchorline.session import checkpoint_dir, stage
from anchorline.sources.adapters import table
from anchorline.sources.files import column_availability, column_sets, discover_participant_files, load_series
from anchorline.sources.sinks import write_series

#: The participant is the folder here, because Spark chooses the names of files it writes.
ID = r"participant_id=([^/]+)/"
LAYOUTS = (["Timestamp", "Dexcom GL", "Libre GL", "METs", "Meal Type", "Carbs", "Amount Consumed "], ["Timestamp", "METs", "Dexcom GL", " Meal Type", "Carbs", "Amount Consumed"],
           ["Amount Consumed", "Meal Type", "Libre GL", "Timestamp", "Dexcom GL"])


def written_files(spark, sf) -> str:
    """One CSV file per participant and month in three layouts, rows in no order of time, notes with quotes, commas and line breaks; and files that hold no series."""
    root = f"{checkpoint_dir(spark)}/anchorline/files-{uuid.uuid4().hex}"
    t, v, e = F.col("event_type"), F.col("value"), table(spark, sf, "events")
    note = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('half, "'), "props", F.lit('"\nleft'))).when(F.col("event_id") % 3 == 1, F.lit('a 5" plate')).otherwise(F.col("props")))
    cells = {"Timestamp": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "Dexcom GL": F.when(t.isin("view", "click", "error"), v), "Libre GL": F.when(t.isin("view", "error"), v),
             "METs": F.when(t == "signup", v), "Meal Type": F.when(t == "purchase", F.when(F.col("event_id") % 2 == 0, "Lunch").otherwise("N/A")), "Carbs": F.when(t == "purchase", F.col("event_id")),
             "Amount Consumed": F.when(t != "click", note)}
    rows = e.select(F.col("user_id").alias("participant_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM").alias("month"), F.md5(F.col("event_id").cast("string")).alias("place"), *[c.alias(n) for n, c in cells.items()])
    rows = stage(rows, "rows")
    for i, layout in enumerate(LAYOUTS):
        write_series(rows.where(F.col("participant_id") % len(LAYOUTS) == i).withColumnsRenamed({c.strip(): c for c in layout}), f"{root}/layout={i}", ["participant_id", "month"], layout, "place")
    e.groupBy("user_id").agg(F.count("*").alias("Timestamp")).write.option("header", "true").csv(f"{root}/counts")
    return root


def headers(spark, sf) -> DataFrame:
    return stage(discover_participant_files(spark, written_files(spark, sf)), "headers")


FILES = "files AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m') AS month, user_id % 3 AS layout FROM events)"
NAMES = """names AS (SELECT * FROM (VALUES (0, ['Timestamp', 'Dexcom GL', 'Libre GL', 'METs', 'Meal Type', 'Carbs', 'Amount Consumed']),
 (1, ['Timestamp', 'METs', 'Dexcom GL', 'Meal Type', 'Carbs', 'Amount Consumed']), (2, ['Amount Consumed', 'Meal Type', 'Libre GL', 'Timestamp', 'Dexcom GL'])) v(layout, columns))"""


@query("discover_files", f"""WITH {FILES}, {NAMES}
SELECT CAST(user_id AS VARCHAR) AS participant_id, month, array_to_string(columns, '|') AS columns FROM files JOIN names USING (layout)""")
def discover_files(spark, sf):
    """Every participant file with its header; files without the required columns are no candidates."""
    h = headers(spark, sf)
    return h.select(F.regexp_extract("path", ID, 1).alias("participant_id"), F.regexp_extract("path", "month=([^/]+)/", 1).alias("month"), F.array_join("columns", "|").alias("columns"))


@query("load_series_files", """SELECT CAST(user_id AS VARCHAR) AS participant_id, epoch_us(ts) AS us,
 CASE WHEN event_type IN ('view','click','error') THEN value END AS sensor_a,
 CASE WHEN user_id % 3 <> 1 AND event_type IN ('view','error') THEN value END AS sensor_b,
 CASE WHEN user_id % 3 <> 2 AND event_type = 'signup' THEN value END AS activity,
 CASE WHEN user_id % 3 <> 2 AND event_type = 'purchase' THEN CAST(event_id AS DOUBLE) END AS dose,
 CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'Lunch' END AS anchor_label,
 CASE WHEN event_type <> 'click' THEN CASE event_id % 3 WHEN 0 THEN 'half, "' || props || '"' || chr(10) || 'left' WHEN 1 THEN 'a 5" plate' ELSE props END END AS amount_consumed_raw,
 user_id % 3 <> 1 AS has_sensor_b,
 row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY md5(CAST(event_id AS VARCHAR))) AS place
FROM events""")
def load_series_files(spark, sf):
    """All rows of all files, with the place of each in its file."""
    s = load_series(spark, written_files(spark, sf), id_pattern=ID)
    month = F.date_format(F.timestamp_micros("us"), "yyyy-MM")
    return s.select("participant_id", "us", "sensor_a", "sensor_b", "activity", "dose", "anchor_label", "amount_consumed_raw", F.array_contains("columns_present", "Libre GL").alias("has_sensor_b"),
                    F.row_number().over(Window.partitionBy("participant_id", month).orderBy("row_order")).cast("bigint").alias("place"))


@query("schema_availability", f"""WITH {FILES}, {NAMES}
SELECT c AS column_name, count(*) AS n_files, count(*) = (SELECT count(*) FROM files) AS in_every_file, (SELECT count(*) FROM files) AS n_total
FROM (SELECT unnest(columns) AS c FROM files JOIN names USING (layout)) GROUP BY c""")
def schema_availability(spark, sf):
    return column_availability(headers(spark, sf))


@query("schema_column_sets", f"""WITH {FILES}, {NAMES}
SELECT count(*) AS n_files, CAST(CASE layout WHEN 0 THEN 7 WHEN 1 THEN 6 ELSE 5 END AS BIGINT) AS n_columns, CASE layout WHEN 0 THEN 'Carbs|Libre GL|METs' WHEN 1 THEN 'Carbs|METs' ELSE 'Libre GL' END AS columns_beyond_common
FROM files GROUP BY layout""")
def schema_column_sets(spark, sf):
    return column_sets(headers(spark, sf)).withColumn("columns_beyond_common", F.array_join("columns_beyond_common", "|"))
