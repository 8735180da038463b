"""Data-quality audits of files, anchors, photos, names and group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.labels import classify_a1c, id_number, name_tokens, parse_numeric, participant_number
from anchorline.functions.scale import adjacent_row, dense_ids
from anchorline.session import stage

K = ["participant_id"]
# fixed values
GAP_EDGES = (0, 1, 5, 15, 30, 60, 120, 240)
OFFSETS = (-60, -30, -15, 0, 15, 30, 45, 60, 90, 120, 150, 180)
MINUTE_EDGES = (0, 5, 10, 15, 20, 30, 45, 60, 90, 120, 240)
ID_NAME = r"(?i)(^|[^a-z])(id|subject|participant|patient|sub)([^a-z]|$)"


def steps(series: DataFrame, unit: int, slice_units: int = 10_000) -> DataFrame:
    """Each timed row with the step to the previous row in time, in units."""
    s = series.where(F.col("us").isNotNull()).withColumn("__s", F.floor(F.col("us") / (unit * slice_units)))
    return adjacent_row(s.select(*K, "us", "row_order", "__s"), K, "__s", ["us", "row_order"], [], "p").select(*K, "us", ((F.col("us") - F.col("p.us")) / unit).alias("step"))


def step_histogram(series: DataFrame, unit: int) -> DataFrame:
    s = steps(series, unit).where(F.col("step").isNotNull())
    return s.groupBy(F.floor("step").cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"))


def step_summary(series: DataFrame, unit: int) -> DataFrame:
    """Per participant: rows, span, repeated times, gaps longer than one unit."""
    return steps(series, unit).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"), ((F.max("us") - F.min("us")) / unit).alias("span"),
                                               F.count_if(F.col("step") == 0).alias("duplicates"), F.count_if(F.col("step") > 1).alias("gaps"), F.max("step").alias("longest_gap"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values (ties by value); Spark runs this as a distributed top-k."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def _bucket(v: Column, edges) -> Column:
    out = F.lit(0)
    for e in edges[1:]:
        out = out + (v >= e).cast("int")
    return out


def anchor_spacing(series: DataFrame, unit: int) -> DataFrame:
    """Gaps between consecutive anchors in fixed buckets, with exact repeats and pairs closer than 120 units."""
    s = steps(series.where(F.col("anchor_label").isNotNull()), unit).where(F.col("step").isNotNull())
    return s.groupBy(_bucket(F.col("step"), GAP_EDGES).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") == 0).alias("repeats"), F.count_if(F.col("step") < 120).alias("closer_than_120"))


def anchors_per_day(series: DataFrame) -> DataFrame:
    day = F.floor(F.col("us") / 86_400_000_000)
    d = series.where(F.col("anchor_label").isNotNull()).groupBy(*K, day.alias("day")).agg(F.count(F.lit(1)).alias("anchors"))
    return d.groupBy("anchors").agg(F.count(F.lit(1)).alias("participant_days"))


def hour_of_day(series: DataFrame, min_n: int = 20) -> DataFrame:
    """Hour-of-day quantiles per label with enough anchors. Minutes of a day are the values: at most 1,440 distinct per label."""
    h = (F.floor(F.col("us") / 60_000_000) % 1440) / 60
    g = series.where(F.col("anchor_label").isNotNull()).groupBy(F.lower(F.trim("anchor_label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(h, F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"))
    return g.where(F.col("n") >= min_n).select("label", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def macro_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    a = df.where(F.col("anchor_label").isNotNull())
    return a.agg(F.count(F.lit(1)).alias("n_anchors"), *[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c) == 0).alias(f"{c}_zero"), F.count_if(F.col(c) < 0).alias(f"{c}_negative"))])


def atwater_ratio(calories: str, carbs: str, protein: str, fat: str) -> Column:
    est = 4 * F.col(carbs) + 4 * F.col(protein) + 9 * F.col(fat)
    return F.when(est > 0, F.col(calories) / est)


def nearest_probe(series: DataFrame, value: str, unit: int, tolerance: int, offsets=OFFSETS) -> DataFrame:
    """Reading nearest to each anchor time plus offset within a tolerance; of two equally near the later wins.

    Targets and readings meet on (participant, time slot of the tolerance width), so a slot, not a participant, is the unit of work."""
    a = series.where(F.col("anchor_label").isNotNull()).select(*K, F.col("row_order").alias("anchor_row"), F.col("us").alias("t0"))
    t = a.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("target", F.col("t0") + F.col("offset").cast("bigint") * F.lit(unit))
    slot = lambda c: F.floor(c / tolerance).cast("bigint")
    t = t.withColumn("slot", F.explode(F.sequence(slot(F.col("target") - tolerance), slot(F.col("target") + tolerance))))
    v = series.where(F.col(value).isNotNull()).select(*K, "us", F.col(value).alias("v"), slot(F.col("us")).alias("slot"))
    hit = t.join(v, [*K, "slot"]).where(F.abs(F.col("us") - F.col("target")) <= tolerance)
    return hit.groupBy(*K, "anchor_row", "offset").agg(F.min(F.struct(F.abs(F.col("us") - F.col("target")).alias("d"), (-F.col("us")).alias("later"), "v")).alias("x")).select(
        *K, "anchor_row", "offset", F.col("x.v").alias("v"))


def probe_summary(probe: DataFrame, anchor: tuple[str, ...] = (*K, "anchor_row")) -> DataFrame:
    """Median change against offset 0 and the share of positive changes per offset. `anchor` names what makes two probes those of one anchor."""
    from anchorline.functions.scale import exact_quantiles
    base = probe.where(F.col("offset") == 0).select(*anchor, F.col("v").alias("v0"))
    d = stage(probe.join(base, list(anchor)).select("offset", (F.col("v") - F.col("v0")).alias("delta")), "deltas")
    g = d.groupBy("offset").agg(F.count("delta").alias("n"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"))
    return g.join(exact_quantiles(d, ["offset"], "delta", {"median_delta": 0.5}), "offset")


# ------------------------------------------------------------------ photos and names

def photo_pairs(rows: DataFrame, unit: int, slice_units: int = 10_000) -> DataFrame:
    """Each non-anchor photo with the last anchor before it, carried forward in time (no join of photos with anchors).

    rows: participant_id, us, row_order, is_anchor, is_photo. A photo at the anchor's own time is not a candidate of that anchor."""
    r = rows.withColumn("__s", F.floor(F.col("us") / (unit * slice_units)))
    a = r.where("is_anchor").select(*K, "us", F.lit(0).alias("kind"), F.col("row_order").alias("anchor_row"), "__s")
    p = r.where(F.col("is_photo") & ~F.col("is_anchor")).select(*K, F.col("us"), F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("anchor_row"), "__s")
    # photos sort before an anchor at the same time, so an equal time never counts as after it
    both = a.unionByName(p)
    from pyspark.sql import Window
    last = Window.partitionBy(*K, "__s").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    per = both.groupBy(*K, "__s").agg(F.max(F.when(F.col("kind") == 0, F.struct("us", "anchor_row"))).alias("__m"))
    carry = per.select(*K, "__s", F.last("__m", ignorenulls=True).over(Window.partitionBy(*K).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    x = both.join(carry, [*K, "__s"]).withColumn("anchor", F.coalesce(F.last(F.when(F.col("kind") == 0, F.struct("us", "anchor_row")), ignorenulls=True).over(last), F.col("__far")))
    return x.where(F.col("kind") == -1).select(*K, "us", F.col("anchor.anchor_row").alias("anchor_row"), ((F.col("us") - F.col("anchor.us")) / unit).alias("offset"))


def pairing_classes(rows: DataFrame, unit: int) -> DataFrame:
    """Per anchor: number of candidate photos, none / single / multiple, first and last offset, same-label next anchor."""
    cand = photo_pairs(rows, unit).where(F.col("anchor_row").isNotNull()).groupBy(*K, "anchor_row").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    a = rows.where("is_anchor").select(*K, "us", F.col("row_order").alias("anchor_row"), F.lower(F.trim("anchor_label")).alias("label"), "is_photo").withColumn("__s", F.floor(F.col("us") / (unit * 10_000)))
    a = adjacent_row(a, K, "__s", ["us", "anchor_row"], ["label"], "next", following=True)
    j = a.join(cand, [*K, "anchor_row"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select(*K, "anchor_row", F.col("n").alias("n_candidates"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").otherwise("multiple").alias("class"),
                    "first_offset", "last_offset", F.col("is_photo").alias("own_photo"), F.col("next").isNotNull().alias("has_next"),
                    F.coalesce(F.col("next.label") == F.col("label"), F.lit(False)).alias("next_same_label"), ((F.col("next.us") - F.col("us")) / unit).alias("next_gap"))


def minute_histogram(df: DataFrame, value: str, edges=MINUTE_EDGES) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(_bucket(F.col(value), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def token_report(names: DataFrame, k: int = 5) -> DataFrame:
    """Tokens used by at least k participants with their row counts; the rest only as one suppressed-token count. names: participant_id, name, role."""
    t = names.select(*K, "role", F.explode(name_tokens("name")).alias("token"))
    per = t.groupBy("token", *K).agg(F.count_if(F.col("role") == "anchor").alias("a"), F.count_if(F.col("role") != "anchor").alias("o"))
    g = per.groupBy("token").agg(F.count(F.lit(1)).alias("n_participants"), F.sum("a").alias("on_anchor_rows"), F.sum("o").alias("on_other_rows"))
    shown = g.where(F.col("n_participants") >= k)
    hidden = g.where(F.col("n_participants") < k).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("(suppressed tokens)").alias("token"), F.lit(None).cast("bigint").alias("n_participants"), F.col("n").alias("on_anchor_rows"), F.lit(0).cast("bigint").alias("on_other_rows"))
    return shown.unionByName(hidden)


# ------------------------------------------------------------------ group tables

def id_candidates(bio: DataFrame, participants: DataFrame) -> DataFrame:
    """For every identifier-looking column: rows, parsed, distinct, matched. Exactly one complete, unique, intersecting column may be used."""
    import re
    cols = [c for c in bio.columns if re.search(ID_NAME, c)]
    if not cols:
        return bio.sparkSession.createDataFrame([], "column_name string, n_rows bigint, n_parsed bigint, n_distinct bigint, n_matched bigint, usable boolean")
    nums = participants.select(participant_number("participant_id").alias("number")).distinct()
    long = bio.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), id_number(F.col(c), bio.schema[c].dataType).alias("number")) for c in cols])).alias("x")).select("x.*")
    hit = long.join(nums.withColumn("__hit", F.lit(1)), "number", "left")
    # two-step distinct: one row per (column, number), then counts
    per = hit.groupBy("column_name", "number").agg(F.count(F.lit(1)).alias("c"), F.max("__hit").alias("h"))
    g = per.groupBy("column_name").agg(F.sum("c").alias("n_rows"), F.sum(F.when(F.col("number").isNotNull(), F.col("c"))).alias("n_parsed"), F.count("number").alias("n_distinct"), F.count("h").alias("n_matched"))
    return g.withColumn("usable", (F.col("n_parsed") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_matched") > 0))


def link_groups(bio: DataFrame, participants: DataFrame, id_column: str, a1c_column: str) -> DataFrame:
    """participant -> group by identifier, never by position; missing rows and unparseable values keep their reason."""
    b = bio.select(id_number(F.col(id_column), bio.schema[id_column].dataType).alias("number"), parse_numeric(F.col(a1c_column).cast("string")).alias("a1c"), F.lit(True).alias("found"))
    p = participants.select("participant_id").distinct().withColumn("number", participant_number("participant_id"))
    j = p.join(b, "number", "left")
    return j.select("participant_id", classify_a1c("a1c").alias("grp"), F.when(F.col("number").isNull(), "no trailing number").when(F.col("found").isNull(), "no row in the group table").when(F.col("a1c").isNull(), "missing or unparseable").alias("problem"))


def checked_groups(bio: DataFrame, participants: DataFrame, a1c_column: str) -> DataFrame:
    """The refusing form of `link_groups`."""
    usable = [r["column_name"] for r in id_candidates(bio, participants).where("usable").limit(3).collect()]
    if len(usable) != 1:
        raise ValueError(f"need exactly one identifier column matching the participants; found {len(usable)}")
    g = link_groups(bio, participants, usable[0], a1c_column)
    bad = g.where(F.col("problem").isNotNull()).groupBy("problem").count().collect()
    if bad:
        raise ValueError(f"the groups cannot be linked: {[(r['problem'], r['count']) for r in bad]}")
    return g.drop("problem")


def positional_groups(bio: DataFrame, participants: DataFrame, bio_order: str) -> DataFrame:
    """Unverified row-by-row pairing, flagged as such; only for an audit of what such a mapping would claim."""
    b = dense_ids(bio.withColumn("__id", F.col(bio_order).cast("string")), "__id", "__i")
    p = dense_ids(participants.select("participant_id").distinct(), "participant_id", "__i")
    return p.join(b, "__i", "full_outer").withColumn("verified", F.lit(False))


def group_quality(bio: DataFrame, a1c_column: str, k_folds: int = 5) -> DataFrame:
    v = parse_numeric(F.col(a1c_column).cast("string"))
    raw = F.trim(F.col(a1c_column).cast("string"))
    b = bio.select(v.alias("v"), raw.alias("raw"), classify_a1c(v).alias("g"))
    num = F.regexp_extract("raw", r"^([0-9]+(?:\.[0-9]+)?)", 1)
    g = b.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v").isNotNull() & (num != F.col("raw"))).alias("annotated"),
              F.count_if(F.col("v") == 5.7).alias("exactly_5_7"), F.count_if(F.col("v") == 6.4).alias("exactly_6_4"),
              *[F.count_if(F.col("g") == x).alias(n) for x, n in (("healthy", "n_healthy"), ("pre-diabetes", "n_pre"), ("t2d", "n_t2d"))])
    return g.withColumn("folds_feasible", F.least("n_healthy", "n_pre", "n_t2d") >= k_folds)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ files and tables

def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, missing (NULL or empty), missing share, timestamp-like name and share parseable as a time, for every column in one aggregate."""
    columns = columns or df.columns
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(blank(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.avg(F.when(~blank(c), F.col(c).cast("string").try_cast("timestamp").isNotNull().cast("double"))).alias(f"t_{i}") for i, c in enumerate(columns)])
    types = dict(df.dtypes)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col(f"m_{i}").alias("n_missing"), F.lit(c).rlike("(?i)(time|date)").alias("time_like_name"),
                               F.when(F.lit(c).rlike("(?i)(time|date)"), F.col(f"t_{i}")).alias("parse_share")) for i, c in enumerate(columns)])
    return row.select("__n", F.explode(items).alias("x")).select("x.*", F.col("__n").alias("n_rows"), F.try_divide(F.col("x.n_missing"), F.col("__n")).alias("missing_share"))


def file_size_summary(files: DataFrame) -> DataFrame:
    """Row counts per file: total, extremes, nearest-rank median, short files, divisibility. files: path, n_rows.

    Nearest rank is the value at position int(p (n - 1) + 0.5), found through distinct counts, not by sorting the files in one task."""
    from anchorline.functions.scale import prefix_sums
    tot = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("total_rows"), F.min("n_rows").alias("rows_min"), F.max("n_rows").alias("rows_max"),
                    F.count_if(F.col("n_rows") < 14400).alias("short_files"), F.count_if(F.col("n_rows") % 5 == 0).alias("divisible_by_5"), F.count_if(F.col("n_rows") % 15 == 0).alias("divisible_by_15"))
    d = files.groupBy("n_rows").agg(F.count(F.lit(1)).alias("c")).withColumn("__b", F.floor(F.log2(F.col("n_rows") + 1) * 64))
    run = prefix_sums(d, [], "__b", ["n_rows"], {"upto": "c"}, totals=True)
    r = F.floor(0.5 * (F.col("upto_total") - 1) + 0.5)
    med = run.where((r < F.col("upto")) & (r >= F.col("upto") - F.col("c"))).select(F.col("n_rows").alias("rows_median"), F.lit(0).alias("__k"))
    return tot.withColumn("__k", F.lit(0)).join(med, "__k").drop("__k")


def extension_summary(files: DataFrame) -> DataFrame:
    from anchorline.functions.labels import extension, file_class
    return files.groupBy(extension("path").alias("ext"), file_class("path").alias("class")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def schema_report(files: DataFrame) -> DataFrame:
    """Distinct column sets with how many files have each. files: path, columns ARRAY<STRING>; the set is hashed, so the key stays short."""
    s = files.select("path", F.array_sort(F.array_distinct("columns")).alias("cols"))
    return s.groupBy("cols").agg(F.count(F.lit(1)).alias("n_files")).select(F.concat_ws(",", "cols").alias("columns"), "n_files")


def column_availability(files: DataFrame) -> DataFrame:
    n = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    return files.select(F.explode("columns").alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_files")).withColumn("in_all", F.col("n_files") == n)
