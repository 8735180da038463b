"""Plans that keep a hot key, or one global ordering, out of a single task.

A window without a partition, or over a participant holding a third of all rows, runs in one task. The helpers here split such an
ordering into slices by an order-preserving bucket, summarise each slice, carry the (small, bounded) slice totals forward, and finish
inside the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.session import stage


#: Metadata of a slice column that has one slice a key.
UNCUT = "anchorline.uncut"


def _dummy(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], bool]:
    if keys:
        return df, keys, False
    return df.withColumn("__all", F.lit(0)), ["__all"], True


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list, sums: dict[str, str], inclusive: bool = True,
                totals: bool | list[str] = False, extremes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Running sums over (bucket, order) within `keys`, two-level. `sums` maps output column -> input column.

    With `totals`, the whole-key sum of each output (or of those listed) is added as `<output>_total`. `extremes` maps an output to (column, "max" or "min")
    for running maxima and minima carried the same way. Where `equi_depth` found no key to cut, a key is one slice and nothing is carried: one exchange by key
    instead of three."""
    pick = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    extremes = extremes or {}
    wanted = [o for o in sums if totals is True or totals and o in totals]
    uncut = df.schema[bucket].metadata.get(UNCUT, False)
    df, keys, drop = _dummy(df, keys)
    if uncut:
        whole = Window.partitionBy(*keys)
        local = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).withColumns({
            **{o: F.coalesce(F.sum(c).over(local), F.lit(0)) for o, c in sums.items()}, **{o: pick[how][0](c).over(local) for o, (c, how) in extremes.items()},
            **{f"{o}_total": F.sum(sums[o]).over(whole) for o in wanted}})
        return out.drop("__all") if drop else out
    slices = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()], *[pick[how][0](c).alias(f"__t_{o}") for o, (c, how) in extremes.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"__t_{o}").over(Window.partitionBy(*keys)).alias(f"{o}_total") for o in wanted]
    offsets = slices.select(*keys, bucket, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums],
                             *[pick[how][0](f"__t_{o}").over(before).alias(f"__o_{o}") for o, (_, how) in extremes.items()], *whole)
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(offsets, [*keys, bucket])
    for o, c in sums.items():
        out = out.withColumn(o, F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"__o_{o}"))
    for o, (c, how) in extremes.items():
        one, two = pick[how]
        out = out.withColumn(o, two(one(c).over(local), F.col(f"__o_{o}")))
    out = out.drop(*[f"__o_{o}" for o in [*sums, *extremes]])
    return out.drop("__all") if drop else out


#: Rows of a slice that `equi_depth` aims at, and the most slices of one key.
DEPTH, MOST_SLICES = 20_000, 1024


def one_slice(df: DataFrame, keys: list[str], out: str, depth: int | None = None, value: str | None = None) -> DataFrame | None:
    """df with `out`, one slice a key, if no key has more than `depth` rows (of a value that is not null); else None."""
    n = F.count(value or F.lit(1)).alias("__n")
    if df.groupBy(*keys).agg(n).where(F.col("__n") > (depth or DEPTH)).limit(1).count():
        return None
    return df.withColumn(out, F.lit(0)).withMetadata(out, {UNCUT: True})


def equi_depth(df: DataFrame, keys: list[str], value: str, out: str, depth: int | None = None, most: int = MOST_SLICES) -> DataFrame:
    """df with `out`, a slice number that rises with `value` within `keys` and cuts a key's rows evenly, whatever the spread of its values.

    Keys of at most `depth` rows are one slice. The others get boundaries from a mergeable quantile sketch, as many as their rows need. A value that fills
    more than a slice has an odd number and the slice to itself; it is never cut, so equal values always meet. Null values are in the first slice."""
    src, keys, drop = _dummy(df, keys)
    depth = depth or DEPTH
    row = one_slice(src, keys, out, depth, value)
    if row is not None:  # the usual table: no key needs cutting, and no plan carries the boundaries
        return row.drop("__all") if drop else row
    large = src.groupBy(*keys).agg(F.count(value).alias("__ed_n")).where(F.col("__ed_n") > depth)
    sketch = F.percentile_approx(value, [i / most for i in range(1, most)], 10 * most)
    wanted = F.least(F.ceil(F.col("__ed_n") / depth), F.lit(most))
    # every most / wanted-th boundary; one that comes twice holds a whole slice
    bounds = (src.join(large, keys, "left_semi").groupBy(*keys).agg(sketch.alias("__ed_q")).join(large, keys)
              .withColumn("__ed_q", F.transform(F.sequence(F.lit(1), (wanted - 1).cast("int")), lambda i: F.element_at("__ed_q", F.greatest(F.lit(1), F.round(i * most / wanted).cast("int")))))
              .withColumn("__ed_b", F.array_distinct("__ed_q"))
              .withColumn("__ed_h", F.transform("__ed_b", lambda b: F.size(F.filter("__ed_q", lambda x: x == b)) > 1))
              .withColumn("__ed_c", F.filter("__ed_b", lambda b, i: i % 32 == 31)).select(*keys, "__ed_b", "__ed_h", "__ed_c"))
    below = lambda bounds_: F.size(F.filter(bounds_, lambda b: b < F.col(value)))
    bounds = stage(bounds, "bounds")  # a sketch depends on the order its rows come in; read from a file, every use of the slices has the same ones
    coarse = below("__ed_c") * 32
    row = src.join(bounds, keys, "left").withColumn("__ed_i", coarse).withColumn("__ed_i", F.col("__ed_i") + below(F.slice("__ed_b", F.col("__ed_i") + 1, 32)))
    alone = F.coalesce((F.get("__ed_b", F.col("__ed_i")) == F.col(value)) & F.get("__ed_h", F.col("__ed_i")), F.lit(False))
    row = row.withColumn(out, F.coalesce(F.when(F.col("__ed_b").isNotNull() & F.col(value).isNotNull(), 2 * F.col("__ed_i") + alone.cast("int")), F.lit(0)).cast("int")).drop("__ed_b", "__ed_h", "__ed_c", "__ed_i")
    return row.drop("__all") if drop else row


def time_slices(df: DataFrame, keys: list[str], value: str, out: str, width: int | None = None) -> DataFrame:
    """Even slices of each key's rows by time, or slices of a fixed width where one is given."""
    return df.withColumn(out, F.floor(F.col(value) / width)) if width else equi_depth(df, keys, value, out)


def dense_ids(df: DataFrame, id_col: str, out: str, total: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Zero-based dense numbering of distinct ids in (md5(id), id) order without one global sort: 4096 hash slices plus slice offsets.

    The order is the same in any engine that has md5, and a slice never grows hot because the ids are distinct."""
    keys = keys or []
    base = df.withColumn("__h", F.md5(F.col(id_col).cast("string")))
    if keys and not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > DEPTH).limit(1).count():  # no key is hot
        w = Window.partitionBy(*keys)
        res = base.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).withColumn(out, (F.row_number().over(w.orderBy("__h", id_col)) - 1).cast("bigint"))
        return (res.withColumn(total, F.count(F.lit(1)).over(w)) if total else res).drop("__h")
    base = base.withColumn("__b", F.substring("__h", 1, 3))
    base, keys, drop = _dummy(base, keys)
    counts = base.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b")
    offs = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
                         F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"))
    local = Window.partitionBy(*keys, "__b").orderBy("__h", id_col)
    res = base.join(offs, [*keys, "__b"]).withColumn(out, (F.row_number().over(local) - 1 + F.col("__o")).cast("bigint"))
    if total:
        res = res.withColumn(total, F.col("__total").cast("bigint"))
    res = res.drop("__h", "__b", "__o", "__total")
    return res.drop("__all") if drop else res


def prob_bucket(p) -> Column:
    """Order-preserving bucket of a probability, fine near 0 and 1: 256 slices per halving of the distance to the nearer end."""
    p = F.col(p) if isinstance(p, str) else p
    lo = F.floor(F.log2(F.greatest(p, F.lit(1e-300))) * 256)
    hi = -F.floor(F.log2(F.greatest(1 - p, F.lit(1e-300))) * 256)
    return F.when(p <= 0.5, lo).otherwise(hi).cast("int")


def _lerp(a: Column, z: Column, f: Column) -> Column:
    """The two branches of numpy's lerp, so equal inputs give equal bits."""
    return F.when(f < 0.5, a + (z - a) * f).otherwise(z - (z - a) * (1 - f))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], slices: int = MOST_SLICES, depth: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key (the numpy default), one row per key, one column per entry of `probs`.

    Distinct values are counted first, cut into even slices (an outlier widens none), and only the slices that hold a wanted rank are ordered."""
    src, keys, drop = _dummy(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), keys)
    dist = src.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    binned = equi_depth(dist, keys, "__v", "__s", depth, slices)
    if binned.schema["__s"].metadata.get(UNCUT, False):  # all values of a key meet in one window, and the wanted ones are picked there
        w = Window.partitionBy(*keys)
        run = dist.withColumns({"__upto": F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(w)})
        at = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
        rank = lambda q, side: F.least(F.floor(at(q)) + side, F.col("__n") - 1)
        here = lambda r: F.max(F.when((r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")), F.col("__v")))
        picked = run.groupBy(*keys).agg(*[x for i, q in enumerate(probs.values()) for x in (here(rank(q, 0)).alias(f"__a{i}"), here(rank(q, 1)).alias(f"__z{i}"), F.max(at(q) - F.floor(at(q))).alias(f"__f{i}"))])
        out = picked.select(*keys, *[_lerp(F.col(f"__a{i}"), F.col(f"__z{i}"), F.col(f"__f{i}")).alias(n) for i, n in enumerate(probs)])
        return out.drop("__all") if drop else out
    hist = binned.groupBy(*keys, "__s").agg(F.sum("__c").alias("__m"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumn("__before", F.coalesce(F.sum("__m").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__m").over(w))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.lit(side).alias("side"))
                      for name, q in probs.items() for side in (0, 1)])
    pos = F.col("__w.q") * (F.col("__n") - 1)
    want = (hist.withColumn("__w", F.explode(ranks))
            .withColumn("__r", F.least(F.floor(pos) + F.col("__w.side"), F.col("__n") - 1))
            .where((F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__m")))
            .select(*keys, "__s", "__before", "__r", F.col("__w.name").alias("__name"), F.col("__w.side").alias("__side"),
                    (pos - F.floor(pos)).alias("__f")))
    local = Window.partitionBy(*keys, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    needed = want.select(*keys, "__s").distinct()
    ordered = (binned.join(needed, [*keys, "__s"], "left_semi").withColumn("__upto", F.sum("__c").over(local))
               .select(*keys, "__s", "__v", "__c", "__upto"))
    hit = (want.join(ordered, [*keys, "__s"])
           .where((F.col("__r") - F.col("__before") < F.col("__upto")) & (F.col("__r") - F.col("__before") >= F.col("__upto") - F.col("__c"))))
    sides = hit.groupBy(*keys, "__name").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__a"),
                                             F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__z"), F.max("__f").alias("__f"))
    out = sides.withColumn("__q", _lerp(F.col("__a"), F.col("__z"), F.col("__f"))).groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in probs])
    return out.drop("__all") if drop else out


def _steps(levels: int | Column) -> Column:
    return F.sequence(F.lit(0), (F.lit(levels) if isinstance(levels, int) else levels) - 1)


def dyadic_nodes(value: Column, levels: int | Column) -> Column:
    """The `levels` aligned power-of-two intervals that contain an integer, as an array of struct(level, node)."""
    return F.transform(_steps(levels),
                       lambda j: F.struct(j.alias("level"), F.call_function("shiftright", value, j).alias("node")))


def dyadic_cover(lo: Column, hi: Column, levels: int | Column) -> Column:
    """The aligned power-of-two intervals that exactly tile [lo, hi]: at most two per level.

    Joining points to tiles on equality answers a range condition without ever pairing the rows of a group."""
    steps = _steps(levels)

    def at(j: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        left = F.call_function("shiftright", lo + one - 1, j)
        right = F.call_function("shiftright", hi + 1, j)
        live = left < right
        return F.array(F.struct(j.alias("level"), F.when(live & (left % 2 == 1), left).alias("node")),
                       F.struct(j.alias("level"), F.when(live & (right % 2 == 1), right - 1).alias("node")))
    return F.filter(F.flatten(F.transform(steps, at)), lambda s: s["node"].isNotNull())


def adjacent_row(df: DataFrame, keys: list[str], slice_col: str, order: list[str], fields: list[str], out: str, following: bool = False) -> DataFrame:
    """Previous (or following) row's order columns and fields as a struct `out`, two-level over slices: lag inside the slice, and at a slice
    edge the nearest row of the nearest earlier (later) slice."""
    row = F.struct(*order, *fields)
    edge = (F.min(row) if following else F.max(row)).alias("__edge")
    w = Window.partitionBy(*keys).orderBy(slice_col)
    per = df.groupBy(*keys, slice_col).agg(edge)
    per = per.select(*keys, slice_col, (F.lead("__edge") if following else F.lag("__edge")).over(w).alias("__far"))
    local = Window.partitionBy(*keys, slice_col).orderBy(*order)
    near = (F.lead(row) if following else F.lag(row)).over(local)
    return df.join(per, [*keys, slice_col]).withColumn(out, F.coalesce(near, F.col("__far"))).drop("__far")
