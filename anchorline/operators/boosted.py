"""Population baseline: gradient-boosted trees over three past-only features, participant folds, additive contributions."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from math import ceil, inf, nextafter

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.events import ELIGIBILITY, FEATURES, OUTCOMES, RETAINED_RAW
from anchorline.operators.folds import N_FOLDS
from anchorline.session import checkpoint_dir, stage

BASELINE_FEATURES = ("carbs_g", "baseline_glucose", "activity_level")
FORBIDDEN = {*OUTCOMES, *ELIGIBILITY, *RETAINED_RAW, "participant_id", "event_id", "us", "label_raw", "label_norm", "grp", "label_exceeds_180"}
_SENTINEL = -1.0
#: Rows of a task in a pass over the training data.
PART = 100_000
#: Values that a tree tells apart in a feature, the sentinel among them.
BINS = 64


def check_features(features) -> None:
    """Features come from the past-only list; outcomes, eligibility, identifiers and groups are refused."""
    bad = [f for f in features if f in FORBIDDEN]
    unknown = [f for f in features if f not in FEATURES]
    if bad or unknown or len(set(features)) != len(features):
        raise ValueError(f"feature policy: forbidden {bad}, unknown {unknown}, or repeated columns")


def _vector(df: DataFrame) -> DataFrame:
    """A missing value is a sentinel plus an indicator, so a tree can split on missingness."""
    cols = {}
    for f in BASELINE_FEATURES:
        cols[f"__{f}"] = F.coalesce(F.col(f), F.lit(_SENTINEL))
        cols[f"__{f}_missing"] = F.col(f).isNull().cast("double")
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df.withColumns(cols)).drop(*cols)


def _levels(train: DataFrame) -> list[list[float]]:
    """The values that stand for all values of each feature: its own where they are few, else even quantiles of all rows."""
    few = train.agg(*[F.approx_count_distinct(f).alias(f) for f in BASELINE_FEATURES]).first()
    found = {f: [] for f in BASELINE_FEATURES}
    for f in BASELINE_FEATURES:
        if few[f] < 2 * BINS:  # the count is an estimate
            found[f] = [r[0] for r in train.select(F.col(f).cast("double")).where(F.col(f).isNotNull()).distinct().limit(BINS).collect()]
    wanted = [f for f in BASELINE_FEATURES if not 0 < len(found[f]) < BINS]
    if wanted:
        at = [i / (BINS - 2) for i in range(BINS - 1)]
        q = train.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in wanted]).first()
        found.update({f: q[f] or [] for f in wanted})
    return [sorted(set(found[f])) for f in BASELINE_FEATURES]


def cells(train: DataFrame) -> DataFrame:
    """(label, features, weight): every row at the nearest level of each feature, equal ones as one row with their number as its weight. There are at most
    2 * BINS ** 3, whatever the number of rows. Trees split half-way between levels, so a row is on the side of every split that its own values are on."""
    levels = _levels(train)
    ends = [[-inf, *[nextafter((a + b) / 2, inf) for a, b in zip(own, own[1:])], inf] for own in levels]  # a value on a split is on its lower side
    at = [f"__at_{f}" for f in BASELINE_FEATURES]
    cut = [e if len(e) > 2 else [-inf, 0.0, inf] for e in ends]  # fewer than two levels need no cut
    rows = train.select(F.col("label_exceeds_180").cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in BASELINE_FEATURES]).where("label IS NOT NULL")
    rows = Bucketizer(splitsArray=cut, inputCols=list(BASELINE_FEATURES), outputCols=at, handleInvalid="keep").transform(rows)
    seen = [F.when(F.col(f).isNotNull(), F.col(a) if len(e) > 2 else F.lit(0.0)).cast("int").alias(a) for f, a, e in zip(BASELINE_FEATURES, at, ends)]
    n = rows.select("label", *seen).groupBy("label", *at).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    back = [F.when(F.col(a).isNotNull(), F.element_at(F.array(*[F.lit(x) for x in own]), F.col(a) + 1)).alias(f) if own else F.lit(None).cast("double").alias(f) for f, a, own in zip(BASELINE_FEATURES, at, levels)]
    return n.select("label", *back, "weight")


def fit(train: DataFrame, trees: int = 100, depth: int = 3, step: float = 0.1, seed: int = 0) -> GBTClassificationModel:
    """The hundreds of passes of a fit go over the cells of the training rows, whose number is bounded. A pass has a task for every PART of them, and what a
    tree is grown on is cut off from the trees before it every ten trees."""
    check_features(BASELINE_FEATURES)
    held = stage(cells(train), "boosting-rows")
    n = held.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if n.lo is None or n.lo == n.hi:
        raise ValueError("both outcome classes are needed in the training data")
    spark = train.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{checkpoint_dir(spark)}/anchorline/boosting")
    data = _vector(held.coalesce(ceil(n.n / PART))).select("label", "features", "weight")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=BINS, weightCol="weight", checkpointInterval=10).fit(data)


def probability(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(_vector(df)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(events: DataFrame, folds: DataFrame, factory=None, k: int = N_FOLDS, trees: int = 100, held: tuple[str, ...] = ()) -> DataFrame:
    """`held` names more columns of the events that the result has. One prediction per event from a model that never saw the participant's fold. The k fits are independent jobs and are submitted together."""
    factory = factory or (lambda train: fit(train, trees))
    ev = stage(events.join(folds.select("participant_id", "fold"), "participant_id"), "folded-events")  # read several times by every fit

    def one(i: int) -> DataFrame:
        train = ev.where(F.col("fold") != i)
        prevalence = train.agg(F.avg("label_exceeds_180").alias("x")).first().x
        return probability(factory(train), ev.where(F.col("fold") == i)).withColumn("train_prevalence", F.lit(prevalence))
    with ThreadPoolExecutor(max_workers=k) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("participant_id", "event_id", "us", "fold", "grp", F.col("label_exceeds_180").alias("y"), "p", "train_prevalence", *held)


def _cuts(model: GBTClassificationModel) -> list[list[float]]:
    """The values each feature is split at in any tree; at most the model's bins."""
    found: list[set[float]] = [set() for _ in BASELINE_FEATURES]
    for index, value in re.findall(r"feature (\d+) <= ([-+0-9.eE]+)", model.toDebugString):
        if int(index) % 2 == 0:  # odd ones are the missing-value indicators
            found[int(index) // 2].add(float(value))
    return [sorted(c) for c in found]


def contributions(model: GBTClassificationModel, events: DataFrame, background: DataFrame) -> DataFrame:
    """Exact interventional Shapley values of the three features on the log-odds, against the whole background; a row sums to its log-odds.

    The trees see a value only through the interval between two split values that it lies in, so the background is one count per cell of intervals, and
    each of the 8 coalitions is evaluated once per cell: a table bounded by the model, whatever the number of rows. Events look their cells up."""
    from pyspark.ml.functions import vector_to_array
    cuts = _cuts(model)
    bins = [f"b{i}" for i in range(3)]

    def interval(f: str, cut: list[float]) -> Column:
        """How many split values lie below; -1 for a missing value."""
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cut]), lambda c: F.col(f) > c)) if cut else F.lit(0)
        return F.when(F.col(f).isNull(), -1).otherwise(below)

    def binned(df: DataFrame) -> DataFrame:
        at = [interval(f, cut).alias(b) for b, f, cut in zip(bins, BASELINE_FEATURES, cuts, strict=True)]
        return df.select(*[c for c in ("event_id",) if c in df.columns], *at)

    counts = stage(binned(background).groupBy(*bins).agg(F.count(F.lit(1)).alias("n")), "background")
    cells = None
    for mask in range(8):
        own = [i for i in range(3) if mask >> i & 1]
        part = counts.groupBy(*[bins[i] for i in range(3) if i not in own]).agg(F.sum("n").alias("n"))
        for i in own:
            part = part.withColumn(bins[i], F.explode(F.sequence(F.lit(-1), F.lit(len(cuts[i])))))
        part = part.select(F.lit(mask).alias("mask"), *bins, "n")
        cells = part if cells is None else cells.unionByName(part)
    # any value of an interval stands for it: its upper end, or one above the last
    inside = [F.array(*[F.lit(c) for c in (*cut, cut[-1] + 1.0 if cut else 0.0)]) for cut in cuts]
    values = cells.withColumns({f: F.when(F.col(b) >= 0, F.element_at(v, F.col(b) + 1)) for f, b, v in zip(BASELINE_FEATURES, bins, inside, strict=True)})
    margin = 2 * vector_to_array("rawPrediction")[1]
    key = ["mask", "k0", "k1", "k2"]
    in_mask = [F.when(F.expr(f"mask & {1 << i}") > 0, F.col(b)).otherwise(-2).alias(f"k{i}") for i, b in enumerate(bins)]
    mean = (model.transform(_vector(values)).select("mask", *in_mask, "n", margin.alias("margin"))
            .groupBy(*key).agg((F.sum(F.col("margin") * F.col("n")) / F.sum("n")).alias("v")))
    asked = binned(events).withColumn("mask", F.explode(F.array(*[F.lit(m) for m in range(8)]))).select("event_id", "mask", *in_mask)
    v = asked.join(stage(mean, "coalitions"), key).groupBy("event_id").agg(*[F.max(F.when(F.col("mask") == m, F.col("v"))).alias(f"v{m}") for m in range(8)])
    out = {}
    for i, f in enumerate(BASELINE_FEATURES):
        b = 1 << i
        j, k = [1 << q for q in range(3) if q != i]
        c = F.col
        out[f"contribution_{f}"] = ((c(f"v{b}") - c("v0")) / 3 + (c(f"v{b | j}") - c(f"v{j}")) / 6 + (c(f"v{b | k}") - c(f"v{k}")) / 6 + (c("v7") - c(f"v{j | k}")) / 3)
    return v.withColumns(out).select("event_id", *out, F.col("v0").alias("bias"), F.col("v7").alias("log_odds"))


def staged_out_of_fold(events: DataFrame, folds: DataFrame, trees: int = 100) -> DataFrame:
    return stage(out_of_fold(events, folds, trees=trees), "baseline-forecasts")
