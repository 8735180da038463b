import json
import time

import pytest
from pyspark.sql import functions as F

from anchorline.operators import events as ev
from anchorline.operators import folds as fo
from anchorline.operators import priors as pr
from anchorline.operators import sequential as sq
from anchorline.session import stage
from anchorline.sources import files, sinks
from anchorline.spec import DAY, MINUTE, WindowSpec
from anchorline.streaming import pipelines as st
from helpers import COHORT, T0, cohort_rows


def write_tree(root):
    import datetime as dt
    start = dt.datetime(2024, 1, 1)

    def rows(cols, n=600, meal=300):
        out = [",".join(cols)]
        for i in range(n):
            v = {"Timestamp": str(start + dt.timedelta(minutes=i)), "Dexcom GL": 100 + i % 7, "Libre GL": 90 + i % 5, "METs": 1.5, "Meal Type": "Lunch" if i == meal else "", "Carbs": 40 if i == meal else "", "Amount Consumed": ""}
            out.append(",".join(str(v[c.strip()]) for c in cols))
        return "\n".join(out) + "\n"
    (root / "P-001").mkdir()
    (root / "P-001" / "P-001.csv").write_text(rows(["Timestamp", "Dexcom GL", "Libre GL", "METs", "Meal Type", "Carbs", "Amount Consumed "]))
    (root / "P-002.csv").write_text(rows(["Timestamp", "Libre GL", "METs", "Meal Type", "Carbs"]))
    (root / "bio.csv").write_text("subject,A1c\n1,5.4\n")
    (root / "README.md").write_text("about")
    (root / ".git").mkdir()
    (root / ".git" / "config").write_text("x")


def test_csv_tree_to_event_table(spark, tmp_path):
    write_tree(tmp_path)
    root = f"file://{tmp_path}"
    scan = files.scan_directory(spark, root)
    assert scan.count() == 4 and {r["class"]: r.n for r in scan.groupBy("class").agg(F.count("*").alias("n")).collect()} == {"tabular": 3, "doc": 1}
    found = files.discover_participant_files(spark, root)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["P-001.csv", "P-002.csv"]
    s = files.load_series(spark, root)
    assert s.count() == 1200 and s.where("anchor_label is not null").count() == 2
    spec = WindowSpec(channel="sensor_a", chunk=DAY)
    flagged = files.with_channel_flag(s, "Dexcom GL")
    (e,) = ev.event_table(flagged, spec).collect()
    assert e.participant_id == "P-001" and e.carbs_g == 40 and e.baseline_age == 5 and e.peak_glucose == 106
    (x,) = ev.exclusion_log(flagged, spec).collect()
    assert x.participant_id == "P-002" and x.reason == "cgm_channel_missing"
    sinks.write_event_table(ev.event_table(flagged, spec), str(tmp_path / "out"), spec, "r1")
    row = spark.read.json(str(tmp_path / "out" / "settings")).first()
    assert row.n_rows == 1 and json.loads(row.settings)["window"] == spec.window
    audit = files.dataset_audit(spark, root)
    assert audit["documents"].count() >= 1


def test_prior_artifact_round_trip_and_refusals(spark, tmp_path):
    e = stage(spark.createDataFrame(cohort_rows(), COHORT), "test-events")
    path = str(tmp_path / "prior")
    sinks.export_prior(e, path, ["p01"])
    r = files.read_priors(spark, path).first()
    assert r.rejected is None and r.provenance.excluded_participants_count == 1
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_prior(e, path, ["p01"])
    with pytest.raises(ValueError):
        sinks.export_prior(e, str(tmp_path / "other"), ["nobody"])
    good = json.loads(next((tmp_path / "prior").glob("*.json")).read_text())
    cases = {"unknown format": {"format": "x"}, "must declare no participant-level data": {"contains_participant_level_data": True}, "unexpected keys": {"rows": [1]},
             "covariance is not positive definite": {"model_c": {**good["model_c"], "v_bb": -1.0}}, "prior must be un-centred": {"model_c": {**good["model_c"], "center": 1.0}},
             "covariance is not symmetric": {"model_c": {**good["model_c"], "v_gb": 5.0}}, "provenance is incomplete": {"provenance": {"prior_scheme": "x"}}, "noise variance must be positive": {"model_b": {**good["model_b"], "noise": 0.0}}}
    bad = tmp_path / "bad"
    bad.mkdir()
    for i, change in enumerate(cases.values()):
        (bad / f"c{i}.json").write_text(json.dumps({**good, **change}))
    got = {r.file_name: r.rejected for r in files.read_priors(spark, str(bad)).collect()}
    assert [got[f"c{i}.json"] for i in range(len(cases))] == list(cases)


def feed(spark, df, path, bounds, t="us"):
    """Write time slices one after another, so the file source takes them in order, one per micro-batch."""
    for i, (a, b) in enumerate(bounds):
        df.where((F.col(t) >= a) & (F.col(t) < b)).coalesce(1).write.parquet(f"{path}/part{i}")
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def test_personalise_in_micro_batches_equals_batch(spark, tmp_path):
    st.use_rocksdb(spark)
    e = stage(spark.createDataFrame(cohort_rows(n_people=6, n_events=8, gap_hours=1), COHORT), "test-events")
    folds = stage(fo.participant_folds(e, k=2), "test-folds")
    prior = stage(pr.fold_priors(e, folds, "C", k=2), "test-priors")
    ex = e.join(folds.select("participant_id", "fold"), "participant_id").withColumn("excluded_reason", F.when(F.col("event_id").endswith("m002"), "gap"))
    hour = 3_600_000_000
    src = feed(spark, ex, str(tmp_path / "in"), [(0, T0 + 3 * hour), (T0 + 3 * hour, T0 + 6 * hour), (T0 + 6 * hour, 1 << 62)])
    out = st.personalise(src.join(prior.drop("source", "train_prevalence"), "fold"))
    st.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    learned = sq.learned_before(e.withColumn("excluded_reason", F.lit(None)), evidence=~F.col("event_id").endswith("m002")).join(folds.select("participant_id", "fold"), "participant_id")
    want = {r.event_id: r for r in sq.forecasts(learned, prior, "C", ["fold"]).collect()}
    seen = [r for r in got if r.kind == "forecast"]
    assert len(seen) == len(want) == 48
    for r in seen:
        assert r.version == want[r.event_id].n_personal_before and r.mean_rise == pytest.approx(want[r.event_id].mean_rise) and r.pred_std == pytest.approx(want[r.event_id].pred_std)
    assert {r.event_id for r in got if r.kind == "excluded"} == {f"p{p:02d}-m002" for p in range(6)}
    done = [r.event_id for r in got if r.kind == "reconciled"]
    assert len(done) == len(set(done)) and len(done) > 20


def test_sessions_mark_isolation(spark, tmp_path):
    minutes = [0, 119, 239, 500, 2000]
    df = spark.createDataFrame([("p", T0 + m * MINUTE) for m in minutes], "participant_id string, us long").withColumn("ts", F.timestamp_micros("us"))
    out = st.overlap_sessions(feed(spark, df, str(tmp_path / "in"), [(0, 1 << 62)]))
    st.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.first, r.n_anchors) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [n for _, n in got] == [2, 1, 1]  # 239 is exactly 120 after 119: isolated; the last session is still open


def test_replayed_batches_change_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(20)], "x long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for state in ("s1", "s2"):
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        st.idempotent_batches(src, str(tmp_path / "out"), str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_duplicate_requests_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([("p", "e1", T0), ("p", "e1", T0 + 5), ("p", "e2", T0)], "participant_id string, event_id string, us long").withColumn("ts", F.timestamp_micros("us"))
    out = st.first_requests(feed(spark, df, str(tmp_path / "in"), [(0, 1 << 62)]))
    st.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e1", "e2"]


def test_header_of_any_length_and_with_quotes(tmp_path):
    import pandas as pd

    from anchorline.sources.files import _headers
    wide = ",".join(["Timestamp", "Meal Type", '"a, quoted name"', *[f"column number {i}" for i in range(9000)]])
    (tmp_path / "wide.csv").write_text(wide + "\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    got = next(_headers(iter([pd.DataFrame({"path": [f"file://{tmp_path}/wide.csv", f"file://{tmp_path}/empty.csv"]})])))
    assert got["columns"][0][:3] == ["Timestamp", "Meal Type", "a, quoted name"] and len(got["columns"][0]) == 9003 and got["columns"][1] is None


def test_a_participant_has_one_timer_for_its_first_open_window():
    import pandas as pd

    class State:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        put = update = lambda self, v: setattr(self, "held", v)
        clear = lambda self: setattr(self, "held", None)

    class Handle:
        timers: list = []
        getValueState = getListState = lambda self, *a: State()  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    who = st.Personaliser(window_us=10_000_000)
    who.init(Handle())
    rows = pd.DataFrame([(f"e{i}", i * 4_000_000, 30.0, 1.0, 20.0, None, 1.0, 0.0, 1.0, 1.0, 0.0, 4.0) for i in range(20)],
                        columns=["event_id", "us", "carbs_g", "activity_level", "peak_glucose_rise", "excluded_reason", "v_bb", "v_bg", "v_gg", "m_b", "m_g", "noise"])
    first = pd.concat(list(who.handleInputRows(("p",), iter([rows]), At(0))))
    assert Handle.timers == [78_001]  # the windows of e17, e18, e19 are open after the last row, at 76 s
    later = pd.concat(list(who.handleExpiredTimer(("p",), At(83_000), At(78_001))))
    assert later.event_id.tolist() == ["e17", "e18"] and Handle.timers == [78_001, 86_001] and (first.kind == "forecast").sum() == 20


def test_series_files_are_written_whole_in_order_by_their_tasks(spark, tmp_path):
    texts = ["plain", 'half, "quoted"\nleft', None, 'a 5" plate', "", "Ünïcode", "x" * 3000]
    rows = [(who, month, (i * 7) % 50, f"2024-01-01 00:{i:02d}:00", "Lunch" if i == 3 else None, texts[(i + len(who)) % 7]) for who in ("p/1", "p2", "p 3") for month in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "who string, month string, place int, Timestamp string, `Meal Type` string, `Amount Consumed ` string")
    root = f"{tmp_path}/in"
    old, sinks.HELD = sinks.HELD, 2000
    try:
        assert sinks.write_series(df, root, ["who", "month"], ["Timestamp", "Meal Type", "Amount Consumed "], "place") == 6
    finally:
        sinks.HELD = old
    assert sorted(p.name for p in (tmp_path / "in").rglob("*") if p.is_file()) == ["series.csv"] * 6 and (tmp_path / "in" / "who=p%2F1").is_dir()
    got = files.load_series(spark, root, id_pattern="who=([^/]+)/month=([^/]+)/").orderBy("row_order").collect()
    for who, name in (("p/1", "p%2F1"), ("p2", "p2"), ("p 3", "p%203")):
        want = [(r[4], r[5] or None) for r in sorted(r for r in rows if r[0] == who and r[1] == "a")]
        mine = [(r.anchor_label, r.amount_consumed_raw) for r in got if r.participant_id == name]
        assert len(mine) == 100 and sorted(mine, key=str) == sorted(want * 2, key=str)
    one = files.load_series(spark, f"{root}/who=p2/month=a").orderBy("row_order").collect()
    assert [(r.anchor_label, r.amount_consumed_raw) for r in one] == [(r[4], r[5] or None) for r in sorted(r for r in rows if r[:2] == ("p2", "a"))]


def test_many_small_files_take_few_tasks(spark, tmp_path, monkeypatch):
    from anchorline import session
    from anchorline.sources import records
    for i in range(120):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "s.csv").write_text("Timestamp,Meal Type\n2024-01-01,Lunch\n")
    monkeypatch.setattr(records, "TASKS", 2)
    assert records.lines(spark, str(tmp_path)).rdd.getNumPartitions() <= 4  # what the session shuffles to
    name, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    own = spark.conf.get(name)
    session.listed(spark, lambda: seen.append(int(spark.conf.get(name))))
    with pytest.raises(ZeroDivisionError):
        session.listed(spark, lambda: 1 / 0)
    assert seen == [session.LISTERS] and spark.conf.get(name) == own
    assert files.load_series(spark, str(tmp_path)).count() == 120


def test_a_stream_step_asks_for_state_three_times_and_gives_rows():
    """Calls for state and Arrow batches of one participant each are what a stream of many participants costs."""
    from pyspark.sql import Row
    calls = []

    class State:
        held = None
        get = lambda self: calls.append("get") or self.held
        exists = lambda self: calls.append("exists") or self.held is not None
        put = update = lambda self, v: calls.append("update") or setattr(self, "held", v)
        clear = lambda self: calls.append("clear")

    class Handle:
        getValueState = getListState = lambda self, *a: State()  # noqa: E731, N815
        registerTimer = lambda self, ms: calls.append("timer")  # noqa: E731, N815

    who = st.RowPersonaliser(window_us=10_000_000)
    who.init(Handle())
    rows = [Row(event_id=f"e{i}", us=i * 4_000_000, carbs_g=30.0, activity_level=1.0, peak_glucose_rise=None if i == 3 else 20.0, excluded_reason=None, v_bb=1.0, v_bg=0.0, v_gg=1.0, m_b=1.0, m_g=0.0, noise=4.0) for i in range(8)]
    got = list(who.handleInputRows(("p",), iter(rows[::-1]), None))
    assert calls == ["get", "update", "timer"] or calls == ["get", "timer", "update"]
    assert [r.event_id for r in got if r.kind == "forecast"] == [f"e{i}" for i in range(8)] and [r.event_id for r in got if r.kind == "excluded"] == ["e3"]
