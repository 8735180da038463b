"""Delimited files read in splits, against a reader that takes each file whole."""

import csv
import io
import random

import pandas as pd
import pytest

from anchorline.session import stage
from anchorline.sources import files, records

HEADER = ["Timestamp", "Meal Type ", "Dexcom GL", "Amount Consumed"]
TEXTS = ["", "Lunch", "a,b", 'say "x"', "two\nlines", "\n", '"', '""', "NA", "5\" plate", "x\n\ny,\"z\"\n", "null", "é\n"]


def content(rng, n):
    """A file's text; quotes stand at field starts as written, and inside unquoted fields as themselves."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(HEADER)
    for i in range(n):
        w.writerow([f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.choice(TEXTS), rng.choice(["", "101.5", "x"]), rng.choice(TEXTS)])
        if rng.random() < 0.1:
            out.write("\n")
        if rng.random() < 0.1:
            out.write(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d},a 5\" plate,7,\n")
    return out.getvalue()


@pytest.mark.parametrize("size", [90, 700, 1 << 27])
def test_records_equal_those_of_a_whole_file_reader(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    for name in ("p1", "p 2", "p3"):
        (tmp_path / f"{name}.csv").write_text(content(rng, 120))
    (tmp_path / "p4.csv").write_text(",".join(HEADER) + "\n")
    (tmp_path / "other.csv").write_text('id,"note\n')
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def small_splits(df, label):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size) if label == "lines" else keep)
        try:
            return stage(df, label)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)

    monkeypatch.setattr(records, "stage", small_splits)
    got = files.load_series(spark, f"file://{tmp_path}").orderBy("participant_id", "row_order").collect()
    want = []
    for name in ("p 2", "p1", "p3"):
        d = pd.read_csv(tmp_path / f"{name}.csv")
        d.columns = [c.strip() for c in d.columns]
        number = pd.to_numeric(d["Dexcom GL"], errors="coerce")
        want += [(name, None if pd.isna(g) else g, None if pd.isna(m) else m, None if pd.isna(a) else a) for g, m, a in zip(number, d["Meal Type"], d["Amount Consumed"])]
    assert [(r.participant_id, r.sensor_a, r.anchor_label, r.amount_consumed_raw) for r in got] == want
    assert len({(r.participant_id, r.row_order) for r in got}) == len(got) and all(r.sensor_b is None and "Meal Type" in r.columns_present for r in got)


def test_a_file_that_ends_in_an_open_field_is_refused_by_name(spark, tmp_path):
    head = "Timestamp,Meal Type\n"
    (tmp_path / "good.csv").write_text(head + "2024-01-01,Lunch\n1/2/2024 7:05,Dinner\nnever,Snack\n")
    (tmp_path / "bad.csv").write_text(head + '2024-01-01,"Lunch\n2024-01-02,Dinner\n')
    root = f"file://{tmp_path}"
    rows = files.load_series(spark, root).orderBy("row_order").collect()
    assert [(r.participant_id, r.us is None, r.anchor_label) for r in rows] == [("good", False, "Lunch"), ("good", False, "Dinner"), ("good", True, "Snack")]
    assert [r.path.rsplit("/", 1)[1] for r in files.refused_files(spark, root).collect()] == ["bad.csv"]


def test_no_files_no_rows_and_quoted_headers(spark, tmp_path):
    assert files.load_series(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "a.csv").write_text('﻿Timestamp,"Meal\nType"," Meal Type ","x,y"\n2024-01-01,q,Lunch,1\n')
    (found,) = files.discover_participant_files(spark, f"file://{tmp_path}").collect()
    assert found.columns == ["Timestamp", "Meal\nType", "Meal Type", "x,y"]
    (row,) = files.load_series(spark, f"file://{tmp_path}").collect()
    assert (row.participant_id, row.anchor_label) == ("a", "Lunch")


def test_schema_reports(spark):
    h = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["c", "a"]), ("r", ["a", "c"])], "path string, columns array<string>")
    assert {r.column_name: (r.n_files, r.in_every_file, r.n_total) for r in files.column_availability(h).collect()} == {"a": (3, True, 3), "b": (1, False, 3), "c": (3, True, 3)}
    assert sorted((r.n_files, r.n_columns, r.columns_beyond_common) for r in files.column_sets(h).collect()) == [(1, 3, ["b"]), (2, 2, [])]
    assert files.column_availability(h.limit(0)).count() == 0 and files.column_sets(h.limit(0)).count() == 0


def test_split_states_are_composed_along_a_file(spark):
    """Splits that keep, swap, open and close the state, in one long run."""
    rng = random.Random(3)
    kinds = {"keep": (0, 1), "swap": (1, 0), "open": (1, 1), "close": (0, 0)}
    rows, state, want = [], 0, []
    for block in range(60):
        to = kinds[rng.choice(list(kinds))]
        want.append(state)
        state = to[state]
        rows.append(("f", block, block, "", block, block, *to))
    got = records.splits(stage(spark.createDataFrame(rows, records._LINE), "marks")).orderBy("block").collect()
    assert [r.inside for r in got] == want and {r.unclosed for r in got} == {state == 1}
    assert [r.carried for r in got] == [None, *range(59)]
