"""Helpers that no registered query calls: round trips and failing audits on small frames."""

import pytest
from pyspark.sql import functions as F

from wardgrid.functions import clinical as cl
from wardgrid.operators import audits as au
from wardgrid.operators import profiling as pf
from wardgrid.operators import windows as win
from wardgrid.operators.targets import observed_only
from wardgrid.operators.timeline import GridSpec, Timeline


def test_min_max_goes_back(spark):
    df = spark.createDataFrame([(0.0,), (40.0,), (99.5,), (None,)], "v double")
    rows = df.select("v", cl.from_min_max(cl.min_max(F.col("v"), 30.0, 100.0), 30.0, 100.0).alias("back")).collect()
    assert all(r.back is None if r.v is None else r.back == pytest.approx(r.v, abs=1e-4) for r in rows)


def test_observed_only_blanks_carried_values(spark):
    spec = GridSpec()
    values = ", ".join(f"{i + 1}.0d AS {c}, {float(i % 2)}d AS mask_{c}" for i, c in enumerate(spec.channels))
    row = observed_only(Timeline(spark.sql(f"SELECT {values}"), spec)).df.first()
    assert [row[c] for c in spec.channels] == [i + 1.0 if i % 2 else None for i in range(len(spec.channels))]


def test_failed_audit_raises(spark):
    audit = spark.createDataFrame([("a", 0), ("b", 2)], "rule string, violations long")
    au.fail_on_violations(audit.where("rule = 'a'"))
    au.fail_on_violations(audit.limit(0))
    with pytest.raises(ValueError, match="'rule': 'b'"):
        au.fail_on_violations(audit)


def test_sample_values_skip_nulls(spark):
    df = spark.createDataFrame([(None,), (1,), (None,), (2,), (3,), (4,)], "v long")
    assert pf.sample_values(df.limit(0), "v").count() == 0
    got = [r.v for r in pf.sample_values(df, "v").collect()]
    assert len(got) == 3 and set(got) <= {"1", "2", "3", "4"}


def test_target_totals_count_subjects_once(spark):
    rows = [("train", 1, 10, 1, 1), ("train", 1, 11, 1, None), ("train", 2, 20, 0, 2), ("train", 2, 20, 0, 1), ("test", 3, 30, None, None)]
    df = spark.createDataFrame(rows, "split string, subject_id long, stay_id long, deterioration int, response int")
    got = {r.part: r[1:] for r in win.target_totals(df).collect()}
    assert got == {"train": (4, 2, 50.0, 2, 3, 1, 2, 2, 1), "test": (1, 0, 0.0, 1, 1, 0, 0, 0, 0),
                   "all": (5, 2, 40.0, 3, 4, 1, 2, 2, 1)}
    assert win.target_totals(df.limit(0)).count() == 0
