"""The models' evaluation, recomputed by SQL from the stored rows (y, p)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wardgrid.operators import models as mo
from wardgrid.session import store

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


def stored(monkeypatch, name, **options):
    """The rows that `models.<name>` gave to the query, filled when it runs."""
    kept, plain = {}, getattr(mo, name)

    def run(*args):
        kept["df"] = store(plain(*args, **options))
        return kept["df"]
    monkeypatch.setattr(mo, name, run)
    return kept


@needs_data
@pytest.mark.parametrize("name", ["logistic_report", "forest_report"])
def test_classifier_report(spark, monkeypatch, name):
    kept = stored(monkeypatch, "classify")
    got = entry.queries()[name](spark, SF).collect()
    rows = kept["df"].toPandas()
    want = duckdb.sql("""
        WITH r AS (SELECT deterioration AS y, score AS s FROM rows),
        k AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q,
                     count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND s >= 0.5) AS fp FROM r),
        u AS (SELECT avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auroc FROM r a JOIN r b ON a.y = 1 AND b.y <> 1),
        m AS (SELECT a.s, (SELECT count(*) FILTER (WHERE y = 1) / count(*) FROM r b WHERE b.s >= a.s) AS x FROM r a WHERE y = 1)
        SELECT p + q AS n, p AS positives, auroc, (SELECT avg(x) FROM m) AS average_precision, (tp + q - fp) / (p + q) AS accuracy,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall,
               CASE WHEN p + tp + fp > 0 THEN 2 * tp / (p + tp + fp) ELSE 0 END AS f1 FROM k, u""").df().iloc[0].to_dict()
    assert len(got) == 1 and len(rows) > 0
    assert {c: got[0][c] for c in want} == pytest.approx(want, abs=1e-9, nan_ok=True)


@needs_data
def test_forecast_report(spark, monkeypatch):
    kept = stored(monkeypatch, "forest_forecasts", channels=("heart_rate", "spo2"), steps=(1, 4), trees=5)
    got = {(r.channel, r.step): (r.n, r.mae, r.rmse, r.r2) for r in entry.queries()["forest_forecast_report"](spark, SF).collect()}
    rows = kept["df"].toPandas()
    want = duckdb.sql("""
        SELECT coalesce(channel, 'all'), step, count(*), avg(abs(p - y)), sqrt(avg((p - y) * (p - y))),
               CASE WHEN count(*) > 1 AND var_pop(y) > 1e-6 THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) ELSE 0 END
        FROM rows GROUP BY GROUPING SETS ((channel, step), (step))""").fetchall()
    assert len(want) == len(got) == 6
    for channel, step, *figures in want:
        assert got[channel, step] == pytest.approx(tuple(figures), rel=1e-6)
