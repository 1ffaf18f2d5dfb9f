"""Sources and sinks: what is written to the shared folder is read back, with checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators import scoring as sc
from wardgrid.operators import splits as sp
from wardgrid.operators.scaling import Scaler
from wardgrid.plans import testmodel as tm
from wardgrid.plans.scoring_queries import SUMMARY_SQL, summary
from wardgrid.plans.testmodel import with_sql
from wardgrid.plans.timeline_queries import TARGETED, r6, windows
from wardgrid.session import shared_dir
from wardgrid.sources import files, sinks, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_tables(spark: SparkSession, d: str) -> str:
    """The core tables and readings as CSV below a new folder; readings lack a column, have another, and hold lines with text for a number."""
    root = _folder(spark, "export")
    _write_csv(tm.patients(spark, d), f"{root}/hosp/patients.csv")
    _write_csv(tm.export(tm.admissions(spark, d)), f"{root}/hosp/admissions.csv.gz")
    _write_csv(tm.export(tm.stays(spark, d)), f"{root}/icu/icustays.csv")
    _write_csv(spark.createDataFrame(sorted(fx.VITAL_ITEMS.items()), "itemid int, label string"), f"{root}/icu/d_items.csv")
    _write_csv(spark.createDataFrame(sorted(fx.LAB_ITEMS.items()), "itemid int, label string"), f"{root}/hosp/d_labitems.csv")
    number = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("about "), F.col("valuenum").cast("string"))).otherwise(F.col("valuenum").cast("string"))
    readings = tm.export(tm.observations(spark, d)).withColumn("valuenum", number).withColumnRenamed("event_id", "note").drop("valueuom")
    _write_csv(readings.select("subject_id", "stay_id", "hadm_id", "itemid", "charttime", "storetime", "value", "valuenum", "note"),
               f"{root}/icu/chartevents.csv")
    return root


_BAD = "event_id % 50 = 7 AND valuenum IS NOT NULL"


@query("csv_scan", with_sql("ev", "obs") + f"""
SELECT event_id::VARCHAR AS note, stay_id, itemid, round(valuenum, 6) AS valuenum, NULL::VARCHAR AS valueuom FROM obs WHERE NOT coalesce({_BAD}, false)""")
def csv_scan(spark, d):
    """Readings from a damaged file: lines with text for a number stay out, the missing column is NULL."""
    rows = tables.read_checked(spark, export_tables(spark, d), "icu/chartevents").rows
    return r6(rows.select("note", "stay_id", "itemid", "valuenum", "valueuom"), "valuenum")


@query("csv_quarantine", with_sql("ev", "obs") + f"""
SELECT event_id::VARCHAR AS note, itemid FROM obs WHERE {_BAD}""")
def csv_quarantine(spark, d):
    """The lines that did not fit, with the two values that tell them."""
    lines = tables.read_checked(spark, export_tables(spark, d), "icu/chartevents").quarantine
    part = F.split("line", ",")
    return lines.select(F.element_at(part, -1).alias("note"), part[3].cast("int").alias("itemid"))


@query("csv_drift", """
SELECT * FROM (VALUES ('chartevents', 'valueuom', 'missing'), ('chartevents', 'note', 'unexpected'), ('chartevents', 'hadm_id', 'moved'),
 ('chartevents', 'stay_id', 'moved')) t(table_name, column_name, state)
UNION ALL SELECT 'rows', 'patients', count(*)::VARCHAR FROM customer UNION ALL SELECT 'rows', 'admissions', count(DISTINCT user_id)::VARCHAR FROM events""")
def csv_drift(spark, d):
    """How the columns of the readings differ from what is expected, and the rows of two tables of the core bundle."""
    root = export_tables(spark, d)
    drift = tables.read_checked(spark, root, "icu/chartevents").drift.select(F.lit("chartevents").alias("table_name"), "column_name", "state")
    core = tables.read_core(spark, root)
    for name in ("patients", "admissions"):
        drift = drift.unionByName(core[name].agg(F.lit("rows").alias("table_name"), F.lit(name).alias("column_name"),
                                                 F.count(F.lit(1)).cast("string").alias("state")))
    return drift


@query("table_availability", """
SELECT 'export' AS dataset, t AS table_name, t IN ('hosp/patients.csv', 'icu/icustays.csv', 'icu/chartevents.csv') AS present, n > 0 AS has_bytes
FROM (SELECT unnest(['hosp/patients.csv', 'icu/icustays.csv', 'icu/chartevents.csv', 'icu/absent.csv']) AS t), (SELECT count(*) AS n FROM events)
WHERE t <> 'icu/absent.csv' UNION ALL SELECT 'export', 'icu/absent.csv', false, false""")
def table_availability(spark, d):
    """Files of the export by the table whose folder holds them."""
    root = export_tables(spark, d)
    found = files.listing(spark, root.removeprefix("file:").replace("///", "/"), "*.csv").withColumn(
        "path", F.regexp_extract("path", r"^(.*\.csv)/[^/]*$", 1)).groupBy("path").agg(F.sum("length").alias("length"))
    out = files.availability(spark, found, "export", ["hosp/patients.csv", "icu/icustays.csv", "icu/chartevents.csv", "icu/absent.csv"])
    return out.select("dataset", "table_name", "present", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("infusions_of_stays", with_sql("ev", "stays", "infusions") + """
SELECT event_id, i.stay_id, drug_name FROM infusions i WHERE stay_id IN (SELECT stay_id FROM stays WHERE first_careunit = 'CCU')""")
def infusions_of_stays(spark, d):
    keep = tm.stays(spark, d).where("first_careunit = 'CCU'")
    return tables.for_stays(tm.infusions(spark, d), keep).select("event_id", "stay_id", "drug_name")


@query("append_batches", """
WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem), a AS (SELECT DISTINCT * FROM l WHERE l_orderkey % 3 < 2), b AS (SELECT DISTINCT * FROM l WHERE l_orderkey % 3 > 0)
SELECT 1 AS step, (SELECT count(*) FROM a) AS added, (SELECT count(*) FROM a) AS total
UNION ALL SELECT 2, 0, (SELECT count(*) FROM a)
UNION ALL SELECT 3, (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), (SELECT count(*) FROM (SELECT DISTINCT * FROM l))
UNION ALL SELECT 4, 0, (SELECT count(*) FROM (SELECT DISTINCT * FROM l))""")
def append_batches(spark, d):
    """A batch, the same batch again, an overlapping one, and one without news, each with what it added and the rows then."""
    path, keys = _folder(spark, "appended"), ["l_orderkey", "l_linenumber"]
    lines = tm.load(spark, d, "lineitem").select(*keys, "l_quantity")
    steps = []
    for step, (batch, part) in enumerate([("a", "l_orderkey % 3 < 2"), ("a", "l_orderkey % 3 < 2"), ("b", "l_orderkey % 3 > 0"), ("c", "true")], 1):
        added = sinks.append_batch(lines.where(part), path, keys, batch, "l_quantity")
        steps.append((step, added, sinks.read_appended(spark, path).count()))
    return spark.createDataFrame(steps, "step int, added long, total long")


@query("window_shards", TARGETED + """
SELECT split, count(*) AS n, true AS sound FROM windows GROUP BY split""")
def window_shards(spark, d):
    """Windows written to seeded shards and checked against their manifest."""
    path = _folder(spark, "shards")
    rows = windows(spark, d).select("stay_id", "tick", "split", "forecast", "forecast_mask", "deterioration", "risk_tier")
    sinks.write_shards(rows, path, ["stay_id", "tick"], shards=4)
    return sinks.verify_shards(spark, path).groupBy("split").agg(F.sum("found").alias("n"), F.bool_and((F.col("bytes") > 0) & F.col("sound")).alias("sound"))


@query("report_sinks", """
WITH r AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT k AS kind, status, n FROM r, (SELECT unnest(['csv', 'json']) AS k)""")
def report_sinks(spark, d):
    """A report of one row for each order status, read back from both kinds of file."""
    root = _folder(spark, "reports")
    report = tm.load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_csv_report(report, f"{root}/csv")
    sinks.write_json_report(report.agg(F.collect_list(F.struct("status", "n")).alias("rows")), f"{root}/json")
    schema = "status string, n long"
    read = spark.read.schema(schema).option("header", True).csv(f"{root}/csv").withColumn("kind", F.lit("csv"))
    nested = spark.read.schema(f"rows array<struct<{schema.replace(' string', ':string').replace(' long', ':bigint')}>>").json(f"{root}/json")
    return read.unionByName(nested.select(F.inline("rows")).withColumn("kind", F.lit("json")))


@query("archive_file", """
SELECT c_custkey::VARCHAR AS "Patient ID", c_name AS "Name", (c_nationkey * 3 + 18)::VARCHAR AS "Age", NULL::VARCHAR AS "Disposition" FROM customer""")
def archive_file(spark, d):
    """Archive records with their printed column names, written as one file and read back."""
    path = _folder(spark, "archive")
    c = tm.load(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey * 3 + 18 AS age")
    sinks.write_csv_report(sinks.archive_export(c), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == list(sinks.ARCHIVE_COLUMNS.values())
    return back.select("Patient ID", "Name", "Age", "Disposition")


@query("scaler_file", """
SELECT channel, round(avg(x), 6) AS mean, round(CASE WHEN stddev_samp(x) > 1e-6 THEN stddev_samp(x) ELSE 1 END, 6) AS std, round(quantile_cont(x, 0.5), 6) AS median
FROM (SELECT 'quantity' AS channel, l_quantity::DOUBLE / 7 AS x FROM lineitem UNION ALL SELECT 'price', l_extendedprice::DOUBLE / 7 FROM lineitem
 UNION ALL SELECT 'flat', 3e0 FROM lineitem) GROUP BY channel""")
def scaler_file(spark, d):
    """Statistics of a fitted scaler after a round trip through its file."""
    path = _folder(spark, "scaler")
    rows = tm.load(spark, d, "lineitem").selectExpr("CAST(l_quantity AS DOUBLE) / 7 AS quantity", "CAST(l_extendedprice AS DOUBLE) / 7 AS price", "3D AS flat")
    Scaler.fit(rows, ["quantity", "price", "flat"]).save(spark, path)
    return Scaler.load(spark, path).to_table(spark)


@query("subset_test", """
SELECT 'orders in customers' AS name, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS subset
UNION ALL SELECT 'customers in orders', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def subset_test(spark, d):
    o = tm.load(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"))
    c = tm.load(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"))
    return spark.createDataFrame([("orders in customers", sp.is_subset(o, c)), ("customers in orders", sp.is_subset(c, o))], "name string, subset boolean")


@query("state_json", SUMMARY_SQL + """
SELECT patient_id, name, round(0.5e0 * risk_1h + 0.3e0 * risk_3h + 0.2e0 * risk_6h, 4) AS health_risk_score, news2_score,
 round(coalesce(heart_rate, 0) - 75, 2) AS hr, round(coalesce(spo2, 0) - 98, 2) AS spo2_deviation FROM summary""")
def state_json(spark, d):
    """The four states as JSON texts, read back by their paths."""
    s = summary(spark, d).withColumns({"active_anomalies": F.array().cast("array<string>"), "overrides": F.create_map().cast("map<string,double>")})
    j = sc.as_json(sc.patient_state(s))
    at = lambda c, path, kind: F.get_json_object(c, path).cast(kind)
    return j.select("patient_id", at("observed_state", "$.name", "string").alias("name"), at("predicted_state", "$.health_risk_score", "double").alias("health_risk_score"),
                    at("derived_state", "$.news2.total_score", "int").alias("news2_score"), at("derived_state", "$.baseline_deviations.heart_rate", "double").alias("hr"),
                    at("derived_state", "$.baseline_deviations.spo2", "double").alias("spo2_deviation"))
