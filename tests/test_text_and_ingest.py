import gzip
import re

import pytest
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions import text as tx
from wardgrid.functions.clinical import fusion, bedside_factors, bedside_points, news2, visual_risk
from wardgrid.sources import files as fl
from wardgrid.sources import sinks, studies, tables

REPORTS = [
    "Findings: Focal consolidation in right base suggesting pneumonia. Moderate left pleural effusion. "
    "No evidence of pneumothorax. Impression: Pneumonia and effusion.",
    "Findings: Lungs are clear without focal consolidation, pleural effusion, edema, or pneumothorax. "
    "Heart size is normal. Impression: No acute cardiopulmonary process.",
    None, "",
    "no pneumonia\npneumonia",
    "No " + "x" * 99 + " pneumonia",
    "no " + "x" * 90 + " pneumonia",
    "Denies chf; pulmonary\nedema seen. pleural \n effusion, volume  loss",
    "Pneumonia, no effusion; Pneumonia. without PNEUMONIA",
    "piano " + "y" * 88 + "; pneumonia",
    "épneumonia no pneumoniaé pneumothorax",
    "cardiac silhouette is mildly enlarged" + " z" * 60 + " unlikely pneumonia. rule out edema, rules out chf. chf",
]


def by_rule(text):
    """The rules read one by one, as a check on the fold."""
    out = {}
    for finding, (pos, neg) in fx.REPORT_PATTERNS.items():
        hit = False
        for m in re.finditer(pos, text or "", re.I):
            before = text[:m.start()]
            border = max(before.rfind("."), before.rfind(";"), before.rfind("\n"), 0)
            window = text[max(border, m.start() - 100):m.end()]
            if not re.search(neg, window, re.I) and not re.search(fx.NEGATION_PATTERN, window, re.I):
                hit = True
        out[finding] = float(hit)
    return out


def test_report_labels(spark):
    df = spark.createDataFrame(list(enumerate(REPORTS)), "id int, report_text string")
    rows = studies.with_report_labels(df).orderBy("id").collect()
    for row, text in zip(rows, REPORTS):
        want = by_rule(text)
        got = {f: row[studies.LABEL_COLUMNS[f]] for f in want}
        assert got == want, text
        assert row.no_finding == float(not any(want.values()))
    assert rows[0].pneumonia == 1.0 and rows[0].pleural_effusion == 1.0 and rows[0].pneumothorax == 0.0
    assert rows[1].no_finding == 1.0 and rows[2].no_finding == 1.0


@pytest.mark.parametrize("packed,want", [
    ("['a', 'b']", ["a", "b"]), ("[\"it's\", 'x, y']", ["it's", "x, y"]), ("[]", []), ("plain", ["plain"]),
    ("['broken", ["['broken"]), (None, []), ("['a\\'b', 'c\\nd']", ["a'b", "c\nd"]), ("  ['z']", ["z"]), ("", []),
])
def test_list_items(spark, packed, want):
    df = spark.createDataFrame([(packed,)], "p string")
    assert df.select(tx.list_items(F.col("p")).alias("x")).first().x == want


def test_uncertain_policy(spark):
    raw = spark.createDataFrame([("P1", 1.0, 0.0, None, None), ("P2", -1.0, 1.0, 0.0, 0.0), ("P3", 0.0, -1.0, 1.0, 0.0)],
                                "subject_id string, `Pneumonia` double, `Pleural Effusion` double, `Atelectasis` double, `No Finding` double")
    def value(policy, who, col):
        return tx.resolve_uncertain(raw, fx.FINDINGS, policy).where(F.col("subject_id") == who).first()[col]
    assert value("u_zero", "P1", "Pneumonia") == 1.0 and value("u_zero", "P2", "Pneumonia") == 0.0
    assert value("u_ones", "P2", "Pneumonia") == 1.0
    assert value("u_chexpert", "P3", "Pleural Effusion") == 1.0 and value("u_chexpert", "P2", "Pneumonia") == 0.0
    assert value("u_zero", "P1", "No Finding") == 0.0 and value("u_zero", "P1", "Edema") == 0.0
    with pytest.raises(ValueError):
        tx.resolve_uncertain(raw, fx.FINDINGS, "other")


@pytest.fixture()
def packed_csv(tmp_path):
    root = tmp_path / "images" / "files" / "p10" / "p10001" / "s501"
    root.mkdir(parents=True)
    (root / "dcm01.jpg").write_bytes(b"x")
    csv = tmp_path / "train.csv"
    csv.write_text(
        'subject_id,image,view,text\n10001,"[\'files/p10/p10001/s501/dcm01.jpg\', \'files/p10/p10001/s502/dcm02.jpg\']",'
        '"[\'PA\', \'LATERAL\']","[\'Findings: pneumonia in the left lobe.\', \'Findings: Normal lungs.\']"\n')
    return str(csv), str(tmp_path / "images")


def test_packed_ingestion(spark, packed_csv, tmp_path):
    csv, root = packed_csv
    images = studies.explode_images(studies.read_packed(spark, csv), "validate")
    valid, bad = studies.ingest(images, fl.listing(spark, root))
    row = valid.first()
    assert valid.count() == 1 and row.study_id == "s501" and row.pneumonia == 1.0 and row.view_position == "PA"
    miss = bad.first()
    assert bad.count() == 1 and miss.study_id == "s502" and miss.reason == "FILE_NOT_FOUND_ON_DISK"
    with pytest.raises(studies.MissingFiles):
        studies.ingest(images, fl.listing(spark, root), fail_fast=True)
    table = str(tmp_path / "table")
    assert sinks.append_new(valid, table, ["study_id", "image_id"]) == 1
    assert sinks.append_new(valid, table, ["study_id", "image_id"]) == 0
    assert "VIOLATION | Split: validate | Subject: 10001" in sinks.violation_lines(bad, "t").first().value
    audit = studies.ingestion_audit(images.select("subject_id").distinct(), valid, bad).first()
    assert (audit.patients, audit.valid_studies, audit.violations, audit.validity_pct) == (1, 1, 1, 50.0)


def gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_hospital_tables(spark, tmp_path, caplog):
    gz(tmp_path / "icu/chartevents.csv.gz",
       "subject_id,hadm_id,stay_id,itemid,charttime,storetime,value,valuenum,valueuom,warning\n"
       "1,10,100,220045,2150-01-01 10:00:00,2150-01-01 10:01:00,80,80,bpm,0\n"
       "1,10,100,99999,2150-01-01 10:00:00,2150-01-01 10:01:00,5,5,x,0\n"
       "2,20,200,220045,2150-01-02 10:00:00,2150-01-02 10:01:00,90,90,bpm,0\n")
    (tmp_path / "icu/d_items.csv").write_text("itemid,label\n220045,Heart Rate\n")
    gz(tmp_path / "hosp/patients.csv.gz", "subject_id,gender\n1,F\n")
    chart = tables.read(spark, str(tmp_path), "icu/chartevents")
    assert dict(chart.dtypes)["charttime"] == "string" and chart.count() == 3
    assert tables.chart_readings(chart, [100]).count() == 1
    assert tables.chart_readings(chart, spark.createDataFrame([(200,)], "stay_id long")).first().subject_id == 2
    assert tables.read(spark, str(tmp_path), "icu/d_items").first().label == "Heart Rate"
    with caplog.at_level("WARNING"):
        people = tables.read(spark, str(tmp_path), "hosp/patients")
    assert "anchor_age" in caplog.text and people.first().anchor_age is None
    with pytest.raises(tables.TableNotFound):
        tables.read(spark, str(tmp_path), "hosp/admissions")
    report = fl.availability(spark, fl.listing(spark, str(tmp_path)), "demo")
    seen = {r.table_name: r.present for r in report.collect()}
    assert seen["icu/d_items.csv.gz"] and seen["icu/chartevents.csv.gz"] and not seen["hosp/labevents.csv.gz"]
    assert fl.availability_summary(report).first().available == 3


def test_report_sinks(spark, tmp_path):
    one = spark.range(1).select(F.struct(F.lit(3).alias("patients")).alias("cohort"))
    sinks.write_json_report(one, str(tmp_path / "r.json"))
    assert spark.read.json(str(tmp_path / "r.json")).first().cohort.patients == 3
    sinks.write_csv_report(spark.createDataFrame([("a", 1)], "m string, v int"), str(tmp_path / "r.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).first().m == "a"
    sinks.write_windows(spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string"), str(tmp_path / "w"))
    assert sinks.read_windows(spark, str(tmp_path / "w"), "test").first().x == 2
    assert len(sinks.archive_export(spark.createDataFrame([("p",)], "id string")).columns) == 11


def test_fusion_and_news2(spark):
    vit = "heart_rate double, spo2 double, sbp double, respiratory_rate double, systolic_bp double, body_temperature double"
    df = spark.createDataFrame([(72.0, 98.5, 120.0, 15.0, 120.0, 37.0), (138.0, 84.0, 78.0, 32.0, 78.0, 39.4)], vit)
    f = fusion(F.lit(0.5), bedside_points(), visual_risk(F.lit("Pneumonia"), F.lit(0.92), F.lit(0.1)))
    rows = df.select(f.alias("f"), bedside_factors().alias("r"), news2().alias("n")).collect()
    assert rows[0].f.risk_tier in ("Low", "Moderate") and rows[0].r == [] and rows[0].n.risk_tier == "Low"
    assert rows[1].f.risk_score >= 50 and rows[1].f.risk_tier in ("High", "Critical")
    assert [x.split(" (")[0] for x in rows[1].r] == [
        "Severe Tachycardia", "Severe Hypoxemia", "Severe Hypotension / Shock", "Severe Tachypnea"]
    assert rows[1].f.visual_contribution + rows[1].f.vitals_contribution == pytest.approx(100.0)
    assert rows[1].n.risk_tier == "High"
    gap = spark.createDataFrame([(75.0, 91.5, 120.0, 24.5, 120.0, 37.0)], vit)
    free, banded = gap.select(news2().alias("a"), news2("banded").alias("b")).first()
    assert (free.spo2_score, free.respiratory_rate_score) == (2, 3)
    assert (banded.spo2_score, banded.respiratory_rate_score) == (0, 0)
