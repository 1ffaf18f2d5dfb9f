"""Hospital tables from CSV files."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.session import store

log = logging.getLogger(__name__)

# Times stay text at ingest; they are parsed later, and what does not parse becomes NULL.
SCHEMAS = {
    "patients": "subject_id long, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod string",
    "admissions": "subject_id long, hadm_id long, admittime string, dischtime string, deathtime string, "
                  "admission_type string, insurance string, ethnicity string",
    "icustays": "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, "
                "intime string, outtime string, los double",
    "chartevents": "subject_id long, hadm_id long, stay_id long, itemid int, charttime string, storetime string, "
                   "value string, valuenum double, valueuom string, warning int",
    "labevents": "subject_id long, hadm_id long, itemid int, charttime string, storetime string, value string, "
                 "valuenum double, valueuom string, ref_range_lower string, ref_range_upper string, flag string",
    "d_items": "itemid int, label string, abbreviation string, category string, unitname string",
    "d_labitems": "itemid int, label string, fluid string, category string, loinc_code string",
    "inputevents": "subject_id long, hadm_id long, stay_id long, itemid int, starttime string, endtime string",
    "procedureevents": "subject_id long, hadm_id long, stay_id long, itemid int, starttime string, endtime string",
    "prescriptions": "subject_id long, hadm_id long, drug string, starttime string, stoptime string",
    "diagnoses_icd": "subject_id long, hadm_id long, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
}
# Discharge diagnoses are known only after a stay: for labels, never for features.
LABEL_ONLY_TABLES = {"diagnoses_icd"}
#: Column of a line that does not fit the schema.
BAD = "_bad_line"
CORE_TABLES = ["hosp/patients", "hosp/admissions", "icu/icustays", "icu/d_items", "hosp/d_labitems"]


class TableNotFound(FileNotFoundError):
    """A table is in neither of its two places."""


def _exists(spark: SparkSession, path: str) -> bool:
    """Ask Spark's reader, so that shared storage works like a local folder."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def find(spark: SparkSession, root: str, table: str) -> str:
    """Path of `hosp/patients` style tables: .csv.gz first, then .csv."""
    for suffix in (".csv.gz", ".csv"):
        path = f"{root.rstrip('/')}/{table}{suffix}"
        if _exists(spark, path):
            return path
    raise TableNotFound(f"no {table}.csv.gz or {table}.csv below {root}; place the export's files there")


def missing_columns(header: Sequence[str], table: str) -> list[str]:
    return [c for c in fx.EXPECTED_COLUMNS.get(table, []) if c not in header]


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()  # the header line only
    return [h.strip().strip('"') for h in first[0].split(",")] if first else []


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table by its fixed schema; expected columns that the file lacks are warned about and NULL.

    A gzip file is one split, so its rows are spread before any wide step.
    """
    path = find(spark, root, table)
    name = table.rsplit("/", 1)[-1]
    header = _header(spark, path)
    lacking = missing_columns(header, name)
    if lacking:
        log.warning("table %s lacks expected columns %s", name, lacking)
    wanted = dict(part.strip().rsplit(" ", 1) for part in SCHEMAS[name].split(","))
    schema = ", ".join(f"`{h}` {wanted.get(h, 'string')}" for h in header)
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if path.endswith(".gz"):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.withColumns({c: F.lit(None).cast(wanted.get(c, "string")) for c in lacking}) if lacking else df


@dataclass(frozen=True)
class Checked:
    """A table read with care: its sound rows, the lines that do not fit the schema, and how the columns differ."""

    rows: DataFrame
    quarantine: DataFrame       # (line)
    drift: DataFrame            # (column_name, state): missing, unexpected or moved


def read_checked(spark: SparkSession, root: str, table: str) -> Checked:
    """`read`, but a line whose values do not fit the schema goes whole to the quarantine instead of losing values.

    The file is parsed once, into the shared folder. A column is moved when the expected columns that the file has come in
    another order than expected.
    """
    path, name = find(spark, root, table), table.rsplit("/", 1)[-1]
    header = _header(spark, path)
    wanted = dict(part.strip().rsplit(" ", 1) for part in SCHEMAS[name].split(","))
    expected = fx.EXPECTED_COLUMNS.get(name, list(wanted))
    schema = ", ".join(f"`{h}` {wanted.get(h, 'string')}" for h in header)
    parsed = store(spark.read.schema(f"{schema}, `{BAD}` string").option("header", True).option("quote", '"').option("escape", '"')
                   .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path))
    lacking = missing_columns(header, name)
    there = [c for c in header if c in expected]
    moved = [c for c, e in zip(there, [c for c in expected if c in there], strict=True) if c != e]
    states = [(c, "missing") for c in lacking] + [(c, "unexpected") for c in header if c not in wanted] + [(c, "moved") for c in moved]
    rows = parsed.where(F.col(BAD).isNull()).drop(BAD)
    return Checked(rows.withColumns({c: F.lit(None).cast(wanted.get(c, "string")) for c in lacking}) if lacking else rows,
                   parsed.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line")),
                   spark.createDataFrame(states, "column_name string, state string"))


def read_core(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t.rsplit("/", 1)[-1]: read(spark, root, t) for t in CORE_TABLES}


def keep_items(df: DataFrame, items: Sequence[int] | None) -> DataFrame:
    return df.where(F.col("itemid").isin(list(items))) if items else df


def keep_keys(df: DataFrame, keys: DataFrame | Sequence[int] | None, column: str) -> DataFrame:
    """Semi join with a table of keys, or an IN list for a handful of keys; None keeps all."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(column), column, "left_semi")
    return df.where(F.col(column).isin(list(keys))) if keys else df


def chart_readings(df: DataFrame, stays=None, items: Sequence[int] | None = None) -> DataFrame:
    return keep_keys(keep_items(df, items or list(fx.PROFILE_VITALS)), stays, "stay_id")


def lab_readings(df: DataFrame, admissions=None, items: Sequence[int] | None = None) -> DataFrame:
    return keep_keys(keep_items(df, items or list(fx.PROFILE_LABS)), admissions, "hadm_id")


def for_stays(df: DataFrame, stays=None) -> DataFrame:
    return keep_keys(df, stays, "stay_id")


def canonical_observations(df: DataFrame, items: DataFrame) -> DataFrame:
    """The ten observation columns; `items` names each item."""
    named = df.join(items.select("itemid", "canonical_name"), "itemid", "left")
    have = set(named.columns)
    return named.select(*[
        F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fx.OBSERVATION_COLUMNS])


def latest_store(df: DataFrame) -> DataFrame:
    """One row per (stay, item, time): the one stored last."""
    key = ["stay_id", "itemid", "charttime"]
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*[
        c for c in ("storetime", "event_id") if c in rest])).alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)
