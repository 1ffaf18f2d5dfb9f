"""The supplied tables read as clinical ones.

`events` gives readings, stays, infusions and orders; `customer` gives patients; `lineitem`, `orders`
and `part` give coded diagnoses. The item codes, units and value ranges are this mapping's own; the
operators only see clinical columns. `SQL` holds the same mapping for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators.timeline import GridSpec

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ITEMS = [*fx.VITAL_ITEMS, *fx.LAB_ITEMS, 99998, 99999]
BASE = [55.0, 100.0, 10.0, 150.0, 145.0, 90.0, 88.0, 105.0, 100.0, 36.0, 96.5,
        4.0, 15.0, 0.5, 0.4, 70.0, 110.0, 35.0, 0.0, 0.0]
SLOPE = [0.6, -0.12, 0.15, -0.5, -0.4, -0.3, -0.25, -0.4, -0.35, 0.03, 0.05,
         0.1, -0.05, 0.04, 0.02, 1.0, -0.3, 0.1, 1.0, 1.0]
UNITS = [fx.ITEM_UNITS.get(i, "none") for i in ITEMS]
DRUGS = ["Norepinephrine", "Furosemide (Lasix)", "Vancomycin", "Albuterol Inhaler", "Dexamethasone",
         "Cefepime", "Insulin", "Heparin", "Epinephrine 0.1mg", "Bumetanide", "Ipratropium",
         "Solu-Medrol"]
UNIT_NAMES = ["MICU", "SICU", "CCU", "Neuro-ICU"]
SECOND_HALF = "2024-01-16"

SPEC = GridSpec(
    step_minutes=360,
    fill_hours={**{c: 48.0 for c in fx.VITAL_CHANNELS}, **{c: 96.0 for c in fx.LAB_CHANNELS},
                "temperature_c": 72.0},
)

DIAGNOSIS_STEMS = ["ring", "gear", "bolt", "hot", "cold"]
CONDITION_RULES = [
    ("Hot ring", ["hot ring"]),
    ("Ring", ["ring"]),
    ("Gear", ["gear"]),
    ("Bolt", ["bolt"]),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def export(df: DataFrame) -> DataFrame:
    """Timestamps back to zone-less ones."""
    return df.selectExpr(*[f"CAST({c} AS TIMESTAMP_NTZ) AS {c}" if t == "timestamp" else c
                           for c, t in df.dtypes])


def _pick(values: list, index: Column) -> Column:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
                      for v in values)
    return F.element_at(F.expr(f"array({items})"), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_events(load(spark, sf_dir, "events"))


def to_events(raw: DataFrame) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        k.alias("k"),
        (F.col("user_id") * 2 + (F.col("ts") >= F.lit(SECOND_HALF).cast("timestamp_ntz")).cast("long"))
        .alias("stay_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_observations(events(spark, sf_dir))


def to_observations(ev: DataFrame) -> DataFrame:
    code = (F.array_position(F.expr(f"array{tuple(EVENT_TYPES)}"), F.col("event_type")) - 1) * 4
    code = code + F.col("k") % 4
    number = F.when(F.col("k") % 25 == 3, None).otherwise(
        _pick(BASE, code) + F.col("value") * _pick(SLOPE, code))
    return ev.select(
        "event_id", F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"), "stay_id",
        F.col("ts").alias("charttime"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("k") % 7) * 60_000_000).alias("storetime"),
        _pick(ITEMS, code).alias("itemid"), F.col("value").cast("string").alias("value"),
        number.alias("valuenum"),
        F.when(F.col("k") % 50 == 0, "other").otherwise(_pick(UNITS, code)).alias("valueuom"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    per = ev.groupBy("stay_id", "user_id").agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
    los = (F.unix_micros("outtime") - F.unix_micros("intime")) / 86400e6
    return per.select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"), "stay_id",
        _pick(UNIT_NAMES, F.col("user_id") % 4).alias("first_careunit"), "intime", "outtime",
        los.alias("los"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("subject_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.col("c_nationkey") * 3 + 18).alias("anchor_age"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    per = ev.groupBy("user_id").agg(
        F.min("ts").alias("admittime"), F.max("ts").alias("dischtime"),
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("_last_error"))
    return per.select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"), "admittime", "dischtime",
        F.when(F.col("user_id") % 7 == 0, F.col("_last_error")).alias("deathtime"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("subject_id"), F.col("o_custkey").alias("hadm_id"),
        F.col("l_partkey").alias("icd_code"), (F.col("l_linenumber") % 2).alias("icd_version"))


def diagnosis_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("icd_code"), (F.col("p_size") % 2).alias("icd_version"),
                    F.col("p_name").alias("long_title"))


def infusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("event_type = 'purchase'")
    return ev.select(
        "event_id", F.col("user_id").alias("subject_id"), "stay_id", (F.col("k") % 12).alias("itemid"),
        _pick(DRUGS, F.col("k") % 12).alias("drug_name"), F.col("ts").alias("starttime"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 3_600_000_000).alias("endtime"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("event_type = 'signup'")
    return ev.select(
        "event_id", F.col("user_id").alias("subject_id"),
        _pick(DRUGS, (F.col("k") + F.col("event_id")) % 12).alias("drug_name"),
        F.col("ts").alias("starttime"),
        F.when(F.col("k") % 2 == 1, F.timestamp_micros(
            F.unix_micros("ts") + F.floor("value") * 3_600_000_000)).alias("stoptime"))


def _sql_list(values: list, cast: str = "") -> str:
    body = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{body}]{cast})"


def _sql_class(text: str, rules, default: str = "NULL") -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"lower({text}) LIKE '%{s}%'" for s in stems) + f" THEN '{label}'"
        for label, stems in rules)
    return f"(CASE {whens} ELSE {default} END)"


def _sql_map(items: dict[int, str]) -> str:
    return "(CASE itemid " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in items.items()) + " END)"


SQL: dict[str, str] = {
    "ev": f"""
ev AS (SELECT event_id, ts, user_id, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    user_id * 2 + CASE WHEN ts >= TIMESTAMP '{SECOND_HALF}' THEN 1 ELSE 0 END AS stay_id,
    epoch_us(ts) AS us
  FROM events)""",
    "obs": f"""
coded AS (SELECT *, (list_position({_sql_list(EVENT_TYPES)}, event_type) - 1) * 4 + k % 4 AS code FROM ev),
obs AS (SELECT event_id, user_id AS subject_id, user_id AS hadm_id, stay_id, ts AS charttime, us,
    ts + to_minutes(CAST(k % 7 AS INTEGER)) AS storetime,
    {_sql_list(ITEMS)}[code + 1] AS itemid,
    CASE WHEN k % 25 = 3 THEN NULL ELSE
      {_sql_list(BASE, '::DOUBLE[]')}[code + 1] + value * {_sql_list(SLOPE, '::DOUBLE[]')}[code + 1]
    END AS valuenum,
    CASE WHEN k % 50 = 0 THEN 'other' ELSE {_sql_list(UNITS)}[code + 1] END AS valueuom
  FROM coded)""",
    "stays": f"""
stays AS (SELECT user_id AS subject_id, user_id AS hadm_id, stay_id,
    {_sql_list(UNIT_NAMES)}[user_id % 4 + 1] AS first_careunit,
    min(ts) AS intime, max(ts) AS outtime, min(us) AS in_us, max(us) AS out_us,
    (max(us) - min(us)) / 86400e6 AS los
  FROM ev GROUP BY user_id, stay_id)""",
    "patients": """
patients AS (SELECT c_custkey AS subject_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    c_nationkey * 3 + 18 AS anchor_age FROM customer)""",
    "admissions": """
admissions AS (SELECT user_id AS subject_id, user_id AS hadm_id, min(ts) AS admittime, max(ts) AS dischtime,
    CASE WHEN user_id % 7 = 0 THEN max(ts) FILTER (WHERE event_type = 'error') END AS deathtime
  FROM ev GROUP BY user_id)""",
    "diag": """
diag AS (SELECT o.o_custkey AS subject_id, o.o_custkey AS hadm_id, p.p_name AS long_title
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size % 2 = l.l_linenumber % 2)""",
    "infusions": f"""
infusions AS (SELECT event_id, user_id AS subject_id, stay_id, k % 12 AS itemid,
    {_sql_list(DRUGS)}[k % 12 + 1] AS drug_name, ts AS starttime, us AS s_us,
    us + CAST(floor(value) AS BIGINT) * 3600000000 AS e_us
  FROM ev WHERE event_type = 'purchase')""",
    "orders": f"""
rx AS (SELECT event_id, user_id AS subject_id, {_sql_list(DRUGS)}[(k + event_id) % 12 + 1] AS drug_name,
    ts AS starttime, us AS s_us,
    CASE WHEN k % 2 = 1 THEN us + CAST(floor(value) AS BIGINT) * 3600000000 END AS stop_us
  FROM ev WHERE event_type = 'signup')""",
}


def with_sql(*names: str) -> str:
    """A WITH prefix made of the named mapping tables."""
    return "WITH " + ",".join(SQL[n] for n in names)
