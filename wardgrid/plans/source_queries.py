"""Text, ingestion and source queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions import text as tx
from wardgrid.operators import profiling as pf
from wardgrid.plans import testmodel as tm
from wardgrid.plans.testmodel import with_sql
from wardgrid.sources import files as fl
from wardgrid.sources import sinks, studies, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


# ---- report text: rules over frequent words, so that matches and negations really occur ----------

RULES = {
    "Pneumonia": (r"\b(the|that)\b", r"\b(with\s+the|is\s+that)\b"),
    "Edema": (r"\b(is|was)\s+(the|for)\b", r"\bby\s+(is|was)\b"),
    "Atelectasis": (r"\b(der|que|le)\b", r"\bund\s+der\b"),
}
NEGATION = r"\b(not|this|von|avec|for|no|without)\b"
# The checking engine's \b knows ASCII letters only; other letters are replaced by one ASCII letter.
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g')"


def _label_sql(name: str, positive: str, negative: str) -> str:
    return f"""{name}_p AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '(?i){positive}')) AS found,
    generate_subscripts(regexp_extract_all(t, '(?i){positive}'), 1) AS k FROM src),
{name}_s AS (SELECT doc_id, unnest(string_split_regex(t, '(?i){positive}')) AS piece,
    generate_subscripts(string_split_regex(t, '(?i){positive}'), 1) AS k FROM src),
{name}_l AS (SELECT p.*, sum(length(s.piece)) OVER w + coalesce(sum(length(p.found)) OVER (
      PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {name}_p p JOIN {name}_s s ON s.doc_id = p.doc_id AND s.k = p.k
  WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.k ROWS UNBOUNDED PRECEDING)),
{name}_w AS (SELECT doc_id, regexp_extract(substr(t, greatest(before - 99, 1)::BIGINT, least(before, 100)::BIGINT), '[.;\\n]?[^.;\\n]*$') || found AS win FROM {name}_l),
{name} AS (SELECT DISTINCT doc_id FROM {name}_w WHERE NOT regexp_matches(win, '(?i)({negative}|{NEGATION})'))"""


@query("report_labels", f"WITH src AS (SELECT doc_id, {_ASCII} AS t FROM documents), "
       + ", ".join(_label_sql(n.lower(), p, q) for n, (p, q) in RULES.items()) + """
SELECT doc_id, CASE WHEN p.doc_id IS NULL THEN 0e0 ELSE 1e0 END AS pneumonia, CASE WHEN e.doc_id IS NULL THEN 0e0 ELSE 1e0 END AS edema,
 CASE WHEN a.doc_id IS NULL THEN 0e0 ELSE 1e0 END AS atelectasis,
 CASE WHEN p.doc_id IS NULL AND e.doc_id IS NULL AND a.doc_id IS NULL THEN 1e0 ELSE 0e0 END AS no_finding
FROM src LEFT JOIN pneumonia p USING (doc_id) LEFT JOIN edema e USING (doc_id) LEFT JOIN atelectasis a USING (doc_id)""")
def report_labels(spark, d):
    docs = tm.load(spark, d, "documents").select("doc_id", F.col("text").alias("report_text"))
    # long texts cluster in few parquet splits: spread them before the regular expressions
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return studies.with_report_labels(docs, RULES, NEGATION).drop("report_text")


@query("report_labels_clinical", """
SELECT doc_id, 0e0 AS pneumonia, 0e0 AS pleural_effusion, 0e0 AS atelectasis, 0e0 AS consolidation, 0e0 AS edema, 0e0 AS pneumothorax,
 0e0 AS cardiomegaly, 1e0 AS no_finding FROM documents
WHERE NOT regexp_matches(text, '(?i)(pneumonia|effusion|pleural|atelecta|volume\\s+loss|consolidation|airspace|opacity|edema|congesti|chf|vascular|fluid|pneumothor|cardiomegaly|enlarged|infiltrate|infectious)')""")
def report_labels_clinical(spark, d):
    docs = tm.load(spark, d, "documents").select("doc_id", F.col("text").alias("report_text"))
    return studies.with_report_labels(docs).drop("report_text")


_MENTIONS = ["pneumonia", "pleural effusion", "atelectasis", "consolidation", "pulmonary edema", "pneumothorax", "cardiomegaly"]
_COLUMNS = ["pneumonia", "pleural_effusion", "atelectasis", "consolidation", "edema", "pneumothorax", "cardiomegaly"]
_I, _J = "o_custkey % 7", "(o_custkey + o_orderkey) % 7"


@query("report_labels_built", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN ({_I} = {k} AND o_orderkey % 2 = 0) OR ({_J} = {k} AND o_custkey % 2 = 0) THEN 1e0 ELSE 0e0 END AS {c}" for k, c in enumerate(_COLUMNS))
    + ", CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 2 = 1 THEN 1e0 ELSE 0e0 END AS no_finding FROM orders")
def report_labels_built(spark, d):
    """Reports made of each order's own columns: two findings, each plain or denied, by the clinical patterns."""
    names = "array(" + ", ".join(f"'{m}'" for m in _MENTIONS) + ")"
    text = (f"concat('Order of ', o_orderpriority, '. ', if(o_orderkey % 2 = 0, 'There is ', 'No evidence of '), {names}[cast({_I} as int)], "
            f"'. Status ', o_orderstatus, if(o_custkey % 2 = 0, '; stable ', '; lungs without '), {names}[cast({_J} as int)], '.')")
    rows = tm.load(spark, d, "orders").select("o_orderkey", F.expr(text).alias("report_text"))
    return studies.with_report_labels(rows).drop("report_text")


_UNC = "CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE quality END"


def _policy_sql(policy: str) -> str:
    q = {"u_zero": f"coalesce({_UNC} = 1, false)", "u_ones": f"coalesce({_UNC} IN (1, -1), false)"}
    both = q["u_ones"] if policy in ("u_ones", "u_chexpert") else q["u_zero"]
    other = q["u_ones"] if policy == "u_ones" else q["u_zero"]
    return (f"SELECT doc_id, '{policy}' AS policy, ({both})::INT::DOUBLE AS edema, ({other})::INT::DOUBLE AS pneumonia, "
            f"(NOT ({both} OR {other}))::INT::DOUBLE AS no_finding FROM labels")


@query("uncertain_labels", " UNION ALL ".join(_policy_sql(p) for p in ("u_zero", "u_ones", "u_chexpert")))
def uncertain_labels(spark, d):
    raw = tm.load(spark, d, "labels").select("doc_id", F.expr(_UNC).cast("double").alias("Edema"),
                                             F.expr(_UNC).cast("double").alias("Pneumonia"))
    parts = [tx.resolve_uncertain(raw, ["Edema", "Pneumonia", "No Finding"], p).select(
        "doc_id", F.lit(p).alias("policy"), F.col("Edema").alias("edema"), F.col("Pneumonia").alias("pneumonia"),
        F.col("No Finding").alias("no_finding")) for p in ("u_zero", "u_ones", "u_chexpert")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- packed studies: one row per customer, its orders as images ----------------------------------

def _files(spark, d) -> DataFrame:
    """The 'disk': images of orders that are not pending."""
    o = tm.load(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.selectExpr("concat('files/p10/p', o_custkey, '/s', o_orderkey DIV 3, '/', o_orderkey, '.jpg') AS path",
                        "o_orderkey AS length")


def packed(spark, d) -> DataFrame:
    o = tm.load(spark, d, "orders").selectExpr(
        "o_custkey", "o_orderkey",
        "concat('files/p10/p', o_custkey, '/s', o_orderkey DIV 3, '/', o_orderkey, '.jpg') AS p",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat(\"'\", 'Pneumonia in the ', o_orderpriority, \"'\") "
        "ELSE concat('\"', \"Patient's lungs: no effusion; edema. \", o_orderstatus, '\"') END AS t")
    # several packed rows per patient keep every cell bounded (at most 1000 images)
    g = o.groupBy("o_custkey", F.expr("o_orderkey DIV 1000")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "p", "t"))).alias("x"))
    return g.select(
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.concat(F.lit("['"), F.array_join(F.col("x.p"), "', '"), F.lit("']")).alias("image"),
        F.lit("['PA', 'LATERAL']").alias("view"),
        F.concat(F.lit("["), F.array_join(F.col("x.t"), ", "), F.lit("]")).alias("text"))


_PACK_SQL = """WITH o AS (SELECT o_custkey, o_orderkey // 1000 AS blk, o_orderkey, o_orderstatus, o_orderpriority, 's' || o_orderkey // 3 AS study_id,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS i FROM orders),
s AS (SELECT o_custkey, blk, study_id, row_number() OVER (PARTITION BY o_custkey, blk ORDER BY min(i)) - 1 AS r FROM o GROUP BY 1, 2, 3),
t AS (SELECT o_custkey, blk, i, CASE WHEN o_orderkey % 2 = 0 THEN 'Pneumonia in the ' || o_orderpriority ELSE 'Patient''s lungs: no effusion; edema. ' || o_orderstatus END AS report FROM o),
img AS (SELECT o.o_custkey::VARCHAR AS subject_id, o.study_id, o.o_orderkey::VARCHAR AS image_id, o_orderstatus,
  CASE o.i WHEN 0 THEN 'PA' WHEN 1 THEN 'LATERAL' ELSE 'PA' END AS view_position,
  'files/p10/p' || o.o_custkey || '/' || o.study_id || '/' || o.o_orderkey || '.jpg' AS image_path, report AS report_text
 FROM o JOIN s ON s.o_custkey = o.o_custkey AND s.blk = o.blk AND s.study_id = o.study_id
 LEFT JOIN t ON t.o_custkey = o.o_custkey AND t.blk = o.blk AND t.i = s.r)"""


@query("packed_studies", _PACK_SQL + """
SELECT subject_id, study_id, image_id, view_position, image_path, coalesce(report_text, '') AS report_text, 'train' AS split FROM img""")
def packed_studies(spark, d):
    return studies.explode_images(packed(spark, d), "train")


@query("study_ingestion", _PACK_SQL + """
SELECT subject_id, study_id, image_id, report_text LIKE 'Pneumonia%' AS pneumonia, false AS edema, NOT report_text LIKE 'Pneumonia%' AS no_finding
FROM img WHERE o_orderstatus <> 'P'""")
def study_ingestion(spark, d):
    valid, _ = studies.ingest(studies.explode_images(packed(spark, d), "train"), _files(spark, d))
    return valid.select("subject_id", "study_id", "image_id", *[
        (F.col(c) == 1.0).alias(c) for c in ("pneumonia", "edema", "no_finding")])


@query("ingestion_violations", _PACK_SQL + """
SELECT '[t] VIOLATION | Split: train | Subject: ' || subject_id || ' | Study: ' || study_id || ' | Attempted Path: ' || image_path || ' | Reason: FILE_NOT_FOUND_ON_DISK' AS value
FROM img WHERE o_orderstatus = 'P'""")
def ingestion_violations(spark, d):
    _, bad = studies.ingest(studies.explode_images(packed(spark, d), "train"), _files(spark, d))
    return sinks.violation_lines(bad, "t")


@query("ingestion_audit", _PACK_SQL + """
SELECT (SELECT count(DISTINCT subject_id) FROM img) AS patients, count(*) FILTER (WHERE o_orderstatus <> 'P') AS valid_studies,
 count(*) FILTER (WHERE o_orderstatus = 'P') AS violations, round(count(*) FILTER (WHERE o_orderstatus <> 'P') * 100e0 / count(*), 2) AS validity_pct FROM img""")
def ingestion_audit(spark, d):
    rows = packed(spark, d)
    checked = fl.with_existence(studies.explode_images(rows, "train"), _files(spark, d))
    return studies.ingestion_audit(rows.select("subject_id").distinct(), checked.where("file_exists"), checked.where("NOT file_exists"))


@query("first_violations", _PACK_SQL + """
SELECT subject_id, image_path FROM img WHERE o_orderstatus = 'P' ORDER BY image_path LIMIT 25""")
def first_violations(spark, d):
    _, bad = studies.ingest(studies.explode_images(packed(spark, d), "train"), _files(spark, d))
    return fl.newest_first(bad.select("subject_id", "image_path"), "image_path", 25)


@query("file_audit", """
WITH r AS (SELECT o_custkey % 500 AS k, o_orderstatus <> 'P' AS ok FROM orders), f AS (SELECT DISTINCT k FROM r WHERE ok AND k % 3 > 0),
c AS (SELECT r.k, f.k IS NOT NULL AS there FROM r LEFT JOIN f ON f.k = r.k)
SELECT count(*) AS referenced, count(*) FILTER (WHERE there) AS on_disk,
 count(*) FILTER (WHERE there) - (SELECT count(DISTINCT k) FROM c WHERE there) AS duplicate_references,
 count(*) FILTER (WHERE NOT there) AS missing, round(count(*) FILTER (WHERE there) * 100e0 / count(*), 2) AS available_pct FROM c""")
def file_audit(spark, d):
    rows = tm.load(spark, d, "orders").selectExpr("concat('img', o_custkey % 500) AS image_path", "o_orderstatus")
    there = rows.where("o_orderstatus <> 'P' AND CAST(substring(image_path, 4) AS INT) % 3 > 0").select(
        F.col("image_path").alias("path")).distinct()
    return fl.file_audit(fl.with_existence(rows, there))


@query("path_candidates", """
WITH i AS (SELECT o_orderkey, o_custkey::VARCHAR AS subject, (o_orderkey // 3)::VARCHAR AS study, CASE WHEN length(o_custkey::VARCHAR) >= 2 THEN 'p' || o_custkey::VARCHAR[1:2] ELSE 'p10' END AS pre FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'files/direct/' || o_orderkey || '.jpg'
 WHEN 1 THEN 'files/' || pre || '/p' || subject || '/s' || study || '/' || o_orderkey || '.jpg'
 WHEN 2 THEN pre || '/p' || subject || '/s' || study || '/' || o_orderkey || '.jpg' WHEN 3 THEN o_orderkey || '.jpg' END AS resolved_path FROM i""".replace("o_custkey::VARCHAR[1:2]", "substr(o_custkey::VARCHAR, 1, 2)"))
def path_candidates(spark, d):
    rows = tm.load(spark, d, "orders").selectExpr(
        "o_orderkey", "concat('files/direct/', o_orderkey, '.jpg') AS image_path", "CAST(o_custkey AS STRING) AS subject_id",
        "CAST(o_orderkey DIV 3 AS STRING) AS study_id", "CAST(o_orderkey AS STRING) AS image_id")
    pre = "CASE WHEN length(subject_id) >= 2 THEN concat('p', substring(subject_id, 1, 2)) ELSE 'p10' END"
    inner = f"concat({pre}, '/p', subject_id, '/s', study_id, '/', image_id, '.jpg')"
    disk = rows.selectExpr(f"""CASE o_orderkey % 5 WHEN 0 THEN image_path WHEN 1 THEN concat('files/', {inner})
        WHEN 2 THEN {inner} WHEN 3 THEN concat(image_id, '.jpg') END AS path""").where("path IS NOT NULL")
    return fl.resolve_candidates(rows, disk, ["o_orderkey"]).select("o_orderkey", "resolved_path")


@query("first_per_subject", """
SELECT o_custkey AS subject_id, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def first_per_subject(spark, d):
    o = tm.load(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderkey", "o_orderstatus")
    return fl.first_per_subject(o, "o_orderkey")


@query("append_new_rows", """
SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderkey % 7 = l_linenumber)""")
def append_new_rows(spark, d):
    new = tm.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    old = tm.load(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "CAST(o_orderkey % 7 AS INT) AS l_linenumber")
    return sinks.new_rows(new, old, ["l_orderkey", "l_linenumber"])


@query("labels_with_split", """
SELECT l.doc_id, l.quality, CASE WHEN lower(lang) = 'en' THEN 'train' ELSE 'test' END AS split FROM labels l JOIN documents d USING (doc_id) WHERE lower(lang) = 'en'""")
def labels_with_split(spark, d):
    labels = tm.load(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), F.col("doc_id").alias("study_id"), "quality")
    split = tm.load(spark, d, "documents").selectExpr(
        "doc_id AS subject_id", "doc_id AS study_id", "CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split")
    out = studies.in_split(studies.join_labels_to_split(labels, split), "TRAIN")
    return out.select(F.col("subject_id").alias("doc_id"), "quality", "split")


# ---- readings ------------------------------------------------------------------------------------

@query("filtered_readings", with_sql("ev", "obs", "stays") + f"""
SELECT event_id, itemid, round(valuenum, 6) AS valuenum FROM obs WHERE itemid IN ({', '.join(map(str, fx.PROFILE_VITALS))})
 AND stay_id IN (SELECT stay_id FROM stays WHERE first_careunit = 'MICU')""")
def filtered_readings(spark, d):
    keep = tm.stays(spark, d).where("first_careunit = 'MICU'")
    out = tables.chart_readings(tm.observations(spark, d), keep)
    return out.select("event_id", "itemid", F.round("valuenum", 6).alias("valuenum"))


@query("filtered_labs", with_sql("ev", "obs", "admissions") + f"""
SELECT event_id, itemid FROM obs WHERE itemid IN ({', '.join(map(str, fx.PROFILE_LABS))}) AND hadm_id IN (SELECT hadm_id FROM admissions WHERE deathtime IS NOT NULL)""")
def filtered_labs(spark, d):
    keep = tm.admissions(spark, d).where("deathtime IS NOT NULL")
    return tables.lab_readings(tm.observations(spark, d), keep).select("event_id", "itemid")


@query("canonical_observations", with_sql("ev", "obs") + f"""
SELECT subject_id, hadm_id, stay_id, charttime, storetime, itemid, {tm._sql_map(fx.VITAL_ITEMS)} AS canonical_name, round(valuenum, 6) AS valuenum, valueuom FROM obs""")
def canonical_observations(spark, d):
    out = tables.canonical_observations(tm.observations(spark, d), pf.registry(spark, fx.VITAL_ITEMS)).drop("value")
    return tm.export(out.withColumn("valuenum", F.round("valuenum", 6)))


@query("latest_store", with_sql("ev", "obs") + """
SELECT stay_id, itemid, date_trunc('day', charttime) AS charttime, event_id, storetime FROM obs
QUALIFY row_number() OVER (PARTITION BY stay_id, itemid, date_trunc('day', charttime) ORDER BY storetime DESC, event_id DESC) = 1""")
def latest_store(spark, d):
    obs = tm.observations(spark, d).select("stay_id", "itemid", F.date_trunc("day", "charttime").alias("charttime"),
                                           "event_id", "storetime")
    return tm.export(tables.latest_store(obs))
