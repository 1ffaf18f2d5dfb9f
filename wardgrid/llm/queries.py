"""The registered queries of the training-data operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardgrid.llm.alignment import align
from wardgrid.llm.chat import rotate
from wardgrid.llm.common import table
from wardgrid.llm.decontaminate import contamination
from wardgrid.llm.extract import extract
from wardgrid.llm.fingerprint import edited_fingerprints
from wardgrid.llm.language import identify
from wardgrid.llm.mixing import mix
from wardgrid.llm.neardup import link_components
from wardgrid.llm.pii import pseudonymise
from wardgrid.llm.quality import classify
from wardgrid.llm.repeats import without_repeats
from wardgrid.llm.whitening import whiten
from wardgrid.llm.wordlm import score_documents


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), words=4)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_position")


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_item", "n_shared", "containment")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "p_content", "p_metadata", "quality_score", "keep")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


def op11_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_language, op3_pfair_mix, op4_contamination, op5_main_text, op6_fingerprints, op7_quality, op8_repeats,
    op9_pseudonyms, op10_perspectives, op11_word_scores, op12_token_alignment, op13_whitening)}

ORACLES = {
    "op1_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        g AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
                   lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        i AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
        FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2""",
    "op4_contamination": """
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL),
        iw AS (
            SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w
            FROM benchmark WHERE item_id IS NOT NULL),
        ds AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                   lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
        bs AS (
            SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                   lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM iw WHERE len(w) > 0),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
        FROM ds JOIN bs USING (g) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op8_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
        s AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM p),
        f AS (SELECT s, min(doc_id) AS low FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
        r AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE doc_id > low),
        o AS (
            SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
            FROM r),
        g AS (SELECT doc_id, p, sum(CASE WHEN e IS NULL OR p > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM o),
        x AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY 1, 2),
        k AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS l FROM x GROUP BY 1),
        j AS (
            SELECT d.doc_id, d.h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
                   list_concat([0], list_transform(coalesce(l, []), lambda q: q.b)) AS a,
                   list_concat(list_transform(coalesce(l, []), lambda q: q.a), [length(d.h) // 2]) AS b
            FROM d LEFT JOIN k USING (doc_id))
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(h, 2 * a[i] + 1, 2 * (b[i] - a[i]))), ''))) AS kept_sha256
        FROM j""",
    "op10_perspectives": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS content
            FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
        r AS (
            SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
                   CASE WHEN speaker = 'system' OR speaker = perspective THEN '' ELSE speaker END AS name
            FROM c JOIN s USING (conv_id)),
        h AS (
            SELECT *, '<|im_start|>' || role || CASE WHEN name = '' THEN '' ELSE ' name=' || name END || chr(10) AS head FROM r),
        g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM h),
        o AS (
            SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
            FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content))
        SELECT conv_id, perspective, seq, turn, role, name, segment,
               CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
               CAST(stop - length(segment) + length(head) AS BIGINT) AS mask_start, CAST(stop - 1 AS BIGINT) AS mask_stop,
               speaker = perspective AS trained
        FROM o""",
}
