"""Document fingerprints by consistent weighted sampling of word counts.

Sample k of a text is its word with the least a = c / (y e^r), where r and c are gamma(2, 1) variates and b is uniform, all
drawn from two hashes of the word and k, w is the word's count and ln y = r (floor(ln w / r + b) - b). Two texts agree in a sample with a
probability equal to the generalised Jaccard similarity of their counts (sum of minima over sum of maxima). Since a
depends on the word, the level of its weight and k alone, the least a itself names the sample, and a sample is one
`min` of floats of ln a: partial aggregates leave one row per text. A similarity j estimated from n samples has the
standard error sqrt(j (1 - j) / n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import first_of, id_ranges, range_of
from wardgrid.session import store

SAMPLES = 48
#: Rows of a range of the document order, about.
BIN_ROWS = 2_000
WORD_BREAKS = r"[ \\t-\\r]+"


def counted_words(text: str) -> str:
    """SQL for an array of (t, n): the hash of each different word and its count; null for null, empty without words.

    Words are sorted by hash and counted as runs; each array is bound once as a lambda variable.
    """
    words = f"array_remove(split(lower({text}), '{WORD_BREAKS}'), '')"
    return (f"transform(array(sort_array(transform({words}, x -> xxhash64(x)))), s -> if(size(s) = 0, "
            "cast(array() as array<struct<t:bigint,n:int>>), transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] != s[i - 1])), "
            "b -> transform(b, (p, j) -> struct(s[p] as t, coalesce(get(b, j + 1), size(s)) - p as n)))[0]))[0]")


def sample_value(k: int) -> Column:
    """ln a of word hash `t` with log count `lw` for sample k; r and c are slices of one hash, the shift b comes from another."""
    h, other = F.xxhash64(F.col("t"), F.lit(k)), F.xxhash64(F.col("t"), F.lit(-1 - k))

    def uniform(h: Column, at: int, bits: int) -> Column:
        return (F.shiftrightunsigned(h, at).bitwiseAND(2 ** bits - 1) + 0.5) / float(2 ** bits)

    r = -F.log(uniform(h, 0, 16) * uniform(h, 16, 16))
    log_c = F.log(-F.log(uniform(h, 32, 16) * uniform(h, 48, 16)))
    shift = uniform(other, 8, 20)
    return log_c - r * (F.floor(F.col("lw") / r + shift) - shift) - r


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row per distinct `keys` with `sig`, an array of 32-bit sample names; an empty array for a text without words."""
    terms = (texts.select(*keys, F.expr(f"inline_outer({counted_words('coalesce(text, \"\")')})"))
             .withColumn("lw", F.log(F.col("n").cast("double"))))
    least = terms.groupBy(*keys).agg(*[F.min(sample_value(k).cast("float")).alias(f"a{k}") for k in range(samples)])
    return least.select(*keys, F.when(F.col("a0").isNull(), F.expr("cast(array() as array<int>)"))
                        .otherwise(F.array(*[F.hash(f"a{k}") for k in range(samples)])).alias("sig"))


def as_text(sig: str) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.expr(f"array_join(transform({sig}, x -> lpad(lower(hex(cast(x as bigint) & 4294967295L)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of agreeing samples: the estimated generalised Jaccard similarity; 1 for two empty texts, 0 for one."""
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D "
                  f"else {same} / size({a}) end")


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, th, text, next_id, next_th, next_text): each document beside the next in doc_id order, the first after the last.

    Ids fall into ranges of about BIN_ROWS rows; the first id of each range is a guest at the end of the range before, so
    every row meets its successor inside one range and texts are shuffled once. Ids may be any whole numbers.
    """
    docs = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = id_ranges(docs.select("doc_id"), F.lit(1), BIN_ROWS) or [0]
    placed = (docs.withColumn("bin", range_of(ranges)).withColumn("first_id", first_of(ranges, "bin"))
              .withColumn("place", F.explode(F.expr(
                  f"if(doc_id = first_id, array(struct(bin as b, 0 as guest), struct(pmod(bin - 1, {len(ranges)}L) as b, 1 as guest)), "
                  "array(struct(bin as b, 0 as guest)))")))
              .select("doc_id", "th", "text", F.col("place.b").alias("b"), F.col("place.guest").alias("guest")))
    w = Window.partitionBy("b").orderBy("guest", "doc_id", "th")
    return (placed.select("*", *[F.lead(c).over(w).alias(f"next_{c[:4] if c == 'text' else c[-2:]}") for c in ("doc_id", "th", "text")])
            .where("guest = 0").drop("b", "guest"))


def edited_fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and of its edit, whose last half is the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is an
    empty one; texts without words have the empty fingerprint, which is like another empty one (1) and no other (0).
    Rows without doc_id have no place in the order and are left out. Rows that repeat a doc_id are ordered by text and
    each has its own row; of rows equal in id and text the signatures are equal too. Other columns are ignored.
    """
    pairs = with_next(documents)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    sides = (pairs.withColumn("edited", edited)
             .withColumn("n_chars", n.cast("long"))
             .withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
             .withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("text").alias("t")),
                                                   F.struct(F.lit(1).alias("s"), F.col("edited").alias("t")))))
             .select("doc_id", "th", "next_id", "next_th", "n_chars", "sha", F.col("side.s").alias("side"), F.col("side.t").alias("text")))
    keys = ["doc_id", "th", "next_id", "next_th", "n_chars", "sha", "side"]
    sig = store(signatures(sides, keys, samples))
    own = sig.where("side = 0").drop("side")
    other = sig.where("side = 1").select("doc_id", "th", "next_id", "next_th", F.col("sig").alias("edited_sig"))
    following = (own.select(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"), F.col("sig").alias("next_sig"))
                 .dropDuplicates(["next_id", "next_th"]))
    # the next text's signature is compared first, so that it is not shuffled again
    compared = (own.join(following, ["next_id", "next_th"])
                .withColumn("near_next", likeness("sig", "next_sig")).drop("next_sig"))
    return (compared.join(other, ["doc_id", "th", "next_id", "next_th"])
            .select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text("sig").alias("fingerprint"),
                    as_text("edited_sig").alias("edited_fingerprint"),
                    likeness("sig", "edited_sig").alias("near_edited"), "near_next"))
