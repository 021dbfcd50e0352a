"""The queries of this subpackage over the test tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import chunking, cooccurrence, encoding, leakage, names, packing, pii, termfreq
from shelfspark.operators.index import first_loads
from shelfspark.plans.oracles import FIRST_LOADS
from shelfspark.session import cut_lineage, load

WORDS = "[0-9A-Za-zА-Яа-яЁё]+"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized(load(spark, d, "object_fields"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(load(spark, d, "object_fields"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text give when laid end to end without their overlaps, and how many are over the limit."""
    pieces = chunking.chunk_texts(load(spark, d, "object_fields"))
    new = F.substring("piece", F.col("new_from") - F.col("start") + 1, F.length("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))), lambda x: x.t), "")
    return pieces.groupBy("row_id").agg(F.md5(whole).alias("digest"), F.count_if(F.col("n_tokens") > chunking.MAX_TOKENS).alias("too_long"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.as_found(cooccurrence.strong(cooccurrence.token_associations(load(spark, d, "token_pairs"), 5), 5, 50))


def p3_associations(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.token_associations(load(spark, d, "token_pairs"), 5).withColumn("lift", F.round("lift", 6))


def p3_all_associations(spark: SparkSession, d: str) -> DataFrame:
    """The full report: every pair that shares a row, also those under the five of ``p3_associations``."""
    return cooccurrence.token_associations(load(spark, d, "token_pairs")).withColumn("lift", F.round("lift", 6))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_cells({
        "catalogue": (load(spark, d, "catalogue"), ["title", "author"]),
        "object_fields": (load(spark, d, "object_fields"), ["field_value"])})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("table_name", "row_id", "column_name").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def _authors(spark: SparkSession, d: str) -> DataFrame:
    """Sound spellings: garbled cells (problem 5) are left out."""
    catalogue = load(spark, d, "catalogue")
    authors = catalogue.where(F.col("author").isNotNull()).groupBy("author").agg(F.count(F.lit(1)).alias("rows"))
    counts = encoding.bigram_counts(encoding.cells_of({"catalogue": (catalogue, ["title", "author"])}))
    # Little data but much work a row: not to be merged into one task.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = authors.select("author", F.col("author").alias("text")).repartitionById(n, F.pmod(F.xxhash64("author"), F.lit(n)).cast("int"))
    garbled = encoding.repaired(spread, counts).select("author")
    return catalogue.select("author").join(garbled, "author", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(names.linked_names(_authors(spark, d)))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_names(_authors(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_marks(load(spark, d, "index_chunks")).where(F.col("mark").isNotNull()).select("token", "mark")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_marks(load(spark, d, "index_chunks"))


def _field_words(spark: SparkSession, d: str) -> DataFrame:
    return first_loads(load(spark, d, "object_fields")).select(
        "object_id", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)).alias("words"))


def p7_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of up to three words of the indexed texts that occur five times or more; records are objects."""
    return termfreq.ngram_counts(_field_words(spark, d), "words", "object_id").withColumn("ngram", F.translate("ngram", termfreq.SEPARATOR, " "))


def p7_ngram_marks(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to three words of the indexed texts, the rare and the common ones marked; records are objects."""
    return termfreq.ngram_marks(_field_words(spark, d), "words", "object_id").withColumn("ngram", F.translate("ngram", termfreq.SEPARATOR, " "))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(load(spark, d, "documents")))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row: the documents placed, and how many containers or documents break a rule."""
    docs = load(spark, d, "documents")
    packed = cut_lineage(packing.pack(docs))
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    split = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    letters = docs.select("doc_id", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")).alias("letters")).where("letters <> ''")
    copies = packed.join(letters, "doc_id").groupBy("container_id", "letters").agg(F.countDistinct("doc_id").alias("k")).where("k > 1")
    return split.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("split_needlessly"),
        F.count_if(F.col("tokens") != F.col("end")).alias("not_whole"),
    ).crossJoin(bins.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))).crossJoin(copies.agg(F.count(F.lit(1)).alias("copies_together")))  # one row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item, the documents that hold it and the longest stretch."""
    found = leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("n_words").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_entities(load(spark, d, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The key comes from the session; without one a key is drawn for this run, and no other run gives the same replacements."""
    return pii.redacted(load(spark, d, "documents"), spark.conf.get("spark.shelfspark.pii.key", None) or secrets.token_hex(32))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_pieces, p2_rebuilt, p3_found, p3_associations, p3_all_associations, p5_found, p5_repaired, p6_found, p6_entities, p7_found, p7_terms, p7_ngrams, p7_ngram_marks,
    p8_containers, p8_fill, p8_checked, p9_found, p9_report, p10_found, p10_redacted)}

_P3 = """
WITH r AS (SELECT DISTINCT object_id, field_id, pair_no, token, next_token FROM token_pairs WHERE next_token IS NOT NULL),
n AS (SELECT count(*) AS n_total FROM r),
m AS (SELECT t, count(*) AS c FROM (SELECT token AS t FROM r WHERE token IS NOT NULL UNION ALL
      SELECT next_token FROM r WHERE next_token IS DISTINCT FROM token) GROUP BY t),
p AS (SELECT least(token, next_token) AS item_a, greatest(token, next_token) AS item_b, count(*) AS n_ab
      FROM r WHERE token <> next_token GROUP BY 1, 2)
SELECT p.item_a, p.item_b, n_ab, x.c AS n_a, y.c AS n_b, n_total, round(n_ab * n_total / (CAST(x.c AS DOUBLE) * y.c), 6) AS lift
FROM p JOIN m x ON x.t = item_a JOIN m y ON y.t = item_b CROSS JOIN n WHERE n_ab >= 5"""

_P7 = """
WITH c AS (SELECT token, unnest(token_codes) AS code FROM index_chunks),
o AS (SELECT count(DISTINCT (code >> 8) & 1048575) AS n_objects FROM c),
k AS (SELECT token, count(DISTINCT code) AS frequency, count(DISTINCT (code >> 8) & 1048575) AS objects FROM c WHERE token IS NOT NULL GROUP BY token),
f AS (SELECT token, CAST(sum(token_freq) AS BIGINT) AS declared_freq FROM index_chunks WHERE token IS NOT NULL GROUP BY token)
SELECT f.token, coalesce(frequency, 0) AS frequency, coalesce(objects, 0) AS objects, declared_freq, n_objects,
CASE WHEN coalesce(frequency, 0) < 5 THEN 'rare' WHEN coalesce(objects, 0) * 100 >= n_objects * 40 THEN 'common' END AS mark
FROM f LEFT JOIN k USING (token) CROSS JOIN o"""

ORACLES = {
    "p2_found": f"SELECT row_id FROM object_fields WHERE len(regexp_extract_all(field_value, '{WORDS}')) > 512",
    "p2_rebuilt": "SELECT row_id, md5(field_value) AS digest, 0 AS too_long FROM object_fields WHERE field_value IS NOT NULL",
    "p8_checked": "SELECT count(DISTINCT doc_id) AS documents, 0 AS split_needlessly, 0 AS not_whole, 0 AS overfull, 0 AS copies_together FROM documents",
    "p3_found": f"SELECT item_a AS token_a, item_b AS token_b FROM ({_P3}) WHERE n_ab * n_total >= 50 * n_a * n_b",
    "p3_associations": _P3,
    "p3_all_associations": _P3.removesuffix(" WHERE n_ab >= 5"),
    "p7_found": f"SELECT token, mark FROM ({_P7}) WHERE mark IS NOT NULL",
    "p7_terms": _P7,
    "p7_ngrams": f"""
WITH {FIRST_LOADS}, w AS (SELECT object_id, regexp_extract_all(lower(text), '{WORDS}') AS ws FROM f WHERE text IS NOT NULL),
g AS (SELECT object_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
n AS (SELECT object_id, unnest([1, 2, 3]) AS n, ws, i FROM g)
SELECT array_to_string(ws[i:i + n - 1], ' ') AS ngram, CAST(n AS INTEGER) AS n, count(*) AS frequency, count(DISTINCT object_id) AS records
FROM n WHERE i + n - 1 <= len(ws) GROUP BY 1, 2 HAVING count(*) >= 5""",
}
ORACLES["p7_ngram_marks"] = f"""
WITH a AS ({ORACLES["p7_ngrams"].removesuffix(" HAVING count(*) >= 5")}),
{FIRST_LOADS}, t AS (SELECT count(DISTINCT object_id) AS n_records FROM f WHERE len(regexp_extract_all(text, '{WORDS}')) > 0)
SELECT a.*, n_records, CASE WHEN frequency < 5 THEN 'rare' WHEN records * 100 >= n_records * 40 THEN 'common' END AS mark FROM a CROSS JOIN t"""
