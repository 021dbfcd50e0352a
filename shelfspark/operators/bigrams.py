"""Most likely next words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T

# Which heads are kept, and how many successors.
LEAST_HEAD, MOST_HEAD, SUCCESSORS = 100, 10_000_000, 20


def adjacent_pairs(fields: DataFrame) -> DataFrame:
    """``(token, next_token)`` of each text, in small letters, not stemmed; pairs never cross a text."""
    words = T.tokens(F.lower("text"))
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    return fields.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("token"), F.col("p.b").alias("next_token"))


def successor_counts(pairs: DataFrame) -> DataFrame:
    """``(token, next_token, n, head_freq)`` of the heads within the frequency limits."""
    counts = pairs.groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))
    heads = counts.groupBy("token").agg(F.sum("n").alias("head_freq")).where(F.col("head_freq").between(LEAST_HEAD, MOST_HEAD))
    return counts.join(heads, "token")


def top_successors(pairs: DataFrame, k: int = SUCCESSORS) -> DataFrame:
    """``(token, next_tokens)``: at most ``k``, most frequent first, ties by the greater word first."""
    w = Window.partitionBy("token").orderBy(F.desc("n"), F.desc("next_token"))
    ranked = successor_counts(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.groupBy("token").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "next_token"))), lambda x: x.next_token).alias("next_tokens"))


def save_successors(successors: DataFrame, path: str) -> None:
    """The table of :func:`top_successors`, sorted by token, so that a look-up reads one row group."""
    successors.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def next_words(spark: SparkSession, path: str, tokens: list[str]) -> dict[str, list[str]]:
    """The saved successors of a few tokens; a token without an entry is left out."""
    rows = spark.read.parquet(path).where(F.col("token").isin(tokens)).collect()  # at most a row a token
    return {r["token"]: r["next_tokens"] for r in rows}
