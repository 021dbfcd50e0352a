"""Building the positional index: segments, postings, lexicon; packed codes; ranges of segments."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.session import cut_lineage

# Which frequencies are indexed, and the layout of a packed occurrence.
LEAST_FREQ, MOST_FREQ = 5, 30_000_000
WEIGHT_BITS, POS_BITS, OBJECT_BITS = 2, 6, 20
#: Rows of a bucket of a saved index, and of one of its files; more tokens of a query than that are joined, not listed.
BUCKET_ROWS, FILE_ROWS, LISTED_TOKENS = 20_000_000, 5_000_000, 1000


@dataclass(frozen=True)
class Index:
    """``lexicon(token, freq)``, ``postings(token, segment_id, object_id, pos, weight)``, ``segments(segment_id, object_id, field_id,
    segment_no, seg_start, seg_length)``: lazy, whether built from texts or read from a folder.

    ``buckets`` is the number of token buckets of a saved index, whose lexicon and postings have a ``bucket`` column.
    """

    lexicon: DataFrame
    postings: DataFrame
    segments: DataFrame
    buckets: int | None = None

    def save(self, path: str, bucket_rows: int = BUCKET_ROWS, file_rows: int = FILE_ROWS) -> None:
        """Postings by bucket of tokens, sorted by token and place, so that a look-up reads few folders and few row groups.

        The number of buckets follows the number of postings. Files are cut by ranges of (bucket, token, segment), so a
        token that holds most rows fills many files, and every file is about ``file_rows`` long.
        """
        rows = self.lexicon.agg(F.sum("freq")).first()[0] or 0
        buckets = max(1, math.ceil(rows / bucket_rows))
        lexicon = self.lexicon.select("token", "freq", token_bucket(F.col("token"), buckets).alias("bucket"))
        order = ["bucket", "token", "segment_id", "pos", "object_id", "weight"]
        postings = self.postings.select("token", "segment_id", "object_id", "pos", "weight").withColumn("bucket", token_bucket(F.col("token"), buckets))
        files = max(1, math.ceil(rows / file_rows))
        (postings.repartitionByRange(files, *order).sortWithinPartitions(*order)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
        lexicon.repartitionByRange(max(1, files // 10), "token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/lexicon")
        self.segments.write.mode("overwrite").parquet(f"{path}/segments")
        self.lexicon.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{x}") for x in ("lexicon", "postings", "segments")], spark.read.parquet(f"{path}/layout").first()[0])

    def only(self, tokens: list[str]) -> Index:
        """The part of the index that a few tokens need: their names, and on a saved index their buckets, as literals that
        prune folders and row groups. Many tokens restrict nothing here; they are joined."""
        tokens = sorted(set(tokens))
        if len(tokens) > LISTED_TOKENS:
            return self
        wanted = F.col("token").isin(tokens)
        postings = self.postings.where(wanted)
        if self.buckets is not None:
            spark = self.postings.sparkSession
            numbers = spark.range(1).select(F.array(*[token_bucket(F.lit(t), self.buckets) for t in tokens])).first()[0] if tokens else []
            postings = self.postings.where(F.col("bucket").isin(sorted(set(numbers))) & wanted)
        return replace(self, lexicon=self.lexicon.where(wanted), postings=postings)

    def postings_of(self, tokens: list[str]) -> DataFrame:
        """Postings of a few tokens."""
        return self.only(tokens).postings


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def pack(segment: Column, obj: Column, pos: Column, weight: Column) -> Column:
    """One long from the four parts; an object id that does not fit its 20 bits fails loudly instead of spoiling others."""
    low = WEIGHT_BITS + POS_BITS
    packed = F.shiftleft(segment.cast("long"), low + OBJECT_BITS) + F.shiftleft(obj.cast("long"), low) + F.shiftleft(pos.cast("long"), WEIGHT_BITS) + weight
    return F.when(obj >= 1 << OBJECT_BITS, F.raise_error(F.lit("object id has more than 20 bits"))).otherwise(packed)


def unpack(code: Column) -> dict[str, Column]:
    low = WEIGHT_BITS + POS_BITS
    return {
        "segment_id": F.shiftright(code, low + OBJECT_BITS),
        "object_id": F.shiftright(code, low).bitwiseAND((1 << OBJECT_BITS) - 1),
        "pos": F.shiftright(code, WEIGHT_BITS).bitwiseAND((1 << POS_BITS) - 1).cast("int"),
        "weight": code.bitwiseAND((1 << WEIGHT_BITS) - 1).cast("int"),
    }


def first_loads(rows: DataFrame) -> DataFrame:
    """``(object_id, field_id, text)``: the first load of each field of the crawled rows; null texts stay null."""
    return rows.groupBy("object_id", "field_id").agg(
        F.min_by("field_value", F.struct("loaded_at", "row_id")).alias("text"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, without ever putting all rows into one task.

    Rows are range-partitioned and sorted, numbered within their partition and written to the checkpoint folder; only the
    row counts of the partitions, as many as there are partitions, come to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dict(rows.groupBy(part.alias("p")).agg((F.max(at) + 1).alias("n")).collect())
    offsets, total = [0] * (max(sizes, default=-1) + 1), 0
    for p in range(len(offsets)):
        offsets[p] = total
        total += sizes.get(p, 0)
    base = F.lit(offsets or [0])[part.cast("int")].cast("long")
    return rows.withColumn(name, base + at).drop("_at")


def segments_with_words(fields: DataFrame) -> DataFrame:
    """Segments numbered in the order of object, field and place, each with its words."""
    rows = T.segment_rows(fields, ["object_id", "field_id"], "text")
    return numbered(rows, ["object_id", "field_id", "segment_no"], "segment_id")


def raw_occurrences(segments: DataFrame) -> DataFrame:
    """One row for each word of each segment, as written."""
    return segments.select("segment_id", "object_id", F.explode("words").alias("w")).select(
        F.col("w.word").alias("word"), "segment_id", "object_id", F.col("w.pos").alias("pos"), T.case_fast(F.col("w.word")).alias("weight"))


def build_index(fields: DataFrame, least: int = LEAST_FREQ, most: int = MOST_FREQ) -> Index:
    """The index of ``(object_id, field_id, text)`` rows. Words are normalised once each, not once an occurrence.

    The vocabulary join is left to Catalyst, which broadcasts it only below its own size limit and else sorts and merges.
    """
    segments = segments_with_words(fields)
    occurrences = raw_occurrences(segments)
    vocabulary = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", T.normalise(F.col("word")).alias("token"))
    lexicon = vocabulary.groupBy("token").agg(F.sum("n").alias("freq")).where(F.col("freq").between(least, most))
    kept = vocabulary.join(lexicon.select("token"), "token", "left_semi").select("word", "token")
    postings = occurrences.join(kept, "word").select("token", "segment_id", "object_id", "pos", "weight")
    return Index(lexicon, postings, segments.drop("words"))


def index_from_tables(postings: DataFrame, segments: DataFrame, least: int = LEAST_FREQ, most: int = MOST_FREQ) -> Index:
    """An index over postings that exist already; segments posted twice count once."""
    once = postings.select("token", "segment_id", "object_id", "pos", "weight").distinct()
    lexicon = once.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq").between(least, most))
    return Index(lexicon, once.join(lexicon.select("token"), "token", "left_semi"), segments)


def object_ranges(segments: DataFrame) -> DataFrame:
    """``(object_id, first_segment, end_segment)``; the end is exclusive."""
    return segments.groupBy("object_id").agg(F.min("segment_id").alias("first_segment"), (F.max("segment_id") + 1).alias("end_segment"))


def segment_owners(ids: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(segment_id, object_id)``: the object whose range begins last at or before each segment id (an as-of look-up).

    Ids and range starts are sorted together within blocks of ids, and the last start is carried forward; each block also
    gets the last start before it, so blocks need nothing of each other.
    """
    width = 1 << 20
    block = F.floor(F.col("at") / width)
    starts = ranges.select(F.col("first_segment").alias("at"), "object_id", F.lit(0).alias("is_id"))
    wanted = ids.select(F.col("segment_id").alias("at"), F.lit(None).cast("long").alias("object_id"), F.lit(1).alias("is_id")).distinct()
    rows = starts.unionByName(wanted).withColumn("block", block)
    # The last start of each block, carried over the blocks: one row a block, a millionth of the ids.
    last = rows.where("is_id = 0").groupBy("block").agg(F.max_by("object_id", "at").alias("last"))
    carried = rows.select("block").distinct().join(last, "block", "left").select(
        "block", F.last("last", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("block").orderBy("at", "is_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, "block").withColumn("owner", F.coalesce(F.last("object_id", True).over(w), F.col("before"))).where(
        "is_id = 1").select(F.col("at").alias("segment_id"), F.col("owner").alias("object_id"))


def top_terms(lexicon: DataFrame, n: int = 800) -> DataFrame:
    return lexicon.orderBy(F.desc("freq"), F.desc("token")).limit(n)


def frequency_bands(lexicon: DataFrame, bands: tuple[int, ...] = (500_000, 1_000_000)) -> DataFrame:
    return lexicon.agg(F.count(F.lit(1)).alias("tokens"), F.sum("freq").alias("occurrences"), *[
        F.count_if(F.col("freq") > b).alias(f"above_{b}") for b in bands])


def index_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(F.max("object_id").alias("max_object_id"), F.count(F.lit(1)).alias("segments"))
