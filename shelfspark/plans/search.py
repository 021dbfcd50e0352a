"""Ranked keyword search over the index, for one query or many in one plan.

All steps are keyed by ``query_id``. First objects are ranked from the rarest keys' occurrences; only for the objects of
the page are spans and relevances of segments worked out. Occurrences of a segment are gathered in one array, which its
64 places bound, so one shuffle by segment serves weights, spans and relevance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import let
from shelfspark.operators.index import Index

#: Query terms are few; above this many rows they are joined by sorting instead of being copied to all executors.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class SearchConfig:
    """``compat`` keeps the quirks of the original: the last occurrence of each key is passed over, the last segment
    escapes the threshold, and the key that breaks the budget counts in the threshold."""

    max_words: int = 10
    max_keys: int = 5
    budget: int = 50_000_000
    trim: float = 0.5
    segments_per_object: int = 100
    compat: bool = False


DEFAULT = SearchConfig()


def idf(freq: Column) -> Column:
    return 1 / F.log(freq + 2.0)


def few(df: DataFrame, rows: int) -> DataFrame:
    """Copied to all executors where its rows are known to be few; else Catalyst chooses by size."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def query_frame(spark: SparkSession, queries: dict[int, list[str]], config: SearchConfig = DEFAULT) -> DataFrame:
    """``(query_id, key_idx, token)`` of the first words of each query; a repeated word keeps its first place."""
    rows = []
    for q, tokens in queries.items():
        first: dict[str, int] = {}
        for i, t in enumerate(tokens[:config.max_words]):
            first.setdefault(t, i)
        rows += [(q, i, t) for t, i in first.items()]
    frame = spark.createDataFrame(rows, "query_id int, key_idx int, token string")
    return few(frame, len(rows))


def query_terms(words: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The same of a table of ``(query_id, place, token)``, for any number of queries; null tokens are no words."""
    w = Window.partitionBy("query_id").orderBy("place")
    first = words.where(F.col("token").isNotNull()).withColumn("key_idx", F.row_number().over(w) - 1).where(F.col("key_idx") < config.max_words)
    return first.groupBy("query_id", "token").agg(F.min("key_idx").alias("key_idx")).select("query_id", "key_idx", "token")


def known_terms(terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, key_idx, token, freq, idf)`` of the words that the lexicon has."""
    return index.lexicon.join(terms, "token").select("query_id", "key_idx", "token", "freq", idf(F.col("freq")).alias("idf"))


def choose_keys(known: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The rarest keys within the budget: adds ``slot``, ``n_keys``, ``min_weight``, ``n_known``, ``known_idf``."""
    w = Window.partitionBy("query_id")
    order = w.orderBy("freq", "key_idx")
    rows = known.withColumns({
        "slot": F.row_number().over(order), "_sum": F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "n_known": F.count(F.lit(1)).over(w), "known_idf": F.sum("idf").over(w)}).where(F.col("slot") <= config.max_keys)
    fits = F.col("_sum") <= config.budget
    # Where the sum first breaks the budget stands the key that compat still counts in the threshold.
    counted = (F.col("_sum") - F.col("freq") <= config.budget) if config.compat else fits
    rows = rows.withColumn("min_weight", config.trim * F.sum(F.when(counted, F.col("idf"))).over(w)).where(fits)
    return rows.withColumn("n_keys", F.count(F.lit(1)).over(w)).drop("_sum")


def occurrences(
    keys: DataFrame, index: Index, objects: DataFrame | None = None, config: SearchConfig = DEFAULT, n_queries: int = 1,
) -> DataFrame:
    """Occurrences of the chosen keys, of the given objects (``object_id``, and ``query_id`` if it differs by query) only.

    ``n_queries`` is the number of queries, if it is known, else 2^31: up to a bound their keys are copied to all executors.
    """
    chosen = few(keys, n_queries * config.max_keys)
    occ = index.postings.select("token", "segment_id", "object_id", "pos", "weight").join(chosen, "token")
    if config.compat:
        last = occ.groupBy("query_id", "token").agg(F.max(F.struct("segment_id", "object_id", "pos", "weight")).alias("_last"))
        here = F.struct("segment_id", "object_id", "pos", "weight")
        occ = occ.join(few(last, n_queries * config.max_keys), ["query_id", "token"]).where((F.col("n_keys") == 1) | (here != F.col("_last"))).drop("_last")
    if objects is not None:
        occ = occ.join(objects, [c for c in ("query_id", "object_id") if c in objects.columns], "left_semi")
    return occ


def segment_matches(occ: DataFrame, config: SearchConfig = DEFAULT, n_queries: int = 1) -> DataFrame:
    """One row for each query and segment: ``occ`` (sorted array), ``uniq``, ``weight`` and the keys' constants, after the threshold."""
    rows = occ.groupBy("query_id", "segment_id", "object_id").agg(
        F.array_sort(F.collect_set(F.struct("pos", "weight", "key_idx", "slot", "idf", "token"))).alias("occ"),
        F.first("n_keys").alias("n_keys"), F.first("min_weight").alias("min_weight"),
        F.first("n_known").alias("n_known"), F.first("known_idf").alias("known_idf"))
    keys = F.array_sort(F.array_distinct(F.transform("occ", lambda o: F.struct(o.slot.alias("slot"), o.idf.alias("idf")))))
    rows = rows.withColumn("keys", keys).withColumns({
        "occ": F.when(F.col("n_keys") == 1, F.slice("occ", 1, 1)).otherwise(F.col("occ")),  # one key: its first place
        "uniq": F.size("keys"), "weight": F.aggregate("keys", F.lit(0.0), lambda a, k: a + k.idf)})
    passes = (F.col("n_keys") == 1) | (F.round(F.col("weight"), 12) >= F.round(F.col("min_weight"), 12))
    if config.compat:
        last = rows.groupBy("query_id").agg(F.max("segment_id").alias("_last_segment"))
        rows = rows.join(few(last, n_queries), "query_id")  # one row a query
        passes = passes | (F.col("segment_id") == F.col("_last_segment"))
        return rows.where(passes).drop("_last_segment")
    return rows.where(passes)


def best_span(occ: Column) -> Column:
    """``(len, from_pos, to_pos)`` of the shortest stretch with every key of the segment, of several the first."""
    slots = F.array_distinct(F.transform(occ, lambda o: o.slot))

    def span(start: Column, keys: Column) -> Column:
        ends = F.transform(keys, lambda k: F.array_min(F.transform(F.filter(occ, lambda o: (o.slot == k) & (o.pos >= start)), lambda o: o.pos)))
        return let(ends, lambda e: F.when(F.forall(e, lambda x: x.isNotNull()), F.struct(
            (F.array_max(e) - start + 1).alias("len"), start.alias("from_pos"), F.array_max(e).alias("to_pos"))))

    return let(slots, lambda keys: F.array_min(F.array_compact(F.transform(occ, lambda o: span(o.pos, keys)))))


def scored_segments(matches: DataFrame) -> DataFrame:
    return matches.withColumn("span", best_span(F.col("occ"))).withColumn(
        "score", F.col("weight") + F.col("uniq") / (1000.0 * F.col("span.len")))


def object_scores(segments: DataFrame) -> DataFrame:
    """``(query_id, object_id, score, matches_count)``."""
    n = F.count(F.lit(1))
    return segments.groupBy("query_id", "object_id").agg(
        (F.max("score") + F.sum("score") / n * F.log(1.0 + n) / 1e6).alias("score"), n.alias("matches_count"))


def ranked_page(scores: DataFrame, first: int, count: int) -> DataFrame:
    """The page of each query: adds ``rank`` (from 1) and ``total``. Near-equal scores are ordered by object."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.desc("object_id"))
    page = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first + count).where(F.col("rank") > first)
    totals = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, "query_id")


def rank(
    terms: DataFrame, index: Index, objects: DataFrame | None = None, config: SearchConfig = DEFAULT, n_queries: int = 1 << 31,
) -> tuple[DataFrame, DataFrame]:
    """Scored segments, and objects with their scores."""
    keys = choose_keys(known_terms(terms, index), config)
    segments = scored_segments(segment_matches(occurrences(keys, index, objects, config, n_queries), config, n_queries))
    return segments, object_scores(segments)


def rank_queries(
    spark: SparkSession, index: Index, queries: dict[int, list[str]], objects: DataFrame | None = None, config: SearchConfig = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """``rank`` of given queries: only the lexicon entries and postings of their words are read."""
    part = index.only([t for ts in queries.values() for t in ts[:config.max_words]])
    return rank(query_frame(spark, queries, config), part, objects, config, len(queries))


def refined(segments: DataFrame, page: DataFrame) -> DataFrame:
    """For the page's objects: occurrences within the best span, ``matched_words`` and ``relevance`` of each segment."""
    rows = segments.join(page.select("query_id", "object_id"), ["query_id", "object_id"], "left_semi")
    inside = F.filter("occ", lambda o: (o.pos >= F.col("span.from_pos")) & (o.pos <= F.col("span.to_pos")))
    rows = rows.withColumn("words", inside)
    keys = F.array_sort(F.array_distinct(F.transform("words", lambda o: F.struct(o.key_idx.alias("k"), o.idf.alias("idf")))))
    pairs = F.size(F.filter(F.transform("words", lambda o, i: F.get("words", i + 1).key_idx - o.key_idx), lambda x: x == 1))
    rows = rows.withColumns({"keys": keys, "pairs": pairs})
    norm = (F.aggregate("keys", F.lit(0.0), lambda a, k: a + k.idf) + 1e-7) / (F.col("known_idf") + 1e-7)
    order = F.when(F.col("n_known") > 1, 1.0 + F.col("pairs") / (F.col("n_known") - 1)).otherwise(2.0)
    cased = F.when(F.exists("words", lambda o: o.weight > 0), 1.1).otherwise(1.0)
    return rows.withColumns({"matched_words": F.size("keys"), "relevance": norm * order / F.col("span.len") * cased})


def top_segments(rows: DataFrame, limit: int) -> DataFrame:
    """The best segments of each object of the page, ``place`` 1 is the best."""
    order = Window.partitionBy("query_id", "object_id").orderBy(F.desc("matched_words"), F.desc(F.round("relevance", 12)), F.desc("segment_id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def search(
    spark: SparkSession, index: Index, queries: dict[int, list[str]], objects: DataFrame | None = None, first: int = 0, count: int = 10,
    config: SearchConfig = DEFAULT,
) -> DataFrame:
    """``(query_id, rank, object_id, score, matches_count, total, segments)``; segments are listed worst first, as the best come last.

    A query is a list of tokens as the index has them (:func:`shelfspark.operators.catalogue.query_tokens` makes them of a
    text). Only the words of the queries are read of the index. An empty frame of objects means: no restriction. Unknown words are passed over; a query of unknown words finds nothing.
    """
    if objects is not None and objects.isEmpty():
        objects = None
    segments, scores = rank_queries(spark, index, queries, objects, config)
    return results(segments, scores, first, count, config)


def results(segments: DataFrame, scores: DataFrame, first: int, count: int, config: SearchConfig = DEFAULT) -> DataFrame:
    """The page of ranked objects with their best segments."""
    page = ranked_page(scores, first, count)
    best = top_segments(refined(segments, page), config.segments_per_object)
    listed = best.groupBy("query_id", "object_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), F.struct(
            "segment_id", "matched_words", "relevance",
            F.transform("words", lambda w: F.struct(w.token.alias("token"), w.pos.alias("pos"))).alias("words")).alias("s")))),
        lambda x: x.s).alias("segments"))
    return page.join(listed, ["query_id", "object_id"]).select("query_id", "rank", "object_id", "score", "matches_count", "total", "segments")
