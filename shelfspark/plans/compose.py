"""Results as users see them: combined search, snippets, highlighting, digest, JSON."""

from __future__ import annotations

from dataclasses import dataclass, fields
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import catalogue as C
from shelfspark.operators.index import Index
from shelfspark.plans import search as S


@dataclass(frozen=True)
class Request:
    """A request; names as in its parameters. Numbers that cannot be read take their defaults."""

    q: str = ""
    start: int = 0
    len: int = 10
    obj_id: str = ""
    lib_section: str = ""
    title: str = ""
    author: str = ""
    udc: str = ""
    year: str = ""
    max_year: str = ""
    min_year: str = ""
    pages_count: str = ""
    max_pcount: str = ""
    min_pcount: str = ""
    snps: int = 1

    @staticmethod
    def from_mapping(params: Mapping[str, str]) -> Request:
        out = {}
        for f in fields(Request):
            if f.name in params:
                value = params[f.name]
                if f.name in ("start", "len", "snps"):
                    number = C.whole_number(value)
                    value = f.default if number is None else number
                out[f.name] = value
        return Request(**out)

    def facets(self) -> dict:
        return {"title": self.title, "author": self.author, "udc": self.udc, "year": self.year, "year_max": self.max_year, "year_min": self.min_year,
                "pages_count": self.pages_count, "pages_count_max": self.max_pcount, "pages_count_min": self.min_pcount, "lib_section": self.lib_section}


SEGMENTS = "array<struct<segment_id:bigint,matched_words:int,relevance:double,words:array<struct<token:string,pos:int>>>>"


def combined_search(
    spark: SparkSession, index: Index, records: DataFrame, request: Request, config: S.SearchConfig = S.DEFAULT, tokens: list[str] | None = None,
) -> DataFrame:
    """``(position, tier, object_id, score, matches_count, total, segments)``: mentions of author and title (tier 0), then texts (tier 1).

    Facets restrict both; within one object there are no mentions. Paging runs over both lists; an object may stand in both.
    ``total`` counts both lists (``compat``: of the mentions only those on this page).
    """
    return combined_parts(spark, index, records, request, config, tokens)[0]


def combined_parts(
    spark: SparkSession, index: Index, records: DataFrame, request: Request, config: S.SearchConfig = S.DEFAULT, tokens: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The joined list of :func:`combined_search`, and one row with the ``total``, which is there for an empty page too.

    One pass over the records counts what the facets allow and the mentions among it; all else stays lazy.
    """
    asked = C.facet_conditions(spark, **request.facets())
    one = C.whole_number(request.obj_id) if request.obj_id else None
    words = tokens if tokens is not None else C.query_tokens(spark, request.q) if request.q else []
    nothing = spark.createDataFrame([], f"position int, tier int, object_id long, score double, matches_count long, total long, segments {SEGMENTS}")
    no_total = spark.range(1).select(F.lit(0).cast("long").alias("total"))
    if not words:
        return nothing, no_total
    passes = F.lit(True)
    for a in asked:
        passes = passes & F.coalesce(a, F.lit(False))
    if one is not None and asked:
        passes = passes & (F.col("object_id") == one)
    score = C.mention_score(C.query_tokens(spark, request.q, 10))
    n_allowed, n_named = records.agg(F.count_if(passes), F.count_if(passes & score.isNotNull())).first()
    allowed = None
    if asked:
        if not n_allowed:
            return nothing, no_total
        allowed = records.where(passes).select("object_id")
    elif one is not None:
        allowed, n_allowed = spark.createDataFrame([(one,)], "object_id long"), 1
    if allowed is not None and n_allowed == 1:
        n_named = 0
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("object_id"))
    take = max(0, min(request.len, n_named - request.start))
    named = records.where(passes).select("object_id", score.alias("score")).where(F.col("score").isNotNull())
    top = named.orderBy(F.desc("score"), F.desc("object_id")).offset(min(request.start, n_named)).limit(take)
    named = top.withColumn("rank", F.row_number().over(order)).select(
        (F.col("rank") + request.start - 1).cast("int").alias("position"), F.lit(0).alias("tier"), "object_id",
        F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matches_count"), F.lit(None).cast(SEGMENTS).alias("segments"))
    first = max(0, request.start - n_named)
    segments, scores = S.rank_queries(spark, index, {0: words}, allowed, config)
    total = scores.agg((F.count(F.lit(1)) + (take if config.compat else n_named)).alias("total"))
    found = S.results(segments, scores, first, request.len - take, config)
    texts = found.select((F.col("rank") - 1 + n_named).cast("int").alias("position"), F.lit(1).alias("tier"), "object_id", "score", "matches_count", "segments")
    joined = named.unionByName(texts).crossJoin(F.broadcast(total))  # one row
    return joined.select("position", "tier", "object_id", "score", "matches_count", "total", "segments"), total


def snippet_texts(segment_ids: DataFrame, segments: DataFrame, fields_: DataFrame) -> DataFrame:
    """``segment_ids`` plus ``field_id`` and ``snippet``, the text of the segment."""
    return segment_ids.join(segments, "segment_id").join(fields_, ["object_id", "field_id"]).withColumn(
        "snippet", F.substring("text", F.col("seg_start") + 1, F.col("seg_length"))).drop("text")


def highlight(snippet: Column, positions: Column, open_: str = "<b>", close: str = "</b>") -> Column:
    """The snippet with the tokens at ``positions`` marked, on one line, with single quotes and single blanks."""
    gaps = F.regexp_extract_all(snippet, F.lit(f"([^{T.TOKEN_CLASS}]*)([{T.TOKEN_CLASS}]+|$)"), F.lit(1))
    words = F.regexp_extract_all(snippet, F.lit(f"([^{T.TOKEN_CLASS}]*)([{T.TOKEN_CLASS}]+|$)"), F.lit(2))
    marked = F.transform(words, lambda w, i: F.when(F.array_contains(positions, i) & (w != ""), F.concat(F.lit(open_), w, F.lit(close))).otherwise(w))
    joined = F.array_join(F.zip_with(gaps, marked, lambda g, w: F.concat(g, w)), "")
    return F.regexp_replace(F.replace(joined, F.lit('"'), F.lit("'")), r"\s+", " ")


def title_cases(snippet: Column, positions: Column) -> Column:
    """How many of the tokens at ``positions`` start with a capital."""
    words = T.tokens(snippet)
    return F.size(F.filter(positions, lambda p: F.get(words, p).rlike(f"^[{T.UPPER_CLASS}]")))


def page_snippets(found: DataFrame, index: Index, fields_: DataFrame, per_object: int = 1) -> DataFrame:
    """One row for each of the best ``per_object`` segments of each result: ``place``, ``field_id``, ``relevance``, ``snippet``, ``marked``."""
    best = found.select("query_id", "rank", "object_id", F.posexplode(F.slice(F.reverse("segments"), 1, per_object)).alias("place", "s"))
    rows = best.select("query_id", "rank", "object_id", "place", "s.segment_id", "s.relevance", "s.matched_words", F.transform("s.words", lambda w: w.pos).alias("positions"))
    texts = snippet_texts(rows, index.segments.drop("object_id", "segment_no"), fields_)
    return texts.withColumn("marked", highlight(F.col("snippet"), F.col("positions")))


def digest(found: DataFrame, index: Index, fields_: DataFrame, records: DataFrame, n_tokens: int) -> DataFrame:
    """Segments that hold every keyword close together, with the book: most capitals first, then weight, snippet, object."""
    rows = found.select("query_id", "object_id", F.explode("segments").alias("s")).select(
        "query_id", "object_id", "s.segment_id", "s.relevance", F.transform("s.words", lambda w: w.pos).alias("positions")).where(
        (F.size("positions") >= n_tokens) & (F.array_max("positions") - F.array_min("positions") + 1 <= n_tokens + 1))
    texts = snippet_texts(rows, index.segments.drop("object_id", "segment_no"), fields_)
    out = texts.withColumns({"cases": title_cases(F.col("snippet"), F.col("positions")), "marked": highlight(F.col("snippet"), F.col("positions"))})
    book = records.select("object_id", F.concat(F.lit("["), F.btrim(F.coalesce("author", F.lit(""))), F.lit(" "), F.coalesce("title", F.lit("")), F.lit("]")).alias("book"))
    return out.join(book, "object_id").select("query_id", "cases", "relevance", "marked", "object_id", "segment_id", "book").orderBy(
        F.desc("cases"), F.desc(F.round("relevance", 12)), F.desc("marked"), F.desc("object_id"))


def service(
    spark: SparkSession, index: Index, fields_: DataFrame, records: DataFrame, params: Mapping[str, str], config: S.SearchConfig = S.DEFAULT,
) -> DataFrame:
    """``(document)``: the answer to a request's parameters as one JSON document, of the joined list of mentions and texts.

    The query is tokenised here as the index was. An empty query, or facets that nothing passes, give a count of 0 and no
    results. A mention has no segments.
    """
    request = Request.from_mapping(params)
    joined, total = combined_parts(spark, index, records, request, config)
    return _document(joined, total, index, fields_, records, request.snps)


def _document(joined: DataFrame, total: DataFrame, index: Index, fields_: DataFrame, records: DataFrame, per_object: int) -> DataFrame:
    listed = joined.select(F.lit(0).alias("query_id"), F.col("position").alias("rank"), "object_id", "segments")
    snippets = page_snippets(listed, index, fields_, per_object).groupBy("rank").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", F.struct("field_id", F.round("relevance", 6).alias("weight"), F.col("marked").alias("snippet")).alias("s")))),
        lambda x: x.s).alias("top_segments"))
    book = records.select("object_id", F.struct(
        "title", "author", "udc", "year", F.lpad(F.col("object_id").cast("string"), 6, "0").alias("id"),
        F.col("pages_count").alias("pages count"), "lib_sections").alias("book"))
    rows = joined.drop("segments").join(snippets.withColumnRenamed("rank", "position"), "position", "left").join(book, "object_id", "left")
    empty = F.lit([]).cast("array<struct<field_id:string,weight:double,snippet:string>>")
    item = F.struct(F.col("position").alias("result_index"), "book", F.coalesce("top_segments", empty).alias("top_segments"),
                    F.round("score", 6).alias("cumul_relev"), F.col("matches_count").alias("segments_matched"))
    results = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("r")))), lambda x: x.r).alias("results"))  # a page
    return total.crossJoin(F.broadcast(results)).select(F.to_json(F.struct(F.col("total").alias("count"), "results")).alias("document"))  # one row each
