"""Queries of the core over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import balance, bigrams
from shelfspark.operators import catalogue as C
from shelfspark.operators import index as I
from shelfspark.plans import batch as B
from shelfspark.plans import compose as P
from shelfspark.plans import search as S
from shelfspark.plans.oracles import ORACLES, WORDS  # noqa: F401
from shelfspark.session import checkpoint_root, load
from shelfspark.sources import crawled, delivered_lines


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that hold at least 1.5 % of all rows of ``postings``."""
    return balance.hot_keys(load(spark, d, "postings"), "token", "object_id", ["segment_id", "pos", "weight"], 15).select("token")


def p1_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return balance.balanced_key_stats(load(spark, d, "postings"), "token", "object_id", ["segment_id", "pos", "weight"])


def p1_merged_codes(spark: SparkSession, d: str) -> DataFrame:
    """Checked by sums: how a token's codes fall into fragments depends on the number of tasks."""
    return balance.merged_codes(load(spark, d, "index_chunks")).groupBy("token").agg(
        F.sum("n_codes").cast("long").alias("n_codes"), F.min(F.element_at("codes", 1)).alias("first_code"),
        F.max(F.element_at("codes", -1)).alias("last_code"))


def p1_weighted_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings joined to their token's declared frequency, heavy tokens split, the lexicon copied to their shards only."""
    lexicon = load(spark, d, "index_chunks").groupBy("token").agg(F.sum("token_freq").alias("declared_freq"))
    return balance.fragment_replicate_join(load(spark, d, "postings"), lexicon, "token", ["segment_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivered_lines.rejected_lines(load(spark, d, "catalogue_raw"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return delivered_lines.loaded_lines(load(spark, d, "catalogue_raw"))


# ---------------------------------------------------------------------------------------------- text and index


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return I.first_loads(load(spark, d, "object_fields"))


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = T.segment_rows(_fields(spark, d), ["object_id", "field_id"], "text")
    return rows.select("object_id", "field_id", "segment_no", F.explode("words").alias("w")).select(
        "object_id", "field_id", (F.col("segment_no") * T.SEGMENT_TOKENS + F.col("w.pos")).alias("i"), F.col("w.start").alias("start"),
        F.col("w.length").alias("length"), F.col("w.word").alias("word"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _token_rows(spark, d)


def token_case(spark: SparkSession, d: str) -> DataFrame:
    words = _token_rows(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", T.case_fast(F.col("word")).alias("case_fast"), T.case_rich(F.col("word")).alias("case_rich"))


def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _token_rows(spark, d).select("word").distinct().select("word", T.normalise(F.col("word")).alias("token"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return I.segments_with_words(_fields(spark, d)).drop("words")


def segment_span(spark: SparkSession, d: str) -> DataFrame:
    """Text of each segment."""
    rows = T.segment_rows(_fields(spark, d), ["object_id", "field_id"], "text").drop("words")
    return rows.join(_fields(spark, d), ["object_id", "field_id"]).select(
        "object_id", "field_id", "segment_no", F.substring("text", F.col("seg_start") + 1, F.col("seg_length")).alias("snippet"))


def occurrence_pack(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "postings")
    return p.select("token", I.pack(*[F.col(c) for c in ("segment_id", "object_id", "pos", "weight")]).alias("code"))


def occurrence_unpack(spark: SparkSession, d: str) -> DataFrame:
    codes = load(spark, d, "index_chunks").select("chunk_id", F.explode("token_codes").alias("code"))
    return codes.select("chunk_id", "code", *[c.alias(n) for n, c in I.unpack(F.col("code")).items()])


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(_fields(spark, d), least=1).lexicon


def lexicon_pruned(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(_fields(spark, d)).lexicon


def postings(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(_fields(spark, d)).postings


def _index(spark: SparkSession, d: str) -> I.Index:
    return I.index_from_tables(load(spark, d, "postings"), load(spark, d, "segments"))


def object_segment_range(spark: SparkSession, d: str) -> DataFrame:
    return I.object_ranges(load(spark, d, "segments"))


def segments_of_object(spark: SparkSession, d: str) -> DataFrame:
    ranges = I.object_ranges(load(spark, d, "segments"))
    return ranges.select("object_id", F.explode(F.sequence("first_segment", F.col("end_segment") - 1)).alias("segment_id"))


def segment_owner_asof(spark: SparkSession, d: str) -> DataFrame:
    return I.segment_owners(load(spark, d, "postings").select("segment_id"), I.object_ranges(load(spark, d, "segments")))


def lexicon_top800(spark: SparkSession, d: str) -> DataFrame:
    return I.top_terms(_index(spark, d).lexicon)


def lexicon_freq_bands(spark: SparkSession, d: str) -> DataFrame:
    return I.frequency_bands(_index(spark, d).lexicon)


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.index_stats(load(spark, d, "segments"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return bigrams.adjacent_pairs(_fields(spark, d)).groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))


def bigram_top20(spark: SparkSession, d: str) -> DataFrame:
    return bigrams.top_successors(bigrams.adjacent_pairs(_fields(spark, d)))


# ---------------------------------------------------------------------------------------------------- ranked search

SMALL_BUDGET = S.SearchConfig(budget=3000, compat=True)
COMPAT = S.SearchConfig(compat=True)


def _terms(spark: SparkSession) -> DataFrame:
    return S.query_frame(spark, WORDS)


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.known_terms(_terms(spark), _index(spark, d)).withColumn("idf", F.round("idf", 6))


def _key_columns(keys: DataFrame) -> DataFrame:
    return keys.select("query_id", "key_idx", "slot", "token", "n_keys", "n_known", F.round("min_weight", 6).alias("min_weight"), F.round("known_idf", 6).alias("known_idf"))


def key_selection(spark: SparkSession, d: str) -> DataFrame:
    return _key_columns(S.choose_keys(S.known_terms(_terms(spark), _index(spark, d))))


def key_budget(spark: SparkSession, d: str) -> DataFrame:
    """With a small budget, so that it decides; the key that breaks it counts in the threshold (compat)."""
    return _key_columns(S.choose_keys(S.known_terms(_terms(spark), _index(spark, d)), SMALL_BUDGET))


def _matches(spark: SparkSession, d: str, trim: float = 0.5) -> DataFrame:
    config = S.SearchConfig(trim=trim)
    index = _index(spark, d).only([t for ts in WORDS.values() for t in ts])
    return S.segment_matches(S.occurrences(S.choose_keys(S.known_terms(_terms(spark), index), config), index, n_queries=len(WORDS)), config)


def segment_simple_weight(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.0).select("query_id", "segment_id", "object_id", "uniq", F.round("weight", 6).alias("weight"))


def crude_filter(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("query_id", "segment_id", "object_id", "uniq", F.round("weight", 6).alias("weight"))


def segment_shortest_span(spark: SparkSession, d: str) -> DataFrame:
    return S.scored_segments(_matches(spark, d)).select("query_id", "segment_id", "span.len", "span.from_pos", "span.to_pos")


def segment_score(spark: SparkSession, d: str) -> DataFrame:
    return S.scored_segments(_matches(spark, d)).select("query_id", "segment_id", "object_id", F.round("score", 6).alias("score"))


def object_score(spark: SparkSession, d: str) -> DataFrame:
    return S.object_scores(S.scored_segments(_matches(spark, d))).withColumn("score", F.round("score", 6))


def _page(spark: SparkSession, d: str, queries: dict, first: int = 0, count: int = 10, objects: DataFrame | None = None, config=S.DEFAULT) -> DataFrame:
    _, scores = S.rank_queries(spark, _index(spark, d), queries, objects, config)
    return S.ranked_page(scores, first, count).select("query_id", "rank", "object_id", F.round("score", 6).alias("score"), "matches_count", "total")


def search_top_objects(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, {0: WORDS[0]})


def search_single_term(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, {1: WORDS[1]})


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    recent = C.catalogue_records(load(spark, d, "catalogue")).where("year >= 2000").select("object_id")
    return _page(spark, d, {0: WORDS[0]}, objects=recent)


def search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, {0: WORDS[0]}, first=10)


def search_compat(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, WORDS, config=COMPAT)


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """The first five words of every fiftieth segment as a query each, against all postings, in one plan."""
    postings = load(spark, d, "postings")
    words = postings.where("segment_id % 50 = 0 AND pos < 5").select(F.col("segment_id").alias("query_id"), F.col("pos").alias("place"), "token").distinct()
    index = I.Index(B.counted_lexicon(postings), postings, load(spark, d, "segments"))  # blocks need no distinct rows
    return B.best_of_queries(S.query_terms(words), index).withColumn("score", F.round("score", 6))


def search_words(spark: SparkSession, d: str) -> DataFrame:
    """Several given queries in one plan."""
    return _page(spark, d, WORDS)


def search_saved(spark: SparkSession, d: str) -> DataFrame:
    """The same on an index that is saved first, several buckets wide, of which only the words' own buckets are read."""
    path = f"{checkpoint_root(spark)}/saved-index-{uuid.uuid4().hex}"
    _index(spark, d).save(path, bucket_rows=10_000, file_rows=50_000)
    _, scores = S.rank_queries(spark, I.Index.load(spark, path), WORDS)
    return S.ranked_page(scores, 0, 10).select("query_id", "rank", "object_id", F.round("score", 6).alias("score"), "matches_count", "total")


def _refined(spark: SparkSession, d: str) -> DataFrame:
    segments_, scores = S.rank_queries(spark, _index(spark, d), WORDS)
    return S.refined(segments_, S.ranked_page(scores, 0, 10))


def span_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _refined(spark, d).select("query_id", "segment_id", F.explode("words").alias("w")).select(
        "query_id", "segment_id", F.col("w.pos").alias("pos"), F.col("w.key_idx").alias("key_idx"), F.col("w.token").alias("token"), F.col("w.weight").alias("weight"))


def segment_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _refined(spark, d).select("query_id", "object_id", "segment_id", "matched_words", F.round("relevance", 6).alias("relevance"))


def top_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.top_segments(_refined(spark, d), 3).select("query_id", "object_id", "segment_id", "place", "matched_words", F.round("relevance", 6).alias("relevance"))


def search_full(spark: SparkSession, d: str) -> DataFrame:
    """Results with their segments, worst first, flattened."""
    found = S.search(spark, _index(spark, d), WORDS)
    return found.select("query_id", "rank", "object_id", F.posexplode("segments").alias("n", "s")).select(
        "query_id", "rank", "object_id", "n", "s.segment_id", "s.matched_words", F.round("s.relevance", 6).alias("relevance"),
        F.array_join(F.transform("s.words", lambda w: F.concat_ws(":", w.token, w.pos.cast("string"))), " ").alias("words"))


# -------------------------------------------------------------------------------------------------------- catalogue


def _records(spark: SparkSession, d: str) -> DataFrame:
    return C.catalogue_records(load(spark, d, "catalogue"))


def catalogue_load(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("object_id", "title", "author", "udc", "year", "pages_count", "udc_key")


def title_and(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), title="Сплав, по")[1].select("object_id")


def year_range(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), year_max="2010", year_min=1990)[1].select("object_id", "year")


def year_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Unparsable years count as -1 and pass an upper bound."""
    return C.facet_filter(_records(spark, d), year_max=1950)[1].select("object_id", "year")


def udc_prefix(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), udc="66.2")[1].union(C.facet_filter(_records(spark, d), udc="55")[1]).select("object_id", "udc")


def author_surname(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("object_id", "author", "surname")


def author_equal(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), author="К. Т. Булубанский")[1].select("object_id")


def pages_range(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), pages_count_max=200, pages_count_min=100)[1].select("object_id", "pages_count")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return delivered_lines.loaded_lines(load(spark, d, "catalogue_raw"))


def lib_section_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d)
    return rows.select("line_id", F.posexplode(C.section_codes([F.col(f"section_{i}") for i in (1, 2, 3)])).alias("level", "section_code"))


def lib_section_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), lib_section="418533012")[1].select("object_id")


def section_collisions(spark: SparkSession, d: str) -> DataFrame:
    return C.section_collisions(_sections(spark, d))


def facet_and(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_filter(_records(spark, d), title="и", year_min=1980, pages_count_max="300", udc="")[1].select("object_id")


def plain_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Lines split without quoting, as the original reads them."""
    lines = load(spark, d, "catalogue_raw").where(F.col("raw_line").isNotNull())
    return crawled.plain_catalogue(lines, "raw_line").select("object_id", "year", "udc", "pages_count", "author", "title")


def mention_rank(spark: SparkSession, d: str) -> DataFrame:
    return C.mentions(_records(spark, d), "Булубанский теория сплав")


# ------------------------------------------------------------------------------------------------------ composition


def combined_search(spark: SparkSession, d: str) -> DataFrame:
    """Two pages that run over the end of the mentions."""
    out = None
    for start in (0, 8):
        request = P.Request(q="теория сплав", min_year="1960", start=start, len=8)
        page = P.combined_search(spark, _index(spark, d), _records(spark, d), request, tokens=["teoriya", "splav"]).select(
            F.lit(start).alias("start"), "position", "tier", "object_id", F.round("score", 6).alias("score"), "matches_count", "total")
        out = page if out is None else out.unionByName(page)
    return out


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, I.Index, DataFrame]:
    index = _index(spark, d)
    return S.search(spark, index, {0: WORDS[0], 1: WORDS[1]}), index, _fields(spark, d)


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return P.page_snippets(*_found(spark, d), 2).select("query_id", "object_id", "place", "field_id", "segment_id", "snippet")


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return P.page_snippets(*_found(spark, d), 2).select("query_id", "object_id", "place", "marked")


def digest(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    found = S.search(spark, index, {0: ["the", "of"]}, count=100)
    return P.digest(found, index, _fields(spark, d), _records(spark, d), 2).select("query_id", "cases", F.round("relevance", 6).alias("relevance"), "marked", "object_id", "segment_id", "book")


def service_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON document of a request, taken apart again. The page runs over the end of the mentions."""
    document = P.service(spark, _index(spark, d), _fields(spark, d), _records(spark, d), {"q": "Сплав, на", "min_year": "1960", "start": "2", "len": "8", "snps": "2"})
    schema = ("count long, results array<struct<result_index:int,book:struct<title:string,author:string,id:string>,"
              "top_segments:array<struct<field_id:string,weight:double,snippet:string>>,cumul_relev:double,segments_matched:long>>")
    return document.select(F.from_json("document", schema).alias("x")).select(F.col("x.count").alias("total"), F.explode("x.results").alias("r")).select(
        "total", "r.result_index", "r.book.id", "r.book.title", "r.cumul_relev", "r.segments_matched", F.transform("r.top_segments", lambda s: s.snippet).alias("snippets"))


def bigram_sink(spark: SparkSession, d: str) -> DataFrame:
    """Successors written to a folder and read again."""
    path = f"{checkpoint_root(spark)}/bigrams-{uuid.uuid4().hex}"
    bigrams.save_successors(bigram_top20(spark, d), path)
    return spark.read.parquet(path)


QUERIES = {f.__name__: f for f in (
    p1_found, p1_token_stats, p1_merged_codes, p1_weighted_postings, p4_found, p4_loaded,
    tokenize, token_case, normalize_tokens, segments, segment_span, occurrence_pack, occurrence_unpack, lexicon, lexicon_pruned, postings,
    object_segment_range, segments_of_object, segment_owner_asof, lexicon_top800, lexicon_freq_bands, index_stats, bigram_counts, bigram_top20,
    query_terms, key_selection, key_budget, segment_simple_weight, crude_filter, segment_shortest_span, segment_score, object_score,
    search_top_objects, search_single_term, search_filtered, search_page2, search_compat, search_words, search_saved, search_batch, span_occurrences, segment_relevance,
    top_segments, search_full, catalogue_load, title_and, year_range, year_unknown, udc_prefix, author_surname, author_equal, pages_range,
    lib_section_codes, lib_section_filter, section_collisions, facet_and, plain_catalogue, mention_rank, combined_search, snippets, highlight,
    digest, service_json, bigram_sink)}
