import random
import re

import numpy as np
import pytest
from conftest import compare
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import balance, bigrams
from shelfspark.operators import catalogue as C
from shelfspark.operators import index as I
from shelfspark.plans import batch as B
from shelfspark.plans import compose as P
from shelfspark.plans import search as S
from shelfspark.plans.queries import ORACLES, QUERIES
from shelfspark.sources import crawled, delivered_lines


def test_queries_equal_their_sql(spark, data):
    """Those that stand at the end of a chain; the driver compares all."""
    names = ["p1_token_stats", "p1_merged_codes", "p4_found", "p4_loaded", "tokenize", "postings", "segment_owner_asof", "bigram_top20",
             "key_budget", "search_compat", "search_full", "search_batch", "search_saved", "service_json", "bigram_sink", "author_surname", "lib_section_codes", "combined_search", "digest"]
    compare(spark, QUERIES, ORACLES, names, data)


def test_every_query_with_sql_or_reason():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


# ------------------------------------------------------------------------------------------------------------- balance


def test_pack_spreads_load():
    tasks, loads = balance.pack([100, 50, 50, 30, 30, 30, 10], 3)
    assert sum(loads) == 300 and max(loads) <= 110 and len(tasks) == 7


def test_one_key_holds_most_rows(spark):
    rows = [("hot", i % 50, i) for i in range(3000)] + [(f"k{i % 40}", i, i) for i in range(400)] + [(None, 1, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "key string, grp long, x long").withColumn("_task", F.lit("clash"))
    placement = balance.plan_placement(df, "key", n_tasks=4)
    assert len(placement.shards["hot"]) > 8 and max(placement.task_loads) < 1.3 * 3402 / 4
    got = {r["key"]: tuple(r)[1:] for r in balance.balanced_key_stats(df.union(df), "key", "grp", ["x"], 4).collect()}
    assert got["hot"] == (6000, 3000, 50) and got["k3"] == (20, 10, 10) and got[None] == (4, 2, 1)
    assert balance.balanced_key_stats(df.limit(0), "key", "grp", ["x"]).count() == 0


def test_a_hot_key_in_one_group_and_a_hot_copy(spark):
    rows = [("hot", 7, i) for i in range(4000)] + [("copy", 1, 1)] * 4000 + [(f"k{i % 40}", i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, grp long, x long").repartition(3)
    placement = balance.plan_placement(df, "key", n_tasks=4)
    placed, task, _ = balance.place(balance.combined(df.select("key", "grp", "x")), "key", placement, ["grp", "x"])
    sizes = [r[0] for r in placed.groupBy(task).agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert len(sizes) == 4 and sum(sizes) <= 4000 + 400 + 3 and max(sizes) < 1.6 * sum(sizes) / 4
    got = {r["key"]: tuple(r)[1:] for r in balance.balanced_key_stats(df, "key", "grp", ["x"], 4).collect()}
    assert got["hot"] == (4000, 4000, 1) and got["copy"] == (4000, 1, 1) and got["k3"] == (10, 10, 10) and len(got) == 42


def test_arrays_are_cut_once(spark):
    df = spark.createDataFrame([("t", list(range(1000)) + [None], 1), ("u", [3, 1, 2], 2), ("v", [], 3), (None, [5], 4)], "token string, codes array<long>, extra int")
    placement = balance.plan_placement(df, "token", weight=F.size("codes"), n_tasks=3)
    rows = balance.cut_arrays(df, "token", "codes", placement).collect()
    hot = [r for r in rows if r["token"] == "t"]
    assert sorted(c for r in hot for c in r["codes"]) == list(range(1000)) and len({r["_shard"] for r in hot}) == len(hot) == len(placement.shards["t"])
    assert {r["token"]: (r["codes"], r["extra"]) for r in rows if r["token"] != "t"} == {"u": ([3, 1, 2], 2), None: ([5], 4)}


def test_replicated_join_and_merge_equal_plain_ones(spark):
    left = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 5), ("d", 6), (None, 7)], "k string, x int")
    got = balance.fragment_replicate_join(left, right, "k", ["x"], 4)
    assert got.columns == ["k", "x", "x_right"]
    want = left.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k")).select("l.k", "l.x", "r.x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    chunks = spark.createDataFrame([("t", list(range(0, 900, 2))), ("t", list(range(0, 900, 3))), ("u", [5, None, 5]), ("v", []), ("w", None)], "token string, token_codes array<long>")
    rows = balance.merged_codes(chunks, n_tasks=3).collect()
    merged = sorted(c for r in rows if r["token"] == "t" for c in r["codes"])
    assert merged == sorted({*range(0, 900, 2), *range(0, 900, 3)}) and sum(r["token"] == "t" for r in rows) > 1
    assert [r["codes"] for r in rows if r["token"] == "u"] == [[5]] and {r["token"] for r in rows} == {"t", "u"}


# ---------------------------------------------------------------------------------------------------- delivered lines

LINES = [
    ("1;2000;1.2;a;b;c;10;An Author;A Title", []), ('1; "2000" ;1.2;a;b;c;10;"A; ""B""" ;x', []), ("", ["column_count"]), (None, ["column_count"]),
    ('1;2000;1;a;b;c;1;"open;x', ["quoting"]), ('1;2000;1;a;b;c;1;"a"b;x', ["quoting"]), ('1;2000;1;a;b;c;1;mid"quote;x', []),
    ("1;1399;1;a;b;c;1;a;t", ["bad_year"]), ("1;2031;1..2;a;b;c;0;a;t", ["bad_pages_count", "bad_udc", "bad_year"]), ("1;;;;;;;;", []),
    ("1;+200;1234;a;b;c;123456;a;t", ["bad_pages_count", "bad_udc", "bad_year"]), ("﻿1; 2000\t;1;a;b;c;7;a;t\r", []), ("a;b", ["column_count"]),
    ('1;2000;1;a;b;c;1;a;"' + '""' * 3000 + '"', []), ('1;2000;1;a;b;c;1;a;"' + '""' * 3000, ["quoting"]), ("1;２０００;1;a;b;c;1;a;t", ["bad_year"]),
    ("1;2000;1;a;b;c;1;" + "x" * 200_000 + ";t", []),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, x, "mine") for i, (x, _) in enumerate(LINES)], "line_id int, raw_line string, year string")
    got = {r["line_id"]: r for r in delivered_lines.parse_lines(df).collect()}
    for i, (line, reasons) in enumerate(LINES):
        assert sorted(got[i]["reasons"]) == reasons, (i, (line or "")[:60])
    assert got[1]["author"] == 'A; "B"' and got[1]["year"] == 2000 and got[6]["author"] == 'mid"quote' and got[11]["object_id"] == 1 and got[11]["title"] == "t"
    assert got[9]["year"] is None and len(got[13]["title"]) == 3000
    assert delivered_lines.rejected_lines(df.limit(0)).count() == 0


def split_line(line):
    """The columns of a line as written, or None if its quoting is broken: the grammar letter by letter."""
    out, at, text, blanks = [], 0, line + ";", " \t\r\u00a0\ufeff"
    while at < len(text):
        first = at
        while text[first] in blanks:
            first += 1
        if text[first] == '"':
            end = first + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    return None
                if text[end + 1] != '"':
                    break
                end += 2
            end += 1
            while text[end] in blanks:
                end += 1
            if text[end] != ";":
                return None
        else:
            end = text.index(";", first)
        out.append(text[at:end])
        at = end + 1
    return out


def test_lines_follow_the_grammar(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice('"";a \ufdd0\ufdd1\u00a0e') for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    lines += [";" * 8 + f'"{x}"' for x in ("", '""', 'a""', '""a', '\ufdd0', '\ufdd1e""\ufdd1d')]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string")
    got = {r["line_id"]: r for r in delivered_lines.parse_lines(df).collect()}
    for i, line in enumerate(lines):
        cells = split_line(line)
        assert (got[i]["reasons"] == ["quoting"]) == (cells is None), line
        if cells is not None:
            assert (got[i]["reasons"] == ["column_count"]) == (len(cells) != 9), line
    assert [got[i]["title"] for i in range(1500, 1506)] == ["", '"', 'a"', '"a', "\ufdd0", '\ufdd1e"\ufdd1d']


# ------------------------------------------------------------------------------------------------------ text and index


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tokens_and_cases(spark):
    text = "Ab, êeux Ёж-12"
    assert one(spark, T.tokens(F.lit(text))) == ["Ab", "eux", "Ёж", "12"]
    df = spark.createDataFrame([(1, "f", text), (2, "f", ""), (3, "f", "!!!"), (4, "f", None)], "object_id int, field_id string, text string")
    rows = T.segment_rows(df, ["object_id", "field_id"], "text").collect()
    assert len(rows) == 1 and [w["start"] for w in rows[0]["words"]] == [0, 5, 9, 12]
    assert [one(spark, T.case_rich(F.lit(w))) for w in ("IBM", "Word", "low", "1A")] == [2, 1, 0, 0]
    assert [one(spark, T.case_fast(F.lit(w))) for w in ("IBM", "Word", "low", "1A")] == [1, 1, 0, 0]
    assert one(spark, T.split_nonempty(F.lit("a<><>b<>"), "<>")) == ["a", "b"]


@pytest.mark.parametrize(("n", "segments"), [(63, 1), (64, 1), (65, 2), (128, 2), (129, 3)])
def test_segment_edges(spark, n, segments):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "object_id int, text string")
    assert T.segment_rows(df, ["object_id"], "text").count() == segments


# Published examples of the Russian stemmer.
STEMS = {"важная": "важн", "вагоны": "вагон", "валяться": "валя", "вальсе": "вальс", "важнейшие": "важн", "ведению": "веден", "книга": "книг", "приходивший": "приход",
         "прекрасный": "прекрасн", "валандался": "валанда", "валентина": "валентин", "валериановых": "валерианов", "валетами": "валет", "валил": "вал", "валился": "вал", "валится": "вал",
         "пак": "пак", "пакет": "пакет", "пакетом": "пакет", "пакостей": "пакост", "пакостных": "пакостн", "пал": "пал", "палате": "палат", "палец": "палец", "палача": "палач",
         "палашах": "палаш", "палевые": "палев", "пальба": "пальб", "пальмовым": "пальмов", "памятен": "памят", "памятниках": "памятник", "памятью": "памят", "панталоны": "панталон", "прочность": "прочност", "нежность": "нежност", "всемирность": "всемирн", "Книга": "Книг", "ВАЖНАЯ": "ВАЖНАЯ"}


def test_stems_and_normal_tokens(spark):
    df = spark.createDataFrame([(w,) for w in [*STEMS, "щука", "объём", "Ёлка", "water"]], "w string")
    got = {r[0]: (r[1], r[2]) for r in df.select("w", T.stem_ru(F.col("w")), T.normalise(F.col("w"))).collect()}
    for w, s in STEMS.items():
        assert got[w][0] == s, w
    assert got["щука"][1] == "shchuka" and got["Ёлка"][1] == "iolka" and got["water"][1] == "water"


def test_pack_round_trip(spark):
    assert one(spark, I.pack(*map(F.lit, (36, 7, 5, 1)))) == 9663678229
    row = spark.range(1).select(*[c.alias(n) for n, c in I.unpack(F.lit(9663678229)).items()]).first()
    assert tuple(row) == (36, 7, 5, 1)
    with pytest.raises(Exception, match="20 bits"):
        one(spark, I.pack(F.lit(1), F.lit(1 << 20), F.lit(0), F.lit(0)))


def test_index_saved_and_read(spark, tmp_path):
    text = " ".join(["alpha beta"] * 5 + ["rare"] * 4 + ["Gamma"] * 70)
    fields = spark.createDataFrame([(1, "a", text), (2, "b", "alpha"), (3, "c", None)], "object_id long, field_id string, text string")
    index = I.build_index(fields)
    assert {r["token"]: r["freq"] for r in index.lexicon.collect()} == {"alpha": 6, "beta": 5, "gamma": 70}
    index.save(str(tmp_path))
    again = I.Index.load(spark, str(tmp_path))
    assert again.postings_of(["gamma"]).count() == 70 and again.postings_of(["rare"]).count() == 0 and again.postings_of([]).count() == 0
    owners = {r[0]: r[1] for r in I.segment_owners(spark.createDataFrame([(0,), (1,), (2,), (9,)], "segment_id long"), I.object_ranges(again.segments)).collect()}
    assert owners == {0: 1, 1: 1, 2: 2, 9: 2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_on_a_saved_index_reads_only_its_terms(spark, tmp_path):
    rows = [(f"t{t}", s, s // 4, t % 64, 0) for s in range(80) for t in range(20)] + [("hot", s, s // 4, p, 0) for s in range(80) for p in range(30, 60)]
    postings = spark.createDataFrame(rows, "token string, segment_id long, object_id long, pos int, weight int")
    segments = spark.createDataFrame([(s, s // 4, "f", 0, 0, 1) for s in range(80)], "segment_id long, object_id long, field_id string, segment_no int, seg_start int, seg_length int")
    index = I.index_from_tables(postings, segments, least=1)
    index.save(str(tmp_path / "i"), bucket_rows=500, file_rows=700)
    saved = I.Index.load(spark, str(tmp_path / "i"))
    assert saved.buckets == 8
    segments_, scores = S.rank_queries(spark, saved, {0: ["t3", "hot"]})
    plan = plan_of(scores)
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*In\(token, \[hot,t3\]\)", plan)
    _, again = S.rank_queries(spark, index, {0: ["t3", "hot"]})
    key = lambda df: sorted((r["object_id"], round(r["score"], 9), r["matches_count"]) for r in df.collect())
    assert key(scores) == key(again) and len(key(scores)) == 20
    # A token that holds most rows fills several files.
    files = saved.postings.where("token = 'hot'").select(F.input_file_name()).distinct().count()
    assert files >= 2


def test_many_queries_are_joined_not_listed(spark):
    index = tiny(spark, [(s, s, [("a", 3, 0), ("b", 5 if s % 2 else 9, 0)]) for s in range(12)])
    words = spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (7, 2, "a"), (8, 0, "b"), (9, 0, "zz"), (9, 1, None)], "query_id long, place int, token string")
    _, many = S.rank(S.query_terms(words), index)
    _, few = S.rank_queries(spark, index, {7: ["a", "b", "a"], 8: ["b"], 9: ["zz"]})
    key = lambda df: sorted((r["query_id"], r["object_id"], round(r["score"], 9)) for r in df.collect())
    assert key(many) == key(few) and len(key(many)) == 24
    assert index.only([f"x{i}" for i in range(2000)]) is index


def test_checkpoints_never_go_to_a_machine_of_a_cluster():
    from shelfspark.session import checkpoint_folder

    assert checkpoint_folder("spark://host:7077", "hdfs:///shared") == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_folder(master, None)


def test_bigram_sink(spark, tmp_path):
    table = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a"])], "token string, next_tokens array<string>")
    bigrams.save_successors(table, str(tmp_path / "b"))
    assert bigrams.next_words(spark, str(tmp_path / "b"), ["a", "zz"]) == {"a": ["b", "c"]} and bigrams.next_words(spark, str(tmp_path / "b"), []) == {}


def test_bigrams(spark):
    fields = spark.createDataFrame([("a b " * 120,), ("a c",), (None,), ("x",), ("",)], "text string")
    pairs = bigrams.adjacent_pairs(fields)
    assert pairs.count() == 240
    assert {r[0]: r[1] for r in bigrams.top_successors(pairs).collect()} == {"a": ["b", "c"], "b": ["a"]}


# ------------------------------------------------------------------------------------------------------------- search


def tiny(spark, rows, extra=()):
    postings = [(t, s, o, p, w) for s, o, occ in rows for t, p, w in occ] + list(extra)
    df = spark.createDataFrame(postings, "token string, segment_id long, object_id long, pos int, weight int")
    segments = spark.createDataFrame([(s, o, "f", 0, 0, 1) for s, o, _ in rows], "segment_id long, object_id long, field_id string, segment_no int, seg_start int, seg_length int")
    return I.index_from_tables(df, segments, least=1)


def brute(rows, words, compat=False):
    """The ranking restated: plain Python over a few segments."""
    import math

    first = {}
    for i, w in enumerate(words[:10]):
        first.setdefault(w, i)
    freq = {w: sum(t == w for _, _, occ in rows for t, _, _ in occ) for w in first}
    known = sorted((freq[w], i, w) for w, i in first.items() if freq[w])[:5]
    idf = {w: 1 / math.log(f + 2) for f, _, w in known}
    least, scores = 0.5 * sum(idf.values()), {}
    for s, o, occ in rows:
        occ = sorted((p, w, t) for t, p, w in occ if t in idf)
        if not occ:
            continue
        occ = occ[:1] if len(idf) == 1 else occ
        have = {t for _, _, t in occ}
        weight = sum(idf[t] for t in have)
        if len(idf) > 1 and round(weight, 12) < round(least, 12):
            continue
        span = min(b[0] - a[0] + 1 for a in occ for b in occ if b[0] >= a[0] and have <= {t for p, _, t in occ if a[0] <= p <= b[0]})
        scores.setdefault(o, []).append(weight + len(have) / (1000 * span))
    return {o: (round(max(x) + sum(x) / len(x) * math.log(1 + len(x)) / 1e6, 6), len(x)) for o, x in scores.items()}


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in range(60):
        places = rng.sample(range(64), rng.randint(1, 12))
        rows.append((s, s // 4, [(rng.choice("abcdef"), p, rng.randint(0, 1)) for p in places]))
    index = tiny(spark, rows)
    for words in (["a", "b"], ["c"], ["a", "b", "c", "d", "e", "f"], ["a", "zz", "a", "d"], ["zz"]):
        _, scores = S.rank(S.query_frame(spark, {0: words}), index)
        assert {r["object_id"]: (round(r["score"], 6), r["matches_count"]) for r in scores.collect()} == brute(rows, words), words


def test_paging_law_filter_and_order(spark):
    rows = [(s, s, [("a", 3, 0), ("b", 5 if s % 2 else 9, 0)]) for s in range(12)]
    index = tiny(spark, rows)

    def page(first, count, objects=None, words=("a", "b")):
        return [r["object_id"] for r in S.search(spark, index, {0: list(words)}, objects, first, count).orderBy("rank").collect()]

    assert page(0, 4) + page(4, 5) == page(0, 9)
    some = spark.createDataFrame([(3,), (4,)], "object_id long")
    assert page(0, 9, some) == [3, 4] and page(0, 99, some.limit(0)) == page(0, 99) and page(0, 5, None, ["zz"]) == []
    ab, ba = [S.search(spark, index, {0: w}).where("rank = 1").first()["segments"][-1]["relevance"] for w in (["a", "b"], ["b", "a"])]
    assert ab == pytest.approx(2 * ba)  # the query's word order counts


def test_span_ties_and_compat(spark):
    index = tiny(spark, [(1, 1, [("a", 1, 0), ("b", 9, 0), ("a", 8, 0), ("b", 2, 0)]), (2, 2, [("a", 0, 0), ("b", 40, 0)])])
    found = S.search(spark, index, {0: ["a", "b"]}).where("object_id = 1").first()["segments"][0]
    assert [w["pos"] for w in found["words"]] == [1, 2]
    old = S.search(spark, index, {0: ["a", "b"]}, config=S.SearchConfig(compat=True))
    assert {r["object_id"] for r in old.collect()} == {1}  # the last place of each key is passed over


def paged(scores, first=0, count=10):
    """The page by joining queries to postings, and the same columns."""
    page = S.ranked_page(scores, first, count)
    return {(r["query_id"], r["rank"], r["object_id"], round(r["score"], 9), r["matches_count"], r["total"]) for r in page.collect()}


@pytest.mark.parametrize("seed, width", [(1, 64), (2, 64), (3, 200)])
def test_blocks_answer_as_the_join_does(spark, seed, width):
    """Ties, unknown words, rows posted twice, several tokens in one place, no object, places beyond a segment's 64."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(30)]
    rows, twice = [], []
    for s in range(1500):
        places = [rng.randrange(width) + 5 for _ in range(rng.choice([1, 2, 3, 40]))]
        occ = {(vocabulary[min(int(rng.expovariate(0.15)), 29)], p, rng.randint(0, 1)) for p in places}
        rows.append((s, None if s < 40 else s // 7, sorted(occ)))
        if s % 9 == 0:
            twice += [(t, s, rows[-1][1], p, w) for t, p, w in rows[-1][2]]
    index = tiny(spark, rows, twice)
    words = [(q, i, rng.choice(vocabulary[:rng.choice([3, 30])] + ["zz"])) for q in range(60) for i in range(rng.randint(1, 12))]
    terms = S.query_terms(spark.createDataFrame(words, "query_id long, place int, token string"))
    _, scores = S.rank(terms, index)
    for first, count, rows_a_block in ((0, 10, 10**9), (2, 3, 500)):
        got = B.best_of_queries(terms, index, first, count, block_rows=rows_a_block)
        have = {(r["query_id"], r["rank"], r["object_id"], round(r["score"], 9), r["matches_count"], r["total"]) for r in got.collect()}
        assert have == paged(scores, first, count) and len({r[0] for r in have}) > 50


def test_blocks_prune_only_what_cannot_win(monkeypatch):
    import math

    import pyarrow as pa

    rng = random.Random(7)
    occ = [(t, s, s // 3, p) for s in range(2000) for t, p in zip(rng.choices("abcdef", weights=[9, 9, 5, 3, 1, 1], k=24), rng.sample(range(64), 24))]
    idf = {t: 1 / math.log(sum(o[0] == t for o in occ) + 2) for t in "abcdef"}
    asked = []
    for q in range(12):
        tokens = sorted(rng.sample("abcdef", rng.randint(2, 5)), key=idf.get, reverse=True)
        asked += [(t, q, i + 1, idf[t], 0.5 * sum(map(idf.get, tokens))) for i, t in enumerate(tokens)]
    packed = pa.table({"token": pa.array([o[0] for o in occ]).dictionary_encode(), "segment_id": [o[1] for o in occ], "object_id": [o[2] for o in occ], "pos": [o[3] for o in occ]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, packed.schema) as writer:
        writer.write_table(packed)
    rows = [(sink.getvalue().to_pybytes(), *[None] * 5), *[(None, *x) for x in asked]]
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["rows", "token", "query_id", "slot", "idf", "min_weight"])

    def answers(prune_from, dense):
        monkeypatch.setattr(B, "PRUNE_FROM", prune_from)
        monkeypatch.setattr(B, "DENSE", dense)
        return [tuple(r.values()) for out in B._answers(10)([batch]) for r in out.to_pylist()]

    plain = answers(10**9, 0)
    assert len(plain) == 120 and plain == answers(3, 0) == answers(3, 10**9) == answers(100, 2)


def test_a_lexicon_of_blocks(spark):
    """Rows posted twice count once; a row is equal to another in its nulls too."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(9)]), rng.choice([None, 1, 2]), rng.choice([None, 1, 70]), rng.randint(0, 1)) for _ in range(900)]
    postings = spark.createDataFrame(rows, "token string, segment_id long, object_id long, pos int, weight int").repartition(3)
    for block_rows in (10**9, 50):
        got = B.counted_lexicon(postings, 1, block_rows=block_rows)
        assert {tuple(r) for r in got.collect()} == {(t, len({r for r in rows if r[0] == t})) for t in "abc"}
    assert B.counted_lexicon(postings.limit(0)).count() == 0


def test_shortest_stretch_against_brute_force():
    rng = random.Random(3)
    for width in (64, 150):
        keys = [[rng.sample(range(width), rng.choice([1, 2, 9])) for _ in range(3)] for _ in range(300)]
        words = -(-width // 64)
        bits = np.array([[[sum(1 << p % 64 for p in segment[k] if p // 64 == w) for segment in keys] for w in range(words)] for k in range(3)], np.uint64)
        want = [min(max(min((p for p in k if p >= a), default=999) for k in segment) - a + 1 for k0 in segment for a in k0) for segment in keys]
        assert B.shortest(bits).tolist() == want


def shuffled_rows(spark, run):
    """Rows that the stages of ``run`` wrote for others."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._gateway.jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(n for stage, n in stages().items() if stage > before)


def test_matches_of_many_queries_do_not_travel(spark, tmp_path):
    """60 queries that each match nearly all of 3,000 segments: what is shuffled follows the postings, not the matches."""
    rng = random.Random(4)
    rows = [(t, s, s // 5, p, 0) for s in range(3000) for p, t in enumerate(rng.sample("abcdefg", 5))]
    spark.createDataFrame(rows, "token string, segment_id long, object_id long, pos int, weight int").write.parquet(str(tmp_path / "postings.parquet"))
    spark.createDataFrame([(0, 0)], "segment_id long, object_id long").write.parquet(str(tmp_path / "segments.parquet"))
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are not this small
    try:
        assert shuffled_rows(spark, lambda: found.extend(QUERIES["search_batch"](spark, str(tmp_path)).collect())) < 5 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 600 and min(r["total"] for r in found) > 500


# ---------------------------------------------------------------------------------------------- catalogue, composition


def test_facets(spark):
    rows = [(1, 2000, "66.1.2", [1], 10, "И. П. Иванов", "Сплав и металл", 1), (2, None, "6", [2], None, "Петров, А.", "Металл", 1),
            (3, 1990, None, None, 300, None, None, 1), (1, 1999, "1", [9], 5, "x", "старое", 0)]
    df = spark.createDataFrame(rows, "object_id long, year int, udc string, lib_sections array<int>, pages_count int, author string, title string, row_id long")
    stamp = F.timestamp_seconds(F.col("row_id"))
    records = C.catalogue_records(df.withColumn("updated_at", stamp).withColumn("arrived_at", stamp)).cache()

    def ids(**facets):
        return sorted(r["object_id"] for r in C.facet_filter(records, **facets)[1].collect())

    assert ids() == [1, 2, 3] and not C.facet_filter(records)[0]
    assert ids(title="металл") == [1, 2] and ids(title="металла сплав") == [1] and ids(title="!!") == []
    assert ids(year_max=1995) == [2, 3] and ids(year="2000") == [1] and ids(year="x") == [] and ids(year=0) == [1, 2, 3]
    assert ids(udc="66.1") == [1] and ids(udc="6") == [2] and ids(udc="..") == []
    assert ids(author="Иванов") == [1] and ids(lib_section="2") == [2] and ids(pages_count_min=10) == [1, 3]
    assert {r[0]: r[1] for r in C.mentions(records, "металл сплав Иванов").collect()} == {1: 3}
    assert C.mentions(records, "!").count() == 0


def test_section_codes(spark):
    got = [one(spark, C.section_codes([F.lit(x) for x in xs])) for xs in (("Наука", " химия ", ""), ("", "a", "b"), ("a", "", "c"))]
    assert got[0][1] == 390746545 and len(got[0]) == 2 and got[1] == [] and len(got[2]) == 1
    lines = spark.createDataFrame([("ab", "c", ""), ("a", "bc", ""), ("x", None, "")], "section_1 string, section_2 string, section_3 string")
    assert C.section_collisions(lines).count() == 1  # no separator between the names


def test_highlight(spark):
    marked = one(spark, P.highlight(F.lit('one "two"\r\n three'), F.array(F.lit(0), F.lit(2))))
    assert marked == "<b>one</b> 'two' <b>three</b>"
    assert one(spark, P.highlight(F.lit(""), F.array(F.lit(0)))) == ""
    assert one(spark, P.title_cases(F.lit("One two Three"), F.array(F.lit(0), F.lit(1), F.lit(2)))) == 2


def test_service_of_nothing(spark, data):
    from shelfspark.plans import queries as Q

    args = (spark, Q._index(spark, data), Q._fields(spark, data), Q._records(spark, data))
    for params in ({}, {"q": ""}, {"q": "сплав", "title": "нетакогослова"}, {"q": "сплав", "year": "x"}):
        assert P.service(*args, params).collect()[0][0] == '{"count":0,"results":[]}', params
    import json

    past = json.loads(P.service(*args, {"q": "сплав", "start": "100000"}).collect()[0][0])
    whole = json.loads(P.service(*args, {"q": "сплав", "len": "3"}).collect()[0][0])
    assert past["results"] == [] and past["count"] == whole["count"] > 3 and [r["result_index"] for r in whole["results"]] == [0, 1, 2]


def test_request():
    r = P.Request.from_mapping({"q": "x", "start": "5", "len": "many", "max_year": "1990", "json": "1"})
    assert (r.start, r.len, r.snps, r.facets()["year_max"]) == (5, 10, 1, "1990")


# ------------------------------------------------------------------------------------------------- sources, streaming


def test_folder_and_plain_catalogue(spark, tmp_path):
    (tmp_path / "c" / "7").mkdir(parents=True)
    (tmp_path / "c" / "x").mkdir()
    (tmp_path / "c" / "7" / "title.txt").write_bytes("Ёж №1".encode("cp1251"))
    (tmp_path / "c" / "x" / "title").write_bytes(b"y")
    (tmp_path / "c" / "7" / "scan.djvu").write_bytes(b"\x00")
    got = {r["field_id"]: tuple(r)[2:] for r in crawled.folder_fields(spark, str(tmp_path / "c")).collect()}
    assert got == {"title.txt": ("Ёж №1", None), "scan.djvu": (None, "no parser for scan.djvu")}
    with pytest.raises(Exception, match="no parser for scan.djvu"):
        crawled.folder_fields(spark, str(tmp_path / "c"), strict=True).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in crawled.list_folder(spark, str(tmp_path / "c" / "7")).collect()] == ["scan.djvu", "title.txt"]
    (tmp_path / "c" / "7" / "scan.djvu").unlink()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "c"))
    assert sorted((r["text"] is None) for r in crawled.parse_files(files).collect()) == [False, True]
    (tmp_path / "b.csv").write_text("5;1999;6.1;A;B;;x;Au;Ti\n6;n\n")
    rows = {r["object_id"]: r for r in crawled.read_catalogue(spark, str(tmp_path / "b.csv")).collect()}
    assert rows[5]["pages_count"] == -1 and len(rows[5]["lib_sections"]) == 2 and rows[6]["year"] == -1 and rows[6]["title"] is None


def test_ingest_twice_adds_once(spark, tmp_path, data):
    from shelfspark.streaming.ingest import ingest_fields

    source = spark.read.parquet(f"{data}/object_fields.parquet")
    source.write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        ingest_fields(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == I.first_loads(source).count()


def test_nothing_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "shelfspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
