import collections
import random

import numpy as np
import pytest
from conftest import compare
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import chunking, cooccurrence, encoding, leakage, names, packing, pii, termfreq
from shelfspark.llm.queries import ORACLES, QUERIES


def test_queries_equal_their_sql(spark, data):
    compare(spark, QUERIES, ORACLES, ["p2_found", "p3_associations", "p7_terms", "p7_ngrams"], data)


def test_all_associations_hold_the_rare_pairs(spark, data):
    compare(spark, QUERIES, ORACLES, ["p3_all_associations"], data)
    assert QUERIES["p3_all_associations"](spark, data).where("n_ab < 5").count() > 0


# ------------------------------------------------------------------------------------------------------------ chunking

words = st.lists(st.sampled_from(["слово", "word.", "конец!\n", "a,", "x\n\n", "—", "№5 "]), max_size=300)


@settings(max_examples=60, deadline=None)
@given(words)
def test_pieces_rebuild_the_text(ws):
    text = " ".join(ws)
    pieces = chunking.split_text(text, 40, 6, 12)
    assert "".join(text[new:end] for _, end, new, _ in pieces) == text
    tokens = [m.span() for m in chunking.TOKEN.finditer(text)]
    assert all(n <= 40 for *_, n in pieces)
    for (a, b, *_), (c, d, new, _) in zip(pieces, pieces[1:]):
        shared = [t for t in tokens if t[0] >= c and t[1] <= b]
        assert len(shared) == 6 and shared[-1][1] <= new


def test_edits_stay_local_and_boundaries_are_natural():
    rng = random.Random(2)
    text = "".join(rng.choice(["альфа", "бета", "гамма", "дельта", "эпсилон"]) + str(rng.randint(0, 99)) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(8000))
    edited = text[:5000] + "вставка " + text[5000:]
    cut = lambda t: {t[a:b] for a, b, *_ in chunking.split_text(t)}
    before, after = cut(text), cut(edited)
    assert len(before - after) <= 4 and len(before) > 15
    ends = [text[b - 2:b] for _, b, *_ in chunking.split_text(text)[:-1]]
    assert all(e == "\n\n" for e in ends)  # paragraphs are everywhere, so every cut is at one


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a " * 1500, 9), (1, "a " * 1500, 9), (2, "", 9), (3, None, 9), (4, "!!", 9)], "row_id long, field_value string, piece int")
    rows = chunking.chunk_texts(df).collect()
    assert {r["row_id"] for r in rows} == {1, 2, 4} and all(r["n_tokens"] <= 512 for r in rows)
    assert [r[0] for r in chunking.oversized(df).collect()] == [1] and chunking.oversized(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------- co-occurrence


def test_gram_equals_brute_force(spark):
    rng = random.Random(4)
    baskets = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] + [None] * rng.randint(0, 1) for _ in range(300)] + [None]
    want = collections.Counter()
    for b in baskets:
        s = sorted({x for x in b or [] if x is not None})
        want.update((x, y) for i, x in enumerate(s) for y in s[i:])
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {(r["item_a"], r["item_b"]): r["n"] for r in cooccurrence.gram(df.where("items is not null"), "items").collect()}
    assert got.pop((None, None)) == sum(bool([x for x in b or [] if x]) for b in baskets) and got == want


def test_pairs_with_odd_rows(spark):
    rows = [(1, "f", 0, "a", "b"), (1, "f", 0, "a", "b"), (1, "f", 1, "b", "a"), (1, "f", 2, "a", "a"), (1, "f", -1, "a", None), (None, None, None, None, "b"), (2, "a|b,", 0, "x|1,", "y|")]
    df = spark.createDataFrame(rows, "object_id long, field_id string, pair_no int, token string, next_token string")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_total"]) for r in cooccurrence.token_associations(df).collect()}
    assert got == {("a", "b"): (2, 3, 3, 5), ("x|1,", "y|"): (1, 1, 1, 5)}
    assert cooccurrence.token_associations(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------ term frequency


def test_suffix_counts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(40)]
    want, seen = collections.Counter(), collections.defaultdict(set)
    for r, t in enumerate(texts):
        for i in range(len(t)):
            for n in (1, 2, 3):
                if i + n <= len(t):
                    want[" ".join(t[i:i + n])] += 1
                    seen[" ".join(t[i:i + n])].add(r)
    df = spark.createDataFrame([(r, t) for r, t in enumerate(texts)], "r long, ws array<string>")
    got = {r["ngram"].replace(termfreq.SEPARATOR, " "): (r["frequency"], r["records"]) for r in termfreq.ngram_counts(df, "ws", "r", 3, 1).collect()}
    assert got == {g: (n, len(seen[g])) for g, n in want.items()}


def test_records_may_be_any_number(spark):
    df = spark.createDataFrame([(1, ["a"]), (1 + 2**24, ["a"]), (2 + 2**25, ["a", "b"]), (-(2**62), ["a"]), (1, ["a", "a"])], "r long, ws array<string>")
    got = {r["ngram"]: (r["frequency"], r["records"]) for r in termfreq.ngram_counts(df, "ws", "r", 1, 1).collect()}
    assert got == {"a": (6, 4), "b": (1, 1)}


def test_rare_ngrams_are_marked_not_dropped(spark, data):
    compare(spark, QUERIES, ORACLES, ["p7_ngram_marks"], data)
    marks = {r["mark"] for r in QUERIES["p7_ngram_marks"](spark, data).select("mark").distinct().collect()}
    assert marks == {"rare", "common", None}


def test_term_marks(spark):
    code = lambda s, o, p=0: s * 2**28 + o * 2**8 + p * 4
    hot = [code(i, i % 50) for i in range(900)]
    rows = [(1, "hot", hot), (2, "hot", hot), (3, "few", [code(1, 1), code(1, 1), None]), (4, "some", [code(i, 1) for i in range(7)]), (5, "none", None), (6, None, [1]), (7, "none", [])]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "chunk_id long, token string, token_codes array<long>, token_freq long")
    got = {r["token"]: (r["frequency"], r["objects"], r["mark"]) for r in termfreq.term_marks(df).collect()}
    assert got == {"hot": (900, 50, "common"), "few": (1, 1, "rare"), "some": (7, 1, None), "none": (0, 0, "rare")}


# ------------------------------------------------------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 5), st.integers(0, 3)), max_size=80))
def test_best_fit_keeps_capacity_and_conflicts(items):
    bins = packing.best_fit([s for s, *_ in items], [1 << c for _, c, _ in items], [1 << (8 + h) for *_, h in items], 100)
    used, clusters = collections.Counter(), collections.Counter()
    for (s, c, _), b in zip(items, bins):
        used[b] += s
        clusters[b, c] += 1
    assert all(v <= 100 for v in used.values()) and all(v == 1 for v in clusters.values())


def test_pack_documents(spark):
    texts = ["слово " * 30, "word " * 5000, "", None, "copy " * 100, "Copy, " * 100]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)] + [(99, "lone", None, 1)], "doc_id long, text string, host string, offset int")
    rows = packing.pack(df).collect()
    per = collections.Counter()
    for r in rows:
        per[r["container_id"]] += r["n_tokens"]
    assert max(per.values()) <= 2048
    long = sorted((r["piece_no"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 1)
    assert [x[1] for x in long] == [2048 * i for i in range(len(long))] and all(n == 2048 for *_, n in long[:-1])
    assert all(sum(r["doc_id"] == i for r in rows) == 1 for i in (0, 2, 3, 4, 5, 99))
    where = {r["doc_id"]: r["container_id"] for r in rows}
    assert where[4] != where[5]
    assert packing.pack(df.limit(0)).count() == 0


def test_long_runs_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "a" * 200_000), (2, "a " * 100_000)], "doc_id long, text string")
    want = {i: len(packing.encoder(packing.TOKENIZER).encode_ordinary(t)) for i, t in df.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in packing.count_tokens(df, "text").collect()} == want
    assert not hasattr(packing, "SLICE_CHARS")  # nothing sliced by it


def test_near_copies_are_found_and_kept_apart(spark):
    rng = random.Random(5)
    body = [f"w{i}" for i in range(200)]
    texts = {0: body, 1: ["menu", "of", *body[:199], "2024"], 2: [*body[:190], *"another footer with links of the site".split()], 3: body[:120], 4: body[100:], 5: ["a"], 6: ["A"], 7: []}
    for i in range(8, 60):
        texts[i] = [f"v{j}" for j in range(60)]
        for _ in range(rng.randint(0, 3)):
            texts[i][rng.randrange(60)] = f"x{rng.randrange(9)}"
    df = spark.createDataFrame([(i, " ".join(t), f"h{i}") for i, t in texts.items()] + [(98, None, "h"), (99, "w0w1w2 w3", "h"), (100, "w0 w1w2w3", "h")], "doc_id long, text string, host string")
    parts = {i: {tuple(x.lower() for x in t[k:k + 5]) for k in range(max(1, len(t) - 4))} for i, t in texts.items() if t}
    want = {(i, j) for i in parts for j in parts if parts[i] != parts[j] and len(parts[i] & parts[j]) * 5 >= 4 * len(parts[i] | parts[j])}
    sets = packing.with_sets(df, "text")
    ids = {r["doc_id"]: r["set_id"] for r in sets.collect()}
    got = {(r["a"], r["b"]) for r in packing.near_pairs(sets).collect()}
    assert got == {tuple(sorted((ids[i], ids[j]))) for i, j in want} and len(got) > 30
    where = {r["doc_id"]: r["container_id"] for r in packing.pack(df).collect()}
    assert len({where[i] for i in (0, 1, 2)}) == 3 and len({where[i] for i in range(8, 60)}) > 20
    assert all(where[i] != where[j] for i, j in want) and where[5] != where[6] and where[99] != where[100]


# ------------------------------------------------------------------------------------------------------------ encoding

SOUND = [
    "Введение в расчёт нагрузки и прочность материалов при обжиге", "Справочник по чугуну, стали и сплавам", "Методика испытания станка", "Größe und Maß", "Рѣчь о сплаве",
    "Что такое шкала??? Ответы", "при 25 °C ± 0,5 °C", "São água e ação", "Œuvres de Barémil", "plain ascii", "РСФСР и СССР: свод норм",
]


@pytest.fixture(scope="module")
def repairer(spark, data):
    return encoding.Repairer(encoding.bigram_counts(encoding.cells_of(
        {t: (spark.read.parquet(f"{data}/{t}.parquet"), [c]) for t, c in (("object_fields", "field_value"), ("catalogue", "title"))})))


@pytest.mark.parametrize(("really", "read"), [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"),
                                              ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("mac-cyrillic", "cp1251")])
def test_round_trips(repairer, really, read):
    to_char = encoding._tables(read)[1]
    # Of the second text this pair of encodings changes one letter only, into an opening quote, which is a sound sign.
    for sound in SOUND[:3] if really != "mac-cyrillic" else SOUND[:1] + SOUND[2:3]:
        garble = lambda t: "".join(to_char[b] for b in t.encode(really))
        assert repairer.repair(garble(sound)) == (sound, True, True)
        part = "Материал станка и " + garble("Испытания Прочности чугуна") + " для стали"
        assert repairer.repair(part)[:2] == ("Материал станка и Испытания Прочности чугуна для стали", True)


def test_two_layers_lost_bytes_and_sound_texts(repairer):
    once = lambda t: "".join(encoding._tables("cp1251")[1][b] for b in t.encode("utf-8"))
    assert repairer.repair(once(once(SOUND[0])))[0] == SOUND[0]
    assert repairer.repair("������ ��� ����")[1:] == (True, False)
    for t in SOUND:
        assert repairer.repair(t) == (t, False, False), t


def test_garbled_table(spark):
    bad = "Методика испытания станка и чугуна".encode().decode("cp1251", "replace").replace("�", "")
    df = spark.createDataFrame([(i, SOUND[i % 3], None) for i in range(60)] + [(100, bad, "x"), (100, bad, "x"), (101, None, ""), (102, "", None)], "row_id long, title string, column_name string")
    got = encoding.garbled_cells({"t": (df, ["title", "column_name"])}).collect()
    assert [(r["table_name"], r["row_id"], r["column_name"]) for r in got] == [("t", 100, "title")] * 2
    assert encoding.garbled_cells({"t": (df.limit(0), ["title"])}).count() == 0


# --------------------------------------------------------------------------------------------------------------- names

PEOPLE = [
    ["Ренидофин Эдуард Фёдорович", "Э. Ф. Ренидофин", "Ренидофин Э.Ф.", "Renidofin, Eduard", "РЕНИДОФИН Э. Ф.", "Ренидофин Эдик", "Рeнидoфин Э. Ф. (ред.)", "Ренидфоин Э. Ф."],
    ["Николай Ренидофин", "Ренидофин Н. П."], ["Легединова Т. И.", "проф. Т. И. Легединова"], ["Легединов Т. И."],
    ["Горный комбинат «Регамут»", 'ГК "Регамут"', "Горн. комб-т Регамут", "GK Regamut", "Регамут ГК"], ["НИИ «Регамут»"],
]


def test_names_are_linked(spark):
    spelled = [(x, "clash") for group in PEOPLE for x in group * 2] + [(None, ""), ("", ""), ("-", ""), ("б. а.", "")]
    df = spark.createDataFrame(spelled, "author string, entity string")
    got = collections.defaultdict(set)
    for r in names.linked_names(df).collect():
        got[r["entity"]].add(r["name"])
        assert r["n"] == 2
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, PEOPLE))
    pairs = names.spelling_pairs(names.linked_names(df))
    assert pairs.count() == sum(len(g) * (len(g) - 1) // 2 for g in PEOPLE)
    assert names.linked_names(df.limit(0)).count() == 0


def test_average_linkage_keeps_contradictions_apart():
    sim = np.array([[1, 0.9, 0.0], [0.9, 1, 0.9], [0.0, 0.9, 1]])
    label = names.average_linkage(sim, np.ones(3), 0.4)
    assert label[0] != label[2] and label[1] in (label[0], label[2])


def greedy_linkage(sim, weight, least):
    groups = [[i] for i in range(len(sim))]
    while True:
        best = (least, None)
        for i, a in enumerate(groups):
            for j in range(i):
                b = groups[j]
                block = sim[np.ix_(a, b)]
                avg = (block * np.outer(weight[a], weight[b])).sum() / np.outer(weight[a], weight[b]).sum()
                if (block > 0).all() and avg >= best[0]:
                    best = (avg, (i, j))
        if best[1] is None:
            return {frozenset(g) for g in groups}
        i, j = best[1]
        groups[j] += groups.pop(i)


def test_average_linkage_equals_merging_the_best_pair():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 9, 14):
        for _ in range(30):
            sim = rng.random((n, n))
            sim = np.where(rng.random((n, n)) < 0.1, 0, sim)
            sim = np.triu(sim, 1) + np.triu(sim, 1).T + np.eye(n)
            weight = rng.integers(1, 9, n).astype(float)
            label = names.average_linkage(sim, weight, 0.45)
            assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == greedy_linkage(sim, weight, 0.45)


def test_cosine_join_equals_all_pairs(spark):
    rng = random.Random(3)
    words_ = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["renidofin", "renidfoin", "renidorin", "renidofn"]
    cores = spark.createDataFrame([("p", w) for w in dict.fromkeys(words_)] + [("o", "renidofin")], "kind string, core string")
    frequency = names.gram_frequencies(cores)
    assert frequency[1] == cores.count()
    got = {(r["core_a"], r["core_b"]): (r["cosine"], r["in_top"]) for r in names.similar_cores(cores, frequency, top=1).collect() if r["kind"] == "p"}
    grams = names.Grams(*frequency)
    long = sorted({w for w in words_ if len(w) >= names.LEAST_LETTERS})
    want = {(a, b): grams.cosine(a, b) for i, a in enumerate(long) for b in long[i + 1:] if grams.cosine(a, b) >= names.COSINE}
    assert got.keys() == want.keys() and all(abs(got[k][0] - v) < 1e-9 for k, v in want.items())
    assert ("renidofin", "renidorin") in got and {top for _, top in got.values()} == {True, False}  # the rest is kept
    with pytest.raises(ValueError):
        names.similar_cores(cores, frequency, least=0.05)


def test_short_bare_and_foreign_names(spark):
    groups = [
        ["Иванов", "Иванов И. П."], ["МГУ"], ["Ли Ю"], ["Ю."], ["Евгений Петров", "Petrov, Yevgeny", "Петров Е. А."], ["William Gates", "Gates, Bill"], ["Сидоров"], ["Сидоров А. А."],
        ["Сидоров Б. Б."], ["Ребипевин Э. Ю.", "Эдуард Ребипевин", "E. Yu. Rebipevin"], ["Ребипевин Е. А."], ["Ренихичина, Клавдия Н."], ["Ренихичина И. С."], ["王小明"],
    ]
    df = spark.createDataFrame([(x,) for g in groups for x in g] + [("без автора",), (" ",)], "author string")
    got = collections.defaultdict(set)
    for r in names.linked_names(df).collect():
        got[r["entity"]].add(r["name"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_two_errors_of_one_name_join_it(spark):
    groups = [
        ["Горный комбинат «Регамут»", 'ГК "Регамут"', "ГК Регамут", "Горный комбинат Регмаут", "ГК «Регямут»"],
        ["Ренидофин Э. Ф.", "Э. Ф. Ренидофин", "Ренидфоин Э. Ф.", "Ренидофи Э. Ф."],
        ["Ренидорин П. Ф."], ["Ренидофина Э. Ф."], ["НИИ «Регямут»"],
    ]
    df = spark.createDataFrame([(x,) for g in groups for x in g], "author string")
    got = collections.defaultdict(set)
    for r in names.linked_names(df).collect():
        got[r["entity"]].add(r["name"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["root"] for r in names.components(links).collect()} == {**{i: 1 for i in range(1, 21)}, 100: 100, 101: 100}


def test_components_that_still_change_are_not_returned(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError):
        names.components(links, 1)


# ------------------------------------------------------------------------------------------------------------- leakage


def test_leaks(spark):
    rng = random.Random(9)
    passage = [f"слово{i}" for i in range(40)]
    items = spark.createDataFrame([(1, "Read.\n" + " ".join(passage)), (2, "Choose.\n" + " ".join(passage[:30]) + "\nOther?"), (3, None), (4, "one line only"), (5, "x\n")], "item_id long, item_text string")
    noise = lambda n: " ".join(f"шум{rng.randint(0, 999)}" for _ in range(n))
    changed = passage[5:20]
    changed[7] = "другое"
    docs = [
        (10, noise(50) + " " + ", ".join(passage).upper() + noise(20)), (11, noise(9) + " " + " ".join(changed) + " " + noise(9)),
        (12, noise(9) + " " + " ".join(passage[5:13]) + " " + noise(9)), (13, " ".join(passage[:14]).replace("ов", "о\u00ad\u200bв")),
        (14, None), (15, ""), (16, " ".join(reversed(passage))),
    ]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_items(df, items).collect())
    assert got == [(10, 1), (10, 2), (11, 1), (11, 2), (13, 1), (13, 2)]
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def test_leaks_with_every_fourth_word_changed(spark):
    passage = [f"слово{i}" for i in range(30)]
    items = spark.createDataFrame([(1, "Read.\n" + " ".join(passage))], "item_id long, item_text string")
    docs = []
    for n in (12, 15, 19, 23):
        for first in range(4):
            ws = [w if k % 4 != first or k in (0, n - 1) else f"иное{k}" for k, w in enumerate(passage[:n])]
            if sum(w in passage for w in ws) * 4 >= n * 3:
                docs.append((n * 10 + first, " ".join(ws)))
    got = {r["doc_id"] for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert 153 in got and got == {d for d, _ in docs}


def test_every_leak_has_enough_unchanged_windows():
    import itertools

    def hits(same):
        return [i for s in leakage.SHAPES for i in range(len(same) - s[-1]) if all(same[i + o] for o in s)]

    for gaps in itertools.product((0, 1), repeat=leakage.LEAST_WORDS - 1):  # as many equal words, single changed ones between
        same = [1]
        for g in gaps:
            same += [0] * g + [1]
        assert len(same) < leakage.REACH and len(hits(same)) >= leakage.LEAST_HITS
    for n in range(leakage.LEAST_WORDS, 16):  # three quarters of them equal
        for same in itertools.product((0, 1), repeat=n):
            if same[0] and same[-1] and sum(same) * 4 >= n * 3 and (0, 0) not in zip(same, same[1:]):
                assert len(hits(same)) >= leakage.LEAST_HITS


def test_leaks_with_many_single_changes(spark):
    passage = [f"слово{i}" for i in range(120)]
    items = spark.createDataFrame([(1, "Read.\n" + " ".join(passage))], "item_id long, item_text string")
    third = [w if k % 3 != 2 else f"иное{k}" for k, w in enumerate(passage)]
    second = [w if k % 2 == 0 else f"иное{k}" for k, w in enumerate(passage)]
    double = [w if k % 3 == 0 else f"иное{k}" for k, w in enumerate(passage)]  # two changed words in a row
    few = [w if k % 2 == 0 else f"иное{k}" for k, w in enumerate(passage[:21])]  # eleven equal words
    docs = spark.createDataFrame([(i, "x " * 30 + " ".join(ws)) for i, ws in enumerate([third, second, double, few])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_words"] for r in leakage.leaked_items(docs, items).collect()}
    assert got == {0: 119, 1: 119}


def test_stretches_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        item = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        doc = [rng.choice("abc") if rng.random() < 0.3 else w for w in item]
        shift = rng.randint(-3, 3)
        best = 0
        places = [i for i in range(len(doc)) if 0 <= i + shift < len(item)]
        same = {i: doc[i] == item[i + shift] for i in places}
        for a in places:
            for b in places:
                run = [same[i] for i in range(a, b + 1)]
                if b >= a and same[a] and same[b] and (False, False) not in zip(run, run[1:]):
                    maximal = not any(same.get(a - k, False) for k in (1, 2)) and not any(same.get(b + k, False) for k in (1, 2))
                    if maximal and (sum(run) >= 12 or len(run) >= 12 and sum(run) * 4 >= 3 * len(run)):
                        best = max(best, len(run))
        assert leakage.stretches(doc, item, shift) == best


def test_the_bit_map_knows_its_own():
    rng = np.random.default_rng(1)
    own, other = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    known = leakage.BitMap(20)
    known.add(own)
    assert known.has(own).all() and known.has(other).mean() < 0.001


# ----------------------------------------------------------------------------------------------------------------- pii

PII = [
    ("Пишите на a.b+c@d-e.example.org.", [("email", "a.b+c@d-e.example.org")]), ("mail vtx(собака)radek точка example точка net!", [("email", "vtx(собака)radek точка example точка net")]),
    ("to ab1 at cd dot example dot com, ok", [("email", "ab1 at cd dot example dot com")]), ("logo@2x.png и 3 @ 5 each, @reader", []), ("we met at home.", []),
    ("Звоните 8 (512) 860-10-31 с девяти", [("phone", "8 (512) 860-10-31")]), ("Tel +44 20 7946 0759 (ext. 4)", [("phone", "+44 20 7946 0759")]), ("unter 030/23125-043", [("phone", "030/23125-043")]),
    ("Auftrag 426/27292-071. ISBN 978-3-10223-766-1. Build 4.838.8990", []), ("паспорт серии 3705 № 488874 указан", [("ident", "3705 № 488874")]), ("СНИЛС: 836-714-397 34", [("ident", "836-714-397 34")]),
    ("Ausweisnummer: L0618T7752 liegt", [("ident", "L0618T7752")]), ("Инв. № 419-142-887", []), ("прописан: 095936, г. Дальнегорка, ул. Мостовая, д. 185а Читатель", [("address", "095936, г. Дальнегорка, ул. Мостовая, д. 185а")]),
    ("Улица Садовая закрыта на ремонт", []), ("to 125-B Old Mill Avenue, Dunlow QX9 9ZZ. ok", [("address", "125-B Old Mill Avenue, Dunlow QX9 9ZZ")]), ("wohnt in Am Brunnen 139, 00001 Tannfelde", [("address", "Am Brunnen 139, 00001 Tannfelde")]),
    ("Подпись: Е. Ф. Мевиворич. При", [("name", "Е. Ф. Мевиворич")]), ("бригадир ЛАСИФИПОВ Фёдор Георгиевич сообщает", [("name", "ЛАСИФИПОВ Фёдор Георгиевич")]),
    ("Thanks go to Rusubokmann, Isolde. Next", [("name", "Rusubokmann, Isolde")]), ("Кафедра Общей Механики. Станция Верхний Брод", []), ("", []),
]


@pytest.mark.parametrize(("text", "want"), PII)
def test_entities(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find_entities(text)] == want


LATIN_NAMES = [
    "Jürgen Müller", "Anna Müller", "Zoë Brandt", "José Álvarez", "Hélène Lefèvre", "Łukasz Żak", "Ö. Müller", "JÜRGEN MÜLLER", "Ju\u0308rgen Mu\u0308ller", "Müller, Jürgen", "Søren Ærø",
]


@pytest.mark.parametrize("name", LATIN_NAMES)
def test_names_with_any_letters(name):
    text = f"geprüft hat {name}, gestern"
    assert [text[a:b] for a, b, k in pii.find_entities(text)] == [name]
    assert name not in pii.replace(text, [(12, 12 + len(name), "name")], "k")[1]


@pytest.mark.parametrize("name", ["Åsa Øst", "Íñigo Örn", "Νίκος Παππάς"])
def test_announced_names_with_any_letters(name):
    text = f"Signed by {name} yesterday"
    assert [text[a:b] for a, b, _ in pii.find_entities(text)] == [name] and name.split()[1] not in pii.replace(text, pii.find_entities(text), "k")[1]


def test_replacement_keeps_the_rest_and_tells_entities_apart():
    text = "Иван Петров, Ivan@a.example, Анна Петрова и Иван Петров; 8 512 860-10-31"
    found = pii.find_entities(text)
    tagged, named = pii.replace(text, found, "k")
    keep, at = [], 0
    for a, b, _ in found:
        keep.append(text[at:a])
        at = b
    assert pii.re.sub(r"\[[A-Z]+_[0-9a-f]+\]", "\0", tagged) == "\0".join([*keep, text[at:]])
    tags = pii.re.findall(r"\[[A-Z]+_[0-9a-f]+\]", tagged)
    assert tags[0] == tags[3] and len(set(tags)) == 4
    assert named.count("Петров") == 0 or "Иван Петров" not in named
    assert pii.GENDER[named.split()[0]] == ("ru", "m") and pii.replace(text, found, "k") == (tagged, named) != pii.replace(text, found, "l")


def test_pii_tables(spark):
    df = spark.createDataFrame([(1, "a@b.example и a@b.example", 5), (1, "a@b.example и a@b.example", 5), (2, None, 5), (3, "", 5), (4, "x " * 100_000, 5)], "doc_id long, text string, start int")
    assert pii.found_entities(df).count() == 4
    rows = {r["doc_id"]: r for r in pii.redacted(df, "k").collect()}
    assert rows[1]["n_entities"] == 2 and rows[2]["text_placeholders"] is None and rows[3]["text_placeholders"] == "" and pii.redacted(df, "k").count() == 5


OTHER_PII = [
    ("met Maria Gonzalez there", "Maria Gonzalez"), ("by Wei Zhang in", "Wei Zhang"), ("an Herr Jürgen Müller und", "Jürgen Müller"), ("and Priya Sharma said", "Priya Sharma"),
    ("with Mohammed Al-Sayed today", "Mohammed Al-Sayed"), ("avec Jean Dupont hier", "Jean Dupont"), ("пришла Айгуль Нурланова вчера", "Айгуль Нурланова"), ("tel +33 1 42 68 53 00 ok", "+33 1 42 68 53 00"),
    ("au 12 rue de Rivoli, 75001 Paris, hier", "12 rue de Rivoli, 75001 Paris"), ("dear Mrs. Keziah Brown, we", "Keziah Brown"),
]


@pytest.mark.parametrize(("text", "want"), OTHER_PII)
def test_entities_of_other_countries(text, want):
    assert [text[a:b] for a, b, _ in pii.find_entities(text)] == [want]


def test_one_entity_has_one_replacement():
    text = "Иван Петров; Петров Иван; 8 (512) 860-10-31; +7 512 860 10 31"
    tagged, named = pii.replace(text, pii.find_entities(text), "k")
    tags = pii.re.findall(r"\[[A-Z]+_[0-9a-f]{16}\]", tagged)
    assert len(tags) == 4 and tags[0] == tags[1] and tags[2] == tags[3]
    a, b, x, y = named.split("; ")
    assert sorted(a.split()) == sorted(b.split()) and a != "Иван Петров"
    assert pii._national(x) == pii._national(y) != "5128601031" and x.startswith("8 (") and y.startswith("+7 ")


def test_the_corpus_teaches_given_names(spark):
    docs = [(i, f"Signed by Zorblat {s} today") for i, s in enumerate(["Quux", "Frobnitz", "Wibble", "Wobble"])] + [(9, "and then Zorblat Grault came"), (10, "Posted by Lone Ranger"), (11, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert pii.given_names(df) == {"Zorblat"} and pii.given_names(df.limit(0)) == frozenset()
    assert [r["pii_text"] for r in pii.found_entities(df).where("doc_id = 9").collect()] == ["Zorblat Grault"]
    with pytest.raises(ValueError):
        pii.redacted(df, "")


def test_given_names_are_learned_however_many_others_are_announced(spark):
    def word(i):
        return "Q" + "".join("bcdfghjklm"[int(c)] + "a" for c in str(i))

    names = [word(i) for i in range(20_001)]  # 60,003 announcements
    docs = [(k, "; ".join(f"Signed by {n} {s}" for n in names[k:k + 100] for s in ("Xub", "Wibble", "Wobble"))) for k in range(0, len(names), 100)]
    df = spark.createDataFrame([*docs, (-1, f"and then {names[-1]} Grault came"), (-1, f"then GRAULT, {names[7].upper()} came"), (-2, None)], "doc_id long, text string").repartition(4)
    assert pii.given_names(df) == set(names)
    assert {r["pii_text"] for r in pii.found_entities(df).where("doc_id = -1").collect()} == {f"{names[-1]} Grault", f"GRAULT, {names[7].upper()}"}
    assert sorted((r["doc_id"], r["n_entities"]) for r in pii.redacted(df, "k").where("doc_id < 0").collect()) == [(-2, 0), (-1, 1), (-1, 1)]


def test_words_that_cannot_be_taught_change_nothing():
    texts = ["Zorblat Grault", "Grault, Zorblat", "ZORBLAT\u00a0GRAULT", "A.Zorblat", "B. Zorblat Grault", "Zorblat. Grault came", "Zorblat C. Grault", "Zo\u0308rb Grault", "Зорблат Иванов", "Иванов Зорблат"]
    taught = frozenset(["Zorblat", "Grault", "Z\u00f6rb", "Зорблат"])
    for t in texts:
        assert pii.find_names(t, taught) == pii.find_names(t, taught & pii.teachable(t))
    assert pii.teachable("Zorblat. Grault came; Иван Петров") == {"Петров"}
