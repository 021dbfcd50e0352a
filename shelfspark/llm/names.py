"""Variant spellings of names of people and organisations, linked.

1. Each distinct spelling is read into a record in one Latin spelling: a person's surname, given name and patronymic (or
   their initials), an organisation's kind (as an acronym) and proper name. Case, order, roles, look-alike letters of
   another script, quotes, spacing and the system of romanisation no longer count.
2. Distinct *cores* (surnames, proper names) become unit vectors of weighted character n-grams: pairs of letters at most one
   letter apart, ends included, weighted by inverse frequency (``1 - GAPPED`` of the squared norm), and gapped n-grams, the
   core with one letter left out (``GAPPED`` of it). A sparse top-n cosine join follows: candidates share a gram; since
   ``COSINE > 1 - GAPPED``, two vectors without a common gapped gram cannot reach the threshold, so only these are joined
   and no candidate is lost (prefix filter). Few words can share a gapped gram (an alphabet times the places of a letter,
   whatever the data), so there is no hot gram and candidates grow as the words do. The cosine decides; pairs are ranked for
   each core, and those beyond the ``TOP`` best are kept too (the exact rest).
3. Components of linked cores, further split by the first letters of given name and patronymic, are what one task gets. In
   such a block average linkage, weighted by the root of the rows, groups first the cores, then within a group of cores the forms of given
   name and patronymic; contradicting ones (a man's and a woman's surname, different full names) are never put together.
4. Records without a patronymic join the group of their component and initial that agrees best, bare surnames the one entity
   that has their core, if there is just one.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.pii import GENDER
from shelfspark.session import cut_lineage

GAPPED, COSINE, TOP = 0.9, 0.11, 16
LEAST_LETTERS = 5  # an error in a shorter core makes another name
LINKAGE = 0.45
LINKED, FAR, FAR_LEAST = 0.8, 0.4, 0.01  # similarity of cores that the join links; of others FAR times their letter pairs' cosine
BUCKETS = 4096  # hashed letter pairs, whose frequencies are shared with all tasks

# Romanisation, look-alikes, short forms of given names, roles.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "e", "ґ": "g",
}
LOOKALIKE = dict(zip("aceopxyABCEHKMOPTXYу", "асеорхуАВСЕНКМОРТХУу"))
SHORT = {
    "Саша": "Александр", "Шура": "Александр", "Саня": "Александр", "Лёша": "Алексей", "Алёша": "Алексей", "Толя": "Анатолий", "Андрюша": "Андрей",
    "Аня": "Анна", "Анюта": "Анна", "Тоша": "Антон", "Боря": "Борис", "Валя": "Валентина", "Вася": "Василий", "Вика": "Виктория", "Витя": "Виктор",
    "Володя": "Владимир", "Вова": "Владимир", "Галя": "Галина", "Гена": "Геннадий", "Гоша": "Георгий", "Жора": "Георгий", "Гриша": "Григорий", "Даша": "Дарья",
    "Денис": "Денис", "Деня": "Денис", "Дима": "Дмитрий", "Митя": "Дмитрий", "Женя": "Евгений", "Катя": "Екатерина", "Лена": "Елена", "Лиза": "Елизавета",
    "Захарка": "Захар", "Зина": "Зинаида", "Ваня": "Иван", "Ира": "Ирина", "Кира": "Кирилл", "Кирюша": "Кирилл", "Клава": "Клавдия", "Костя": "Константин",
    "Ксюша": "Ксения", "Лёня": "Леонид", "Люба": "Любовь", "Люда": "Людмила", "Люся": "Людмила", "Мила": "Людмила", "Максимка": "Максим", "Рита": "Маргарита",
    "Маша": "Мария", "Миша": "Михаил", "Надя": "Надежда", "Наташа": "Наталья", "Ната": "Наталья", "Коля": "Николай", "Оля": "Ольга", "Паша": "Павел",
    "Петя": "Пётр", "Поля": "Полина", "Рая": "Раиса", "Рома": "Роман", "Света": "Светлана", "Серёжа": "Сергей", "Соня": "София", "Стёпа": "Степан",
    "Тарасик": "Тарас", "Тома": "Тамара", "Таня": "Татьяна", "Тима": "Тимофей", "Тимоша": "Тимофей", "Федя": "Фёдор", "Эдик": "Эдуард", "Эля": "Элеонора",
    "Юля": "Юлия", "Юра": "Юрий", "Яша": "Яков", "Вера": "Вера", "Верочка": "Вера", "Олежка": "Олег", "Олежек": "Олег",
}
ROLE = re.compile(
    r"(?i)\b(?:и\s+др\.?|et\s+al\.?|сост\.?|ред\.?|под\s+ред\.?|отв\.?\s*ред\.?|пер\.|акад\.?|академик|проф\.?|профессор|доц\.?|доцент|инж\.|д-р|dr\.?|prof\.?|ed\.?|eds\.?|"
    r"(?:(?:канд|докт|к|д)\.|канд|докт|д-р)\s*[а-я-]{1,7}\.\s*(?:наук|н\.)|канд\.|докт\.|[кд]\.\s?[тфэмпх]\.\s?[-]?[мн]?\.?\s?н\.|чл\.-кор\.)(?=\W|$)")
_QUOTED = re.compile(r"[«\"“„]+([^«»\"“”„]+)[»\"”“]*")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?")
_ORG_WORD = re.compile(r"(?i)институт|ин-т|объединени|об-ние|комбинат|комб-т|центр\b|бюро|завод|з-д|университет|ун-т|академия|издательств|изд-во|фабрика|ф-ка|общество|о-во|трест|музей|библиотек")
_PATRONYMIC = re.compile(r"(?:[oe]vich|[oe]vna|ichna|inichna|[ly]ich)$")


def roman(text: str) -> str:
    return "".join(ROMAN.get(c, c) for c in text.lower())


SHORT_LATIN = {
    "Bill": "William", "Will": "William", "Bob": "Robert", "Rob": "Robert", "Dick": "Richard", "Jim": "James", "Jack": "John", "Tom": "Thomas", "Ted": "Edward", "Ed": "Edward",
    "Mike": "Michael", "Joe": "Joseph", "Tony": "Anthony", "Dan": "Daniel", "Dave": "David", "Sam": "Samuel", "Steve": "Stephen", "Kate": "Catherine", "Liz": "Elizabeth",
    "Beth": "Elizabeth", "Peggy": "Margaret", "Maggie": "Margaret", "Sue": "Susan", "Hans": "Johannes", "Fritz": "Friedrich", "Kurt": "Konrad", "Pepe": "José", "Paco": "Francisco",
}
_ENDING = re.compile(r"(?:iy|yy|ij|y|j)$")
_SYSTEMS = [(re.compile(a), b) for a, b in ((r"^ye", "e"), (r"^yo", "e"), (r"x", "ks"), (r"w", "v"), (r"[’'`]", ""), (r"ia$", "iya"), (r"iu", "yu"))]


@lru_cache(maxsize=200_000)
def latin(word: str) -> str:
    """Small Latin letters without accents, one spelling for all systems of romanisation."""
    w = "".join(c for c in unicodedata.normalize("NFD", roman(word)) if not unicodedata.combining(c))
    if not any("\u0400" <= c <= "\u052f" for c in word):
        for pattern, new in _SYSTEMS:
            w = pattern.sub(new, w)
    return _ENDING.sub("i", w) if len(w) > 2 else w


SHORT_ROMAN = {latin(k): latin(v) for k, v in (SHORT | SHORT_LATIN).items()}
GIVEN_ROMAN = {latin(n) for n in GENDER} | set(SHORT_ROMAN)
# One Latin letter for two initials: names known to begin with the rarer one are told apart.
_E_NAMES = {latin(n) for n in [*GENDER, *SHORT] if n.startswith("Э")}
#: What stands for "no author" in a catalogue; no name.
NOBODY = re.compile(r"(?i)^(?:б\.?\s?а\.?|без автора|no author|anon\.?|n\.?\s?n\.?)$")


def _clean(text: str) -> str:
    t = unicodedata.normalize("NFKC", text)

    def one_script(m):
        w = m[0]
        cyr = sum("Ѐ" <= c <= "ӿ" for c in w)
        if 0 < cyr < sum(c.isalpha() for c in w) and all("Ѐ" <= c <= "ӿ" or c in LOOKALIKE or not c.isalpha() for c in w):
            return "".join(LOOKALIKE.get(c, c) for c in w)
        return w

    t = re.sub(r"[^\W_]+", one_script, t)
    return re.sub(r"\s+", " ", t).strip()


def _acronym(words: list[str]) -> str:
    out = ""
    for w in words:
        for k, part in enumerate(w.split("-")):
            if part and (k == 0 or len(part.rstrip(".")) >= 4):
                out += _fold(roman(part))[:1]
    return out


def read_name(text: str) -> tuple[str, str, str, str, str] | None:
    """``(kind, core, given, patronymic, type)`` in Latin letters; None only where there are no letters, or words for "no author"."""
    t = ROLE.sub(" ", _clean(text))
    t = re.sub(r"\(\s*\)", " ", t).strip(" ,;()[]")
    if not any(c.isalpha() for c in t) or NOBODY.match(t):
        return None
    quoted = _QUOTED.search(t)
    words = _TOKEN.findall(t)
    if not words:
        return "o", _core(t), "", "", ""
    if quoted or _ORG_WORD.search(t) or _is_type(words) or len(words) == 1 and _type_token(words[0]):
        if quoted:
            core, rest = quoted[1], t[:quoted.start()] + " " + t[quoted.end():]
            kind_words = _TOKEN.findall(rest)
        else:
            at = 0 if len(words) > 1 and words[0][:1].isupper() and _type_token(words[-1]) and not _type_token(words[0]) else len(words) - 1
            core, kind_words = words[at], words[:at] + words[at + 1:]
        if len(kind_words) == 1 and _type_token(kind_words[0]):
            kind = _fold(roman(kind_words[0]))
        else:
            kind = _acronym(kind_words)
        return "o", _core(core), "", "", kind
    comma = t.find(",")
    first_is_surname = 0 < comma and len(_TOKEN.findall(t[:comma])) == 1
    parts = [(latin(w.rstrip(".")), w.endswith(".")) for w in words]
    rest = list(range(len(parts)))
    if first_is_surname:
        best = 0
    else:
        # the surname: the longest full word that is no given name or patronymic; at an end of the name
        options = [i for i in (rest[0], rest[-1]) if not parts[i][1] and len(words[i]) > 1] or rest
        best = max(options, key=lambda i: (_surnameness(parts, i), len(parts[i][0])))
    given, patronymic = [*[_part(words[i], parts[i][0]) for i in rest if i != best], "", ""][:2]
    return "p", _core(words[best]), given, patronymic, ""


def _part(word: str, w: str) -> str:
    """A given name or patronymic in full or short; a first letter Э is marked, in Latin letters only where the name is known."""
    w = SHORT_ROMAN.get(w, w)
    if word.rstrip(".") in ("E", "e"):
        return "è"
    return "ě" + w[1:] if word[0] in "Ээ" or w in _E_NAMES else w


def _core(text: str) -> str:
    return _fold(re.sub(r"[^\w]", "", latin(text)))


def _surnameness(parts, i) -> int:
    w = parts[i][0]
    if w in GIVEN_ROMAN or "-" in w and len(w) < 8 or (_PATRONYMIC.search(w) and i == len(parts) - 1 and len(parts) > 2 and parts[0][0] not in GIVEN_ROMAN):
        return 0
    if any(parts[j][0] in GIVEN_ROMAN for j in range(len(parts)) if j != i):
        return 3
    return 1 if len(parts) > 1 and _near_given(w) else 2


@lru_cache(maxsize=200_000)
def _near_given(w: str) -> bool:
    return any(abs(len(g) - len(w)) <= 1 and _edits(w, g) <= 1 for g in GIVEN_ROMAN)


def _type_token(w: str) -> bool:
    return 2 <= len(w) <= 4 and w.isalpha() and (w.isupper() or (w[0].isupper() and sum(c.isupper() for c in w) > 1))


def _is_type(words: list[str]) -> bool:
    return len(words) == 2 and (_type_token(words[0]) != _type_token(words[1])) and any(len(w) > 4 for w in words)


def _edits(a: str, b: str, limit: int = 2) -> int:
    """Typing errors between two words: inserted, missing, wrong or swapped letters."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if before2 is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        before2, before = before, row
    return before[-1]


def _fold(s: str) -> str:
    """One letter for each letter of the original alphabet, so that a typing error counts once however it is romanised."""
    for a, b in (("shch", "1"), ("zh", "2"), ("kh", "3"), ("ts", "4"), ("ch", "5"), ("sh", "6"), ("yu", "7"), ("ya", "8")):
        s = s.replace(a, b)
    return s


def _part_match(a: str, b: str) -> float | None:
    """How well two given names or patronymics agree; None if they contradict each other."""
    if not a or not b:
        return 0.9
    a, b = _fold(a), _fold(b)
    if "è" in (a, b):  # a Latin initial of either letter
        a, b = (b[0] if a == "è" else a), (a[0] if b == "è" else b)
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if long.startswith(short.rstrip("-")) and len(short) <= 3:
        return 0.97
    if "-" in a or "-" in b:  # letters left out in the middle
        x, y = (a, b) if "-" in a else (b, a)
        head, _, tail = x.partition("-")
        return 0.95 if y.startswith(head) and (not tail or y.endswith(tail) or len(y) <= 3) else None
    if len(short) == 1:
        return None
    return 0.9 if _edits(a, b) <= 1 and len(short) > 3 else None


def letter_pairs(core: str) -> list[str]:
    """The distinct pairs of letters that stand side by side or one letter apart, ends included."""
    w = f"^{core}$"
    return sorted({w[i] + w[j] for i in range(len(w)) for j in (i + 1, i + 2) if j < len(w)})


def gapped(core: str) -> set[str]:
    return {core} | {core[:i] + core[i + 1:] for i in range(len(core))}


def _bucket(pair: str) -> int:
    return (ord(pair[0]) * 1_000_003 + ord(pair[1])) % BUCKETS


class Grams:
    """Unit vectors of cores, given the share of cores that hold each (hashed) letter pair."""

    def __init__(self, frequency: dict[int, int], n: int):
        self.weight = np.sqrt(np.log1p(max(1, n) / np.array([max(1, frequency.get(b, 0)) for b in range(BUCKETS)])))
        self.known: dict[str, tuple] = {}

    def vector(self, core: str) -> tuple[set[str], dict[str, float]]:
        got = self.known.get(core)
        if got is None:
            pairs = letter_pairs(core)
            w = self.weight[[_bucket(p) for p in pairs]]
            got = gapped(core), dict(zip(pairs, (w / np.sqrt((w * w).sum())).tolist()))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[core] = got
        return got

    def parts(self, a: str, b: str) -> tuple[float, float]:
        """Cosines of the gapped n-grams and of the letter pairs."""
        (ga, pa_), (gb, pb) = self.vector(a), self.vector(b)
        return len(ga & gb) / (len(ga) * len(gb)) ** 0.5, sum(w * pb[p] for p, w in pa_.items() if p in pb)

    def cosine(self, a: str, b: str) -> float:
        long, short = self.parts(a, b)
        return GAPPED * long + (1 - GAPPED) * short

    def similarity(self, a: str, b: str) -> float:
        """Of two cores; 0 only for a man's and a woman's surname."""
        if a == b:
            return 1.0
        if a[-1:] != b[-1:] and "a" in (a[-1:], b[-1:]):
            return 0.0
        long, short = self.parts(a, b)
        linked = min(len(a), len(b)) >= LEAST_LETTERS and GAPPED * long + (1 - GAPPED) * short >= COSINE
        return LINKED if linked else max(FAR_LEAST, FAR * short)


def form_similarity(x: tuple[str, str], y: tuple[str, str]) -> float:
    """Of two (given name, patronymic); 0 only if they contradict each other."""
    g, p = _part_match(x[0], y[0]), _part_match(x[1], y[1])
    return 0.0 if g is None or p is None else g * p


def average_linkage(sim: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers. The weighted average similarity of members decides; a pair with similarity 0 is never put together.

    Chains of nearest neighbours: a pair that is nearest to each other is merged, which never changes what later merges see
    (the linkage is reducible), so the work is quadratic and the result that of merging the best pair each time.
    """
    n = len(sim)
    label = np.arange(n)
    if n < 2:
        return label
    avg = np.where(sim <= 0, -1.0, sim).astype(np.float64)
    np.fill_diagonal(avg, -2.0)
    size = np.asarray(weight, np.float64).copy()
    alive, chain = np.ones(n, bool), []
    for start in range(n):
        if not alive[start]:
            continue
        chain.append(start)
        while chain:
            i = chain[-1]
            row = np.where(alive, avg[i], -2.0)
            row[i] = -2.0
            j = int(np.argmax(row))
            if len(chain) > 1 and row[chain[-2]] >= row[j]:
                j = chain[-2]
            if row[j] < least:  # nothing joins i any more
                chain.pop()
                continue
            if len(chain) > 1 and j == chain[-2]:
                chain.pop()
                chain.pop()
                a, b = min(i, j), max(i, j)
                both = np.where((avg[a] < 0) | (avg[b] < 0), -1.0, (avg[a] * size[a] + avg[b] * size[b]) / (size[a] + size[b]))
                avg[a], avg[:, a] = both, both
                avg[a, a] = -2.0
                size[a] += size[b]
                alive[b] = False
                label[label == b] = a
                if not chain:  # what was merged may now be nearest to something else
                    chain.append(a)
            else:
                chain.append(j)
    return label


RECORD = "kind string, core string, given string, patronymic string, type string"


def name_records(names: DataFrame, name: str = "author") -> DataFrame:
    """``(name, kind, core, given, patronymic, type, n)`` of the distinct spellings that hold a name, ``n`` rows each."""
    distinct = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # Little data but much work a row: not to be merged into one task.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartitionById(tasks, F.pmod(F.xxhash64("name"), F.lit(tasks)).cast("int"))

    def run(batches):
        for batch in batches:
            read = [read_name(t) for t in batch.column(0).to_pylist()]
            take = pa.array([i for i, r in enumerate(read) if r], pa.int64())
            cols = list(zip(*[r for r in read if r])) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *[pa.array(c, pa.string()) for c in cols], batch.column(1).take(take)],
                ["name", "kind", "core", "given", "patronymic", "type", "n"])

    return distinct.mapInArrow(run, f"name string, {RECORD}, n long")


def gram_frequencies(cores: DataFrame) -> tuple[dict[int, int], int]:
    """In how many of the distinct cores each hashed letter pair stands, at most ``BUCKETS`` numbers, and the number of cores."""

    def run(batches):
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for core in batch.column(0).to_pylist():
                counts[list({_bucket(p) for p in letter_pairs(core)})] += 1
            counts[BUCKETS] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["b", "k"])

    got = {r["b"]: r["k"] for r in cores.select("core").mapInArrow(run, "b long, k long").groupBy("b").agg(F.sum("k").alias("k")).collect()}
    return got, got.pop(BUCKETS, 0)


def similar_cores(cores: DataFrame, frequency: tuple[dict[int, int], int], least: float = COSINE, top: int = TOP) -> DataFrame:
    """``(kind, core_a, core_b, cosine, in_top)``, ``core_a < core_b``: all pairs of the distinct ``(kind, core)`` with a cosine of ``least``
    or more, where ``least > 1 - GAPPED``.

    ``in_top`` tells the pairs among the ``top`` best of one of their cores (the top-n join) from the exact rest, which is kept
    so that no cap loses a link.
    """
    if least <= 1 - GAPPED:
        raise ValueError("below this threshold pairs without a common gapped n-gram would be lost")
    size = F.length("core")
    long = cores.where(size >= LEAST_LETTERS)
    grams = F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(
        F.substring("core", F.lit(1), i - 1), F.substring("core", i + 1, size))), F.col("core")))
    met = long.select("kind", "core", F.explode(grams).alias("gram")).groupBy("kind", "gram").agg(
        F.collect_set("core").alias("cores")).where(F.size("cores") > 1)
    pairs = met.select("kind", F.explode("cores").alias("core_a"), "cores").select(
        "kind", "core_a", F.explode(F.filter("cores", lambda x: x > F.col("core_a"))).alias("core_b")).distinct()

    def run(batches):
        vectors = Grams(*frequency)
        for batch in batches:
            cosine = np.array([vectors.cosine(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], np.float64)
            keep = pa.array(np.flatnonzero(cosine >= least))
            yield pa.RecordBatch.from_arrays([*[c.take(keep) for c in batch.columns], pa.array(cosine).take(keep)], ["kind", "core_a", "core_b", "cosine"])

    near = cut_lineage(pairs.mapInArrow(run, "kind string, core_a string, core_b string, cosine double"))
    best = None
    for side, other in (("core_a", "core_b"), ("core_b", "core_a")):
        w = Window.partitionBy("kind", side).orderBy(F.desc("cosine"), other)
        ranked = near.select("*", F.row_number().over(w).alias("rank"))
        best = ranked if best is None else best.unionByName(ranked)
    return best.groupBy("kind", "core_a", "core_b").agg(F.max("cosine").alias("cosine"), (F.min("rank") <= top).alias("in_top"))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(id, root)`` of all linked ids: each takes the least root among itself and its neighbours, until none changes.

    If ``rounds`` is given and more are needed, that is an error; roots that still move are never returned.
    """
    edges = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    for k in itertools.count():
        if k == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        near = edges.join(roots.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        new = roots.join(near, "id").select("id", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved"))
        # pointer jumping: the root's own root
        jump = new.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut_lineage(new.join(jump, "root").select("id", F.least("root", "up").alias("root"), "moved"))
        if new.where("moved").isEmpty():
            return new.select("id", "root")
        roots = new.select("id", "root")


def by_block(df: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """``work(rows)`` of the rows of each block of equal keys, as tuples of ``columns`` and in their order.

    Blocks are hashed to as many tasks as the session shuffles to; rows arrive sorted by block, so that a task holds one
    block at a time. ``work`` gives rows of the schema.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names_ = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        current, held, out = None, [], []

        def table():
            cols = list(zip(*out)) or [()] * len(names_)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names_)

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*lists[:len(keys)]), zip(*lists[len(keys):])):
                if key != current:
                    if held:
                        out.extend(work(held))
                    current, held = key, []
                held.append(row)
            if len(out) > 10_000:
                yield table()
        if held:
            out.extend(work(held))
        yield table()

    spread = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns).repartitionById(
        n, F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keys))]), F.lit(n)).cast("int"))
    return spread.sortWithinPartitions(*[f"_k{i}" for i in range(len(keys))], columns[0]).mapInArrow(run, schema)


def _linkage(items: list, weight: dict, similarity) -> dict:
    """Items to cluster numbers."""
    if len(items) == 1:
        return {items[0]: 0}
    sim = np.ones((len(items), len(items)))
    for i, j in itertools.combinations(range(len(items)), 2):
        sim[i, j] = sim[j, i] = similarity(items[i], items[j])
    return dict(zip(items, average_linkage(sim, np.sqrt([weight[x] for x in items]), LINKAGE).tolist()))


def _blocks(frequency: tuple[dict[int, int], int]):
    """The groups of one block of records ``(id, core, given, patronymic, n)`` that share component, initials and kind."""
    vectors = Grams(*frequency)

    def work(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return []
        weight: dict = defaultdict(int)
        for _, core, given, patronymic, n in rows:
            weight[core] += n
        group = _linkage(sorted(weight), weight, vectors.similarity)
        forms: dict = defaultdict(lambda: defaultdict(int))
        for _, core, given, patronymic, n in rows:
            forms[group[core]][given, patronymic] += n
        label = {g: _linkage(sorted(w), w, form_similarity) for g, w in forms.items()}
        first: dict = {}
        return [(id_, first.setdefault((group[core], label[group[core]][given, patronymic]), id_)) for id_, core, given, patronymic, _ in rows]

    return work


def _attached(frequency: tuple[dict[int, int], int]):
    """Records ``(id, core, given, patronymic, n, entity)`` without a patronymic, each with the entity it joins: of those with its
    core and initial, or else a linked core, the best."""
    vectors = Grams(*frequency)

    def work(rows: list[tuple]) -> list[tuple]:
        whole, by_core = defaultdict(list), defaultdict(set)
        for _, core, given, patronymic, n, entity in rows:
            if patronymic:
                whole[entity].append((core, (given, patronymic), n))
                by_core[core].add(entity)
        linked: dict[str, set] = {}
        out = []
        for id_, core, given, patronymic, _, _ in rows:
            if patronymic or not by_core:
                continue
            near = by_core.get(core)
            if near is None:
                near = linked.get(core)
                if near is None:
                    near = linked[core] = {e for c, es in by_core.items() if vectors.similarity(c, core) >= LINKED for e in es}
            best = (0.0, 0, 0)
            for e in near:
                sims = [vectors.similarity(core, c) * form_similarity((given, patronymic), f) for c, f, _ in whole[e]]
                if min(sims) > 0 and sum(sims) / len(sims) >= LINKAGE:
                    best = max(best, (round(sum(sims) / len(sims), 9), sum(n for *_, n in whole[e]), e))
            if best[0]:
                out.append((id_, best[2]))
        return out

    return work


def linked_names(names: DataFrame, name: str = "author") -> DataFrame:
    """``(name, entity, n)``: each distinct spelling with the number of its entity (alone or not) and of its rows.

    Null names, and spellings without a name (no letters, or words for "no author"), are left out; repeated rows add to ``n``.
    A bare surname that several entities share is an entity of its own.
    """
    spelled = name_records(names, name)
    fields = ["kind", "core", "given", "patronymic", "type"]
    # The id is a hash of the record, the same wherever it is computed.
    spelled = cut_lineage(spelled.withColumn("id", F.xxhash64(*fields)))
    records = spelled.groupBy("id", *fields).agg(F.sum("n").alias("n"))
    cores = records.select("kind", "core").distinct()
    frequency = gram_frequencies(cores)
    links = similar_cores(cores, frequency).select(F.xxhash64("kind", "core_a").alias("a"), F.xxhash64("kind", "core_b").alias("b"))
    roots = components(links)
    first = lambda c: F.translate(F.substring(c, 1, 1), "ěè", "ee")
    keyed = records.withColumn("core_id", F.xxhash64("kind", "core")).join(roots.withColumnRenamed("id", "core_id"), "core_id", "left").withColumns({
        "root": F.coalesce("root", "core_id"), "g": F.when(F.col("kind") == "o", F.col("type")).otherwise(first("given")), "p": first("patronymic")})
    fields = ["id", "core", "given", "patronymic", "n"]
    several = by_block(keyed, ["kind", "root", "g", "p"], fields, _blocks(frequency), "id long, entity long")
    grouped = cut_lineage(keyed.join(several, "id", "left").withColumn("entity", F.coalesce("entity", "id")))
    # Without a patronymic: beside groups with one.
    people = grouped.where("kind = 'p' AND g != ''")
    joins = by_block(people, ["root", "g"], [*fields, "entity"], _attached(frequency), "id long, joins long")
    grouped = grouped.join(joins, "id", "left").withColumn("entity", F.coalesce("joins", "entity")).drop("joins")
    # A bare surname: the one entity of that core.
    owners = grouped.where("kind = 'p' AND g != ''").groupBy("core_id").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).where("low = high")
    bare = F.when((F.col("kind") == "p") & (F.col("g") == ""), F.col("low"))
    final = grouped.join(owners.drop("high"), "core_id", "left").select("id", F.coalesce(bare, "entity").alias("entity"))
    return spelled.join(final, "id").select("name", "entity", "n")


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``(author_a, author_b)``: the pairs of spellings of one entity."""
    a, b = linked.select("entity", F.col("name").alias("author_a")), linked.select("entity", F.col("name").alias("author_b"))
    return a.join(b, "entity").where(F.col("author_a") < F.col("author_b")).select("author_a", "author_b").distinct()
