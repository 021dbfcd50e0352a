"""Text decoded with the wrong encoding: found, and restored where it can be.

Round-trip repair: garbled text is encoded back under the encoding it was wrongly decoded with and strictly decoded as the
encoding it had, for every pair in question; a repair is accepted when a garbling cost drops, and the result is tried
again for nested layers. The cost of a word is its bits under a character bigram model of all words of the data, most of
which are sound; characters outside the usual alphabets are dear.

As only a part of a text may be garbled, gains are added up along the words and the stretch with the largest total is
repaired. Where bytes were lost, so that no strict decoding exists, the text is still reported, with what could be
restored, and ``restored`` false.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (read as, really): how text comes to be garbled. Fixed by what is met in Cyrillic and Western European text.
READ_AS = ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
REALLY = {
    "utf-8": READ_AS,
    "cp1251": ("latin-1", "cp1252", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5"),
    "koi8-r": ("latin-1", "cp1252", "cp1251", "cp866", "mac-cyrillic"),
    "cp866": ("latin-1", "cp1252", "cp1251", "koi8-r", "mac-cyrillic"),
    "mac-cyrillic": ("cp1251", "latin-1", "cp1252", "koi8-r"),
    "iso8859-5": ("cp1251", "latin-1", "cp1252"),
}
PAIRS = [(read, really) for really, reads in REALLY.items() for read in reads]
#: Bits in all: where characters outside the alphabets are repaired, and where only letters stand; and bits a character.
LEAST_GAIN, LEAST_PLAIN_GAIN, LEAST_GAIN_RATE = 6.0, 16.0, 0.8
LAYERS = 4
SOUND_RATE = 7.2  # bits a character that repaired words may have; garbled text has 8 to 13
ALPHABET = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
LETTER = {c: i for i, c in enumerate(ALPHABET)}
RARE_CHAR_BITS = 11.0
_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789\n\r\t\u00ad")
#: Signs that stand alone or at a word's edge in sound text; inside a word they are as rare as any other character.
_SIGNS = set("«»—–№“”„’‘…•©°")
#: Letters of other languages' sound words: dearer than those of the model, far cheaper than other characters.
_FOREIGN = set("äöüßÄÖÜàáâãåæçèéêëìíîïñòóôõøùúûýÿœšžłąćęńśźżğşıėœŁŞČŠŽÅÆÇÉÈÊØÑÕÐðÞþđěřůťďőűіїєґўІЇЄҐЎјљњћќџђѕЈЉЊЋЌЏЂЅѣѳѵѢѲѴђ")
_CODED = re.compile("[^\x00-\x7f]")
#: Characters that cost ``RARE_CHAR_BITS`` or more wherever they stand.
_RARE = re.compile("[^" + re.escape(ALPHABET + ALPHABET.upper() + "".join(sorted(_PUNCT | _SIGNS | _FOREIGN))) + "]")


@lru_cache(maxsize=None)
def _tables(encoding: str) -> tuple[dict, dict]:
    """Character to byte and byte to character; bytes without a character stand for the control of the same number."""
    to_byte, to_char = {}, {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        to_byte.setdefault(c, b)
        to_char[b] = c
    for b in range(128, 160):  # controls pass where the table has something else, as browsers let them
        to_byte.setdefault(chr(b), b)
    return to_byte, to_char


class _Strict(dict):
    """A table for ``str.translate`` in which a character without a byte becomes a mark."""

    def __missing__(self, key):
        return _NO_BYTE


_NO_BYTE = "\ufffe"


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> _Strict:
    """Characters to the characters of Latin-1 with the same byte."""
    return _Strict({ord(c): chr(b) for c, b in _tables(encoding)[0].items()})


@lru_cache(maxsize=None)
def _from_bytes(encoding: str) -> dict:
    return {b: c for b, c in _tables(encoding)[1].items() if chr(b) != c}


def _as_read(text: str, read: str, strict: bool) -> str | None:
    """The bytes of a text under an encoding, as Latin-1 characters; lenient: 0xFF, never valid in UTF-8, for what has none."""
    t = text.translate(_to_bytes(read))
    if _NO_BYTE in t:
        return None if strict else t.replace(_NO_BYTE, "\xff")
    return t


def _really(as_read: str, really: str, strict: bool) -> str | None:
    if really == "utf-8":
        try:
            return as_read.encode("latin-1").decode("utf-8", "strict" if strict else "replace")
        except UnicodeDecodeError:
            return None
    return as_read.translate(_from_bytes(really))


def round_trip(text: str, read: str, really: str, strict: bool = True) -> str | None:
    """``text`` as it was before it was decoded as ``read`` instead of ``really``, or None."""
    t = _as_read(text, read, strict)
    return None if t is None else _really(t, really, strict)


class Cost:
    """Bits of a word under the bigram model, with the rules for case and for characters without a model."""

    def __init__(self, counts: dict[str, int]):
        n = len(ALPHABET) + 1
        total = [[0.3] * n for _ in range(n)]
        for pair, k in counts.items():
            a, b = (LETTER.get(c, n - 1) for c in pair)
            total[a][b] += k
        self.bits = [[-math.log2(x / sum(row)) for x in row] for row in total]
        self.known: dict[str, float] = {}
        self.beyond: dict[str, float] = {}

    def excess(self, w: str) -> float:
        """By how much a word is dearer than sound text; a strange word is always worth a look."""
        got = self.beyond.get(w)
        if got is None:
            got = self.word(w) - EXCESS_RATE * len(w) - EXCESS_BASE
            if got <= EXCESS_LEAST and _strange(w):
                got = EXCESS_LEAST + 0.1
            if len(self.beyond) > 500_000:
                self.beyond.clear()
            self.beyond[w] = got
        return got

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = self._word(w)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[w] = got
        return got

    def _word(self, w: str) -> float:
        edge = len(ALPHABET)
        before, bits, case, letters, script = edge, 0.0, "", 0, ""
        core_from = next((k for k, c in enumerate(w) if c not in _SIGNS and c not in "(\"'[<"), len(w))
        core_to = next((k for k in range(len(w), 0, -1) if w[k - 1] not in _SIGNS and w[k - 1] not in ".,:;!?)\"'>]"), 0)
        for k, c in enumerate(w):
            low = c.lower()
            i = LETTER.get(low)
            if i is None:
                if c in _PUNCT:
                    bits += 1.0
                elif c in _SIGNS and not core_from <= k < core_to and (k == 0 or w[k - 1] not in _SIGNS):
                    bits += 9.0 if c in "—–" and len(w) > 1 else 3.0 if c in "«»—–№©“”„" else 6.0
                elif c in _FOREIGN:
                    bits += 6.0
                    if case == "l" and letters and c.isupper():
                        bits += 7.0
                    if k and w[k - 1] in _FOREIGN:
                        bits += 4.0
                elif c == "�":
                    bits += 14.0
                elif "\x80" <= c <= "\x9f":
                    bits += 13.0
                else:
                    bits += RARE_CHAR_BITS
                before = edge
                case = case if c in _FOREIGN else ""
                script = ""
                continue
            bits += self.bits[before][i]
            up = c != low
            if letters and case == "l" and up:
                bits += 7.0  # a capital after a small letter
            kind = "c" if i >= 26 else "l"
            if script and kind != script:
                bits += 4.0
            script, case, before = kind, "u" if up else "l", i
            letters += 1
        if before != edge:
            bits += self.bits[before][edge]
        if letters > 1 and w[0] != w[0].lower() and w.isupper():
            bits += 1.5
        return bits


def bigram_counts(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of letter pairs (word edges are blanks) over all words of a column.

    Every row is counted. The result has at most 60 * 60 rows whatever the data, which is what comes to the driver.
    """
    n = len(ALPHABET) + 1
    place = np.full(0x500, n - 1, np.int64)
    for c, i in LETTER.items():
        place[ord(c)] = i

    def run(batches):
        counts = np.zeros(n * n, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                whole = " ".join(["", *[t for t in batch.column(0).slice(lo, 2000).to_pylist() if t is not None], ""]).lower()
                codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
                at = place[np.where(codes < 0x500, codes, 0)]
                counts += np.bincount(at[:-1] * n + at[1:], minlength=n * n)
        counts[-1] = 0  # two blanks
        keep = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(counts[keep])], ["p", "k"])

    letter = ALPHABET + " "
    got = texts.select(text).mapInArrow(run, "p long, k long").groupBy("p").agg(F.sum("k").alias("k")).collect()
    return {letter[r["p"] // n] + letter[r["p"] % n]: r["k"] for r in got}


def _stretch(gains: list[float]) -> tuple[float, int, int]:
    """The contiguous stretch with the largest sum."""
    best, at, end, run, start = 0.0, 0, 0, 0.0, 0
    for i, g in enumerate(gains):
        if run <= 0:
            run, start = 0.0, i
        run += g
        if run > best + 1e-9:
            best, at, end = run, start, i + 1
    return best, at, end


_WORD = re.compile(r"[^ \n\r\t]+")
_LOST = re.compile(r"�|(?:^|[\s(«\"])\?{2,}[?.,:;!]*(?=\s|$).*?[\s]\?{2,}|^\?{3,}[\s?.,:]*$")


EXCESS_RATE, EXCESS_BASE, EXCESS_LEAST = 5.0, 2.0, 3.0
GAP, MARGIN = 8, 3  # words between two dear ones, and around them, that are looked at together


def regions(words: list[str], cost: Cost) -> list[tuple[int, int]]:
    """Stretches of words that are dearer than sound text: all that could be garbled, with a margin."""
    out: list[list] = []
    known = cost.beyond
    found = [known[w] if w in known else cost.excess(w) for w in words]
    for i, excess in enumerate(found):
        if excess <= 0:
            continue
        if out and i - out[-1][1] <= GAP:
            out[-1][1] = i
            out[-1][2] += excess
        else:
            out.append([i, i, excess])
    return [(max(0, a - MARGIN), min(len(words), b + 1 + MARGIN)) for a, b, e in out if e > EXCESS_LEAST]


# No sound word: letters of two scripts, signs within, characters that are in no alphabet.
_ODD = re.compile(r"[a-zA-Z][\u0400-\u04ff]|[\u0400-\u04ff][a-zA-Z]|[\w][«»„“”•©°№—…‚„†‡ˆ‰‹›][\w]|[\u0080-\u00a0\ufffd¬®±§¶µ·¤¦¨¸€‰]|[а-яёѐ-џ][А-ЯЁЀ-Џ]|[—–“„][А-Яа-яЁё]|[А-Яа-яЁё][—–„]|^[^\w«»—–№“”„’…•©°.,;:!?()-]+$|[ЂЃЄЅЇЈЉЊЋЌЏђѓєѕїјљњћќџ].*[ЂЃЄЅЇЈЉЊЋЌЏђѓєѕїјљњћќџ]")


def _changed(w: str, new: str | None) -> int:
    """Characters that a repair alters; encodings that are close to each other alter few."""
    if new is None:
        return 0
    return sum(x != y for x, y in zip(w, new)) if len(w) == len(new) else len(w)


_CAPITAL_WITHIN = re.compile("[а-яё][А-ЯЁ]")


def _strange(w: str) -> bool:
    if _CAPITAL_WITHIN.search(w):
        return True
    return any(c > "\x7f" and c.lower() not in LETTER and c not in _FOREIGN and c not in "«»„“”—–№" for c in w)


class Repairer:
    """Repairs texts; remembers for each word what every pair of encodings would make of it."""

    def __init__(self, counts: dict[str, int]):
        self.cost = Cost(counts)
        self.known: tuple[dict, dict] = ({}, {})

    def _options(self, w: str, strict: bool) -> tuple[list[tuple[str | None, float]], list[int]]:
        """What each pair of encodings makes of a word, with the gain, and the pairs that gain anything."""
        known = self.known[strict]
        got = known.get(w)
        if got is None:
            if not _CODED.search(w):
                got = [(w, 0.0)] * len(PAIRS)
            else:
                bits, got, done = self.cost.word(w), [], {}
                as_read = {read: _as_read(w, read, strict) for read in READ_AS}
                for read, really in PAIRS:
                    t = as_read[read]
                    new = None if t is None else _really(t, really, strict)
                    if new is None or (not strict and (really != "utf-8" or new.count("�") * 2 > len(new))):
                        got.append((None, -30.0))
                        continue
                    gain = done.get(new)
                    if gain is None:
                        gain = 0.0
                        if new != w:
                            # Characters that no sound word has cost so much that the rest need not be added up.
                            dear = RARE_CHAR_BITS * len(_RARE.findall(new))
                            gain = bits - (dear if dear > 2 * bits + 10 else self.cost.word(new))
                        done[new] = gain
                    got.append((new, gain))
            if len(known) > 60_000:
                known.clear()
            got = known[w] = got, [p for p, (_, gain) in enumerate(got) if gain > 0]
        return got

    def _step(self, words: list[str], strict: bool) -> tuple[int, int, list[str]] | None:
        both = [self._options(w, strict) for w in words]
        options = [o for o, _ in both]
        best, pick = 0.0, None
        for p in sorted({p for _, good in both for p in good}):
            gain, a, b = _stretch([o[p][1] for o in options])
            if gain <= best or gain < LEAST_GAIN:
                continue
            size = sum(_changed(w, o[p][0]) for w, o in zip(words[a:b], options[a:b]))
            if gain < LEAST_GAIN_RATE * size or (gain < LEAST_PLAIN_GAIN and not any(map(_strange, words[a:b]))):
                continue
            best, pick = gain, (a, b, [w if o[p][0] is None else o[p][0] for w, o in zip(words[a:b], options[a:b])])
        return pick

    def repair(self, text: str) -> tuple[str, bool, bool]:
        """``(text, garbled, restored)``: the repaired text, whether any of it is garbled, whether all that is was restored."""
        lost = bool(_LOST.search(text))
        if not lost and not _CODED.search(text):
            return text, False, False
        words = _WORD.findall(text)
        garbled = False
        for a, b in regions(words, self.cost):
            part, layers = words[a:b], 0
            while layers < LAYERS * 2 and (step := self._step(part, True)):
                x, y, new = step
                part[x:y] = new
                layers += 1
            if layers:
                changed = [(w, x) for w, x in zip(words[a:b], part) if w != x]
                bits, size = sum(self.cost.word(x) for _, x in changed), sum(len(x) for _, x in changed)
                odd = sum(_ODD.search(x) is not None for _, x in changed)
                if bits <= SOUND_RATE * size + len(changed) and odd * 10 <= len(changed):  # cheaper and sound
                    garbled = True
                    words[a:b] = part
                else:
                    part = words[a:b]
            if self._broken(part) and self._step(part, False):
                garbled = lost = True
        if not garbled and not lost:
            return text, False, False
        out, at = [], 0
        for (a, b), w in zip([m.span() for m in _WORD.finditer(text)], words):
            out += [text[at:a], w]
            at = b
        return "".join([*out, text[at:]]), True, garbled and not lost

    @staticmethod
    def _broken(words: list[str]) -> bool:
        """Characters that no sound text has are left, so bytes may be missing."""
        return any(c == "�" or "\x80" <= c <= "\x9f" or (c > "\x7f" and c not in _PUNCT and c not in _SIGNS and c not in _FOREIGN and c.lower() not in LETTER)
                   or c in "ÐÑÂÃ" for w in words for c in w)


def repaired(cells: DataFrame, counts: dict[str, int], id_column: str = "row_id", text: str = "text") -> DataFrame:
    """Garbled cells only: ``(row_id, text, repaired_text, restored)`` plus the other columns of ``cells``.

    Null, empty and ASCII texts are never garbled. Repeated rows come out repeated.
    """
    keep = [c for c in cells.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    shared = cells.sparkSession.sparkContext.broadcast(counts)  # at most 60 * 60 entries

    def run(batches):
        repairer = Repairer(shared.value)
        for batch in batches:
            take, new, ok = [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                fixed, garbled, restored = repairer.repair(t)
                if garbled:
                    take.append(i)
                    new.append(fixed)
                    ok.append(restored)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in range(len(keep) + 1)] + [pa.array(new, pa.string()), pa.array(ok, pa.bool_())],
                [*keep, text, "repaired_text", "restored"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{text}` string, repaired_text string, restored boolean"])
    return cells.where(F.length(text) > 0).select(*keep, text).mapInArrow(run, schema)


def cells_of(tables: dict[str, tuple[DataFrame, list[str]]], id_column: str = "row_id") -> DataFrame:
    """``(table_name, row_id, column_name, text)`` of the named tables' columns; each table is read once."""
    cells = None
    for name, (df, columns) in tables.items():
        one = df.select(
            F.lit(name).alias("table_name"), F.col(id_column).alias("row_id"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns])).alias("cell"),
        ).select("table_name", "row_id", "cell.column_name", "cell.text")
        cells = one if cells is None else cells.unionByName(one)
    return cells


def garbled_cells(tables: dict[str, tuple[DataFrame, list[str]]], id_column: str = "row_id") -> DataFrame:
    """``(table_name, row_id, column_name, text, repaired_text, restored)`` of the garbled cells of the named tables' columns."""
    cells = cells_of(tables, id_column)
    return repaired(cells, bigram_counts(cells))
