"""Text analysis: tokens with places, letter case, Russian stemming, romanisation, normalisation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a token is, and what counts as a capital.
TOKEN_CLASS = "0-9A-Za-zА-Яа-яЁё"
UPPER_CLASS = "A-ZА-ЯЁ"
SEGMENT_TOKENS = 64

_TOKEN = re.compile(f"[{TOKEN_CLASS}]+")


def tokens(text: Column) -> Column:
    """The tokens of a text, in order, as an array; null for a null text."""
    return F.regexp_extract_all(text, F.lit(f"[{TOKEN_CLASS}]+"), F.lit(0))


def case_fast(word: Column) -> Column:
    """1 for a word that starts with a capital, else 0."""
    return F.when(word.rlike(f"^[{UPPER_CLASS}]"), 1).otherwise(0)


def case_rich(word: Column) -> Column:
    """2 for a word of capitals only, 1 for one that starts with a capital, else 0."""
    return F.when(word.rlike(f"^[{UPPER_CLASS}]+$"), 2).otherwise(case_fast(word))


# The published Russian Snowball endings.
VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = "вшись|вши|в", "ившись|ывшись|ивши|ывши|ив|ыв"
REFLEXIVE = "ся|сь"
ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем|нн|вш|ющ|щ", "ивш|ывш|ующ"
VERB_1 = "ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н"
VERB_2 = "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
SUPERLATIVE = "ейше|ейш"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it (a plain reuse would repeat the whole tree)."""
    return F.transform(F.array(value), body)[0]


def stem_ru(word: Column) -> Column:
    """Russian Snowball stem. Only small letters count, as in the published rules; other words come out as they are."""

    def cut(x: Column, ending: str) -> Column:
        return F.regexp_replace(x, f"(?:{ending})$", "")

    def cut_after_a(x: Column, first: str, second: str) -> Column:
        """Endings of the first group go only after а or я; the longest ending decides."""
        return F.regexp_replace(x, f"(?:([ая])(?:{first})|(?:{second}))$", "$1")

    def inflection(rv: Column) -> Column:
        return let(cut(rv, REFLEXIVE), lambda plain: let(cut(plain, ADJECTIVE), lambda adjective: let(
            cut_after_a(plain, VERB_1, VERB_2), lambda verb: F.when(
                adjective != plain, cut_after_a(adjective, PARTICIPLE_1, PARTICIPLE_2)).when(verb != plain, verb).otherwise(cut(plain, NOUN)))))

    def first(rv: Column) -> Column:
        return let(cut_after_a(rv, GERUND_1, GERUND_2), lambda gerund: F.when(gerund != rv, gerund).otherwise(inflection(rv)))

    def derivation(w: Column, head: Column, two: Column) -> Column:
        before_r2 = F.length(F.regexp_extract(w, f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}][^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", 0))
        return let(before_r2, lambda r2: let(F.regexp_replace(two, "ость?$", ""), lambda short: F.when(
            (r2 > 0) & (F.length(head) + F.length(short) >= r2), short).otherwise(two)))

    def tidy(three: Column) -> Column:
        return let(cut(three, SUPERLATIVE), lambda best: let(F.regexp_replace(best, "нн$", "н"), lambda single: F.when(
            (best != three) | (single != best), single).otherwise(F.regexp_replace(three, "ь$", ""))))

    def stem(w: Column, head: Column) -> Column:
        return let(F.substring(w, F.length(head) + 1, F.length(w)), lambda rv: let(
            F.regexp_replace(first(rv), "и$", ""), lambda two: F.concat(head, let(derivation(w, head, two), tidy))))

    return let(word, lambda w: let(
        F.regexp_extract(w, f"^[^{VOWELS}]*[{VOWELS}]", 0), lambda head: F.when(head == "", w).otherwise(stem(w, head))))


# Romanisation of small letters.
SINGLE = ("абвгдезийклмнопрстуфыэ", "abvgdeziiklmnoprstufye")
SEVERAL = [("щ", "shch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "iu"), ("я", "ia"), ("ё", "io"), ("ь", "'"), ("ъ", '"')]


def romanise(word: Column) -> Column:
    """Small Cyrillic letters in ASCII."""
    out = F.translate(word, *SINGLE)
    for letter, roman in SEVERAL:
        out = F.replace(out, F.lit(letter), F.lit(roman))
    return out


def normalise(word: Column) -> Column:
    """The token of the index: stemmed if longer than four letters (before its case is lost), romanised, in small letters."""
    return romanise(F.lower(F.when(F.length(word) > 4, stem_ru(word)).otherwise(word)))


def segment_rows(fields: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Texts cut into segments of 64 tokens: ``(*keys, segment_no, seg_start, seg_length, words)``.

    ``words`` is an array of ``(pos, start, length, word)``. One Arrow-batched pass without a shuffle: Spark has no built-in
    that gives the places of all matches, and summing gaps by a window would shuffle every token. Null, empty and
    token-less texts have no segment.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fields.schema}

    def emit(batch, take, counts, starts, ends, words):
        n = np.array(counts, np.int64)  # tokens of each text
        a, b = np.array(starts, np.int32), np.array(ends, np.int32)
        at = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)  # a token's number in its text
        first = np.flatnonzero(at % SEGMENT_TOKENS == 0)
        stop = np.r_[first[1:], len(a)]
        owner = np.repeat(np.array(take, np.int64), -(-n // SEGMENT_TOKENS))
        tokens_ = pa.StructArray.from_arrays(
            [pa.array((at % SEGMENT_TOKENS).astype(np.int32)), pa.array(a), pa.array(b - a), pa.array(words, pa.string())], ["pos", "start", "length", "word"])
        return pa.RecordBatch.from_arrays(
            [batch.column(i).take(pa.array(owner)) for i in range(len(keys))]
            + [pa.array((at[first] // SEGMENT_TOKENS).astype(np.int32)), pa.array(a[first]), pa.array(b[stop - 1] - a[first]),
               pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)].astype(np.int32)), tokens_)],
            [*keys, "segment_no", "seg_start", "seg_length", "words"])

    def run(batches):
        for batch in batches:
            take, counts, starts, ends, words = [], [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                found = _TOKEN.findall(t) if t else None
                if not found:
                    continue
                take.append(i)
                counts.append(len(found))
                words += found
                for m in _TOKEN.finditer(t):
                    starts.append(m.start())
                    ends.append(m.end())
                if len(words) >= 200_000:
                    yield emit(batch, take, counts, starts, ends, words)
                    take, counts, starts, ends, words = [], [], [], [], []
            if words:
                yield emit(batch, take, counts, starts, ends, words)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [
        "segment_no int, seg_start int, seg_length int, words array<struct<pos:int,start:int,length:int,word:string>>"])
    return fields.select(*keys, text).mapInArrow(run, schema)


def split_nonempty(text: Column, delimiter: str) -> Column:
    """Parts of a text between delimiters, without the empty ones."""
    return F.filter(F.split(text, re.escape(delimiter)), lambda x: x != "")
