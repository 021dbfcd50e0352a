"""Evaluation items that stand in documents, whole or in part.

Texts become words: lower case, without punctuation, spacing and invisible characters, with one spelling of yo. A *stretch* is
a run of a document and a run of an item laid side by side in which no two neighbouring words both differ. A document holds
an item if a stretch has ``LEAST_WORDS`` equal words, or as many words of which three quarters are equal.

Windows of five words, in the sixteen ``SHAPES`` (between two of them one place may be left free), have a 64-bit SimHash, the
bitwise majority of the words' hashes. Any five equal words that follow each other in a stretch are such a window, wholly
unchanged, so their fingerprints agree exactly: a stretch that counts has ``LEAST_HITS`` of them within ``REACH`` words.

1. A bit map of the items' fingerprints, sized by their number, goes to all tasks. One pass over the corpus keeps the
   documents in which enough windows lie in it close together; nothing else is written.
2. Fingerprints of kept documents and items are joined. Pairs with enough hits on one diagonal are candidates.
3. A candidate is verified exactly: along its diagonals the texts are compared word by word.

Why not windows as long as an item within a Hamming radius: a leak of 12 words in an item of 150 moves nearly as many bits
as another text does, and in a window of 12 words one changed word already moves 8 of 64 bits, every third one 17; blocks
that guarantee a radius of 17 would be under 4 bits wide.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

LEAST_WORDS = 12
SHAPES = [(0, *itertools.accumulate(steps)) for steps in itertools.product((1, 2), repeat=4)]
LEAST_HITS, REACH = 5, 24  # nine equal words of twelve hold five such windows, twelve equal words eight
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 32, 20, 30  # of the bit map; 2^30 bits are 128 MB, beyond which it only keeps less out

WORD = re.compile(r"[^\W_]+")
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])
_HAS_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")


def words(text: str) -> list[str]:
    if _HAS_INVISIBLE.search(text):
        text = text.translate(INVISIBLE)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower().replace("ё", "е"))


class Hasher:
    """Words to 64-bit hashes; every distinct word is hashed once."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 2_000_000:  # bounds the memory of a worker
            known.clear()
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def fingerprints(hashes: np.ndarray) -> list[np.ndarray]:
    """SimHash of each window of each shape: bit by bit what most of its five (word, place in the window) have.

    The place turns a word's hash, so that a word that stands there twice is not most of it. Shapes are told apart.
    """
    out = []
    turned = [hashes, *[(hashes << np.uint64(r)) | (hashes >> np.uint64(64 - r)) for r in (13, 26, 39, 52)]]
    for k, shape in enumerate(SHAPES):
        n = max(0, len(hashes) - shape[-1])
        a, b, c, d, e = (t[i:i + n] for t, i in zip(turned, shape))
        ab, two = a ^ b, a & b
        one, first = ab ^ c, two | (ab & c)  # sum and carry of three
        de, two = d ^ e, d & e
        second = two | (de & one)
        out.append(((first & second) | ((one ^ de) & (first | second))) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    return out


def _probes(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((prints * np.uint64(m)) >> np.uint64(64 - bits) & mask).astype(np.int64) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class BitMap:
    """Which fingerprints the items may have: two bits each; never wrong about one that they have."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits, self.packed = bits, np.zeros(1 << (bits - 3), np.uint8) if packed is None else packed

    def add(self, prints: np.ndarray) -> None:
        for at in _probes(prints, self.bits):
            np.bitwise_or.at(self.packed, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, prints: np.ndarray) -> np.ndarray:
        one, two = _probes(prints, self.bits)
        out = (self.packed[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(out)
        out[at] = (self.packed[two[at] >> 3] >> (two[at] & 7).astype(np.uint8)) & 1 == 1
        return out


def dense(at: np.ndarray, least: int = LEAST_HITS, reach: int = REACH) -> bool:
    """Whether ``least`` of the sorted places lie within ``reach`` words."""
    return len(at) >= least and bool((at[least - 1:] - at[:len(at) - least + 1] < reach).any())


def stretches(doc: list[str], item: list[str], shift: int, least: int = LEAST_WORDS) -> int:
    """The longest stretch in words that counts on the diagonal where ``doc[i]`` lies beside ``item[i + shift]``, or 0."""
    first, last = max(0, -shift), min(len(doc), len(item) - shift)
    best, start, end, equal = 0, None, None, 0
    for i in range(first, last + 1):
        same = i < last and doc[i] == item[i + shift]
        if same:
            if start is None:
                start, equal = i, 0
            equal, end = equal + 1, i + 1
        elif start is not None and (i >= last or i > end):  # two changed words in a row end it
            if equal >= least or end - start >= least and equal * 4 >= (end - start) * 3:
                best = max(best, end - start)
            start = None
    return best


def _item_rows(items: DataFrame) -> DataFrame:
    """``(item_id, words)`` of the text after the instruction line; null texts and texts of one line have none."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            held = [words((t or "").partition("\n")[2]) for t in batch.column(1).to_pylist()]
            take = pa.array([i for i, ws in enumerate(held) if ws], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([" ".join(ws) for ws in held if ws], pa.string())], ["item_id", "words"])

    return items.select("item_id", "item_text").mapInArrow(run, f"item_id {kind}, words string").distinct()


def _item_windows(rows: DataFrame) -> DataFrame:
    """``(f, item, q)``: fingerprint, item and place of each window."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, text in zip(numbers, texts):
                for prints in fingerprints(hasher(text.split(" "))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints.view(np.int64)), pa.array(np.full(len(prints), number, np.int64)), pa.array(np.arange(len(prints), dtype=np.int32))], ["f", "item", "q"])

    return rows.select("item", "words").mapInArrow(run, "f long, item long, q int")


def _bit_map(windows: DataFrame, n: int) -> BitMap:
    """Of the windows' fingerprints; a few tasks fill one each, which are united."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_WINDOW).bit_length()))

    def run(batches):
        own = BitMap(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.packed.tobytes()], pa.binary())], ["packed"])

    out = BitMap(bits)
    for r in windows.select("f").coalesce(4).mapInArrow(run, "packed binary").toLocalIterator():
        out.packed |= np.frombuffer(r[0], np.uint8)
    return out


def _kept(docs: DataFrame, id_column: str, text: str, shared) -> DataFrame:
    """``(doc, words, hits)`` of the documents with windows of the bit map close together, in one pass."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        hasher, (bits, packed) = Hasher(), shared.value
        known = BitMap(bits, packed)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 200):
                held = [words(t) for t in texts[lo:lo + 200]]
                starts = np.cumsum([0, *map(len, held)])
                hashes = hasher([w for ws in held for w in ws])
                at, prints = [], []
                for shape, f in zip(SHAPES, fingerprints(hashes)):
                    p = np.flatnonzero(known.has(f))
                    owner = np.searchsorted(starts, p, side="right") - 1
                    p = p[p + shape[-1] < starts[owner + 1]]
                    at.append(p)
                    prints.append(f[p])
                at, prints = np.concatenate(at), np.concatenate(prints)
                order = np.argsort(at, kind="stable")
                at, prints = at[order], prints[order]
                cuts = np.searchsorted(at, starts)
                take = [k for k in range(len(held)) if dense(at[cuts[k]:cuts[k + 1]])]
                hits = [[{"f": int(f), "p": int(p)} for f, p in zip(
                    prints[cuts[k]:cuts[k + 1]].view(np.int64).tolist(), (at[cuts[k]:cuts[k + 1]] - starts[k]).tolist())] for k in take]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([lo + k for k in take], pa.int64())), pa.array([" ".join(held[k]) for k in take], pa.string()),
                     pa.array(hits, pa.list_(pa.struct([("f", pa.int64()), ("p", pa.int32())])))], [id_column, "words", "hits"])

    return docs.where(F.length(text) > 0).select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, words string, hits array<struct<f:bigint,p:int>>")


def leaked_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_words)``: the items each document holds, with the longest stretch in words.

    Null and empty texts hold none, an item of fewer than ``least_words`` words is never found, repeated rows give one row.
    ``least_words`` may not be under ``LEAST_WORDS``, for which the windows are made.
    """
    if least_words < LEAST_WORDS:
        raise ValueError(f"at least {LEAST_WORDS} words")
    rows = cut_lineage(_item_rows(items).withColumn("item", F.monotonically_increasing_id()))
    windows = cut_lineage(_item_windows(rows))
    known = _bit_map(windows, windows.count())
    shared = docs.sparkSession.sparkContext.broadcast((known.bits, known.packed))  # 128 MB at most
    kept = cut_lineage(_kept(docs, id_column, text, shared).withColumn("doc", F.monotonically_increasing_id()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = kept.select("doc", F.explode("hits").alias("h")).select("doc", "h.f", "h.p").join(windows, "f")
    diagonals = met.groupBy("doc", "item", (F.col("q") - F.col("p")).alias("shift")).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= LEAST_HITS)
    candidates = diagonals.groupBy("doc", "item").agg(F.collect_list("shift").alias("shifts"))
    pairs = candidates.join(rows, "item").withColumnRenamed("words", "item_words").join(kept.select("doc", id_column, "words"), "doc")
    doc_kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def verify(batches):
        for batch in batches:
            doc_words, item_words, shifts = (batch.column(i).to_pylist() for i in (2, 3, 4))
            longest = []
            for d, i, s in zip(doc_words, item_words, shifts):
                d, i = d.split(" "), i.split(" ")
                longest.append(max(stretches(d, i, x, least_words) for x in s))
            take = pa.array([k for k, x in enumerate(longest) if x], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([x for x in longest if x], pa.int32())], [id_column, "item_id", "n_words"])

    spread = pairs.repartitionById(n, F.pmod(F.xxhash64("doc", "item"), F.lit(n)).cast("int"))
    found = spread.select(id_column, "item_id", "words", "item_words", "shifts").mapInArrow(
        verify, f"`{id_column}` {doc_kind}, item_id {item_kind}, n_words int")
    return found.groupBy(id_column, "item_id").agg(F.max("n_words").alias("n_words"))
