"""Splitting long texts: content-defined chunking with natural boundaries and an overlap.

A hash of the last ``WINDOW`` tokens rolls over the text; places where it has ``LANDMARK_BITS`` zero bits are landmarks, set
by nothing but the tokens around them. A piece ends at the first landmark after its minimum size, snapped to the nearest
end of a paragraph, else line, else sentence, else word that keeps the piece within its minimum and maximum. As landmarks
and boundaries depend on local content only, an edit alters the pieces around it and the cuts fall in step again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP, MIN_TOKENS = 512, 32, 160
WINDOW, LANDMARK_BITS = 8, 5
TOKEN = re.compile("[0-9A-Za-zА-Яа-яЁё]+")
SENTENCE_END = re.compile(r"[.!?…][\"'»”)\]]*\s")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n|\r\n\s*\r\n")


def landmarks(tokens: list[str]) -> np.ndarray:
    """Hash of the ``WINDOW`` tokens up to and including each token (a cut after it)."""
    import xxhash

    known: dict[str, int] = {}
    h = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        v = known.get(t)
        if v is None:
            v = known[t] = xxhash.xxh64_intdigest(t)
        h[i] = v
    rolled = np.zeros(len(tokens), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, len(tokens))):
            rolled[k:] += h[:len(h) - k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) << np.uint64(k)
        rolled ^= rolled >> np.uint64(33)
        rolled *= np.uint64(0xFF51AFD7ED558CCD)
        rolled ^= rolled >> np.uint64(29)
    return rolled


def boundary_class(gap: str) -> int:
    """How natural a cut in the gap after a token is: 3 paragraph, 2 line, 1 sentence, 0 word."""
    if "\n" in gap or "\r" in gap:
        return 3 if PARAGRAPH.search(gap) else 2
    return 1 if SENTENCE_END.search(gap) else 0


def _cut_char(gap: str) -> int:
    """Where in the gap to cut: after its last line break, else after its last blank, else at its end."""
    at = max(gap.rfind("\n"), gap.rfind("\r"))
    if at < 0:
        at = max((i for i, c in enumerate(gap) if c.isspace()), default=len(gap) - 1)
    return at + 1


def split_text(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS):
    """Pieces ``(start, end, new_from, n_tokens)`` in characters; the text from ``new_from`` on is not in the piece before.

    The stretches ``[new_from, end)`` are the whole text, in order. Only the first piece has ``start == new_from``.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= max_tokens:
        return [(0, len(text), 0, n)]
    rolled = landmarks([text[a:b] for a, b in spans])
    mark = (rolled & np.uint64((1 << LANDMARK_BITS) - 1)) == 0
    kind = np.array([boundary_class(text[spans[i][1]:spans[i + 1][0]]) for i in range(n - 1)], np.int8)
    pieces, first, start, new_from = [], 0, 0, 0  # first: first new token
    while True:
        back = overlap if first else 0
        room = max_tokens - back
        if n - first <= room:
            pieces.append((start, len(text), new_from, n - first + back))
            return pieces
        lo, hi = first + min(min_tokens, room) - 1, first + room - 1  # last token of the piece, at least and at most
        window = np.flatnonzero(mark[lo:hi + 1])
        at = lo + (int(window[0]) if len(window) else int(np.argmin(rolled[lo:hi + 1])))
        best = kind[lo:hi + 1].max()
        places = lo + np.flatnonzero(kind[lo:hi + 1] == best)
        last = int(places[np.argmin(np.abs(places - at))]) if best else at
        gap_from = spans[last][1]
        end = gap_from + _cut_char(text[gap_from:spans[last + 1][0]])
        pieces.append((start, end, new_from, last + 1 - first + back))
        first, new_from = last + 1, end
        start = spans[first - overlap][0] if overlap else end


def chunk_texts(
    df: DataFrame, id_column: str = "row_id", text: str = "field_value", max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """``(row_id, piece_no, n_pieces, start, new_from, n_tokens, piece)``: one row for each piece of each non-null text.

    A text within the limit is one piece, however few tokens it has; an empty one is one empty piece; a null one is none.
    """
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            take, rows = [], []
            size = 0
            for i, t in enumerate(texts):
                cut = split_text(t, max_tokens, overlap, min_tokens)
                for k, (a, b, new, n) in enumerate(cut):
                    take.append(i)
                    rows.append((k, len(cut), a, new, n, t[a:b]))
                    size += b - a
                    if size > 32_000_000:
                        yield emit(ids, take, rows)
                        take, rows, size = [], [], 0
            yield emit(ids, take, rows)

    def emit(ids, take, rows):
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int32()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            [id_column, "piece_no", "n_pieces", "start", "new_from", "n_tokens", "piece"])

    return df.where(F.col(text).isNotNull()).select(id_column, text).mapInArrow(
        run, f"`{id_column}` {id_type}, piece_no int, n_pieces int, start int, new_from int, n_tokens int, piece string")


def oversized(df: DataFrame, id_column: str = "row_id", text: str = "field_value") -> DataFrame:
    """The ids of texts that had to be cut."""
    return chunk_texts(df, id_column, text).where(F.col("n_pieces") > 1).select(id_column).distinct()
