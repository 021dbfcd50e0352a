"""Filling fixed-capacity containers: conflict-constrained best fit, decreasing.

Texts are measured with a public tokenizer. A text above the capacity is cut into full containers and a rest; nothing
else is split. Pieces are spread over packing groups of a bounded size (``GROUP_CHARS`` characters, ``GROUP_ROWS`` rows),
each of which is packed by one task; a group wastes space in its last few containers only, about one in a thousand.

Within a group bins stand in residual order. Each bin carries a bitmap of the sources (hosts) and duplicate clusters it
holds. Clusters are components of near copies: sets of five-word shingles, candidates by minhash bands, an exact check.
A piece goes to the tightest bin that has room and shares no bit with it: a successor search from the piece's size
upward through the residuals, which goes on until a compatible bin is found. Copies of a text are never put together; two
texts of one source are if no other bin has room, since held apart at any price they would cost 4 % of the space.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.names import components
from shelfspark.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The pre-tokenizer pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
GROUP_CHARS, GROUP_ROWS = 10_000_000, 50_000
#: Near copies: sets of five-word shingles with a Jaccard similarity of SIMILAR percent or more. A pair at the threshold
#: shares no band with probability (1 - 0.8^6)^64 = 4e-9.
SHINGLE, SIMILAR, BANDS, BAND_ROWS = 5, 80, 64, 6
SET_ROWS = 500  # texts shingled at once


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text`` but with ``n_tokens``; a null text has 0."""
    keep = [c for c in df.columns if c not in (text, "n_tokens")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [0 if t is None else len(enc.encode_ordinary(t)) for t in pdf[text]]
            yield out

    return df.select(*keep, text).mapInPandas(run, f"{schema}, n_tokens int" if schema else "n_tokens int")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, end to end, and where each text starts; last, their number.

    A text of fewer words than a shingle has one shingle, a text without words none.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    coded = pc.list_flatten(split).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    text = pc.list_parent_indices(split).to_numpy()
    full = np.array(pc.not_equal(coded.dictionary, "").to_pylist(), bool)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, bool)
    text, word = text[full].astype(np.int64), hashes[coded.indices.to_numpy()[full]]
    # Pads make a short text one shingle; a shingle starts where all its words are of one text.
    n = np.bincount(text, minlength=len(texts))
    pads = np.repeat(np.arange(len(texts)), np.where(n > 0, np.maximum(SHINGLE - n, 0), 0))
    text = np.concatenate([text, pads])
    order = np.argsort(text, kind="stable")
    text, word = text[order], np.concatenate([word, np.zeros(len(pads), np.uint64)])[order]
    m = max(0, len(word) - SHINGLE + 1)
    h = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        h = _mix(h * np.uint64(31) + word[k:k + m])
    whole = text[:m] == text[SHINGLE - 1:]
    text, h = text[:m][whole], h[whole]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][:len(h)]
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def bands(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhash bands of the sets that are not empty, a row of ``BANDS`` hashes each."""
    starts = starts[:-1][np.diff(starts) > 0]
    rng = np.random.default_rng(8)
    xor, odd = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    if len(starts):
        for k in range(BANDS * BAND_ROWS):
            least = np.minimum.reduceat((h ^ xor[k]) * (odd[k] | np.uint64(1)), starts)
            out[:, k // BAND_ROWS] = _mix(out[:, k // BAND_ROWS] * np.uint64(31) + least)
    return out


def with_sets(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text`` but with ``set_id``, ``bands`` and ``shingles``; all null for a text without words."""
    keep = [c for c in df.columns if c not in (text, "set_id", "bands", "shingles")]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SET_ROWS):
                batch = whole.slice(lo, SET_ROWS)
                h, starts = shingle_sets(batch.column(len(keep)))
                size = np.diff(starts)
                null = pa.array(size == 0)
                ids = np.zeros(len(size), np.uint64)
                if len(h):
                    ids[size > 0] = _mix(np.add.reduceat(_mix(h ^ np.uint64(SHINGLE)), starts[:-1][size > 0]) ^ size[size > 0].astype(np.uint64))
                offsets = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                rows = bands(h, starts).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], pa.array(ids.view(np.int64), mask=size == 0),
                     pa.ListArray.from_arrays(offsets(np.where(size > 0, BANDS, 0)), pa.array(rows.view(np.int64)), mask=null),
                     pa.ListArray.from_arrays(offsets(size), pa.array(h.view(np.int64)), mask=null)],
                    [*keep, "set_id", "bands", "shingles"])

    return df.select(*keep, text).mapInArrow(run, f"{schema}set_id long, bands array<long>, shingles array<long>")


def near_pairs(sets: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: the distinct sets of ``with_sets`` that are near copies. Bands propose, the sets decide."""
    held = sets.where(F.col("set_id").isNotNull())
    buckets = held.select("set_id", F.explode("bands").alias("band")).groupBy("band").agg(
        F.collect_set("set_id").alias("ids")).where(F.size("ids") > 1)
    pairs = cut_lineage(buckets.select(F.explode("ids").alias("a"), "ids").select(
        "a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b")).distinct())
    met = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    own = held.select("set_id", "shingles").join(met, "set_id", "left_semi").dropDuplicates(["set_id"])
    for side in "ab":
        pairs = pairs.join(own.select(F.col("set_id").alias(side), F.col("shingles").alias(f"s{side}")), side)
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * SIMILAR).select("a", "b")


def copy_clusters(sets: DataFrame) -> DataFrame:
    """``(set_id, cluster)`` of the sets that are near copies of another, or hold texts with the same ``letters`` as another."""
    same = sets.where(F.col("set_id").isNotNull()).groupBy("letters").agg(F.collect_set("set_id").alias("ids")).where(F.size("ids") > 1)
    links = near_pairs(sets).unionByName(same.select(F.explode("ids").alias("a"), F.col("letters").alias("b")))
    return components(links).select(F.col("id").alias("set_id"), F.col("root").alias("cluster"))


def best_fit(sizes: list[int], hard: list[int], soft: list[int], capacity: int) -> list[int]:
    """The bin of each item, largest first. ``hard`` bitmaps must not meet in a bin; ``soft`` ones meet only to save a bin."""
    at_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has residual r
    bin_mask: list[int] = []
    place = [0] * len(sizes)

    def search(size: int, mask: int) -> tuple[int, int]:
        """Takes the tightest bin with room that shares no bit with ``mask`` out of its residual, or (-1, capacity)."""
        nonlocal filled
        open_, r = filled >> size, size
        while open_:
            step = (open_ & -open_).bit_length() - 1
            r += step
            bins = at_residual[r]
            for k, b in enumerate(bins):
                if not bin_mask[b] & mask:
                    bins[k] = bins[-1]
                    bins.pop()
                    if not bins:
                        filled &= ~(1 << r)
                    return b, r
            open_ >>= step + 1
            r += 1
        return -1, capacity

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found, r = search(sizes[i], hard[i] | soft[i])
        if found < 0 and soft[i]:
            found, r = search(sizes[i], hard[i])
        if found < 0:
            found = len(bin_mask)
            bin_mask.append(0)
        place[i] = found
        bin_mask[found] |= hard[i] | soft[i]
        at_residual[r - sizes[i]].append(found)
        filled |= 1 << (r - sizes[i])
    return place


def pack(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "host", capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """``(container_id, doc_id, piece_no, first_token, n_tokens, offset)``: one row for each piece.

    ``first_token`` is the piece's place in its text, ``offset`` its place in the container. Documents with
    the same text apart from case, spacing and punctuation, and near copies (``SIMILAR`` percent of the five-word shingles of
    both, directly or through others), never share a container; those of one source do only if no other open container has
    room (a null source conflicts with none).
    A text without tokens, null included, takes a place of size 0. Repeated rows are packed each on their own.
    """
    letters = F.lower(F.regexp_replace(F.col(text), r"[^\p{L}\p{N}]+", ""))
    items = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(source)).alias("source"), F.isnull(F.col(source)).alias("no_source"),
        F.when(F.length(letters) > 0, F.xxhash64(letters)).alias("letters"), F.col(text).alias("text"), F.col(text).alias("copy"))
    size = docs.agg(F.sum(F.length(text)).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-(size["chars"] or 0) // GROUP_CHARS), -(-size["rows"] // GROUP_ROWS))
    sets = cut_lineage(with_sets(count_tokens(items, "text", tokenizer), "copy"))
    counted = sets.drop("bands", "shingles").join(copy_clusters(sets), "set_id", "left").withColumn("cluster", F.coalesce("cluster", "set_id"))
    pieces = counted.select(
        "doc_id", "source", "no_source", "cluster", "n_tokens",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1)) - 1)).alias("piece_no")
    ).select(
        "doc_id", "source", "no_source", "cluster", "piece_no", (F.col("piece_no") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).cast("int").alias("grp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        # Bits only for what can conflict: sources and clusters with more than one piece here.
        masks = {"source": [0] * len(pdf), "cluster": [0] * len(pdf)}
        bit = 0
        for column, skip in (("source", pdf["no_source"]), ("cluster", pdf["cluster"].isna())):
            values, uniques = pd.factorize(pdf[column].where(~skip))
            count = np.bincount(values[values >= 0], minlength=len(uniques))
            for i, v in enumerate(values):
                if v >= 0 and count[v] > 1:
                    masks[column][i] = 1 << (bit + int(v))
            bit += len(uniques)
        bins = best_fit(pdf["n_tokens"].tolist(), masks["cluster"], masks["source"], capacity)
        out = pdf[["doc_id", "piece_no", "first_token", "n_tokens"]].copy()
        out.insert(0, "container_id", (np.int64(pdf["grp"].iloc[0] if len(pdf) else 0) << 32) + np.asarray(bins, np.int64))
        out["offset"] = out.groupby("container_id")["n_tokens"].cumsum() - out["n_tokens"]
        return out

    kind = docs.schema[id_column].dataType.simpleString()
    return pieces.groupBy("grp").applyInPandas(
        run, f"container_id long, doc_id {kind}, piece_no int, first_token int, n_tokens int, offset int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, and the share of space used."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("used").alias("fullest"))
