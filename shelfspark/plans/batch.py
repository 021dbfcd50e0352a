"""Very many queries against all postings: each block of objects answers every query, and only its best objects go on.

Joining queries to postings makes a row of every occurrence of every key of every query, which grows with the square of the
data if the queries do. Here postings travel, packed, to the block of their object, and the keys of all queries to every
block; no match travels but a block's best. Within a block a query is answered by whole arrays: a byte a segment tells
which keys it has, 64 bits the places of a key in it. Spans are worked out only for objects that may be among the best;
those left out are bounded from above, so that scores, order and totals are those of :func:`shelfspark.plans.search.rank`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.index import LEAST_FREQ, MOST_FREQ, Index
from shelfspark.plans.search import DEFAULT, SearchConfig, choose_keys, few, known_terms
from shelfspark.session import cut_lineage

#: Postings of a block, and segments whose spans are worked out together.
BLOCK_ROWS, SPAN_ROWS = 1_500_000, 1 << 16
#: Postings that are packed together before they travel.
PACK_ROWS = 1 << 19
#: Fewer candidates than this are not worth pruning; an array for all segments is held of tokens in one segment of so many.
PRUNE_FROM, DENSE = 512, 8
#: More than what the order of additions changes and what rounding to 12 digits hides.
SLACK = 1e-11
ALL = np.uint64(2**64 - 1)
NO_OBJECT = -(1 << 63)
ANSWERS = "query_id long, object_id long, score double, matches_count long, found long"


def best_of_queries(terms: DataFrame, index: Index, first: int = 0, count: int = 10, config: SearchConfig = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, object_id, score, matches_count, total)`` of the page of each query of ``terms``.

    The keys are written once, as their frequencies decide the number of blocks. Repeated postings do not matter; those
    without a segment or place count for nothing but frequency. An object is answered by one task, with its postings in memory.
    """
    if config.compat or config.max_keys > 16:
        raise ValueError("blocks answer queries of at most 16 keys, without the quirks of the original")
    spark = terms.sparkSession
    keys = cut_lineage(choose_keys(known_terms(terms, index), config).select("query_id", "slot", "token", "freq", "idf", "min_weight"))
    tokens = keys.select("token", "freq").distinct()
    n_tokens, rows = tokens.agg(F.count(F.lit(1)), F.sum("freq")).first()
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil((rows or 0) / block_rows))
    occ = index.postings.where("segment_id IS NOT NULL AND pos IS NOT NULL").join(few(tokens.select("token"), n_tokens), "token", "left_semi")
    occ = packed(occ, ["segment_id", "object_id", "pos"], blocks)
    asked = keys.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "token", F.col("query_id").cast("long").alias("query_id"), "slot", "idf", "min_weight")
    sent = occ.unionByName(asked, allowMissingColumns=True).repartitionById(blocks, F.col("block"))
    answers = sent.select("rows", "token", "query_id", "slot", "idf", "min_weight").mapInArrow(_answers(first + count), ANSWERS)
    queries = Window.partitionBy("query_id")
    order = queries.orderBy(F.desc(F.round("score", 12)), F.desc("object_id"))
    return answers.withColumns({"rank": F.row_number().over(order), "total": F.sum("found").over(queries)}).where(
        (F.col("rank") > first) & (F.col("rank") <= first + count)).select("query_id", "rank", "object_id", "score", "matches_count", "total")


def counted_lexicon(postings: DataFrame, least: int = LEAST_FREQ, most: int = MOST_FREQ, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(token, freq)`` as of :func:`shelfspark.operators.index.index_from_tables`; equal rows, which count once, meet in a block."""
    names = ["segment_id", "object_id", "pos", "weight"]
    blocks = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(postings.count() / block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, int] = {}
        held = [t for batch in batches for t in _unpacked(batch.column("rows"), tokens)]
        if held:
            once = pa.concat_tables(held).group_by(["code", *names], use_threads=False).aggregate([])
            n = np.bincount(once.column("code").to_numpy(), minlength=len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.string()), pa.array(n, pa.int64())], ["token", "freq"])

    parts = packed(postings, names, blocks).repartitionById(blocks, F.col("block")).select("rows").mapInArrow(run, "token string, freq long")
    return parts.groupBy("token").agg(F.sum("freq").alias("freq")).where(F.col("freq").between(least, most))


def packed(postings: DataFrame, names: list[str], blocks: int) -> DataFrame:
    """``(block, rows)``: the named columns and tokens of many postings of a block, compressed, as they travel."""
    rows = postings.where("token IS NOT NULL").select(F.pmod(F.xxhash64("object_id"), F.lit(blocks)).cast("int").alias("block"), "token", *names)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block, segment = table.column("block").to_numpy(), pc.fill_null(table.column("segment_id"), 0).to_numpy()
        order = np.lexsort((segment, block))
        table, block = table.select(["token", *names]).take(order).combine_chunks(), block[order]
        starts = runs(block)
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(block)]):
            part = table.slice(a, b - a)
            part = part.set_column(0, "token", part.column("token").combine_chunks().dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), pa.array(out, pa.binary())], ["block", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return rows.mapInArrow(run, "block int, rows binary")


def _unpacked(rows: pa.Array, tokens: dict[str, int]) -> Iterator[pa.Table]:
    """Tables of packed postings with a ``code`` for the token, by which ``tokens`` has it."""
    for x in rows.drop_null():
        table = pa.ipc.open_stream(x.as_buffer()).read_all()
        token = table.column("token").combine_chunks()
        numbers = np.array([tokens.setdefault(t, len(tokens)) for t in token.dictionary.to_pylist()], np.int64)
        yield table.set_column(0, "code", pa.array(numbers[token.indices.to_numpy()]))


def rounded(x: np.ndarray) -> np.ndarray:
    """Units of the twelfth digit, halves away from 0 as Spark's ``round`` has them."""
    y = np.abs(x) * 1e12
    r = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 0.01):
        r[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(12).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(r, x)


def later(places: np.ndarray, by: int) -> np.ndarray:
    """Places (words of 64, then segments) as seen from ``by`` places further on."""
    words, n = by // 64, places.shape[-2]
    if n == 1 and not words:
        return places >> np.uint64(by)
    out = np.zeros_like(places)
    out[..., :n - words, :] = places[..., words:, :] >> np.uint64(by % 64)
    if by % 64:
        out[..., :max(0, n - words - 1), :] |= places[..., words + 1:, :] << np.uint64(64 - by % 64)
    return out


def met(places: np.ndarray) -> np.ndarray:
    """Segments in which all keys have a place in common."""
    return (np.bitwise_and.reduce(places, axis=0) != 0).any(axis=0)


def shortest(places: np.ndarray) -> np.ndarray:
    """Length of the shortest stretch with a place of every key, of ``(key, word, segment)`` bits; none is without a bit."""
    _, words, n = places.shape
    if words > 1:
        length, live, seen, by = np.zeros(n, np.int64), np.arange(n), places, 1
        while len(live):
            hit = met(seen)
            length[live[hit]] = by
            live = live[~hit]
            seen = seen[..., ~hit] | later(places[..., live], by)
            by += 1
        return length
    # Where a stretch of `missed` places holds all keys nowhere, it is lengthened by halves.
    wide = [places[:, 0]]
    for s in (1, 2, 4, 8, 16):
        wide.append(wide[-1] | (wide[-1] >> np.uint64(s)))
    missed, seen = np.zeros(n, np.uint64), np.zeros_like(wide[0])
    for s, reach in zip((32, 16, 8, 4, 2, 1), reversed(wide)):
        longer = seen | (reach >> missed)
        miss = np.bitwise_and.reduce(longer, axis=0) == 0
        seen = np.where(miss, longer, seen)
        missed += np.where(miss, np.uint64(s), np.uint64(0))
    return missed.astype(np.int64) + 1


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def least_of(values: np.ndarray, n: int) -> float:
    """The ``n``-th largest."""
    return np.partition(values, -n)[-n]


class Block:
    """Postings of some objects: units are pairs of object and segment, in order of object; tokens are numbers."""

    def __init__(self, code: np.ndarray, segment: np.ndarray, obj: np.ndarray, pos: np.ndarray, n_tokens: int) -> None:
        self.objects, o = np.unique(obj, return_inverse=True)
        segments, s = np.unique(segment, return_inverse=True)
        units, unit = np.unique(o * len(segments) + s, return_inverse=True)
        self.n, self.owner = len(units), units // len(segments)
        pos = pos.astype(np.int64)
        low = pos.min()
        if pos.max() - low >= 64:  # not the places of an index; then each segment starts at its first
            at = np.argsort(unit, kind="stable")
            low = np.minimum.reduceat(pos[at], runs(unit[at]))[unit]
        pos = pos - low
        at = np.argsort(code * np.int64(self.n) + unit, kind="stable")
        pair = (code * np.int64(self.n) + unit)[at]
        starts = runs(pair)
        bit, word = np.uint64(1) << (pos[at] & 63).astype(np.uint64), pos[at] >> 6
        self.words = int(word.max()) + 1
        self.bits = np.stack([np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), starts) for w in range(self.words)])
        self.units = pair[starts] % self.n
        self.bounds = np.searchsorted(pair[starts] // self.n, np.arange(n_tokens + 1))
        self.dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in np.flatnonzero(np.diff(self.bounds) * DENSE >= self.n):
            a, b = self.bounds[c], self.bounds[c + 1]
            there, places = np.zeros(self.n, np.uint8), np.zeros((self.words, self.n), np.uint64)
            there[self.units[a:b]], places[:, self.units[a:b]] = 1, self.bits[:, a:b]
            self.dense[int(c)] = there, places

    def masks(self, codes: list[int]) -> np.ndarray:
        """Which of the keys each unit has."""
        kind = np.uint8 if len(codes) <= 8 else np.uint16
        out = np.zeros(self.n, kind)
        for j, c in enumerate(codes):
            if c in self.dense:
                out |= self.dense[c][0] * kind(1 << j)
            elif c >= 0:
                out[self.units[self.bounds[c]:self.bounds[c + 1]]] |= kind(1 << j)
        return out

    def places(self, codes: list[int], units: np.ndarray, n_keys: int) -> np.ndarray:
        """``(key, word, unit)`` bits; a key that a unit has not is everywhere, so that it asks for nothing."""
        out = np.full((n_keys, self.words, len(units)), ALL)
        for j, c in enumerate(codes):
            if c in self.dense:
                found = self.dense[c][1][:, units]
            elif c >= 0 and self.bounds[c] < self.bounds[c + 1]:
                own = self.units[self.bounds[c]:self.bounds[c + 1]]
                i = np.minimum(np.searchsorted(own, units), len(own) - 1)
                found = np.where(own[i] == units, self.bits[:, self.bounds[c] + i], np.uint64(0))
            else:
                continue
            out[j] = np.where((found != 0).any(axis=0), found, ALL)
        return out


def _weights(idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight and number of keys of every mask, and whether it passes; keys are added in order of slot."""
    masks = np.arange(1 << len(idf))
    weight, uniq = np.zeros(len(masks)), np.zeros(len(masks))
    for j, x in enumerate(idf):
        has = (masks >> j) & 1
        weight, uniq = weight + has * x, uniq + has
    passes = weight >= least
    near = np.flatnonzero(np.abs(weight - least) < SLACK)
    if len(near):
        passes[near] = rounded(weight[near]) >= rounded(np.array([least]))
    if len(idf) == 1:
        passes[:] = True
    passes[0] = False
    return weight, uniq, passes


def _candidates(block: Block, codes: list[int], units: np.ndarray, weight: np.ndarray, uniq: np.ndarray, owner: np.ndarray, top: int, rest: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the units may still hold one of the ``top`` best scores, and their places; a score is above that of a
    unit by ``rest`` at most. Stretches are lengthened until enough objects have all keys in one."""
    kept, places = np.arange(len(units)), block.places(codes, units, len(codes))
    seen, length = places, 1
    while len(kept) > PRUNE_FROM and length < 32:
        seen = seen | later(seen, length)
        length *= 2
        if length < 4:
            continue
        hit = met(seen)
        h = kept[hit]
        starts = runs(owner[h])
        if len(starts) < top:
            continue
        bound = least_of(np.maximum.reduceat(weight[h] + uniq[h] / (1000.0 * length), starts), top)
        may = weight[kept] + uniq[kept] / (1000.0 * np.where(hit, 1, length + 1)) + rest >= bound
        kept, places, seen = kept[may], places[..., may], seen[..., may]
    return kept, places


def _answers(last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, int] = {}
        held: list[pa.Table] = []
        asked: list[tuple] = []
        for batch in batches:
            held += _unpacked(batch.column("rows"), tokens)
            batch = batch.filter(batch.column("query_id").is_valid())
            code = np.array([tokens.setdefault(t, len(tokens)) for t in batch.column("token").to_pylist()], np.int64)
            asked.append((*(batch.column(c).to_numpy() for c in ("query_id", "slot", "idf", "min_weight")), code))
        if not held or not sum(len(x[0]) for x in asked):
            return
        query, slot, idf, least, code = (np.concatenate(x) for x in zip(*asked))
        table = pa.concat_tables(held)
        held.clear()
        block = Block(*(pc.fill_null(table.column(c), NO_OBJECT if c == "object_id" else 0).to_numpy() for c in ("code", "segment_id", "object_id", "pos")), len(tokens))
        del table
        at = np.lexsort((slot, query))
        query, code, idf, least = query[at], code[at], idf[at], least[at]
        starts = runs(query)
        n_keys = int(np.diff(np.r_[starts, len(query)]).max())
        parts: list[tuple] = []
        waiting = 0
        for a, b in zip(starts, np.r_[starts[1:], len(query)]):
            part = _finalists(block, code[a:b].tolist(), idf[a:b], least[a], last, n_keys)
            if part is not None:
                parts.append((query[a], *part))
                waiting += len(part[2])
            if waiting >= SPAN_ROWS:
                yield _best(block, parts, last)
                parts, waiting = [], 0
        if parts:
            yield _best(block, parts, last)

    return run


def _finalists(block: Block, codes: list[int], idf: np.ndarray, least: float, last: int, n_keys: int) -> tuple | None:
    """Number of objects found, and of those that may be among the best: ``(objects, segments each)``, weight, keys and
    places of all their segments."""
    weight, uniq, passes = _weights(idf, least)
    masks = block.masks(codes)
    units = np.flatnonzero(passes[masks])
    if not len(units):
        return None
    mask, owner = masks[units], block.owner[units]
    starts = runs(owner)
    n = np.diff(np.r_[starts, len(units)])
    top, w = min(last, len(starts)), weight[mask]
    # The mean of the segments adds little, and is known but for their spans.
    mean, log = np.add.reduceat(w, starts) / n, np.log(1.0 + n) / 1e6
    low, high = mean * log, (mean + len(codes) / 1000.0) * log
    if len(codes) == 1:  # every span is one place
        score = (weight[1] + 1 / 1000.0) * log
        chosen = np.flatnonzero(score + SLACK >= least_of(score, top))
        if len(chosen) > 2 * top:
            chosen = np.sort(chosen[np.lexsort((chosen, rounded(score[chosen] + weight[1] + 1 / 1000.0)))[-top:]])
        wanted = _ranges(starts[chosen], n[chosen])
        return len(starts), (owner[starts[chosen]], n[chosen]), w[wanted], np.ones(len(wanted)), np.full((n_keys, block.words, len(wanted)), ALL)
    rest = float(high.max()) + SLACK
    bound = least_of(np.maximum.reduceat(w, starts) + low, top)
    near = np.flatnonzero((weight + uniq / 1000.0 + rest >= bound)[mask])
    kept, places = _candidates(block, codes, units[near], w[near], uniq[mask[near]], owner[near], top, rest)
    near = near[kept]
    raw = w[near] + uniq[mask[near]] / (1000.0 * shortest(places))
    found = runs(owner[near])
    best, which = np.maximum.reduceat(raw, found), np.searchsorted(starts, near[found], "right") - 1
    chosen = which[best + high[which] + SLACK >= least_of(best + low[which], top)]
    wanted = _ranges(starts[chosen], n[chosen])
    return len(starts), (owner[starts[chosen]], n[chosen]), w[wanted], uniq[mask[wanted]], block.places(codes, units[wanted], n_keys)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)


def _best(block: Block, parts: list[tuple], last: int) -> pa.RecordBatch:
    """The best objects of several queries, scored by all their segments; the first of a query carries the number found."""
    numbers, found, objects, w, uniq, places = zip(*parts)
    n = np.concatenate([x[1] for x in objects])
    owner = np.concatenate([x[0] for x in objects])
    query = np.repeat(np.arange(len(parts)), [len(x[0]) for x in objects])
    raw = np.concatenate(w) + np.concatenate(uniq) / (1000.0 * shortest(np.concatenate(places, axis=2)))
    starts = np.r_[0, np.cumsum(n)[:-1]]
    score = np.maximum.reduceat(raw, starts) + np.add.reduceat(raw, starts) / n * np.log(1.0 + n) / 1e6
    order = np.lexsort((-owner, -rounded(score), query))
    begin = runs(query[order])
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    order, place = order[place < last], place[place < last]
    ids = block.objects[owner[order]]
    return pa.RecordBatch.from_arrays([
        pa.array(np.array(numbers, np.int64)[query[order]]), pa.array(ids, pa.int64(), mask=ids == NO_OBJECT), pa.array(score[order]),
        pa.array(n[order].astype(np.int64)), pa.array(np.where(place == 0, np.array(found, np.int64)[query[order]], 0))],
        ["query_id", "object_id", "score", "matches_count", "found"])
