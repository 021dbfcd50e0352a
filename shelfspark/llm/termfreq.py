"""Frequency of every term or n-gram, in how many records it occurs, and a mark on the too rare and too common.

Suffix-sorted counting: every position sends its suffix, cut to ``sigma`` terms, to the task of its first term; a task
sorts its suffixes in reverse lexicographic order, so that a prefix comes after all that extend it, and one pass with a
stack of at most ``sigma`` levels adds up counts and record sets of all prefixes. Suffixes travel with arrays of
occurrence codes. A first term whose load is above a task's fair share is routed to several tasks, by record; both the
distinct occurrences and the distinct records of its n-grams then add up over these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.balance import cut_arrays, plan_placement

#: Layout of an occurrence code: segment * 2^28 + object * 2^8 + pos * 4 + weight.
OBJECT_SHIFT, OBJECT_BITS = 8, 20
SEPARATOR = "\x1f"


def object_of(code: Column) -> Column:
    return F.shiftright(code, OBJECT_SHIFT).bitwiseAND(F.lit((1 << OBJECT_BITS) - 1))


def _stack_pass(shift: int, bits: int, distinct: bool):
    mask = -1 if bits >= 64 else (1 << bits) - 1

    def run(batches):
        stack: list[tuple[str, list[np.ndarray]]] = []  # terms of the current suffix, each with its occurrences
        out: list[tuple[str, int, int]] = []
        current = None

        def pop():
            codes = np.concatenate(stack[-1][1])
            codes = np.unique(codes) if distinct else codes
            records = len(np.unique((codes >> shift) & mask))
            out.append((SEPARATOR.join(t for t, _ in stack), len(codes), records))
            stack.pop()
            if stack:  # what extends a prefix also is an occurrence of it
                stack[-1][1].append(codes)

        def batch_out():
            rows = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())],
                ["ngram", "frequency", "records"])

        for batch in batches:
            if not batch.num_rows:
                continue
            suffixes, lists = batch.column(0), batch.column(1)
            coded = suffixes.dictionary_encode()
            ids, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for a, b in zip(starts, np.r_[starts[1:], len(ids)]):
                word = words[ids[a]]
                codes = values[offsets[a]:offsets[b]]
                if word != current:
                    terms = word.split(SEPARATOR)
                    same = 0
                    while same < min(len(stack), len(terms)) and stack[same][0] == terms[same]:
                        same += 1
                    while len(stack) > same:
                        pop()
                    for t in terms[same:]:
                        stack.append((t, []))
                    current = word
                stack[-1][1].append(codes)
                held = stack[-1][1]
                if len(held) > 4096:  # bounds the number of small arrays, and repeated chunks fold together
                    held[:] = [np.unique(np.concatenate(held)) if distinct else np.concatenate(held)]
            if len(out) >= 8192:
                yield batch_out()
        while stack:
            pop()
        yield batch_out()

    return run


def suffix_counts(
    suffixes: DataFrame, suffix: str, codes: str, shift: int = OBJECT_SHIFT, bits: int = OBJECT_BITS, distinct: bool = True,
) -> DataFrame:
    """``(ngram, frequency, records)`` of all prefixes of all suffixes; terms of an n-gram are joined by U+001F.

    ``suffix`` is a string of terms joined by U+001F, ``codes`` an array of occurrence codes whose record is
    ``(code >> shift) & (2^bits - 1)``. A repeated code counts once for its n-gram, unless ``distinct`` is false. Null suffixes,
    null or empty arrays and null codes add nothing.
    """
    rows = suffixes.select(F.col(suffix).alias("_suffix"), F.col(codes).alias("_codes")).where(F.col("_suffix").isNotNull()).withColumn(
        "_first", F.substring_index("_suffix", SEPARATOR, 1))
    placement = plan_placement(rows, "_first", weight=F.when(F.col("_codes").isNotNull(), F.size("_codes")))
    record = lambda c: c if bits >= 64 else F.shiftright(c, shift).bitwiseAND(F.lit((1 << bits) - 1))
    routed = (
        cut_arrays(rows, "_first", "_codes", placement, record)
        .select("_suffix", "_codes", "_shard", "_task")
        .repartitionById(placement.n_tasks, F.col("_task"))
        .sortWithinPartitions(F.col("_shard").desc(), F.col("_suffix").desc())
        .select("_suffix", "_codes")
    )
    counted = routed.mapInArrow(_stack_pass(shift, bits, distinct), "ngram string, frequency long, records long")
    return counted.groupBy("ngram").agg(F.sum("frequency").alias("frequency"), F.sum("records").alias("records"))


def term_marks(chunks: DataFrame, rare_below: int = 5, common_percent: int = 40) -> DataFrame:
    """``(token, frequency, objects, declared_freq, n_objects, mark)`` of each token of ``index_chunks``.

    ``frequency`` counts distinct codes over all rows of the token (chunks sent again add nothing), ``declared_freq`` is the
    sum of ``token_freq`` as sent. ``mark`` is ``rare``, ``common`` or null. A null token is none; a token without codes has
    frequency 0 and is rare.
    """
    counts = suffix_counts(chunks, "token", "token_codes")
    declared = chunks.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("token_freq").alias("declared_freq"))
    objects = (
        chunks.select(F.explode(F.array_distinct(F.transform("token_codes", object_of))).alias("o")).where(F.col("o").isNotNull())
        .distinct().agg(F.count(F.lit(1)).alias("n_objects"))
    )
    joined = declared.join(counts.withColumnRenamed("ngram", "token"), "token", "left").crossJoin(F.broadcast(objects))  # one row
    frequency, n = F.coalesce("frequency", F.lit(0)), F.coalesce("records", F.lit(0))
    return joined.select(
        "token", frequency.alias("frequency"), n.alias("objects"), "declared_freq", "n_objects",
        F.when(frequency < rare_below, "rare")
        .when(n * 100 >= F.col("n_objects") * common_percent, "common").alias("mark"))


def ngram_counts(fields: DataFrame, words: str, record: str, sigma: int = 3, least: int = 5) -> DataFrame:
    """``(ngram, n, frequency, records)`` of all n-grams of up to ``sigma`` terms that occur ``least`` times or more.

    ``words`` is an array column, one text a row; ``record`` any integer that says in which record it stands. Every row is a
    text of its own, so occurrences need no code but their record.
    """
    rows = fields.select(F.col(record).cast("long").alias("_record"), F.col(words).alias("_words"))
    # Suffixes are cut before the explode: else each of its rows would carry the whole text.
    cut = F.transform("_words", lambda w, i: F.array_join(F.slice("_words", i + 1, F.lit(sigma)), SEPARATOR))
    suffixes = rows.select("_record", F.explode(cut).alias("suffix")).select("suffix", F.array("_record").alias("codes"))
    counted = suffix_counts(suffixes, "suffix", "codes", 0, 64, False)
    return counted.where(F.col("frequency") >= least).select(
        "ngram", F.size(F.split("ngram", SEPARATOR)).alias("n"), "frequency", "records")


def ngram_marks(fields: DataFrame, words: str, record: str, sigma: int = 3, rare_below: int = 5, common_percent: int = 40) -> DataFrame:
    """``(ngram, n, frequency, records, n_records, mark)`` of all n-grams of up to ``sigma`` terms, with marks as in ``term_marks``.

    ``n_records`` counts the records with a word.
    """
    total = fields.where(F.size(words) > 0).agg(F.countDistinct(record).alias("n_records"))  # one row
    return ngram_counts(fields, words, record, sigma, 1).crossJoin(F.broadcast(total)).withColumn(
        "mark", F.when(F.col("frequency") < rare_below, "rare").when(F.col("records") * 100 >= F.col("n_records") * common_percent, "common"))
