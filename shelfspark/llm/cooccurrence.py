"""Items that appear together: a blocked Gram matrix over binary baskets.

Each basket becomes a row of a sparse binary matrix X. Record blocks (Arrow batches gathered to ``block_rows``) give
partial products X_b^T X_b in local item numbers; their non-zero entries of the upper triangle, diagonal included, are
summed by Spark, hashed by item pair, so no task holds an item's whole row. The diagonal holds the marginals, against
which the counts are normalised: lift = n_ab * N / (n_a * n_b).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

BLOCK_ROWS = 1 << 19


def _entries(codes: np.ndarray, basket: np.ndarray, n_items: int):
    """Non-zero entries of the upper triangle of X^T X of one record block: item numbers and counts."""
    cell = np.unique(basket.astype(np.int64) * n_items + codes)  # X is binary
    row, item = cell // n_items, cell % n_items
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    width = np.diff(np.r_[first, len(row)])
    keys = [item * n_items + item]
    place = np.arange(len(row)) - np.repeat(first, width)
    left = np.repeat(width, width) - 1 - place  # items of the basket that follow
    step = 1
    while True:  # the k-th off-diagonal of every basket at once
        at = np.flatnonzero(left >= step)
        if not len(at):
            break
        keys.append(item[at] * n_items + item[at + step])
        step += 1
        if sum(map(len, keys)) > 8 * BLOCK_ROWS:
            keys = [np.concatenate(keys)]
            yield np.unique(keys[0], return_counts=True)
            keys = []
    if keys:
        yield np.unique(np.concatenate(keys), return_counts=True)


def gram(baskets: DataFrame, items: str) -> DataFrame:
    """``(item_a, item_b, n)`` for ``item_a <= item_b``: the baskets that hold both; equal items give the marginals,
    and a row with null items has the number of baskets that hold any.

    ``items`` is an array column; nulls in it and repeated items count once or not at all; empty baskets add nothing.
    """

    def run(batches):
        held, rows = [], 0

        def flush():
            table = pa.concat_arrays(held)
            flat = table.flatten()
            basket = np.repeat(np.arange(len(table)), np.diff(table.offsets.to_numpy()))
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            # Item numbers follow code point order, so that a <= b in numbers is a <= b in strings.
            coded = flat.filter(pa.array(valid)).dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False)
            order = np.argsort(words, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words = words[order]
            if not len(words):
                return
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([len(np.unique(basket[valid]))], pa.int64())],
                ["item_a", "item_b", "n"])
            for keys, counts in _entries(rank[coded.indices.to_numpy()], basket[valid], len(words)):
                for lo in range(0, len(keys), BLOCK_ROWS):
                    k = keys[lo:lo + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[k // len(words)], pa.string()), pa.array(words[k % len(words)], pa.string()),
                         pa.array(counts[lo:lo + BLOCK_ROWS].astype(np.int64))], ["item_a", "item_b", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0))
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    partial = baskets.select(F.col(items).alias("items")).mapInArrow(run, "item_a string, item_b string, n long")
    return partial.groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def associations(baskets: DataFrame, items: str, least: int = 1) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_total, lift)`` of the item pairs with ``n_ab >= least``.

    ``n_total`` counts the baskets with an item. The product is formed once and written to the checkpoint folder: pairs,
    marginals and the total are all read from it.
    """
    g = cut_lineage(gram(baskets, items).where((F.col("n") >= least) | F.col("item_a").isNull() | (F.col("item_a") == F.col("item_b"))))
    single = g.where(F.col("item_a") == F.col("item_b"))
    total = g.where(F.col("item_a").isNull()).select(F.col("n").alias("n_total"))
    pairs = g.where(F.col("item_a") != F.col("item_b")).select("item_a", "item_b", F.col("n").alias("n_ab"))
    for side in "ab":
        pairs = pairs.join(single.select(F.col("item_a").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    return pairs.crossJoin(F.broadcast(total)).select(  # one row
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_total",
        (F.col("n_ab") * F.col("n_total") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))


RUN = 64  # neighbouring pairs that travel together and so compress


def _pair_rows(pairs: DataFrame) -> DataFrame:
    """The distinct rows with a successor, as ``(token, next_token)``.

    A row travels as one string, so that what it shares with its neighbours costs next to nothing in the shuffle; lengths
    in its head make it exact whatever the texts hold. Runs of a field go to one task each, not whole fields.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = lambda c: F.coalesce(F.length(c), F.lit(-1)).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat_ws(",", number("object_id"), number("pair_no"), size("field_id"), size("token"))
    rows = pairs.where(F.col("next_token").isNotNull()).select(
        F.pmod(F.xxhash64("object_id", "field_id", F.floor(F.col("pair_no") / RUN)), F.lit(n)).cast("int").alias("_task"),
        F.concat(head, F.lit("|"), text("field_id"), text("token"), F.col("next_token")).alias("_row"))
    once = rows.repartitionById(n, F.col("_task")).groupBy("_task", "_row").agg(F.count(F.lit(1)).alias("_n"))
    head = F.substring_index("_row", "|", 1)
    sizes = F.split(head, ",")
    field, token = F.greatest(sizes[2].cast("int"), F.lit(0)), sizes[3].cast("int")
    at = F.length(head) + 2 + field
    return once.select(
        F.when(token >= 0, F.substring("_row", at, token)).alias("token"),
        F.substring("_row", at + F.greatest(token, F.lit(0)), F.lit(1 << 30)).alias("next_token"))


def token_associations(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Associations of the two tokens of each distinct row of ``token_pairs`` with a successor (a null token is no item)."""
    return associations(_pair_rows(pairs).select(F.array("token", "next_token").alias("items")), "items", least)


def strong(assoc: DataFrame, least: int, lift: int) -> DataFrame:
    """Pairs with ``n_ab >= least`` and ``n_ab * N >= lift * n_a * n_b``, in exact arithmetic."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return assoc.where((F.col("n_ab") >= least) & (
        big("n_ab") * big("n_total") >= (big("n_a") * big("n_b")) * F.lit(lift).cast("decimal(4,0)")))


def as_found(assoc: DataFrame) -> DataFrame:
    return assoc.select(F.col("item_a").alias("token_a"), F.col("item_b").alias("token_b")).distinct()


