"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

``plan_placement`` measures the load of every key with a map-side-combined aggregate. A key whose load exceeds
``1 / (fragments_per_task * n_tasks)`` of the total is *heavy*: it is cut into shards in proportion to its load. There
are at most ``fragments_per_task * n_tasks`` such keys whatever the data, which bounds what is collected and broadcast.
All other keys are hashed to ``buckets_per_task * n_tasks`` buckets. Shards and buckets are then bin-packed to tasks,
largest first onto the least loaded task, and ``repartitionById`` sends each row to exactly the planned task.

A shard of a key is chosen by hashing *sub-key* columns, so rows that agree on these stay together. For joins the other side
is replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import let
from shelfspark.session import cut_lineage, fresh


@dataclass(frozen=True)
class Placement:
    """Which task gets which part of which key.

    ``heavy`` has the columns ``key`` and ``slots`` (task of each shard); ``bucket_tasks`` the task of each bucket of
    light keys; ``task_loads`` the planned load of each task; ``loads`` the measured ``(key, load)`` of every key, which
    lies in the checkpoint folder.
    """

    n_tasks: int
    total: int
    heavy: DataFrame
    bucket_tasks: list[int]
    task_loads: list[int]
    shards: dict
    loads: DataFrame


def pack(loads: list[int], n_tasks: int) -> tuple[list[int], list[int]]:
    """Largest first onto the least loaded task: the task of each item, and the load of each task."""
    heap = [(0, t) for t in range(n_tasks)]
    task_of, task_loads = [0] * len(loads), [0] * n_tasks
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, t = heapq.heappop(heap)
        task_of[i] = t
        task_loads[t] = load + loads[i]
        heapq.heappush(heap, (task_loads[t], t))
    return task_of, task_loads


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def plan_placement(
    df: DataFrame,
    key: str,
    weight: Column | None = None,
    n_tasks: int | None = None,
    fragments_per_task: int = 4,
    buckets_per_task: int = 16,
) -> Placement:
    """Measure loads (``weight`` per row, default 1) and pack them. A null key is a key of its own; null weights are 0.

    The rows are read once, for the loads; the total and the heavy keys come from these.
    """
    spark = df.sparkSession
    n_tasks = n_tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    rows = df.select(F.col(key).alias("key"), w.cast("long").alias("w"))
    loads = cut_lineage(rows.groupBy("key").agg(F.sum("w").alias("load")))
    total = loads.agg(F.sum("load")).first()[0] or 0
    limit = max(1, math.ceil(total / (n_tasks * fragments_per_task)))
    n_buckets = n_tasks * buckets_per_task
    measured = (
        loads.withColumn("heavy", F.col("load") > limit)
        .groupBy("heavy", F.when(F.col("heavy"), F.col("key")).alias("key"),
                 F.when(~F.col("heavy"), _bucket(F.col("key"), n_buckets)).alias("bucket"))
        .agg(F.sum("load").alias("load"))
        .collect()  # at most n_tasks * (fragments_per_task + buckets_per_task) rows
    )
    bucket_loads = [0] * n_buckets
    heavy = []
    for r in measured:
        if r["heavy"]:
            heavy.append((r["key"], r["load"], math.ceil(r["load"] / limit)))
        else:
            bucket_loads[r["bucket"]] = r["load"]
    heavy.sort(key=lambda x: (-x[1], str(x[0])))
    shard_loads = [load // n for _, load, n in heavy for _ in range(n)]
    task_of, task_loads = pack(shard_loads + bucket_loads, n_tasks)
    slots, at = [], 0
    for k, _, n in heavy:
        slots.append((k, task_of[at:at + n]))
        at += n
    key_type = df.schema[key].dataType.simpleString()
    return Placement(
        n_tasks, total, spark.createDataFrame(slots, f"key {key_type}, slots array<int>"), task_of[at:], task_loads,
        dict(slots), loads,
    )


def place(df: DataFrame, key: str, placement: Placement, sub_key: list[str]) -> tuple[DataFrame, str, str]:
    """Send each row to its planned task. Returns the frame and the names of its added task and shard columns; the shard of
    a light key is -1."""
    task, shard, slots, heavy_key = (fresh(df, x) for x in ("_task", "_shard", "_slots", "_heavy_key"))
    heavy = placement.heavy.select(F.col("key").alias(heavy_key), F.col("slots").alias(slots))
    tasks = F.lit(placement.bucket_tasks)
    placed = (
        df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col(heavy_key)), "left")
        .withColumn(shard, F.coalesce(
            F.pmod(F.xxhash64(*[F.col(c) for c in sub_key]), F.size(slots).cast("long")).cast("int"), F.lit(-1)))
        .withColumn(task, F.coalesce(
            F.col(slots)[F.col(shard)], tasks[_bucket(F.col(key), len(placement.bucket_tasks))]))
        .drop(heavy_key, slots)
    )
    return placed.repartitionById(placement.n_tasks, F.col(task)), task, shard


COMBINE_ROWS = 1 << 18


def combined(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with copies that stand near each other left out and in order, before they are shuffled.

    A row that is repeated so often that it holds a share of the table thereby shrinks by ``COMBINE_ROWS``; what neighbours
    share costs next to nothing in the compressed shuffle. Columns must be of atomic types.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        held, rows = [], 0

        def flush():
            table = pa.Table.from_batches(held).group_by(names, use_threads=False).aggregate([])
            return table.sort_by([(c, "ascending") for c in names]).select(names).to_batches(1 << 16)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COMBINE_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return df.mapInArrow(run, schema)


def balanced_key_stats(
    df: DataFrame, key: str, group: str, occurrence: list[str], n_tasks: int | None = None, placement: Placement | None = None,
) -> DataFrame:
    """Per key: ``n_rows``, ``occurrences`` (distinct ``occurrence`` tuples) and ``n_groups`` (distinct ``group``).

    Rows are read twice: for the loads, which are the ``n_rows``, and for the rest. Shards of a heavy key are cut by the
    whole occurrence, so a key that lies in one group only is split as well, and rows that are copies are combined before
    they travel; the (key, group) pairs of heavy keys meet once more to be counted. A null key is a key of its own, null
    groups are not counted in ``n_groups``, repeated rows count once in ``occurrences``, an empty frame gives an empty result,
    and other columns of ``df`` are ignored.
    """
    placement = placement or plan_placement(df, key, n_tasks=n_tasks)
    need = list(dict.fromkeys([key, group, *occurrence]))
    placed, task, shard = place(combined(df.select(*need)), key, placement, [c for c in need if c != key])
    once = placed.groupBy(task, shard, *need).agg(F.count(F.lit(1)).alias("_n"))
    groups = once.groupBy(task, shard, *dict.fromkeys([key, group])).agg(F.count(F.lit(1)).alias("_occ"))
    # A light key becomes one row here, a heavy one a row for each of its groups, whose parts lie in several shards.
    split = F.col(shard) >= 0
    pairs = groups.groupBy(F.col(key), split.alias("_split"), F.when(split, F.col(group)).alias("_group")).agg(
        F.sum("_occ").alias("_occ"), F.count(F.when(~split, F.col(group))).alias("_groups"))
    stats = pairs.groupBy(key).agg(F.sum("_occ").alias("_occ"), F.sum(
        F.when(F.col("_split"), F.col("_group").isNotNull().cast("long")).otherwise(F.col("_groups"))).alias("_groups"))
    loads = placement.loads.select(F.col("key").alias("_load_key"), F.col("load").alias("n_rows"))
    return stats.join(loads, F.col(key).eqNullSafe(F.col("_load_key"))).select(
        key, "n_rows", F.col("_occ").alias("occurrences"), F.col("_groups").alias("n_groups"))


def hot_keys(df: DataFrame, key: str, group: str, occurrence: list[str], per_mille: int) -> DataFrame:
    """Rows of :func:`balanced_key_stats` of keys that hold at least ``per_mille`` / 1000 of all rows."""
    placement = plan_placement(df, key)
    stats = balanced_key_stats(df, key, group, occurrence, placement=placement)
    return stats.where(F.col("n_rows") * 1000 >= F.lit(placement.total) * per_mille)


def merged_codes(chunks: DataFrame, key: str = "token", codes: str = "token_codes", n_tasks: int | None = None) -> DataFrame:
    """The merged, sorted, distinct codes of each key, in fragments: ``(key, fragment, n_codes, codes)``.

    A light key has one fragment. A heavy key has as many as its load asks for, so no array grows with the key; its
    fragments are disjoint and each is sorted. Null and empty arrays and null codes add nothing; a null key is a key.
    """
    rows = chunks.select(F.col(key).alias("_key"), F.col(codes).alias("_codes"))
    placement = plan_placement(rows, "_key", weight=F.when(F.col("_codes").isNotNull(), F.size("_codes")), n_tasks=n_tasks)
    cut = cut_arrays(rows, "_key", "_codes", placement).select("_task", "_key", "_shard", "_codes").repartitionById(placement.n_tasks, F.col("_task"))
    merged = cut.groupBy("_task", "_key", "_shard").agg(F.collect_list("_codes").alias("_all"))
    return merged.select(
        F.col("_key").alias(key), F.col("_shard").alias("fragment"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten("_all")))).alias("codes"),
    ).where(F.size("codes") > 0).select(key, "fragment", F.size("codes").alias("n_codes"), "codes")


def cut_arrays(rows: DataFrame, key: str, codes: str, placement: Placement, split_by: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``rows`` with ``_shard`` and ``_task``, and arrays of heavy keys cut by shard before they travel.

    Each code is given its shard once, by the hash of ``split_by(code)``; the pieces then are slices of the array in order of
    shards, so the work is that of a sort of the array, not a pass over it for each shard. Rows without codes are left out.
    """
    heavy = placement.heavy.select(F.col("key").alias("_heavy_key"), F.col("slots").alias("_slots"))
    n = F.size("_slots").cast("long")

    def pieces(numbered: Column) -> Column:
        starts = F.array_compact(F.transform(numbered, lambda x, i: F.when((i == 0) | (F.get(numbered, i - 1).s != x.s), i)))
        return let(starts, lambda at: F.transform(at, lambda a, k: F.struct(
            F.get(numbered, a).s.alias("s"),
            F.transform(F.slice(numbered, a + 1, F.coalesce(F.get(at, k + 1), F.size(numbered)) - a), lambda x: x.c).alias("c"))))

    numbered = F.array_sort(F.transform(F.col(codes), lambda c: F.struct(F.pmod(F.xxhash64(split_by(c)), n).cast("int").alias("s"), c.alias("c"))))
    parts = F.when(F.col("_slots").isNull(), F.array(F.struct(F.lit(0).alias("s"), F.col(codes).alias("c")))).otherwise(let(numbered, pieces))
    keep = [c for c in rows.columns if c != codes]
    return (
        rows.withColumn(codes, F.array_compact(codes)).where(F.size(codes) > 0)
        .join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy_key")), "left")
        .select(*keep, "_slots", F.explode(parts).alias("_part"))
        .select(*keep, F.col("_part.c").alias(codes), F.col("_part.s").alias("_shard"), F.coalesce(
            F.get("_slots", F.col("_part.s")), F.lit(placement.bucket_tasks)[_bucket(F.col(key), len(placement.bucket_tasks))]).alias("_task"))
    )


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], n_tasks: int | None = None) -> DataFrame:
    """Inner join on ``key`` where ``left`` has heavy keys and ``right`` few rows a key.

    ``left`` is cut by load, rows of ``right`` are copied only to the shards of their key. Columns of ``right`` that
    clash with ``left`` get the suffix ``_right``. Null keys match nothing, as in any equi-join.
    """
    placement = plan_placement(left, key, n_tasks=n_tasks)
    a, task, shard = place(left.where(F.col(key).isNotNull()), key, placement, spread)
    names = {c: f"{c}_right" if c in left.columns and c != key else c for c in right.columns}
    b = right.where(F.col(key).isNotNull()).select(*[F.col(c).alias(n if c != key else "_rkey") for c, n in names.items()])
    heavy = placement.heavy.select(F.col("key").alias("_heavy_key"), F.col("slots").alias("_slots"))
    b = (
        b.join(F.broadcast(heavy), F.col("_rkey") == F.col("_heavy_key"), "left")
        .withColumn("_rshard", F.explode(F.coalesce(F.sequence(F.lit(0), F.size("_slots") - 1), F.array(F.lit(-1)))))
        .withColumn("_rtask", F.coalesce(
            F.col("_slots")[F.col("_rshard")],
            F.lit(placement.bucket_tasks)[_bucket(F.col("_rkey"), len(placement.bucket_tasks))]))
        .drop("_heavy_key", "_slots")
        .repartitionById(placement.n_tasks, F.col("_rtask"))
    )
    joined = a.join(b, (a[task] == b["_rtask"]) & (a[key] == b["_rkey"]) & (a[shard] == b["_rshard"]))
    return joined.drop(task, shard, "_rtask", "_rshard", "_rkey")
