"""Sharding by balanced label propagation under the law of equal row counts.

Links are given as hubs: rows with the same hub are linked (an edge is a hub of two
rows, equal texts are a hub of all copies), so that a group of copies is linear in
its size.  Rows start in shards by hash.  In each round every linked row sees
how many neighbours each shard holds and wants to move to the shard with most; moves
are admitted as a balanced flow, as many as can be: the room in a shard is what linked rows leave
in the same round and what unlinked rows can leave, and unlinked rows are moved out to keep
all counts at most one apart.  Rounds end when none is admitted, whichever of equal shards
a hub takes; each move adds to its hub's largest part, so that they do end.  Ranks
within shards come from hash buckets and prefix sums over small bucket counts, so no
shard is gathered in one task.

Defined cases: a null text has size 1, crc32 0 and counts as an empty text; rows that repeat a
doc_id are rows of their own; a group larger than a shard fills its shard and
leaves the rest where they are; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, table

SHARDS = 8
BUCKET_ROWS, SLICES = 20_000, 64


def ranked(rows: DataFrame, by: list[str], n: int, first: Column | None = None) -> DataFrame:
    """rows with rank_, gapless from 0 within each group of by; rows with a smaller value of first (a small number) come first."""
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("uid"), F.lit(buckets)) + (first * buckets if first is not None else 0))
    counts = rows.groupBy(*by, "bucket_").count()
    offset = counts.withColumn("offset_", F.sum("count").over(Window.partitionBy(*by).orderBy("bucket_")) - F.col("count")).drop("count")
    own = rows.withColumn("own_", F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy("uid")) - 1)
    return own.join(offset, [*by, "bucket_"]).withColumn("rank_", F.col("own_") + F.col("offset_")).drop("own_", "offset_", "bucket_")


def _cuts(column: Column, limits: list[tuple[int, int]]) -> Column:
    """The label of the range that a rank falls in; limits: (end, label), ascending."""
    out = F.lit(None).cast("int")
    for end, label in reversed(limits):
        out = F.when(column < end, F.lit(label)).otherwise(out)
    return out


def _level(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """rows with all shard counts at most one apart; unlinked rows are moved first."""
    count = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    quota = [n // SHARDS + (s < n % SHARDS) for s in range(SHARDS)]
    over = {s: count.get(s, 0) - quota[s] for s in range(SHARDS) if count.get(s, 0) > quota[s]}
    want = [(s, quota[s] - count.get(s, 0)) for s in range(SHARDS) if count.get(s, 0) < quota[s]]
    if not over:
        return rows
    to = F.col("shard")
    for s, much in over.items():
        limits, at = [], 0
        while at < much:
            label, lack = want[0]
            step = min(lack, much - at)
            at += step
            limits.append((at, label))
            want[0] = (label, lack - step)
            if lack == step:
                want.pop(0)
        to = F.when(F.col("shard") == s, F.coalesce(_cuts(F.col("rank_"), limits), F.col("shard"))).otherwise(to)
    return scratch.save(ranked(rows, ["shard"], n, F.col("linked").cast("int")).withColumn("shard", to.cast("int")).drop("rank_"))


def _admitted(want: dict, room: list[int]) -> dict:
    """How many of each (from, to) may move: as many as can be where no shard gains more than its room.

    A circulation of most moves; what a shard gains goes on, as unlinked rows, over one more node to the
    shards that lose.  Cycles of the residual graph that add moves are filled until there is none.
    """
    arcs, hub = [], SHARDS  # [from, to, room left, cost]; the arc back lies beside it
    for (a, b), k in sorted(want.items()):
        arcs += [[a, b, k, -1], [b, a, 0, 1]]
    moves = len(arcs)
    for s in range(SHARDS):
        arcs += [[s, hub, room[s], 0], [hub, s, 0, 0], [hub, s, sum(want.values()), 0], [s, hub, 0, 0]]
    while True:
        cost, by, last = [0] * (SHARDS + 1), [None] * (SHARDS + 1), None
        for _ in range(SHARDS + 1):
            last = None
            for i, (a, b, left, c) in enumerate(arcs):
                if left and cost[a] + c < cost[b]:
                    cost[b], by[b], last = cost[a] + c, i, b
        if last is None:
            return {(arcs[i][0], arcs[i][1]): arcs[i + 1][2] for i in range(0, moves, 2) if arcs[i + 1][2]}
        for _ in range(SHARDS + 1):
            last = arcs[by[last]][0]
        cycle, at = [], last
        while not cycle or at != last:
            cycle.append(by[at])
            at = arcs[by[at]][0]
        much = min(arcs[i][2] for i in cycle)
        for i in cycle:
            arcs[i][2] -= much
            arcs[i ^ 1][2] += much


def propagate(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """rows (uid, hub, linked, ...) with shard, by rounds until no move is admitted."""
    rows = scratch.save(rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(SHARDS)).cast("int")))
    rows = _level(rows, n, scratch)
    turn = idle = 0
    while idle < SHARDS:
        seen = rows.where("linked").groupBy("hub", "shard").count()
        # Ties: in an order that differs from hub to hub, so that they spread, and turns, so that each of equal shards is tried.
        order = F.pmod(F.xxhash64("hub") % SHARDS + F.col("shard") + turn, F.lit(SHARDS))
        best = seen.groupBy("hub").agg(F.max_by("shard", F.struct("count", order)).alias("goal"), F.sort_array(F.collect_list("count"), False).alias("parts"))
        best = best.select("hub", "goal", F.coalesce(F.get("parts", F.lit(0)) == F.get("parts", F.lit(1)), F.lit(False)).alias("tied"))
        turn += 1
        goal = scratch.save(best.withColumnRenamed("hub", "of_hub"))
        wish = scratch.save(rows.join(goal, F.col("linked") & (F.col("hub") == F.col("of_hub")), "left").drop("of_hub").withColumn("goal", F.coalesce("goal", "shard")))
        moves = {(r["shard"], r["goal"]): r["count"] for r in wish.where("goal <> shard").groupBy("shard", "goal").count().collect()}
        if not moves:
            break
        stat = {r["shard"]: (r["n"], r["free"]) for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("free")).collect()}
        quota = [n // SHARDS + (s < n % SHARDS) for s in range(SHARDS)]
        may = _admitted(moves, [stat.get(s, (0, 0))[1] + max(0, quota[s] - stat.get(s, (0, 0))[0]) for s in range(SHARDS)])
        if not may:
            # Without ties the next turn has the same goals.
            idle = idle + 1 if goal.where("tied").limit(1).count() else SHARDS
            scratch.drop(goal, wish)
            continue
        idle = 0
        if may == moves:
            moved = wish.withColumn("shard", F.col("goal"))
        else:
            limit = F.lit(0)
            for (a, b), k in may.items():
                limit = F.when((F.col("shard") == a) & (F.col("goal") == b), k).otherwise(limit)
            # In one order of slices of hubs everywhere: rows that may not move are of few hubs.
            moved = ranked(wish, ["shard", "goal"], n, F.pmod(F.xxhash64("hub"), F.lit(SLICES)).cast("int")).withColumn("shard", F.when((F.col("goal") != F.col("shard")) & (F.col("rank_") < limit), F.col("goal")).otherwise(F.col("shard"))).drop("rank_")
        before = rows
        rows = _level(scratch.save(moved.drop("goal", "tied")), n, scratch)
        scratch.drop(before, goal, wish)
    return rows


def shard(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("hub"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = scratch.save(rows)
    n = rows.count()
    groups = scratch.save(rows.groupBy("hub").agg(F.count("*").alias("k")).where("k > 1").select(F.col("hub").alias("of_hub")))
    rows = rows.join(groups, F.col("hub") == F.col("of_hub"), "left").withColumn("linked", F.col("of_hub").isNotNull()).drop("of_hub")
    placed = ranked(propagate(rows, n, scratch), ["shard"], n)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank_").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
