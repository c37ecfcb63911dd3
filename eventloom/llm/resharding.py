"""Resharding by minimum-cost flow.

The documents lie in old shards. New shards get equal capacities in bytes; a flow network
from old sizes to capacities, in which a byte that stays costs nothing and one that moves
costs its distance, is solved for the least cost, and each old shard hands runs of
documents, in a fixed hash order, to the shards that its flows name. Whole documents can't
meet a flow to the byte: what is left over is settled by further flows between the new
shards, each of which moves documents of at most a quarter of it, so that a round leaves about
a quarter of what it found. Where shards lack such small documents, single ones move: of each
of the fullest shards the one that comes nearest to halving its difference from one of the
emptiest. Rounds go on until shards are near enough or no such document brings them nearer.

Only shard sizes (old times new numbers, both parameters) reach the driver. Sizes are
bytes of UTF-8 plus 8. Law: ``bytes``. At last the shards that lose or get a document are
written anew; a row is known by its file and its place there, so null ids, repeated rows and
equal texts of one id are each written once.

Defined cases: a null text has no bytes; a document whose old shard is null or not among the
old ones lies in none, so it moves; null sources count as one; a very long text moves as a
whole, so its shard may stay larger by it; repeated rows are placed one by one; ties of the
hash order are broken by doc_id; an empty table gives an empty result; columns other than the
named ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import blocks_for, kept_scratch, materialize, running_sums, table, text_or_empty

N_OLD = 16
N_NEW = 24
ROWS_PER_BLOCK = 4096
#: Flows that settle what whole documents left over at most, and when that is near enough.
SETTLING_ROUNDS = 12
SINGLE_ROUNDS = 40
NEAR = 0.0005


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Least-cost transport of all supplies into capacities: successive shortest paths.

    The graph has one node a shard, so it stays small whatever the shards hold.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        # Bellman-Ford from the shards with bytes left; back along an arc with flow costs its negative.
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                if dist[i] is None:
                    continue
                for j in range(m):
                    if dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], came[n + j], changed = dist[i] + cost[i][j], i, True
            for (i, j), x in flow.items():
                if x and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                    dist[i], came[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        ends = [j for j in range(m) if room[j] and dist[n + j] is not None]
        if not ends:
            raise ValueError("the capacities don't hold the supplies")
        end = min(ends, key=lambda j: (dist[n + j], j))
        path, at = [], n + end
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        amount = min(left[at], room[end], *(flow[b, a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return {k: x for k, x in sorted(flow.items()) if x}


def _arcs(spark: SparkSession, flows: dict[tuple[int, int], int]) -> DataFrame:
    """One row a flow: the run of bytes of the giving shard that it takes; own bytes first."""
    rows, at = [], {}
    for (a, b), x in sorted(flows.items(), key=lambda f: (f[0][0], f[0][1] != f[0][0], f[0][1])):
        rows.append((a, b, at.get(a, 0), at.get(a, 0) + x))
        at[a] = at.get(a, 0) + x
    return spark.createDataFrame(rows, "__from int, __to int, __lo long, __hi long")


def _sizes(df: DataFrame, shard: str, n: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(shard).agg(F.sum("size")).collect()}
    return [found.get(i, 0) for i in range(n)]


def row_in_file() -> Column:
    """What tells rows of a Parquet table apart, whatever they hold."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def reshard(docs: DataFrame, old_shard: Column, n_old: int = N_OLD, n_new: int = N_NEW, row: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, and ``row`` where given: one row a document."""
    spark = docs.sparkSession
    text = text_or_empty()
    known = [] if row is None else ["row"]
    narrow = docs.select(
        "doc_id",
        *([] if row is None else [row.alias("row")]),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        F.xxhash64("doc_id", text).alias("__key"),
    )
    # Documents in none of the old shards are one more that gives.
    of_old = F.when(F.col("old_shard").between(0, n_old - 1), F.col("old_shard")).otherwise(n_old)
    narrow = materialize(narrow.withColumn("__one", F.lit(1)).withColumn("__old", of_old).withColumn("__id", F.monotonically_increasing_id()))
    n_rows = narrow.count()
    if not n_rows:
        return narrow.select("doc_id", "size", "text_crc32", "old_shard", F.col("old_shard").alias("shard"), F.col("__key").alias("slot"), *known)
    block = F.pmod("__key", F.lit(blocks_for(n_rows, ROWS_PER_BLOCK)))
    placed = narrow.withColumn("__block", block)
    old = _sizes(placed, "__old", n_old + 1)
    total = sum(old)
    capacity = [total // n_new + (i < total % n_new) for i in range(n_new)]
    cost = [[int(i != j or i == n_old) for j in range(n_new)] for i in range(n_old + 1)]
    arcs = _arcs(spark, min_cost_flow(old, capacity, cost))
    summed = running_sums(placed, ["__old"], "__block", ["__key", "doc_id"], ["size"])
    # A document goes where its middle byte goes; the arcs of a shard tile all of its bytes.
    middle = F.col("size_before") + F.floor(F.col("size") / 2)
    joined = summed.join(F.broadcast(arcs), (F.col("__old") == F.col("__from")) & (middle >= F.col("__lo")) & (middle < F.col("__hi")))
    placed = materialize(joined.select(*placed.columns, F.col("__to").alias("shard")))
    off = None
    for _ in range(SETTLING_ROUNDS):
        now = _sizes(placed, "shard", n_new)
        over = [max(0, s - c) for s, c in zip(now, capacity, strict=True)]
        under = [max(0, c - s) for s, c in zip(now, capacity, strict=True)]
        if max(over + under) <= NEAR * max(capacity) or off is not None and sum(over) >= off:
            break
        off = sum(over)
        each = [[int(i != j) for j in range(n_new)] for i in range(n_new)]
        arcs = _arcs(spark, min_cost_flow(over, under, each))
        least = arcs.groupBy("__from").agg(F.floor(F.max(F.col("__hi") - F.col("__lo")) / 4).alias("__most"))
        small = placed.join(F.broadcast(least), F.col("shard") == F.col("__from"), "left")
        small = small.withColumn("__light", F.when(F.col("size") <= F.col("__most"), F.col("size")).otherwise(0)).drop("__from", "__most")
        summed = running_sums(materialize(small), ["shard"], "__block", ["__key", "doc_id"], ["__light"])
        fits = (F.col("shard") == F.col("__from")) & (F.col("__light") > 0) & (F.col("__light_before") >= F.col("__lo"))
        fits &= F.col("__light_before") + F.col("__light") <= F.col("__hi")
        moved = summed.join(F.broadcast(arcs), fits, "left")
        placed = materialize(moved.select(*[c for c in placed.columns if c != "shard"], F.coalesce("__to", "shard").alias("shard")))
    placed = _single_moves(placed, capacity)
    slotted = running_sums(placed, ["shard"], "__block", ["__key", "doc_id"], ["__one"])
    return slotted.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("__one_before").alias("slot"), *known)


def _single_moves(placed: DataFrame, capacity: list[int]) -> DataFrame:
    """The fullest shards each give one document to one of the emptiest, again and again while that makes them more alike."""
    n_new = len(capacity)
    for _ in range(SINGLE_ROUNDS):
        off = [s - c for s, c in zip(_sizes(placed, "shard", n_new), capacity, strict=True)]
        if max(map(abs, off)) <= NEAR * max(capacity):
            break
        order = sorted(range(n_new), key=lambda i: off[i])
        # A document of less than the difference helps; one of half of it helps most.
        pairs = [(b, a, off[b] - off[a]) for a, b in zip(order, order[::-1], strict=True) if off[b] > off[a]]
        if not pairs:
            break
        of = placed.sparkSession.createDataFrame(pairs, "__from int, __to int, __less long")
        fits = placed.join(F.broadcast(of), F.col("shard") == F.col("__from")).where(F.col("size") < F.col("__less"))
        best = fits.groupBy("__to").agg(F.min(F.struct(F.abs(2 * F.col("size") - F.col("__less")).alias("d"), F.col("__id").alias("i"))).alias("b"))
        # One row a pair.
        moves = [(r["b"]["i"], r["__to"]) for r in best.collect()]
        if not moves:
            break
        to = F.coalesce(*(F.when(F.col("__id") == i, t) for i, t in moves), "shard")
        placed = materialize(placed.withColumn("shard", to.cast("int")))
    return placed


def moved_bytes(placed: DataFrame) -> DataFrame:
    """(bytes, moved): of all documents, and of those that change their shard."""
    moves = ~F.col("old_shard").eqNullSafe(F.col("shard"))
    return placed.agg(F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(moves, F.col("size"))), F.lit(0)).alias("moved"))


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write anew the shards that lose or get a document, as ``path/shard=N``; others stay as they are.

    ``docs`` is read from Parquet and ``placed`` is its ``reshard`` with ``row_in_file()``. A file holds its rows
    by ``slot``; columns of ``docs`` named shard or slot give way. An old shard that is left empty gets no folder.
    """
    touched = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    touched = touched.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    rows = placed.join(F.broadcast(touched), "shard", "left_semi").select("row.file", "row.place", "shard", "slot")
    held = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("__doc"), row_in_file().alias("__row"))
    held = held.select("__doc", F.col("__row.file").alias("file"), F.col("__row.place").alias("place"))
    out = held.join(rows, ["file", "place"]).select("__doc.*", "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def reshard_files(docs: DataFrame, old_shard: Column, path: str, n_old: int = N_OLD, n_new: int = N_NEW) -> DataFrame:
    """The whole method on a table read from Parquet: places the documents, writes the affected shards, returns the places."""
    placed = materialize(reshard(docs, old_shard, n_old, n_new, row_in_file()))
    rewrite_affected(docs, placed, path)
    return placed.drop("row")


def op10_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # As collected: a source's documents lie together, so old shards differ much in size.
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(N_OLD))
    return reshard_files(docs, old, kept_scratch(spark)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )
