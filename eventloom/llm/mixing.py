"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks by a hash of the document, and its blocks in a fixed
random order. A source's quota is the number of block draws that hold its target: once
around all blocks for each whole pass, then as many blocks as reach the target; of the last
one only the words that are missing. A tree over the output shards splits the vector of
quotas: at each node the draws of the left half are a multivariate-hypergeometric draw from
the node's vector, so every draw goes to one shard, and a shard's share of each source is
what a uniform shuffle of all blocks would give it. A shard's draws of a source are the next
blocks of that order: what a document gives to the mix is what the draws of its block take,
and at most one document a source is cut. Within a shard documents follow a hash order.

Targets: weights 5, 2, 1 repeating over the sources by code point, null last; 150% of all
words shared by weight; a target stops at twice its source, the excess shared again.

Shards grow with the mix, so that each is sorted by one task. Places in a source are sums
over blocks, and over runs of blocks, so that no task holds a whole source.

Defined cases: a null text has no words and takes none; a null source is a source, the last;
very long texts are counted whole, and lie in one block; repeated rows are taken one by one;
ties of the hash order are broken by doc_id; an empty table gives an empty result; a source
without words has target 0; columns other than the named ones are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import DOCUMENT_COLUMNS, blocks_for, broadcast_if_small, count_words, global_rank, materialize, running_sums, split_words, table, text_or_empty

WEIGHTS = [5, 2, 1]
SHARE = 1.5
MOST_REPEATS = 2
#: Output shards: so many at least, and one for so many words of the mix.
N_SHARDS = 64
WORDS_PER_SHARD = 20_000_000
ROWS_PER_BLOCK = 256
BLOCKS_PER_RUN = 1024
SEED = 20240105
#: Sources whose quotas one tree splits; more sources have a tree for each chunk of these.
SOURCES_PER_TREE = 4096


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: rank, rows, words, weight, target. ``sized`` has ``source`` and ``size``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("long")).withColumn("most", MOST_REPEATS * F.col("source_size")))
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    # Only sums of long numbers come to the driver, a round for each time the excess is shared.
    level, n_stopped = 0.0, -1
    while True:
        stopped = F.lit(level) * F.col("weight") > F.col("most")
        n, held, weights = ranked.agg(
            F.sum(stopped.cast("long")), F.sum(F.when(stopped, F.col("most")).otherwise(0)), F.sum(F.when(~stopped, F.col("weight")).otherwise(0))
        ).first()
        if not words or not weights or n == n_stopped:
            break
        level, n_stopped = (SHARE * words - held) / weights, n
    target = F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))
    return materialize(ranked.withColumn("target", target))


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(index of source, shard, first draw, draws) of every shard, by the splitting tree."""
    out: list[tuple[int, int, int, int]] = []
    nodes = [(0, n_shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while nodes:
        lo, hi, have, start = nodes.pop()
        if not have.any():
            continue
        if hi - lo == 1:
            out += [(int(i), lo, int(start[i]), int(have[i])) for i in np.flatnonzero(have)]
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(have.sum())
        # The blocks that can't be shared evenly fall to either half alike.
        take = int(np.floor(total * (mid - lo) / (hi - lo) + rng.random()))
        left = rng.multivariate_hypergeometric(have, min(take, total), method="marginals")
        nodes += [(lo, mid, left, start), (mid, hi, have - left, start + left)]
    return out


def shard_runs(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(rank, runs): the shards of a source with the first draw of each, by draw; from (rank, quota)."""

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        # One number a chunk keeps the draws of chunks apart.
        chunk = int(part["rank"].iloc[0]) // SOURCES_PER_TREE
        rows = split_quotas(part["quota"].to_numpy(), n_shards, seed + 1_000_003 * chunk)
        ranks = part["rank"].to_numpy()
        return pd.DataFrame([(int(ranks[i]), s, a) for i, s, a, _ in rows], columns=["rank", "shard", "first"])

    by_chunk = quotas.groupBy(F.floor(F.col("rank") / SOURCES_PER_TREE).alias("chunk"))
    leaves = by_chunk.applyInPandas(tree, "rank long, shard int, first long")
    return leaves.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("runs"))


def drawn_blocks(blocks: DataFrame, targets: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(rank, __block, draws): for each drawn block its draws (pass, shard, words that the draw takes).

    ``blocks`` has (rank, __block, words); ``targets`` (rank, source_size, quota_words).
    """
    blocks = materialize(blocks.withColumn("__one", F.lit(1)).withColumn("__run", F.floor(F.col("__block") / BLOCKS_PER_RUN)))
    placed = running_sums(blocks, ["rank"], "__run", ["__block"], ["words", "__one"])
    placed = placed.join(broadcast_if_small(targets), "rank")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota_words") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("quota_words") - F.col("whole") * F.col("source_size")
    placed = materialize(placed.withColumn("whole", whole).withColumn("rest", rest).withColumn("reached", F.col("words_before") < F.col("rest")))
    quotas = placed.groupBy("rank").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("whole").alias("w"), F.count_if("reached").alias("last"))
    quotas = materialize(quotas.select("rank", "n_blocks", (F.col("n_blocks") * F.col("w") + F.col("last")).alias("quota")))
    runs = quotas.select("rank", "n_blocks").join(shard_runs(quotas.select("rank", "quota"), n_shards, seed), "rank")
    told = placed.join(broadcast_if_small(materialize(runs)), "rank")
    passes = told.withColumn("times", F.col("whole") + F.col("reached").cast("long")).where("times > 0")
    each = passes.withColumn("pass", F.explode(F.expr("sequence(0L, times - 1)")))
    # A pass draws all blocks in their order; draw numbers follow on from pass to pass.
    draw = F.col("pass") * F.col("n_blocks") + F.col("__one_before")
    each = each.withColumn("draw", draw).withColumn("shard", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("draw")), -1)["shard"])
    takes = F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("words_before")))
    one = F.struct("pass", "shard", takes.alias("words"))
    return each.groupBy("rank", "__block").agg(F.sort_array(F.collect_list(one)).alias("__drawn"))


def mix(docs: DataFrame, keep: list[str], n_shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``keep``, ``size``, the source's ``source_size`` and ``target``, ``taken`` and ``draws``:
    the output shard, place key and words of each time the document is taken (two at most)."""
    key = F.xxhash64(F.lit(seed), "doc_id", F.col("text"))
    sized = materialize(docs.select(*keep, F.col("source").alias("__source"), count_words(text_or_empty()).alias("size"), key.alias("__key")))
    targets = source_targets(sized.select(F.col("__source").alias("source"), "size"))
    own = targets.select(
        F.col("source").alias("__named"), "rank", "source_size", "target",
        F.ceil(F.col("n_rows") / ROWS_PER_BLOCK).alias("__blocks"),
        F.floor(F.col("target") + 0.5).cast("long").alias("quota_words"),
    )
    if n_shards is None:
        n_shards = max(N_SHARDS, blocks_for(own.agg(F.sum("quota_words")).first()[0] or 0, WORDS_PER_SHARD))
    of = own.select("__named", "rank", "source_size", "target", "__blocks")
    sized = sized.join(broadcast_if_small(of), sized["__source"].eqNullSafe(of["__named"])).drop("__source", "__named")
    sized = materialize(sized.withColumn("__block", F.pmod("__key", F.col("__blocks"))))
    blocks = sized.groupBy("rank", "__block").agg(F.sum("size").alias("words"))
    drawn = drawn_blocks(blocks, own.select("rank", "source_size", "quota_words"), n_shards, seed)
    in_block = Window.partitionBy("rank", "__block").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("before", F.sum("size").over(in_block) - F.col("size"))
    joined = placed.join(drawn, ["rank", "__block"], "left")

    def one(d):
        return F.struct(
            d["shard"].alias("shard"),
            F.xxhash64("__key", d["pass"]).alias("place"),
            F.greatest(F.lit(0), F.least(F.col("size"), d["words"] - F.col("before"))).alias("words"),
        )

    draws = F.filter(F.transform(F.coalesce("__drawn", F.array().cast("array<struct<pass:bigint,shard:int,words:bigint>>")), one), lambda d: d["words"] > 0)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return joined.withColumn("draws", draws).select(*keep, "size", "source_size", "target", taken.alias("taken"), "draws")


def _cut(text: Column, words: Column) -> Column:
    return F.array_join(F.slice(split_words(text), F.lit(1), words.cast("int")), " ")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, one row each time one is taken, dealt out by shard and shuffled in it (a pipeline stage).

    A document cut by its source's target holds its first words, joined by single spaces; a
    document without words is never taken. Rows that repeat a document share out its draws.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    drawn = mix(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("__print")), ["doc_id", "__print", "source"])
    drawn = materialize(drawn.select(F.col("doc_id").alias("__doc"), "__print", F.col("source").alias("__from"), "size", "draws"))
    per = drawn.groupBy("__doc", "__print", "__from").agg(
        F.count(F.lit(1)).alias("__rows"), F.max("size").alias("__size"), F.flatten(F.collect_list("draws")).alias("__draws")
    )
    same = docs["doc_id"].eqNullSafe(per["__doc"]) & (F.xxhash64(docs["text"]) == per["__print"]) & docs["source"].eqNullSafe(per["__from"])
    joined = docs.join(per.where(F.size("__draws") > 0), same)
    nth = F.row_number().over(Window.partitionBy("__doc", "__print", "__from").orderBy("lang")) - 1
    mine = F.filter("__draws", lambda d, i: F.pmod(i, F.col("__rows")) == F.col("__nth"))
    single = joined.where("__rows = 1").select(*docs.columns, "__size", F.explode("__draws").alias("d"))
    repeated = joined.where("__rows > 1").withColumn("__nth", nth).select(*docs.columns, "__size", F.explode(mine).alias("d"))
    text = F.when(F.col("d.words") < F.col("__size"), _cut(F.col("text"), F.col("d.words"))).otherwise(F.col("text"))
    both = single.unionByName(repeated).select("doc_id", text.alias("__taken"), "lang", "source", "d.shard", "d.place")
    dealt = both.repartition("shard").sortWithinPartitions("shard", "place", "doc_id")
    return dealt.select("doc_id", F.col("__taken").alias("text"), "lang", "source", F.length("__taken").cast("long").alias("n_chars"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shards`` and ``places``: where each time goes, and its sort key there."""
    mixed = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    listed = lambda name: F.array_join(F.transform("draws", lambda d: d[name].cast("string")), ",").alias(f"{name}s")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", listed("shard"), listed("place"))
