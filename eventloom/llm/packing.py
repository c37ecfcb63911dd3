"""Best-two-fit packing of token pieces into sequences.

Documents are tokenized and cut into pieces of at most the sequence length; a whole piece
fills a sequence alone. What is to be packed is then no more than a count for each length,
bounded by the sequence length however large the corpus: the plan is made on those counts.
A bin is filled greedily (the longest piece that fits, again and again); then its smallest
piece is replaced by two unpacked pieces that fit the expanded gap more tightly, if there
are such. The bin is repeated as often as the counts allow at once, so each step uses up a
length. Pieces are numbered within their length by blocks, and join the plan's runs.

Defined cases: a null text is empty; an empty text is the closing id alone; a very long text is
tokenized whole and cut into pieces; pieces of one length are dealt out by a hash, ties by
doc_id; repeated rows are packed one by one; an empty table gives an empty result; columns
other than the named ones are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import blocks_for, materialize, running_sums, table, text_or_empty
from eventloom.llm.pretokens import Pieces, lent_pieces, vocabulary_path

SEQUENCE = 4096
END_ID = 1
ROWS_PER_BLOCK = 4096
#: Texts that are tokenized together, in bytes, so that a worker's memory is bounded.
CHUNK_BYTES = 4_000_000


def tokenize_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent_pieces(path) as known:
            yield from encoded(batches, known)

    def encoded(batches: Iterator[pa.RecordBatch], known: Pieces) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(texts):
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
                rows: list[tuple[int, int, int, int, int]] = []
                for k, found in enumerate(known.encode_texts(texts.slice(at, upto - at)), at):
                    tokens = np.append(found, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), sequence)):
                        part = tokens[start : start + sequence]
                        rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
                which, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at = upto

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def _best_two(gap: int, lengths: list[int], left: dict[int, int]) -> tuple[int, int] | None:
    """The two unpacked pieces with the largest sum of at most ``gap``, over ascending ``lengths``."""
    best, lo, hi = None, 0, len(lengths) - 1
    while lo <= hi and hi >= 0:
        a, b = lengths[lo], lengths[hi]
        if a + b > gap:
            hi -= 1
        elif lo == hi and left[a] < 2:
            break
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
                if a + b == gap:
                    break
            lo += 1
    return best


def plan_bins(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of a bin in place order, times it is repeated) for counts of piece lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            del left[n]
            lengths.remove(n)

    def give(n: int) -> None:
        if n not in left:
            insort(lengths, n)
        left[n] = left.get(n, 0) + 1

    while left:
        held: list[int] = []
        gap = sequence
        while (at := bisect_right(lengths, gap)) and gap:
            n = lengths[at - 1]
            held.append(n)
            gap -= n
            take(n)
        while gap and len(held) > 1:
            smallest = held[-1]
            two = _best_two(gap + smallest, lengths, left)
            if two is None or sum(two) <= smallest:
                break
            held.pop()
            for n in two:
                take(n)
            give(smallest)
            held = sorted([*held, *two], reverse=True)
            gap = sequence - sum(held)
        need = {n: held.count(n) for n in set(held)}
        times = min(left.get(n, 0) // k for n, k in need.items()) + 1
        for n, k in need.items():
            if times > 1:
                left[n] -= k * (times - 1)
                if not left[n]:
                    del left[n]
                    lengths.remove(n)
        plan.append((held, times))
    return plan


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = materialize(parts)
    # One row a length: at most ``sequence`` of them.
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs, first = [], 0
    used: dict[int, int] = {}
    for held, times in plan_bins(counts, sequence):
        offset = 0
        for n in sorted(set(held), reverse=True):
            k = held.count(n)
            runs.append((n, used.get(n, 0), used.get(n, 0) + k * times, k, first, offset))
            used[n] = used.get(n, 0) + k * times
            offset += k * n
        first += times
    # A run list for each length, found by its rank: the join is on the length alone.
    plan = spark.createDataFrame(runs, "__length long, __lo long, __hi long, __k long, __first long, __at long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    # Blocks by the count of a length, so that seldom lengths are one block each.
    blocks = spark.createDataFrame([(n, blocks_for(c, ROWS_PER_BLOCK)) for n, c in counts.items()], "__length long, __blocks long")
    placed = parts.join(F.broadcast(blocks), F.col("length") == F.col("__length")).withColumn("__one", F.lit(1)).withColumn("__key", key)
    placed = placed.withColumn("__block", F.pmod("__key", F.col("__blocks"))).drop("__length", "__blocks")
    ranked = running_sums(placed, ["length"], "__block", ["__key", "doc_id", "piece"], ["__one"])
    runs_of = plan.groupBy("__length").agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi", "__k", "__first", "__at"))).alias("__runs"))
    rank = F.col("__one_before")
    joined = ranked.join(F.broadcast(runs_of), F.col("length") == F.col("__length"))
    joined = joined.withColumn("__run", F.filter("__runs", lambda r: (r["__lo"] <= rank) & (rank < r["__hi"]))[0])
    inside = rank - F.col("__run.__lo")
    return joined.select(
        *parts.columns,
        (F.col("__run.__first") + F.floor(inside / F.col("__run.__k"))).cast("long").alias("sequence_id"),
        (F.col("__run.__at") + F.pmod(inside, F.col("__run.__k")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    return pack(tokenize_pieces(docs, path or vocabulary_path(), sequence), sequence)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
