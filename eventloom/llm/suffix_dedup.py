"""Suffix-array dedup: bytes that stand in a string of 400 bytes that also starts elsewhere.

No suffix array of the whole corpus is built. Every window of 400 bytes names an anchor, the
100 bytes in it with the least hash, the leftmost of equals: equal windows name equal anchors
at equal places, so all starts of a repeated string are found among runs of windows with the
same anchor. Runs are known by the anchor and by a hash of the bytes that their windows cover:

* A run whose bytes occur again is repeated as a whole, however many copies there are; they
  are counted, inside tasks first, and never gathered.
* Unequal runs of one anchor may share windows. Their bytes, one copy each, go by anchor into
  blocks of bounded size. A block is sorted into its Burrows-Wheeler transform; a breadth-first
  backward extension of the borders between suffixes then derives common prefixes by
  increasing length and stops at 400: suffixes with no border between them start a repeated string.
* An anchor with more unequal runs than a block should hold is split: its windows are dealt
  into cells by the anchor's place in them, each cell anchored by all bytes that its windows have in
  common, where most runs become equal or part company. The last cells are single windows, for
  which counts decide, so splitting always ends.

Defined cases: a null text is empty; texts below 400 bytes are kept whole; matches never cross
documents; a very long text is anchored a quarter of a million windows at a time, in one task; equal
hashes take the leftmost place; repeated rows are copies of each other, null and repeated ids
are told apart by row; an empty table gives an empty result; columns other than the named
ones are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import blocks_for, join_hot, kept_scratch, materialize, table, text_or_empty

LEAST = 400
#: Windows that are worked on at once.
WINDOWS = 1 << 18
#: Unequal runs of one anchor that go to a block as one group.
GROUP = 1000
#: Bytes of runs that a block holds, but for its last group.
BLOCK = 3 << 18
#: Places that are looked at one by one before all symbols are, and lookups that need no such walk.
STEPS, FEW = 64, 1500
#: Cells that a split deals an anchor's windows into.
CELLS = 16
#: Bytes of texts a bucket holds, and the most buckets that Spark allows.
BUCKET, MOST_BUCKETS = 64 << 20, 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64((1 << 22) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    both = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    for p in both:
        p[:1] = 1
        np.multiply.accumulate(p, out=p)
    return both


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, from sums of powers modulo 2^64."""
    n = len(data)
    powers, inverse = _powers(1 << max(10, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    h = (sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values: least so far in blocks of that width, from both ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, ends: np.ndarray, least: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, last, anchor, hash): runs of windows of one anchor, as places in ``data``.

    ``ends`` are the ends of the documents that stand one after the other in ``data``.
    """
    n_kmers = least - width + 1
    for low in range(0, len(data) - least + 1, WINDOWS):
        high = min(low + WINDOWS, len(data) - least + 1)
        starts = np.arange(low, high)
        a, b = np.searchsorted(ends, (low, high - 1), "right")
        edges = np.clip(ends[a : b + 1], None, high)
        inside = starts + least <= np.repeat(ends[a : b + 1], np.diff(edges, prepend=low))
        if not inside.any():
            continue
        hashes = _hashes(data[low : high + least - 1], width)
        packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least_of(packed, n_kmers)[inside] & _PLACE).astype(np.int64)
        starts = starts[inside]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        yield starts[first], starts[last], anchor[first] + low, hashes[anchor[first]].view(np.int64)


_RUN = "row long, start long, n int, place int, anchor long, bytes_hash binary"


def runs_of(texts: DataFrame, least: int) -> DataFrame:
    """row, start (of the first window), n (windows), place (of the anchor in the last window), anchor, bytes_hash."""
    width = max(1, least // 4)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts_ = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.fromiter((len(x.as_buffer()) for x in texts_), np.int64, len(texts_))
            ends = np.cumsum(lengths)
            raw = b"".join(x.as_buffer() for x in texts_)
            for first, last, anchor, hashes in anchored_runs(np.frombuffer(raw, np.uint8), ends, least, width):
                doc = np.searchsorted(ends, first, "right")
                of_bytes = [xxhash.xxh3_128_digest(raw[a : b + least]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[doc]), pa.array(first - (ends - lengths)[doc]), pa.array((last - first + 1).astype(np.int32)), pa.array((anchor - last).astype(np.int32)), pa.array(hashes), pa.array(of_bytes, pa.binary())],
                    ["row", "start", "n", "place", "anchor", "bytes_hash"],
                )

    return texts.select("row", "bytes").mapInArrow(find, _RUN).withColumn("copies", F.lit(1).cast("long"))


def suffix_order(symbols: np.ndarray, depth: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rotations ordered by their first ``depth`` symbols, the packed keys they were first ordered by,
    how many symbols a key holds and the bits of each."""
    n = len(symbols)
    bits = max(1, int(n_symbols - 1).bit_length())
    packed, key = 1, symbols.astype(np.int64)
    while 2 * packed * bits <= 62 and 2 * packed <= depth:
        key = (key << (packed * bits)) | np.roll(key, -packed)
        packed *= 2
    order = np.argsort(key).astype(np.int32)
    keys = key[order]
    head = np.ones(n, bool)
    head[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    done = packed
    # Only ties are ordered anew, by what follows them: the next two ranks, where three fit a key.
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while done < depth and len(tied):
        step = min(done, depth - done)
        at = order[tied]
        both = rank[at].astype(np.int64) * n + rank[(at + step) % n]
        if n < 1 << 21 and done + step < depth:
            more = min(done, depth - done - step)
            both *= n
            both += rank[(at + step + more) % n]
            step += more
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~new | ~np.append(new[1:], True)]
        done += step
    return order, keys, packed, bits


def repeated_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Of each rotation of ``symbols``: do its first ``depth`` symbols start another one too?

    Borders between neighbours of the suffix order are found by the length of what the two
    have in common. A border of length m between rotations x and y is carried back over each
    symbol c that stands before rotations on both sides of it: between the last c-rotation
    before it and the first one after it there is a border of length m + 1, unless a
    shorter one was found there. After ``depth`` - 1 steps all others have ``depth`` symbols in common.
    """
    n = len(symbols)
    symbols = symbols - symbols.min()
    used = np.bincount(symbols) > 0
    n_symbols = int(used.sum())
    # Small numbers: the order by one symbol is a radix sort.
    symbols = (np.cumsum(used) - 1).astype(np.uint16)[symbols]
    order, keys, packed, bits = suffix_order(symbols, depth, n_symbols)
    border = np.ones(n + 1, bool)
    border[1:n] = keys[1:] != keys[:-1]
    edge = np.flatnonzero(border[1:n] & (keys[1:] >> bits == keys[:-1] >> bits)) + 1
    before = symbols[order - 1]
    # Place j of the order, less its first symbol, is place follows[j]; back is the way there.
    follows = np.argsort(before, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)
    back[follows] = np.arange(n, dtype=np.int32)
    first = before[follows]
    ranked = first.astype(np.int64) * n + follows
    # Places that have no border yet, and the same first symbol as the place before.
    free = np.zeros(n + 1, bool)
    free[1:n] = (first[1:] == first[:-1]) & ~border[1:n]
    some = np.arange(n_symbols) * n
    for _ in range(packed, depth):
        if not len(edge):
            break
        found, at, left = [], edge, edge - 1
        # Leftwards to the next border; of the few that are far from it, symbol by symbol.
        for _ in range(STEPS):
            if len(at) * n_symbols <= FEW:
                break
            j = back[left] + 1
            hit = free[j]
            j, here = j[hit], at[hit]
            j = j[follows[j] >= here]
            free[j] = False
            found.append(j)
            go = ~border[left]
            at, left = at[go], left[go] - 1
        if len(at):
            j = np.searchsorted(ranked, (at[:, None] + some).ravel())
            j = np.unique(j[free[j]])
            free[j] = False
            found.append(j)
        edge = np.concatenate(found)
        border[edge] = True
    repeated = np.zeros(n, bool)
    repeated[order] = ~border[:n] | ~border[1:]
    return repeated


def _repeats_in_blocks(least: int):
    """(row, start, n) of repeated windows, from runs with their bytes, sorted by anchor."""

    def solve(runs: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(r[4]) + 1 for r in runs])
        symbols = np.frombuffer(b"".join(r[4] + b"\0" for r in runs), np.uint8).astype(np.int64) + 1
        at = np.cumsum(lengths) - lengths
        symbols[at + lengths - 1] = 0
        repeated = repeated_suffixes(symbols, least)
        rows, starts, ns = [], [], []
        for (row, start, n, copies, _), place in zip(runs, at.tolist(), strict=True):
            if copies > 1:
                continue
            change = np.flatnonzero(np.diff(repeated[place : place + n].astype(np.int8), prepend=0, append=0))
            for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                rows.append(row)
                starts.append(start + a)
                ns.append(b - a)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64())], ["row", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and anchor != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(tuple(rest))
                size += len(rest[4])
                last = anchor
        if held:
            yield solve(held)

    return run


def _cut_runs(least: int, width: int | None):
    """Rows of texts with their runs to runs with bytes, or, with a ``width``, to runs in cells of so many windows."""

    def whole(raw: memoryview, r: dict) -> Iterator[tuple]:
        yield r["start"], r["n"], r["place"], r["anchor"], None, r["copies"], bytes(raw[r["start"] : r["start"] + r["n"] - 1 + least])

    def in_cells(raw: memoryview, r: dict) -> Iterator[tuple]:
        low, high = r["place"], r["place"] + r["n"] - 1
        at = r["start"] + high
        for cell in range(low // width, high // width + 1):
            a, b = max(low, cell * width), min(high, cell * width + width - 1)
            # What all windows of the cell have in common.
            core = raw[at - cell * width : at - (cell * width + width - 1) + least]
            anchor = xxhash.xxh3_64_intdigest(r["anchor"].to_bytes(8, "little", signed=True) + cell.to_bytes(4, "little") + bytes(core))
            yield at - b, b - a + 1, a, anchor - (1 << 63), xxhash.xxh3_128_digest(raw[at - b : at - a + least]), r["copies"], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                some = batch.slice(i, 100)
                out: list[tuple] = []
                for row, raw, runs in zip(some.column(0).to_pylist(), some.column(1), some.column(2).to_pylist(), strict=True):
                    view = memoryview(raw.as_buffer())
                    out += [(row, *x) for r in runs for x in (in_cells if width else whole)(view, r)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "start", "n", "place", "anchor", "bytes_hash", "copies", "bytes"])

    return run


def _with_texts(texts: DataFrame, runs: DataFrame, least: int, width: int | None = None) -> DataFrame:
    per_text = runs.groupBy("row").agg(F.collect_list(F.struct("start", "n", "place", "anchor", "copies")).alias("runs"))
    return texts.join(per_text, "row").select("row", "bytes", "runs").mapInArrow(_cut_runs(least, width), f"{_RUN}, copies long, bytes binary")


def bucketed_texts(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id, bytes, written once in buckets of rows: joins by row move no text."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode(text_or_empty(), "utf-8").alias("bytes"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(size, BUCKET)))
    name = f"texts_{uuid.uuid4().hex}"
    out = texts.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row")
    out.option("path", kept_scratch(spark)).saveAsTable(name)
    return spark.table(name)


def repeated_windows(texts: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """(row, start, n): runs of windows of ``least`` bytes that also start elsewhere, some of them told twice."""
    spark = texts.sparkSession
    marks = []
    widths = [least - max(1, least // 4) + 1]
    runs = materialize(runs_of(texts, least))
    while True:
        one = F.min(F.struct("row", "start", "n", "place")).alias("one")
        kinds = materialize(runs.groupBy("anchor", "bytes_hash").agg(F.sum("copies").alias("copies"), one))
        anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all"))
        more = kinds.where("copies > 1").select("bytes_hash", "copies")
        total = runs.count()
        again = join_hot(runs.withColumnRenamed("copies", "own").where("own = 1"), materialize(more.groupBy("bytes_hash").agg(F.sum("copies").alias("copies"))), "bytes_hash", "copies", total)
        marks.append(again.select("row", "start", F.col("n").cast("long").alias("n")))
        mixed = materialize(anchors.where("kinds > 1"))
        if len(widths) > 1 and widths[-1] == 1:
            break
        weight = mixed.select("anchor", "kinds", F.col("kinds").alias("weight"))
        unequal = materialize(join_hot(kinds.select("anchor", "copies", "one.*"), weight, "anchor", "weight", kinds.count()))
        few = _with_texts(texts, unequal.where(F.col("kinds") <= group), least).select("anchor", "row", "start", "n", "copies", "bytes")
        size = unequal.where(F.col("kinds") <= group).agg(F.sum(F.col("n") + least)).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(size, 4 * BLOCK))
        sorted_ = few.repartition(tasks, "anchor").sortWithinPartitions("anchor")
        marks.append(materialize(sorted_.mapInArrow(_repeats_in_blocks(least), "row long, start long, n long")))
        many = unequal.where(F.col("kinds") > group)
        if many.isEmpty():
            break
        widths.append(-(-widths[-1] // CELLS))
        runs = materialize(_with_texts(texts, many, least, widths[-1]).drop("bytes"))
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def without_repeats(docs: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (start, end: maximal removed runs, in bytes) and kept (the remaining bytes): one row a document."""
    texts = bucketed_texts(docs)
    found = repeated_windows(texts, least, group).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for raw, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = raw.as_buffer()
                own: list[list[int]] = []
                for r in runs or ():
                    start, end = r["start"], r["start"] + r["n"] - 1 + least
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([start, end])
                starts = [0, *(b for _, b in own)]
                ends = [*(a for a, _ in own), len(raw)]
                view = memoryview(raw)
                kept.append(b"".join(view[a:b] for a, b in zip(starts, ends, strict=True)))
                spans.append([{"start": a, "end": b} for a, b in own])
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = texts.join(found, "row", "left").select("doc_id", "bytes", "runs")
    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    cut = without_repeats(docs.select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


#: Windows are told apart by 64-bit hashes here.
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT r, p, hash(substr(h, 2 * p + 1, {2 * LEAST})) AS k FROM (SELECT r, h, unnest(range(n - {LEAST - 1})) AS p FROM d WHERE n >= {LEAST})),
m AS MATERIALIZED (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, p, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -{2 * LEAST}) + {LEAST} AS new FROM m)),
s AS (SELECT r, min(p) AS a, max(p) + {LEAST} AS b FROM g GROUP BY r, g),
t AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY r),
k AS (SELECT doc_id, n, n_removed, n_spans, CASE WHEN a IS NULL THEN h
  ELSE array_to_string([h[2 * (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) + 1 : 2 * (CASE WHEN i > len(a) THEN n ELSE a[i] END)] FOR i IN range(1, len(a) + 2)], '') END AS left_over FROM d LEFT JOIN t USING (r))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM k"""
