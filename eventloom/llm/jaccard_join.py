"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Texts with the same set of five-word shingles are one class; the join works on one text of
each class, so copies are never expanded into pairs. Classes meet in buckets of banded
MinHash values. Each bucket has about 128 representatives (all of its classes, if they are
no more), chosen by a hash, and every class is held against them: the remaining MinHash
values of a pair are compared incrementally. With a uniform prior, after n values of which m
agree the similarity has a Beta(m + 1, n - m + 1) posterior, and a pair whose posterior
probability of reaching the threshold is below the tolerance goes. Classes with a pair that
stays meet again with their whole shingle sets, on which the pair is verified exactly.

A large bucket is dealt out in parts of bounded rows and bytes; its representatives go to
each part, its other classes to one, so rows grow with the classes and not with their pairs.
Links make groups. Where a bucket still holds classes of several groups, those outside its
largest group are then held against all classes of other groups, so that no link between
two groups is lost: groups are the connected components of all links. At last the classes of
one group that shared only large buckets, in which neither was a representative, are held
against each other, so that every link is counted. Counts are added up inside the tasks, no
link is a row; each and every link can be had as a row from ``jaccard_links``, whose output is
as large as it is asked to be. ``one_of_each_group`` needs groups alone and leaves the counts out.

A pair at the threshold shares none of the 28 bands of 4 with probability 4e-7 and is pruned
with a probability of 1.5e-5 (the tolerance, summed over the rounds); more alike pairs
far more seldom. No bucket, pair or group is capped.

Defined cases: a null text is empty; texts without words are one class that links with no
other; a text of fewer than five words is one shingle; a very long text has a long set, of
which parts hold fewer; repeated rows are documents of one class; of equal least doc_ids the
one with the least text hash names a class (null first); an empty table gives an empty
result; columns other than the named ones are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import DOCUMENT_COLUMNS, broadcast_if_small, join_hot, materialize, table, text_or_empty
from eventloom.llm.shingles import mixed, shingle_hashes

THRESHOLD = 0.8
BANDS, BAND_ROWS = 28, 4
CHECKS, ROUND = 128, 8
TOLERANCE = 1e-6
#: Representatives of a bucket, on average.
REPRESENTATIVES = 128
#: Classes of a bucket, and bytes of their shingle sets, in one part, on average.
PART, PART_BYTES = 1024, 16_000_000
#: Classes in one block where blocks are held against each other.
BLOCK = 512
#: A group's classes meet as a whole if these are at most so many times the pairs in its buckets.
WHOLE = 1.0
SEED = 11
_CHUNK = 2048
_PAIRS = 200_000
#: Pairs whose bands are looked at together.
_BANDED = 16_384
#: Bytes of shingle sets that a task holds before it hands them on.
_HELD = 4_000_000
_WIDTH = 2 * CHECKS


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each round, the fewest agreeing values with which a pair stays.

    P(J >= t | m of n agree) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(ROUND, CHECKS + 1, ROUND):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class MinHasher:
    def __init__(self, seed: int = SEED):
        n = BANDS * BAND_ROWS + CHECKS
        rng = np.random.default_rng(seed)
        self.a, self.b = (rng.integers(1, 1 << 32, (n, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bucket keys of the bands, and the values to compare as bytes."""
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), _CHUNK):
            x = shingles[at : at + _CHUNK]
            values = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32) * self.a
            values ^= (x >> np.uint64(32)).astype(np.uint32) * self.b
            np.minimum(least, values.min(axis=1), out=least)
        rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(BAND_ROWS):
            keys = mixed(keys * np.uint64(0x100000001B3) + rows[:, k])
        checks = (mixed(least[BANDS * BAND_ROWS :].astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
        return keys.view(np.int64), checks.tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_id, n_shingles, bands, signature: one row a document, texts left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            sets, sizes, bands, signs = [], [], [], []
            for text in batch.column(2):
                shingles = np.unique(shingle_hashes(text.as_py()))
                sizes.append(len(shingles))
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys, sign = hasher.signature(shingles) if len(shingles) else (None, None)
                bands.append(keys)
                signs.append(sign)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                ["doc_id", "text_key", "set_id", "n_shingles", "bands", "signature"],
            )

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, set_id binary, n_shingles long, bands array<long>, signature binary")


class _Cells:
    """Works through rows sorted by cell (bucket, lo, hi), whole cells at a time, in bounded memory.

    A row is a class: ``_ROW`` and what ``done`` needs more, which gets rows and the pairs that stay. In a cell with lo = hi all pairs
    meet; else the rows of block lo meet the others. With ``within`` the cells are those of ``within_cells``.
    """

    def __init__(self, least: list[int], done, within: bool = False):
        self.least, self.done, self.within = least, done, within

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for batch in batches:
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            cell = self._numbers(batch, range(4))
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:, :3] != cell[:-1, :3]).any(axis=1)]))
            # The last cell may go on in the next batch.
            yield from self._judged(batch.slice(0, int(starts[-1])), cell, starts)
            kept = pa.Table.from_batches([batch.slice(int(starts[-1]))]).combine_chunks().to_batches()[0]
        if kept is not None:
            yield from self._judged(kept, self._numbers(kept, range(4)), np.array([0, kept.num_rows]))

    @staticmethod
    def _numbers(batch: pa.RecordBatch, columns) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in columns], axis=1)

    def _judged(self, batch: pa.RecordBatch, cell: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        signs = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, _WIDTH)
        bands = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        meets = self._numbers(batch, (6, 7))
        stay = (self._alike(signs, bands, meets, cell, a, b) for a, b in self._paired(cell, starts))
        yield from self.done(batch, cell, ((a, b) for a, b in stay if len(a)))

    @staticmethod
    def _paired(cell: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of the cells, about ``_PAIRS`` at a time."""
        left, right, n = [], [], 0
        for lo, hi in zip(starts, starts[1:], strict=False):
            if cell[lo, 1] == cell[lo, 2]:
                one, two = np.arange(lo, hi), None
            else:
                first = cell[lo:hi, 3] == cell[lo, 1]
                one, two = np.flatnonzero(first) + lo, np.flatnonzero(~first) + lo
            step = max(1, _PAIRS // (hi - lo))
            for at in range(0, len(one), step):
                some = one[at : at + step]
                if two is None:
                    counts = hi - 1 - some
                    a = np.repeat(some, counts)
                    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
                else:
                    a, b = np.repeat(some, len(two)), np.tile(two, len(some))
                left.append(a)
                right.append(b)
                n += len(a)
                if n >= _PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, n = [], [], 0
        if n:
            yield np.concatenate(left), np.concatenate(right)

    def _alike(self, signs: np.ndarray, bands: np.ndarray, meets: np.ndarray, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        checks = signs.view(np.uint16)
        apart = meets[a, 1] != meets[b, 1]
        a, b = a[apart], b[apart]
        same = np.zeros(len(a), np.int64)
        for r, least in enumerate(self.least):
            part = slice(r * ROUND, (r + 1) * ROUND)
            same += (checks[a, part] == checks[b, part]).sum(axis=1)
            stay = same >= least
            a, b, same = a[stay], b[stay], same[stay]
        # A pair that meets in several buckets counts in the first band in which it meets.
        here = np.zeros(len(a), bool)
        bits = np.left_shift(np.int64(1), np.arange(BANDS))
        for at in range(0, len(a), _BANDED):
            x, y = a[at : at + _BANDED], b[at : at + _BANDED]
            met = ((meets[x, 0] | meets[y, 0])[:, None] & bits) != 0
            equal = bands[x] == bands[y]
            met &= equal
            if self.within:
                band = meets[x, 0] >> BANDS
                here[at : at + _BANDED] = ~met.any(axis=1) & ((band == 0) | (band == equal.argmax(axis=1) + 1))
            else:
                here[at : at + _BANDED] = bands[x, met.argmax(axis=1)] == cell[x, 0]
        return a[here], b[here]


_CELL = ["bucket", "lo", "hi"]
#: ``meets``: bit k is set if the class meets in its k-th band all that it shares the bucket
#: with; ``team``: classes of one team are not compared.
_ROW = [*_CELL, "block", "set_id", "signature", "meets", "team", "bands"]


def _in_cells(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).select(*_ROW, *more)


def placed(classes: DataFrame) -> DataFrame:
    """(set_id, band, bucket, n, parts, leads): classes in the buckets that they share; ``n`` classes are in a bucket."""
    banded = classes.select("set_id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(8 * F.col("held") / PART_BYTES)).cast("long")
    leads = F.pmod(F.xxhash64("bucket", "set_id"), F.col("n")) < REPRESENTATIVES
    return banded.join(shared, "bucket").select("set_id", "n_shingles", "band", "bucket", "n", parts.alias("parts"), leads.alias("leads"))


def _cells(rows: DataFrame, cells: Column, meets: Column, team: Column) -> DataFrame:
    """The cells of each class, from its places (at most one a band)."""
    place = F.struct("bucket", cells.alias("cells"))
    gathered = rows.groupBy("set_id").agg(F.collect_list(place).alias("at"), F.sum(meets).alias("meets"), F.first(team).alias("team"))
    each = gathered.select("set_id", "meets", "team", F.explode("at").alias("x"))
    return each.select("set_id", "meets", "team", "x.bucket", F.explode("x.cells").alias("c")).select("bucket", "c.lo", "c.hi", "c.block", "set_id", "meets", "team")


def _cell(lo: Column, hi: Column, block: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), block.cast("long").alias("block"))


_BIT = "shiftleft(1L, band)"


def representative_cells(places: DataFrame) -> DataFrame:
    """Representatives (block 0) with each other and with each part of their bucket."""
    zero, part = F.lit(0), 1 + F.pmod(F.xxhash64("set_id"), F.col("parts"))
    # Without a part of its own: all classes of a bucket are representatives.
    all_lead = F.col("n") <= REPRESENTATIVES
    cells = F.when(all_lead, F.array(_cell(zero, zero, zero)))
    cells = cells.when(F.col("leads"), F.transform(F.sequence(F.lit(0).cast("long"), "parts"), lambda k: _cell(zero, k, zero)))
    cells = cells.otherwise(F.array(_cell(zero, part, part)))
    return _cells(places, cells, F.when(F.col("leads"), F.expr(_BIT)).otherwise(0), F.xxhash64("set_id"))


def group_cells(places: DataFrame, labels: DataFrame) -> DataFrame:
    """In buckets with classes of several groups: those outside the largest group with each other and with all others.

    ``labels`` has (node, label). The rows are few unless a large bucket holds many groups,
    whose classes then are compared block by block.
    """
    large = places.where(F.col("n") > REPRESENTATIVES)
    named = materialize(large.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "band", "bucket", "n", "parts", F.coalesce("label", "set_id").alias("label")))
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed_buckets = named.join(most, "bucket").withColumn("minor", F.col("label") != F.col("top.label"))
    blocks = F.ceil((F.col("n") - F.col("top.c")) / BLOCK)
    mixed_buckets = mixed_buckets.withColumn("blocks", blocks.cast("long")).withColumn("h", F.xxhash64("set_id"))
    block, part = 1 + F.pmod(F.col("h"), F.col("blocks")), F.col("blocks") + 1 + F.pmod(F.col("h"), F.col("parts"))
    others = F.sequence(F.lit(1).cast("long"), F.col("blocks") + F.col("parts"))
    own = F.transform(others, lambda k: _cell(F.least(k, block), F.greatest(k, block), block))
    rest = F.transform(F.sequence(F.lit(1).cast("long"), "blocks"), lambda k: _cell(k, part, part))
    return _cells(mixed_buckets, F.when(F.col("minor"), own).otherwise(rest), F.expr(_BIT), F.xxhash64("label"))


def all_cells(places: DataFrame) -> DataFrame:
    """Every class with every other of its bucket, block by block."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK).cast("long"), F.col("parts"))
    block = F.pmod(F.xxhash64("set_id"), blocks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: _cell(F.least(k, block), F.greatest(k, block), block))
    return _cells(places, cells, F.expr(_BIT), F.xxhash64("set_id"))


def within_cells(places: DataFrame, labels: DataFrame) -> DataFrame | None:
    """In large buckets: the classes of one group that are no representatives there, with each other; None if there are none.

    ``labels`` are those that ``group_cells`` had. All such classes of a group meet in cells of
    the group, or in those of its part of each bucket, whichever are fewer pairs. ``meets``: bit
    k is set if the class is a representative in its k-th band, where its pairs have met; the
    bits from ``BANDS`` on hold the number of the cell's band, from 1, or 0 for a group's cell.
    """
    aside = places.where((F.col("n") > REPRESENTATIVES) & ~F.col("leads"))
    named = materialize(aside.join(labels, F.col("set_id") == F.col("node")).select("set_id", "n_shingles", "band", "label", F.xxhash64("bucket", "label").alias("key")))
    n_named = named.count()
    if not n_named:
        return None
    size = lambda w: (F.count(F.lit(1)).alias("m"), F.count(F.lit(1)).alias(w), F.sum("n_shingles").alias("held"))
    members = materialize(named.select("set_id", "n_shingles", "label").distinct())
    in_buckets = materialize(named.groupBy("label", "key").agg(*size("n_of_key")).where("m > 1"))
    costs = in_buckets.groupBy("label").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost"))
    groups = members.groupBy("label").agg(*size("n_of_label")).join(costs, "label")
    groups = materialize(groups.withColumn("whole", F.col("m").cast("double") * F.col("m") <= WHOLE * F.col("cost")))
    by_group = join_hot(members, groups.where("whole").drop("whole", "cost"), "label", "n_of_label", n_named)
    split = in_buckets.join(groups.where("NOT whole").select("label"), "label", "left_semi").drop("label")
    by_bucket = join_hot(named, split, "key", "n_of_key", n_named)
    home = ["set_id", "key", "mark", "m", "held"]
    homes = by_group.withColumns({"key": F.xxhash64("label"), "mark": F.lit(0).cast("long")}).select(*home)
    homes = homes.unionByName(by_bucket.withColumn("mark", F.shiftleft((F.col("band") + 1).cast("long"), BANDS)).select(*home))
    led = places.join(members.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.sum(F.when(F.col("leads"), F.expr(_BIT)).otherwise(0)).alias("led"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(8 * F.col("held") / PART_BYTES)).cast("long")
    homes = homes.join(led, "set_id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: _cell(F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.col("own")))
    each = homes.select("set_id", F.col("key").alias("bucket"), (F.col("mark") + F.col("led")).alias("meets"), F.explode(cells).alias("c"))
    return each.select("bucket", "c.lo", "c.hi", "c.block", "set_id", "meets", F.xxhash64("set_id").alias("team"))


def candidate_members(cells: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, within: bool = False) -> DataFrame:
    """``_ROW``: classes with a pair in that cell that Bayesian pruning leaves.

    No pair is a row of its own: a cell gives at most its classes.
    """

    def done(batch: pa.RecordBatch, cell: np.ndarray, alike: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        paired = np.zeros(batch.num_rows, bool)
        for pair in alike:
            for side in pair:
                paired[side] = True
        if paired.any():
            yield batch.take(pa.array(np.flatnonzero(paired))).select(_ROW)

    run = _Cells(least_matches(threshold, tolerance), done, within)
    dealt = _in_cells(cells.join(classes.select("set_id", "signature", "bands"), "set_id"))
    return dealt.mapInArrow(lambda batches: run(batches), "bucket long, lo long, hi long, block long, set_id binary, signature binary, meets long, team long, bands array<long>")


def asked_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, doc, key, n_docs): the classes of ``members``; signatures are in ``members``, so that no table of all is dealt out again."""
    ids = members.select("set_id").distinct()
    return materialize(classes.join(ids, "set_id", "left_semi").select("set_id", F.col("rep.doc_id").alias("doc"), F.col("rep.text_key").alias("key"), "n_docs"))


def shingle_sets(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, shingles): the whole sorted set of each class of ``asked``, as bytes."""
    named = asked.select("set_id", F.col("doc").alias("__doc"), F.col("key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(named["__doc"]) & (F.xxhash64(docs["text"]) == named["__key"])
    texts = docs.join(broadcast_if_small(named), same).select("set_id", text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[bytes] = []
            sets: list[bytes] = []
            held = 0

            def handed() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["set_id", "shingles"])
                ids.clear()
                sets.clear()
                return out

            for set_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(set_id.as_py())
                sets.append(np.unique(shingle_hashes(text.as_py())).tobytes())
                held += len(sets[-1])
                if held > _HELD:
                    yield handed()
                    held = 0
            yield handed()

    made = materialize(texts.mapInArrow(run, "set_id binary, shingles binary"))
    if made.count() == asked.count():
        return made
    # Rows that repeat a class's document give its set again.
    return materialize(made.groupBy("set_id").agg(F.first("shingles").alias("shingles")))


def verified(members: DataFrame, asked: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, pairs: bool = False, within: bool = False) -> DataFrame:
    """Links: pairs that stay whose whole shingle sets reach the threshold.

    With ``pairs`` a row a link (a, b, jaccard). Else a row a class and cell: (set_id, near,
    head), the documents of the classes linked there and the least of those that the cell's
    links connect, so that a large group of near copies takes rows in proportion to its size.
    """

    def done(batch: pa.RecordBatch, cell: np.ndarray, alike: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in alike:
            yield from some(batch, cell, a, b)

    def some(batch: pa.RecordBatch, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, sizes = batch.column(4).to_pylist(), batch.column(9).to_numpy(zero_copy_only=False)
        raw = batch.column(10)
        near = np.zeros(batch.num_rows, np.int64)
        up: dict[int, int] = {}
        links: list[tuple[int, int, float]] = []

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        # Pairs of one cell stand together: their rows are one run, whose shingles are numbered once.
        where = np.flatnonzero(np.concatenate([[True], (cell[a[1:], :3] != cell[a[:-1], :3]).any(axis=1), [True]]))
        for lo, hi in zip(where, where[1:], strict=False):
            rows = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]))
            have = [np.frombuffer(raw[int(r)].as_py(), np.uint64) for r in rows]
            lengths = np.array([len(x) for x in have])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            _, number = np.unique(np.concatenate(have), return_inverse=True)
            flags = np.zeros(int(number.max()) + 1, bool)
            x, y = np.searchsorted(rows, a[lo:hi]), np.searchsorted(rows, b[lo:hi])
            for one in np.unique(x):
                mine = number[starts[one] : starts[one + 1]]
                flags[mine] = True
                others = y[x == one]
                if len(others) < 8:
                    both = np.array([flags[number[starts[o] : starts[o + 1]]].sum() for o in others])
                else:
                    both = np.add.reduceat(flags[number].astype(np.int64), starts[:-1])[others]
                flags[mine] = False
                share = both / (lengths[one] + lengths[others] - both)
                hit = share >= threshold
                met = rows[others[hit]]
                near[rows[one]] += sizes[met].sum()
                near[met] += sizes[rows[one]]
                if pairs:
                    links.extend((int(rows[one]), q, j) for q, j in zip(met.tolist(), share[hit].tolist(), strict=True))
                elif not within:
                    # Inside a group all are connected already.
                    for q in met.tolist():
                        p, q = sorted((root(int(rows[one])), root(q)), key=ids.__getitem__)
                        up[q] = p
        if links:
            ends = [sorted((ids[p], ids[q])) for p, q, _ in links]
            yield pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in ends]), "b": pa.array([e[1] for e in ends]), "jaccard": pa.array([j for *_, j in links])})
        linked = np.flatnonzero(near).tolist()
        if linked and not pairs:
            yield pa.RecordBatch.from_pydict({"set_id": pa.array([ids[p] for p in linked]), "near": pa.array(near[linked], pa.int64()), "head": pa.array([ids[root(p)] for p in linked])})

    run = _Cells(least_matches(threshold, tolerance), done, within)
    full = members.join(asked.select("set_id", "n_docs"), "set_id").join(sets, "set_id")
    return _in_cells(full, "n_docs", "shingles").mapInArrow(lambda batches: run(batches), "a binary, b binary, jaccard double" if pairs else "set_id binary, near long, head binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of the connected component, for every node of a link (a, b).

    Labels spread along links and are then followed to their own labels, so that paths halve:
    rounds grow with the logarithm of a component's width. Nodes with very many links, and
    labels of very many nodes, are joined by broadcast, however large the component.
    """
    arcs = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("node")).union(links.select("b", "a")))
    n_arcs = arcs.count()
    labels = materialize(arcs.groupBy("node").agg(F.min(F.least("src", "node")).alias("label"), F.count(F.lit(1)).alias("degree")))
    n_nodes = labels.count()
    while True:
        heard = join_hot(arcs, labels, "node", "degree", n_arcs).groupBy("src").agg(F.min("label").alias("heard"))
        spread = labels.join(heard, F.col("node") == F.col("src")).select("node", "degree", "label", F.least("label", "heard").alias("new"))
        spread = materialize(spread)
        own = spread.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        further = own.join(spread.select(F.col("node").alias("new"), F.col("new").alias("further")), "new")
        after = join_hot(spread, materialize(further), "new", "n", n_nodes)
        after = materialize(after.select("node", "degree", "label", F.least("new", "further").alias("new")))
        labels = after.select("node", F.col("new").alias("label"), "degree")
        if not after.where("label <> new").limit(1).count():
            return labels.select("node", "label")


class JaccardJoin:
    """The tables of one join: documents with their class, classes, and what links them."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE):
        self.limits = (threshold, tolerance)
        self.docs = docs.select("doc_id", "text")
        self.signed = materialize(signatures(self.docs))
        classes = self.signed.groupBy("set_id").agg(
            F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("signature").alias("signature"),
        )
        self.classes = materialize(classes)
        self.n_docs, self.n_classes = self.classes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.lit(1))).first()
        self.places = materialize(placed(self.classes))

    def _verified(self, cells: DataFrame, pairs: bool = False, within: bool = False) -> DataFrame | None:
        if within:
            # All these classes have links already, and so their signatures and sets, of which few are asked for as a rule.
            classes = self.members.groupBy("set_id").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        else:
            classes = self.classes
        members = materialize(candidate_members(cells, classes, *self.limits, within))
        if not members.limit(1).count():
            return None
        if within:
            sets = self.sets.join(broadcast_if_small(members.select("set_id").distinct()), "set_id", "left_semi")
            return verified(members, self.asked, sets, *self.limits, pairs, within)
        self.members, self.asked = members, asked_classes(members, self.classes)
        self.sets = shingle_sets(self.asked, self.docs)
        return verified(members, self.asked, self.sets, *self.limits, pairs, within)

    def links(self) -> DataFrame:
        """(a, b, jaccard): every link as a row; a group of n near copies has up to n * n / 2."""
        found = self._verified(all_cells(self.places), pairs=True)
        return self.docs.sparkSession.createDataFrame([], "a binary, b binary, jaccard double") if found is None else found

    def grouped(self, counted: bool = False) -> tuple[DataFrame, DataFrame]:
        """(set_id, near, head) of links with representatives and between groups, and (set_id, label, rep, n_docs).

        With ``counted`` also of the links inside groups, so that ``near`` adds up to all links.
        """
        linked = self._verified(representative_cells(self.places))
        if linked is None:
            linked = self.docs.sparkSession.createDataFrame([], "set_id binary, near long, head binary")
        linked = materialize(linked)
        arcs = linked.select(F.col("set_id").alias("a"), F.col("head").alias("b")).distinct()
        labels = components(arcs)
        cells = within_cells(self.places, labels) if counted else None
        inside = None if cells is None else self._verified(cells, within=True)
        more = self._verified(group_cells(self.places, labels))
        if more is not None:
            more = materialize(more)
            linked = linked.unionByName(more)
            labels = components(arcs.union(more.select("set_id", "head")).distinct())
        if inside is not None:
            linked = linked.unionByName(materialize(inside))
        labelled = self.classes.join(labels, F.col("set_id") == F.col("node"), "left")
        return linked, materialize(labelled.select("set_id", F.coalesce("label", "set_id").alias("label"), "rep", "n_docs"))

    def of_documents(self, of_classes: DataFrame) -> DataFrame:
        """The documents with what ``of_classes`` (set_id, n_docs ...) says of their class; a class of very many copies is no hot key."""
        return join_hot(self.signed.select("doc_id", "text_key", "set_id"), of_classes, "set_id", "n_docs", self.n_docs)


def named_groups(groups: DataFrame, n_classes: int, least: Column) -> DataFrame:
    """``groups`` (set_id, label, rep, n_docs) with ``least`` over the classes of a label; a label of very many classes is no hot key."""
    of = groups.groupBy("label").agg(least.alias("least"), F.count(F.lit(1)).alias("n_of_label"))
    return join_hot(groups, materialize(of), "label", "n_of_label", n_classes)


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(class_id, linked_class_id, jaccard) between the least doc_ids of two classes, a row a link."""
    join = JaccardJoin(docs, threshold, tolerance)
    named = join.classes.select("set_id", F.col("rep.doc_id").alias("doc_id"))
    one, two = (named.select(F.col("set_id").alias(k), F.col("doc_id").alias(f"d{k}")) for k in "ab")
    met = join.links().join(one, "a").join(two, "b")
    return met.select(F.least("da", "db").alias("class_id"), F.greatest("da", "db").alias("linked_class_id"), "jaccard")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, group_id, n_links: one row a document.

    Its class is the least doc_id with the same shingles, its group the least doc_id that links
    connect it with. ``n_links`` are all other documents at or above the threshold, its copies
    among them.
    """
    join = JaccardJoin(docs, threshold, tolerance)
    linked, groups = join.grouped(counted=True)
    named = named_groups(groups, join.n_classes, F.min("rep.doc_id"))
    near = linked.groupBy(F.col("set_id").alias("x")).agg(F.sum("near").alias("near"))
    named = named.join(near, F.col("set_id") == F.col("x"), "left")
    n_links = F.col("n_docs") - 1 + F.coalesce("near", F.lit(0))
    named = named.select("set_id", F.col("rep.doc_id").alias("class_id"), F.col("least").alias("group_id"), n_links.alias("n_links"), "n_docs")
    return join.of_documents(materialize(named)).select("doc_id", "class_id", "group_id", "n_links")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without their copies and near copies: of each group the least doc_id stays (a pipeline stage)."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    join = JaccardJoin(docs, threshold)
    _, groups = join.grouped()
    of = named_groups(groups, join.n_classes, F.min("rep")).select("set_id", F.col("least").alias("first"), "n_docs")
    members = join.of_documents(materialize(of))
    me = F.struct("doc_id", "text_key")
    told = materialize(members.groupBy("doc_id", "text_key", "first").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), me.eqNullSafe(F.col("first")).alias("__stays"), "rows"
    ))
    on = lambda t: docs["doc_id"].eqNullSafe(t["__doc"]) & (F.xxhash64(docs["text"]) == t["__key"])
    gone = told.where(~F.col("__stays") | (F.col("rows") > 1)).select("__doc", "__key")
    again = told.where(F.col("__stays") & (F.col("rows") > 1)).select("__doc", "__key")
    alone = docs.join(broadcast_if_small(gone), on(gone), "left_anti")
    if not again.limit(1).count():
        return alone
    nth = F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("lang"))
    repeated = docs.join(broadcast_if_small(again), on(again)).withColumn("__nth", nth).where("__nth = 1")
    return alone.unionByName(repeated.select(*docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
