"""Vector codes: weighted Lloyd over the distinct parts of each position, codes joined back.

Components become integers and vectors are cut into equal parts. Equal parts of a position
fall together first (inside a task, then by an exchange), so Lloyd's rounds run over distinct
parts with their numbers, however many vectors share one. A round reads the distinct parts
once, with the codebooks beside each task, and sends home one row for each entry and
component: parts x entries x components of a part, a bound that no table changes. The codes
and squared distances of distinct parts are then joined to the vectors' parts, frequent ones
by broadcast (``join_hot``), and gathered into one code and one error a vector.

Defined cases: vectors that are null or hold a null or non-finite component are dropped, and
so are those of another length than the kept vector of the smallest id; a length that can't
be cut into equal parts is an error, as are values whose squared distances don't fit a long.
Null ids come after all others, repeated ids are ordered by their integers, and each such row
is coded; with fewer rows than entries there are as many entries as rows. Null labels are one
label. Equal distances take the lower entry. An empty table gives an empty result; columns
other than the named ones are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import join_hot, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distinct parts held against an entry at once.
CHUNK = 8192


@dataclass(frozen=True)
class Shape:
    """How vectors are cut, and the integer type that holds any component of the table."""

    parts: int
    size: int
    kind: str

    @property
    def key_bytes(self) -> int:
        """A key is the part's place, two bytes, and its components."""
        return 2 + self.size * np.dtype(self.kind).itemsize

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, parts, key_bytes) of (n, parts x size) integers."""
        n = len(vectors)
        out = np.empty((n, self.parts, self.key_bytes), np.uint8)
        out[:, :, :2] = np.arange(self.parts, dtype="<u2").view(np.uint8).reshape(1, self.parts, 2)
        values = np.ascontiguousarray(vectors.reshape(n, self.parts, self.size).astype(self.kind))
        out[:, :, 2:] = values.view(np.uint8).reshape(n, self.parts, -1)
        return out

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places and the components (n, size) of a column of keys."""
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), self.key_bytes)
        values = np.ascontiguousarray(raw[:, 2:]).view(self.kind).reshape(len(column), self.size)
        return raw[:, 0].astype(np.int64) + (raw[:, 1].astype(np.int64) << 8), values.astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows (n, bytes)."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integer_vectors(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """row (unique), the table's other columns, and ``__ints``: finite vectors as integers, floors going down."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rest = [F.col(c) for c in vectors.columns if c != vector]
    return vectors.where(v.isNotNull() & finite).select(F.monotonically_increasing_id().alias("__row"), *rest, ints.alias("__ints"))


def _nearest(places: np.ndarray, values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part's codebook, the lower at equal distances, and the squared distance."""
    code, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for place in np.unique(places):
        at = np.flatnonzero(places == place)
        for i in range(0, len(at), CHUNK):
            some = at[i : i + CHUNK]
            far = ((values[some, None, :] - books[place][None]) ** 2).sum(axis=2)
            code[some] = far.argmin(axis=1)
            error[some] = far[np.arange(len(some)), code[some]]
    return code, error


def distinct_parts(kept: DataFrame, shape: Shape) -> DataFrame:
    """(key, weight), one row a distinct part of a position; written once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                ints = _integers(batch.column(0).slice(i, CHUNK), shape.parts * shape.size)
                rows = shape.keys(ints).reshape(-1, shape.key_bytes)
                keys, n = np.unique(rows.view(f"V{shape.key_bytes}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([_binary(keys.view(np.uint8).reshape(-1, shape.key_bytes)), pa.array(n, pa.int64())], ["key", "n"])

    return materialize(kept.select("__ints").mapInArrow(found, "key binary, n long").groupBy("key").agg(F.sum("n").alias("weight")))


def lloyd_round(distinct: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment of all weighted parts; unused entries stay."""
    parts, entries, size = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for batch in batches:
            places, values = shape.read(batch.column(0))
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            slot = places * entries + _nearest(places, values, books)[0]
            np.add.at(n, slot, weight)
            np.add.at(sums, slot, values * weight[:, None])
        slots = np.repeat(np.flatnonzero(n), size)
        where = np.tile(np.arange(size), len(slots) // size) if size else slots
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "place": pa.array(where, pa.int64()), "n": pa.array(n[slots], pa.int64()), "total": pa.array(sums[slots, where], pa.int64())})

    sums = distinct.mapInArrow(added, "slot long, place long, n long, total long").groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = books.copy()
    for r in sums.collect():
        new[r["slot"] // entries, r["slot"] % entries, r["place"]] = r["total"] // r["n"]
    return new


def compress(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows without their vectors, with ``code`` (two hexadecimal digits a part) and ``error``;
    and the codebooks (parts, entries, components of a part)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry is two hexadecimal digits")
    kept = materialize(integer_vectors(vectors, vector, scale))
    order = [F.col(key).asc_nulls_last(), F.col("__ints"), F.col("__row")]
    first = kept.select(key, "__ints", "__row").orderBy(*order).limit(1).collect()
    length = len(first[0]["__ints"]) if first else 0
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("__ints") == length)
    size = length // parts
    seeds = [r["__ints"] for r in kept.select(key, "__ints", "__row").orderBy(*order).limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, size).transpose(1, 0, 2).copy()
    low, high = kept.agg(F.min(F.array_min("__ints")), F.max(F.array_max("__ints"))).first() if length else (0, 0)
    low, high = low or 0, high or 0
    if length * (high - low + 1) ** 2 >= 2**62:
        raise OverflowError("squared distances between these vectors don't fit a long")
    shape = Shape(parts, size, next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
    distinct = distinct_parts(kept, shape)
    for _ in range(rounds if seeds else 0):
        books = lloyd_round(distinct, shape, books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = _nearest(*shape.read(batch.column(0)), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], ["key", "weight", "code", "error"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                keys = shape.keys(_integers(some.column(1), length)).reshape(-1, shape.key_bytes)
                rows = np.repeat(some.column(0).to_numpy(zero_copy_only=False), parts)
                places = np.tile(np.arange(parts, dtype=np.int32), some.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places), _binary(keys)], ["__row", "place", "key"])

    coded = materialize(distinct.mapInArrow(assigned, "key binary, weight long, code long, error long"))
    total = kept.count() * parts
    pieces = kept.select("__row", "__ints").mapInArrow(split, "__row long, place int, key binary")
    joined = join_hot(pieces, coded, "key", "weight", total)
    # Eight parts a long: codes add up without a list.
    longs = -(-parts // 8)
    words = [F.bit_or(F.when(F.floor(F.col("place") / 8) == w, F.expr("shiftleft(code, cast(8 * (7 - place % 8) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(longs)]
    whole = joined.groupBy("__row").agg(F.sum("error").alias("error"), *words)
    text = F.concat(*[F.substring(F.lower(F.lpad(F.hex(f"w{w}"), 16, "0")), 1, 2 * min(8, parts - 8 * w)) for w in range(longs)])
    codes = whole.select("__row", text.alias("code"), "error")
    return kept.drop("__ints").join(codes, "__row").drop("__row"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over rows of an equal label, nulls together."""
    keyed = materialize(coded.withColumn("__label", F.when(F.col(label).isNull(), "").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))))
    sums = materialize(keyed.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")))
    return join_hot(keyed, sums, "__label", "__n", keyed.count()).drop("__label")


def code_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row a kept vector."""
    coded, books = compress(vectors.select("vec_id", "embedding", "label"))
    out = label_errors(coded, "label").withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    assign = """
    SELECT * EXCLUDE (rn) FROM (
      SELECT p.part, p.v, p.weight, b.entry, list_sum([(p.v[i] - b.c[i]) * (p.v[i] - b.c[i]) FOR i IN range(1, len(p.v) + 1)])::BIGINT AS err,
             row_number() OVER (PARTITION BY p.part, p.v ORDER BY err, b.entry) AS rn
      FROM parts p JOIN {book} b ON p.part = b.part) WHERE rn = 1"""
    update = """
    SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM {book} b LEFT JOIN (
      SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
        SELECT part, entry, i, sum(v[i] * weight) AS s, sum(weight) AS n FROM {assigned}, (SELECT unnest(range(1, (SELECT d FROM dims) + 1)) AS i) GROUP BY ALL)
      GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry"""
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT (len(q) // {PARTS})::BIGINT AS d FROM kept WHERE r = 0),
pieces AS (SELECT r, part, q[part * d + 1 : part * d + d] AS v FROM kept, dims, (SELECT unnest(range({PARTS})) AS part)),
parts AS MATERIALIZED (SELECT part, v, count(*) AS weight FROM pieces GROUP BY ALL),
book0 AS MATERIALIZED (SELECT part, r AS entry, v AS c FROM pieces WHERE r < {ENTRIES}),
a0 AS MATERIALIZED ({assign.format(book="book0")}),
book1 AS MATERIALIZED ({update.format(book="book0", assigned="a0")}),
a1 AS MATERIALIZED ({assign.format(book="book1")}),
book2 AS MATERIALIZED ({update.format(book="book1", assigned="a1")}),
a2 AS MATERIALIZED ({assign.format(book="book2")}),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
coded AS (
  SELECT r, string_agg(printf('%02x', a.entry), '' ORDER BY p.part) AS code, sum(a.err)::BIGINT AS error
  FROM pieces p JOIN a2 a ON a.part = p.part AND a.v = p.v GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


OP11_SQL = _sql()
