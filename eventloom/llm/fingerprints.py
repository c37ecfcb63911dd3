"""Document fingerprints by consistent weighted sampling.

A document is its five-word shingles, each weighted by how often it occurs. For each of the
samples every weighted term gets gamma-distributed r and c and a uniform beta from its hash;
t = floor(ln w / r + beta), ln y = r (t - beta), and the term with the least ln c - ln y - r
is drawn. Two documents draw the same (term, t) with a probability equal to their
generalised Jaccard similarity, so the share of equal samples estimates it.

The edited text of a document needs the start of the next one by doc_id. Documents are dealt
out by ranges of doc_id that begin at doc_ids of the table; a document that begins a range
is also sent to the range before, so each task meets every pair it needs in a single pass
over its sorted rows, one document at a time.

Defined cases: a null text is empty, its fingerprint the empty string (like only itself); a
very long text is sampled whole, some terms at a time; a null doc_id comes first, and doc_ids
that are texts follow by code point; documents with one doc_id follow one another by a hash of
the text, and lie in one range; one lone document is its own next; an empty table gives an
empty result; columns other than the named ones are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import blocks_for, table, text_or_empty
from eventloom.llm.shingles import mixed, shingle_hashes

SAMPLES = 64
SEED = 7
ROWS_PER_RANGE = 3000
MOST_RANGES = 100_000
_BITS = 16
#: Terms that are sampled together, and the most whose values are kept for the edited text, so that a long text takes no more memory.
_CHUNK = 1024
_KEPT = 32_768


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal steps, by bisection of its distribution."""
    u = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
    lo, hi = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return hi


class Drawn(NamedTuple):
    """What a text drew: a 16-bit code for each sample, its terms, and their values unless they are many."""

    code: np.ndarray
    terms: np.ndarray
    values: np.ndarray | None


def _quantiles(of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    # take() with machine integers is twice as fast as indexing with others.
    return of.take((bits >> np.uint32(16)).astype(np.intp), mode="clip")


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.a, self.b, self.d = (rng.integers(1, 1 << 32, (samples, 1), dtype=np.uint32) | np.uint32(1) for _ in range(3))
        gamma = _gamma_quantiles()
        self.r = gamma.astype(np.float32)
        self.ln_c = np.log(gamma).astype(np.float32)

    def _bits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash bits of each sample and term: those of r (upper half) and beta (lower), and those of c."""
        lo, hi = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        one = lo * self.a
        one ^= hi * self.b
        one ^= one >> np.uint32(15)
        return one, (one + hi) * self.d

    def _r_beta(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta = (one & np.uint32(0xFFFF)).view(np.int32).astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(1 / 65536)
        return _quantiles(self.r, one), beta

    def _values(self, x: np.ndarray) -> np.ndarray:
        """ln c - ln y - r of terms that occur once (ln w = 0, so t = 0)."""
        one, two = self._bits(x)
        r, beta = self._r_beta(one)
        r *= np.subtract(np.float32(1), beta, out=beta)
        value = _quantiles(self.ln_c, two)
        value -= r
        return value

    def _parts(self, terms: np.ndarray, known: Sequence[Drawn]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of terms, ascending, and a copy of their values where ``known`` has them; for the rest, some at a time."""
        left = np.arange(len(terms))
        for other in known:
            if other.values is not None:
                at = np.minimum(np.searchsorted(other.terms, terms[left]), len(other.terms) - 1)
                same = other.terms[at] == terms[left]
                if same.any():
                    yield left[same], other.values.take(at[same], axis=1, mode="clip")
                    left = left[~same]
        for k in range(0, len(left), _CHUNK):
            yield left[k : k + _CHUNK], self._values(terms[left[k : k + _CHUNK]])

    def draw(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 16-bit code of (term, t) for each sample; ``terms`` are distinct and sorted."""
        return self.sample(terms, weights).code

    def sample(self, terms: np.ndarray, weights: np.ndarray, known: Sequence[Drawn] = ()) -> Drawn:
        best = np.full(self.samples, np.inf, np.float32)
        which, level = np.zeros(self.samples, np.int64), np.zeros(self.samples, np.int64)
        rows, keep, kept = np.arange(self.samples), not known and len(terms) <= _KEPT, []
        for place, value in self._parts(terms, known):
            if keep:
                kept.append(value)
            many = np.flatnonzero(weights[place] > 1)
            if len(many):
                r, beta = self._r_beta(self._bits(terms[place[many]])[0])
                t = np.floor(np.log(weights[place[many]]).astype(np.float32) / r + beta)
                value = value.copy()
                value[:, many] -= r * t
            own = value.argmin(axis=1)
            low, term = value[rows, own], place[own]
            better = (low < best) | ((low == best) & (term < which))
            best[better], which[better], level[better] = low[better], term[better], 0
            if len(many):
                at = np.minimum(np.searchsorted(many, own), len(many) - 1)
                better &= many[at] == own
                level[better] = t[rows, at][better]
        code = (mixed(terms[which] * np.uint64(31) + level.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        return Drawn(code, terms, np.concatenate(kept, axis=1) if len(kept) > 1 else kept[0] if kept else None)

    def fingerprint(self, text: str, known: Sequence[Drawn] = ()) -> Drawn | None:
        """None for a text without words. Terms of ``known`` texts aren't hashed again."""
        terms, weights = np.unique(shingle_hashes(text), return_counts=True)
        return self.sample(terms, weights, known) if len(terms) else None


def _hex(drawn: Drawn | None) -> str:
    return "" if drawn is None else drawn.code.astype(">u2").tobytes().hex()


def likeness(a: Drawn | None, b: Drawn | None) -> float:
    """Share of equal samples: the estimate of generalised Jaccard similarity."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a.code == b.code).mean())


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _range_starts(docs: DataFrame, n: int, least) -> list:
    """At most n - 1 doc_ids above the least, about as many rows between each two. They only balance the tasks."""
    if dict(docs.dtypes)["doc_id"] == "string":
        # Strings have no percentile_approx: every so many of a sample's sorted ids, which don't repeat much.
        share = min(1.0, 64 * n / max(1, docs.count()))
        some = sorted(r["doc_id"] for r in docs.select("doc_id").where("doc_id is not null").sample(share, seed=1).limit(128 * n).collect())
        found = [some[len(some) * i // n] for i in range(1, n)] if some else []
    else:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted({x for x in found if x > least})


def by_ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows dealt out by ranges of doc_id (``__range``), a task a range, and sorted in them.

    Each range ends with the rows that begin the next one (``__ahead``); the first of all
    follow the last range. Some doc_ids for each range come to the driver, no more.
    """
    n_rows, n_null, least = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    n = min(MOST_RANGES, blocks_for(n_rows, rows_per_range))
    starts = _range_starts(docs, n, least) if n > 1 and least is not None else []
    if starts and n_null:
        # Rows without an id stand before all others: a range of their own.
        starts = [least, *starts]
    last = len(starts)
    text = dict(docs.dtypes)["doc_id"] == "string"
    begins, first = np.array(starts, object if text else np.int64), None if n_null else least

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, missing: pd.Series) -> pd.Series:
        """Twice the range, and for a row that is sent ahead also twice the range before and one."""
        known, value = ~missing.to_numpy(), ids.to_numpy(object if text else np.int64)
        at = np.where(known, np.searchsorted(begins, value, side="right"), 0)
        begin = known & np.isin(value, begins)
        head = ~known if first is None else known & (value == first)
        return pd.Series([[2 * r, *([2 * r - 1] if b else []), *([2 * last + 1] if h else [])] for r, b, h in zip(at, begin, head, strict=True)])

    out = docs.withColumn("__place", F.explode(places(F.coalesce("doc_id", F.lit("" if text else 0)), F.col("doc_id").isNull()))).withColumn("__key", F.xxhash64("text"))
    out = out.withColumn("__range", F.shiftright("__place", 1)).withColumn("__ahead", F.col("__place") % 2 == 1)
    order = ["__range", "__ahead", F.col("doc_id").asc_nulls_first(), "__key"]
    return out.repartitionById(last + 1, F.col("__range")).sortWithinPartitions(*order).select("__range", "__ahead", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and how alike they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, seed)
        open_range, held = None, None
        for batch in batches:
            rows = []
            for k, (at, ahead) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at == open_range and ahead and held is None:
                    continue
                text = batch.column(3)[k].as_py()
                own = sampler.fingerprint(text)
                if at == open_range and held is not None:
                    doc_id, before, code = held
                    edited = edited_text(before, text)
                    # Nearly all its shingles are of one of the two texts.
                    new = sampler.fingerprint(edited, [x for x in (code, own) if x is not None])
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc_id, len(before), digest, _hex(code), _hex(new), likeness(code, new), likeness(code, own)))
                open_range = at
                held = None if ahead else (batch.column(2)[k].as_py(), text, own)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    kind = "string" if kind == "string" else "bigint"
    types = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ranged = by_ranges(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), text_or_empty().alias("text")))
    return ranged.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op8_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
