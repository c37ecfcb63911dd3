"""Source divergence audit: radix-selected terms of each source, sparse sums for each pair of sources.

Terms are counted inside tasks by (lang, source) and added up by one exchange, which also
tells in how many documents of its language a term stands. Values are integers of 30 bits.
The ten highest terms of a source are found without a sort: a histogram of the highest ten
bits by group names the bin that holds the tenth place, the next ten bits are counted in that
bin alone, then the last; at the threshold so found, ties are narrowed by longer and longer
prefixes of their UTF-8 bytes. So of a source with a third of all terms no task sees more
than counts, and no list is built.

Pairs: most terms are in neither source of a pair, or in one. With ``f00`` the value of a
term that is in neither, a pair's sum is V * f00, plus for each term of one side
f(p, q0) - f00, plus for each common term what the two corrections count wrong. The first two
need only (count, how many terms have it) a source; the last is added up inside numpy over cells of so many
terms and two tiles of sources, from which only sums by pair leave.

Defined cases: null texts, languages and sources are empty strings; a text without terms makes
its group occur; a very long text or term is worked whole; equal values are ordered by the
item's UTF-8 bytes; repeated rows and ids count row by row; an empty table gives an empty
result; columns other than the named ones are dropped.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import BROADCAST_ROWS, broadcast_if_small, join_hot, materialize, table

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Values are below 2 ** 30; bits that a histogram counts at once.
BITS, STEP = 30, 10
#: Distinct terms that a task holds before it hands them on.
HELD = 300_000
#: Terms and sources of a cell of the pairs.
CELL_TERMS, TILE = 4096, 64
#: Pairs of entries that a cell works on at once.
AT_ONCE = 1 << 20

# Bytes of terms, A to Z lower-cased; all others end a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, ASCII capitals lower-cased."""
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of a term in a group; a group occurs with an empty term too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: defaultdict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        within: defaultdict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                found[b""] += 0
                d = within[lang, source]
                keys = list(found)
                for i in range(0, len(keys), 50_000):
                    some = keys[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array([k.decode() for k in some], pa.string()),
                         pa.array([found[k] for k in some], pa.int64()), pa.array([d[k] for k in some], pa.int64())],
                        ["lang", "source", "term", "n", "d"],
                    )
            times.clear()
            within.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = terms(text.as_buffer().to_pybytes())
                found = times[lang, source]
                held -= len(found)
                found.update(words)
                held += len(found)
                within[lang, source].update(set(words))
                if held > HELD:
                    yield from handed()
                    held = 0
        yield from handed()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), F.encode(empty("text"), "utf-8").alias("text"))
    found = texts.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), in decimals, so that no count is too large."""
    top = (n.cast("decimal(20,0)") + 2) * F.lit(UNIT).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * 2
    return (F.call_function("div", top, under) + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """Shares of all kept terms; tables are written once and read by both parts."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        counts = term_counts(docs)
        found = counts.where("term <> ''")
        frequent = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("__d")).where(F.col("__d") >= least).drop("__d")
        kept = materialize(found.select("lang", "source", "term", "n").join(frequent, ["lang", "term"]))
        languages = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        v = materialize(kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v")))
        groups = counts.where("term = ''").select("lang", "source").join(languages, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["total", "v"])
        whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        #: lang, source, total, v, lang_total, p0 (share of a term it lacks; null if no term is kept), key: every occurring group.
        blank = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))
        key = F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")
        self.groups = materialize(groups.join(whole, "lang").withColumn("p0", blank).withColumn("key", key))
        self._sizes = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"))
        with_sizes = materialize(self.groups.join(self._sizes, ["lang", "source"]))
        keyed = kept.withColumn("key", key).drop("lang", "source")
        rows = join_hot(keyed, with_sizes, "key", "__n", with_sizes.agg(F.sum("__n")).first()[0] or 0)
        p = share(F.col("n"), F.col("total"), F.col("v"))
        #: key, lang, source, term, n, p (the group's), lang_n, lang_total, v: every kept term of a group.
        self.entries = materialize(rows.select("key", "lang", "source", "term", "n", p.alias("p"), "lang_n", "lang_total", "v"))

    def raised(self) -> DataFrame:
        """(key, lang, source, term, value): terms whose share is above their language's."""
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        rows = self.entries.select("key", "lang", "source", "term", "p", q.alias("q")).where("p > q")
        return rows.select("key", "lang", "source", "term", distance(F.col("p"), F.col("q")).alias("value"))


def _within(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` joined with one row a group: broadcast where a count proves it small, else hot groups alone are."""
    if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(chosen), "key")
    sizes = materialize(chosen.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")), "key"))
    return join_hot(rows, sizes, "key", "__n", rows.count())


def _bin_of_place(counts: DataFrame, descending: bool) -> DataFrame:
    """Of (key, need, bin, n): the bin in which the ``need``-th row stands, and what is needed of it.

    A group with fewer rows gives its last bin, whole.
    """
    order = F.col("bin").desc() if descending else F.col("bin").asc()
    so_far = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = counts.withColumn("__to", F.sum("n").over(so_far))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("bin").asc() if descending else F.col("bin").desc())) == 1
    here = (F.col("__to") - F.col("n") < F.col("need")) & ((F.col("__to") >= F.col("need")) | F.col("__last"))
    return ran.withColumn("__last", last).where(here).select("key", "bin", (F.col("need") - F.col("__to") + F.col("n")).alias("need"))


def top_by_radix(rows: DataFrame, item: str, value: str, k: int) -> DataFrame:
    """The ``k`` rows of each ``key`` with the highest values, equal ones by their item's bytes.

    ``rows`` should be materialized, its items distinct within a key and its values below 2 ** BITS.
    """
    high = None
    for shift in range(BITS - STEP, -1, -STEP):
        digit = F.expr(f"shiftright({value}, {shift})")
        if high is None:
            counts = rows.groupBy("key", digit.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("need", F.lit(k).cast("long"))
        else:
            inside = _within(rows, high).where(F.expr(f"shiftright({value}, {shift + STEP})") == F.col("bin"))
            counts = inside.groupBy("key", "need", digit.alias("__bin")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("__bin", "bin")
        high = materialize(_bin_of_place(counts, descending=True))
    # ``bin`` is now the value at the k-th place, ``need`` how many rows of just that value are wanted.
    met = materialize(_within(rows, high).where(F.col(value) >= F.col("bin")))
    above = met.where(F.col(value) > F.col("bin")).drop("bin", "need")
    tied, taken = met.where(F.col(value) == F.col("bin")).drop("bin"), [above]
    raw = F.encode(F.col(item), "utf-8")
    longest = met.agg(F.max(F.octet_length(item))).first()[0] or 0
    length = 4
    while True:
        # Groups whose ties are all wanted are done; of the others the byte prefix that holds the place goes on.
        sizes = tied.groupBy("key").agg(F.count(F.lit(1)).alias("__ties"))
        sized = materialize(_within(tied.withColumnRenamed("need", "__need"), sizes))
        done, open_ = sized.where("__ties <= __need"), sized.where("__ties > __need")
        taken.append(done.drop("__ties", "__need"))
        if length > 4 * max(longest, 1) or open_.isEmpty():
            break
        prefix = F.substring(raw, 1, length)
        counts = open_.groupBy("key", F.col("__need").alias("need"), prefix.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        place = materialize(_bin_of_place(counts, descending=False))
        both = _within(open_.drop("__ties", "__need"), place)
        taken.append(both.where(prefix < F.col("bin")).drop("bin", "need"))
        tied = both.where(prefix == F.col("bin")).drop("bin")
        length *= 2
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(audit: Audit) -> DataFrame:
    """(lang, source, item, value): every ordered pair of sources of a language."""
    groups = audit.groups.select("lang", "source", "p0", "v")
    # Each source's number within its language, for tiles.
    numbered = materialize(groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    held = broadcast_if_small(numbered.where("v > 0").select("lang", "source", "i", "p0"))
    entries = audit.entries.select("lang", "source", "term", "p").join(held, ["lang", "source"])
    # Terms of one side: what stands out of a source, by equal share.
    shares = materialize(entries.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("n")))
    tiles = numbered.where("v > 0").groupBy("lang").agg((F.floor(F.max("i") / TILE) + 1).alias("tiles"))
    tile = F.floor(F.col("i") / TILE)

    blocks = max(1, -(-audit.entries.select("lang", "term").distinct().count() // CELL_TERMS))
    cut = entries.join(broadcast_if_small(tiles), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).withColumn("tile", tile)
    # An entry goes to every cell that its tile is a side of, as left, right or both.
    sides = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b")))
    cells = cut.withColumn("cell", F.explode(sides)).select("lang", "block", F.col("cell.a").alias("a"), F.col("cell.b").alias("b"), "term", "i", "p", "p0")

    def common(part: pd.DataFrame) -> pd.DataFrame:
        lang, a, b = part["lang"].iloc[0], int(part["a"].iloc[0]), int(part["b"].iloc[0])
        term = pd.factorize(part["term"])[0]
        order = np.argsort(term, kind="stable")
        term, i, p, p0 = term[order], part["i"].to_numpy(np.int64)[order], part["p"].to_numpy(np.int64)[order], part["p0"].to_numpy(np.int64)[order]
        right = np.flatnonzero(i // TILE == b)
        left = np.flatnonzero(i // TILE == a)
        start, end = np.searchsorted(term[right], term[left], "left"), np.searchsorted(term[right], term[left], "right")
        sums: Counter[tuple[int, int]] = Counter()
        per = end - start
        at = np.concatenate(([0], np.cumsum(per)))
        low = 0
        while low < len(left):
            high = max(low + 1, int(np.searchsorted(at, at[low] + AT_ONCE, "right")) - 1)
            n = per[low:high]
            x = np.repeat(left[low:high], n)
            y = right[np.arange(at[high] - at[low]) - np.repeat(at[low:high] - at[low], n) + np.repeat(start[low:high], n)]
            keep = i[x] < i[y]
            x, y = x[keep], y[keep]
            value = _distances(p[x], p[y]) - _distances(p[x], p0[y]) - _distances(p0[x], p[y]) + _distances(p0[x], p0[y])
            pair = i[x] * (1 << 31) + i[y]
            which, where = np.unique(pair, return_inverse=True)
            total = np.zeros(len(which), np.int64)
            np.add.at(total, where, value)
            for k, t in zip(which.tolist(), total.tolist(), strict=True):
                sums[k >> 31, k & ((1 << 31) - 1)] += t
            low = high
        return pd.DataFrame({"lang": lang, "i": [k[0] for k in sums], "j": [k[1] for k in sums], "value": list(sums.values())}).astype({"i": "int64", "j": "int64", "value": "int64"})

    both = cells.groupBy("lang", "block", "a", "b").applyInPandas(common, "lang string, i long, j long, value long")
    both = both.groupBy("lang", "i", "j").agg(F.sum("value").alias("both"))
    both = both.unionByName(both.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "both"))

    # All ordered pairs of sources: these rows are the result's own.
    one = numbered.select("lang", "source", F.col("i").cast("long").alias("i"), "p0", "v")
    other = one.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("p0").alias("q0"))
    pairs = materialize(one.join(other, "lang").where("i <> j"))
    # Of one side: a term of share p against a source without it; by distinct (p, other source).
    f00 = distance(F.col("p0"), F.col("q0"))
    alone = pairs.where("v > 0").select("lang", "i", "j", "p0", "q0").join(shares.select("lang", F.col("i").cast("long").alias("i"), "p", "n"), ["lang", "i"])
    alone = alone.groupBy("lang", "i", "j").agg(F.sum(F.col("n") * (distance(F.col("p"), F.col("q0")) - f00)).alias("alone"))
    alone = materialize(alone)
    back = alone.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("alone").alias("back"))
    joined = pairs.join(alone, ["lang", "i", "j"], "left").join(back, ["lang", "i", "j"], "left").join(both, ["lang", "i", "j"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = F.when(F.col("v") > 0, F.col("v") * f00 + some("alone") + some("back") + some("both")).otherwise(0)
    return joined.select("lang", "source", "item", value.cast("long").alias("value"))


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and the terms that set a source apart."""
    audit = Audit(docs, least)
    raised = materialize(audit.raised())
    terms_ = top_by_radix(raised, "term", "value", top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = pair_sums(audit).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item")))
    return pairs.unionByName(terms_).withColumn("rank", rank)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(d) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::BIGINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
      LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS p,
      1 + {UNIT}::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}"""
