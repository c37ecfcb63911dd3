"""Token counts: pieces counted once a distinct pre-token, joined to per-document pre-token frequencies.

The first pass over the documents finds the distinct pre-tokens and how often each occurs
(added up inside a task before the exchange), and the library counts the pieces of each of
them once. The second pass makes the documents' pre-token frequencies. The most frequent
pre-tokens, a fixed number of bounded size, are broadcast and joined inside the tasks; the
others are joined by an exchange. A pre-token of more than 24 characters is known by a 128-bit
hash of it, so a long one that is frequent is broadcast like any other and none of the others
can be hot. No ids are materialised.

Defined cases: a null text is empty and has no tokens; a very long text is counted whole, in
one task; frequencies tie at random without effect on counts; repeated rows are counted one
by one; an empty table gives an empty result; columns other than the named ones are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, table, text_or_empty
from eventloom.llm.pretokens import pretokens, token_counts, vocabulary_path

LIMIT = 2048
#: What is broadcast: at most so many pre-tokens, each as itself or as a hash of 33 characters.
BROADCAST_PRETOKENS = 150_000
#: Characters of a pre-token that is its own key.
KEY_CHARS = 24
#: Distinct pre-tokens that a task of the first pass holds before it hands them on.
HELD = 300_000


def key_of(pretoken: str) -> str:
    """No pre-token holds U+0000 beside hexadecimal digits alone: it is a control character, which splits."""
    return pretoken if len(pretoken) <= KEY_CHARS else "\0" + xxhash.xxh3_128_hexdigest(pretoken.encode())


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """(pretoken, freq, pieces), one row a distinct pre-token of the corpus, by its key."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            long = [w if len(w) > KEY_CHARS else None for w in held]
            out = pa.RecordBatch.from_pydict({"pretoken": pa.array(map(key_of, held), pa.string()), "whole": pa.array(long, pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(pretokens(text.as_py(), path))
                if len(held) > HELD:
                    yield handed()
        yield handed()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            words = [w if k is None else k for w, k in zip(part["pretoken"], part["whole"], strict=True)]
            yield pd.DataFrame({"pretoken": part["pretoken"], "freq": part["freq"], "pieces": token_counts(words, path)})

    found = texts.select("text").mapInArrow(distinct, "pretoken string, whole string, n long")
    found = found.groupBy("pretoken", "whole").agg(F.sum("n").alias("freq"))
    return materialize(found.mapInPandas(count, "pretoken string, freq long, pieces int"))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most so many pre-tokens: all above a frequency that a histogram of eighth powers
    of two gives, so that nothing is sorted and no more than these come to the driver."""
    levels = words.withColumn("level", F.floor(F.log2("freq") * 8))
    counts = sorted(((r["level"], r["count"]) for r in levels.groupBy("level").count().collect()), reverse=True)
    least, n = None, 0
    for level, count in counts:
        n += count
        if n > most:
            break
        least = level
    return levels.where(F.lit(False) if least is None else F.col("level") >= least).select("pretoken", "pieces")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row a document."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    words = vocabulary(texts, path)
    common = most_frequent(words, BROADCAST_PRETOKENS).toPandas()
    known = spark.sparkContext.broadcast(dict(zip(common["pretoken"], common["pieces"].tolist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known.value
        for batch in batches:
            n_bytes, n_known, rare, times = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                n_bytes.append(len(text.encode()))
                freq = {key_of(w): n for w, n in Counter(pretokens(text, path)).items()}
                other = {w: n for w, n in freq.items() if w not in have}
                n_known.append(sum(have[w] * n for w, n in freq.items() if w in have))
                rare.append(list(other))
                times.append(list(other.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "known", "rare", "times"],
            )

    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, known long, rare array<string>, times array<long>"
    each = materialize(texts.mapInArrow(frequencies, schema)).withColumn("row", F.monotonically_increasing_id())
    rare = each.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("pretoken"), F.col("x.times").alias("n"))
    more = rare.join(words.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    counted = each.drop("rare", "times").join(more, "row", "left").withColumn("n_tokens", n_tokens.cast("long"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
