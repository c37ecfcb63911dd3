"""URL filters as a sort-merge range join.

The key of a host is its labels in reverse, each closed by a dot, so a host and all its
subdomains are one interval of the sorted keys, and rules' hosts nest. URLs and rules are
dealt out by ranges of keys (range bounds are keys of the table) and sorted; a rule goes to
each range that its interval meets. A task sweeps its rows once and keeps the rules whose
interval it is in on a stack; a host's path rules are looked up by their lengths.

A rule fits its host and all subdomains where the path starts with the rule's; of several,
the longest host wins and then the longest path. Without a rule the verdict is ``allow``.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no
rule (but for a rule of the empty host); repeated rows are judged one by one; an empty table
gives an empty result; of two rules with one host and path the first by text stays; columns
other than the named ones are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import blocks_for, parallelism, table

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT = "allow"
ROWS_PER_RANGE = 100_000
MOST_RANGES = 20_000
#: Characters of a key that range bounds have; longer keys fall into the range of their start.
BOUND_CHARS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def _after(key: str) -> str:
    """The least string above all that start with ``key``, which ends with a dot."""
    return key[:-1] + "/"


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], default: str = DEFAULT, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``keep``, host, path, rule and verdict; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession

    @F.pandas_udf("string")
    def key_of(host: pd.Series) -> pd.Series:
        return host.map(host_key)

    host, path = host_and_path(F.col("url"))
    urls = pages.select(*keep, host.alias("host"), path.alias("path"))
    n_rows = urls.count()
    n = min(MOST_RANGES, blocks_for(n_rows, rows_per_range))
    bounds: list[str] = []
    if n > 1:
        # Strings have no percentile_approx: bounds are every so many of a sample's sorted keys. They only balance the tasks.
        few = urls.sample(min(1.0, 64 * n / n_rows), seed=1).select(F.substring(key_of("host"), 1, BOUND_CHARS).alias("k")).limit(256 * n)
        some = sorted(r["k"] for r in few.collect())
        bounds = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k)).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: list(range(bisect_right(bounds, k), bisect_left(bounds, _after(k)) + 1)))

    keyed = urls.withColumn("__key", key_of("host")).withColumn("__range", range_of("__key"))
    ruled = rules.where("host is not null and path is not null").select("host", "path", "verdict", key_of("host").alias("__key"))
    ruled = ruled.withColumn("__range", F.explode(ranges_of("__key")))
    kinds = dict(urls.dtypes)
    both = keyed.withColumn("__rule", F.lit(None).cast("string")).unionByName(
        ruled.select(*(F.lit(None).cast(kinds[c]).alias(c) for c in keep), "host", "path", "__key", "__range", F.col("verdict").alias("__rule"))
    )
    # Hot hosts (a third of all rows) are spread by a salt; the rules go to each part.
    salts = max(1, min(64, n))
    salt = F.when(F.col("__rule").isNull(), F.array(F.pmod(F.xxhash64("path", *keep), F.lit(salts)))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    both = both.withColumn("__salt", F.explode(salt))
    dealt = both.repartition(parallelism(spark, n_rows, rows_per_range), "__range", "__salt")
    dealt = dealt.sortWithinPartitions("__range", "__salt", "__key", F.col("__rule").isNull(), "path", "__rule")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple[int, int] | None = None
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []
        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c not in keep}
            stays, found, verdicts = [], [], []
            for k, key in enumerate(columns["__key"]):
                now = (columns["__range"][k], columns["__salt"][k])
                if now != part:
                    part, stack = now, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                path, verdict = columns["path"][k], columns["__rule"][k]
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, columns["host"][k], {}, []))
                    _, _, paths, lengths = stack[-1]
                    if path not in paths:
                        paths[path] = verdict
                        if len(path) not in lengths:
                            lengths.append(len(path))
                            lengths.sort(reverse=True)
                    continue
                stays.append(k)
                hit = next(((h, path[:n], p[path[:n]]) for _, h, p, ls in reversed(stack) for n in ls if path[:n] in p and n <= len(path)), None)
                found.append(None if hit is None else hit[0] + hit[1])
                verdicts.append(default if hit is None else hit[2])
            if stays:
                kept = batch.take(pa.array(stays))
                own = [kept.column(c) for c in [*keep, "host", "path"]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], [*keep, "host", "path", "rule", "verdict"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", host string, path string, rule string, verdict string"
    return dealt.mapInArrow(sweep, schema)


def op9_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, ["page_id"])


OP9_SQL = """
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), u AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT p.rid, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.rid = f.rid AND f.k = 1
"""
