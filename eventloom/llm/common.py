"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of ``documents``; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Largest table, in rows, that any operator here broadcasts.
BROADCAST_ROWS = 100_000
#: Most keys that ``join_hot`` broadcasts.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that this process wrote, by application.
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors share.

    Where the setting is unset on one machine, as in tests, a temporary folder takes its place;
    on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/eventloom-{uuid.uuid4().hex}"


def kept_scratch(spark: SparkSession) -> str:
    """A fresh path that ``clear_scratch`` deletes."""
    path = scratch_dir(spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: whatever is built on the result survives a lost executor without
    running the scan below again, and columns that are not used are not read.
    """
    spark = df.sparkSession
    path = kept_scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_paths(spark: SparkSession) -> list[str]:
    """What ``materialize`` and ``kept_scratch`` gave out for this application and still stands, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete ``paths``, or all of ``scratch_paths``, once what is built on them is stored; how many."""
    standing = _written.setdefault(spark.sparkContext.applicationId, [])
    jvm, gone = spark.sparkContext._jvm, list(standing) if paths is None else [p for p in paths if p in standing]
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        standing.remove(path)
    return len(gone)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count proves the side small; else Spark shuffles."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def join_hot(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, one row a ``key`` with its number of rows as ``weight``.

    Keys with at least a thousandth of the ``total`` are broadcast: as weights sum to the total,
    there are no more than HOT_KEYS of them. So a key with a third of all rows stays where its
    rows are. Both sides should be materialized: ``rows`` is read twice.
    """
    is_hot = F.col(weight) * HOT_KEYS >= F.lit(total)
    hot, cold = values.where(is_hot).drop(weight), values.where(~is_hot).drop(weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def split_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D, as an array."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def count_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def blocks_for(n_rows: int, rows_per_block: int) -> int:
    return max(1, -(-n_rows // rows_per_block))


def running_sums(df: DataFrame, group: list[str], block: str, order: list[str], values: list[str]) -> DataFrame:
    """Add ``<value>_before``: the sum of a value over all earlier rows of the row's group.

    The order within a group is (``block``, ``order``). No window holds more than one block
    of one group, so a group with a third of all rows is summed by many tasks; a group's
    blocks, one row each, then meet to get their starts. ``group`` and ``block`` must not be
    null, and ``df`` should be materialized: it is read twice.
    """
    blocks = df.groupBy(*group, block).agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    by_group = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = blocks.select(
        *group, block, *((F.sum(f"__t_{v}").over(by_group) - F.col(f"__t_{v}")).alias(f"__s_{v}") for v in values)
    )
    in_block = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumns({f"__w_{v}": F.sum(v).over(in_block) - F.col(v) for v in values})
    joined = placed.join(starts, [*group, block])
    return joined.select(
        *[joined[c] for c in df.columns],
        *((F.col(f"__w_{v}") + F.col(f"__s_{v}")).cast("long").alias(f"{v}_before") for v in values),
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the place (from 0) in a total order, by ranges: no task sorts the whole table."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("__part", (F.sum("__n").over(earlier) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = ranged.withColumn("__inside", inside).join(starts, "__part")
    return ranked.select(*df.columns, (F.col("__inside") + F.col("__start")).cast("long").alias(name))


def parallelism(spark: SparkSession, n_rows: int, rows_per_task: int) -> int:
    """Partitions for an exchange of small rows: as many as the rows ask for, no fewer than the setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(n_rows, rows_per_task))
