"""From raw documents to packed sequences: five stages, each a DataFrame written and read again.

Counted as part of the subpackage eventloom.llm. All stages but the last return the columns
of ``documents``.

Defined cases, for every stage: a null text is empty, so it fails the quality rules; null
sources and languages count as values of their own; null doc_ids and repeated rows are kept
apart row by row, but of equal texts one row stays; very long texts are worked whole and only
cut by packing; ties are broken by doc_id and hashes of the text; empty tables give empty
tables; columns beside those of ``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm.common import clear_scratch, materialize, scratch_paths, table
from eventloom.llm.jaccard_join import one_of_each_group
from eventloom.llm.mixing import mixed_documents
from eventloom.llm.packing import pack_documents
from eventloom.llm.quality import keep_good
from eventloom.llm.secrets import mask_secrets

#: Intermediate tables of the stages that ran in this process.
_made: list[str] = []


def _stage(of: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage; before it runs, intermediate tables of earlier ones go, but for those that ``docs`` still reads.

    So a stage's result must be stored before the next stage begins, as the stages are meant to be run.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0].split("eventloom-")[-1] for f in docs.inputFiles()} if _made else set()
        clear_scratch(spark, [p for p in _made if p.split("eventloom-")[-1] not in read])
        _made[:] = [p for p in _made if p.split("eventloom-")[-1] in read]
        before = set(scratch_paths(spark))
        out = of(docs)
        _made.extend(p for p in scratch_paths(spark) if p not in before)
        return out

    run.__name__, run.__doc__ = of.__name__, of.__doc__
    return run


@_stage
def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return keep_good(docs)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of copies and near copies the document of least doc_id stays."""
    return one_of_each_group(docs)


@_stage
def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return mask_secrets(docs)


@_stage
def mixing(docs: DataFrame) -> DataFrame:
    """Sources are brought to their target words: documents go, stay or repeat."""
    return mixed_documents(docs)


@_stage
def packing(docs: DataFrame) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: Near duplicates, the splitting tree and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
