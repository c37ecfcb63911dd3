"""How often a plan deals its rows out anew."""

import pytest

from eventloom.operators import review
from eventloom.plans import fixtures, queries
from eventloom.sources.run_folders import read_run_folder, write_run_folder

SF = "/root/testdata/sf0.001"


def _dealt(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["slices", "review_consensus", "disagreements", "event_notes"])
def test_scores_deal_out_orders_and_lineitems_once(spark, name):
    assert _dealt(queries.QUERIES[name](spark, SF)) <= 2


def test_review_texts_deal_out_orders_and_lineitems_once(spark):
    assert _dealt(review.review_blocks(queries._two_models(spark, SF), ["p7", "p3"])) <= 2


def test_run_folders_hold_compressed_records(spark, tmp_path):
    runs = fixtures.run_records(spark, SF)
    assert _dealt(runs) <= 2
    write_run_folder(str(tmp_path / "run"), runs, {}, {}, runs.groupBy("model").count())
    size = sum(p.stat().st_size for p in (tmp_path / "run" / "runs.jsonl").glob("part-*"))
    records = read_run_folder(spark, str(tmp_path / "run"))[1]
    assert records.count() == 6000 and size < 150 * 6000
