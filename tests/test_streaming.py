"""Group status over a stream: late and incomplete groups, resumption, batches that do not matter."""

from __future__ import annotations

from datetime import timedelta

import pytest

from cohort_spark.core import ContractError
from cohort_spark.streaming import status as S

ROWS = "g string, m string, n int, t timestamp"


def run(spark, root, batches, **options):
    """The batches as runs of one resumed stream; the reports in the order of the runs."""
    seen, out = set(), []
    options = {"late": "12 hours", "wait": timedelta(days=3), "keep": timedelta(days=60), **options}
    with S.state_store(spark):
        for batch in batches:
            rows = spark.createDataFrame(batch, "g string, m string, n int, t string").selectExpr("g", "m", "n", "cast(t AS timestamp) AS t")
            rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
            found = S.group_status(spark.readStream.schema(ROWS).parquet(f"{root}/in"), group=["g"], member="m", expected="n", event_time="t", **options)
            query = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            now = {(r.g, r.status, r.found, r.expected) for r in spark.read.parquet(f"{root}/out").collect()}
            assert spark.read.parquet(f"{root}/out").count() == len(now)
            out.append(sorted(now - seen))
            seen |= now
    return out


def test_batches_in_order_end_like_one_batch(spark, tmp_path):
    first = [("a", "1", 3, "2020-01-01"), ("a", "2", None, "2020-01-01"), ("b", "1", 2, "2020-01-01"), (None, "1", 1, "2020-01-01")]
    second = [("a", "3", 3, "2020-01-02"), ("a", "3", 3, "2020-01-02"), ("c", "1", 1, "2020-01-02"), ("d", None, 2, "2020-01-02")]
    third = [("b", "2", 2, "2020-01-03"), ("e", "1", None, "2020-01-03"), ("z", "1", 1, "2020-02-10")]
    batches = run(spark, tmp_path / "three", [first, second, third])
    assert batches[0] == [(None, "complete", 1, 1)]
    one = run(spark, tmp_path / "one", [first + second + third])
    assert sorted(sum(batches, []), key=repr) == sorted(one[0], key=repr)
    assert ("d", "incomplete", 0, 2) in one[0] and ("e", "incomplete", 1, None) in one[0]


def test_late_and_incomplete_groups_are_reported_once(spark, tmp_path):
    first = [("b", "1", 2, "2020-01-01"), ("c", "1", 1, "2020-01-01"), ("z", "1", 1, "2020-01-10")]
    second = [("b", "2", 2, "2020-01-11"), ("c", "9", 1, "2020-01-11")]
    third = [("b", "3", 2, "2020-01-12"), ("b", "1", 2, "2020-01-02"), ("z", "2", 1, "2020-01-12")]
    batches = run(spark, tmp_path, [first, second, third])
    assert batches == [[("b", "incomplete", 1, 2), ("c", "complete", 1, 1), ("z", "complete", 1, 1)], [("b", "late", 2, 2)], []]


def test_status_columns_may_not_be_groups(spark):
    rows = spark.createDataFrame([], "status string, m string, n int, t timestamp")
    with pytest.raises(ContractError, match="status"):
        S.group_status(rows, group=["status"], member="m", expected="n", event_time="t")
