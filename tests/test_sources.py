import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import cut_lineage, shared_folder
from tallyward.sources import star, tables
from tallyward.sources.schema import account_schema, conform, event_schema
from tests.fixtures import account, accounts, event, events


def test_schema_mismatch_fails_early(spark):
    log = events(spark, event(1, 1, 0))
    assert conform(log, event_schema(T.LongType())).columns == event_schema().names
    with pytest.raises(ValueError, match="user_id"):
        conform(log, event_schema())
    with pytest.raises(ValueError, match="nothing"):
        conform(log.drop("ip"), event_schema(T.LongType()))
    people = accounts(spark, account(1))
    assert conform(people, account_schema(T.LongType())).count() == 1


def test_given_tables_are_checked_on_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, more string")
    rows.write.parquet(str(tmp_path / "labels.parquet"))
    assert star.table(spark, str(tmp_path), "labels").columns == ["doc_id", "quality", "toxic"]
    rows.withColumn("toxic", F.col("toxic").cast("string")).write.parquet(str(tmp_path / "other" / "labels.parquet"))
    with pytest.raises(ValueError, match="toxic: want int, have string"):
        star.table(spark, str(tmp_path / "other"), "labels")


def test_table_round_trip(spark, tmp_path):
    log = events(spark, event(1, 1, 0), event(2, 2, 9))
    tables.write_table(log, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), event_schema(T.LongType()))
    assert sorted(back.collect()) == sorted(log.collect())


def test_events_by_day_prune(spark, tmp_path):
    log = events(spark, *[event(i, i % 3, i * 3600) for i in range(72)])
    path = str(tmp_path / "log")
    tables.write_events_by_day(log, path)
    first = log.agg(F.min("ts")).first()[0]
    part = tables.read_events_between(spark, path, first + 3600, first + 86400 + 7200)
    assert sorted(r.event_id for r in part.collect()) == list(range(1, 26))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_account_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(events(spark, event(1, 1, 0), event(2, 2, 9)), path)
    from tallyward.operators.review import account_timeline

    plan = account_timeline(spark.read.parquet(path), 2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,2)" in plan and "prompt_text" not in plan


def test_metrics_of_missing_stages_are_absent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, v double")
    rows = tables.metric_rows(df, "rings", "size", "name", "v").unionByName(
        tables.metric_rows(df.agg(F.sum("v").alias("s")), "fusion", "total", None, "s")
    )
    folder = str(tmp_path / "m")
    tables.write_metrics(rows, folder)
    back = tables.read_metrics(spark, folder)
    assert sorted(map(tuple, back.collect())) == [
        ("fusion", "total", "", 3.5), ("rings", "size", "a", 1.5), ("rings", "size", "b", 2.0),
    ]
    assert back.filter("stage = 'tabular'").isEmpty()
    files = list((tmp_path / "m").rglob("*.json"))
    assert files and all(json.loads(line) for f in files for line in f.read_text().splitlines())


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10), "numbers")
    assert df.count() == 10
    assert all(f.startswith("file:") and shared_folder(spark) in f for f in df.inputFiles())
