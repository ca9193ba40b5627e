"""The physical plans are the ones meant."""

import pytest

from conftest import SF
from quillstone.operators import evidence as ev, graph, temporal
from quillstone.sources import adapters


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "evidence")
    adapters.evidence(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    p = plan(ev.newest(ev.select(stored, type="click", since="2024-01-05", session_id="s", subject_id="t1"), 10).select("id", "at"))
    for part in ("EqualTo(type,click)", "GreaterThanOrEqual(at,2024-01-05)", "EqualTo(session_id,s)", "EqualTo(subject.ref_id,t1)", "TakeOrderedAndProject(limit=10"):
        assert part in p
    assert "body" not in p and "tags" not in p and "Exchange" not in p


def test_cursors_reach_the_scan(stored):
    p = plan(stored.where(ev.after_cursor("2024-01-15", "e-5")))
    assert "Or(LessThan(at,2024-01-15),And(EqualTo(at,2024-01-15),LessThan(id,e-5)))" in p


def test_counts_read_no_other_columns(stored):
    p = plan(ev.count(stored, type="error"))
    assert "ReadSchema: struct<type:string>" in p


def test_as_of_is_one_aggregation(spark):
    p = plan(temporal.as_of(adapters.order_log(spark, SF).where("op = 'put'"), "1998-01-01 00:00:00"))
    assert p.count("Exchange") == 1 and "Window" not in p and "partial_max_by" in p


def test_unused_windows_are_pruned(spark):
    assert "Window" not in plan(ev.count(adapters.evidence(spark, SF), type="error"))


def test_semi_joins_carry_ids_alone(spark):
    p = plan(graph.hydrate(adapters.relations(spark, SF).where("type = 'geo/in-region'"), adapters.entities(spark, SF)))
    assert "LeftSemi" in p and "o_orderdate" not in p
