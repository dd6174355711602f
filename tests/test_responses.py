"""Responses over small tables of orders."""

import datetime

import pytest
from pyspark.sql import functions as F

from linemetry.operators import instances as inst
from linemetry.plans import queries as q
from linemetry.plans import measuring as _  # noqa: F401  registers its queries


@pytest.fixture
def tables(spark, tmp_path):
    """write(orders: {key: [(line, quantity, price, discount, tax)]}), one customer, who has all."""

    def write(orders):
        day = datetime.datetime(2024, 1, 1)
        spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
        spark.createDataFrame([(k, 1, 1.0) for k in orders], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
        lines = [(k, *line, "N", day) for k, of in orders.items() for line in of]
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return write


def test_a_length_on_a_tie_is_rounded_half_to_even_whatever_the_order_of_its_sum(spark, tables):
    lines = ((79205.62, 0.01), (83298.81, 0.06), (36637.88, 0.04))  # 7255.5 in all, as doubles 7255.499999999999 in each order
    d = tables({8: [(i, 10.0, price, 0.05, tax) for i, (price, tax) in enumerate(lines)]})
    assert q.QUERIES["response_instances"](spark, d).first().length_mm == 7256.0


def test_equal_lines_are_paths_of_their_own(spark, tables):
    d = tables({8: [(1, 10.0, 700.0, 0.05, 0.02)] * 2 + [(2, 20.0, 70.0, 0.05, 0.0)], 9: [(1, 5.0, 7.0, 0.0, 0.01)]})
    found = {r.instance_id: r for r in q.QUERIES["response_instances"](spark, d).collect()}
    assert [(found[i].paths, found[i].points, found[i].at_junction_of_3, found[i].loops) for i in (0, 1)] == [(3, 9, 9, 1), (1, 3, 3, 0)]
    assert q.QUERIES["response_json"](spark, d).first().whole


@pytest.mark.parametrize("name", ["response_instances", "response_json"])
def test_order_lines_are_read_once(spark, tables, name):
    df = q.QUERIES[name](spark, tables({8: [(1, 10.0, 700.0, 0.05, 0.02)]}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sum(1 for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line) == 1


def test_figures_of_arrays_are_those_of_rows(spark):
    nan = float("nan")
    rows = [(1, 1, 4.0, 0.1, False), (1, 2, 2.0, None, False), (1, 3, 90.0, 0.1, True), (2, 1, 3.0, 0.0, True), (2, 2, None, 0.2, True), (3, 1, -1.0, 0.1, None), (3, 2, 5.0, 0.3, False), (4, 1, 1.0, 0.1, None), (5, 1, nan, 0.1, False), (5, 2, 7.0, 0.1, False)]
    samples = spark.createDataFrame(rows, "instance_id long, sample_id int, width_px double, mm_per_px double, at_junction boolean")
    arrays = samples.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "width_px", "mm_per_px", "at_junction"))).alias("samples"))
    text = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))
    assert text(inst.with_width_figures(arrays)) == text(inst.width_summary(samples))

    rows = [(1, 1, 5.0, 2.0, 10.0, 1.0), (1, 2, 5.0, 3.0, 20.0, 1.5), (1, 3, 4.0, None, 30.0, 2.0), (2, 1, None, 1.0, 5.0, 1.0), (2, 2, 3.0, 1.0, 6.0, 1.1), (3, 1, 2.0, -1.0, 7.0, 1.2)]
    paths = spark.createDataFrame(rows, "instance_id long, path_id int, length double, length_mm double, orientation double, tortuosity double")
    arrays = paths.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("path_id", "length", "length_mm", "orientation", "tortuosity"))).alias("path_rows"))
    assert text(inst.with_totals(arrays).drop("path_rows")) == text(inst.instance_totals(paths))
