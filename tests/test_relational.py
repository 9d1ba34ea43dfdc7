import math

import pytest
from pyspark.sql import functions as F

from tessera import add, avg, col, count, divide, max_, min_, multiply, sum_
from tessera.operators import aggregate, relational
from tessera.types import create_dataframe

from .conftest import rows

SHIPS = [("tern", 12, "oslo"), ("skua", 31, "riga"), ("gull", 7, "oslo"), ("auk", 55, "kiel"), ("ibis", 31, None)]
LOADS = [("oak", "n", 4), ("oak", "s", 9), ("elm", "n", 1), ("oak", "n", 2), ("elm", "s", 8), ("elm", "s", 8)]


@pytest.fixture
def ships(make):
    return make(SHIPS, "name:string age:int port:string")


@pytest.fixture
def loads(make):
    return make(LOADS, "wood:string hold:string tons:int")


def test_projection_and_filter(ships):
    assert rows(relational.where(ships, col("age") >= 31).select("name")) == [("auk",), ("ibis",), ("skua",)]
    assert relational.select(ships, "port", "age").columns == ["port", "age"]
    for out in (ships.select(add(col("age"), 1, ships)), ships.select(add(col("age"), 1))):
        assert out.columns == ["age + 1"] and out.dtypes[0][1] == "bigint"
        assert sorted(r[0] for r in out.collect()) == [8, 13, 32, 32, 56]
    with pytest.raises(Exception, match="nope"):
        ships.select("nope")


def test_filter_sees_the_projected_name(ships):
    shadow = ships.select((col("age") + 1).alias("age"))
    assert shadow.filter("age = 32").count() == 2


def test_aggregates_and_names(loads):
    out = aggregate.group_agg(loads, ["wood"], sum_("tons"), avg("tons"), count(), min_("tons"), max_("tons"))
    assert out.columns == ["wood", "sum(tons)", "avg(tons)", "count(*)", "min(tons)", "max(tons)"]
    assert rows(out) == [("elm", 17, 17 / 3, 3, 1, 8), ("oak", 15, 5.0, 3, 2, 9)]
    assert dict(out.dtypes)["sum(tons)"] == "bigint"
    assert aggregate.group_count(loads, "wood").columns == ["wood", "count(*)"]
    assert rows(aggregate.group_agg(loads, ["wood"], sum_("tons").alias("s"), having="s > 15")) == [("elm", 17)]


def test_empty_input_and_null_groups(make):
    empty = make([], "k:int v:int")
    assert rows(aggregate.group_agg(empty, [], count().alias("n"), sum_("v").alias("s"))) == [(0, None)]
    assert rows(aggregate.group_agg(empty, ["k"], count().alias("n"))) == []
    assert rows(aggregate.group_count(make([(None, 1), (None, 2), (1, 3)], "k:int v:int"), "k")) == [(1, 1), (None, 2)]


def test_exact_sums_above_2_to_53(make):
    assert make([(2**53,), (1,)], "v:long").agg(F.sum("v")).first()[0] == 2**53 + 1


@pytest.mark.parametrize("a,b,want", [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan), (1.0, 4.0, 0.25), (None, 0.0, None), (1.0, None, None), (1.0, -0.0, -math.inf), (-1.0, -0.0, math.inf), (0.0, -0.0, math.nan)])
def test_division(make, a, b, want):
    got = make([(a, b)], "a:double b:double").select(divide(col("a"), col("b"))).first()[0]
    assert (math.isnan(got) if isinstance(want, float) and math.isnan(want) else got == want)


def test_overflow_is_an_error(make):
    df = make([(2**62,)], "v:long")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.select(multiply(col("v"), 4, df)).collect()


def test_whole_numbers_widen_without_a_table(make):
    df = make([(2**31 - 1, 2.5, -0.0)], "i:int d:double z:double")
    out = df.select(add(col("i"), col("i")).alias("a"), multiply(col("i"), 4).alias("m"), add(col("d"), 1).alias("d"), multiply(col("z"), 1).alias("z"))
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "double", "double"]
    r = out.first()
    assert (r.a, r.m, r.d) == (2**32 - 2, 2**33 - 4, 3.5) and math.copysign(1, r.z) == -1


def test_sort_limit_distinct(make, loads):
    df = make([(r[0], r[1]) for r in SHIPS], "name:string age:int")
    assert [r.age for r in relational.order_by(df, "age").collect()] == [7, 12, 31, 31, 55]
    assert [r.name for r in relational.order_by(df, ("age", "asc"), ("name", "desc")).collect()] == ["gull", "tern", "skua", "ibis", "auk"]
    assert [r.age for r in relational.top_n(df, 2, ("age", "desc")).collect()] == [55, 31]
    nulls = make([(None,), (1,)], "v:int")
    assert [r.v for r in relational.order_by(nulls, ("v", "asc")).collect()] == [None, 1]
    assert [r.v for r in relational.order_by(nulls, ("v", "desc")).collect()] == [1, None]
    assert relational.distinct(loads.select("wood")).count() == 2


@pytest.mark.parametrize("row", [("x", "1", None), ("x",), (1, 2, 3), ("x", 2**31, "y"), ("x", True, "y")])
def test_rows_are_checked_at_once(spark, row):
    with pytest.raises(ValueError):
        create_dataframe(spark, [row], [("a", "string"), ("b", "int"), ("c", "string")])


def test_user_aggregate(spark, make):
    from tessera.functions.aggregates import user_aggregate

    longest = user_aggregate(lambda: "", lambda b, v: max(b, v, key=len), lambda a, b: max(a, b, key=len), len, "long")
    df = make([(None, "a"), (None, "bbb"), ("k", "cc")], "k:string v:string").repartition(3)
    assert rows(longest(df, ["k"], "v", "n")) == [("k", 2), (None, 3)]


def test_user_aggregates_beside_built_in_ones(make):
    from tessera.functions.aggregates import user_aggregate

    total = user_aggregate(lambda: 0, lambda b, v: b + (v or 0), lambda a, b: a + b, lambda b: b, "bigint")
    seen = user_aggregate(lambda: (), lambda b, v: (*b, v), lambda a, b: a + b, lambda b: str(sorted(b, key=repr)), "string")
    df = make([(2**53, 1), (2**53 + 1, None), (None, 3), (2**53 + 1, 5), (None, 4)], "k:long v:int").repartition(4)
    out = aggregate.group_agg(df, ["k"], count().alias("n"), total.of("v").alias("t"), max_("v"), seen.of("v"))
    assert out.columns == ["k", "n", "t", "max(v)", "user(v)"]
    assert rows(out) == [(2**53, 1, 1, 1, "[1]"), (2**53 + 1, 2, 5, 5, "[5, None]"), (None, 2, 7, 4, "[3, 4]")]
    assert rows(aggregate.group_agg(df, [], total.of("v").alias("t"), count().alias("n"))) == [(13, 5)]
    assert rows(total(df.limit(0), [], "v", "t")) == [(0,)] and rows(total(df.limit(0), ["k"], "v", "t")) == []
    assert rows(aggregate.group_agg(df, ["k"], total.of("v").alias("t"), having="t > 5")) == [(None, 7)]
    zeros = make([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4)], "k:double v:int").repartition(4)
    assert sorted(r.t for r in total(zeros, ["k"], "v", "t").collect()) == [3, 7]
