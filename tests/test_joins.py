import pytest

from tessera.operators import joins
from tessera.plans.explain import explain, physical_nodes

from .conftest import rows


@pytest.fixture
def people(make):
    return make([(10, "oslo"), (20, "riga"), (30, "kiel")], "id:int name:string")


@pytest.fixture
def orders(make):
    return make([(20, "tern"), (20, "skua"), (10, "gull"), (50, "auk")], "id:int item:string")


@pytest.mark.parametrize("how,n", [("inner", 3), ("left", 4), ("right", 4), ("full", 5), ("left_semi", 2), ("left_anti", 1)])
@pytest.mark.parametrize("strategy", [None, "broadcast", "shuffle_hash", "sort_merge"])
def test_kinds_and_strategies(people, orders, how, n, strategy):
    out = joins.equi_join(people, orders, "id", how=how, strategy=strategy)
    assert out.count() == n
    assert out.columns == (["id", "name"] if "_" in how else ["id", "name", "id_2", "item"])


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("sort_merge", "SortMergeJoin")])
def test_strategy_is_planned(people, orders, strategy, node):
    j = joins.equi_join(people, orders, "id", strategy=strategy)
    assert node in physical_nodes(j)
    assert "Physical" in explain(j)


def test_adaptive_on_and_off_agree(spark, people, orders):
    out = []
    for on in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", on)
        out.append(rows(joins.equi_join(people.filter("id > 10 and id < 30"), orders, "id", how="full")))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out[0] == out[1] and len(out[0]) == 4


def test_names_three_deep(people):
    twice = joins.equi_join(people, people, "id")
    assert joins.equi_join(twice, people, "id").columns == ["id", "name", "id_2", "name_2", "id_3", "name_3"]


def test_null_keys_match_nothing(make):
    a, b = make([(20, "riga"), (None, "nowhere")], "id:int name:string"), make([(None, "lost"), (20, "skua")], "id:int item:string")
    for s in (None, "broadcast", "shuffle_hash", "sort_merge"):
        assert rows(joins.equi_join(a, b, "id", strategy=s).select("name", "item")) == [("riga", "skua")]


def test_hot_keys(make):
    a, b = (make([(i % 8, str(i)) for i in range(200)], "id:int v:string") for _ in range(2))
    assert joins.equi_join(a, b, "id").count() == 8 * 25 * 25


def test_theta_and_cross(make):
    buckets = make([(1, 4, "a"), (4, 9, "b"), (6, 7, "c"), (20, 21, "d")], "lo:int hi:int label:string")
    points = make([(2,), (8,), (3,)], "x:int")
    on = "lo <= x and x < hi"
    assert joins.theta_join(points, buckets, on).count() == 3
    assert joins.theta_join(buckets, points, on, "left").count() == 5
    assert joins.theta_join(buckets, points, on, "left_semi").columns == ["lo", "hi", "label"]
    assert joins.theta_join(buckets, points, on, "left_anti").count() == 2
    assert joins.theta_join(buckets, points, on, "full").count() == 5
    assert joins.theta_join(buckets, points, on, "cross").count() == 3
    assert joins.cross_join(buckets, points).count() == 12
    with pytest.raises(ValueError):
        joins.equi_join(buckets, points, ["lo", "hi"], ["x"])


def test_large_sides_are_not_broadcast(people, orders, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 1)
    spark = people.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in physical_nodes(joins.equi_join(people, orders, "id", strategy="broadcast"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
