import os

import pytest

from tessera import registry

from .oracle import SMALL, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_oracle(spark, name):
    same(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["join_inner", "join_left", "join_right", "join_full", "cogroup"])
def test_some_query_takes_whole_tables(spark, name):
    q = {k: f for k, f in registry.queries().items() if k in (name, f"{name}_whole")}
    customers = {r[0] for r in spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey").collect()}
    orders = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect()}

    def whole(f):
        out = f(spark, SMALL).collect()
        if name == "cogroup":
            return {r.k for r in out} == customers | set(orders.values()) and {int(x) for r in out for x in r.v.split(",") if x} == set(orders)
        lone = set() if name in ("join_inner", "join_right") else customers - set(orders.values())
        strays = set() if name in ("join_inner", "join_left") else {k for k, c in orders.items() if c not in customers}
        met = {k for k, c in orders.items() if c in customers}
        return {r.c_custkey for r in out} - {None} == (customers & set(orders.values())) | lone and {r.o_orderkey for r in out} - {None} == met | strays

    assert any(whole(f) for f in q.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = list(e.queries()); assert n and not [x for x in n if x[:2] == 'op' or x == 'pipeline']; assert set(e.oracle_sql()) == set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
