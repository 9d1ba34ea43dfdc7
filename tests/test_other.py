import threading

import pytest

from tessera import session, shared
from tessera.operators import keyed, pyfunc, windows
from tessera.plans import sqlfront
from tessera.sources import files
from tessera.streaming import each_batch

from .conftest import rows

BOATS = [("red", "tern", 41), ("red", "skua", 55), ("red", "gull", 41), ("red", "auk", 12), ("red", "ibis", 12), ("blue", "crane", None), ("blue", "heron", 7)]


def test_ranks(make):
    df = make(BOATS, "fleet:string name:string length:int")
    spec = windows.partition_by("fleet").order_by_desc("length")
    out = df.select("name", windows.rank(spec).alias("r"), windows.dense_rank(spec).alias("d"), windows.row_number(windows.order_by("length", "name")).alias("n"))
    got = {r.name: (r.r, r.d) for r in out.collect()}
    assert got == {"skua": (1, 1), "tern": (2, 2), "gull": (2, 2), "auk": (4, 3), "ibis": (4, 3), "heron": (1, 1), "crane": (2, 2)}
    assert [t for _, t in out.dtypes[1:]] == ["bigint"] * 3
    assert [r.name for r in sorted(out.collect(), key=lambda r: r.n)] == ["crane", "heron", "auk", "ibis", "gull", "tern", "skua"]


def test_user_windows(make):
    df = make([("a", 3, 2**53 + 1), ("a", None, 2**53), ("a", 1, None), (None, 5, 1), (None, 4, 2)], "k:string o:int v:long").repartition(3)
    seen = lambda rows: [str([x.v for x in rows[: i + 1]]) for i in range(len(rows))]
    up = windows.user_window(df, windows.partition_by("k").order_by("o"), "s", "string", seen)
    assert {(r.k, r.o): r.s for r in up.collect()} == {("a", None): f"[{2**53}]", ("a", 1): f"[{2**53}, None]", ("a", 3): f"[{2**53}, None, {2**53 + 1}]", (None, 4): "[2]", (None, 5): "[2, 1]"}
    down = windows.user_window(df, windows.partition_by("k").order_by_desc("o"), "n", "bigint", lambda rows: range(len(rows)))
    assert {(r.k, r.o): r.n for r in down.collect()} == {("a", 3): 0, ("a", 1): 1, ("a", None): 2, (None, 5): 0, (None, 4): 1}
    whole = windows.user_window(df, windows.order_by("v"), "n", "int", lambda rows: [len(rows)] * len(rows))
    assert [r.n for r in whole.collect()] == [5] * 5 and up.columns == ["k", "o", "v", "s"]
    assert windows.user_window(df.limit(0), windows.partition_by("k"), "n", "int", len).count() == 0


def test_global_row_number(make):
    df = make([(i * 7 % 101, None if i % 10 == 0 else "x") for i in range(101)], "v:int s:string").repartition(5)
    out = windows.global_row_number(df, "v", name="n").collect()
    assert {r.v: r.n for r in out} == {v: v + 1 for v in range(101)}
    assert windows.global_row_number(df.limit(0), "v").count() == 0


def test_keyed(spark, make):
    p = make([("a", 1), ("b", 2), ("a", 3), ("a", 4), ("b", 5)], "k:string v:int")
    assert rows(keyed.reduce_by_key(p)) == [("a", 8), ("b", 7)]
    assert rows(keyed.group_by_key(p)) == [("a", [1, 3, 4]), ("b", [2, 5])]
    x, y = make([("x", 1), ("x", 2), ("y", 3)], "k:string v:int"), make([("x", 10), ("z", 20)], "k:string v:int")
    assert rows(keyed.cogroup(x, y)) == [("x", [1, 2], [10]), ("y", [3], []), ("z", [], [20])]
    assert rows(keyed.join(x, y)) == [("x", 1, 10), ("x", 2, 10)]
    assert [r.k for r in keyed.sort_by_key(p, 2).collect()] == ["a", "a", "a", "b", "b"]
    assert [r.v for r in keyed.take_ordered(p, 2, "v")] == [1, 2]
    a, b = spark.sparkContext.parallelize(range(6), 2), spark.sparkContext.parallelize(range(10, 16), 2)
    assert sorted(keyed.zip_partitions(a, b, lambda i, j: zip(i, j)).collect()) == [(k, k + 10) for k in range(6)]
    with pytest.raises(ValueError):
        keyed.zip_partitions(a, spark.sparkContext.parallelize(range(3), 3), zip)


def test_python_functions(make):
    df = make([(1, "a b"), (2, "c")], "id:int s:string")
    assert rows(pyfunc.py_map(df, lambda r: (r.id * r.id,), "x long")) == [(1,), (4,)]
    assert rows(pyfunc.py_filter(df, lambda r: r.id > 1)) == [(2, "c")]
    assert rows(pyfunc.py_flat_map(df, lambda r: [(w,) for w in r.s.split()], "w string")) == [("a",), ("b",), ("c",)]
    assert rows(pyfunc.py_reduce_by_key(make([("a", 1), ("a", 3), ("b", 2)], "k:string v:long"), "k", "v", lambda a, b: a + b, 0, "long")) == [("a", 4), ("b", 2)]
    assert sorted(r.n for r in pyfunc.map_partitions(make([(i,) for i in range(10)], "v:int").repartition(3), lambda it: [(sum(1 for _ in it),)], "n int").collect() if r.n) and sum(r.n for r in pyfunc.map_partitions(df, lambda it: [(sum(1 for _ in it),)], "n int").collect()) == 2


BIG = [(2**53 + 1, "x"), (2**53, None), (None, "z")]


def test_python_functions_see_whole_numbers_and_none(make):
    df = make(BIG, "v:long s:string").repartition(1)
    assert rows(pyfunc.py_map(df, lambda r: (r.v, r.s), "v long, s string")) == sorted(BIG, key=repr)
    assert rows(pyfunc.py_map(df, lambda r: (type(r.v).__name__ + type(r.s).__name__,), "t string")) == [("NoneTypestr",), ("intNoneType",), ("intstr",)]
    assert rows(pyfunc.py_filter(df, lambda r: r.v is None or r.v % 2 == 1)) == sorted([BIG[0], BIG[2]], key=repr)
    assert rows(pyfunc.py_flat_map(df, lambda r: [(r.v,)] * 2, "v long")) == sorted([(v,) for v, _ in BIG] * 2, key=repr)
    got = pyfunc.py_reduce_by_key(make([(2**53, 1), (2**53 + 1, 2), (None, 3), (None, None), (2**53, 4)], "k:long v:long"), "k", "v", lambda a, b: a + (b or 0), 0, "long")
    assert rows(got) == [(2**53, 5), (2**53 + 1, 2), (None, 3)]
    assert rows(pyfunc.py_map(df.limit(0), lambda r: (1,), "x int")) == []
    dotted = df.toDF("a.b", "s")
    assert pyfunc.py_filter(dotted, lambda r: r[0] is None).columns == ["a.b", "s"] and pyfunc.py_map(dotted, lambda r: (r[0],), "x long").count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text('port,depth,fee\noslo,14,2.25\nriga , 9,7\n"say ""hi"", all",deep,1.0,more\nlone\n\n')
    df = files.read_csv(spark, str(tmp_path / "h.csv"), "port string, depth int, fee double", header=True)
    assert rows(df) == [("lone", None, None), ("oslo", 14, 2.25), ("riga", 9, 7.0), ('say "hi", all', None, 1.0)]
    (tmp_path / "n.csv").write_text("oslo,14\nriga,9\n")
    assert files.read_csv(spark, str(tmp_path / "n.csv")).columns == ["c0", "c1"]
    assert dict(files.read_csv(spark, str(tmp_path / "n.csv"), inferSchema=True).dtypes)["c1"] == "int"
    with pytest.raises(ValueError):
        files.read_csv(spark, "x", nonsense=1)


def test_round_trips(spark, make, tmp_path):
    df = make([("oslo", 3), ('a "b", c', 8), (None, 5)], "port:string n:int")
    files.write_csv(df, str(tmp_path / "c"), header=True)
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "port string, n int", header=True)) == rows(df)
    files.write_json(df, str(tmp_path / "j"))
    assert rows(files.read_json(spark, str(tmp_path / "j"), df.schema)) == rows(df)
    files.write_text(df, str(tmp_path / "t"), "n")
    assert sorted(r[0] for r in files.read_text(spark, str(tmp_path / "t")).collect()) == ["3", "5", "8"]
    assert files.text_rdd(spark, str(tmp_path / "t"), 2).count() == 3


def test_json_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"port":"oslo","depth":14,"fee":1}\n{"port":"riga","depth":7000000000,"fee":0.5,"none":null}\nnot json\n[1]\n{"open":true,"port":3}\n')
    s = files.infer_json_schema(spark, str(tmp_path / "a.json"))
    assert [(f.name, f.dataType.simpleString()) for f in s] == [("port", "string"), ("depth", "bigint"), ("fee", "double"), ("none", "string"), ("open", "boolean")]
    assert files.read_json(spark, str(tmp_path / "a.json")).count() == 5


def test_json_schema_of_all_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join('{"a":%d}\n' % i for i in range(5000)) + '{"a":3000000000,"late":1}\n{"late":2.5,"last":[1]}\n')
    df = files.read_json(spark, str(tmp_path / "a.json"))
    assert df.dtypes == [("a", "bigint"), ("late", "double"), ("last", "string")]
    assert rows(df.filter("late is not null")) == [(3000000000, 1.0, None), (None, 2.5, "[1]")]
    (tmp_path / "none.json").write_text("\n")
    assert files.infer_json_schema(spark, str(tmp_path / "none.json")).names == []


GOOD = ["SELECT * FROM t", "select a, count(*) AS n from t where a >= 1 AND (b = 'x' OR c < 2.5) group by a having count(*) > 1 order by n desc limit 3", "SELECT DISTINCT a + 1 * 2 b FROM t LEFT OUTER JOIN u ON a = b AND c = d"]
BAD = ["SELECT", "SELECT a", "SELECT a FROM t WHERE a IS NULL", "SELECT upper(a) FROM t", "SELECT a FROM t UNION SELECT a FROM u", "SELECT -1 FROM t", "SELECT t.a FROM t", "SELECT a FROM t LIMIT x", "SELECT a FROM t WHERE a < 1 < 2", "SELECT a FROM t CROSS JOIN u"]


@pytest.mark.parametrize("text", GOOD)
def test_grammar_takes(text):
    sqlfront.check(text)


@pytest.mark.parametrize("text", BAD)
def test_grammar_refuses(text):
    with pytest.raises(sqlfront.GrammarError):
        sqlfront.check(text)


def test_sql(spark, make):
    make([(1, "x"), (2, "y")], "a:int b:string").createOrReplaceTempView("t")
    assert rows(sqlfront.sql(spark, "SELECT b FROM t WHERE a > 1", strict=True)) == [("y",)]
    assert rows(sqlfront.sql(spark, "SELECT CASE WHEN a = 1 THEN 'one' END c FROM t")) == [("one",), (None,)]
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        sqlfront.sql(spark, "SELECT a FROM nowhere")


def test_sql_semantics(spark, make):
    import math

    make([(2**31 - 1, 0.0, "x"), (None, -0.0, "y"), (-5, 2.0, None)], "a:int d:double s:string").createOrReplaceTempView("t")
    make([(2**31 - 1, 1), (-5, 2), (None, 3)], "a:int s:int").createOrReplaceTempView("u")
    q = lambda text: sqlfront.sql(spark, text, strict=True)
    assert q("SELECT a + 1, a * 2 AS b, a - 1 c FROM t").dtypes == [("a + 1", "bigint"), ("b", "bigint"), ("c", "bigint")]
    assert rows(q("SELECT a + 1 FROM t WHERE a * 2 > 5")) == [(2**31,)]
    assert q("SELECT d + 1, d * a FROM t").dtypes == [("d + 1", "double"), ("d * a", "double")]
    assert sorted(map(str, (r[0] for r in q("SELECT 1 / d FROM t").collect()))) == ["-inf", "0.5", "inf"]
    assert [r[0] for r in q("SELECT (a - a) / (a - a) FROM t WHERE s = 'x'").collect()][0] != 0 and math.isnan(q("SELECT (a - a) / d z FROM t WHERE s = 'x'").first().z)
    joined = q("SELECT * FROM t JOIN u ON a = a JOIN u ON a = a")
    assert joined.columns == ["a", "d", "s", "a_2", "s_2", "a_3", "s_3"] and joined.count() == 2
    assert rows(q("SELECT s, s_2 FROM t LEFT JOIN u ON a + 1 = a + 1 ORDER BY s_2")) == sorted([("x", 1), ("y", None), (None, 2)], key=repr)
    assert rows(q("SELECT s_2 FROM u FULL OUTER JOIN t ON s = a + 6")) == sorted([(None,), (None,), (None,), ("x",), ("y",)][1:] + [(None,)], key=repr)
    assert q("SELECT count(*), sum(a + 1) FROM t GROUP BY s HAVING count(*) > 0 ORDER BY sum(a + 1) DESC LIMIT 2").columns == ["count(*)", "sum(a + 1)"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_from_")]


def test_settings():
    got = session.translate({"sql.adaptive.enabled": True, "sql.autoBroadcastJoinThreshold.rows": 0, "sql.adaptive.autoBroadcastJoinThreshold.rows": 5, "spark.x": 1})
    assert got == {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.x": "1"}
    with pytest.raises(KeyError):
        session.translate({"unknown": 1})


def test_shared(spark, make, tmp_path):
    sc = spark.sparkContext
    total = shared.long_accumulator(spark)
    sc.parallelize(range(100), 4).foreach(lambda _: total.add(1))
    assert total.value == 100
    longest = shared.accumulator(spark, "", lambda: "", lambda a, b: max(a, b, key=len))
    sc.parallelize(["a", "ccc", "bb"], 3).foreach(lambda x: longest.add(x))
    assert longest.value == "ccc"
    b = shared.broadcast_value(spark, {"a": 1})
    assert sc.parallelize(["a"]).map(lambda x: b.value[x]).collect() == [1]
    df = make([(i,) for i in range(20)], "v:int")
    assert shared.checkpoint(df.filter("v >= 10")).count() == 10
    assert shared.persist(df).count() == 20
    assert shared.persist(df, "NONE").count() == 20
    with shared.job_group(spark, "g"), shared.scheduler_pool(spark, "p"):
        assert df.count() == 20
    assert shared.run_job(sc.parallelize(range(4), 2), lambda it: [sum(it)], [1]) == [5]
    shared.pool_file(str(tmp_path / "pools.xml"), {"p": (2, 1)})
    assert "<weight>2</weight>" in (tmp_path / "pools.xml").read_text()
    now = shared.status(spark)
    assert now["jobs"] == [] and now["executors"] and now["executors"][0]["running"] == 0


def test_cancel(spark):
    failed = []

    def run():
        try:
            with shared.job_group(spark, "slow"):
                spark.sparkContext.parallelize(range(2), 2).foreach(lambda _: __import__("time").sleep(30))
        except Exception as e:
            failed.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=run)
    t.start()
    for _ in range(100):
        if (now := shared.status(spark))["stages"]:
            assert now["jobs"][0]["stages"] == [now["stages"][0]["id"]] and now["jobs"][0]["status"] == "RUNNING" and now["stages"][0]["tasks"] == 2
            break
        threading.Event().wait(0.1)
    shared.cancel(spark)
    t.join(25)
    assert failed


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    q = each_batch(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sum(seen) == 10


def test_submit(tmp_path):
    import subprocess
    import sys

    from tessera import submit

    c = submit.command(["--master", "local[1]", "--name", "n", "--conf", "sql.adaptive.enabled=false", "--conf", "spark.x=a=b", "app.py", "--flag", "1"])
    assert c[0].endswith("spark-submit") and c[1:] == ["--master", "local[1]", "--name", "n", "--conf", "spark.sql.adaptive.enabled=false", "--conf", "spark.x=a=b", "app.py", "--flag", "1"]
    with pytest.raises(SystemExit):
        submit.command(["--conf", "nonsense", "app.py"])
    (tmp_path / "app.py").write_text("import sys\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.getOrCreate()\nopen(sys.argv[1], 'w').write(f'{s.range(5).count()} {s.sparkContext.appName}')\n")
    subprocess.run([sys.executable, "-m", "tessera.submit", "--master", "local[1]", "--name", "counts", "--conf", "ui.enabled=false", str(tmp_path / "app.py"), str(tmp_path / "out")], check=True, capture_output=True, timeout=120)
    assert (tmp_path / "out").read_text() == "5 counts"


def test_show_and_foreach(spark, make, capsys):
    df = make([(3, "c"), (None, "n")], "v:int s:string")
    df.show()
    assert "NULL" in capsys.readouterr().out and df.first() == df.take(1)[0]
    n = shared.long_accumulator(spark)
    df.foreach(lambda r: n.add(r.v or 0))
    assert n.value == 3 and df.rdd.map(lambda r: r.v or 0).reduce(max) == 3
    assert keyed.hash_partitioned(df, 3, "v").rdd.getNumPartitions() == 3
