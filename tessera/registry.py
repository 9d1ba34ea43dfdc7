"""The engine's queries by name, each with the SQL that DuckDB must answer alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as A
from .functions import expressions as X
from .operators import aggregate, joins, keyed, pyfunc, relational, windows
from .plans import sqlfront
from .session import load_table, load_tables
from .shared import broadcast_value, checkpoint, long_accumulator, persist, set_checkpoint_dir
from .sources import files
from .types import create_dataframe

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; f takes (table, spark), table giving a DataFrame by name."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, folder: f(lambda t: load_table(spark, folder, t), spark)
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


FLAGSHIP = """SELECT c_mktsegment, count(*) AS n, sum(l_quantity) AS qty, avg(l_extendedprice) AS avg_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_discount >= 0.05 GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY qty DESC LIMIT 5"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    load_tables(spark, folder, "lineitem", "orders", "customer")
    return sqlfront.sql(spark, FLAGSHIP, strict=True).withColumns({"qty": F.round("qty", 2), "avg_price": F.round("avg_price", 2)})


_QUERIES["flagship"] = flagship
_SQL["flagship"] = f"SELECT c_mktsegment, n, round(qty, 2) AS qty, round(avg_price, 2) AS avg_price FROM ({FLAGSHIP})"

# Projection, filters, expressions


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_project(t, spark):
    return relational.select(t("customer"), "c_custkey", "c_name", "c_acctbal")


@query("SELECT * FROM part WHERE p_size >= 40")
def select_star_filter(t, spark):
    return relational.where(t("part"), X.col("p_size") >= 40)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) + 1 AS next_line, round(l_extendedprice * l_quantity, 2) AS total FROM lineitem")
def arith_alias(t, spark):
    df = t("lineitem")
    return df.select("l_orderkey", X.add(X.col("l_linenumber"), 1, df).alias("next_line"), F.round(X.multiply(X.col("l_extendedprice"), X.col("l_quantity"), df), 2).alias("total"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) - 3 AS less, CAST(p_size AS BIGINT) * p_size AS square FROM part")
def arith_whole(t, spark):
    df = t("part")
    return df.select("p_partkey", X.subtract(X.col("p_size"), 3, df).alias("less"), X.multiply(X.col("p_size"), X.col("p_size"), df).alias("square"))


@query("SELECT p_partkey, round(p_retailprice / p_size, 6) AS ratio FROM part")
def divide_double(t, spark):
    return t("part").select("p_partkey", F.round(X.divide(X.col("p_retailprice"), X.col("p_size")), 6).alias("ratio"))


@query("SELECT p_partkey, p_retailprice / CAST(p_size - p_size AS DOUBLE) AS ratio FROM part")
def divide_by_zero_inf(t, spark):
    return t("part").select("p_partkey", X.divide(X.col("p_retailprice"), X.col("p_size") - X.col("p_size")).alias("ratio"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderkey >= 10 AND o_orderkey <= 5000 AND o_orderstatus <> 'F') OR (o_totalprice > 300000.0 AND o_orderstatus = 'F') OR o_orderkey < 3")
def cmp_all_ops(t, spark):
    k, p, s = X.col("o_orderkey"), X.col("o_totalprice"), X.col("o_orderstatus")
    return relational.where(t("orders"), ((k >= 10) & (k <= 5000) & (s != "F")) | ((p > 300000.0) & (s == "F")) | (k < 3)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' AND c_acctbal > 5000.0")
def bool_precedence(t, spark):
    t("customer").createOrReplaceTempView("customer")
    return sqlfront.sql(spark, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' AND c_acctbal > 5000.0", strict=True)


@query("SELECT id, a OR b AS either, a AND b AS both FROM (VALUES (1, NULL, TRUE), (2, NULL, FALSE), (3, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN)), (4, TRUE, NULL), (5, FALSE, NULL), (6, TRUE, FALSE)) AS v(id, a, b)")
def null_logic(t, spark):
    df = create_dataframe(spark, [(1, None, True), (2, None, False), (3, None, None), (4, True, None), (5, False, None), (6, True, False)], [("id", "int"), ("a", "boolean"), ("b", "boolean")])
    return df.select("id", (X.col("a") | X.col("b")).alias("either"), (X.col("a") & X.col("b")).alias("both"))


@query("SELECT *, round(s_acctbal * 2.0, 2) AS twice FROM supplier")
def with_column_append(t, spark):
    return relational.with_column(t("supplier"), "twice", F.round(X.col("s_acctbal") * 2.0, 2))


@query("SELECT r_regionkey, 7 AS i, CAST(5000000000 AS BIGINT) AS l, CAST(2.5 AS DOUBLE) AS d, 'it''s' AS s, TRUE AS b FROM region")
def literals(t, spark):
    return t("region").select("r_regionkey", X.lit(7).alias("i"), X.lit(5_000_000_000).alias("l"), X.lit(2.5).alias("d"), X.lit("it's").alias("s"), X.lit(True).alias("b"))


# Aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_sum_count_avg(t, spark):
    return aggregate.group_agg(t("lineitem"), ["l_returnflag", "l_linestatus"], F.round(A.sum_("l_quantity"), 2).alias("sum_qty"), A.count().alias("n"), F.round(A.avg("l_extendedprice"), 4).alias("avg_price"))


@query("SELECT p_brand, p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand, p_type")
def group_min_max_multi(t, spark):
    return aggregate.group_agg(t("part"), ["p_brand", "p_type"], A.min_("p_size").alias("lo"), A.max_("p_size").alias("hi"))


@query('SELECT o_orderpriority, count(*) AS "count(*)" FROM orders GROUP BY o_orderpriority')
def group_count_short(t, spark):
    return aggregate.group_count(t("orders"), "o_orderpriority")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def global_agg(t, spark):
    return aggregate.group_agg(t("orders"), [], A.count().alias("n"), A.sum_("o_orderkey").alias("s"), A.min_("o_totalprice").alias("lo"), A.max_("o_totalprice").alias("hi"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
def global_agg_empty(t, spark):
    return aggregate.group_agg(t("orders").filter("o_orderkey < 0"), [], A.count().alias("n"), A.sum_("o_orderkey").alias("s"), A.avg("o_totalprice").alias("a"))


@query("SELECT c_custkey, count(o_orderkey) AS n, count(*) AS total FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000.0) ON c_custkey = o_custkey GROUP BY c_custkey")
def count_col_skips_null(t, spark):
    j = joins.equi_join(t("customer"), t("orders").filter("o_totalprice > 300000.0"), "c_custkey", "o_custkey", "left")
    return aggregate.group_agg(j, ["c_custkey"], A.count("o_orderkey").alias("n"), A.count().alias("total"))


HAVING = "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12"


@query(HAVING)
def having_hidden_agg(t, spark):
    t("orders").createOrReplaceTempView("orders")
    return sqlfront.sql(spark, HAVING, strict=True)


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) + 1 AS s FROM lineitem GROUP BY l_returnflag")
def agg_in_expr(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg((F.sum("l_linenumber") + 1).alias("s"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
def order_by_agg(t, spark):
    g = aggregate.group_agg(t("orders"), ["o_custkey"], A.sum_("o_totalprice").alias("s"))
    return relational.top_n(g, 20, ("s", "desc"), ("o_custkey", "asc")).select("o_custkey", F.round("s", 2).alias("total"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t, spark):
    return relational.distinct(t("orders").select("o_orderstatus", "o_orderpriority"))


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_one(t, spark):
    return relational.distinct(t("orders").select("o_custkey"))


@query("SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS g FROM events WHERE value >= 0 GROUP BY event_type")
def user_aggregate(t, spark):
    import math

    g = A.user_aggregate(lambda: (0.0, 0), lambda b, v: (b[0] + math.log(v + 1), b[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda b: round(math.exp(b[0] / b[1]), 6), "double")
    return g(t("events").filter("value >= 0"), ["event_type"], "value", "g")


@query("SELECT event_type, count(*) AS n, round(exp(avg(ln(value + 1))), 6) AS g, max(value) AS top, CAST(max(event_id) AS BIGINT) AS last FROM events WHERE value >= 0 GROUP BY event_type")
def mixed_aggregates(t, spark):
    import math

    mean = A.user_aggregate(lambda: (0.0, 0), lambda b, v: (b[0] + math.log(v + 1), b[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda b: round(math.exp(b[0] / b[1]), 6), "double")
    last = A.user_aggregate(lambda: -1, max, max, lambda b: b, "bigint")
    return aggregate.group_agg(t("events").filter("value >= 0"), ["event_type"], A.count().alias("n"), mean.of("value").alias("g"), A.max_("value").alias("top"), last.of("event_id").alias("last"))


@query("SELECT count(*) AS n, CAST(bit_xor(CAST(o_orderkey AS BIGINT)) AS BIGINT) AS x FROM orders")
def user_aggregate_global(t, spark):
    return aggregate.group_agg(t("orders"), [], A.count().alias("n"), A.user_aggregate(lambda: 0, lambda b, v: b ^ v, lambda a, b: a ^ b, lambda b: b, "bigint").of("o_orderkey").alias("x"))


# Joins


for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {_kind} orders ON c_custkey = o_custkey", name=f"join_{_how}_whole")(
        lambda t, spark, how=_how: joins.equi_join(t("customer").select("c_custkey", "c_name"), t("orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", how)
    )
for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):
    query(f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000.0)", name=f"join_{_how}")(
        lambda t, spark, how=_how: joins.equi_join(t("customer").select("c_custkey", "c_name"), t("orders").filter("o_totalprice > 250000.0"), "c_custkey", "o_custkey", how)
    )
for _strategy in ("broadcast", "shuffle_hash", "sort_merge"):
    query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", name=f"join_{_strategy}_whole")(
        lambda t, spark, s=_strategy: joins.equi_join(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", strategy=s).select("o_orderkey", "c_name")
    )


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS q FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity < 10")
def join_multi_key(t, spark):
    j = joins.equi_join(t("lineitem").filter("l_quantity < 10"), t("lineitem").filter("l_quantity >= 49"), ["l_orderkey", "l_linenumber"])
    return j.select("l_orderkey", "l_linenumber", F.col("l_quantity_2").alias("q"))


@query("SELECT port, ship FROM (VALUES (7, 'oslo'), (NULL, 'nowhere'), (9, 'riga')) a(dock, port) JOIN (VALUES (9, 'tern'), (NULL, 'lost'), (9, 'skua')) b(dock, ship) ON a.dock = b.dock")
def join_null_keys(t, spark):
    a = create_dataframe(spark, [(7, "oslo"), (None, "nowhere"), (9, "riga")], [("dock", "int"), ("port", "string")])
    b = create_dataframe(spark, [(9, "tern"), (None, "lost"), (9, "skua")], [("dock", "int"), ("ship", "string")])
    return joins.equi_join(a, b, "dock").select("port", "ship")


@query("SELECT n_nationkey, r_name FROM nation JOIN (SELECT CAST(r_regionkey AS DOUBLE) AS k, r_name FROM region) ON n_regionkey = k")
def join_mixed_numeric_keys(t, spark):
    return joins.equi_join(t("nation"), t("region").select(F.col("r_regionkey").cast("double").alias("k"), "r_name"), "n_regionkey", "k").select("n_nationkey", "r_name")


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_2, b.n_name AS n_name_2, b.n_regionkey AS n_regionkey_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_dup_names(t, spark):
    return joins.equi_join(t("nation"), t("nation"), "n_regionkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9900.0")
def join_adaptive_demote(t, spark):
    return joins.equi_join(t("orders"), t("customer").filter("c_acctbal > 9900.0"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


CHAIN = "SELECT c_mktsegment, l_returnflag, sum(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_mktsegment, l_returnflag"


@query(f"SELECT c_mktsegment, l_returnflag, round(s, 1) AS s FROM ({CHAIN})")
def join_chain3(t, spark):
    for n in ("lineitem", "orders", "customer"):
        t(n).createOrReplaceTempView(n)
    return sqlfront.sql(spark, CHAIN, strict=True).withColumn("s", F.round("s", 1))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t, spark):
    return joins.cross_join(t("region"), t("nation")).select("r_name", "n_name")


def _bands(spark):
    return create_dataframe(spark, [(1, 8, "tiny"), (5, 23, "medium"), (23, 46, "big"), (60, 75, "giant")], [("lo", "int"), ("hi", "int"), ("label", "string")])


BANDS = "(VALUES (1, 8, 'tiny'), (5, 23, 'medium'), (23, 46, 'big'), (60, 75, 'giant')) b(lo, hi, label)"
for _how, _sql in (
    ("inner", f"SELECT p_partkey, label FROM part JOIN {BANDS} ON p_size >= lo AND p_size < hi"),
    ("left", f"SELECT p_partkey, label FROM part LEFT JOIN {BANDS} ON p_size >= lo AND p_size < hi"),
    ("right", f"SELECT p_partkey, label FROM part RIGHT JOIN {BANDS} ON p_size >= lo AND p_size < hi"),
    ("full", f"SELECT p_partkey, label FROM part FULL JOIN {BANDS} ON p_size >= lo AND p_size < hi"),
    ("left_semi", f"SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM {BANDS} WHERE p_size >= lo AND p_size < hi)"),
    ("left_anti", f"SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM {BANDS} WHERE p_size >= lo AND p_size < hi)"),
    ("cross", f"SELECT p_partkey, label FROM part CROSS JOIN {BANDS} WHERE p_size >= lo AND p_size < hi"),
):
    query(_sql, name=f"theta_{_how.replace('left_', '')}")(lambda t, spark, how=_how: joins.theta_join(t("part"), _bands(spark), "p_size >= lo AND p_size < hi", how).select("p_partkey", *[] if how in ("left_semi", "left_anti") else ["label"]))

@query("SELECT p_partkey, p_retailprice / CAST(p_size - 25 AS DOUBLE) AS q, CAST(p_size - 25 AS DOUBLE) / CAST(p_size - 25 AS DOUBLE) AS one FROM part")
def sql_divide_by_zero(t, spark):
    t("part").createOrReplaceTempView("part")
    return sqlfront.sql(spark, "SELECT p_partkey, p_retailprice / (p_size - 25) AS q, (p_size - 25) / (p_size - 25) AS one FROM part", strict=True)


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 100000000 + 2147483647 AS big, CAST(p_size AS BIGINT) - 2147483647 AS low FROM part WHERE CAST(p_size AS BIGINT) * 100000000 > 2147483647")
def sql_int_widen(t, spark):
    t("part").createOrReplaceTempView("part")
    return sqlfront.sql(spark, "SELECT p_partkey, p_size * 100000000 + 2147483647 AS big, p_size - 2147483647 low FROM part WHERE p_size * 100000000 > 2147483647", strict=True)


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_2, b.n_name AS n_name_2, b.n_regionkey AS n_regionkey_2 FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey WHERE a.n_nationkey > 2")
def sql_join_star(t, spark):
    t("nation").createOrReplaceTempView("nation")
    return sqlfront.sql(spark, "SELECT * FROM nation LEFT OUTER JOIN nation ON n_regionkey = n_nationkey WHERE n_nationkey > 2", strict=True)


@query("SELECT n_name_2, count(*) AS n FROM (SELECT b.n_name AS n_name_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_regionkey + 1 = b.n_regionkey + 1) GROUP BY n_name_2 HAVING count(*) > 1")
def sql_join_same_names(t, spark):
    t("nation").createOrReplaceTempView("nation")
    return sqlfront.sql(spark, "SELECT n_name_2, count(*) n FROM nation JOIN nation ON n_regionkey = n_regionkey AND n_regionkey + 1 = n_regionkey + 1 GROUP BY n_name_2 HAVING count(*) > 1 ORDER BY n_name_2", strict=True)


# Windows, sorting


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(t, spark):
    return t("orders").select("o_custkey", "o_orderkey", windows.row_number(windows.partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")).alias("rn"))


for _f in ("rank", "dense_rank"):
    query(f"SELECT p_partkey, p_brand, {_f}() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part", name=f"win_{_f}")(lambda t, spark, f=_f: t("part").select("p_partkey", "p_brand", getattr(windows, f)(windows.partition_by("p_brand").order_by("p_size")).alias("r")))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events")
def win_global_row_number(t, spark):
    return windows.global_row_number(t("events").select("event_id"), "event_id", name="rn")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS rn FROM customer")
def win_order_desc(t, spark):
    return t("customer").select("c_custkey", windows.row_number(windows.partition_by("c_mktsegment").order_by_desc("c_acctbal", "c_custkey")).alias("rn"))


@query("SELECT p_partkey, p_brand, p_size, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM part")
def user_window(t, spark):
    return windows.user_window(t("part").select("p_partkey", "p_brand", "p_size"), windows.partition_by("p_brand").order_by("p_partkey"), "running", "bigint", lambda rows: list(accumulate(r.p_size for r in rows)))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_multi(t, spark):
    return relational.top_n(t("orders"), 50, ("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_top_n(t, spark):
    return relational.limit(relational.order_by(t("orders"), ("o_totalprice", "desc"), ("o_orderkey", "asc")), 100).select("o_orderkey", "o_totalprice")


# Keyed dataflow


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(t, spark):
    return keyed.word_count(t("documents"))


def _pairs(t):
    return keyed.map_to_pair(t("orders"), "o_custkey", "o_orderkey")


@query("SELECT o_custkey AS k, CAST(sum(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY o_custkey")
def reduce_by_key(t, spark):
    return keyed.reduce_by_key(_pairs(t))


@query("SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey")
def group_by_key(t, spark):
    return keyed.group_by_key(_pairs(t)).withColumn("v", F.array_join("v", ","))


@query("WITH a AS (SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, string_agg(CAST(c_nationkey AS VARCHAR), ',' ORDER BY c_nationkey) AS w FROM customer GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(v, '') AS v, coalesce(w, '') AS w FROM a FULL JOIN b ON a.k = b.k")
def cogroup_whole(t, spark):
    c = keyed.cogroup(_pairs(t), keyed.map_to_pair(t("customer"), "c_custkey", "c_nationkey"))
    return c.select("k", F.array_join("v", ",").alias("v"), F.array_join("w", ",").alias("w"))


@query("SELECT o_custkey AS k, o_orderkey AS v, c_mktsegment AS w FROM orders JOIN customer ON o_custkey = c_custkey")
def pair_join(t, spark):
    return keyed.join(_pairs(t), keyed.map_to_pair(t("customer"), "c_custkey", "c_mktsegment"))


@query("SELECT o_orderkey AS k, o_custkey AS v FROM orders")
def sort_by_key(t, spark):
    return keyed.sort_by_key(keyed.map_to_pair(t("orders"), "o_orderkey", "o_custkey"))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def count_distinct_idiom(t, spark):
    return keyed.reduce_by_key(keyed.map_to_pair(t("events"), "user_id", F.lit(1))).agg(A.count().alias("n"))


@query("SELECT event_type AS k, round(avg(value), 6) AS v FROM events GROUP BY event_type")
def avg_per_key(t, spark):
    return keyed.reduce_by_key(keyed.map_to_pair(t("events"), "event_type", "value"), lambda v: F.round(F.sum(v) / F.count(v), 6))


@query("SELECT CAST(sum(r_regionkey * r_regionkey) AS BIGINT) AS total FROM region WHERE r_regionkey % 2 = 0")
def rdd_pipeline(t, spark):
    squares = t("region").select("r_regionkey").rdd.map(lambda r: r[0]).filter(lambda x: x % 2 == 0).map(lambda x: x * x)
    return spark.createDataFrame(squares.map(lambda x: ("all", x)).reduceByKey(lambda a, b: a + b).map(lambda kv: (kv[1],)), "total long")


# Python functions


@query("SELECT c_custkey + 1 AS k, upper(c_mktsegment) || '!' AS s FROM customer")
def py_map(t, spark):
    return pyfunc.py_map(t("customer").select("c_custkey", "c_mktsegment"), lambda r: (r.c_custkey + 1, r.c_mktsegment.upper() + "!"), "k long, s string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0")
def py_filter(t, spark):
    return pyfunc.py_filter(t("customer").select("c_custkey", "c_name"), lambda r: r.c_custkey % 7 == 0)


@query("SELECT n_nationkey AS k, unnest(string_split(n_name, ' ')) AS part FROM nation")
def py_flatmap(t, spark):
    return pyfunc.py_flat_map(t("nation").select("n_nationkey", "n_name"), lambda r: [(r.n_nationkey, x) for x in r.n_name.split(" ")], "k int, part string")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def py_reduce_by_key(t, spark):
    return pyfunc.py_reduce_by_key(t("orders"), "o_custkey", "o_orderkey", max, -1, "long")


@query("SELECT l_orderkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3")
def map_partitions(t, spark):
    def run(rows):
        held = {}
        for r in rows:
            n, s = held.get(r.l_orderkey, (0, 0))
            held[r.l_orderkey] = n + 1, s + r.l_linenumber
        yield from ((k, s) for k, (n, s) in held.items() if n > 3)

    return pyfunc.map_partitions(keyed.hash_partitioned(t("lineitem").select("l_orderkey", "l_linenumber"), 8, "l_orderkey"), run, "k bigint, v bigint")


# Actions, RDDs, shared variables


@query("SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS total, (SELECT min(l_orderkey) FROM lineitem) AS first")
def actions(t, spark):
    df = t("lineitem")
    total = df.select("l_linenumber").rdd.map(lambda r: r[0]).reduce(lambda a, b: a + b)
    first = keyed.take_ordered(df.select("l_orderkey"), 1, "l_orderkey")[0][0]
    return create_dataframe(spark, [(df.count(), total, first)], [("n", "bigint"), ("total", "bigint"), ("first", "bigint")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def take_ordered(t, spark):
    rows = keyed.take_ordered(t("orders").select("o_orderkey", "o_totalprice"), 7, F.desc("o_totalprice"), "o_orderkey")
    return create_dataframe(spark, [(int(k), p) for k, p in rows], [("o_orderkey", "bigint"), ("o_totalprice", "double")])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT count(*) FROM orders) AS n")
def accumulators(t, spark):
    n, f = long_accumulator(spark), long_accumulator(spark)

    def see(rows):
        for r in rows:
            n.add(1)
            f.add(int(r.o_orderstatus == "F"))

    t("orders").select("o_orderstatus").foreachPartition(see)
    return create_dataframe(spark, [(f.value, n.value)], [("f", "bigint"), ("n", "bigint")])


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_lookup(t, spark):
    names = broadcast_value(spark, {r[0]: r[1] for r in t("nation").select("n_nationkey", "n_name").collect()})  # 25 rows
    return pyfunc.py_map(t("supplier").select("s_suppkey", "s_nationkey"), lambda r: (r.s_suppkey, names.value[r.s_nationkey]), "s_suppkey bigint, n_name string")


@query("SELECT a AS k, a * a AS square FROM range(1000) t(a)")
def zipped_rdds(t, spark):
    a, b = spark.sparkContext.parallelize(range(1000), 8), spark.sparkContext.parallelize(range(1000), 8).map(lambda x: x * x)
    return spark.createDataFrame(keyed.zip_partitions(a, b, zip), "k long, square long")


# Files, views, persistence


def _folder(spark, kind: str) -> str:
    return f"{set_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t, spark):
    files.write_csv(t("nation"), path := _folder(spark, "csv"), header=True)
    return files.read_csv(spark, path, header=True, inferSchema=True)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(t, spark):
    files.write_json(t("nation"), path := _folder(spark, "json"))
    return files.read_json(spark, path)


@query("SELECT n_name AS value FROM nation")
def text_round_trip(t, spark):
    files.write_text(t("nation"), path := _folder(spark, "text"), "n_name")
    return files.read_text(spark, path)


@query("SELECT user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY user_id")
def temp_view_sql(t, spark):
    t("events").createOrReplaceTempView("events_view")
    return sqlfront.sql(spark, "SELECT user_id, count(*) AS n FROM events_view WHERE value > 50 GROUP BY user_id", strict=True)


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000.0) AS n, (SELECT max(o_orderkey) FROM orders WHERE o_totalprice > 100000.0) AS top")
def cache_reuse(t, spark):
    df = persist(t("orders").filter("o_totalprice > 100000.0"))
    return df.agg(A.count().alias("n")).crossJoin(df.agg(A.max_("o_orderkey").alias("top")))


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000.0) AS n, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 100000.0) AS low")
def checkpoint_reuse(t, spark):
    df = checkpoint(t("orders").filter("o_totalprice > 100000.0"))
    return df.agg(A.count().alias("n")).crossJoin(df.agg(A.min_("o_orderkey").alias("low")))
