"""Checks: choosing rows and columns, expressions, joins, set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.functions.names import Remapping, expand_columns, include_exclude
from recon.functions.predicates import CompareRules, distinct_from
from recon.operators import relational as rel
from recon.operators.hashdiff import rowset_diff
from recon.operators.joindiff import compare_by_key
from recon.sources.side import side
from recon.suite.inputs import CUSTOMERS_A, CUSTOMERS_RENAMED, ORDERS_A, ORDERS_B, derive, sql, table
from recon.suite.registry import check

NOW = datetime(2024, 1, 31)


def orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf, "orders", ORDERS_A), derive(spark, sf, "orders", ORDERS_B)


A_B = f"WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')}) "


@check(
    "F1_key_range",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000",
)
def key_range(spark, sf):
    return side(table(spark, sf, "orders"), "o_orderkey", ["o_custkey"], min_key=(100,), max_key=(5000,)).rows()


@check(
    "F1_compound_key_range",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 5 AND conv_id < 60 AND turn >= 1 AND turn < 4",
)
def compound_range(spark, sf):
    t = table(spark, sf, "conversations")
    return side(t, ("conv_id", "turn"), ["role"], min_key=(5, 1), max_key=(60, 4)).rows()


@check(
    "F2_update_window",
    "SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'",
)
def update_window(spark, sf):
    return side(
        table(spark, sf, "events"),
        "event_id",
        ["user_id"],
        update_column="ts",
        min_update=datetime(2024, 1, 5),
        max_update=datetime(2024, 1, 20, 12),
    ).rows()


@check(
    "F3_relative_age",
    "SELECT event_id, ts, user_id FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AND ts < TIMESTAMP '2024-01-31' - INTERVAL 30 HOUR",
)
def relative_age(spark, sf):
    s = side(table(spark, sf, "events"), "event_id", ["user_id"], update_column="ts")
    return s.with_age(NOW, min_age="1d6h", max_age="1w3d").rows()


@check(
    "F4_where",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1-%'",
)
def where(spark, sf):
    return side(
        table(spark, sf, "orders"), "o_orderkey", ["o_orderstatus"], where="o_orderstatus = 'F' OR o_orderpriority LIKE '1-%'"
    ).rows()


@check("F5_column_patterns", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders")
def column_patterns(spark, sf):
    t = table(spark, sf, "orders")
    chosen = expand_columns(["o_order%", "o_cust???"], t.columns, t.columns, keys=["o_orderkey"], update="o_orderdate")
    return side(t, "o_orderkey", chosen).rows()


@check("F6_include_exclude", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def include(spark, sf):
    t = table(spark, sf, "orders")
    chosen = include_exclude(
        [c for c in t.columns if c != "o_orderkey"],
        include=["O_CUSTKEY", "O_ORDERDATE", "O_ORDERSTATUS", "O_TOTALPRICE"],
        exclude=["o_OrderStatus"],
        retyped=["o_totalprice"],
    )
    return side(t, "o_orderkey", chosen).rows()


@check(
    "F7_ignored_column",
    A_B
    + """, d AS (SELECT a.o_orderkey k FROM a JOIN b ON a.o_orderkey = b.o_orderkey
       WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
       UNION ALL SELECT o_orderkey FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
       UNION ALL SELECT o_orderkey FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a))
    SELECT '-' AS sign, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderstatus
    FROM a WHERE o_orderkey IN (SELECT k FROM d)
    UNION ALL
    SELECT '+', CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), o_orderstatus
    FROM b WHERE o_orderkey IN (SELECT k FROM d)""",
)
def ignored(spark, sf):
    a, b = (side(t, "o_orderkey", ["o_totalprice", "o_orderstatus"]) for t in orders(spark, sf))
    return rowset_diff(a, b, rules=CompareRules(ignored_columns=frozenset({"o_totalprice"})))


@check(
    "F8_remapping",
    f"""WITH a AS ({sql(CUSTOMERS_A, 'customer')}), b AS ({sql(CUSTOMERS_RENAMED, 'customer')})
    SELECT count(a.c_custkey) AS "rows_A", count(b.c_custkey) AS "rows_B",
      count(*) FILTER (WHERE b.c_custkey IS NULL) AS "exclusive_A", count(*) FILTER (WHERE a.c_custkey IS NULL) AS "exclusive_B",
      count(*) FILTER (WHERE a.c_custkey = b.c_custkey AND (a.c_acctbal IS DISTINCT FROM b.balance
        OR a.c_name IS DISTINCT FROM b.full_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment)) AS updated,
      count(*) FILTER (WHERE a.c_custkey = b.c_custkey AND a.c_acctbal = b.balance AND a.c_name = b.full_name
        AND a.c_mktsegment = b.c_mktsegment) AS unchanged,
      count(*) FILTER (WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.balance
        OR a.c_name IS DISTINCT FROM b.full_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment) AS total
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""",
)
def remapping(spark, sf):
    a = side(derive(spark, sf, "customer", CUSTOMERS_A), "c_custkey")
    b = side(derive(spark, sf, "customer", CUSTOMERS_RENAMED), "c_custkey")
    return compare_by_key(a, b, remapping=Remapping.parse("C_NAME:full_name, c_acctbal:Balance", case_sensitive=False)).stats()


@check(
    "F9_select_distinct",
    "SELECT DISTINCT o_orderstatus, upper(o_orderpriority) AS priority, o_custkey % 10 AS bucket FROM orders",
)
def select_distinct(spark, sf):
    t = table(spark, sf, "orders")
    return t.select("o_orderstatus", F.upper("o_orderpriority").alias("priority"), (F.col("o_custkey") % 10).alias("bucket")).distinct()


@check(
    "F10_predicates",
    """SELECT p_partkey, -p_size AS negative_size, p_size + 1 - 2 AS shifted FROM part
    WHERE ((p_size >= 10 AND p_size < 30) OR p_size = 45 OR p_size <= 2 OR p_size > 48)
      AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23', 'Brand#7') AND p_name LIKE '%e%' AND p_type IS NOT NULL""",
)
def predicates(spark, sf):
    t, size = table(spark, sf, "part"), F.col("p_size")
    keep = ((size >= 10) & (size < 30)) | (size == 45) | (size <= 2) | (size > 48)
    keep = keep & F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#23", "Brand#7")
    keep = keep & F.col("p_name").like("%e%") & ~F.col("p_type").isNull()
    return t.where(keep).select("p_partkey", (-size).alias("negative_size"), (size + 1 - 2).alias("shifted"))


@check(
    "F11_distinct_from",
    A_B
    + """SELECT a.o_orderkey, a.o_orderstatus AS left_status, b.o_orderstatus AS right_status FROM a JOIN b
    ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
)
def is_distinct_from(spark, sf):
    a, b = orders(spark, sf)
    both = a.alias("a").join(b.alias("b"), "o_orderkey")
    left, right = F.col("a.o_orderstatus"), F.col("b.o_orderstatus")
    return both.where(distinct_from(left, right)).select("o_orderkey", left.alias("left_status"), right.alias("right_status"))


@check(
    "F12_case_when",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
    CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_even FROM part""",
)
def case_when(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        rel.choose((size < 10, F.lit("small")), (size < 30, F.lit("medium")), otherwise=F.lit("large")).alias("size_class"),
        rel.choose((size % 2 == 0, F.lit(1)), otherwise=F.lit(0)).alias("is_even"),
    )


@check("F13a_coalesce", A_B + "SELECT o_orderkey, coalesce(o_orderstatus, 'none') AS status FROM b")
def coalesce(spark, sf):
    return orders(spark, sf)[1].select("o_orderkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"))


@check(
    "F13b_cast",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey_text, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
    CAST(o_orderdate AS DATE) AS order_day, TRY_CAST(o_orderstatus AS INTEGER) AS status_number FROM orders""",
)
def cast(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("custkey_text"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("order_day"),
        F.col("o_orderstatus").try_cast("int").alias("status_number"),
    )


@check(
    "F13c_concat",
    A_B
    + """SELECT o_orderkey, concat(CAST(o_orderkey AS VARCHAR), '-', coalesce(o_orderstatus, '<null>'), '-', o_orderpriority) AS label
    FROM b""",
)
def concat(spark, sf):
    cols = [F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")]
    return orders(spark, sf)[1].select("o_orderkey", rel.concat_text(cols, "-").alias("label"))


@check("F13d_random_now")
def random_now(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.rand(7).alias("random"), F.current_timestamp().alias("at")
    )


@check("F14_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(spark, sf):
    return rel.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice").desc(), "o_orderkey")


@check(
    "F15_cte_exists",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000)
    SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM big WHERE big.o_custkey = customer.c_custkey)""",
)
def cte_exists(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    c = table(spark, sf, "customer")
    return rel.exists_in(c, big, c.c_custkey == big.o_custkey).select("c_custkey", "c_name")


@check(
    "F16_hint",
    """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def hint(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n.hint("merge"), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@check(
    "J4a_inner_join",
    """SELECT r_name, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS price FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def inner_join(spark, sf):
    o, c, n, r = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(38,2)").alias("price")
    )


@check(
    "J4b_left_right_join",
    """SELECT 'left' AS side, count(*) AS n, count(quality) AS matched FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'right', count(*), count(text) FROM documents RIGHT JOIN labels USING (doc_id)""",
)
def left_right(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")

    def counted(how, probe):
        return d.join(l, "doc_id", how).agg(F.lit(how).alias("side"), F.count(F.lit(1)).alias("n"), F.count(probe).alias("matched"))

    return counted("left", "quality").unionByName(counted("right", "text"))


@check(
    "J4c_full_outer_join",
    """SELECT a.c_custkey AS customer, b.s_suppkey AS supplier, c_nationkey, s_nationkey FROM customer a
    FULL OUTER JOIN supplier b ON a.c_custkey = b.s_suppkey * 3""",
)
def full_outer(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey * 3, "full_outer").select(
        F.col("c_custkey").alias("customer"), F.col("s_suppkey").alias("supplier"), "c_nationkey", "s_nationkey"
    )


@check(
    "J4d_theta_join",
    """SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate, l_shipdate FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate""",
)
def theta(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    on = (l.l_orderkey == o.o_orderkey) & (l.l_shipdate < o.o_orderdate)
    return rel.theta_join(l, o, on).select("l_orderkey", "l_partkey", "l_linenumber", "o_orderdate", "l_shipdate")


@check(
    "A1_group_having",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers,
    sum(CAST(o_totalprice AS DECIMAL(12,2))) AS price, min(o_orderdate) AS first_day, max(o_orderkey) AS last_key,
    CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(o_totalprice) AS avg_price
    FROM orders GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 10""",
)
def group_having(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", "o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("o_custkey").alias("customers"),
            F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(38,2)").alias("price"),
            F.min("o_orderdate").alias("first_day"),
            F.max("o_orderkey").alias("last_key"),
            (F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double") / F.count("o_totalprice")).alias("avg_price"),
        )
        .where("n > 10")
    )



def _halves(spark, sf):
    a, b = orders(spark, sf)
    return a.select("o_custkey", "o_orderstatus"), b.select("o_custkey", "o_orderstatus")


@check("U1_union", A_B + "SELECT o_custkey, o_orderstatus FROM a UNION SELECT o_custkey, o_orderstatus FROM b")
def union(spark, sf):
    return rel.union_distinct(*_halves(spark, sf))


@check("U1_union_all", A_B + "SELECT o_custkey, o_orderstatus FROM a UNION ALL SELECT o_custkey, o_orderstatus FROM b")
def union_all(spark, sf):
    return rel.union_all(*_halves(spark, sf))


@check("U2_except", A_B + "SELECT o_custkey, o_orderstatus FROM b EXCEPT SELECT o_custkey, o_orderstatus FROM a")
def subtract(spark, sf):
    a, b = _halves(spark, sf)
    return rel.except_distinct(b, a)


@check("U3_intersect", A_B + "SELECT o_custkey, o_orderstatus FROM a INTERSECT SELECT o_custkey, o_orderstatus FROM b")
def intersect(spark, sf):
    a, b = _halves(spark, sf)
    return rel.intersect_distinct(a, b)
