"""Relational, window and streaming queries over the star schema and events, extensions of ours, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.session import shared_folder, table
from skarn.streaming import events as E

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "ext_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def ext_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    "ext_region_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
)
def ext_region_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    "ext_shipping_priority",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10",
)
def ext_shipping_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = rows.groupBy("l_orderkey", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return total.orderBy(F.col("revenue").desc(), "l_orderkey").limit(10)


@query("ext_discount_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def ext_discount_revenue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("ext_customers_without_orders", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def ext_customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("ext_rollup", "SELECT n_regionkey, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def ext_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query(
    "ext_moving_average",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving, rank() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events",
)
def ext_moving_average(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    r = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"), F.rank().over(r).cast("long").alias("rank"))


@query(
    "ext_asof_join",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS cts, event_id AS click_id FROM events WHERE event_type = 'click')
    SELECT p.event_id, max_by(c.click_id, (c.cts, c.click_id)) AS click_id FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.cts <= p.ts GROUP BY p.event_id""",
)
def ext_asof_join(spark, sf_dir):
    """The last click before each purchase: one union and one window, no join of all pairs of a user."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase')")
    is_click = F.col("event_type") == "click"
    order = Window.partitionBy("user_id").orderBy("ts", F.when(is_click, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("click_id", F.last(F.when(is_click, F.col("event_id")), ignorenulls=True).over(order)).filter(~is_click).select("event_id", "click_id")


@query("ext_json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def ext_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query(
    "ext_set_algebra",
    """SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""",
)
def ext_set_algebra(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(c.intersect(s), "both").unionByName(count(c.subtract(s), "customers"))


_DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@query("ext_tumbling_batch", _DAYS)
def ext_tumbling_batch(spark, sf_dir):
    return E.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _event_stream(spark, sf_dir):
    return E.read_events(spark, f"{sf_dir}/event[s].parquet")


@query("ext_tumbling_stream", _DAYS)
def ext_tumbling_stream(spark, sf_dir):
    """The same windows through a stream. Complete mode keeps windows that the watermark has not closed."""
    out = f"{_folder(spark)}/out"
    E.run_batches(E.tumbling(_event_stream(spark, sf_dir)), f"{_folder(spark)}/ck", lambda df, _: df.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out).withColumn("total", F.round("total", 6))


@query("ext_sliding_batch", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL")
def ext_sliding_batch(spark, sf_dir):
    return E.sliding(table(spark, sf_dir, "events"))


@query(
    "ext_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ext_sessions(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"))


@query(
    "ext_running_totals_stream",
    "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
)
def ext_running_totals_stream(spark, sf_dir):
    """The last state of each user from a stream with custom state."""
    out = f"{_folder(spark)}/out"

    def keep(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    E.run_batches(E.running_totals(_event_stream(spark, sf_dir)), f"{_folder(spark)}/ck", keep)
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 6).alias("total"))


@query("ext_deduplicated_stream", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def ext_deduplicated_stream(spark, sf_dir):
    root = _folder(spark)
    out = E.run_available(E.deduplicated(_event_stream(spark, sf_dir)), f"{root}/ck", f"{root}/out")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))
