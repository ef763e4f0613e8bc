"""Joins, aggregations, windows, state and model metrics over the star schema, events and labels.

Where a query is SQL by nature (grouping, joins and frames as showcases) its text is written once for both
engines; ``{name}`` stands for a table.  All others call the operators; ``oracle`` holds their SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import evaluation, relations, sampling, state
from ..plans.session import table
from ..streaming import operators as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def both(name: str, sql: str, duck: str | None = None) -> None:
    def run(spark, sf, sql=sql):
        used = {t: table(spark, sf, t) for t in TABLES if re.search(rf"\{{{t}\}}", sql)}
        return spark.sql(sql, **used)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck or sql)


def oracle(name: str, sql: str, duck: str | None = None) -> None:
    """The DuckDB side of a query that calls the operators."""
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck or sql)


# Joins --------------------------------------------------------------------------------------------
both("join_inner_chunks", "SELECT l_orderkey, l_linenumber, p_brand, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_size < 5")
oracle("join_label_fallback", """SELECT d.doc_id, coalesce(l.quality, CAST(CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS INT)) AS label,
CASE WHEN l.doc_id IS NULL THEN 1.0D ELSE 3.0D END AS weight FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""".replace("D ELSE", "D ELSE"),
     """SELECT d.doc_id, coalesce(l.quality, CAST(CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS INT)) AS label, CASE WHEN l.doc_id IS NULL THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS weight
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""")
oracle("anti_join_unlabelled", "SELECT d.doc_id, d.lang FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
oracle("anti_join_composite", """SELECT n.n_nationkey, s.o_orderpriority FROM {nation} n CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {orders}) s
WHERE NOT EXISTS (SELECT 1 FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = n.n_nationkey AND o.o_orderpriority = s.o_orderpriority AND o.o_totalprice > 450000)""")
both("join_kinds", """SELECT 'inner' AS kind, count(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey UNION ALL SELECT 'left', count(*) FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey
UNION ALL SELECT 'full', count(*) FROM {supplier} FULL JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 0 UNION ALL SELECT 'semi', count(*) FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
UNION ALL SELECT 'anti', count(*) FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) UNION ALL SELECT 'cross', count(*) FROM {region} CROSS JOIN {nation}""")
oracle("lookup_with_default", "SELECT c.c_custkey, coalesce(n.n_name, '?') AS nation FROM {customer} c LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3")
oracle("semi_join_list", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
oracle("reverse_unknown_ids", "SELECT l.doc_id FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT -1 - count(*) FROM {labels}")

# Aggregations -------------------------------------------------------------------------------------
both("pricing_summary", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
oracle("counts_by_category", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
oracle("conditional_counts", "SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases, count(*) AS n FROM {events} GROUP BY user_id")
oracle("slices_grouping_sets", """SELECT n_name, o_orderpriority, o_orderstatus, CAST(grouping(n_name) * 4 + grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS INT) AS slice, count(*) AS n, round(avg(o_totalprice), 2) AS mean
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((n_name), (o_orderpriority), (o_orderstatus))""")
both("cube_rollup", """SELECT 'cube' AS kind, r_name, c_mktsegment, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY CUBE (r_name, c_mktsegment)
UNION ALL SELECT 'rollup', r_name, c_mktsegment, count(*) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""")
oracle("group_mean_sd", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS sd, min(p_size) AS low, max(p_size) AS high FROM {part} GROUP BY p_brand")
oracle("percentiles_linear", "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type",
     "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type")
oracle("distinct_in_order", "SELECT source, min(doc_id) AS first_id FROM {documents} GROUP BY source")
oracle("latest_per_setting", "SELECT user_id, event_type, max(event_id) AS last_id, max_by(value, event_id) AS last_value FROM {events} GROUP BY user_id, event_type",
     "SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS last_value FROM {events} GROUP BY user_id, event_type")
oracle("cost_estimate", "SELECT lang, CAST(sum(200 + floor(n_chars * 0.35)) AS BIGINT) AS tokens FROM {documents} GROUP BY lang")
both("setops", """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) a UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) b
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM {customer} UNION SELECT s_nationkey FROM {supplier}) c UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) d""")

# Windows ------------------------------------------------------------------------------------------
oracle("latest_order_per_customer", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM {orders}) x WHERE r = 1")
oracle("distinct_on_latest", "SELECT user_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE)) d) x WHERE r = 1")
both("frames", """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS priority_rank FROM {orders}""")
oracle("leave_one_out_mean", """SELECT l_orderkey, l_linenumber, round(coalesce((sum(l_quantity) OVER (PARTITION BY l_orderkey) - l_quantity) / nullif(count(*) OVER (PARTITION BY l_orderkey) - 1, 0), l_quantity), 6) AS others_mean,
round(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY l_orderkey) - 1, 1), 6) AS rank_norm FROM {lineitem}""")
oracle("quiet_stretch", """SELECT user_id, max(gap) AS longest FROM (SELECT user_id, CAST(unix_timestamp(ts) - unix_timestamp(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap FROM {events}) g GROUP BY user_id""",
     """SELECT user_id, max(gap) AS longest FROM (SELECT user_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM {events}) g GROUP BY user_id""")
oracle("consecutive_dedupe", "SELECT user_id, count(*) AS kept FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x WHERE prev IS NULL OR prev <> event_type GROUP BY user_id")
oracle("gaps_islands_turns", """SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM (SELECT user_id, event_type, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS chg FROM {events}) a) b GROUP BY user_id, island""".replace("sum(chg) OVER", "CAST(sum(chg) OVER").replace("UNBOUNDED PRECEDING) AS island", "UNBOUNDED PRECEDING) AS BIGINT) AS island"))
oracle("timeline_union", """SELECT t, stream, id, CAST(row_number() OVER (PARTITION BY t ORDER BY stream, id) AS BIGINT) AS place FROM (SELECT CAST(o_orderdate AS DATE) AS t, 0 AS stream, o_orderkey AS id FROM {orders}
UNION ALL SELECT CAST(l_shipdate AS DATE), 1, l_orderkey * 10 + l_linenumber FROM {lineitem}) u""")
oracle("carry_forward", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM {events}""",
     """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM {events}""")
oracle("tumbling_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY date_trunc('hour', ts), event_type")
oracle("sliding_counts", """SELECT w.start AS start, count(*) AS n FROM (SELECT window(ts, '2 hours', '1 hour') AS w FROM {events}) x GROUP BY w.start""",
     """SELECT date_trunc('hour', ts) - to_hours(k) AS start, count(*) AS n FROM {events}, (SELECT unnest([0, 1]) AS k) GROUP BY 1""")
oracle("session_windows", """SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')""",
     """SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM {events}) a) b GROUP BY user_id, s""")
oracle("dedupe_watermark", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS first_id FROM {events} GROUP BY user_id, event_type, CAST(ts AS DATE)")
oracle("ordinal_ids", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS ordinal FROM {orders} WHERE o_orderstatus <> 'F'")
oracle("average_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0D AS r FROM {part}",
     "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM {part}")
oracle("last_informative_event", """SELECT user_id, max_by(event_type, event_id) AS blocker FROM {events} WHERE event_type = 'purchase' OR (event_type = 'error' AND value > 0) GROUP BY user_id""",
     """SELECT user_id, arg_max(event_type, event_id) AS blocker FROM {events} WHERE event_type = 'purchase' OR (event_type = 'error' AND value > 0) GROUP BY user_id""")
oracle("soft_delete", "SELECT c_custkey, c_name FROM {customer} WHERE coalesce(CASE WHEN c_acctbal < 0 THEN 'retire' END, '') <> 'retire'")
oracle("masked_reads", "SELECT substr(c_name, 1, 4) AS masked, c_custkey, c_mktsegment FROM {customer} WHERE c_acctbal > 5000")
oracle("counts_with_reference_kinds", "SELECT k.kind, count(e.event_id) AS n FROM (SELECT DISTINCT event_type AS kind FROM {events} UNION SELECT 'mock') k LEFT JOIN {events} e ON e.event_type = k.kind AND e.value > 50 GROUP BY k.kind")
oracle("replace_subset", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_custkey >= 100 UNION ALL SELECT o_orderkey, 'X' FROM {orders} WHERE o_custkey < 100")
both("json_props", "SELECT event_id, get_json_object(props, '$.k') AS k, length(props) AS n FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::INTEGER AS n FROM {events}")
oracle("budget_left", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE greatest(20 - count(*), 0) END AS left_calls FROM {events} WHERE event_type = 'click' GROUP BY user_id")
oracle("usage_row_today", "SELECT user_id, CASE WHEN max(CAST(ts AS DATE)) = DATE '2024-01-30' THEN count(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN 1 END) ELSE 0 END AS used FROM {events} GROUP BY user_id")
oracle("delete_by_owner", "SELECT count(*) AS kept, count(CASE WHEN user_id = 7 THEN 1 END) AS deleted FROM {events}")
oracle("pivot_confusion", "SELECT lang, count(CASE WHEN quality = 0 THEN 1 END) AS bad, count(CASE WHEN quality = 1 THEN 1 END) AS good FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang")


# The same through the operators -------------------------------------------------------------------
def _events(spark, sf):
    return table(spark, sf, "events")


@query()
def join_label_fallback(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    guess = F.when(F.col("n_chars") > 200, 1).otherwise(0)
    return relations.first_known(docs, table(spark, sf, "labels"), ["doc_id"], "quality", guess, 3.0, 1.0).select("doc_id", "label", "weight")


@query()
def anti_join_unlabelled(spark, sf):
    return relations.not_done(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query()
def anti_join_composite(spark, sf):
    orders = table(spark, sf, "orders")
    dear = orders.where("o_totalprice > 450000").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority")
    return relations.pairs_not_done(table(spark, sf, "nation").select("n_nationkey"), orders.select("o_orderpriority").distinct(), dear, ["n_nationkey", "o_orderpriority"])


@query()
def lookup_with_default(spark, sf):
    nations = table(spark, sf, "nation").where("n_regionkey < 3")
    return relations.lookup(table(spark, sf, "customer"), nations, "c_nationkey", "n_nationkey", "n_name", "?").select("c_custkey", F.col("found").alias("nation"))


@query()
def semi_join_list(spark, sf):
    members = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return relations.chosen(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], members, "o_custkey", "c_custkey").select("o_orderkey", "o_orderstatus")


@query()
def reverse_unknown_ids(spark, sf):
    labels = table(spark, sf, "labels")
    return relations.unknown_ids(labels, table(spark, sf, "documents"), "doc_id").unionByName(labels.agg((-1 - F.count(F.lit(1))).alias("doc_id")))


@query()
def counts_by_category(spark, sf):
    return relations.counts(_events(spark, sf), "event_type", "user_id").withColumnRenamed("distinct", "users")


@query()
def conditional_counts(spark, sf):
    return relations.count_kinds(_events(spark, sf), "user_id", "event_type", {"errors": "error", "purchases": "purchase"})


@query()
def slices_grouping_sets(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return relations.sliced(o, ["n_name", "o_orderpriority", "o_orderstatus"], "o_totalprice")


@query()
def group_mean_sd(spark, sf):
    return relations.spread(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_size")


@query()
def percentiles_linear(spark, sf):
    return relations.percentiles(_events(spark, sf), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query()
def distinct_in_order(spark, sf):
    return relations.first_ids(table(spark, sf, "documents"), "source", "doc_id")


@query()
def latest_per_setting(spark, sf):
    return relations.last_by(_events(spark, sf), ["user_id", "event_type"], "event_id", last_value="value")


@query()
def cost_estimate(spark, sf):
    return relations.cost(table(spark, sf, "documents"), "lang", "n_chars")


@query()
def latest_order_per_customer(spark, sf):
    return state.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query()
def distinct_on_latest(spark, sf):
    days = _events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return state.latest(days, ["user_id"], [F.desc("day")])


@query()
def leave_one_out_mean(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return relations.leave_one_out(rows, "l_orderkey", "l_quantity", [F.desc("l_quantity"), F.col("l_linenumber")]).drop("l_quantity")


@query()
def quiet_stretch(spark, sf):
    return relations.longest_gap(_events(spark, sf), "user_id", "ts", ["ts", "event_id"])


@query()
def consecutive_dedupe(spark, sf):
    kept = state.consecutive(_events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query()
def gaps_islands_turns(spark, sf):
    runs = state.islands(_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query()
def timeline_union(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return relations.merged_streams([(o, F.to_date("o_orderdate"), F.col("o_orderkey")), (l, F.to_date("l_shipdate"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))])


@query()
def carry_forward(spark, sf):
    e = _events(spark, sf).withColumn("signup", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return e.select("event_id", "user_id", state.carry_forward(e, ["user_id"], ["ts", "event_id"], "signup", strictly_before=True).alias("last_signup"))


@query()
def tumbling_counts(spark, sf):
    e = _events(spark, sf)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return e.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def sliding_counts(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding(e, "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def session_windows(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.sessions(e, "30 minutes", "user_id")
    return out.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"))


@query()
def dedupe_watermark(spark, sf):
    e = _events(spark, sf).withColumn("day", F.to_date("ts"))
    return state.latest(e, ["user_id", "event_type", "day"], [F.col("event_id")]).select("user_id", "event_type", "day", F.col("event_id").alias("first_id"))


@query()
def ordinal_ids(spark, sf):
    return relations.ordinals(table(spark, sf, "orders").where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey").select("o_orderkey", "ordinal")


@query()
def average_ranks(spark, sf):
    return relations.ranks_within(table(spark, sf, "part"), "p_brand", "p_size").select("p_partkey", "r")


@query()
def last_informative_event(spark, sf):
    e = _events(spark, sf).where("event_type = 'purchase' OR (event_type = 'error' AND value > 0)")
    return relations.last_by(e, ["user_id"], "event_id", blocker="event_type").select("user_id", "blocker")


@query()
def soft_delete(spark, sf):
    return relations.not_retired(table(spark, sf, "customer"), F.when(F.col("c_acctbal") < 0, "retire")).select("c_custkey", "c_name")


@query()
def masked_reads(spark, sf):
    return relations.masked(table(spark, sf, "customer"), "c_name", 4, F.col("c_acctbal") > 5000).select("masked", "c_custkey", "c_mktsegment")


@query()
def counts_with_reference_kinds(spark, sf):
    e = _events(spark, sf)
    kinds = e.select(F.col("event_type").alias("kind")).union(spark.createDataFrame([("mock",)], "kind string"))
    return relations.count_all_kinds(e, kinds, "event_type", F.col("value") > 50)


@query()
def replace_subset(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_custkey < 100").withColumn("o_orderstatus", F.lit("X"))
    return relations.replaced(o, new, F.col("o_custkey") < 100).select("o_orderkey", "o_orderstatus")


@query()
def budget_left(spark, sf):
    return relations.left_of_budget(_events(spark, sf).where("event_type = 'click'"), "user_id", 20, F.col("user_id") % 5 == 0)


@query()
def usage_row_today(spark, sf):
    return relations.used_on(_events(spark, sf), "user_id", F.to_date("ts"), F.to_date(F.lit("2024-01-30")))


@query()
def delete_by_owner(spark, sf):
    _, told = relations.deleted(_events(spark, sf), F.col("user_id") == 7)
    return told.select(F.col("all").alias("kept"), "deleted")


@query()
def pivot_confusion(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return relations.confusion(j, "lang", "quality", {"bad": 0, "good": 1})


@query("SELECT e.event_id, e.user_id, p.event_id AS as_of FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type = 'click'")
def as_of_join(spark, sf):
    """The last purchase at or before each click."""
    e = _events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return relations.as_of(e.where("event_type = 'click'"), bought, "user_id", "ts", "event_id").select("event_id", "user_id", "as_of")


# State --------------------------------------------------------------------------------------------
NOW = "TIMESTAMP '1998-12-01 00:00:00'"
ATTEMPT = "SELECT o_orderkey AS id, o_custkey AS problem_key, o_orderdate AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'O' THEN 'unsolved' ELSE 'shown' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS hint_max FROM {orders}"
STATUS = "CASE WHEN outcome <> 'solved' THEN outcome WHEN hint_max IS NULL THEN 'clean' WHEN hint_max >= 3 THEN 'heavy' ELSE 'hinted' END"
REVIEW = f"""WITH a AS ({ATTEMPT.replace('{orders}', 'orders')}), r AS (SELECT *, row_number() OVER (PARTITION BY problem_key ORDER BY finished_at DESC, id) AS k, count(*) OVER (PARTITION BY problem_key) AS attempts, bool_or(outcome = 'solved') OVER (PARTITION BY problem_key) AS solved FROM a),
s AS (SELECT problem_key, attempts, solved, {STATUS} AS status, finished_at FROM r WHERE k = 1),
d AS (SELECT *, finished_at + to_days(CASE status WHEN 'heavy' THEN 2 WHEN 'hinted' THEN 7 WHEN 'clean' THEN 21 ELSE 0 END) AS due FROM s)"""


def _reviewed(spark, sf):
    attempts = spark.sql(ATTEMPT, orders=table(spark, sf, "orders"))
    return state.review(attempts, F.to_timestamp(F.lit("1998-12-01 00:00:00")))


@query(f"{REVIEW} SELECT problem_key, attempts, solved, status, due, due <= {NOW} AS is_due, finished_at FROM d")
def problem_history(spark, sf):
    return _reviewed(spark, sf)


@query(f"""{REVIEW} SELECT problem_key, status, finished_at FROM d WHERE due <= {NOW} ORDER BY list_position(['unsolved', 'shown', 'heavy', 'hinted', 'clean'], status), finished_at, problem_key LIMIT 100""")
def review_queue(spark, sf):
    return state.review_queue(_reviewed(spark, sf), 100).select("problem_key", "status", "finished_at")


@query("""SELECT c_custkey, CASE WHEN n.k IS NULL THEN c_name ELSE 'new ' || c_custkey END AS c_name, c_mktsegment FROM customer LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0) n ON n.k = c_custkey
UNION ALL SELECT c_custkey + 10000000, 'new ' || (c_custkey + 10000000), 'NEW' FROM customer WHERE c_custkey % 100 = 0""")
def upsert_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    added = c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_name", F.lit("NEW").alias("c_mktsegment"))
    new = changed.unionByName(added).withColumn("c_name", F.concat(F.lit("new "), F.col("c_custkey").cast("string")))
    return state.upsert(c, new, ["c_custkey"], keep=["c_mktsegment"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def insert_ignore(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("event_type = 'error' AND value > 90").select("user_id").distinct()
    return state.insert_ignore(old, e.where("event_type <> 'error'").select("event_id", "user_id", "event_type"), ["user_id"], "event_id")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def lru_trim(spark, sf):
    return state.lru_trim(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 3, [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_custkey"])


@query("SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100 AS granted FROM events WHERE event_type = 'click'")
def quota_single_cap(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").withColumn("day", F.to_date("ts"))
    return state.reserve_single(e, ["day"], ["ts", "event_id"], 100).select("event_id", "day", "granted")


@query("""SELECT event_id, user_id, coalesce(sum(greatest(0, value)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS granted FROM events""")
def voice_charge(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return state.charge(e, ["user_id", "day"], ["ts", "event_id"], "value", 60.0).select("event_id", "user_id", "granted")


@query()
def quota_coupled(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), "event_id", F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "claude").otherwise("other").alias("engine"))
    return state.reserve_coupled(e, 1, 4, 250)


# Evaluation ---------------------------------------------------------------------------------------
GRADED = "SELECT l.doc_id, CAST(1 + (l.doc_id * 7) % 10 AS DOUBLE) AS truth, greatest(1.0D, least(10.0D, 1 + (l.doc_id * 7) % 10 + ((l.doc_id * 13) % 9 - 4) * 0.75D)) AS pred, ((l.doc_id * 31) % 100) / 100.0D AS frac_hit, l.quality, l.toxic, d.lang FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"
GRADED_DUCK = "g AS (" + re.sub(r"(\d+\.?\d*)D\b", r"\1::DOUBLE", GRADED).replace("{", "").replace("}", "") + ")"


def graded(spark, sf):
    return spark.sql(GRADED, labels=table(spark, sf, "labels"), documents=table(spark, sf, "documents"))


ROUNDED = "greatest(1, least(10, round_even({0}, 0)))"


@query(f"""WITH {GRADED_DUCK}, x AS (SELECT truth AS y, pred AS z, {ROUNDED.format('truth')} AS t, {ROUNDED.format('pred')} AS p, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rz FROM g),
o AS (SELECT sum((t - p) * (t - p)) AS w FROM x), e AS (SELECT sum((a.t - b.p) * (a.t - b.p) * a.n * b.n) / (SELECT count(*) FROM x) AS w FROM (SELECT t, count(*) AS n FROM x GROUP BY t) a, (SELECT p, count(*) AS n FROM x GROUP BY p) b)
SELECT count(*) AS n, round(avg(abs(y - z)), 6) AS mae, round(avg(CASE WHEN abs(t - p) <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within1, round(avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact, round(corr(ry, rz), 6) AS spearman, round(1 - (SELECT w FROM o) / (SELECT w FROM e), 6) AS qwk FROM x""")
def mae_within_qwk_spearman(spark, sf):
    return evaluation.grade_metrics(graded(spark, sf))


VERDICT = "CASE WHEN {0} >= 0.6 THEN 'hit' WHEN {0} >= 0.35 THEN 'partial' ELSE 'miss' END"


@query(f"""WITH {GRADED_DUCK}, v AS (SELECT {VERDICT.format('frac_hit')} AS a, {VERDICT.format('pred / 10')} AS b FROM g), l AS (SELECT a AS label FROM v UNION SELECT b FROM v),
f AS (SELECT label, 2.0::DOUBLE * (SELECT count(*) FROM v WHERE a = label AND b = label) / ((SELECT count(*) FROM v WHERE a = label) + (SELECT count(*) FROM v WHERE b = label)) AS f1 FROM l)
SELECT (SELECT round(avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END), 6) FROM v) AS accuracy, round(avg(f1), 6) AS macro_f1, round(coalesce(max(f1) FILTER (label = 'hit'), 0), 6) AS hit_f1 FROM f""")
def kp_f1(spark, sf):
    v = graded(spark, sf).select(F.expr(VERDICT.format("frac_hit")).alias("a"), F.expr(VERDICT.format("pred / 10")).alias("b"))
    return evaluation.label_scores(v, "a", "b")


@query(f"""WITH {GRADED_DUCK}, v AS (SELECT lang, quality AS a, CAST(frac_hit > 0.3 AS INT) AS b FROM g), t AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = 0) * count(*) FILTER (b = 0) + count(*) FILTER (a = 1) * count(*) FILTER (b = 1) AS cross_ FROM v GROUP BY lang)
SELECT lang, n, round(agree / n::DOUBLE, 6) AS agreement, round(CASE WHEN cross_ / (n * n)::DOUBLE < 1 THEN (agree / n::DOUBLE - cross_ / (n * n)::DOUBLE) / (1 - cross_ / (n * n)::DOUBLE) END, 6) AS kappa FROM t""")
def kappa(spark, sf):
    v = graded(spark, sf).select("lang", F.col("quality").alias("a"), (F.col("frac_hit") > 0.3).cast("int").alias("b"))
    return evaluation.kappa(v, "a", "b", ["lang"])


@query(f"""WITH {GRADED_DUCK}, r AS (SELECT toxic = 1 AS y, rank() OVER (ORDER BY frac_hit) + (count(*) OVER (PARTITION BY frac_hit) - 1) / 2.0::DOUBLE AS r FROM g)
SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def auc_low_confidence(spark, sf):
    return evaluation.auc(graded(spark, sf).withColumn("y", F.col("toxic") == 1), "y", "frac_hit")


KNOTS = ([0.0, 0.2, 0.5, 0.5, 0.9], [1.0, 3.0, 4.5, 5.0, 10.0])


@query(f"""WITH {GRADED_DUCK} SELECT doc_id, round(CASE WHEN frac_hit <= 0.0 THEN 1.0 WHEN frac_hit >= 0.9 THEN 10.0 WHEN frac_hit <= 0.2 THEN 1 + frac_hit * 2 / 0.2::DOUBLE
WHEN frac_hit <= 0.5 THEN 3 + (frac_hit - 0.2) * 1.5 / 0.3::DOUBLE ELSE 5 + (frac_hit - 0.5) * 5 / 0.4::DOUBLE END, 6)::DOUBLE AS calibrated FROM g""")
def isotonic_apply(spark, sf):
    return graded(spark, sf).select("doc_id", F.round(numeric.interpolate(F.col("frac_hit"), *KNOTS), 6).alias("calibrated"))


@query(f"WITH {GRADED_DUCK} SELECT CAST((frac_hit >= 0.25) AS INT) + CAST((frac_hit >= 0.5) AS INT) + CAST((frac_hit >= 0.75) AS INT) AS bin, count(*) AS n, round(avg(truth), 6) AS mean FROM g GROUP BY 1")
def quartile_bins(spark, sf):
    b = numeric.bin_of(F.col("frac_hit"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return graded(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("truth"), 6).alias("mean"))


def _rule_sql() -> str:
    p, f = "pred", "frac_hit"
    rules = {"all": "true", "shipped": f"{p} <= 2.5 AND {f} <= 0.25"}
    rules |= {f"high_{hi}_{fh}": f"{p} >= {hi} AND {f} >= {fh}" for hi in (7.5, 8.0) for fh in (0.6, 0.75)}
    rules |= {f"low_{lo}_{fl}": f"{p} <= {lo} AND {f} <= {fl}" for lo in (2.5, 3.0, 3.5) for fl in (0.15, 0.25)}
    for lo, hi in ((3.0, 8.0), (3.5, 7.5), (3.0, 7.5)):
        rules[f"extremes_{lo}_{hi}"] = f"(({p} <= {lo} AND {f} <= 0.25) OR ({p} >= {hi} AND {f} >= 0.6))"
    for lo, hi in ((3.0, 8.0), (3.5, 7.5)):
        rules[f"escalated_{lo}_{hi}"] = "NOT " + rules[f"extremes_{lo}_{hi}"]
    close = f"CASE WHEN abs({ROUNDED.format('pred')} - {ROUNDED.format('truth')}) <= 1 THEN 1.0::DOUBLE ELSE 0 END"
    return f"WITH {GRADED_DUCK} " + " UNION ALL ".join(
        f"SELECT '{k}' AS rule, count(*) FILTER ({r}) AS n, round(count(*) FILTER ({r}) / count(*)::DOUBLE, 6) AS coverage, round(avg({close}) FILTER ({r}), 6) AS within1, round(avg(abs(pred - truth)) FILTER ({r}), 6) AS mae FROM g" for k, r in rules.items()
    )


@query(_rule_sql())
def rule_grid(spark, sf):
    return evaluation.rule_grid(graded(spark, sf), evaluation.cascade_rules())


SEEDS = "SELECT lang AS seed, {0} AS mae, {1} AS qwk FROM g GROUP BY lang"


@query(f"""WITH {GRADED_DUCK}, a AS (SELECT lang AS seed, avg(abs(truth - pred)) AS mae, avg(frac_hit) + 0.5 AS qwk FROM g GROUP BY lang), b AS (SELECT lang AS seed, avg(abs(truth - pred)) + 0.1 AS mae, avg(frac_hit) AS qwk FROM g GROUP BY lang)
SELECT count(*) AS seeds, coalesce(bool_and(a.qwk >= b.qwk + 0.03 AND a.mae < b.mae), false) AS quality_pass, true AS latency_pass, coalesce(bool_and(a.qwk >= b.qwk + 0.03 AND a.mae < b.mae), false) AS pass FROM a JOIN b USING (seed)""")
def rule_verdict(spark, sf):
    g = graded(spark, sf).groupBy(F.col("lang").alias("seed")).agg(F.avg(F.abs(F.col("truth") - F.col("pred"))).alias("mae"), F.avg("frac_hit").alias("qwk"))
    return evaluation.rule_verdict(g.withColumn("qwk", F.col("qwk") + 0.5), g.withColumn("mae", F.col("mae") + 0.1), 120.0)


@query(f"""WITH {GRADED_DUCK} SELECT count(*) AS n, round(avg(CASE WHEN truth = round_even(pred, 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact, round(avg(abs(truth - round_even(pred, 0))), 6) AS mae, max(abs(truth - round_even(pred, 0))) AS max_diff FROM g""")
def two_pass_consistency(spark, sf):
    g = graded(spark, sf)
    rows = g.select("doc_id", F.lit("main").alias("pass"), F.col("truth").alias("score")).unionByName(g.select("doc_id", F.lit("retry").alias("pass"), F.rint("pred").alias("score")))
    return evaluation.regrade_consistency(rows, "doc_id", "main", "retry")


@query("""SELECT event_type, list(value ORDER BY value)[greatest(round_even(0.95 * count(*), 0)::INT - 1, 0) + 1] AS p95_round, list(value ORDER BY value)[least(count(*) - 1, floor(0.9 * count(*))::INT) + 1] AS p90_floor FROM events GROUP BY event_type""")
def percentiles_nearest(spark, sf):
    """Two nearest-rank conventions, from ranks instead of lists of values."""
    e = table(spark, sf, "events")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = e.select("event_type", "value", F.row_number().over(Window.partitionBy("event_type").orderBy("value")).alias("r")).join(F.broadcast(n), "event_type")
    a = F.greatest(F.rint(0.95 * F.col("n")).cast("int") - 1, F.lit(0)) + 1
    b = F.least(F.col("n") - 1, F.floor(0.9 * F.col("n"))) + 1
    return r.groupBy("event_type").agg(F.max(F.when(F.col("r") == a, F.col("value"))).alias("p95_round"), F.max(F.when(F.col("r") == b, F.col("value"))).alias("p90_floor"))


@query("SELECT doc_id, fold::INTEGER AS fold FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) % 2 AS fold FROM labels)")
def two_folds(spark, sf):
    return sampling.two_folds(table(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", "fold")
