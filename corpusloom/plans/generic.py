"""Relational operators that a search corpus needs around it, over the star tables and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query, table
from corpusloom.sources.storage import written
from corpusloom.streaming import sketches

REVENUE = "(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))"


def revenue():
    return F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))


@query(f"select l_returnflag, l_linestatus, sum(l_quantity)::double as sum_qty, sum({REVENUE})::double as revenue, count(*)::bigint as n, round(avg(l_discount), 6) as avg_disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def rel_pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), F.sum(revenue()).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query(f"select o_orderkey, sum({REVENUE})::double as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by 1 order by 2 desc, 1 limit 10")
def rel_top_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.sum(revenue()).cast("double").alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("select event_type, user_id % 3 as g, count(*)::bigint as n from events group by cube (event_type, user_id % 3)")
def agg_cube(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3).cube("event_type", "g").agg(F.count(F.lit(1)).alias("n"))


@query("select r_name, n_name, count(*)::bigint as n, grouping(n_name)::int as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def agg_rollup(spark, sf_dir):
    place = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping("n_name").cast("int").alias("total"))


@query("select c_mktsegment, c_nationkey, count(*)::bigint as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())")
def agg_grouping_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_orderpriority order by o_orderdate, o_orderkey) as q, round(cume_dist() over w, 6) as c from orders window w as (partition by o_orderpriority order by o_orderdate)")
def win_ranking(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate")
    n = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(n).cast("long").alias("q"), F.round(F.cume_dist().over(w), 6).alias("c"))


@query("select event_id, round(avg(value) over w, 6) as near, lag(value) over (partition by user_id order by event_id) as before from events window w as (partition by user_id order by event_id rows between 2 preceding and 2 following)")
def win_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6).alias("near"), F.lag("value").over(w).alias("before"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def jon_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def jon_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, count(o_orderkey)::bigint as n from customer left join orders on o_custkey = c_custkey group by 1")
def jon_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("select e.event_id, p.event_id as purchase_id from events e left join events p on p.user_id = e.user_id and p.event_type = 'purchase' and e.event_type = 'click' and p.ts < e.ts where e.event_type = 'click' qualify row_number() over (partition by e.event_id order by p.ts desc, p.event_id desc) = 1")
def jon_as_of(spark, sf_dir):
    """The last purchase before each click: one union and one window, no range join."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    # of equal times the clicks come first, so only earlier purchases are seen
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", bought).where("event_type = 'click'").select("event_id", "purchase_id")


@query("select n_nationkey as k from nation union all select c_nationkey from customer where c_custkey < 20")
def set_union_all(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).unionByName(table(spark, sf_dir, "customer").where("c_custkey < 20").select(F.col("c_nationkey").alias("k")))


@query("select c_nationkey as k from customer except select s_nationkey from supplier where s_suppkey < 8")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").where("s_suppkey < 8").select("s_nationkey"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("select p_type, p_partkey, p_retailprice from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as r from part) where r <= 5")
def srt_group_top_k(spark, sf_dir):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").select("p_type", "p_partkey", "p_retailprice")


@query("select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*)::bigint as n from events group by 1, 2")
def str_rate_windows(spark, sf_dir):
    """Counts per five minutes and label; the stream of the same plan is in corpusloom.streaming."""
    from corpusloom.streaming.events import rates

    return rates(table(spark, sf_dir, "events"))


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, quantile_disc(value, 0.95) as p95 from events group by 1, 2")
def str_percentile_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return e.agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "p95")


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(value)::bigint as n, true as within from events group by 1, 2")
def str_sketch_windows(spark, sf_dir):
    """Sketches of an hour, stored, merged into days; whether the rank of their 0.95 quantile is within the sketches' error, by all events."""
    e = table(spark, sf_dir, "events")
    hours = written(sketches.windows(e, "value", "1 hour", "event_type"), "sketches")
    days = sketches.longer(hours, "1 day", "event_type").select("window_start", "event_type", "n", sketches.quantile(0.95).alias("q"))
    met = e.withColumn("window_start", F.window("ts", "1 day")["start"]).join(days, ["window_start", "event_type"])
    rank = met.groupBy("window_start", "event_type", "n").agg(F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    # a rank of n values cannot be told closer than one of them
    near = (F.col("below") <= (0.95 + sketches.ERROR) * F.col("n") + 1) & (F.col("upto") >= (0.95 - sketches.ERROR) * F.col("n") - 1)
    return rank.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", near.alias("within"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from (select * from g)) select user_id, min(ts) as begin, count(*)::bigint as n from s group by user_id, sid""")
def str_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return e.agg(F.min("ts").alias("begin"), F.count(F.lit(1)).alias("n")).select("user_id", "begin", "n")


@query("select event_type, width_bucket_like as bucket, count(*)::bigint as n from (select event_type, least(10, floor(value / 50))::bigint as width_bucket_like from events) group by 1, 2")
def agg_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bucket", F.least(F.lit(10), F.floor(F.col("value") / 50)).cast("long"))
    return e.groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("select n_name, coalesce(sum(case when c_mktsegment = 'BUILDING' then 1 end), 0)::bigint as building, coalesce(sum(case when c_mktsegment = 'MACHINERY' then 1 end), 0)::bigint as machinery from customer join nation on c_nationkey = n_nationkey group by 1")
def agg_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return out.select("n_name", F.coalesce("BUILDING", F.lit(0)).cast("long").alias("building"), F.coalesce("MACHINERY", F.lit(0)).cast("long").alias("machinery"))
