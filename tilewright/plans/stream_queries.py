"""Stream operators in batch form over events; tests hold the streams against them."""

from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.plans.registry import query
from tilewright.session import table
from tilewright.streaming import limits, views


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


@query("""
with e as (select user_id, event_id, (epoch_us(ts) // 1000) as t from events), n as (select *, row_number() over (partition by user_id order by t, event_id) as k from e),
c as (select a.user_id, a.event_id, count(*) filter (where b.t >= a.t - 3600000) as burst_count, count(*) filter (where b.t >= a.t - 86400000) as long_count
      from n a join n b on a.user_id = b.user_id and b.k <= a.k and b.k > a.k - 8 group by 1, 2)
select *, burst_count > 1 or long_count > 4 as denied from c
""")
def rate_limit_dual(spark, sf_dir):
    e = limits.rate_limited(events(spark, sf_dir), "user_id", "t", "event_id", 1, 3_600_000, 4, 86_400_000, 8)
    return e.select("user_id", "event_id", "burst_count", "long_count", "denied")


@query("""
with recursive e as (select user_id, event_id, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id order by ts, event_id) as k from events), g as (
  select user_id, event_id, t, k, t as last, true as passed from e where k = 1 union all
  select e.user_id, e.event_id, e.t, e.k, case when e.t - g.last >= 36000000 then e.t else g.last end, e.t - g.last >= 36000000 from g join e on e.user_id = g.user_id and e.k = g.k + 1
)
select user_id, event_id, t, passed from g
""")
def rerequest_gate(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "t")
    return limits.gated(e, ["user_id"], "t", "event_id", 36_000_000)


@query("select user_id || ':' || event_type as message_id, count(*) as seen from events group by 1")
def dedup_message_id(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("message_id", text.scoped_key(F.col("user_id"), F.col("event_type")))
    once = limits.distinct_messages(e.select("message_id", "ts"), "message_id", "ts").select("message_id")
    return once.join(e, "message_id").groupBy("message_id").agg(F.count("*").alias("seen"))


@query("select event_id, n::int as attempt, (epoch_us(ts) // 1000) + 1100 + case when n = 0 then 0 else (2 ** n - 1) * 3000 end::bigint as retry_at from events, (select unnest(range(10)) as n)")
def retry_schedule(spark, sf_dir):
    return limits.retry_schedule(events(spark, sf_dir).select("event_id", "t"), "t").select("event_id", "attempt", "retry_at")


@query("select event_id, (least(event_id % 15, 10) * 1000)::bigint as wait, (3000 * 2 ** (event_id % 10))::bigint as delay from events")
def reconnect_delays(spark, sf_dir):
    n = F.col("event_id")
    return events(spark, sf_dir).select("event_id", limits.reconnect_delay(n % 15).cast("long").alias("wait"), limits.retry_delay(n % 10).alias("delay"))


@query("select user_id, max_by(event_type, (epoch_us(ts) // 1000)) as event_type, max((epoch_us(ts) // 1000)) as t from events group by 1")
def progress_latest(spark, sf_dir):
    return views.latest_progress(events(spark, sf_dir).select("user_id", "event_type", "t"), "user_id", "t")


@query("""
with recursive n as (select user_id, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id order by ts) as done from events),
e as (select user_id, t, done, row_number() over (partition by user_id order by t, done) as k from n where done % 5 = 0), g as (
  select user_id, done, t, k, t as last, true as passed from e where k = 1 union all
  select e.user_id, e.done, e.t, e.k, case when e.t - g.last >= 3600000 then e.t else g.last end, e.t - g.last >= 3600000 from g join e on e.user_id = g.user_id and e.k = g.k + 1
)
select user_id, t, done from g where passed
""")
def progress_throttle(spark, sf_dir):
    from pyspark.sql import Window

    e = events(spark, sf_dir)
    e = e.select("user_id", "t", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).alias("done"))
    return limits.throttled_progress(e, "user_id", "done", "t", 5, 3_600_000)


@query("select user_id, event_id, round(avg(value) over w, 8) as mean_ms, round(1000 / avg(value) over w, 6) as fps from events window w as (partition by user_id order by (epoch_us(ts) // 1000) rows between 29 preceding and current row)")
def rolling_fps(spark, sf_dir):
    r = limits.rolling_rate(events(spark, sf_dir), "user_id", "t", "value")
    return r.select("user_id", "event_id", F.round("mean_ms", 8).alias("mean_ms"), F.round("fps", 6).alias("fps"))


@query("select event_type, le, count(*) filter (where value <= le) as n from events, (select unnest([1.0::double, 10, 50, 100, 500]) as le) group by all")
def latency_histogram(spark, sf_dir):
    return limits.latency_histogram(events(spark, sf_dir), "event_type", "value", [1, 10, 50, 100, 500])


@query("""
with e as (select user_id, (epoch_us(ts) // 1000) as t, value from events), r as (select *, t - lag(t) over (partition by user_id order by t) as dt from e where t >= (select max(t) from e) - 864000000)
select user_id, round(sum(value) filter (where dt > 0) / sum(dt) filter (where dt > 0) * 1000, 9) as vx, round(sum(-value) filter (where dt > 0) / sum(dt) filter (where dt > 0) * 1000, 9) as vy from r group by 1
""")
def velocity(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("minus", -F.col("value"))
    now = e.agg(F.max("t")).first()[0]
    v = limits.velocity(e, "user_id", "t", "value", "minus", F.lit(now), 864_000_000)
    return v.select("user_id", F.round("vx", 9).alias("vx"), F.round("vy", 9).alias("vy"))
