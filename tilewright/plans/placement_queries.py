"""Placement queries: orders are tiles, suppliers replicas of the shards of nations, line items a log."""

from pyspark.sql import functions as F

from tilewright.operators import placement
from tilewright.plans.registry import query
from tilewright.session import table

NOW, TIMEOUT = 100_000, 10_000


_TOP = "xor(c >> 8, x)"
_FOLD = f"xor({_TOP}, ({_TOP}) >> 4)"


@query(f"""
with h as (
  select o_orderkey, md5(o_orderkey::varchar) || printf('%02x000000', o_orderkey % 200) || printf('%02x000000', o_custkey % 200) || printf('%02x000000', o_orderkey % 9) as h from orders
), b as (
  select o_orderkey, list_transform(range(1, 29), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::int) as bytes from h
)
select o_orderkey, list_reduce(list_prepend(0, bytes), lambda c, x: xor(xor(((c & 255) << 8), (({_FOLD}) << 12) & 65535), xor((({_FOLD}) << 5) & 65535, {_FOLD})))::int % 16384 as slot from b
""")
def slot_route(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", placement.slot(F.unhex(F.md5(k.cast("string"))), k % 200, F.col("o_custkey") % 200, k % 9).alias("slot"))


@query("select s::int as slot, (s * 7 // 16384)::int as shard from (select unnest(range(16384)) as s)")
def slot_table(spark, sf_dir):
    return placement.slot_table(spark, 7)


@query("""
with t as (select o_orderkey, (o_orderkey * 31 % 16384)::int as slot, (o_custkey % 5)::int as held_by from orders), o as (select *, (slot * 5 // 16384)::int as shard from t)
select o_orderkey, held_by, shard, row_number() over (partition by held_by order by o_orderkey)::int as turn from o where held_by <> shard
""")
def misplaced(spark, sf_dir):
    k = F.col("o_orderkey")
    slot = (k * 31 % 16384).cast("int")
    t = table(spark, sf_dir, "orders").select("o_orderkey", slot.alias("slot"), (F.col("o_custkey") % 5).cast("int").alias("held_by"), placement.slot_owner(slot, 5).alias("shard"), k.alias("stored_at"), F.lit(0).alias("level"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    return placement.misplaced(t).select("o_orderkey", "held_by", "shard", "turn")


def replicas(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("shard_id"), F.col("s_name").alias("name"), F.when(k % 4 == 0, "master").otherwise("replica").alias("role"), (k % 3 != 0).alias("ready"),
        (NOW - k * 397 % 20_000).alias("last_heartbeat"), F.when(k % 5 != 0, k * 13 % 100).alias("lag"), (k * 17 % 1000).alias("offset"), (k % 6).alias("config_epoch"),
    )


REPLICAS = """
r as (select s_nationkey as shard_id, s_name as name, case when s_suppkey % 4 = 0 then 'master' else 'replica' end as role, s_suppkey % 3 <> 0 as ready,
  100000 - s_suppkey * 397 % 20000 as hb, case when s_suppkey % 5 <> 0 then s_suppkey * 13 % 100 end as lag, s_suppkey * 17 % 1000 as off, s_suppkey % 6 as config_epoch from supplier),
f as (select *, ready and 100000 - hb <= 10000 as fresh from r),
b as (select shard_id, name as promote from (select *, row_number() over (partition by shard_id order by coalesce(lag, 9223372036854775807), name) as k from f where fresh and role = 'replica') where k = 1)
"""


@query(f"with {REPLICAS} select * from b")
def best_replica(spark, sf_dir):
    return placement.best_replica(replicas(spark, sf_dir), NOW, TIMEOUT)


@query(f"""with {REPLICAS}, m as (select shard_id, bool_or(role = 'master' and fresh) as healthy from f group by 1)
select m.shard_id, promote, (select count(*) from f where f.shard_id = m.shard_id and role = 'master')::int as demoted, shard_id::bigint % 4 + 1 as new_epoch
from m join b using (shard_id) where not healthy and shard_id % 7 <> 0""")
def failover(spark, sf_dir):
    r = replicas(spark, sf_dir)
    epochs = r.select("shard_id").distinct().select("shard_id", (F.col("shard_id").cast("long") % 4).alias("epoch"), (F.col("shard_id") % 7 == 0).alias("cooldown"))
    return placement.failover(r, epochs, NOW, TIMEOUT).select("shard_id", "promote", F.size("demote").alias("demoted"), "new_epoch")


@query(f"with {REPLICAS} select n_nationkey as shard_id, coalesce(max(off), 0) as current_offset, coalesce(max(config_epoch), 0) as config_epoch, count(*) filter (where ready) as ready_replicas from nation left join r on shard_id = n_nationkey group by 1")
def shard_summary(spark, sf_dir):
    shards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shard_id"))
    return placement.with_status(shards, placement.shard_summary(replicas(spark, sf_dir)))


@query("""
select n_regionkey as cluster, case when not bool_and(n_nationkey % 11 <> 0) then 'Degraded' when bool_and(n_nationkey >= 3 and n_nationkey % 13 <> 1) then 'Ready' else 'Reconciling' end as phase from nation group by 1
""")
def cluster_phase(spark, sf_dir):
    k = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), k.alias("config_epoch"), F.lit(3).alias("target"), (k % 11 != 0).alias("healthy"), (k % 13 == 1).cast("int").alias("migration_queue_len"), F.lit(0).alias("misplaced_tiles"))
    return placement.cluster_phase(s, "cluster", "target", "healthy")


@query("select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber desc) as k from lineitem) where k = 1")
def log_latest(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"))
    return placement.applied(log, "l_partkey", "offset").drop("offset")


@query("select l_suppkey, batch, count(*) as entries from (select l_suppkey, (row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) - 1) // 128 as batch from lineitem) group by all")
def log_batches(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"))
    return placement.log_batches(log, "l_suppkey", "offset").groupBy("l_suppkey", "batch").agg(F.count("*").alias("entries"))


@query("""
select s_suppkey, greatest(0, 900 - s_suppkey * 17 % 1000) as lag, case when 900 < s_suppkey * 17 % 1000 then 'reject' when 900 = s_suppkey * 17 % 1000 then 'heartbeat' when s_suppkey * 17 % 1000 + 1 < 500 then 'snapshot' else 'batches' end as action from supplier
""")
def replica_lag(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(900).alias("last_offset"), (F.col("s_suppkey") * 17 % 1000).alias("applied_offset"), F.lit(500).alias("backlog_start"))
    return placement.sync_plan(s).select("s_suppkey", placement.lag(F.col("last_offset"), F.col("applied_offset")).alias("lag"), "action")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'not_master' when o_orderkey % 7 = 0 then 'no_epoch' when o_orderkey % 3 <> 1 then 'not_owner' else 'ok' end as status from orders")
def write_fence(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, "replica").otherwise("master").alias("role"), F.when(k % 7 == 0, 0).otherwise(4).alias("epoch"), (k % 3).alias("shard"), F.lit(1).alias("local"))
    return t.select("o_orderkey", placement.write_status().alias("status"))


@query("""
select o_custkey, o_orderkey, e > coalesce(max(e) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), -1) as accepted
from (select o_custkey, o_orderkey, o_orderkey % 10 as e from orders)
""")
def epoch_install(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 10).alias("e"))
    return placement.installed(c, "o_custkey", "e", "o_orderkey").select("o_custkey", "o_orderkey", "accepted")


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 1 when o_orderkey % 2 = 0 then o_orderkey % 4 + 1 else o_orderkey % 4 end::bigint as epoch from orders")
def epoch_step(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", placement.next_epoch(k % 4, k % 2, F.lit(1)).cast("long").alias("epoch"))
