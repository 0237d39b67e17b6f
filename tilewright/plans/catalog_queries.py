"""Catalogue queries: customers are parents, orders their children, suppliers the sources of nations."""

from pyspark.sql import functions as F

from tilewright.operators import catalog
from tilewright.plans.registry import query
from tilewright.session import table

DAY = 1_700_000_000_000


@query("""
with page as (
  select c_custkey, c_name, count(*) over () as full_count from customer where c_mktsegment = 'BUILDING' order by c_name, c_custkey limit 50
), agg as (
  select o_custkey, count(*) as n_children, sum(o_totalprice) as total from orders where o_custkey in (select c_custkey from page) group by 1
)
select c_custkey, c_name, full_count, coalesce(n_children, 0) as n_children, round(coalesce(total, 0), 2) as total
from page left join agg on c_custkey = o_custkey
""")
def paged_children(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    children = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    page = catalog.paged_with_children(parents, children, "c_custkey", "o_custkey", ["c_name", "c_custkey"], {"total": "o_totalprice"}, limit=50)
    return page.withColumn("total", F.round("total", 2))


@query("""
with p as (select p_partkey, p_name, count(*) over () as full_count from part order by p_name, p_partkey limit 40 offset 100)
select *, 100 + (select count(*) from p) < full_count as truncated from p
""")
def paged_list_truncated(spark, sf_dir):
    return catalog.with_truncated(catalog.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 40, 100), 100)


@query("select c_custkey, c_name from customer where c_acctbal >= 0 and c_nationkey % 3 <> 0")
def visible_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, DAY)).withColumn("private", F.col("c_nationkey") % 3 == 0)
    return c.where(catalog.live() & catalog.visible(False)).select("c_custkey", "c_name")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def equality_filters(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(catalog.matching({"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})).select("o_orderkey", "o_orderpriority")


@query("select p_partkey from part where contains(lower(coalesce(p_name, '')), 'brand#1') or contains(lower(coalesce(p_brand, '')), 'brand#1') or contains(lower(coalesce(p_type, '')), 'brand#1')")
def search_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").where(catalog.search("  BRAND#1 ", "p_name", "p_brand", "p_type")).select("p_partkey")


@query("select s_nationkey, s_suppkey, s_name from (select *, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as k from supplier) where k = 1")
def first_source(spark, sf_dir):
    return catalog.first_per(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_acctbal", "s_suppkey"]).select("s_nationkey", "s_suppkey", "s_name")


def _base(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return c.select("c_custkey", "c_name", F.lit(1).cast("long").alias("created_at"), F.when(F.col("c_custkey") % 5 == 0, 7).cast("long").alias("deleted_at"))


def _changes(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(2).cast("long").alias("created_at"))


@query("""
with b as (select c_custkey, c_name, 1::bigint as created_at, case when c_custkey % 5 = 0 then 7::bigint end as deleted_at from customer where c_custkey % 3 <> 0),
c as (select c_custkey, upper(c_name) as c_name from customer where c_custkey % 2 = 0)
select coalesce(b.c_custkey, c.c_custkey) as c_custkey, coalesce(c.c_name, b.c_name) as c_name, coalesce(b.created_at, 2) as created_at,
       case when c.c_custkey is null then b.deleted_at end as deleted_at
from b full join c on b.c_custkey = c.c_custkey
""")
def upsert_merge(spark, sf_dir):
    return catalog.upsert(_base(spark, sf_dir), _changes(spark, sf_dir), ["c_custkey"], keep=["created_at"], reset=["deleted_at"])


@query("""
select c_custkey, case when c_custkey % 4 = 0 then upper(c_name) else c_name end as c_name,
       case when c_custkey % 4 = 0 then 99::bigint else 1::bigint end as created_at, case when c_custkey % 5 = 0 then 7::bigint end as deleted_at
from customer where c_custkey % 3 <> 0
""")
def patch_partial(spark, sf_dir):
    changes = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).alias("c_name"))
    return catalog.patch(_base(spark, sf_dir), changes, "c_custkey", touched="created_at", now=99)


@query("select c_custkey, case when c_custkey % 3 = 0 then 'NotFound' when c_custkey % 5 = 0 then 'Deleted' else 'Updated' end as outcome from customer where c_custkey % 2 = 0")
def patch_outcome(spark, sf_dir):
    return catalog.patch_outcome(_base(spark, sf_dir), _changes(spark, sf_dir), "c_custkey")


@query("""
select c_custkey, c_name, 1::bigint as created_at, case when c_custkey % 5 = 0 then 7::bigint when c_custkey % 2 = 0 then 50::bigint end as deleted_at
from customer where c_custkey % 3 <> 0
""")
def soft_delete(spark, sf_dir):
    return catalog.soft_delete(_base(spark, sf_dir), _changes(spark, sf_dir), "c_custkey", 50)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey = 3)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return catalog.cascade(gone, "c_custkey", [(orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", "l_orderkey")])[1]


@query("""
with recursive t as (select c_custkey as id, case when c_custkey <= 5 then null when c_custkey % 5 = 0 then c_custkey - 5 when c_custkey % 11 = 0 then -1 else c_custkey // 3 end as parent, c_nationkey from customer),
g as (select id from t where (c_nationkey = 3 and id % 7 = 0) or id = 400 union select t.id from t join g on t.parent = g.id)
select id, parent from t where id not in (select id from g)
""")
def cascade_any_depth(spark, sf_dir):
    """A tree of customers, in part a long chain: some are deleted, and all below them go."""
    k = F.col("c_custkey")
    parent = F.when(k <= 5, None).when(k % 5 == 0, k - 5).when(k % 11 == 0, F.lit(-1)).otherwise(F.floor(k / 3))
    tree = table(spark, sf_dir, "customer").select(k.alias("id"), parent.cast("long").alias("parent"), "c_nationkey")
    return catalog.without_descendants(tree.drop("c_nationkey"), tree.where("(c_nationkey = 3 and id % 7 = 0) or id = 400"), "id", "parent")


def _ledger(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, DAY).alias("dispatched_at"))


@query("select distinct l_orderkey as o_orderkey from lineitem where not (l_orderkey % 6 = 0) or l_orderkey not in (select o_orderkey from orders) order by 1 limit 500")
def ledger_dispatch(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.dispatch(keys, _ledger(spark, sf_dir), "o_orderkey", 500)


@query("""
select case when k % 6 = 0 then 'skipped' when k % 7 = 0 then 'failed' else 'dispatched' end as result, count(*) as keys
from (select o_orderkey as k from orders) group by 1
""")
def dispatch_counts(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return catalog.dispatch_counts(keys, _ledger(spark, sf_dir), keys.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("select c_custkey, c_custkey % 3 = 0 as front from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0")
def prepend_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return catalog.merge_new(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0"), "c_custkey")


@query("""
select k, action from (
  select 'c-' || n || '-s' || s || '-r' || r as k, 'create' as action from (select unnest(range(5)) as n), (select unnest(range(3)) as s), (select unnest(range(2)) as r) where s >= 2
  union all select 'c-' || n || '-s' || s || '-r' || r, 'delete' from (select unnest(range(5)) as n), (select unnest(range(2)) as s), (select unnest(range(3)) as r) where r >= 2
)
""")
def topology_difference(spark, sf_dir):
    from tilewright.operators import placement

    clusters = table(spark, sf_dir, "region").select(F.concat(F.lit("c-"), F.col("r_regionkey").cast("string")).alias("cluster"))
    pods = lambda s, r: placement.desired_pods(clusters.withColumns({"shards": F.lit(s), "replicas": F.lit(r)})).withColumnRenamed("pod", "k")
    return catalog.difference(pods(3, 2), pods(2, 3), "k")


@query("select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then 5::bigint end, 11::bigint) as updated_at from orders")
def backfill_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 5).cast("long").alias("updated_at"))
    return catalog.backfill(o, {"updated_at": 11}).withColumn("updated_at", F.col("updated_at").cast("long"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from events) where k <= 20")
def bounded_queue(spark, sf_dir):
    return catalog.keep_last(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 20).select("user_id", "event_id")


@query("""
with e as (select user_id, event_id, (epoch_us(ts) // 1000) as t, (select max((epoch_us(ts) // 1000)) from events) - 864000000 as cut from events),
n as (select *, count(*) over (partition by user_id) as n from e),
y as (select *, count(*) over (partition by user_id) as m, row_number() over (partition by user_id order by t desc, event_id desc) as k from n where n <= 40 or t >= cut)
select user_id, event_id from y where n <= 40 or m <= 40 or k <= 15
""")
def stale_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    now = e.agg(F.max("t")).first()[0]
    return catalog.stale_pending(e, ["user_id"], "t", F.lit(now), "event_id", 40, 864_000_000, 15).select("user_id", "event_id")
