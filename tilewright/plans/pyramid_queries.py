"""Pyramid and viewport queries: parts stand for images, customers for views."""

from pyspark.sql import functions as F

from tilewright.operators import pyramid, viewport
from tilewright.plans.registry import query
from tilewright.session import table

IMG = "select p_partkey as id, (p_size * 110 + p_partkey % 977)::bigint as width, (p_size * 80 + p_partkey % 613)::bigint as height from part"
LEVELS = f"""
i as ({IMG}), n as (select *, case when greatest(width, height) <= 512 then 0 else ceil(log2(greatest(width, height) / 512.0))::int end as top from i),
l as (select *, unnest(range(top + 1))::int as level from n),
g as (select id, width, height, top, level, ceil(ceil(width / 2.0 ** level) / 512.0)::bigint as tiles_x, ceil(ceil(height / 2.0 ** level) / 512.0)::bigint as tiles_y from l)
"""
GRID = f"{LEVELS}, t0 as (select *, unnest(range(tiles_y))::int as y from g), t as (select *, unnest(range(tiles_x))::int as x from t0)"


def images(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 110 + F.col("p_partkey") % 977).cast("long").alias("width"), (F.col("p_size") * 80 + F.col("p_partkey") % 613).cast("long").alias("height"))


def tiles(spark, sf_dir):
    return pyramid.grid(images(spark, sf_dir)).withColumn("max_level", pyramid.max_level(F.col("width"), F.col("height")))


@query(f"with {LEVELS} select id, level, tiles_x, tiles_y from g")
def pyramid_levels(spark, sf_dir):
    return pyramid.levels(images(spark, sf_dir)).select("id", "level", "tiles_x", "tiles_y")


@query(f"with {LEVELS} select id, sum(tiles_x * tiles_y)::bigint as tiles from g group by id")
def pyramid_tiles_total(spark, sf_dir):
    return pyramid.total_tiles(images(spark, sf_dir), "id")


@query(f"""with {GRID} select id, level, x, y, x::bigint * 512 * (1 << level) as x0, y::bigint * 512 * (1 << level) as y0,
  least((x::bigint + 1) * 512 * (1 << level), width) as x1, least((y::bigint + 1) * 512 * (1 << level), height) as y1 from t""")
def tile_grid(spark, sf_dir):
    c = F.col
    return pyramid.grid(images(spark, sf_dir)).withColumns(pyramid.rectangle(c("x"), c("y"), c("level"), c("width"), c("height"))).select("id", "level", "x", "y", "x0", "y0", "x1", "y1")


@query(f"with {GRID} select id, x::bigint | (y::bigint << 20) | (level::bigint << 40) as key, x::bigint as back_x, y::bigint as back_y, level::bigint as back_level from t")
def tile_key(spark, sf_dir):
    t = pyramid.grid(images(spark, sf_dir)).withColumn("key", pyramid.pack_key(F.col("x"), F.col("y"), F.col("level")))
    return t.select("id", "key", *[v.alias(f"back_{k}") for k, v in pyramid.unpack_key(F.col("key")).items()])


EMPTY = "(id * 31 + level * 17 + x * 7 + y * 3) % 5 = 0 and level >= 2"


@query(f"""
with {GRID}, e as (select id, level, x, y from t where {EMPTY})
select id, level, x, y from t where not exists (
  select 1 from e where e.id = t.id and e.level >= t.level and e.x = t.x >> (e.level - t.level) and e.y = t.y >> (e.level - t.level))
""")
def empty_propagation(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return pyramid.without_empty(t, t.where(EMPTY).select("id", "level", "x", "y"), "id").select("id", "level", "x", "y")


@query(f"""
with {GRID}, h as (select id, level, x, y from t where (id + level * 3 + x + y * 2) % 4 = 0),
j as (select t.id, t.level, t.x, t.y, min(h.level) as source_level from t left join h on h.id = t.id and h.level >= t.level and h.x = t.x >> (h.level - t.level) and h.y = t.y >> (h.level - t.level) group by all)
select id, level, x, y, source_level, (x >> (source_level - level)) as source_x, (y >> (source_level - level)) as source_y from j
""")
def best_ancestor(spark, sf_dir):
    t = tiles(spark, sf_dir).select("id", "level", "x", "y", "max_level")
    held = t.where("(id + level * 3 + x + y * 2) % 4 = 0").select("id", "level", "x", "y")
    return viewport.best_available(t, held, ["id"], "max_level").drop("max_level")


@query(f"with {GRID} select id, level, x, y, level - 1 as below, x * 2 + dx as below_x, y * 2 + dy as below_y from t, (select unnest(range(2))::int as dx) a, (select unnest(range(2))::int as dy) b where level >= 1")
def descendant_cover(spark, sf_dir):
    t = pyramid.grid(images(spark, sf_dir)).where("level >= 1").select("id", "level", "x", "y")
    return pyramid.descendants(t, F.lit(1))


@query(f"with {LEVELS} select id, list_max([k for k in range(4) if 4 ** k <= 2 ** top])::int as native from g where level = 0")
def best_native_level(spark, sf_dir):
    i = images(spark, sf_dir).withColumn("top", pyramid.max_level(F.col("width"), F.col("height"))).withColumn("down", F.array(*[F.lit(4.0**k) for k in range(4)]))
    return pyramid.best_native(i, "id", "down", F.col("top")).select("id", "native")


@query(f"""
with {LEVELS}, d as (select id, level, case when (id + level) % 3 = 0 then tiles_x * tiles_y else (tiles_x * tiles_y) // 2 end as n from g),
s as (select id, sum(tiles_x * tiles_y)::bigint as tiles from g group by id)
select s.id, tiles, sum(n)::bigint as completed, tiles > 0 and sum(n) >= tiles as complete from s join d on s.id = d.id group by s.id, tiles
""")
def progress_rollup(spark, sf_dir):
    lv = pyramid.levels(images(spark, sf_dir)).withColumn("n", F.col("tiles_x") * F.col("tiles_y"))
    done = lv.select("id", F.when((F.col("id") + F.col("level")) % 3 == 0, F.col("n")).otherwise(F.floor(F.col("n") / 2)).alias("completed_up_to"))
    return pyramid.progress(done, pyramid.total_tiles(images(spark, sf_dir), "id"), "id")


VIEWS = f"""
{LEVELS}, v as (
  select c_custkey as view_id, id, width, height, top + 1 as levels, (c_custkey * 37 % 900)::double as view_x, (c_custkey * 53 % 700)::double as view_y,
         800::double as view_width, 600::double as view_height, 0.5::double ** (c_custkey % 5) as zoom
  from customer join g on id = 1 + c_custkey % (select count(*) from part) and level = 0
), w as (
  select *, case when zoom >= 1 then 0 else floor(-log2(zoom) + 0.5)::int end as ideal from v
), a as (
  select *, unnest(range(greatest(0, least(greatest(0, ideal - 2), levels - 1)), levels))::int as level from w
), b as (
  select *, 512.0::double * 2.0::double ** level as step from a
), r as (
  select *, greatest(0, floor(view_x / step))::int as tx0, least(greatest(0, ceil((view_x + view_width / zoom) / step)), ceil(width / step))::int as tx1,
            greatest(0, floor(view_y / step))::int as ty0, least(greatest(0, ceil((view_y + view_height / zoom) / step)), ceil(height / step))::int as ty1 from b
), y0 as (select *, unnest(range(ty0, ty1))::int as y from r), s as (select *, unnest(range(tx0, tx1))::int as x from y0)
"""


def views(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    i = images(spark, sf_dir).withColumn("levels", pyramid.max_level(F.col("width"), F.col("height")) + 1)
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("view_id"), (1 + k % n).alias("id"), (k * 37 % 900).cast("double").alias("view_x"), (k * 53 % 700).cast("double").alias("view_y"), F.lit(800.0).alias("view_width"), F.lit(600.0).alias("view_height"), F.pow(F.lit(0.5), k % 5).alias("zoom"), F.lit(96.0).alias("dpi"))
    return c.join(i, "id")


@query(f"with {VIEWS} select view_id, level, x, y from s")
def visible_tiles(spark, sf_dir):
    return viewport.visible_tiles(views(spark, sf_dir)).select("view_id", "level", "x", "y")


TOPK = """
d as (select *, (x * step - (view_x + view_width / 2)) ** 2 + (y * step - (view_y + view_height / 2)) ** 2 as dist from s),
k as (select *, row_number() over (partition by view_id, level order by dist, y, x) as in_level from d)
"""


@query(f"with {VIEWS}, {TOPK}, f as (select *, row_number() over (partition by view_id order by level desc, in_level) as nth from k where in_level <= 64) select view_id, level, x, y, nth::int as nth from f where nth <= 64")
def viewport_topk(spark, sf_dir):
    return viewport.to_send(viewport.visible_tiles(views(spark, sf_dir))).select("view_id", "level", "x", "y", "nth")


@query(f"""with {VIEWS}, {TOPK}, f as (select *, row_number() over (partition by view_id order by level desc, in_level) as nth from k where in_level <= 64 and (view_id + level + x + y) % 3 <> 0)
select view_id, level, x, y, nth::int as nth from f where nth <= 64""")
def viewport_minus_sent(spark, sf_dir):
    v = viewport.visible_tiles(views(spark, sf_dir))
    return viewport.to_send(v, v.where("(view_id + level + x + y) % 3 = 0")).select("view_id", "level", "x", "y", "nth")


@query(f"""
with {VIEWS}, p as (
  select view_id, width, height, view_x, view_y, view_width / zoom as sw, view_height / zoom as sh from v
), m as (
  select *, least(sw * 0.5, width * 0.5) as mx, least(sh * 0.5, height * 0.5) as my from p
)
select view_id, round(case when -mx > width - sw + mx then (width - sw) / 2 else greatest(-mx, least(view_x, width - sw + mx)) end, 6) as x,
       round(case when -my > height - sh + my then (height - sh) / 2 else greatest(-my, least(view_y, height - sh + my)) end, 6) as y from m
""")
def clamp_viewport(spark, sf_dir):
    c = F.col
    v = views(spark, sf_dir).withColumns(viewport.clamped(c("view_x"), c("view_y"), c("view_width"), c("view_height"), c("zoom"), c("width"), c("height")))
    return v.select("view_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""
with {VIEWS}, f as (select view_id, width, height, greatest(0.01, least(64, least(800 * 0.9 / width, 600 * 0.9 / height))) as z from v)
select view_id, round(z, 9) as zoom, round((width - 800 / z) / 2, 5) as x, round((height - 600 / z) / 2, 5) as y from f
""")
def fit_viewport(spark, sf_dir):
    v = views(spark, sf_dir).withColumns({f"f_{k}": e for k, e in viewport.fitted(F.col("view_width"), F.col("view_height"), F.col("width"), F.col("height")).items()})
    return v.select("view_id", F.round("f_zoom", 9).alias("zoom"), F.round("f_x", 5).alias("x"), F.round("f_y", 5).alias("y"))


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), (1 + F.col("event_id") % 97).alias("bytes"))


@query("""
with e as (select 0 as view_id, event_id, (epoch_us(ts) // 1000) // 1000 as t from events), n as (select *, count(*) over () as n, row_number() over (order by t) as k from e)
select view_id, event_id from n where n <= 1000 or t >= (select max(t) from n where k = least(n - 500, n - 1) + 1)
""")
def evict_kth(spark, sf_dir):
    e = _entries(spark, sf_dir).select(F.lit(0).alias("view_id"), "event_id", F.floor(F.col("t") / 1000).alias("t"))
    return viewport.prune(e, "view_id", "t", hard=True).select("view_id", "event_id")


@query("""
with e as (select user_id, event_id, (epoch_us(ts) // 1000) as t, 1 + event_id % 97 as bytes from events),
c as (select *, count(*) over (partition by user_id) as n, sum(bytes) over (partition by user_id) as b from e),
p as (select *, row_number() over w - 1 as gone, coalesce(sum(bytes) over (w rows between unbounded preceding and 1 preceding), 0) as freed
      from c where event_id % 11 <> 0 window w as (partition by user_id order by t, event_id))
select user_id, event_id from p where (n > 50 or b > 2000) and (n - gone > 40 or b - freed > 1600)
""")
def evict_lru(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return viewport.evict_least_recent(e, "user_id", "t", "bytes", "event_id", 50, 2000, e.where("event_id % 11 = 0")).select("user_id", "event_id")


@query("select user_id, sum(1 + event_id % 97 + case when event_id % 2 = 0 then 1048576 else 0 end)::bigint as bytes, count(*) filter (where event_id % 2 = 0) as decoded from events group by 1")
def cache_use(spark, sf_dir):
    return viewport.cache_use(_entries(spark, sf_dir).withColumn("done", F.col("event_id") % 2 == 0), "user_id", "bytes", "done")


@query(f"with {VIEWS} select distinct view_id, least(160.0 / width, 160.0 / height) as scale, coalesce((select max(q.level) from g q where q.id = v.id and q.tiles_x <= 8 and q.tiles_y <= 8), levels - 1) as level from v")
def minimap(spark, sf_dir):
    m = viewport.minimap(160.0, F.col("width"), F.col("height"), F.col("levels"))
    return views(spark, sf_dir).select("view_id", m["scale"].alias("scale"), m["level"].alias("level"))
