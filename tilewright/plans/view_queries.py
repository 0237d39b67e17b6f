"""Views, masks, whole tiles and routing: parts stand for images, customers for views, line items for pixels and tiles."""

from pyspark.sql import functions as F

from tilewright.operators import geometry, masks, placement, pyramid, stain, viewport
from tilewright.plans.pyramid_queries import IMG, VIEWS, images, views
from tilewright.plans.registry import query
from tilewright.plans.stain_queries import OD, pixels
from tilewright.session import spread, table
from tilewright.sources import objects
from tilewright.streaming import limits
from tilewright.streaming.views import events_in_view

# --- viewports


@query(f"select id, case when greatest(width, height) <= 512 then 1 else ceil(log2(greatest(width, height) / 512.0))::int + 1 end as levels, (ceil(log2(greatest(width, height) / 512.0)) + 1)::int as client_levels from ({IMG})")
def level_counts(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return images(spark, sf_dir).select("id", pyramid.level_count(w, h).alias("levels"), pyramid.level_count(w, h, client=True).alias("client_levels"))


@query(f"with {VIEWS} select view_id, greatest(0, least(ideal, levels - 1)) as ideal from w")
def ideal_levels(spark, sf_dir):
    return views(spark, sf_dir).select("view_id", viewport.ideal_level(F.col("zoom"), F.col("dpi"), F.col("levels")).alias("ideal"))


@query(f"with {VIEWS}, z as (select *, greatest(0.01, least(64, zoom * (1 + view_id % 7))) as new from v) select view_id, round(view_x + 100 / zoom - 100 / new, 6) as x, round(view_y + 50 / zoom - 50 / new, 6) as y, new as zoom from z")
def zoom_about(spark, sf_dir):
    z = viewport.zoomed(F.col("view_x"), F.col("view_y"), F.col("zoom"), F.lit(100), F.lit(50), 1 + F.col("view_id") % 7)
    return views(spark, sf_dir).select("view_id", F.round(z["x"], 6).alias("x"), F.round(z["y"], 6).alias("y"), z["zoom"].alias("zoom"))


@query(f"with {VIEWS} select view_id, round(view_x - 30 / zoom, 6) as x, round(view_y + 20 / zoom, 6) as y, round((512 - view_x) * zoom, 6) as screen_x, round((256 - view_y) * zoom, 6) as screen_y from v")
def pan_and_screen(spark, sf_dir):
    zoom = F.col("zoom")
    p, s = viewport.panned(F.col("view_x"), F.col("view_y"), zoom, F.lit(30), F.lit(-20)), viewport.to_screen(F.lit(512), F.lit(256), F.col("view_x"), F.col("view_y"), zoom)
    return views(spark, sf_dir).select("view_id", *[F.round(v, 6).alias(n) for n, v in (p | s).items()])


@query(f"with {VIEWS}, o as (select view_id, level, x, y, row_number() over (partition by view_id order by sqrt(((x + 0.5) * step - (view_x + view_width / zoom / 2)) ** 2 + ((y + 0.5) * step - (view_y + view_height / zoom / 2)) ** 2)::decimal(18, 3), level, y, x) as turn from s) select view_id, level, x, y, turn::int as turn from o")
def work_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("view_id").orderBy(viewport.centre_distance().cast("decimal(18,3)"), "level", "y", "x")
    return viewport.visible_tiles(views(spark, sf_dir)).withColumn("turn", F.row_number().over(order)).select("view_id", "level", "x", "y", "turn")


@query("select p_partkey, coalesce((select max(n) from unnest([1.0, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]) as t(n) where n <= (p_size * 40)::double * 0.15::double * 0.25::double / (0.5::double ** (p_partkey % 9))), 1)::double as bar from part")
def scale_bar(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", viewport.scale_bar(F.col("p_size") * 40, F.lit(0.25), F.pow(F.lit(0.5), F.col("p_partkey") % 9)).alias("bar"))


@query(f"""
with {VIEWS}, f as (select view_id, width, height, 0 as level, 512.0::double as step, greatest(0, floor(view_x / 512))::int as tx0, least(greatest(0, ceil((view_x + view_width / zoom) / 512)), ceil(width / 512))::int as tx1, greatest(0, floor(view_y / 512))::int as ty0, least(greatest(0, ceil((view_y + view_height / zoom) / 512)), ceil(height / 512))::int as ty1 from v),
o as (select *, unnest(range(greatest(0, ty0 - 3), least(ceil(height / step)::int, ty1 + 3)))::int as y from f), q as (select *, unnest(range(greatest(0, tx0 - 3), least(ceil(width / step)::int, tx1 + 3)))::int as x from o),
d as (select *, row_number() over (partition by view_id order by y, x) as nth from q where not (y >= ty0 and y < ty1 and x >= tx0 and x < tx1) and (x + y) % 3 <> 0)
select view_id, level, x, y, nth::int as nth from d where nth <= 8
""")
def prefetch_tiles(spark, sf_dir):
    v, level = views(spark, sf_dir), F.lit(0)
    held = viewport.visible_tiles(v, level, 3).where("(x + y) % 3 <> 0")
    return viewport.prefetch_ring(v, level, held).select("view_id", "level", "x", "y", "nth")


@query(f"""
with {VIEWS}, u as (select distinct id, level, x, y, least(level + 2, levels - 1) as up, step, 512.0::double * 2.0::double ** least(level + 2, levels - 1) as up_step, width, height from s),
o as (select *, floor(x * step / up_step) * up_step as ox, floor(y * step / up_step) * up_step as oy from u),
p as (select *, greatest(1, least(ox + up_step, width) - ox) as span_x, greatest(1, least(oy + up_step, height) - oy) as span_y, 500::double as bw, 400::double as bh from o)
select id, level, x, y, round((x * step - ox) / span_x * bw, 6) as sx, round((least(x * step + step, width) - x * step) / span_x * bw, 6) as s_width, round((y * step - oy) / span_y * bh, 6) as sy, round((least(y * step + step, height) - y * step) / span_y * bh, 6) as s_height from p
""")
def ancestor_part(spark, sf_dir):
    c = F.col
    t = viewport.visible_tiles(views(spark, sf_dir)).select("id", "level", "x", "y", "levels", "width", "height").distinct()
    part = viewport.source_part(c("level"), c("x"), c("y"), F.least(c("level") + 2, c("levels") - 1), c("width"), c("height"), F.lit(500), F.lit(400))
    return t.select("id", "level", "x", "y", *[F.round(v, 6).alias(n) for n, v in part.items()])


@query("""
with e as (select event_id, user_id % 20 as slide, epoch_us(ts) // 1000 as t, (event_id % 3)::int as level, (event_id % 7)::int as x, (event_id % 5)::int as y from events),
v as (select event_id as update_id, user_id as view_id, user_id % 20 as slide, epoch_us(ts) // 1000 as t, (event_id * 37 % 2000)::double as view_x, (event_id * 53 % 1500)::double as view_y, 0.5::double ** (event_id % 4) as zoom from events where event_id % 3 = 0),
l as (select *, lead(t) over (partition by view_id, slide order by t) as till from v),
m as (select * from e join l on e.slide = l.slide and e.t >= l.t and (till is null or e.t < till))
select view_id, event_id from (select view_id, event_id, e_level as level, x, y, view_x, view_y, zoom, 512::double * 2 ** e_level as step, case when zoom >= 1 then 0 else floor(-log2(zoom) + 0.5)::int end as ideal from (select view_id, event_id, level as e_level, x, y, view_x, view_y, zoom from m))
where x >= greatest(0, floor(view_x / step)) and x < least(greatest(0, ceil((view_x + 800 / zoom) / step)), ceil(9000 / step)) and y >= greatest(0, floor(view_y / step)) and y < least(greatest(0, ceil((view_y + 600 / zoom) / step)), ceil(7000 / step))
  and level >= greatest(0, least(greatest(0, ideal - 2), 5))
""")
def events_for_views(spark, sf_dir):
    k = F.col("event_id")
    base = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("slide", F.col("user_id") % 20)
    tiles = base.select("event_id", "slide", "at", (k % 3).cast("int").alias("level"), (k % 7).cast("int").alias("x"), (k % 5).cast("int").alias("y"))
    sizes = {"view_width": 800.0, "view_height": 600.0, "dpi": 96.0, "width": 9000, "height": 7000, "levels": 6}
    updates = base.where("event_id % 3 = 0").select(F.col("user_id").alias("view_id"), "slide", "at", (k * 37 % 2000).cast("double").alias("view_x"), (k * 53 % 1500).cast("double").alias("view_y"), F.pow(F.lit(0.5), k % 4).alias("zoom"), *[F.lit(v).alias(n) for n, v in sizes.items()])
    return events_in_view(tiles, updates).select("view_id", "event_id")


# --- masks and shapes


@query("select p_partkey, ((p_size + 7) // 8)::int as stride, ((p_size + 7) // 8 * 10)::int as bytes, (p_size * 9 + p_partkey % 50) as client_bit from part")
def mask_layout(spark, sf_dir):
    w = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", masks.stride(w).alias("stride"), masks.expected_size(w, F.lit(10)).alias("bytes"), masks.continuous_bit(F.col("p_partkey") % 50, F.lit(9), w).alias("client_bit"))


@query("""
with d as (select doc_id, encode(text) as data, (doc_id % 19 - 1)::int as x, (doc_id % 5)::int as y from documents where octet_length(encode(text)) >= 10)
select doc_id, x, y, case when x < 0 or x >= 16 then false else get_bit(data::bit, (y * 2 + x // 8) * 8 + 7 - x % 8) = 1 end as pixel from d
""")
def mask_pixels(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"), (k % 19 - 1).cast("int").alias("x"), (k % 5).cast("int").alias("y")).where("octet_length(data) >= 10")
    return d.select("doc_id", "x", "y", masks.get_pixel(F.col("data"), F.lit(16), F.lit(5), F.col("x"), F.col("y")).alias("pixel"))


@query("select p_partkey, case when p_partkey % 2 = 0 then '00' || substr(hex(chr(((1 << (p_partkey % 7)::int))::int)), 1, 2) else 'FF' || substr(upper(printf('%02x', 255 - (1 << (p_partkey % 7)::int))), 1, 2) end as data from part")
def mask_edits(spark, sf_dir):
    """A pixel of an empty mask set, or of a full one cleared; one beyond the edge is left out."""
    k = F.col("p_partkey")
    on = k % 2 == 0
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(on, F.unhex(F.lit("0000"))).otherwise(F.unhex(F.lit("FFFF"))).alias("data"), F.array(F.array((k % 7).cast("int"), F.lit(1)), F.array(F.lit(8), F.lit(0))).alias("points"), on.alias("on"))
    return p.select("p_partkey", F.hex(masks.with_pixels(F.col("data"), F.lit(8), F.col("points"), F.col("on"))).alias("data"))


@query("""
with s as (select p_partkey as id, (p_partkey * 37 % 1500)::int as cx, (p_partkey * 11 % 1500)::int as cy, (p_size % 12)::int as r from part),
x as (select *, unnest(range(-r, r + 1))::int as dx from s), y as (select *, unnest(range(-r, r + 1))::int as dy from x), p as (select id, cx + dx as px, cy + dy as py from y where dx * dx + dy * dy <= r * r and cx + dx >= 0 and cy + dy >= 0)
select id, (px // 512)::bigint as patch_x, (py // 512)::bigint as patch_y, 32768 as bytes, count(*) as bits, min((py % 512) * 64 + (px % 512) // 8)::int as first_byte from p group by 1, 2, 3
""")
def brush_patches(spark, sf_dir):
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 1500).cast("int").alias("cx"), (k * 11 % 1500).cast("int").alias("cy"), (F.col("p_size") % 12).cast("int").alias("radius"))
    first = F.floor((F.regexp_instr(F.hex("data"), F.lit("[1-9A-F]")) - 1) / 2).cast("int")
    return masks.patches(masks.brush_words(s)).select("id", "patch_x", "patch_y", F.octet_length("data").alias("bytes"), masks.popcount(F.col("data")).alias("bits"), first.alias("first_byte"))


@query("""
with s as (select p_partkey, p_size::double as d, greatest(1, ceil(sqrt((p_size * 3::double) ** 2 + (p_size * 5::double) ** 2) / greatest(1, (p_partkey % 9) * 0.3)))::int as n from part)
select p_partkey, k::int as k, floor(d * 3 * k / n * 1000)::bigint as x, floor(d * 5 * k / n * 1000)::bigint as y from (select *, unnest(range(n + 1)) as k from s)
""")
def stroke_points(spark, sf_dir):
    d, o = F.col("p_size").cast("double"), F.lit(0.0)
    p = spread(table(spark, sf_dir, "part")).select("p_partkey", F.posexplode(masks.stroke_points(o, o, d * 3, d * 5, F.col("p_partkey") % 9)).alias("k", "p"))
    return p.select("p_partkey", "k", F.floor(F.col("p")[0] * 1000).alias("x"), F.floor(F.col("p")[1] * 1000).alias("y"))


@query("select p_partkey, list_aggregate(list_transform(range(8), lambda i: case when (p_size >> i) & 1 = 1 then '0A141E80' else '00000000' end), 'string_agg', '') as rgba from part")
def mask_raster(spark, sf_dir):
    data = F.unhex(F.lpad(F.hex("p_size"), 2, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(masks.coloured(data, F.lit(8), (10, 20, 30), 0.5)).alias("rgba"))


@query("select o_orderkey, 'M 0.0 0.0 L ' || o_custkey || '.0 1.5 L 2.0 ' || o_orderkey || '.0 Z' as d from orders")
def svg_paths(spark, sf_dir):
    n = lambda v: F.lit(v).cast("double")
    path = F.array(F.array(n(0), n(0)), F.array(F.col("o_custkey").cast("double"), n(1.5)), F.array(n(2), F.col("o_orderkey").cast("double")))
    return table(spark, sf_dir, "orders").where("o_orderkey < 10000000 and o_custkey < 10000000").select("o_orderkey", geometry.svg_path(path, True).alias("d"))


@query("""
select l_orderkey, l_linenumber, least(l_quantity, l_tax) as x, least(l_discount, l_quantity) as y, abs(l_tax - l_quantity) as width, abs(l_quantity - l_discount) as height,
       round(greatest(1, abs(l_quantity * cos(l_tax) + l_linenumber * sin(l_tax))), 6) as radius_x, round(greatest(1, abs(l_linenumber * cos(l_tax) - l_quantity * sin(l_tax))), 6) as radius_y from lineitem
""")
def drawn_shapes(spark, sf_dir):
    c = F.col
    r = geometry.rectangle(c("l_quantity"), c("l_discount"), c("l_tax"), c("l_quantity"))
    e = geometry.ellipse_from_pointer(F.lit(0), F.lit(0), c("l_quantity"), c("l_linenumber"), c("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in r.items()], *[F.round(v, 6).alias(n) for n, v in e.items()])


# --- whole tiles


def _square(rows, size=3):
    """RGBA bytes of a square of one grey around one pixel of another: columns grey and spot."""
    one = lambda c: F.unhex(F.concat(F.repeat(F.lpad(F.hex(c), 2, "0"), 3), F.lit("FF")))
    n = size * size // 2
    return rows.withColumn("pixels", F.concat(*[one("grey")] * n, one("spot"), *[one("grey")] * n))


@query("select p_partkey, p_partkey % 2 = 0 as black from part")
def black_tiles(spark, sf_dir):
    t = _square(table(spark, sf_dir, "part").withColumns({"grey": F.lit(0), "spot": F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(F.col("p_size") + 1)}))
    return t.select("p_partkey", pyramid.is_black(F.col("pixels")).alias("black"))


SQUARE = "g as (select p_partkey, (p_partkey % 100 * 2 + 20)::double as grey, (p_size * 4 % 256)::double as spot from part)"


@query(f"""
with {SQUARE}, y as (select *, 0.299::double * spot + 0.587::double * spot + 0.114::double * spot as s, 0.299::double * grey + 0.587::double * grey + 0.114::double * grey as e from g),
m as (select *, s + 0.4::double * (s - (4 * s + 12 * e) / 16) as one, s + 0.15::double * (s - (4 * s + 12 * e) / 16) as two from y)
select p_partkey, round_even(least(255, spot * least(255, greatest(0, one)) / greatest(s, 0.001)), 0)::int as first, floor(least(255, case when s > 0.255 then spot * least(2, greatest(0, two / s)) else spot end) + 1e-9)::int as second from m
""")
def sharpen_tiles(spark, sf_dir):
    t = _square(spread(table(spark, sf_dir, "part")).select("p_partkey", (F.col("p_partkey") % 100 * 2 + 20).alias("grey"), (F.col("p_size") * 4 % 256).alias("spot")))
    t = stain.processed(stain.processed(t, 3, 3, 50.0, name="first"), 3, 3, 50.0, alternative=True, name="second")
    return t.select("p_partkey", *[F.conv(F.hex(F.substring(c, 17, 1)), 16, 10).cast("int").alias(c) for c in ("first", "second")])


@query(f"with {SQUARE} select p_partkey, upper(printf('%02x', grey::int)) || '0000FF' as pixel, 36 as bytes, 16 as small from g")
def swapped_tiles(spark, sf_dir):
    """Blue-first pixels turned round, and one grey resized to a smaller square, which keeps it."""
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", (F.col("p_partkey") % 100 * 2 + 20).alias("grey"))
    blue = rows.withColumn("pixels", F.unhex(F.repeat(F.concat(F.lit("0000"), F.lpad(F.hex("grey"), 2, "0"), F.lit("FF")), 9)))
    both = stain.processed(stain.processed(blue, 3, 3, swap=True, name="whole"), 3, 3, swap=True, to=(2, 2), name="less")
    first = lambda c: F.hex(F.substring(c, 1, 4))
    return both.where(first("whole") == first("less")).select("p_partkey", first("whole").alias("pixel"), F.octet_length("whole").alias("bytes"), F.octet_length("less").alias("small"))


def _lobes(n: int, m: int) -> str:
    """Weights (to, "from", w) of a Lanczos window of three lobes that takes n values to m."""
    x = f"(i - ((k + 0.5::double) * {n} / {m} - 0.5::double)) / greatest(1.0::double, {n}::double / {m})"
    sinc = lambda v: f"(case when {v} = 0 then 1 else sin(pi() * {v}) / (pi() * {v}) end)"
    return f"select k as \"to\", i as \"from\", w / sum(w) over (partition by k) as w from (select k, i, case when abs(x) < 3 then {sinc('x')} * {sinc('x / 3')} else 0 end as w from (select k, i, {x} as x from (select unnest(range({m})) as k), (select unnest(range({n})) as i)))"


@query(f"""
with r as ({_lobes(6, 4)}), c as ({_lobes(8, 11)}), p as (
  select p_partkey, y, x, ((x * 29 + y * 53 + p_partkey * 7) % 256)::double as v from part, (select unnest(range(6)) as y), (select unnest(range(8)) as x)
), d as (
  select p_partkey, r."to" as y, x, sum(r.w * v) as v from p join r on r."from" = y group by all
), o as (
  select p_partkey, y, c."to" as x, sum(c.w * v) as v from d join c on c."from" = x group by all
)
select p_partkey, string_agg(greatest(0, least(255, round_even(v, 0)))::int::varchar, ',' order by y, x) as red from o group by p_partkey
""")
def resized_tiles(spark, sf_dir):
    """Slopes of 8 by 6 pixels, made wider and lower."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.concat(F.lpad(F.hex((i % 8 * 29 + F.floor(i / 8) * 53 + F.col("p_partkey") * 7) % 256), 2, "0"), F.lit("0000FF")))
    t = spread(table(spark, sf_dir, "part")).select("p_partkey", F.unhex(F.array_join(pixel, "")).alias("pixels"))
    red = F.transform(F.sequence(F.lit(0), F.lit(43)), lambda i: F.conv(F.hex(F.substring("pixels", i * 4 + 1, F.lit(1))), 16, 10))
    return stain.processed(t, 8, 6, to=(11, 4)).select("p_partkey", F.array_join(red, ",").alias("red"))


@query(f"""
with {OD}, t as (select *, l_orderkey * 10 + l_linenumber as place from o), k as (
  select *, row_number() over (partition by l_suppkey % 7 order by place) as n from t where place % 4 = 0 and not (r > 240 and g > 240 and b > 240) and sqrt(od_r ** 2 + od_g ** 2 + od_b ** 2) >= 0.15)
select l_suppkey % 7 as tile, count(*) as samples, round(sum(od_r), 4) as od_r from k where n <= 15000 group by 1
""")
def tissue_sampling(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumns({"tile": F.col("l_suppkey") % 7, "place": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    return stain.tissue_samples(p, "tile", "place", 0.25).groupBy("tile").agg(F.count("*").alias("samples"), F.round(F.sum("od_r"), 4).alias("od_r"))


@query("select p_partkey, abs(p_size - p_partkey % 50)::double / nullif((p_size + p_partkey % 50) / 2.0::double, 0) <= 0.25 as stable from part where p_partkey % 50 > 0")
def stable_parameters(spark, sf_dir):
    one = lambda m: F.struct(F.array(*[F.array(F.lit(0.5), F.lit(0.001))] * 3).alias("stain"), F.array(F.lit(1.0), m.cast("double")).alias("most"))
    p = table(spark, sf_dir, "part").where("p_partkey % 50 > 0").select("p_partkey", one(F.col("p_size")).alias("a"), one(F.col("p_partkey") % 50).alias("b"))
    return p.select("p_partkey", stain.is_stable("a", "b").alias("stable"))


@query("select 0 as one, list_sort(list(l_extendedprice))[least((count(*) * 0.9)::double // 1, count(*) - 1)::bigint + 1] as p90 from lineitem")
def percentile_large_group(spark, sf_dir):
    return stain.floor_percentile(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(0)), "one", "l_extendedprice", 0.9, "p90", F.rint)


# --- routing and gates


@query("select o_orderkey, case when o_orderkey % 20 < 16 then (o_orderkey % 20 * 3 // 16)::int else 9 end as shard from orders")
def routed_slots(spark, sf_dir):
    slots = F.array(*[F.lit(i * 3 // 16) for i in range(16)])
    return placement.routed(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("slot")), slots, F.lit(9)).select("o_orderkey", "shard")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'not_master' when o_custkey % 3 <> 1 then 'not_owner' when o_orderkey % 7 < 3 then 'stale_epoch' else 'ok' end as status from orders")
def migration_accept(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, "replica").otherwise("master").alias("role"), (F.col("o_custkey") % 3).alias("shard"), F.lit(1).alias("local"), F.lit(3).alias("config_epoch"), (k % 7).alias("sender_epoch"))
    return t.select("o_orderkey", placement.migration_status().alias("status"))


@query("""
with r as (select s_suppkey, s_suppkey // 3 as shard_id, 's' || s_suppkey as name, s_suppkey % 3 = 0 as master, s_suppkey % 4 <> 0 as ready, s_suppkey % 11 as lag, s_suppkey as off from supplier),
a as (select shard_id, max(off) as current_offset, count(*) filter (where ready) as ready_replicas, coalesce(bool_or(ready) filter (where master), false) as healthy_master from r group by 1),
b as (select shard_id, min_by(name, (lag, name)) as promote from r where not master and ready group by 1),
p as (select shard_id % 2 as cluster, bool_and(ready_replicas >= 1) as all_healthy from a group by 1)
select a.shard_id, current_offset, ready_replicas, case when not healthy_master and shard_id % 5 <> 0 then promote end as promote, case when not healthy_master and shard_id % 5 <> 0 and promote is not null then 8 end::bigint as new_epoch, case when not all_healthy then 'Degraded' else 'Ready' end as phase
from a left join b using (shard_id) join p on p.cluster = a.shard_id % 2
""")
def reconcile_shards(spark, sf_dir):
    k = F.col("s_suppkey")
    shard = F.floor(k / 3)
    s = table(spark, sf_dir, "supplier")
    r = s.select(shard.alias("shard_id"), F.concat(F.lit("s"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "master").otherwise("replica").alias("role"), (k % 4 != 0).alias("ready"), (k % 11).alias("lag"), k.alias("offset"), F.lit(3).cast("long").alias("config_epoch"), F.lit(100).cast("long").alias("last_heartbeat"))
    shards = r.select("shard_id").distinct().select("shard_id", (F.col("shard_id") % 2).alias("cluster"), F.lit(7).cast("long").alias("epoch"), (F.col("shard_id") % 5 == 0).alias("cooldown"), F.lit(1).alias("expected_replicas"), F.lit(0).alias("migration_queue_len"), F.lit(0).alias("misplaced_tiles"))
    return placement.reconcile(r, shards, 120, 60, 3).select("shard_id", "current_offset", "ready_replicas", "promote", "new_epoch", "phase")


@query("select event_id, round((event_id % 100) / 100.0::double * least(30000, 1000 * 2.0 ** (event_id % 8)), 6) as wait from events")
def jittered_waits(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(limits.full_jitter(k % 8, 1000, 30_000, (k % 100) / 100.0), 6).alias("wait"))


@query("select event_type, count(*) as n from events group by 1")
def counted_beside(spark, sf_dir):
    """Counters beside a query: the rows that pass are counted without another pass."""
    return objects.observed(table(spark, sf_dir, "events"), "events_seen", rows=F.count("*"), errors=F.count_if(F.col("event_type") == "error")).groupBy("event_type").agg(F.count("*").alias("n"))
