"""Lookups, listings, curation and files: orders, customers, pages and events stand for slides, sets and objects."""

from pyspark.sql import functions as F

from tilewright.functions import packets, text
from tilewright.operators import catalog, geometry
from tilewright.plans.registry import query
from tilewright.session import table
from tilewright.sources import objects


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 33")
def slide_lookup(spark, sf_dir):
    return catalog.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 33)


@query("select c_custkey, c_name from customer where c_custkey in (41, 42) and c_custkey % 2 = 0")
def dataset_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 != 0, 1).alias("deleted_at"))
    return catalog.lookup(c, "c_custkey", 41, "deleted_at").union(catalog.lookup(c, "c_custkey", 42, "deleted_at")).drop("deleted_at")


@query("select o_orderkey, case o_orderkey % 2 when 0 then 'point' else 'ellipse' end as kind, case o_orderkey % 2 when 0 then o_totalprice else o_custkey end::double as value from orders where o_orderkey in (10, 33)")
def annotation_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "point").otherwise("ellipse").alias("kind"))
    of = {"point": o.select(F.col("o_orderkey").alias("annotation_id"), F.col("o_totalprice").alias("p")), "ellipse": o.select(F.col("o_orderkey").alias("annotation_id"), F.col("o_custkey").cast("double").alias("e"))}
    one = lambda k: geometry.with_geometry(catalog.lookup(a, "id", k), of, drop_orphans=False)
    return one(10).unionByName(one(33)).select("o_orderkey", "kind", F.coalesce("p", "e").alias("value"))


@query("select page_id, length(url) as n from pages")
def listing_pruned(spark, sf_dir):
    return catalog.pruned(table(spark, sf_dir, "pages"), ["html"]).select("page_id", F.length("url").cast("long").alias("n"))


@query("""
select p_partkey, p_name, false as appended from (select * from part order by p_name, p_partkey limit 30)
union all select p_partkey, p_name, true from (select * from (select * from part order by p_name, p_partkey limit 30 offset 25) offset 5)
""")
def append_page(spark, sf_dir):
    page = lambda n, at: catalog.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], n, at).drop("full_count")
    return catalog.append_page(page(30, 0), page(30, 25), "p_partkey")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'dark' when o_custkey % 4 = 0 then 'blue' else 'light' end as choice from orders""")
def preference_chain(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    candidates = [F.when(k % 3 == 0, "dark").otherwise("no such"), F.when(c % 4 == 0, "blue"), F.lit("gone")]
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.first_known(candidates, ["light", "dark", "blue"]).alias("choice"))


@query("""
select o_orderkey, case k when 0 then 'point' when 1 then 'ellipse' else 'polygon' end as kind,
       case when k = 0 and o_custkey % 2 = 0 then 9.0::double else 1.0::double end as x, case when k = 1 and o_custkey % 5 <> 0 then 4.0::double else 2.0::double end as radius_y,
       case when o_custkey % 7 = 6 then null when k = 0 then case when o_custkey % 2 = 0 then 'updated' else 'y required' end when k = 1 then case when o_custkey % 5 <> 0 then 'updated' else 'radius_y required' end else 'path required' end as outcome
from (select *, o_orderkey % 3 as k from orders)
where not (o_custkey % 7 = 6)
union all
select o_orderkey, case o_orderkey % 3 when 0 then 'point' when 1 then 'ellipse' else 'polygon' end, 1.0::double, 2.0::double, null from orders where o_custkey % 7 = 6
""")
def geometry_update(spark, sf_dir):
    k, c, one = F.col("o_orderkey") % 3, F.col("o_custkey"), lambda v: F.lit(v).cast("double")
    path, data = F.lit(None).cast("array<array<double>>"), F.lit(None).cast("binary")
    o = table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", F.when(k == 0, "point").when(k == 1, "ellipse").otherwise("polygon").alias("kind"), one(1.0).alias("x"), one(1.0).alias("y"), one(2.0).alias("radius_y"), path.alias("path"))
    changes = o.where(c % 7 != 6).select(
        "o_orderkey", one(9.0).alias("x"), F.when(c % 2 == 0, one(8.0)).alias("y"), path.alias("path"), *[one(3.0).alias(f) for f in ("cx", "cy", "radius_x", "rotation", "x0", "y0", "mask_width", "mask_height")], F.when(c % 5 != 0, one(4.0)).alias("radius_y"), data.alias("data")
    )
    return geometry.updated(a, changes, "o_orderkey").select("o_orderkey", "kind", "x", "radius_y", "outcome")


@query("""select event_id, props->'$.k' ->> '$' as k, case when event_id % 3 = 0 then event_id::varchar end as kind from events""")
def nested_first(spark, sf_dir):
    json = F.concat(F.lit('{"cases": [{"k": '), F.get_json_object("props", "$.k"), F.lit(', "samples": ['), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type": "'), F.col("event_id").cast("string"), F.lit('"}, {"type": "no"}'))).otherwise(""), F.lit("]}, {}]}"))
    return table(spark, sf_dir, "events").select("event_id", text.first_of(json, "cases", "k").alias("k"), text.first_of(json, "cases", "samples", "type").alias("kind"))


@query("select event_id, props as back, case when event_id % 2 = 0 then props end as odd from events")
def session_roundtrip(spark, sf_dir):
    coded = text.to_base64url(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.base64url_json(coded).alias("back"), text.base64url_json(F.when(F.col("event_id") % 2 == 0, coded).otherwise("!*")).alias("odd"))


@query("select page_id, case when page_id % 3 = 0 then url else substr(md5(page_id::varchar), 1, 8) end as label from pages")
def slide_label(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "")
    return table(spark, sf_dir, "pages").select("page_id", text.slide_label(name, F.md5(F.col("page_id").cast("string"))).alias("label"))


@query("select o_orderkey, o_orderkey % 4 in (0, 1) as good from orders")
def uuid_syntax(spark, sf_dir):
    k, u = F.col("o_orderkey"), text.uuid5(F.col("o_orderkey").cast("string"))
    t = F.when(k % 4 == 0, F.upper(u)).when(k % 4 == 1, F.regexp_replace(u, "-", "")).when(k % 4 == 2, F.concat(u, F.lit("0"))).otherwise(F.regexp_replace(u, "^.", "g"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.is_uuid(t).alias("good"))


@query("""
select event_id, nullif(case event_id % 5 when 0 then '10.0.0.' || user_id when 1 then '172.16.0.1' when 2 then '192.168.1.1' when 3 then '8.8.' || user_id || '.8' else '' end, '') as hop,
       case event_id % 5 when 3 then false when 4 then null else true end as internal from events
""")
def forwarded_hop(spark, sf_dir):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    ip = F.when(k == 0, F.concat(F.lit("10.0.0."), u)).when(k == 1, "172.16.0.1").when(k == 2, "192.168.1.1").when(k == 3, F.concat(F.lit("8.8."), u, F.lit(".8"))).otherwise("")
    hop = text.first_hop(F.concat(F.lit("  "), ip, F.lit(" , 1.1.1.1")))
    return table(spark, sf_dir, "events").select("event_id", hop.alias("hop"), text.is_internal(hop).alias("internal"))


@query("select c_custkey, c_custkey % 3 = 0 as name_ok, c_custkey % 5 in (0, 3) as password_ok from customer")
def credential_rules(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("user.-_"), k.cast("string"))).when(k % 3 == 1, "ab").otherwise("a b c")
    word = F.when(k % 5 == 0, "pass-word1").when(k % 5 == 1, "password1").when(k % 5 == 2, "p-1").when(k % 5 == 3, "a1 b2 c3").otherwise("pass-word")
    return table(spark, sf_dir, "customer").select("c_custkey", text.valid_name(name).alias("name_ok"), text.valid_password(word).alias("password_ok"))


@query("""select event_id, '{"a": {"x": 1, "y": ' || event_id || '}, "k": ' || (props->>'$.k') || ', "l": [3]}' as merged from events""")
def json_merge(spark, sf_dir):
    other = F.concat(F.lit('{"a": {"y": '), F.col("event_id").cast("string"), F.lit('}, "l": [3]}'))
    mine = F.concat(F.lit('{"a": {"x": 1, "y": 0}, "l": [1, 2], "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text.merged_json(mine, other).alias("merged"))


@query("""
select event_id, m->>'$.a' as a, m->>'$.k' as k, m->>'$.n' as n, m->>'$.z' as z from (select event_id, json_merge_patch('{"a": {"b": {"x": 1, "y": 0}, "c": [1, 2]}, "k": ' || (props->>'$.k') || ', "n": 5}',
  case event_id % 4 when 0 then '{"a": {"b": {"y": ' || event_id || '}, "c": [3]}}' when 1 then '{"a": 7, "z": {"q": "é"}}' when 2 then '{"k": {"deep": true}}' else '{}' end) as m from events)
""")
def variant_merge(spark, sf_dir):
    n = F.col("event_id")
    mine = F.concat(F.lit('{"a": {"b": {"x": 1, "y": 0}, "c": [1, 2]}, "k": '), F.get_json_object("props", "$.k"), F.lit(', "n": 5}'))
    other = F.when(n % 4 == 0, F.concat(F.lit('{"a": {"b": {"y": '), n.cast("string"), F.lit('}, "c": [3]}}'))).when(n % 4 == 1, '{"a": 7, "z": {"q": "é"}}').when(n % 4 == 2, '{"k": {"deep": true}}').otherwise("{}")
    merged = table(spark, sf_dir, "events").select("event_id", text.deep_merged(F.parse_json(mine), F.parse_json(other)).alias("m"))
    return merged.select("event_id", *[F.variant_get("m", f"$.{c}", "string").alias(c) for c in "aknz"])


@query("""
select event_id, case event_id % 3 when 0 then 'progress' when 1 then 'created' else 'error' end as kind, case when event_id % 3 = 0 then user_id end as steps,
       case when event_id % 3 = 0 then -event_id end as total, case when event_id % 3 = 1 then props end as json from events
""")
def event_codec(spark, sf_dir):
    k = F.col("event_id") % 3
    four = lambda c: packets.bytes_of(F.pmod(c, F.lit(1 << 32)), 4)
    data = F.when(k == 0, F.concat(packets.bytes_of(F.lit(0), 1), four(F.col("user_id")), four(-F.col("event_id")))).when(k == 1, F.concat(packets.bytes_of(F.lit(1), 1), F.encode("props", "utf-8"))).otherwise(packets.bytes_of(F.lit(9), 1))
    return table(spark, sf_dir, "events").select("event_id", *[v.alias(n) for n, v in packets.event(data).items()])


@query("select event_id, event_type as id from events")
def subject_suffix(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", packets.subject_id(F.concat(F.lit("tiles.progress."), "event_type")).alias("id"))


@query("select p_partkey, p_partkey % 5000 + 1 as width, p_size::bigint as height, case when p_partkey % 2 = 0 then p_name end as description from part where p_partkey % 7 <> 0 union all select p_partkey, null, null, null from part where p_partkey % 7 = 0")
def tiff_probe(spark, sf_dir):
    """A first directory of three tags, little-endian; every seventh file is none."""
    k, n = F.col("p_partkey"), packets.bytes_of
    entry = lambda tag, kind, count, value: F.concat(n(F.lit(tag), 2), n(F.lit(kind), 2), n(count, 4), n(value, 4))
    name = F.encode("p_name", "utf-8")
    described = F.concat(n(F.lit(3), 2), entry(256, 4, F.lit(1), k % 5000 + 1), entry(257, 3, F.lit(1), F.col("p_size")), entry(270, 2, F.octet_length(name) + 1, F.lit(8 + 2 + 3 * 12 + 4)), n(F.lit(0), 4), name, n(F.lit(0), 1))
    bare = F.concat(n(F.lit(2), 2), entry(256, 4, F.lit(1), k % 5000 + 1), entry(257, 3, F.lit(1), F.col("p_size")), n(F.lit(0), 4))
    head = F.when(k % 7 == 0, F.encode(F.lit("GIF89a"), "utf-8")).otherwise(F.concat(F.encode(F.lit("II"), "utf-8"), n(F.lit(42), 2), n(F.lit(8), 4)))
    return table(spark, sf_dir, "part").select("p_partkey", objects.probe(F.concat(head, F.when(k % 2 == 0, described).otherwise(bare))).alias("t")).select("p_partkey", "t.*")


@query("select doc_id, doc_id % 3 = 0 as good from documents where text is not null")
def verified_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.col("doc_id").alias("name"), F.encode("text", "utf-8").alias("content"))
    k, raw = F.col("doc_id") % 3, F.encode("text", "utf-8")
    expected = d.select(F.col("doc_id").alias("name"), (F.octet_length(raw) + F.when(k == 1, 1).otherwise(0)).alias("size"), F.when(k == 2, F.md5(F.lit("x"))).otherwise(F.md5(raw)).alias("md5"))
    return objects.verified(files, expected).select(F.col("name").alias("doc_id"), "good")


@query("select event_id, case event_id % 3 when 0 then props end as metadata from events")
def sidecar_metadata(spark, sf_dir):
    path = F.concat(F.lit("s3/"), F.col("event_id").cast("string"), F.lit(".tif"))
    e = table(spark, sf_dir, "events").withColumn("path", path)
    side = e.where("event_id % 3 <> 1").select(F.concat("path", F.lit(".json")).alias("path"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("{not json").alias("text"))
    return objects.with_metadata(e.select("event_id", "path"), side).select("event_id", "metadata")


@query("select o_orderkey::varchar as id, (o_custkey % 9)::int as level, (o_orderkey % 50)::int as x, (o_custkey % 70)::int as y, o_orderkey as length from orders where o_orderkey % 4 <> 0")
def tile_directory(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    named = F.concat_ws("/", F.lit("root"), k.cast("string"), (c % 9).cast("string"), F.concat((k % 50).cast("string"), F.when(k % 4 == 0, "-").otherwise("_"), (c % 70).cast("string"), F.lit(".webp")))
    return objects.tile_paths(table(spark, sf_dir, "orders").select(named.alias("path"), k.alias("length"))).drop("path")


@query("select id, level, x, y, count(*) as requests, bool_or(hit) as hit, case when not bool_or(hit) then id || '.' || level || '.' || x || '.' || y end as message_id from (select l_suppkey % 10 as id, l_linenumber as level, l_partkey % 20 as x, l_suppkey % 20 as y, (l_suppkey + l_linenumber + l_partkey) % 2 = 0 as hit from lineitem) group by 1, 2, 3, 4")
def tile_reads(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("id"), F.col("l_linenumber").alias("level"), (F.col("l_partkey") % 20).alias("x"), (F.col("l_suppkey") % 20).alias("y"))
    keys = ["id", "level", "x", "y"]
    held = table(spark, sf_dir, "lineitem").where("(l_suppkey + l_linenumber + l_partkey) % 2 = 0").select((F.col("l_suppkey") % 10).alias("id"), F.col("l_linenumber").alias("level"), (F.col("l_partkey") % 20).alias("x"), (F.col("l_suppkey") % 20).alias("y")).distinct()
    found, misses = objects.read_tiles(held, asked)
    hits = found.groupBy(*keys).agg(F.count("*").alias("requests")).withColumns({"hit": F.lit(True), "message_id": F.lit(None).cast("string")})
    lost = asked.join(misses, keys).groupBy(*keys, "message_id").agg(F.count("*").alias("requests")).withColumn("hit", F.lit(False))
    return hits.unionByName(lost)
