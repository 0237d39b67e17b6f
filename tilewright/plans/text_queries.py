"""Identity, naming, formatting and curation queries over orders, pages, documents and events.

The SQL's printf rounds exact halves to even; 1e-9 is added to them, for they go up here.
"""

from pyspark.sql import functions as F

from tilewright.functions import packets, text
from tilewright.plans.registry import query
from tilewright.session import table
from tilewright.sources import objects


@query("""
with h as (select o_orderkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('ds:' || o_orderkey::varchar)) as h from orders)
select o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::int & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h
""")
def uuid5_identity(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.uuid5(F.concat(F.lit("ds:"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("""select page_id, regexp_replace(replace(url, '/', '_'), '[^A-Za-z0-9._-]+', '_', 'g') as name, case when split_part(url, '/', -1) = '' then url else split_part(url, '/', -1) end as base,
 ends_with(lower(url), '.html') or ends_with(lower(url), '/') as known from pages""")
def safe_name(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(u).alias("name"), text.basename(u).alias("base"), text.has_suffix(u, ".HTML", "/").alias("known"))


@query("""
select doc_id, case when n >= 1 << 30 then printf('%.1f GB', n / 1073741824.0::double + case when n / 1073741824.0::double * 8 = floor(n / 1073741824.0::double * 8) then 1e-9 else 0 end) when n >= 1 << 20 then printf('%.1f MB', n / 1048576.0::double + case when n / 1048576.0::double * 8 = floor(n / 1048576.0::double * 8) then 1e-9 else 0 end) when n >= 1024 then printf('%.1f KB', n / 1024.0::double + case when n / 1024.0::double * 8 = floor(n / 1024.0::double * 8) then 1e-9 else 0 end) else n || ' B' end as size,
       case when n >= 1000000 or d >= 1000000 then printf('%.1fM × %.1fM', n / 1000000.0::double + case when n / 1000000.0::double * 8 = floor(n / 1000000.0::double * 8) then 1e-9 else 0 end, d / 1000000.0::double + case when d / 1000000.0::double * 8 = floor(d / 1000000.0::double * 8) then 1e-9 else 0 end) when n >= 1000 or d >= 1000 then printf('%.1fK × %.1fK', n / 1000.0::double + case when n / 1000.0::double * 8 = floor(n / 1000.0::double * 8) then 1e-9 else 0 end, d / 1000.0::double + case when d / 1000.0::double * 8 = floor(d / 1000.0::double * 8) then 1e-9 else 0 end) else n || ' × ' || d end as dims
from (select doc_id, n_chars * 37 as n, doc_id * 3 as d from documents)
""")
def size_format(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 37).alias("n"), (F.col("doc_id") * 3).alias("d"))
    return d.select("doc_id", text.size_text(F.col("n")).alias("size"), text.dimension_text(F.col("n"), F.col("d")).alias("dims"))


@query("""select l_orderkey, l_linenumber, case when m >= 10000 then printf('%.0f mm', m / 1000 + case when m / 1000 * 8 = floor(m / 1000 * 8) then 1e-9 else 0 end) when m >= 1000 then printf('%.1f mm', m / 1000 + case when m / 1000 * 8 = floor(m / 1000 * 8) then 1e-9 else 0 end) else printf('%.1f µm', m + case when m * 8 = floor(m * 8) then 1e-9 else 0 end) end as um,
 case when m / 25400 >= 0.1 then printf('%.2f in', m / 25400 + case when m / 25400 * 8 = floor(m / 25400 * 8) then 1e-9 else 0 end) else printf('%.1f mil', m / 25400 * 1000 + case when m / 25400 * 1000 * 8 = floor(m / 25400 * 1000 * 8) then 1e-9 else 0 end) end as inch from (select l_orderkey, l_linenumber, l_extendedprice / 3 as m from lineitem)""")
def distance_format(spark, sf_dir):
    m = F.col("l_extendedprice") / 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.distance_text(m).alias("um"), text.distance_text(m, "in").alias("inch"))


@query("select p_partkey, list_aggregate(list_transform(string_split(replace(k, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') as label from (select p_partkey, replace(lower(p_type), ' ', '_') as k from part)")
def property_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.property_label(F.regexp_replace(F.lower("p_type"), " ", "_")).alias("label"))


@query("""select page_id, list_transform(regexp_extract_all('see ' || url || '), and doi: 10.1234/ab' || page_id || '.', '(?i)(doi:\\s*10\\.\\d{4,9}/\\S+|https?://\\S+)', 1), lambda x: regexp_replace(x, '[\\].,;:!?)+]+$', '')) as links from pages""")
def credit_links(spark, sf_dir):
    t = F.concat(F.lit("see "), "url", F.lit("), and doi: 10.1234/ab"), F.col("page_id").cast("string"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", text.credit_links(t).alias("links"))


@query("""
with l as (select page_id, url || '),' as whole, regexp_replace(url || '),', '[\\].,;:!?)+]+$', '') as link from pages)
select page_id, to_json([{'kind': 'text', 'value': 'see '}, {'kind': 'url', 'value': link}, {'kind': 'text', 'value': whole[len(link) + 1:] || ' and '}, {'kind': 'doi', 'value': 'doi: 10.1234/ab' || page_id}, {'kind': 'text', 'value': '.'}])::varchar as parts from l
""")
def credit_parts(spark, sf_dir):
    t = F.concat(F.lit("see "), "url", F.lit("), and doi: 10.1234/ab"), F.col("page_id").cast("string"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(text.credit_parts(t)).alias("parts"))


@query("""select event_id, coalesce(props->>'$.imageId', props->>'$.id', event_id::varchar) as image from events""")
def json_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", text.picked(F.col("props")).alias("m"))
    return e.select("event_id", F.coalesce(F.try_element_at("m", F.lit("imageId")), F.col("event_id").cast("string")).alias("image"))


@query("""select o_orderkey, case when t <> 0 and s < t then (case when s = 0 then '0.00' when s / t::double * 100 >= 99.95 then printf('%.0f', s / t::double * 100 + case when s / t::double * 100 * 8 = floor(s / t::double * 100 * 8) then 1e-9 else 0 end) when s / t::double * 100 >= 9.995 then printf('%.1f', s / t::double * 100 + case when s / t::double * 100 * 8 = floor(s / t::double * 100 * 8) then 1e-9 else 0 end) else printf('%.2f', s / t::double * 100 + case when s / t::double * 100 * 8 = floor(s / t::double * 100 * 8) then 1e-9 else 0 end) end) || '%' end as progress
 from (select o_orderkey, o_orderkey % 97 as s, o_custkey % 90 as t from orders)""")
def progress_format(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("s"), (F.col("o_custkey") % 90).alias("t"))
    return o.select("o_orderkey", text.progress_text(F.col("s"), F.col("t")).alias("progress"))


@query("""select o_orderkey, 5::bigint as slot, o_orderkey % 1000 as x, o_custkey % 1000 as y, o_orderkey % 7 as level from orders""")
def packet_roundtrip(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    data = packets.message(packets.REQUEST, (F.lit(5), 1), (k % 1000, 4), (c % 1000, 4), (k % 7, 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data")).select("o_orderkey", *[v.alias(n) for n, v in packets.tile_request(F.col("data")).items()])


@query("""select o_orderkey, case when w is null and o_orderkey % 2 = 0 then 'unknown size, small file' when w < 5000 then 'too small' end as reason, not coalesce((w is null and o_orderkey % 2 = 0) or w < 5000, false) as accepted
 from (select o_orderkey, case when o_orderkey % 3 <> 0 then o_custkey * 10 end as w from orders)""")
def accept_slides(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 != 0, F.col("o_custkey") * 10).alias("width"), F.lit(9000).alias("height"), F.when(k % 2 == 0, 1).otherwise(1 << 30).alias("file_size"))
    return objects.judged(s, 5000, 5000).select("o_orderkey", "reason", "accepted")


@query("select p_partkey from part order by md5('7:' || p_partkey::varchar), p_partkey limit 25")
def seeded_sample(spark, sf_dir):
    return objects.sampled_search(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 25, 7)


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 50 when o_orderkey % 3 = 1 then null else null end::double as zoom, o_orderkey % 3 = 0 as is_number from orders")
def permalink_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, (k % 50).cast("string")).when(k % 3 == 1, "abc").otherwise("1e9")
    z = text.permalink_number(raw, 0, 64)
    return table(spark, sf_dir, "orders").select("o_orderkey", z.alias("zoom"), z.isNotNull().alias("is_number"))
