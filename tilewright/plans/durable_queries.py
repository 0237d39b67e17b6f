"""Messages and tiles that go through shared storage and come back: dispatch, consumption, files."""

import uuid

from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.plans.registry import query
from tilewright.session import shared_dir, spread, stage, table
from tilewright.sources import journal, ledger, objects, raw_slide
from tilewright.streaming.replay import replayed


@query("select user_id || ':' || event_type as message_id, 'user.' || user_id as subject, 1::bigint as seen from events where user_id % 2 = 0 group by all")
def dispatched_once(spark, sf_dir):
    """Keys of all events go through the ledger into a journal, and a consumer of some subjects takes them from there."""
    root = f"{shared_dir(spark)}/dispatch-{uuid.uuid4().hex}"
    keys = replayed(spark, sf_dir).select(text.scoped_key(F.col("user_id"), F.col("event_type")).alias("key"), F.when(F.col("user_id") % 2 == 0, "user").otherwise("other").alias("kind"), "user_id")
    send = lambda rows, n: journal.publish(rows.select(F.concat_ws(".", "kind", "user_id").alias("subject"), F.col("key").alias("message_id"), F.lit("{}").alias("payload")), f"{root}/journal", n)
    objects.consume(keys, ledger.dispatching(f"{root}/ledger", send), f"{root}/sent", available_now=True).awaitTermination()
    journal.register(spark)
    taken = spark.readStream.format("journal").option("path", f"{root}/journal").option("consumer", "query").option("subject", "user.*").load()
    objects.consume(taken, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/taken/batch={n}"), f"{root}/taken-from", available_now=True).awaitTermination()
    return spark.read.schema(f"segment long, {journal.MESSAGE}, batch long").parquet(f"{root}/taken").groupBy("message_id", "subject").agg(F.count("*").alias("seen"))


@query("select 's' || s_nationkey as id, (s_suppkey % 4)::int as level, s_suppkey::int as x, (s_suppkey % 7)::int as y, length(s_name || s_suppkey) as length, md5(s_name || s_suppkey) as md5 from supplier where s_suppkey % 5 <> 0")
def written_tiles(spark, sf_dir):
    """Tiles whose write is accepted go to files, twice, and are read back."""
    root = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    tiles = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("id"), (k % 4).cast("int").alias("level"), k.cast("int").alias("x"), (k % 7).cast("int").alias("y"), F.concat("s_name", k.cast("string")).cast("binary").alias("data"), F.when(k % 5 == 0, "fenced").otherwise("ok").alias("status"))
    for _ in range(2):
        objects.write_tiles(tiles, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.webp").load(root)
    read = objects.tile_paths(files.select("path", "length")).drop("length")
    return read.join(files.select("path", F.length("content").alias("length"), F.md5("content").alias("md5")), "path").drop("path")


@query("""
with p as (select s_suppkey, px, py, c, (px * 7 + py * 13 + c * 29 + s_suppkey) % 256 as v
           from supplier, (select unnest(range(40, 60)) as px), (select unnest(range(32)) as py), (select unnest(range(4)) as c) where s_suppkey % 3 = 0)
select 's' || s_suppkey as slide, (px // 20)::int as x, (py // 20)::int as y, 20 as width, (case when py < 20 then 20 else 12 end)::int as height, md5(unhex(string_agg(printf('%02x', v), '' order by py, px, c))) as md5
from p group by s_suppkey, px // 20, py // 20, case when py < 20 then 20 else 12 end
""")
def slide_regions(spark, sf_dir):
    """Raw slides of 60 by 32 pixels, written by tasks; of every third the last column of tiles is read back."""
    root = f"{shared_dir(spark)}/slides-{uuid.uuid4().hex}"

    def write(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                y, x, c = np.indices((32, 60, 4))
                raw_slide.write_raw(f"{root}/s{k}.raw", 60, 32, ((x * 7 + y * 13 + c * 29 + k) % 256).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    stage(spread(table(spark, sf_dir, "supplier").select("s_suppkey"), 2_000).mapInArrow(write, "id long"), "slides-written")
    raw_slide.register(spark)
    tiles = spark.read.format("raw_slide").option("path", root).option("tile", "20").load().where("x >= 2 and int(substring(slide, 2)) % 3 = 0")
    return tiles.select("slide", "x", "y", "width", "height", F.md5("pixels").alias("md5"))
