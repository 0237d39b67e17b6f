"""Sharded placement: slots, routing, replication logs, lag, failover and convergence, as queries over status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import ranks
from tilewright.operators.catalog import latest

SLOTS, BATCH, BACKLOG = 16_384, 128, 4096


def _crc_step(nibble: int) -> int:
    """What four highest bits of a CRC-16 become when they are shifted out; polynomial 0x1021."""
    crc = nibble << 12
    for _ in range(4):
        crc = (crc << 1 ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def crc16(data: Column) -> Column:
    """CRC-16, polynomial 0x1021 from 0, highest bit first (R1): folded over the hex digits, one lookup for each."""
    digits = F.transform(F.split(F.hex(data), ""), lambda c: F.position(c, F.lit("0123456789ABCDEF")) - 1)
    steps = F.array(*[F.lit(_crc_step(n)) for n in range(16)])
    step = lambda crc, d: F.get(steps, F.shiftright(crc, 12).bitwiseXOR(d)).bitwiseXOR(F.shiftleft(crc, 4).bitwiseAND(F.lit(0xFFFF)))
    return F.when(F.octet_length(data) == 0, F.lit(0)).otherwise(F.aggregate(digits, F.lit(0), step))


def little_endian(value: Column) -> Column:
    """A number as 4 bytes, lowest first."""
    h = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def _crc_at(after: int) -> Column:
    """What each value of a byte adds to a CRC-16 from 0, with ``after`` bytes behind it."""
    out = []
    for byte in range(256):
        crc = 0
        for digit in (byte >> 4, byte & 15, *[0] * (2 * after)):
            crc = _crc_step(crc >> 12 ^ digit) ^ (crc << 4 & 0xFFFF)
        out.append(crc)
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>")  # one constant, not 256


def slot(image_id: Column, x: Column, y: Column, level: Column) -> Column:
    """Slot of a tile: CRC-16 of its id (16 bytes) and its place, 4 bytes each, lowest first.

    From 0 a CRC is the exclusive or of what each byte adds at its place, so 28 lookups stand side by side, and all of it
    is compiled; see ``crc16`` for bytes of any number.
    """
    h = F.hex(image_id)
    size = 28
    found, place = [], 0
    for start, n in ((0, 7), (7, 7), (14, 2)):  # as many bytes as a long holds, highest first
        part = F.conv(F.substring(h, 2 * start + 1, 2 * n), 16, 10).cast("long")
        found += [(F.shiftrightunsigned(part, 8 * (n - 1 - k)), place + k) for k in range(n)]
        place += n
    for value in (x, y, level):
        found += [(F.shiftrightunsigned(value.cast("long"), 8 * k), place + k) for k in range(4)]
        place += 4
    adds = [F.get(_crc_at(size - 1 - at), v.bitwiseAND(F.lit(255)).cast("int")) for v, at in found]
    crc = adds[0]
    for a in adds[1:]:
        crc = crc.bitwiseXOR(a)
    return F.pmod(crc, F.lit(SLOTS))


def slot_owner(slot_: Column, shards: int | Column, slots: int = SLOTS) -> Column:
    """Shard of a slot: equal runs of slots (R2)."""
    return F.floor(slot_ * shards / F.lit(slots)).cast("int")


def slot_table(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for all slots (R2)."""
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), slot_owner(F.col("id"), shards, slots).alias("shard"))


def routed(tiles: DataFrame, table: Column, local: Column) -> DataFrame:
    """Adds ``shard`` from an array by slot; the local shard where the slot has none."""
    return tiles.withColumn("shard", F.coalesce(F.try_element_at(table, (F.col("slot") + 1).cast("int")), local))


def misplaced(tiles: DataFrame) -> DataFrame:
    """Tiles held by another shard than their slot's (R9), oldest first in ``turn`` for migration."""
    return ranks.numbered(tiles.where("held_by <> shard"), ["held_by"], ["stored_at", "slot", "level", "y", "x"], "turn")


def migration_wait(failures: Column) -> Column:
    """Milliseconds before a failed migration is tried again: 100 * min(n, 20)."""
    return F.least(failures, F.lit(20)) * 100


def write_status() -> Column:
    """ok, or why a write is refused: not master, no epoch, or another owner (R4, S9). Columns: role, epoch, shard, local."""
    return F.when(F.col("role") != "master", "not_master").when(F.col("epoch") <= 0, "no_epoch").when(F.col("shard") != F.col("local"), "not_owner").otherwise("ok")


def migration_status() -> Column:
    """Whether a migrated tile is accepted (R11). Columns: role, shard, local, config_epoch, sender_epoch."""
    return F.when(F.col("role") != "master", "not_master").when(F.col("shard") != F.col("local"), "not_owner").when(F.col("sender_epoch") < F.col("config_epoch"), "stale_epoch").otherwise("ok")


def installed(configs: DataFrame, shard: str = "shard_id", epoch: str = "config_epoch", seq: str = "seq") -> DataFrame:
    """Each config with ``accepted``: its epoch is above all before it."""
    before = Window.partitionBy(shard).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return configs.withColumn("accepted", F.col(epoch) > F.coalesce(F.max(epoch).over(before), F.lit(-1)))


def sync_plan(replicas: DataFrame) -> DataFrame:
    """What a replica gets: reject (it is ahead), snapshot (its next entry has left the backlog), batches or heartbeat."""
    behind = F.col("last_offset") - F.col("applied_offset")
    action = F.when(behind < 0, "reject").when(behind == 0, "heartbeat").when(F.col("applied_offset") + 1 < F.col("backlog_start"), "snapshot").otherwise("batches")
    return replicas.withColumn("action", action).withColumn("batches", F.when(F.col("action") == "batches", F.ceil(behind / F.lit(BATCH))).otherwise(0).cast("long"))


def log_batches(log: DataFrame, shard: str, offset: str) -> DataFrame:
    """Log entries with their batch of 128."""
    return ranks.numbered(log, [shard], [offset], "_nth").withColumn("batch", F.floor((F.col("_nth") - 1) / F.lit(BATCH))).drop("_nth")


def applied(log: DataFrame, key: str, offset: str) -> DataFrame:
    """The state after a log: the last write of each key."""
    return latest(log, key, [offset])


def lag(known: Column, applied_: Column) -> Column:
    """Entries that a replica is behind, 0 at least."""
    return F.greatest(F.lit(0), known - applied_)


def shard_summary(status: DataFrame) -> DataFrame:
    """Largest offset and config epoch, and number of ready replicas of each shard."""
    return status.groupBy("shard_id").agg(F.max("offset").alias("current_offset"), F.max("config_epoch").alias("config_epoch"), F.count_if("ready").alias("ready_replicas"))


def with_status(shards: DataFrame, summary: DataFrame) -> DataFrame:
    """All shards with their summary, zeros where none is known."""
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in summary.columns if c != "shard_id"]
    return shards.join(summary, "shard_id", "left").select(*shards.columns, *filled)


def _fresh(now: int, timeout: int) -> Column:
    return F.col("ready") & (F.greatest(F.lit(0), F.lit(now) - F.col("last_heartbeat")) <= timeout)


def best_replica(replicas: DataFrame, now: int, timeout: int) -> DataFrame:
    """Ready and fresh replica of least lag, unknown lag last, then by name (A10)."""
    ok = replicas.where(_fresh(now, timeout) & (F.col("role") == "replica"))
    return ok.groupBy("shard_id").agg(F.min_by("name", F.struct(F.coalesce("lag", F.lit(2**63 - 1)), "name")).alias("promote"))


def failover(replicas: DataFrame, epochs: DataFrame, now: int, timeout: int) -> DataFrame:
    """Promotions (R13): shards whose master is not ready and fresh, not cooling down, with a candidate.

    ``epochs``: shard_id, epoch, cooldown. Returns shard_id, promote, demote and new_epoch.
    """
    masters = replicas.groupBy("shard_id").agg(F.coalesce(F.bool_or(F.when(F.col("role") == "master", _fresh(now, timeout))), F.lit(False)).alias("healthy"), F.sort_array(F.collect_list(F.when(F.col("role") == "master", F.col("name")))).alias("masters"))
    found = masters.where("not healthy").join(best_replica(replicas, now, timeout), "shard_id").join(epochs.where("not cooldown"), "shard_id")
    return found.select("shard_id", "promote", F.array_remove("masters", F.col("promote")).alias("demote"), (F.col("epoch") + 1).alias("new_epoch"))


def next_epoch(current: Column, shards_before: Column, shards: Column) -> Column:
    """1 at first, one more when the number of shards changes (R14). Arguments: epoch, old and new number."""
    return F.when(current == 0, F.lit(1)).when(shards_before != shards, current + 1).otherwise(current)


def cluster_phase(status: DataFrame, cluster: str, target_epoch: str, healthy: str) -> DataFrame:
    """Degraded, Ready or Reconciling for each cluster."""
    converged = (F.col("config_epoch") >= F.col(target_epoch)) & (F.col("migration_queue_len") == 0) & (F.col("misplaced_tiles") == 0)
    return status.groupBy(cluster).agg(F.when(~F.bool_and(healthy), "Degraded").when(F.bool_and(converged), "Ready").otherwise("Reconciling").alias("phase"))


def reconcile(replicas: DataFrame, shards: DataFrame, now: int, timeout: int, target_epoch: int) -> DataFrame:
    """One row per shard: summary, promotion if due, and phase of the cluster (R16). ``shards``: shard_id, cluster, epoch, cooldown, expected_replicas, migration_queue_len, misplaced_tiles."""
    s = with_status(shards, shard_summary(replicas))
    s = s.withColumn("healthy", F.col("ready_replicas") >= F.col("expected_replicas")).withColumn("target", F.lit(target_epoch))
    phase = cluster_phase(s, "cluster", "target", "healthy")
    moves = failover(replicas, shards.select("shard_id", "epoch", "cooldown"), now, timeout)
    return s.join(moves, "shard_id", "left").join(phase, "cluster").drop("target")


def pod_name(cluster: Column, shard: Column, replica: Column) -> Column:
    """<cluster>-s<shard>-r<replica>."""
    return F.concat(cluster, F.lit("-s"), shard.cast("string"), F.lit("-r"), replica.cast("string"))


def pod_parts(name: Column) -> dict[str, Column]:
    part = lambda k: F.nullif(F.regexp_extract(name, r"^(.*)-s(\d+)-r(\d+)$", k), F.lit(""))
    return {"cluster": part(1), "shard": part(2).cast("int"), "replica": part(3).cast("int")}


def desired_pods(clusters: DataFrame) -> DataFrame:
    """Names of all pods of clusters (cluster, shards, replicas) (U1, U2); feed ``catalog.difference``."""
    rows = clusters.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)))
    return rows.select("cluster", pod_name(F.col("cluster"), F.col("shard"), F.col("replica")).alias("pod"))
