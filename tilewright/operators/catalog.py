"""Catalogue reads and writes: pages, child totals, merges, patches, soft deletes, cascades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import stage

#: The largest page.
MAX_LIMIT = 1000


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``, each with the count of all rows as full_count.

    The count is a one-row aggregate put beside the page, so no window gathers all rows in one task. A page beyond the
    end is empty.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be above 0 and offset 0 or more")
    total = df.agg(F.count("*").alias("full_count"))
    return df.orderBy(*order).offset(offset).limit(min(limit, MAX_LIMIT)).crossJoin(F.broadcast(total))


def paged_with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: Sequence[str], sums: Mapping[str, str], limit: int, offset: int = 0) -> DataFrame:
    """A page of parents with the number of their children and sums over them, zero if none.

    Children are cut down to the page's parents before they are aggregated; a page has ``MAX_LIMIT`` rows at most, so
    it is broadcast.
    """
    rows = page(parents, order, limit, offset)
    mine = children.join(F.broadcast(rows.select(F.col(key).alias(child_key))), child_key, "left_semi")
    agg = mine.groupBy(child_key).agg(F.count("*").alias("n_children"), *[F.sum(c).alias(n) for n, c in sums.items()])
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ["n_children", *sums]]
    return rows.join(agg, rows[key] == agg[child_key], "left").select(*[rows[c] for c in rows.columns], *filled)


def with_truncated(paged: DataFrame, offset: int) -> DataFrame:
    """Adds ``truncated``: more rows follow the page (W3). Rows of an empty page carry no count, so none is reported (Q8)."""
    length = paged.agg(F.count("*").alias("_length"))
    return paged.crossJoin(F.broadcast(length)).withColumn("truncated", F.lit(offset) + F.col("_length") < F.col("full_count")).drop("_length")


def live(deleted_at: str = "deleted_at") -> Column:
    """Not soft-deleted."""
    return F.col(deleted_at).isNull()


def visible(include_private: bool, private: str = "private") -> Column:
    """Public rows, or all of them."""
    return F.lit(include_private) | ~F.col(private)


def matching(equal: Mapping[str, object]) -> Column:
    """All of the filters whose value is given."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in equal.items() if v is not None], F.lit(True))


def search(text: str, *columns: str) -> Column:
    """Trimmed, lower-cased text is part of one of the columns; blank text matches all."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted)) for c in columns])


def lookup(df: DataFrame, key: str, value: object, deleted_at: str | None = None) -> DataFrame:
    """The row of one key, if there is one (S1, S3); with ``deleted_at``, only while it is live."""
    found = df.where(F.col(key) == F.lit(value))
    return found.where(live(deleted_at)) if deleted_at else found


def pruned(df: DataFrame, heavy: Sequence[str], wanted: bool = False) -> DataFrame:
    """A listing without its heavy columns, unless they are wanted (P7): the scan then doesn't read them."""
    return df if wanted else df.drop(*heavy)


def first_known(candidates: Sequence[Column], known: Sequence[object]) -> Column:
    """The first candidate that is one of the known values."""
    return F.coalesce(*[F.when(c.isin(*known), c) for c in candidates], F.lit(known[0]))


def first_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order`` (J13): one aggregate, no sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_first")).select("_first.*")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), reset: Sequence[str] = ()) -> DataFrame:
    """``base`` with ``changes`` put in by key.

    Columns of ``changes`` win where the key is there; those in ``keep`` stay as in ``base`` if it has the row, and
    those in ``reset`` become null in changed rows (a soft-deleted row comes back that way). ``changes`` holds a key
    once; see ``latest`` otherwise.
    """
    c = changes.select(*[F.col(x).alias(f"_new_{x}") for x in changes.columns])
    same = reduce(lambda a, b: a & b, [base[k].eqNullSafe(c[f"_new_{k}"]) for k in keys])
    b = base.withColumn("_old", F.lit(True))
    joined = b.join(c.withColumn("_changed", F.lit(True)), same, "full")

    def value(x: str) -> Column:
        old, changed = F.col(x), F.col("_changed").isNotNull()
        if x in keys:
            return F.coalesce(old, F.col(f"_new_{x}"))
        if x in reset:
            return F.when(changed, F.lit(None)).otherwise(old)
        if x not in changes.columns:
            return old
        if x in keep:
            return F.when(F.col("_old").isNotNull(), old).otherwise(F.col(f"_new_{x}"))
        return F.when(changed, F.col(f"_new_{x}")).otherwise(old)

    return joined.select(*[value(x).alias(x) for x in base.columns])


def patch(base: DataFrame, changes: DataFrame, key: str, touched: str | None = None, now: int = 0, always_touch: bool = False) -> DataFrame:
    """Partial update: a null in ``changes`` leaves the value (M4, M5).

    ``touched`` is the column to set to ``now``: only if some field was given, or for every patched row.
    """
    fields = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_new_{x}") for x in fields]).withColumn("_patched", F.lit(True))
    given = reduce(lambda a, b: a | b, [F.col(f"_new_{x}").isNotNull() for x in fields], F.lit(False))
    joined = base.join(c, base[key] == c["_key"], "left")

    def value(x: str) -> Column:
        if x == touched:
            return F.when(F.col("_patched").isNotNull() & (F.lit(always_touch) | given), F.lit(now)).otherwise(F.col(x))
        return F.coalesce(f"_new_{x}", x) if x in fields else F.col(x)

    return joined.select(*[value(x).alias(x) for x in base.columns])


def patch_outcome(base: DataFrame, changes: DataFrame, key: str, deleted_at: str = "deleted_at") -> DataFrame:
    """For each patch: NotFound, Deleted or Updated (M5)."""
    known = base.select(F.col(key), F.col(deleted_at).isNotNull().alias("_gone"))
    outcome = F.when(F.col("_gone").isNull(), "NotFound").when(F.col("_gone"), "Deleted").otherwise("Updated")
    return changes.select(key).join(known, key, "left").select(key, outcome.alias("outcome"))


def soft_delete(base: DataFrame, gone: DataFrame, key: str, now: int, deleted_at: str = "deleted_at") -> DataFrame:
    """Sets deleted_at once; rows already deleted keep theirs (M6)."""
    c = gone.select(F.col(key).alias("_key")).distinct()
    hit = F.col("_key").isNotNull() & F.col(deleted_at).isNull()
    return base.join(c, base[key] == c["_key"], "left").select(*[F.when(hit, F.lit(now)).otherwise(F.col(x)).alias(x) if x == deleted_at else F.col(x) for x in base.columns])


def cascade(gone: DataFrame, key: str, children: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What stays of each child table, parent before child, when the rows of ``gone`` go (M7).

    ``children``: (table, its reference to the parent, its own key).
    """
    out, lost = [], gone.select(F.col(key).alias("_gone")).distinct()
    for df, reference, own in children:
        out.append(df.join(lost, df[reference] == lost["_gone"], "left_anti"))
        lost = df.join(lost, df[reference] == lost["_gone"], "left_semi").select(F.col(own).alias("_gone")).distinct()
    return out


def without_descendants(df: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows of a table that refers to itself, without those of ``gone`` (its keys) and all below them (M7 at any depth).

    Every row looks at its ancestor one step up, then two, four and so on, and is lost if that or what that has seen is:
    rounds are logarithmic in the depth, and end when nothing more is lost. Rows whose parent is null or not there stay
    unless named; so do rows that only go round in a ring. A null key is no one's parent. ``key`` is unique.
    """
    named = gone.select(F.col(key).alias("_gone")).distinct()
    steps = df.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("up"))
    state = stage(steps.join(named, steps["node"] == named["_gone"], "left").select("node", "up", F.col("_gone").isNotNull().alias("lost")), "tree")
    before = state.where("lost").count()
    while True:
        above = state.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("lost").alias("_lost"))
        # Those that are lost, or have no one above, look no further.
        looking = state.where("not lost and up is not null").join(above, F.col("up") == F.col("_node"), "left").select("node", F.col("_up").alias("up"), F.coalesce("_lost", F.lit(False)).alias("lost"))
        state = stage(state.where("lost or up is null").union(looking), "tree")
        now = state.where("lost").count()
        if now == before:
            lost = state.where("lost").select("node")
            return df.join(lost, df[key] == lost["node"], "left_anti")
        before = now


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order`` (ST13, R7)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_last")).select("_last.*")


def dispatch(listing: DataFrame, ledger: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Keys to dispatch: listed, not in the ledger as dispatched, in order of the key, ``most`` new ones at most.

    Publishing them and then appending them to the ledger repeats a key at worst; consumers drop repeats by message id.
    """
    done = ledger.where("dispatched_at is not null").select(key)
    fresh = listing.select(key).distinct().join(done, key, "left_anti").orderBy(key)
    return fresh if most is None else fresh.limit(most)


def dispatch_counts(listing: DataFrame, ledger: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """dispatched, skipped and failed keys."""
    done = ledger.where("dispatched_at is not null").select(key, F.lit(True).alias("_done"))
    marked = listing.select(key).distinct().join(done, key, "left").join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
    result = F.when(F.col("_done").isNotNull(), "skipped").when(F.col("_failed").isNotNull(), "failed").otherwise("dispatched")
    return marked.groupBy(result.alias("result")).agg(F.count("*").alias("keys"))


def backfill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls of the named columns filled."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def merge_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not there, put before ``existing`` (U3); ``front`` keeps the order."""
    fresh = incoming.join(existing.select(key), key, "left_anti").select(*existing.columns)
    return fresh.withColumn("front", F.lit(True)).unionByName(existing.withColumn("front", F.lit(False)))


def append_page(shown: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Rows shown, and after them those of the next page that are not shown yet (U4); ``appended`` tells which."""
    fresh = fetched.join(shown.select(key), key, "left_anti").select(*shown.columns)
    return shown.withColumn("appended", F.lit(False)).unionByName(fresh.withColumn("appended", F.lit(True)))


def difference(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, action) to create what is desired only and delete what exists only."""
    create = desired.select(key).distinct().join(existing, key, "left_anti").withColumn("action", F.lit("create"))
    delete = existing.select(key).distinct().join(desired, key, "left_anti").withColumn("action", F.lit("delete"))
    return create.unionByName(delete)


def keep_last(df: DataFrame, partition: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each partition in ``order``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def stale_pending(df: DataFrame, partition: Sequence[str], at: str, now: Column, id_column: str, limit: int = 100, most_age: int = 30_000, target: int = 50) -> DataFrame:
    """Pending entries that stay (O17): over ``limit``, those older than ``most_age`` go, then the oldest down to ``target``."""
    w = Window.partitionBy(*partition)
    counted = df.withColumn("_n", F.count("*").over(w))
    young = counted.where((F.col("_n") <= limit) | (now - F.col(at) <= most_age))
    newest = Window.partitionBy(*partition).orderBy(F.desc(at), F.desc(id_column))
    ranked = young.withColumn("_left", F.count("*").over(w)).withColumn("_nth", F.row_number().over(newest))
    return ranked.where((F.col("_n") <= limit) | (F.col("_left") <= limit) | (F.col("_nth") <= target)).drop("_n", "_left", "_nth")
