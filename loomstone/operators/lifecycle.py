"""Mutations of an entity frame: insert, update, remove, replay of a log, merge. Frames in, frames out.

A batch is checked as a whole before anything changes."""

from __future__ import annotations

from dataclasses import dataclass

from loomstone.errors import EntityAlreadyExists, EntityNotFound
from loomstone.schema import conform
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many of the offending ids an error names.
SHOWN = 20


def _ids(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("entity_id").distinct().limit(SHOWN).collect()]


def existing(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of the batch that are in entities, or in the batch more than once."""
    ids = batch.select("entity_id")
    twice = ids.groupBy("entity_id").count().where("count > 1").select("entity_id")
    return ids.join(entities, "entity_id", "left_semi").unionByName(twice)


def missing(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("entity_id").join(entities, "entity_id", "left_anti")


def insert(entities: DataFrame, batch: DataFrame, check: bool = True) -> DataFrame:
    """entities and the batch, which goes after all in its own order."""
    batch = conform(batch)
    if check and (found := _ids(existing(entities, batch))):
        raise EntityAlreadyExists(found)
    last = entities.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    first = batch.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("first"))
    bounds = last.crossJoin(first)  # one row
    moved = batch.crossJoin(F.broadcast(bounds)).withColumn("ord", F.col("last") + 1 + F.col("ord") - F.col("first")).drop("last", "first")
    return entities.unionByName(moved)


def remove(entities: DataFrame, ids: DataFrame, check: bool = True) -> DataFrame:
    if check and (found := _ids(missing(entities, ids))):
        raise EntityNotFound(found)
    return entities.join(ids.select("entity_id"), "entity_id", "left_anti")


def update(entities: DataFrame, batch: DataFrame, check: bool = True) -> DataFrame:
    """Replaces whole entities; they keep their place in the order."""
    batch = conform(batch)
    if check:
        if found := _ids(missing(entities, batch)):
            raise EntityNotFound(found)
        if found := _ids(batch.groupBy("entity_id").count().where("count > 1")):
            raise EntityAlreadyExists(found)
    places = entities.select("entity_id", F.col("ord").alias("kept_ord"))
    fresh = batch.drop("ord").join(places, "entity_id").withColumnRenamed("kept_ord", "ord")
    return entities.join(batch.select("entity_id"), "entity_id", "left_anti").unionByName(fresh)


def judged(log: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """log (seq, op, entity_id, ...) with ``error``: EntityAlreadyExists for an insert of what is there, EntityNotFound for an
    update or removal of what is not. An operation in error changes nothing. present: ids that are there at the start.

    Whether an entity is there depends on the last insert or removal before: an insert, valid or not, leaves it there, a
    removal leaves it gone."""
    before = W.partitionBy("entity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op").isin("insert", "remove"), F.col("op")), ignorenulls=True).over(before)
    start = F.lit(False)
    if present is not None:
        log = log.join(present.select("entity_id", F.lit(True).alias("at_start")).distinct(), "entity_id", "left")
        start = F.coalesce("at_start", F.lit(False))
    there = F.coalesce(state == "insert", start)
    error = F.when((F.col("op") == "insert") & there, "EntityAlreadyExists").when(F.col("op").isin("update", "remove") & ~there, "EntityNotFound")
    return log.withColumn("error", error).drop("at_start")


def replay(entities: DataFrame, log: DataFrame) -> DataFrame:
    """The state after a log of valid operations (seq, op, entity_id, payload columns of ENTITY): the last operation of each
    entity wins; an entity's place is that of its first insert after its last removal, or the one it had."""
    others = [c for c in log.columns if c != "entity_id"]
    # in a valid log an entity's last insert is the first after its last removal; both sums combine before the shuffle
    final = log.groupBy("entity_id").agg(F.max_by(F.struct(*others), "seq").alias("last"), F.max(F.when(F.col("op") == "insert", F.col("seq"))).alias("inserted"))
    final = final.select("entity_id", "inserted", *[F.col(f"last.{c}").alias(c) for c in others])
    places = entities.select("entity_id", F.col("ord").alias("had"))
    end = entities.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("end"))
    alive = final.where("op <> 'remove'").join(places, "entity_id", "left").crossJoin(F.broadcast(end))  # one row
    alive = alive.withColumn("ord", F.coalesce(F.col("end") + 1 + F.col("inserted"), F.col("had"), F.col("end") + 1 + F.col("seq")))
    untouched = entities.join(final.select("entity_id"), "entity_id", "left_anti")
    return untouched.unionByName(conform(alive))


@dataclass(frozen=True)
class MergeReport:
    entities_added: int
    entities_skipped: int


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """All of left, then what right has besides; for an id in both, left's entity stays."""
    return insert(left, right.join(left.select("entity_id"), "entity_id", "left_anti"), check=False)


def merge_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: entities_added and entities_skipped, counting rows of both sides as they are written to a new store."""
    both = right.join(left.select("entity_id", F.lit(1).alias("seen")), "entity_id", "left")
    counts = both.agg(F.count(F.when(F.col("seen").isNull(), 1)).alias("new"), F.count("seen").alias("entities_skipped"))
    return counts.crossJoin(left.agg(F.count(F.lit(1)).alias("n"))).select((F.col("n") + F.col("new")).alias("entities_added"), "entities_skipped")  # one row each
