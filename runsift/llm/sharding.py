"""Shards by balanced label propagation: linked documents move together under capacity quotas.

Documents are linked if their texts are equal; a group stands for all its links, so no pairs are
made. A group that holds very many documents is cut into SALTS units by a hash of the id, any other
document of a group is (nearly always) a unit of its own. Every unit starts in the shard that a
hash gives it. In each round a unit wants to go where most documents of its group are, among shards
with room; a shard takes as many as its quota leaves, those with the largest gain first. Gains are
counted in classes, at most shards x 64 of them, and a class that does not fit whole is taken in
part, by a hash of the group.

Last, counts are made exact (law `rows`: counts of the shards differ by one at most): documents
beyond a shard's quota and documents without a group fill the free places. Numbers come from counts
of hash buckets, so no shard's documents meet in one task.

Null texts have size 8, check sum 0 and no group. Rows that repeat an id are separate documents. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import buckets_for, forget, numbered, whole_text, written

SALTS = 64


def _load(units: DataFrame, shards: int) -> list[int]:
    """Documents in each shard; one row for each shard."""
    load = [0] * shards
    for row in units.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[row["shard"]] = row["n"]
    return load


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def propagate(units: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """units (g, salt, n, shard) with new shards."""
    shards = len(quotas)
    rounds_before = None
    for turn in range(rounds):
        load = _load(units, shards)
        room = [max(0, q - n) for q, n in zip(quotas, load)]
        here = units.groupBy("g", "shard").agg(F.sum("n").alias("here"))
        # A group goes where most of it is, if there is room for any; a group of which all shards
        # are full stays.
        free = F.array(*[F.lit(r > 0) for r in room])
        best = (
            here.where(F.element_at(free, F.col("shard") + 1))
            .groupBy("g")
            .agg(F.max(F.struct("here", (-F.col("shard")).alias("minus"))).alias("b"))
            .select("g", (-F.col("b.minus")).alias("target"), F.col("b.here").alias("there"))
        )
        wish = (
            units.join(here, ["g", "shard"])
            .join(best, "g", "left")
            .withColumn("gain", F.coalesce(F.col("there") - F.col("here"), F.lit(-1)))
            # Equal shares: the smaller shard number attracts, so that two halves don't swap.
            .withColumn("moves", (F.col("target") != F.col("shard")) & ((F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("target") < F.col("shard")))))
            .withColumn("class", F.when(F.col("moves"), F.least(F.lit(63), F.log2(F.col("gain") + 1).cast("int"))))
        )
        wish = written(wish.select("g", "salt", "n", "shard", "target", "class"), "shards-wish")
        classes = wish.where("class is not null").groupBy("target", "class").agg(F.sum("n").alias("n")).collect()
        if not classes:
            forget(wish)
            return units
        share: dict[tuple[int, int], float] = {}
        for row in sorted(classes, key=lambda r: (r["target"], -r["class"])):
            left = room[row["target"]]
            share[row["target"], row["class"]] = min(1.0, left / row["n"])
            room[row["target"]] = max(0, left - row["n"])
        # shards x 64 numbers at most
        table = F.array(*[F.lit(share.get((t, c), 0.0)) for t in range(shards) for c in range(64)])
        taken = F.element_at(table, F.coalesce(F.col("target") * 64 + F.col("class"), F.lit(0)).cast("int") + 1)
        coin = F.pmod(F.xxhash64("g", "salt", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = F.col("class").isNotNull() & (coin < taken)
        units = written(
            wish.select("g", "salt", "n", F.when(moved, F.col("target")).otherwise(F.col("shard")).cast("int").alias("shard")), "shards-units"
        )
        forget(wish)
        if rounds_before is not None:
            forget(rounds_before)
        rounds_before = units
    return units


def shard(docs: DataFrame, shards: int = 24, rounds: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 8), text_crc32, law (`rows`), shard, slot (gapless from 0)."""
    body = F.encode(whole_text(text), "UTF-8")
    base = written(
        docs.select(
            F.col(key).alias("id"),
            (F.octet_length(whole_text(text)) + 8).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.when(F.col(text).isNotNull(), F.md5(body)).alias("g"),
            F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "shards-base",
    )
    total = base.count()
    quotas = _quotas(total, shards)
    units = (
        base.where("g is not null")
        .groupBy("g", "salt")
        .agg(F.count("*").alias("n"))
    )
    groups = units.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    start = F.pmod(F.xxhash64("salt", "g"), F.lit(shards)).cast("int")
    units = written(units.join(groups, "g").withColumn("shard", start), "shards-units")
    units = propagate(units, quotas, rounds)

    placed = base.join(units.select("g", "salt", "shard"), ["g", "salt"], "left")
    buckets = buckets_for(total // shards)
    linked = numbered(placed.where("shard is not null"), ["shard"], ["id"], buckets, "slot")
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
    linked = written(linked.withColumn("stays", F.col("slot") < quota), "shards-linked")
    full = [0] * shards
    for row in linked.where("stays").groupBy("shard").count().collect():
        full[row["shard"]] = row["count"]
    columns = ["id", "size", "text_crc32", "shard", "slot"]
    rest = placed.where("shard is null").select("id", "size", "text_crc32").unionByName(
        linked.where("not stays").select("id", "size", "text_crc32")
    )
    filled = numbered(rest, [], ["id"], buckets_for(total), "place")
    # Free places of the shards, one shard after the other.
    ends, at = [], 0
    for q, n in zip(quotas, full):
        at += q - n
        ends.append(at)
    target = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        target = F.when(F.col("place") < ends[s], s).otherwise(target)
    shift = F.array(*[F.lit(full[s] - (ends[s - 1] if s else 0)).cast("bigint") for s in range(shards)])
    filled = filled.withColumn("shard", target.cast("int")).withColumn(
        "slot", F.col("place") + F.element_at(shift, F.col("shard") + 1)
    )
    return (
        linked.where("stays").select(*columns).unionByName(filled.select(*columns))
        .select(F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"))
    )
