"""Sharding by balanced label propagation.

Documents are linked through groups (a link between two documents is a group of two). Each round is a few joins and partial
aggregates: the documents of each group are counted by shard, every document scores the shards of its groups' members, and
asks to move to the best one. Quotas keep sizes: the linked documents of a shard stay within its even share. Which moves are
granted is decided from counts by priority, where documents of one group share a priority and so move together. Counts by pair
of shards and priority are all that reaches the driver, and their number is fixed. At the end, what a shard has over its even
share goes to those with room, documents without links first, so that counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import buckets_of, discard, ranked, staged

PRIORITIES = 256


def _hash_below(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _grants(asked: dict[int, dict[int, dict[int, int]]], linked: dict[int, int], share: int) -> list[tuple[int, int, int, int]]:
    """(from, to, priorities below this move, and so many of this priority): linked rows never exceed a shard's share.

    asked: how many ask, by shard wanted, priority and present shard."""
    out = []
    for to, by in sorted(asked.items()):
        room = max(0, share - linked.get(to, 0))
        cut, also = PRIORITIES, {}
        for p in sorted(by):
            n = sum(by[p].values())
            if n > room:
                cut = p
                for start, k in sorted(by[p].items()):
                    also[start] = min(k, room)
                    room -= also[start]
                break
            room -= n
        starts = {start for p in by for start in by[p]}
        out += [(start, to, cut, also.get(start, 0)) for start in sorted(starts)]
    return out


def propagate(nodes: DataFrame, members: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """Moves linked nodes towards shards where their groups are; staged nodes(node, shard, linked), members(node, grp, weight).

    Returns nodes with the new shard. Linked nodes of a shard stay within its even share, so that nodes without links can
    make up the rest. A shard that is full is settled: nobody asks for it or leaves it, so a group of several shares' size fills
    one shard after the other. Ends when nothing moves. Groups of any size are only ever aggregated, or joined where Spark
    splits large keys.
    """
    count = {r["shard"]: (r["n"], r["k"]) for r in nodes.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("linked").alias("k")).collect()}
    total = sum(n for n, _ in count.values())
    share = total // shards
    linked = {s: k for s, (_, k) in count.items()}
    for k in range(rounds):
        full = [s for s, n in linked.items() if n >= share]
        at = members.join(nodes.filter(~F.col("shard").isin(full)) if full else nodes, "node")
        tally = at.groupBy("grp", "shard").agg(F.sum("weight").alias("w"))
        best = Window.partitionBy("grp").orderBy(F.desc("w"), _hash_below(1 << 30, "grp", "shard"))
        # a group has at most as many rows here as there are shards
        top = tally.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("grp", F.col("shard").alias("to"), "w")
        score = members.join(top, "grp").groupBy("node", "to").agg(F.sum(F.col("w") * F.col("weight")).alias("w"), F.min("grp").alias("grp"))
        want = score.groupBy("node").agg(F.max(F.struct("w", "to", "grp")).alias("x")).select("node", F.col("x.to").alias("to"), F.col("x.grp").alias("grp"))
        asking = (nodes.filter(~F.col("shard").isin(full)) if full else nodes).join(want, "node").filter("shard <> to").withColumn("p", _hash_below(PRIORITIES, "grp"))
        asking = staged(asking.select("node", "shard", "to", "p"), f"moves-{k}")
        asked: dict[int, dict[int, dict[int, int]]] = {}
        for r in asking.groupBy("shard", "to", "p").agg(F.count("*").alias("n")).collect():
            asked.setdefault(r["to"], {}).setdefault(r["p"], {})[r["shard"]] = r["n"]
        grants = _grants(asked, linked, share)
        if not any(below or also for _, _, below, also in grants):
            break
        given = nodes.sparkSession.createDataFrame(grants, "shard int, to int, below int, also long")
        moving = asking.join(F.broadcast(given), ["shard", "to"]).filter("p <= below")
        part = ranked(moving.filter("p = below"), ["shard", "to"], ["node"], "_place", buckets=buckets_of(total)).filter("_place < also")
        moves = moving.filter("p < below").select("node", "to").unionByName(part.select("node", "to"))
        dead = nodes
        nodes = staged(nodes.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard"), "linked"), f"shards-{k}")
        discard(dead, asking)
        linked = {r["shard"]: r["k"] for r in nodes.groupBy("shard").agg(F.count_if("linked").alias("k")).collect()}
    return nodes


def even(nodes: DataFrame, shards: int, loose: Column) -> DataFrame:
    """nodes(node, shard, ...) with counts at most one apart, and slot, gapless from 0 in each shard.

    What is over a shard's share moves on: rows for which loose holds first."""
    placed = ranked(nodes, ["shard"], ["node"], "_place", first=F.when(loose, 1).otherwise(0))
    have = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    share = {s: total // shards for s in range(shards)}
    for s in sorted(share, key=lambda s: (-have.get(s, 0), s))[: total % shards]:
        share[s] += 1
    over, at = [], 0
    for s in range(shards):
        extra = max(0, have.get(s, 0) - share[s])
        over.append((s, share[s], at))
        at += extra
    room, at = [], 0
    for s in range(shards):
        free = max(0, share[s] - have.get(s, 0))
        if free:
            room.append((at, at + free, s, have.get(s, 0)))
            at += free
    # arithmetic over constants, one branch a shard: no join, and nothing that grows
    first_over = F.element_at(F.create_map(*[F.lit(x) for s, _, a in over for x in (s, a)]), F.col("shard"))
    quota = F.element_at(F.create_map(*[F.lit(x) for s, q, _ in over for x in (s, q)]), F.col("shard"))
    extra = F.col("_place") - quota
    to, slot = F.col("shard"), F.col("_place")
    for lo, hi, s, base in room:
        here = (extra >= 0) & (first_over + extra >= lo) & (first_over + extra < hi)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, first_over + extra - lo + base).otherwise(slot)
    return placed.withColumn("_to", to).withColumn("slot", slot.cast("long")).withColumn("shard", F.col("_to").cast("int")).drop("_to", "_place")


def shard_rows(docs: DataFrame, links: DataFrame | None = None, shards: int = 16, rounds: int = 8, text_col: str = "text") -> DataFrame:
    """Puts every row of docs(doc_id, text) into one of so many shards, counts at most one apart, linked rows together.

    links(doc_id, grp string) names the groups of documents; without it, a group is the rows of equal text. Returns doc_id,
    size (bytes of the text plus 1; a null text is empty), text_crc32, shard, slot. Other columns are not read. A null doc_id
    is kept as any other and is in no group of links; equal rows are separate rows. Empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_text"))
    slim = slim.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    # node: a number for each row, by content, so that a task that runs again gives the same one
    slim = slim.withColumn("_part", _hash_below(buckets_of(docs.count(), 4096), "_id", "_text"))
    slim = slim.withColumn("node", F.col("_part").cast("long") * F.lit(1 << 40) + F.row_number().over(Window.partitionBy("_part").orderBy("_id", "_text")))
    slim = staged(slim.drop("_part"), "rows")
    if links is None:
        # staged, so that Spark can split the rows of a large group in the join
        sizes = staged(slim.groupBy("_text").agg(F.count("*").alias("_n")).filter("_n > 1"), "groups")
        members = slim.join(sizes, "_text").select("node", F.col("_text").alias("grp"), F.lit(1).cast("long").alias("weight"))
    else:
        own = links.filter("doc_id is not null and grp is not null").select(F.col("doc_id").cast("string").alias("_id"), "grp").distinct()
        members = slim.select("node", "_id").join(own, "_id").select("node", "grp", F.lit(1).cast("long").alias("weight"))
    members = staged(members, "members")
    linked = members.select("node").distinct().withColumn("linked", F.lit(True))
    nodes = slim.select("node", _hash_below(shards, "node").alias("shard")).join(linked, "node", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    nodes = propagate(staged(nodes, "shards"), members, shards, rounds)
    placed = even(nodes, shards, ~F.col("linked"))
    return slim.join(placed.select("node", "shard", "slot"), "node").select("doc_id", "size", "text_crc32", "shard", "slot")
