"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations alone.

Sources, in order of their code points and null last, weigh 5, 2, 1, repeating. They share EPOCH times all
words by weight; a source's target stops at MOST times its own words, and what is over goes to the others
by weight until none is above. Targets come from a water level: sources are ordered by the level at which
they fill, and the last level that fits is found from running sums.

Documents are dealt by a hash of their ids into shards of each source, SHARDS of them, and twice as many
for each doubling of all words above SHARDS * SHARD_WORDS, so that a shard stays a task's work at any size. A shard's documents lie in
an order drawn by a seeded hash, and its words are cut into equal blocks of BLOCK words. Blocks are
allocated by highest quotients (votes / (2 seats + 1)): first to sources, by their targets, then to the
shards of each source, by their words. A shard with a quota of q blocks gives every block as often as q
fills the shard, and the first blocks of its seeded order once more. A document takes the words that its
place shares with those blocks.

Only quotients near the cut are listed: with the common divisor a source has the rounded number of seats,
and the divisor that fits differs by so little that seats move by half the number of parties times the
party's share at most. So the work grows with the number of sources and shards, not with the blocks.

Defined results: a null text, or one without a word, has size 0 and takes 0. Null is a source of its own,
the last. Rows without doc_id take part. Rows that repeat a doc_id lie next to each other in a fixed order by
size and are taken one by one. An empty table gives no rows. Ties between quotients go to the earlier source
or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import spare, stored

# Fixed values.
WEIGHTS = (5, 2, 1)
EPOCH = 1.5
MOST = 2
SHARDS = 64
SHARD_WORDS = 1 << 25
BLOCK = 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null: 0. Counted as the starts of words, so that no list of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column) -> Column:
    """28 bits by which documents are dealt and ordered; any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 7), 16, 10).cast("long")


def water_level(sources: DataFrame) -> DataFrame:
    """source, source_size -> source, source_size, target. One row a source: a small table."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MOST)
    fill = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("filled", F.coalesce(F.sum("cap").over(fill), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    all_ = W.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(all_) * F.lit(EPOCH)).withColumn("weights", F.sum("weight").over(all_))
    # the level if this source and all that fill later are not full; it holds for the first that does not fill
    s = s.withColumn("level", (F.col("budget") - F.col("filled")) / (F.col("weights") - F.col("spent")))
    level = F.max(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))).over(all_)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return s.select("source", "source_size", "rank", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: str, out: str) -> DataFrame:
    """`parties` with the seats that each gets of its group's `seats`, by Sainte-Lague.

    Quotients are votes / (2 k + 1) for k = 0, 1, ...; the seats highest ones win, and ties go to the least
    `tie`. Parties without votes get nothing.
    """
    g = W.partitionBy(*group)
    p = parties.withColumn("_v", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    fair = F.when(F.col("_v") > 0, F.col(votes) * F.col(seats) / F.col("_v")).otherwise(F.lit(0.0))
    reach = F.ceil(F.col("_n") / 2 * F.col(votes) / F.col("_v")) + 2
    p = p.withColumn("_low", F.greatest(F.floor(fair) - reach, F.lit(0))).withColumn("_high", F.floor(fair) + reach)
    p = p.withColumn("_low", F.when(F.col("_v") > 0, F.col("_low")).otherwise(F.lit(0)))
    listed = p.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence("_low", "_high")))
    spare = F.col(seats) - F.sum("_first").over(g)
    listed = listed.withColumn("_first", F.when(F.col("_k") == F.col("_low"), F.col("_low")).otherwise(F.lit(0)))
    listed = listed.withColumn("_spare", spare)
    best = g.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(tie), F.col("_k"))
    won = listed.withColumn("_win", (F.row_number().over(best) <= F.col("_spare")).cast("long"))
    keys = [*group, tie]
    won = won.groupBy(*keys).agg((F.first("_low") + F.sum("_win")).alias(out))
    return parties.join(won, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def shards_for(words: int, shards: int = SHARDS) -> int:
    """Shards of each source, for this number of all words."""
    while words > shards * SHARD_WORDS:
        shards *= 2
    return shards


def mix(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`; `shards` of each source at least."""
    h = order_hash(F.col("doc_id"))
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    light = stored(light.select("*", h.alias("h")), "sizes")
    dealt = shards_for(light.agg(F.sum("size")).first()[0] or 0, shards)
    light = light.withColumn("shard", F.pmod(F.col("h"), F.lit(dealt)).cast("int"))
    cells = light.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = stored(cells, "cells")
    sources = water_level(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    sources = sources.withColumn("seats", F.floor(F.sum("target").over(W.partitionBy()) / block + 0.5)).withColumn("all", F.lit(0))
    sources = apportion(sources, ["all"], "target", "seats", "rank", "blocks")
    of = sources.select(F.col("source").alias("_s"), "source_size", "target", "rank", "blocks")
    quota = cells.join(of, F.col("source").eqNullSafe(F.col("_s")))
    quota = apportion(quota, ["rank"], "cell_size", "blocks", "shard", "quota")
    words = F.least(F.col("quota") * block, F.col("cell_size") * MOST)
    quota = quota.withColumn("times", F.when(F.col("cell_size") > 0, F.floor(words / F.col("cell_size"))).otherwise(F.lit(0)))
    quota = quota.withColumn("more", words - F.col("times") * F.col("cell_size"))
    quota = stored(quota.select("_s", F.col("shard").alias("_shard"), "source_size", "target", "times", "more"), "quota")
    lie = W.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = light.withColumn("end", F.sum("size").over(lie))
    placed = placed.join(quota, (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_s")))
    extra = F.greatest(F.lit(0), F.least(F.col("end"), F.col("more")) - (F.col("end") - F.col("size")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + extra).cast("long").alias("taken"))


def drawn(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """`docs` as the mixture draws them: each row as often as its taken words fill it, rounded (0, 1 or 2 times).

    Only the one document in a shard that the last block ends in is rounded. Rows that repeat a doc_id, or
    have none, are drawn together, by their sum. A text without a word has nothing to take and is not drawn.
    """
    own, times, copy = spare(docs, "_d", "_times", "_copy")
    taken = mix(docs, shards, block).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_r"))
    drawn = taken.select(F.col("doc_id").alias(own), F.floor(F.coalesce("_r", F.lit(0.0)) + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    rows = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col(own)))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
