"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights by water-filling: no source takes more than a fixed
number of times its size, and what is cut off is shared again by weight.  Block
quotas are those of the highest quotients target / (2 k + 1), first over
sources, then over the shards of each source.  Within a shard the documents
stand in seeded order as one stream of words; its blocks lie end to end in it,
and a quota of q blocks takes the whole stream as often as it fits and then a
run of blocks from a seeded start.  A document takes the words that lie in
chosen blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, text_of, words_of

#: Words in a block, words and rows that a shard has at most on average, and how often a source may repeat.
BLOCK, SHARD_WORDS, SHARD_ROWS, REPEATS, SEED = 64, 500_000, 1_000, 3, 17


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _level(parties: DataFrame, group: list[str], cap: str, share: str, total: Column, name: str) -> DataFrame:
    """parties with the level y at which sum(least(cap, share * y)) over a group's parties is total; null if all caps together are less.

    In the order of cap / share the parties up to some point are at their caps;
    y is what is left, shared by the others' shares.  Shares are positive.
    """
    by_ratio = Window.partitionBy(*group).orderBy(F.col(cap) / F.col(share), F.col("_order"))
    before = F.coalesce(F.sum(F.col(cap)).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col(share)).over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = parties.withColumn("_y", (total - before) / rest)
    first = F.first(F.when(F.col("_y") <= F.col(cap) / F.col(share), F.col("_y")), ignorenulls=True)
    return out.withColumn(name, first.over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_y")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size, weight) with target: the whole of all sizes shared by weight, none above repeats times its size.

    One task sorts a row per source.  Sources of size 0 get 0.
    """
    out = sizes.withColumn("_cap", (repeats * F.col("source_size")).cast("double")).withColumn("_all", F.lit(0)).withColumn("_order", F.col("source"))
    out = _level(out, ["_all"], "_cap", "weight", F.sum("source_size").over(Window.partitionBy("_all")).cast("double"), "_final")
    return out.withColumn("target", F.coalesce(F.least("_cap", F.col("weight") * F.col("_final")), "_cap")).drop("_cap", "_final", "_all", "_order")


def sainte_lague(parties: DataFrame, group: list[str], share: str, capacity: str, seats: str, name: str = "quota") -> DataFrame:
    """parties with an integer quota: the group's seats by highest quotients share / (2 k + 1), none above its capacity.

    At a quotient q a party has floor(share / 2 q + 1/2) seats, or its capacity
    if that is less: within half a seat of least(capacity, share / 2 q).  So the
    level at which these sum to the seats less half a seat a party gives seats
    that are certain, the level of half a seat a party more all that can be won,
    and the quotients between them, two a party on average, are ranked.  Seats
    that capacities leave over stay unassigned.  Ties go to the smaller _order,
    parties of no share get none.  One task sorts a group's parties.
    """
    own = Window.partitionBy(*group)
    out = parties.withColumn("_in", (F.col(share) > 0) & (F.col(capacity) > 0))
    some = out.where("_in").withColumn("_half", F.count(F.lit(1)).over(own) / 2 + 1)
    some = _level(some, group, capacity, share, F.greatest(F.lit(0), F.col(seats) - F.col("_half")), "_low")
    some = _level(some, group, capacity, share, F.col(seats) + F.col("_half"), "_high")
    at = lambda level: F.least(F.col(capacity), F.floor(F.col(share) * F.col(level) + 0.5)).cast("long")
    some = some.withColumn("_sure", F.when(F.col(seats) <= F.col("_half"), 0).otherwise(F.coalesce(at("_low"), F.col(capacity))).cast("long"))
    some = some.withColumn("_most", F.coalesce(at("_high"), F.col(capacity)).cast("long")).withColumn("_left", (F.col(seats) - F.sum("_sure").over(own)).cast("long"))
    ranked = F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>"))
    near = some.select("*", F.explode_outer(ranked).alias("_k")).withColumn("_q", F.col(share) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(own.orderBy(F.col("_q").desc_nulls_last(), "_order", "_k"))
    near = near.withColumn("_won", (F.col("_q").isNotNull() & (rank <= F.col("_left"))).cast("int"))
    won = near.groupBy(*parties.columns).agg((F.first("_sure") + F.sum("_won")).alias(name))
    return won.unionByName(out.where("not coalesce(_in, false)").select(*parties.columns, F.lit(0).cast("long").alias(name)))


def source_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating over ranks from 1 on."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def _seeded(seed: int, *parts: Column) -> Column:
    """32 hexadecimal digits that order rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def _number(digits: Column) -> Column:
    """The first 7 hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, 7), 16, 10).cast("long")


def mix(docs: DataFrame, keep: list[str] | None = None, block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """keep plus size, source_size, target, shard, n_blocks, quota and taken.

    size counts words; null and empty texts have 0 and are never taken.  Sources
    rank by code point, null last, as a source of its own.  A source is dealt
    over shards of about shard_words words and shard_rows rows at most, by a
    seeded hash of doc_id (of the text where that is null), so no task holds a
    whole source; one task sorts a row for each source, or for each shard of one
    source.  Equal seeds and rows give equal results; repeated rows stand next
    to each other in the stream.  Of docs only doc_id, source, text and keep
    are read; keep must not hold the names that are added.
    """
    keep = keep if keep is not None else ["doc_id"]
    text = text_of(docs)
    own = [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("-"), F.md5(text.cast("binary"))))
    rows = docs.select(*own, word_count(text).alias("size"), _seeded(seed, name).alias("_seeded"), F.xxhash64(text).alias("_tie"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("_src"), docs["source"].isNull().cast("int").alias("_null"))
    rows = materialize(rows, "mixing")
    key = ["_null", "_src"]
    sizes = rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.withColumn("weight", source_weight(F.row_number().over(Window.orderBy(*key))).cast("double"))
    sizes = targets(sizes.withColumn("source", F.struct(*key)), repeats).drop("source")
    shards = F.greatest(F.ceil((F.col("source_size") + 1) / shard_words), F.ceil(F.col("_rows") / shard_rows)).cast("int")
    # written out, so that its size is known before the rows are joined: small tables are then broadcast and no row is dealt by its source
    sizes = materialize(sizes.withColumn("n_shards", shards).drop("_rows"), "mixing-sources")

    rows = rows.join(sizes, key).withColumn("shard", F.pmod(_number(F.col("_seeded")), F.col("n_shards")).cast("int"))
    shards = materialize(rows.groupBy(*key, "shard", "source_size", "target").agg(F.sum("size").alias("_words")).withColumn("n_blocks", F.ceil(F.col("_words") / block).cast("long")), "mixing-shards")
    # blocks of a shard are as equal as whole words allow; a source's seats are its target in blocks of its own mean size
    by_source = shards.groupBy(*key, "source_size", "target").agg(F.sum("n_blocks").alias("_blocks"))
    by_source = by_source.withColumn("_cap", repeats * F.col("_blocks")).withColumn("_share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("_blocks")).otherwise(0.0))
    by_source = by_source.withColumn("_all", F.lit(1)).withColumn("_order", F.struct(*key))
    by_source = by_source.withColumn("_seats", F.round(F.sum(F.round(F.col("_share") * 4096)).over(Window.partitionBy("_all")) / 4096).cast("long"))  # whole numbers add up alike in any order
    quotas = sainte_lague(by_source, ["_all"], "_share", "_cap", "_seats", "_source_quota").select(*key, "_source_quota")
    shards = shards.join(quotas, key).withColumn("_cap", repeats * F.col("n_blocks")).withColumn("_order", F.col("shard")).withColumn("_share", F.col("n_blocks").cast("double"))
    shards = materialize(sainte_lague(shards, key, "_share", "_cap", "_source_quota").select(*key, "shard", "_words", "n_blocks", "quota"), "mixing-quotas")

    rows = rows.join(shards, [*key, "shard"])
    order = Window.partitionBy(*key, "shard").orderBy("_seeded", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
    blocks = F.greatest(F.col("n_blocks"), F.lit(1))
    rounds, rest = F.floor(F.col("quota") / blocks), F.pmod(F.col("quota"), blocks)
    first = F.pmod(_number(_seeded(seed + 1, F.col("_null").cast("string"), F.col("_src"), F.col("shard").cast("string"))), blocks)
    edge = lambda b: F.floor(b * F.col("_words") / blocks)
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_start"), a))
    some = over(edge(first), edge(F.least(first + rest, blocks))) + over(F.lit(0), edge(F.greatest(first + rest - blocks, F.lit(0))))
    taken = (rounds * F.col("size") + some).cast("long").alias("taken")
    return rows.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", taken, "shard", "n_blocks", "quota")


def resample(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns of any name, each as often as mix takes it, rounded to whole documents.

    Only documents on a shard's first or last chosen words are cut by mix, so
    rounding moves each shard by less than two documents.  Rows with a null
    doc_id, or with one that others have, are told apart by their texts.
    """
    doc, hashed, times, doc2, hashed2, again = free_names(docs.columns, "doc", "hashed", "times", "doc2", "hashed2", "again")
    own = docs.withColumn(doc, F.col("doc_id")).withColumn(hashed, F.xxhash64(F.col("text").cast("string")))
    copies = mix(own, [doc, hashed], block, shard_words, repeats=repeats, seed=seed).where("taken > 0")
    copies = copies.groupBy(doc, hashed).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).alias(times)).where(F.col(times) > 0)
    copies = copies.select(F.col(doc).alias(doc2), F.col(hashed).alias(hashed2), times)
    out = own.join(copies, F.col(doc).eqNullSafe(F.col(doc2)) & (F.col(hashed) == F.col(hashed2)))
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
