"""Mixing sources to target weights by drawing fixed-length blocks of words.

A source's documents are laid end to end and cut into blocks of ``block`` words. Output shards have
``shard_slots`` slots. The counts a shard takes from each source are multinomial draws, conditioned on
every source's total: one pseudorandom permutation of all slots deals a source's quota to the shards.
A source's j-th slot takes block ``perm(j mod blocks)`` of epoch ``j div blocks``, so that all blocks are
used once before any is used again. Everything is integer arithmetic on columns: reruns agree, and the
same arithmetic can be written in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 64  # words
SHARD_SLOTS = 4096  # blocks in an output shard
LANES = 1024  # parts in which a source's documents are laid out
PIECE = 16_384  # slots that one row unfolds to
ROUNDS = 8
PRIME = 2_147_483_647
LANE_KEY = 1_103_515_245
#: Multiplier and offset of each round's bit, multiplier and offset of each round's pivot.
ROUND_KEYS = tuple(((i * 7_368_787 + 48_271) % PRIME, (i * 15_485_863 + 11) % PRIME, (i * 32_452_843 + 69_621) % PRIME, (i * 49_979_687 + 7) % PRIME) for i in range(1, ROUNDS + 1))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: str, n: str, key: str) -> Column:
    """The image of ``x`` in 0..n-1 under a bijection chosen by ``key`` (a swap-or-not shuffle).

    The rounds run inside ``aggregate``: unrolled, each round would repeat the one before it several times.
    """
    rounds = ", ".join(f"named_struct('a', {a}L, 'c', {c}L, 'm', {m}L, 'd', {d}L)" for a, c, m, d in ROUND_KEYS)
    other = f"((({key} + 1) * r.m + r.d) % {PRIME} % {n} - x + {n}) % {n}"
    bit = f"(greatest(x, {other}) % {PRIME} * r.a + r.c + {key}) % {PRIME}"
    return F.expr(f"aggregate(array({rounds}), {x}, (x, r) -> CASE WHEN ({bit}) * ({bit}) % {PRIME} % 2 = 1 THEN {other} ELSE x END)")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns ``carry``: one scan of the texts."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *carry)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per source: sidx, source, weight, source_size, target, blocks, slots, first_slot, all_slots.

    Sources by code point, null last, take ``weights`` in turn. A target stops at ``cap`` times its
    source's size, and what is over goes to the open sources by weight until none is above: open sources
    share one level, so the sources fill in the order of cap over weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("sidx", (F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1).cast("long"))
    s = s.withColumn("weight", F.array(*[F.lit(w).cast("long") for w in weights])[(F.col("sidx") % len(weights)).cast("int")])
    s = s.withColumn("cap", F.col("source_size") * cap)
    fill = everything.orderBy(F.col("cap").cast("double") / F.col("weight"), "sidx")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / open_)
    level = F.min(F.when(F.col("level") <= F.col("cap").cast("double") / F.col("weight"), F.struct("cap_rank", "level"))).over(everything)
    s = s.withColumn("cap_rank", F.row_number().over(fill)).withColumn("level", level["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    s = s.withColumn("slots", F.least(share, F.col("blocks") * cap).cast("long"))
    s = s.withColumn("first_slot", F.coalesce(F.sum("slots").over(everything.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    s = s.withColumn("all_slots", F.sum("slots").over(everything).cast("long"))
    return s.select("sidx", "source", "weight", "source_size", "target", "blocks", "slots", "first_slot", "all_slots")


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, piece: int = PIECE) -> DataFrame:
    """The mix: (shard, position, sidx, epoch, block), one row per slot of the output.

    A hot source's slots unfold from many rows, which are dealt to all tasks first.
    """
    p = sources.filter("slots > 0").select("sidx", "blocks", "slots", "first_slot", "all_slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {piece})")).alias("p"))
    p = p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sidx", "p")  # a fixed number: few rows, much work
    s = p.withColumn("j", F.explode(F.expr(f"sequence(p * {piece}, least(slots, (p + 1) * {piece}) - 1)")))
    s = s.select("sidx", "blocks", "all_slots", (F.col("first_slot") + F.col("j")).alias("g"), F.expr("j div blocks").alias("epoch"), F.expr("j % blocks").alias("i"))
    s = s.withColumn("k", F.col("sidx") * 4 + F.col("epoch")).withColumn("block", permuted("i", "blocks", "k")).withColumn("q", permuted("g", "all_slots", "0L"))
    return s.select(F.expr(f"q div {shard_slots}").alias("shard"), F.expr(f"q % {shard_slots}").alias("position"), "sidx", "epoch", "block")


def laid_out(sizes: DataFrame, sources: DataFrame, lanes: int = LANES) -> DataFrame:
    """Each document's first word in its source: (doc_id, source, size, first_word, sidx, source_size, target).

    Documents of a source are ordered by (lane, doc_id, size), the lane by a hash of id and size, which spreads ids at
    any step and rows without an id. A lane is summed first and numbered inside afterwards, so a source that holds
    a third of all rows is spread over ``lanes`` tasks.
    """
    key = f"(coalesce(pmod(doc_id, {PRIME}L), 0L) * {LANE_KEY}L + size % {PRIME}) % {PRIME} * {LANE_KEY}L % {PRIME}"
    d = sizes.withColumn("lane", F.expr(f"{key} % {lanes}"))
    d = d.join(sources.select("sidx", F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    before = Window.partitionBy("sidx").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane = d.groupBy("sidx", "lane").agg(F.sum("size").alias("n")).select("sidx", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_first"))
    inside = Window.partitionBy("sidx", "lane").orderBy(F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(lane, ["sidx", "lane"]).withColumn("first_word", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("lane_first")).drop("lane", "lane_first")


def shard_counts(mix: DataFrame) -> DataFrame:
    """Blocks that each output shard draws from each source."""
    return mix.groupBy("shard", "sidx").agg(F.count(F.lit(1)).alias("drawn"))


def block_parts(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(document, block) rows with the words of the document that lie in the block."""
    b = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(first_word div {block}, (first_word + size - 1) div {block})")))
    return b.withColumn("words", F.expr(f"least(first_word + size, (block + 1) * {block}) - greatest(first_word, block * {block})"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, source, text), and its columns ``carry``.

    ``taken`` counts the words of the document in all drawn blocks, repeats counted; it never exceeds
    ``cap`` times the size. A source's taken words differ from its target by less than two blocks.
    Null or empty texts have size 0 and are never taken; a null source is a source of its own, the last;
    a null doc_id is laid out first; repeated rows are separate documents; an empty table gives no rows.
    """
    sizes = stage(sized(docs, carry=carry), "sizes")
    sources = stage(targets(sizes, weights, cap, block), "sources")
    placed = stage(laid_out(sizes, sources), "placed")
    used = slots(sources).groupBy("sidx", "block").agg(F.count(F.lit(1)).alias("times"))
    keys = ["sidx", "first_word", "doc_id", "size", "source_size", "target", *carry]
    taken = block_parts(placed, block).join(used.hint("merge"), ["sidx", "block"], "left").groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken", *carry]
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(none.select(*out))
