"""Mix sources to target weights.

The words of each source are one long stream, cut into blocks of
``BLOCK_WORDS`` words (the last of a source may be shorter).  The mix takes,
of every source, as many block slots as its target asks for: whole passes over
the source while they fit and slots of the next pass for the rest.  Slots are
dealt to output shards at random, so that each shard's counts by source are a
multinomial draw, conditioned on the sources' totals, which therefore come out
at their targets rather than near them.  A slot's place in its pass is mapped
to a block by the source's own pseudorandom permutation (a swap-or-not
shuffle, which permutes any number of blocks without a table), and blocks are
joined by (source, block).

Nothing is gathered by source: offsets come from sums over about sqrt(rows)
buckets, and slots are made shard by shard, so one source may hold most rows.

Defined cases: a null text has size 0 and nothing is taken from it; a null
source is a source of its own, last in order; repeated rows are documents of
their own; ties in doc_id are ordered by size and text hash; a very long text has
as many blocks as it needs; extra columns, whatever their names, are ignored by
``digest`` and ``mix`` and kept by ``sampled``; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotiles.llm.common import SPACE_CLASS, SPACES, materialize, table

BLOCK_WORDS = 64
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_PASSES = 2
#: Words of an output shard, about.
SHARD_WORDS = 1 << 22
#: Slots that one row of the plan makes.
CHUNK_SLOTS = 4096
#: Slots that one task makes, about.
TASK_SLOTS = 1 << 16
ROUNDS = 12
SEED = 20


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE_CLASS}+", -1))).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Words to take of each source, from rows (source, source_size).

    The weights repeat over the sources by code point, null last.  A target
    stops at ``most`` times its source's size; what that leaves over goes to the
    others by weight until none is above.  With the sources ordered by
    most * size / weight, those that stop are a prefix, so running sums find
    the one level at which all others meet.  The windows here see one row per
    source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranked.withColumn("cap", cap).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
    out = out.withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("weight_left"))
    # the first source whose cap is not reached at its level fixes the level
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(whole)["level"]
    return out.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(math.inf)) * F.col("weight"))).select("source", "source_size", "target")


def streams(documents: DataFrame, source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Documents as (doc_id, source, size, start): ``start`` counts the source's words before.

    Documents are ordered by bucket of a hash, then doc_id, size and hash, never by their
    arrival, so the mix is the same for any partitions of the input.  Columns named
    in ``keep`` stay.
    """
    rows = documents.select("doc_id", F.col(source).cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64("text", *keep).alias("h"), *keep)
    rows = materialize(rows)
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int"))
    # rows alike in all of this are one entry, however many they are, and follow each other in any order
    entries = rows.groupBy("source", "bucket", "doc_id", "size", "h").agg(F.count("*").alias("copies"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = entries.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
    placed = entries.alias("a").join(by_bucket.alias("b"), on).select("a.source", "a.doc_id", "a.size", "a.h", "a.copies", (F.col("b.base") + F.col("a.inside")).alias("first"))
    exploded = lambda df: df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    out = ["doc_id", "source", "size", *keep, (F.col("first") + F.col("copy") * F.col("size")).alias("start")]
    if not keep:
        return exploded(placed).select(*out)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("source", "doc_id", "size", "h")]
    joined = rows.alias("r").join(placed.alias("p"), same[0] & same[1] & same[2] & same[3]).select("r.source", "r.doc_id", "r.size", "r.h", "p.copies", "p.first", *[f"r.{c}" for c in keep])
    # what is kept is the same in all rows of an entry
    alike = joined.where("copies > 1").groupBy("source", "doc_id", "size", "h", "copies", "first").agg(*[F.first(c).alias(c) for c in keep])
    return joined.where("copies = 1").withColumn("copy", F.lit(0).cast("long")).select(*out).union(exploded(alike).select(*out))


def permuted(place: Column, blocks: Column, key: Column) -> Column:
    """The block at a place: a swap-or-not shuffle of 0..blocks-1 under ``key``."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(key, r, F.lit(SEED)), blocks) - x
        other = F.when(other < 0, other + blocks).otherwise(other)
        swap = F.xxhash64(F.greatest(x, other), key, r) < 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place, turn)


def _with_slots(plan: DataFrame, block_words: int) -> DataFrame:
    """The plan with ``blocks`` of each source and the ``slots`` that its target asks for."""
    plan = plan.where("source_size > 0")
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / block_words).cast("long")
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.when(F.col("passes") < MOST_PASSES, F.least(rest, F.col("blocks"))).otherwise(F.lit(0)))
    return plan.where("slots > 0")


def _tasks(total: int) -> int:
    """A number of partitions that follows the slots: by bytes, the few rows they are made from would all be one."""
    return max(1, min(100_000, -(-total // TASK_SLOTS)))


def draws(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The shards' counts by source, as rows (shard, source, blocks, first, drawn), from rows (source, source_size, target).

    Each of a source's slots draws its shard, so given the totals the counts are
    multinomial.  ``first`` counts the source's slots in the shards before; its window
    sees a row per shard of a source, some 4 million words each.
    """
    plan = _with_slots(plan, block_words)
    total = plan.agg(F.sum("slots")).collect()[0][0] or 0
    shards = max(1, -(-total * block_words // shard_words))
    chunks = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK_SLOTS).cast("long"))))
    first = F.col("chunk") * CHUNK_SLOTS
    thrown = chunks.repartition(_tasks(total), "source", "chunk").select("source", "blocks", F.explode(F.sequence(first, F.least(first + CHUNK_SLOTS, F.col("slots")) - 1)).alias("slot"))
    counts = thrown.groupBy(F.pmod(F.xxhash64("source", "slot", F.lit(seed + 1)), F.lit(shards)).alias("shard"), "source", "blocks").agg(F.count("*").alias("drawn"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))


def slots(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as rows (shard, source, slot, block, pass): every shard's drawn counts, mapped through the permutations.

    The planner takes them for as few as the plan's rows, so joins with them
    must ask for a merge and not leave it to broadcast them.
    """
    drawn = materialize(draws(plan, block_words, shard_words, seed))
    total = drawn.agg(F.sum("drawn")).collect()[0][0] or 0
    made = drawn.repartition(_tasks(total), "shard", "source").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)))
    of_pass = (F.col("slot") / F.col("blocks")).cast("long")
    made = made.withColumn("key", F.xxhash64("source", of_pass, F.lit(seed))).withColumn("place", F.col("slot") % F.col("blocks"))
    return made.select("shard", "source", "slot", permuted(F.col("place"), F.col("blocks"), F.col("key")).alias("block"), of_pass.alias("pass"))


def blocks_of(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for every block a document has words in: (..., block, words)."""
    end = F.col("start") + F.col("size")
    cut = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))))
    left = F.col("block") * block_words
    return cut.withColumn("words", F.least(end, left + block_words) - F.greatest(F.col("start"), left))


def plan_of(docs: DataFrame, **options) -> DataFrame:
    return targets(docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), **options)


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (shard, source, slot, block, doc_id, first_word, words), a row per document part of a slot.

    ``first_word`` counts the document's words before the part.
    """
    docs = materialize(streams(documents))
    parts = blocks_of(docs, block_words).withColumn("first_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")))
    chosen = slots(plan_of(docs), block_words).alias("a")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
    return chosen.hint("merge").join(parts.alias("b"), on).select("a.shard", "a.source", "a.slot", "a.block", "b.doc_id", "b.first_word", "b.words")


def taken(docs: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words that the mix takes of each document with words, and the first shard that has some: (source, start, taken, shard).

    Documents with words have distinct (source, start).
    """
    times = slots(plan, block_words).groupBy("source", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard")).alias("a")
    parts = blocks_of(docs, block_words).alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
    return parts.join(times.hint("merge"), on).groupBy("b.source", "b.start").agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"), F.min("shard").alias("shard"))


def digest(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    docs = materialize(streams(documents))
    plan = materialize(plan_of(docs))
    got = taken(docs, plan, block_words).select(F.col("source").alias("s"), F.col("start").alias("at"), "taken", "shard")
    # documents without words share a start with others; nothing is taken from them
    out = docs.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left").drop("s", "at")
    by = plan.select(F.col("source").alias("s"), "source_size", "target")
    return out.join(by, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shard")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def sampled(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents``, a row for every pass that takes the block of the document's first word.

    Texts stay whole; every document has the chance that its source's target
    gives its blocks.  Documents without words go with the block at their place,
    or stay once if their source has no words at all.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), "doc_id", "source", "text")
    docs = materialize(streams(rows, keep=["_row"]))
    plan = materialize(plan_of(docs))
    times = slots(plan, block_words).groupBy("source", "block").agg(F.count("*").cast("int").alias("times"))
    sizes = plan.select(F.col("source").alias("s"), "source_size")
    placed = docs.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # a document without words at the very end of its source goes with the last block
    block = F.floor(F.least(F.col("start"), F.greatest(F.col("source_size") - 1, F.lit(0))) / block_words).cast("long")
    placed = placed.withColumn("at", block)
    times = times.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    joined = placed.join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b")), "left")
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.coalesce("times", F.lit(0)))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
