"""Mixing sources to target weights with multivariate-hypergeometric splitting trees.

Every document has a lot, a random place that a hash of seed, source, id and text gives it.
The documents of a source in the order of their lots are permuted, and equal ranges of lots
are its blocks. A source's quota of words is met by whole passes over all its blocks and one
partial pass over the lots below a cut. The cut is found by descent: words are summed by the
next bits of the lots, a source has at most as many sums as these bits have values, and only
the range that the cut falls into is looked at further; nothing sorts a source or gathers a
block. The block draws are dealt to the output shards: a binary tree over the shards splits
the exact number of draws of a source again and again, the left part being a hypergeometric
draw from the slots below the node, which makes the shares of all shards multivariate
hypergeometric. Shards own disjoint runs of the permuted draws and are shuffled locally by a
hash. Everything is SQL functions, nothing depends on row order, and what a document gives
follows from its own row and its source's, so that texts are not joined with anything.

Defined results
---------------
* null or empty text: size 0, taken 0. null source is a source of its own and sorts last.
* a source without words has target 0. No source at all: no rows.
* rows alike in id and text share what is left at the cut evenly, so a source's words can
  miss the rounded target by half as many words as there are such rows at its cut; otherwise
  they meet it exactly. Repeated rows count as documents each.
* extra columns are ignored by `mix` and kept by `materialise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents a block holds on average, and the most blocks of a source, among which shards are drawn.
BLOCK_DOCS, MOST_BLOCKS = 16, 4096
#: Bits of a lot, and bits that a step of the descent to the cut takes.
LOT_BITS, STEP_BITS = 48, 8
#: Bytes up to which the table of sources is joined by broadcast; beyond it by a salted shuffle.
BROADCAST_BYTES, SALTS = 1 << 24, 32
#: Parts that a shard is dealt in, so that it is not one task's.
PARTS = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; null has none."""
    blank = r"[\x20\x09-\x0D]"
    only = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(only, blank + "++", "")).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _with_sources(left: DataFrame, sources: DataFrame, small: bool, salt: Column) -> DataFrame:
    """Joins rows with their source's row; a hot source is neither shuffled to one task."""
    right = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if small:
        return left.join(F.broadcast(right), same).drop("_source")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_s", F.pmod(salt, F.lit(SALTS)).cast("int")).join(right, same & (F.col("_s") == F.col("_salt"))).drop("_source", "_s", "_salt")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their 0-based rank by code point, null last, without one task for all."""
    by = F.asc_nulls_last("source")
    parts = scratch.save(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "source_parts")
    heads = parts.groupBy("part").agg(F.count("*").alias("n"))
    heads = heads.withColumn("skip", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    within = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return parts.withColumn("within", within).join(heads, "part").select("source", "n_docs", "source_size", (F.col("within") + F.coalesce("skip", F.lit(0))).alias("rank"))


def _water_level(sources: DataFrame, total: float, cap: float) -> float:
    """The level w at which min(level * weight, cap * size) sums up to the total.

    Targets above their cap stop there and the excess is shared again by weight, round by
    round; a round reads two sums, so nothing but scalars reaches the driver.
    """
    over = F.lit(False)
    level, before = 0.0, -1
    while True:
        held = F.when(over, F.col("source_size") * cap).otherwise(0.0)
        free = F.when(over, 0.0).otherwise(F.col("weight"))
        row = sources.agg(F.sum(held).alias("held"), F.sum(free).alias("free"), F.sum(over.cast("int")).alias("n")).first()
        if not row["free"] or row["n"] == before:
            return level if row["free"] else float("inf")
        level, before = (total - (row["held"] or 0.0)) / row["free"], row["n"]
        over = F.col("weight") * level > F.col("source_size") * cap


def _shares(draws: Column, slots: Column, key: Column, shards: int) -> Column:
    """The draws of each shard: `draws` of `slots` split by a binary tree over the shards."""

    def slots_below(first: int, last: int) -> Column:
        edge = lambda i: F.floor(slots * i / shards).cast("long")
        return edge(last) - edge(first)

    def left(n: Column, node: int, below: Column, of_left: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("got"), of_left.alias("l"), below.alias("all"))

        def draw(a: Column, i: Column) -> Column:
            hit = (_uniform(key, F.lit(node), i) * a["all"] < a["l"]).cast("long")
            return F.struct((a["got"] + hit).alias("got"), (a["l"] - hit).alias("l"), (a["all"] - 1).alias("all"))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), start, draw)["got"]).otherwise(F.lit(0).cast("long"))

    def split(n: Column, node: int, first: int, last: int) -> Column:
        if last - first == 1:
            return F.array(n)
        middle = (first + last) // 2
        both = F.array(left(n, node, slots_below(first, last), slots_below(first, middle)))
        # a one-element array binds the draw once, so that it is not computed again below
        return F.flatten(F.transform(both, lambda x: F.concat(split(x, 2 * node, first, middle), split(n - x, 2 * node + 1, middle, last))))

    return split(draws, 1, 0, shards)


def _lot(seed: int, doc_id: Column, source: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), source, doc_id.cast("string"), text), 64 - LOT_BITS)


def _with_cuts(sized: DataFrame, sources: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """The sources with the lot of their cut, the words left at it and the rows that share them.

    Lots below `cut` are drawn once more than the whole passes; at it `cut_rows` rows have
    `cut_words` words left.
    """
    base = sources.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left")).where("rest > 0")
    open_rows, at = sized.where("size > 0"), base
    for step in range(1, LOT_BITS // STEP_BITS + 1):
        low = LOT_BITS - step * STEP_BITS
        there = _with_sources(open_rows, at, small, F.col("lot"))
        there = there.where(F.shiftright("lot", low + STEP_BITS) == F.col("prefix")) if step > 1 else there
        if step == 2:
            # what the first step has left is a small part of all rows
            open_rows = scratch.save(there.select("source", "size", "lot"), "open")
            there = _with_sources(open_rows, at, small, F.col("lot"))
        sums = there.groupBy("source", F.shiftright("lot", low).alias("next")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.max("left").alias("left"), F.max("lot").alias("last"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        found = found.select("source", F.col("next").alias("prefix"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "rows", F.col("words").alias("here"), "last")
        at = scratch.save(found, f"cut_{step}")
        if (at.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    # one document, or rows with the same lot, are left: where a step ends early, the cut is the end of its range
    cuts = at.select(F.col("source").alias("_cut"), F.col("prefix").alias("cut"), F.lit(low).alias("cut_low"), F.col("left").alias("cut_words"), F.col("rows").alias("cut_rows"), F.col("here").alias("cut_size"), F.col("last").alias("cut_lot"))
    return sources.join(cuts.hint("merge"), F.col("source").eqNullSafe(F.col("_cut")), "left").drop("_cut")


def _plan(
    sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], budget: float, cap: int, shards: int, seed: int
) -> tuple[DataFrame, bool]:
    """A row a source: its targets, passes, cut and the shards of its draws; whether they are few."""
    found = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = scratch.save(_ranked(found, scratch).withColumn("weight", weight), "sources")
    head = sources.agg(F.sum("source_size").alias("words"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 8 * shards + 160).alias("bytes")).first()
    small = (head["bytes"] or 0) <= BROADCAST_BYTES
    level = _water_level(sources, budget * (head["words"] or 0), cap)

    most = F.col("source_size").cast("double") * cap
    sources = sources.withColumn("target", F.when(F.col("weight") * level < most, F.col("weight") * level).otherwise(most))
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * cap)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    # a power of two, so that a block is the leading bits of a lot
    bits = F.least(F.lit(MOST_BLOCKS.bit_length() - 1), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / BLOCK_DOCS))).cast("int"))
    sources = scratch.save(sources.withColumn("block_bits", bits), "targets")
    sources = _with_cuts(sized, sources, small, scratch)

    n_blocks = F.pow(F.lit(2.0), F.col("block_bits")).cast("long")
    at_block = F.expr(f"shiftright(cut_lot, {LOT_BITS} - block_bits)") + 1
    draws = F.col("passes") * n_blocks + F.coalesce(at_block, F.lit(0)).cast("long")
    share = _shares(draws, n_blocks * cap, F.xxhash64(F.lit(seed), F.col("source")), shards)
    sources = sources.withColumn("n_blocks", n_blocks).withColumn("share", share)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("share", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    # sources begin with different shards, so that small ones don't meet in the same
    turn = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("source")), F.lit(shards)).cast("int")
    plan = sources.select("source", "source_size", "target", "passes", "block_bits", "n_blocks", ends.alias("ends"), turn.alias("turn"), "cut", "cut_low", "cut_words", "cut_rows", "cut_size")
    plan = scratch.save(plan, "plan")
    scratch.drop("source_parts", "sources", "targets", "open", *(f"cut_{k}" for k in range(1, LOT_BITS // STEP_BITS + 1)))
    return plan, small


def _drawn(shards: int) -> tuple[Column, Column]:
    """(taken words, shards of the draws) of a row with size and lot that is joined with its source's."""
    mine = F.expr("shiftright(lot, cut_low)")
    # rows at the cut: the one document left, or rows alike, whose part is rounded to words
    part = F.least(F.col("size"), F.floor(F.col("cut_words") * F.col("size") / F.col("cut_size") + 0.5).cast("long"))
    extra = F.when(F.col("cut").isNull() | (F.col("size") == 0), F.lit(0)).when(mine < F.col("cut"), F.col("size")).when(mine == F.col("cut"), part).otherwise(F.lit(0)).cast("long")
    taken = F.col("passes") * F.col("size") + extra
    block = F.expr(f"shiftright(lot, {LOT_BITS} - block_bits)")
    n_draws = F.col("passes") + (extra > 0).cast("long")
    at = F.transform(
        F.sequence(F.lit(1).cast("long"), F.greatest(n_draws, F.lit(1).cast("long"))), lambda p: (F.size(F.filter("ends", lambda e: e <= (p - 1) * F.col("n_blocks") + block)) + F.col("turn")) % shards
    )
    return F.when(F.col("size") > 0, taken).otherwise(0).cast("long"), F.when((F.col("size") > 0) & (n_draws > 0), at).otherwise(F.array().cast("array<int>"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    cap: int = 2,
    shards: int = 8,
    seed: int = 17,
    text: str = "text",
) -> DataFrame:
    """Per document: size, source_size, target, taken (words) and the shards of its draws.

    weights: given to the sources in turn by code point; budget: the mix's words as a part
    of all words; cap: the most times a source may be repeated.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_sized(docs, text, seed), "sizes")
    plan, small = _plan(sized, scratch, weights, budget, cap, shards, seed)
    taken, drawn = _drawn(shards)
    return _with_sources(sized, plan, small, F.col("lot")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), drawn.alias("shards"), "source")


def _sized(docs: DataFrame, text: str, seed: int) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select("doc_id", source.alias("source"), word_count(F.col(text)).alias("size"), _lot(seed, F.col("doc_id"), source, F.col(text)).alias("lot"))


def materialise(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    cap: int = 2,
    shards: int = 8,
    seed: int = 17,
    text: str = "text",
    shard: str | None = None,
) -> DataFrame:
    """The mixed documents themselves: each as often as it is drawn, the last draw cut.

    Keeps the columns of the input. Draws are dealt by shard, a shard in several parts by a
    hash, and lie in each part in the order of another hash. shard: name of a column with the
    shard's number, for write.partitionBy.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_sized(docs, text, seed).drop("doc_id"), "sizes")
    plan, small = _plan(sized, scratch, weights, budget, cap, shards, seed)
    scratch.drop("sizes")
    # the input's columns travel as one, so that none of them can clash with ours
    source = F.col("source").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), source.alias("source"), word_count(F.col(text)).alias("size"), _lot(seed, F.col("doc_id"), source, F.col(text)).alias("lot"))
    taken, drawn = _drawn(shards)
    out = _with_sources(rows, plan, small, F.col("lot")).select("_row", "size", "lot", taken.alias("taken"), drawn.alias("shards")).where("taken > 0")
    out = out.select("_row", "size", "lot", "taken", F.posexplode("shards").alias("draw", "shard"))
    left = F.col("taken") - F.col("draw") * F.col("size")
    whole = F.col(f"_row.`{text}`")
    parts = F.split(F.regexp_replace(whole, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(parts, F.lit(1), left.cast("int")), " ")
    shown = F.when(left < F.col("size"), cut).otherwise(whole)
    out = out.select(*(shown.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns), F.col("shard").alias("_shard"), F.xxhash64(F.lit(seed), F.lit("draw"), "lot", "draw").alias("_place"))
    out = out.repartition("_shard", F.pmod("_place", F.lit(PARTS))).sortWithinPartitions("_shard", "_place")
    return out.select(*docs.columns, *([F.col("_shard").alias(shard)] if shard else []))
