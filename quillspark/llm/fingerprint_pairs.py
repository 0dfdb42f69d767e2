"""Groups of 64-bit fingerprints within a Hamming distance, from an index on shared pieces."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import Scratch, connected_components, stored

_SAMPLED, _SEARCHED = 64, 4096  # one row in so many is counted; rows of a stem's list, beyond which it isn't searched


def _mask(blocks: list[tuple[int, int]]) -> int:
    m = 0
    for low, width in blocks:
        m |= ((1 << width) - 1) << low
    return m - (1 << 64) if m >= 1 << 63 else m


def block_masks(n_blocks: int, shared: int, bits: int = 64) -> list[int]:
    """Masks of every choice of `shared` out of `n_blocks` near-equal blocks of `bits` bits."""
    cuts = [bits * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n_blocks)]
    return [_mask(list(c)) for c in combinations(blocks, shared)]


def stems_of(n_blocks: int, shared: int, bits: int = 64) -> list[int]:
    """Masks of which every choice of `shared` out of `n_blocks` blocks holds one: about half as many
    blocks, all in that half of the blocks which holds more of the choice. The 20 choices of three
    out of six have six stems."""
    cuts = [bits * i // n_blocks for i in range(n_blocks + 1)]
    blocks, half, size = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n_blocks)], n_blocks // 2, (shared + 1) // 2
    return [_mask(list(c)) for side in (blocks[:half], blocks[half:]) for c in combinations(side, size)]


def stem_blocks(rows: int, max_bits: int, bits: int = 64) -> int:
    """How many blocks to cut `bits` bits into for stems: the fewest with which about 32 of `rows` fingerprints share one by chance."""
    need = math.log2(max(rows, 1)) - 5
    return next((n for n in range(max(2 * max_bits, 2), 16, 2) if bits * ((n - max_bits + 1) // 2) / n >= need), 16)


def blocks_for(rows: int, max_bits: int, bits: int = 64, spare: int = 3) -> int:
    """How many blocks to cut `bits` bits into for an index of `rows` fingerprints: the fewest with
    which those that max_bits leave alone hold `spare` bits more than number the rows, so that
    few rows share a key by chance; at least twice max_bits. Any choice finds the same pairs."""
    need = math.log2(max(rows, 1)) + spare
    return next((n for n in range(max(2 * max_bits, 2), 16) if bits * (n - max_bits) / n >= need), 16)


def index_keys(fp: Column, masks: list[int]) -> Column:
    """One posting key per mask: the masked bits, hashed with the mask's number."""
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(masks)])


def shared_postings(rows: DataFrame, key: str) -> DataFrame:
    """Keep postings whose key holds two rows or more; `n` is the list's length."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("n", n).where("n > 1")


def posting_lists(rows: DataFrame, coarse: list[int], fine: list[int], long_list: int) -> DataFrame:
    """(node, fp, k, n) of rows (node, fp): the lists by coarse masks; one of more than long_list
    rows is replaced by those of its rows' fine masks, which find the same pairs."""
    with Scratch(rows.sparkSession) as scratch:
        first = rows.select("node", "fp", F.explode(index_keys(F.col("fp"), coarse)).alias("k"))
        lists = scratch.stored(shared_postings(first, "k"))
        long_ones = lists.where(F.col("n") > long_list).select("node", "fp").distinct()
        split = shared_postings(long_ones.select("node", "fp", F.explode(index_keys(F.col("fp"), fine)).alias("k")), "k")
        return stored(lists.where(F.col("n") <= long_list).select("node", "fp", "k", "n").union(split.select("node", "fp", "k", "n")))


def partnered(rows: DataFrame, max_bits: int, bits: int = 64) -> DataFrame:
    """Of rows (node, fp), those that may lie within max_bits bits of another: all that do, and few others.

    Different fingerprints are dealt out by stems, which are fewer than the masks that an index of lists
    needs, and each looks in its lists for one near it. Lists that a sample shows to be long are not
    searched: their fingerprints stay, for an index that splits such lists. What the sample misses
    costs time alone.
    """
    with Scratch(rows.sparkSession) as scratch:
        kinds = scratch.stored(rows.groupBy("fp").count())
        n = stem_blocks(kinds.count(), max_bits, bits)
        stems = stems_of(n, n - max_bits, bits)
        dealt = lambda part, fp, key: part.select(F.col("fp").alias(fp), F.explode(index_keys(F.col("fp"), stems)).alias(key))
        some = dealt(kinds.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLED)) == 0), "a", "ka")
        long_lists = scratch.stored(some.groupBy("ka").count().where(F.col("count") > _SEARCHED // _SAMPLED).select(F.col("ka").alias("k")))
        here, there = dealt(kinds, "a", "ka"), dealt(kinds, "b", "kb")
        found = kinds.where("count > 1").select("fp")
        if not long_lists.isEmpty():
            found = found.union(here.join(long_lists, F.col("ka") == F.col("k"), "left_semi").select("a"))
            here, there = (x.join(long_lists, F.col(key) == F.col("k"), "left_anti") for x, key in ((here, "ka"), (there, "kb")))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        # sorted lists were cheaper than hashed ones here
        found = found.union(here.join(there.hint("merge"), (F.col("ka") == F.col("kb")) & (F.col("a") != F.col("b")) & near, "left_semi").select("a"))
        return stored(rows.join(found.distinct().hint("shuffle_hash"), "fp", "left_semi").select("node", "fp"))


def list_components(lists: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component): nodes of posting lists (node, fp, k, n) joined by links; near is the test of
    two fingerprints, verify keeps the true links of candidate pairs (a, b).

    A group of copies would make pairs by the square of its size. So each list's rows are first
    compared with its least node alone. Of two nodes which that connects no pair is needed, so
    then only rows apart from their list's main component meet the list's rows of other
    components; lists of two have no other pair. No link between components is lost.
    """
    with Scratch(lists.sparkSession) as scratch:
        hub = F.min(F.struct(F.col("node").alias("a"), F.col("fp").alias("fa"))).over(Window.partitionBy("k"))
        hubs = lists.withColumn("hub", hub).where(F.col("node") != F.col("hub.a")).where(near(F.col("hub.fa"), F.col("fp")))
        pairs = scratch.stored(hubs.select(F.col("hub.a").alias("a"), F.col("node").alias("b")).distinct())
        found = connected_components(verify(pairs))
        placed = lists.where("n > 2").join(found, "node", "left").select("node", "fp", "k", F.coalesce("component", "node").alias("c"))
        main = F.min(F.struct("node", "c")).over(Window.partitionBy("k"))
        placed = placed.withColumn("apart", F.col("c") != main["c"]).withColumn("mixed", F.max("apart").over(Window.partitionBy("k")))
        placed = scratch.stored(placed.where("mixed"))
        rest = placed.where("apart").select("k", F.col("node").alias("x"), F.col("fp").alias("fx"), F.col("c").alias("cx"))
        rest = rest.join(placed.select("k", F.col("node").alias("y"), F.col("fp").alias("fy"), F.col("c").alias("cy"), "apart"), "k")
        rest = rest.where("cx <> cy AND (NOT apart OR x < y)").where(near(F.col("fx"), F.col("fy")))
        more = scratch.stored(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if more.isEmpty():
            return found
        stars = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return connected_components(stars.union(verify(more)))
