"""Connected components and block links, as DataFrame joins that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonflow.llm.common import BROADCAST_ROWS, bounded, cut, new_path, remove


#: Counted edges up to which one task takes ``AT_ONCE`` steps in a job, by windows without an exchange or a broadcast, each of which costs the driver a thread.
FEW_EDGES, AT_ONCE = 10_000, 3


def _edges(*ends: tuple[str, str]) -> Column:
    """Edges ``(u, v)`` between columns, to be exploded."""
    return F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))


def _few_stars(state: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges ``(u, v)`` in one partition."""
    low = F.min("v").over(Window.partitionBy("u"))
    both = state.select(F.explode(_edges(("u", "v"), ("v", "u"))).alias("e")).select("e.*")
    large = both.withColumn("m", F.least("u", low)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    ends = F.when(F.col("v") != F.col("m"), _edges(("u", "m"), ("v", "m"))).otherwise(_edges(("u", "m")))
    return large.withColumn("m", low).select(F.explode(ends).alias("e")).select("e.*").distinct()


def _stars(state: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges ``(u, v)``."""
    both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: each vertex with the smallest vertex that it reaches.

    Alternates large-star and small-star steps until the edges are a star forest. A vertex is
    only ever aggregated by ``min`` (map-side combined) and joined on, so a hub with a third of
    the edges is split by the skew join; few edges are one task's. Each round is written to the shared folder. Self-loops
    and null ends are ignored; vertices without an edge do not appear; no edges: an empty result.
    """
    spark = edges.sparkSession
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    path = new_path(spark, "components")
    state, seen = cut(state, "components", path), None
    while True:
        sign = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == seen or not sign[0]:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = sign
        after = new_path(spark, "components")
        if sign[0] <= FEW_EDGES:
            step = state.coalesce(1)
            for _ in range(AT_ONCE):
                step = _few_stars(step)
        else:
            step = _stars(state)
        state = cut(step, "components", after)
        remove(spark, path)
        path = after


#: Takes candidate pairs ``(a, b, ...)``; adds ``score``: null for pairs that pass, else less for likelier ones. Hopeless pairs may go. Written.
Judge = Callable[[DataFrame], DataFrame]
#: Takes pairs and leaves those that pass the costly test.
Settle = Callable[[DataFrame], DataFrame]
#: Pairs that are settled at once; of more, rounds find out which need it.
FEW_PAIRS = 5_000


def joined_by_rounds(pairs: DataFrame, judge: Judge, settle: Settle) -> DataFrame:
    """``pairs(a, b, ca, cb)``, each once, of ids in different components -> ``(ca, cb)`` of components that a passing pair joins.

    Exact up to connectivity, without settling every pair: in a dense group one link makes most others needless. In each
    round each component has one pair settled, the likeliest, and pairs whose ends are in one component by then, through
    these or those that pass by judgement, are left out. When a round makes less than a fifth of the pairs that it did not
    settle needless, as among unlike members, or few are open, all that are left are settled.
    """
    judged = judge(pairs.select("a", "b", F.struct("ca", "cb", F.col("ca").alias("la"), F.col("cb").alias("lb")).alias("c")))
    rows, passed, links, before = judged.where("score is not null").select("a", "b", "score", "c"), judged.where("score is null").select("a", "b", "c"), [], None
    while True:
        n = rows.count()
        if n <= FEW_PAIRS or (before is not None and n > 0.8 * before):
            return unions([*links, passed.select("c.ca", "c.cb"), settle(rows.select("a", "b", "c")).select("c.ca", "c.cb")])
        one = F.struct("score", F.xxhash64("a", "b").alias("h"), "a", "b", "c").alias("one")
        ends = rows.select("c.la", one).unionAll(rows.select(F.col("c.lb").alias("la"), one))
        chosen = cut(ends.groupBy("la").agg(F.min("one").alias("one")).select("one.a", "one.b", "one.c").distinct(), "chosen-pairs")
        settled = chosen.count()
        met = cut(passed.unionAll(settle(chosen)), "passed-pairs")
        links.append(met.select("c.ca", "c.cb"))
        tops = cut(components(met.select(F.col("c.la").alias("a"), F.col("c.lb").alias("b")).distinct()), "tops")
        size, left = tops.count(), rows.join(bounded(chosen.select("a", "b"), settled), ["a", "b"], "left_anti").select("a", "b", "score", "c.*")
        for end in ("la", "lb"):
            top = tops.select(F.col("id").alias(end), F.col("component").alias("top"))
            left = left.join(bounded(top, size), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        rows = cut(left.where("la <> lb").select("a", "b", "score", F.struct("ca", "cb", "la", "lb").alias("c")), "open-pairs")
        before, passed = n - settled, met.limit(0)


def repeated_blocks(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(k, id)`` whose block has another member.

    Most blocks have one. They are told by their number alone, and bits for those with more, broadcast, keep nearly all other rows
    out of the join: a row is shuffled once as a key of eight bytes, whatever the table's size.
    """
    keys = cut(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated-keys")
    n = keys.count()
    words = min(BROADCAST_ROWS.bit_length(), max(0, (n // 4).bit_length()))  # about 16 bits a key, up to the words that may be broadcast
    word = F.expr(f"shiftrightunsigned(k, 6) & {(1 << words) - 1}L").alias("w")
    bits = F.broadcast(keys.select(word, F.expr("shiftleft(1L, cast(k & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")))
    likely = rows.withColumn("w", word).join(bits, "w").where("getbit(bits, cast(k & 63 as int)) = 1").select("k", "id")
    return likely.join(bounded(keys, n), "k").select("k", "id")


def block_components(rows: DataFrame, close: Callable[[Column, Column], Column], prepare: Callable[[DataFrame], tuple[Judge, Settle, DataFrame | None]] | None = None, by_block: bool = False) -> DataFrame:
    """``rows(k, id)``: ids that share a block ``k`` and are ``close`` are linked -> ``(id, component)``.

    Exact without all pairs of a block. Blocks of one member are left out first. Each member meets three pivots
    of its block (linear in the block). Then, only in blocks whose members are not yet in one component, the
    members outside the block's commonest component meet the others, and just pairs from
    different components are kept. A dense group is in one component after the first step.
    ``prepare``, given the ids that may be in pairs, returns how candidate pairs ``(a, b)`` are judged and settled, and ``(id, mark)`` or None: where
    there are marks, these are given to ``close`` in place of ids, after the pivots. ``by_block`` draws other pivots in each block: more pairs, for groups in which few members are linked to any one pivot. Rows must not repeat.
    """
    blocks = cut(repeated_blocks(rows.where("k is not null and id is not null")), "blocks")
    order = F.xxhash64("id", "k") if by_block else F.xxhash64("id")
    ends = [F.min("id"), F.min_by("id", order), F.max_by("id", order)]
    pivots = blocks.groupBy("k").agg(F.count("*").alias("n"), F.array_distinct(F.array(*ends)).alias("ps"))
    pivots = cut(pivots, "pivots")
    sized = blocks.join(bounded(pivots, pivots.count()), "k")
    judge, settle, marks = prepare(blocks.select("id").distinct()) if prepare else (None, None, None)
    near = sized.select("id", F.explode("ps").alias("p")).where(F.col("id") != F.col("p"))
    near = near.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct()
    if judge:
        judged = judge(near)
        near = judged.where("score is null").select("a", "b").unionAll(settle(judged.where("score is not null").select("a", "b")))
    else:
        near = near.where(close(F.col("a"), F.col("b")))
    first = cut(components(near), "linked")

    named = sized.where("n > 2").select("k", "id").join(first, "id", "left").select("k", "id", F.coalesce("component", "id").alias("c"))
    named = cut(named, "named-blocks")
    parts = named.groupBy("k", "c").agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("parts"), F.max_by("c", "n").alias("most"))
    mixed = cut(parts.where("parts > 1").select("k", "most"), "mixed-blocks")
    open_ = named.join(bounded(mixed, mixed.count()), "k").withColumn("mark", F.col("id"))
    if marks:
        open_ = cut(open_.drop("mark").join(marks, "id"), "open-blocks")
    some = open_.where("c <> most").select("k", F.col("id").alias("a"), F.col("mark").alias("fa"), F.col("c").alias("ca"))
    rest = open_.select("k", F.col("id").alias("b"), F.col("mark").alias("fb"), F.col("c").alias("cb"), (F.col("c") == F.col("most")).alias("main"))
    once = F.col("main") | (F.col("a") > F.col("b"))  # two members outside the commonest component meet once
    pairs = some.join(rest, "k").where((F.col("ca") != F.col("cb")) & once & close(F.col("fa"), F.col("fb")))
    if judge:
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col("a") > F.col("b"), F.col("cb")).otherwise(F.col("ca")).alias("cb"))
        pairs = joined_by_rounds(ordered.distinct(), judge, settle)
    over = cut(components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()), "joined")
    tops = over.select(F.col("id").alias("component"), F.col("component").alias("top"))
    merged = first.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    lone = over.join(first, "id", "left_anti")
    return merged.unionAll(lone)


def unions(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
