"""The items nearest in time among the neighbours of each item in path order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonflow.functions.datetimes import proximity
from photonflow.functions.template import fill
from photonflow.functions.text import truncate
from photonflow.operators.tables import stable
from photonflow.operators.walk import walk_candidates


def path_ranks(items: DataFrame, key: str = "rel_path") -> DataFrame:
    """Adds ``rank``, the position in binary order of ``key``, without one task for all.

    Runs of the order are numbered within themselves, and the sums of the runs before are added; the
    driver sees one count for each run. The runs are written first, so both steps see the same ones.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stable(items.repartitionByRange(parts, key).withColumn("_run", F.spark_partition_id()), "ranks")
    before, offsets = 0, []
    for r in runs.groupBy("_run").count().orderBy("_run").collect():
        offsets.append((r["_run"], before))
        before += r["count"]
    base = items.sparkSession.createDataFrame(offsets, "_run int, _before long")
    local = F.row_number().over(W.partitionBy("_run").orderBy(key))
    return runs.withColumn("_local", local).join(F.broadcast(base), "_run").withColumn("rank", F.col("_before") + F.col("_local")).drop("_run", "_local", "_before")


#: Rows of a block at least; a block also has a copy of the rows next to it.
BLOCK = 4096


def nearest(items: DataFrame, k: int, window_days: int | None = None, targets: DataFrame | None = None, walk: bool = False) -> DataFrame:
    """``(rel_path, item, score_min, score_max, place)``: up to ``k`` items by distance of their farther ends in time, then path.

    Candidates are the 2k rows before and after in path order, or with ``walk`` what a walk through the directory tree takes (``walk_candidates``); rows
    without a time are no candidates and have none. ``targets(rel_path)`` are the rows that context is wanted for, all if not given.

    Ranks are cut into blocks, each with the 2k rows on either side of it, so a row's candidates are a frame of its block: nothing is joined.
    """
    items = stable(items.select("rel_path", "datetime_min", "datetime_max"), "dated-items")
    own, other = F.struct("rel_path", "datetime_min", "datetime_max"), ["rel_path", "datetime_min", "datetime_max"]
    if walk:
        times = items.where("datetime_min is not null")
        met = walk_candidates(items, 2 * k, targets).select("rel_path", "item").join(times.select(F.col("rel_path").alias("item"), F.struct(F.col("rel_path"), "datetime_min", "datetime_max").alias("i")), "item")
        scored = met.join(times, "rel_path").select("rel_path", _scored(own, F.col("i")).alias("s"))
        scored = scored if window_days is None else scored.where(F.col("s.score_max") <= window_days * 86400.0)
        placed = scored.withColumn("place", F.row_number().over(W.partitionBy("rel_path").orderBy("s.score_max", "s.item"))).where(F.col("place") <= k)
        return placed.select("rel_path", "s.item", "s.score_min", "s.score_max", "place")
    reach, size = 2 * k, max(BLOCK, 8 * k)
    block = lambda rank: F.floor(rank / F.lit(size)).cast("long")
    ranked = path_ranks(items)
    dealt = ranked.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("rank") - reach), block(F.col("rank")), block(F.col("rank") + reach)))))
    frame = W.partitionBy("_block").orderBy("rank").rowsBetween(-reach, reach)
    found = F.collect_list(F.when(F.col("datetime_min").isNotNull(), F.struct(*other))).over(frame)
    rows = dealt.withColumn("_near", found).where((F.col("_block") == block(F.col("rank"))) & F.col("datetime_min").isNotNull())
    if targets is not None:
        rows = rows.join(targets.select("rel_path").distinct(), "rel_path", "left_semi")
    scores = F.transform(F.filter("_near", lambda i: i["rel_path"] != F.col("rel_path")), lambda i: _scored(own, i))
    if window_days is not None:
        scores = F.filter(scores, lambda x: x["score_max"] <= window_days * 86400.0)
    best = rows.select("rel_path", F.posexplode(F.slice(F.array_sort(scores), 1, k)).alias("_pos", "s"))
    return best.select("rel_path", "s.item", "s.score_min", "s.score_max", (F.col("_pos") + 1).alias("place"))


def _scored(target: Column, item: Column) -> Column:
    """``struct(score_max, item, score_min)``, which orders as candidates do."""
    score = proximity(target["datetime_min"], target["datetime_max"], item["datetime_min"], item["datetime_max"])
    return F.struct(score["score_max"].alias("score_max"), item["rel_path"].alias("item"), score["score_min"].alias("score_min"))


def context_arrays(near: DataFrame, descriptions: DataFrame, compat: bool = False) -> DataFrame:
    """``(rel_path, context)``: descriptions in order. Items without one are left out; in ``compat`` one such item empties the context."""
    met = near.join(descriptions.select(F.col("rel_path").alias("item"), "description"), "item", "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("description").isNotNull(), F.struct("place", "item", "score_min", "score_max", "description"))))
    if compat:
        rows = F.when(F.bool_or(F.col("description").isNull()), F.array().cast("array<struct<place:int,item:string,score_min:double,score_max:double,description:string>>")).otherwise(rows)
    return met.groupBy("rel_path").agg(rows.alias("context"))


def context_section(context: Column, template: str, item_template: str, max_items: int, max_length: int, budget: int | None = None, compat: bool = False) -> Column:
    """The filled section of numbered, truncated descriptions; empty without context.

    ``context`` is an array of texts. ``budget`` keeps the first items whose lengths together do not
    pass it. In ``compat`` the items are never put in, as in the original.
    """
    numbered = F.transform(F.slice(context, 1, max_items), lambda text, i: fill(item_template, {"number": i + 1, "description": truncate(text, max_length)}))
    if budget is not None:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

        def add(acc: Column, item: Column) -> Column:
            fits = acc["open"] & (acc["n"] + F.length(item) <= budget)
            return F.struct((acc["n"] + F.length(item)).alias("n"), F.when(fits, F.array_append(acc["kept"], item)).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

        numbered = F.aggregate(numbered, start, add)["kept"]
    items = F.lit("") if compat else F.array_join(numbered, "")
    return F.when(F.size(context) > 0, fill(template, {"items": items})).otherwise("")
