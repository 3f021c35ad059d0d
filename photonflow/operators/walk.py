"""The neighbours that a walk through the directory tree meets, for all items of a listing at once.

From an item's directory the walk goes up and down: among the directories that it has heard of it takes the greatest (up) or
smallest (down) path, all of whose files before (after) the item it takes, until it has enough files; a directory tells of its own directories on
that side of the item and of its parent. Nothing is walked here. What the walk would take follows from places in four orders, each
computed once over ranges of a sort, and each item's way to the root is that of its folder. Files of a folder without directories are sorted in one order only.

* Up, the directories below an ancestor come before the next ancestor, greatest name first and each before its own: a preorder, in which
  what is below a directory is an interval (nested sets).
* Down, all ancestors come first, as each is a prefix of all that is below it, and then all directories by path.
* A directory whose path continues the item's with a character below ``/`` (``a`` beside ``a-1/x.jpg``) is never taken: its own path is before the item, those below it after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photonflow.operators.tables import stable


def before(rows: DataFrame, key: str, **weights: Column) -> DataFrame:
    """Adds for each name in ``weights`` the sum over the rows of smaller ``key``, by ranges of the order; the driver sees a row for each range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.withColumns({f"_{n}": w.cast("long") for n, w in weights.items()})
    runs = stable(kept.repartitionByRange(parts, key).withColumn("_run", F.spark_partition_id()), "walk-runs")
    sums, offsets = dict.fromkeys(weights, 0), []
    for r in runs.groupBy("_run").agg(*(F.sum(f"_{n}").alias(n) for n in weights)).orderBy("_run").collect():
        offsets.append((r["_run"], *sums.values()))
        sums = {n: s + r[n] for n, s in sums.items()}
    base = rows.sparkSession.createDataFrame(offsets, "_run int" + "".join(f", _{n}_base long" for n in weights))
    w = W.partitionBy("_run").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    out = runs.join(F.broadcast(base), "_run").withColumns({n: F.col(f"_{n}_base") + F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in weights})
    return out.drop("_run", *(f"_{n}" for n in weights), *(f"_{n}_base" for n in weights))


def ancestors(path: Column) -> Column:
    """The directories above ``path``, deepest first; the root is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def below(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def preorder_key(path: Column, name: Column | None = None) -> Column:
    """Orders a directory before those below it and greater names first; ``name`` is a further step, of any characters."""
    turned = lambda c: F.concat(F.lit("/"), F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    steps = F.when(path == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(path, "/"), turned), ""))
    return steps if name is None else F.concat(steps, turned(name))


def prefixes(text: Column, most: str) -> Column:
    """The proper prefixes of ``text`` that go on with a character up to ``most``."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i + 1, F.lit(1)).between("\x00", most) & (i < F.length(text)))
    return F.transform(at, lambda i: F.substring(text, F.lit(1), i))


def places(start: Column, end: Column, skipped: Column, most: int) -> Column:
    """Up to ``most`` numbers from ``start`` to below ``end``, without the intervals ``skipped`` (array of struct(at, n), null for none)."""
    some = F.array_sort(F.filter(F.coalesce(skipped, F.array().cast("array<struct<at:bigint,n:bigint>>")), lambda s: (s["at"] + s["n"] > start) & (s["at"] < end)))
    starts = F.concat(F.array(start), F.transform(some, lambda s: s["at"] + s["n"]))
    ends = F.concat(F.transform(some, lambda s: s["at"]), F.array(end))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a < b, F.sequence(a, F.least(b - 1, a + most - 1))).otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.flatten(runs), 1, most)


def listed(rows: DataFrame, folders: DataFrame, place: str, key: str) -> DataFrame:
    """``rows(key, places)`` -> ``(key, folder, taken)``: the directories at these places of the order ``place``, and the files of those before each."""
    each = rows.select(key, F.posexplode("places").alias("_pos", place)).join(folders.where("files > 0").select(place, "folder", "files"), place)
    taken = F.coalesce(F.sum("files").over(W.partitionBy(key).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return each.select(key, "folder", taken.alias("taken"))


def walk_candidates(items: DataFrame, enough: int, targets: DataFrame | None = None) -> DataFrame:
    """``(rel_path, item, up)``: what the walk up and the walk down from each item take, each until it has ``enough`` files.

    ``items(rel_path)`` is the listing below one root, ``targets(rel_path)`` those of its items that are asked for, all if not given.
    A directory that is begun is taken whole, so items of a flat directory have all others of it, as in the walk. Null paths are left out, repeated ones count once.
    """
    files = stable(items.where("rel_path is not null").select("rel_path").distinct().select("rel_path", F.get(ancestors(F.col("rel_path")), F.lit(0)).alias("folder")), "walk-files")
    # directories: files of their own, and directories with files from them down
    counts = files.groupBy("folder").agg(F.count("*").alias("n"))
    spread = counts.select("folder", "n", F.explode(F.concat(F.array("folder"), F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("folder"))))).alias("up"))
    folders = spread.groupBy(F.col("up").alias("folder")).agg(F.count("*").alias("inside"), F.coalesce(F.sum(F.when(F.col("up") == F.col("folder"), F.col("n"))), F.lit(0)).alias("files"))
    folders = stable(folders, "walk-folders")
    # entries: what a directory holds; a directory's entry stands where what is below it begins
    parent = F.get(ancestors(F.col("folder")), F.lit(0))
    entries = files.select(F.col("rel_path").alias("entry"), "folder", last(F.col("rel_path")).alias("name"), F.lit(True).alias("file")).unionAll(
        folders.where("folder <> ''").select(F.col("folder").alias("entry"), parent.alias("folder"), F.concat(last(F.col("folder")), F.lit("/")), F.lit(False)))
    one = F.when(F.col("file"), 1).otherwise(0)
    entries = before(entries.withColumn("key", F.concat("folder", F.lit("\x00"), "name")), "key", own_place=one).drop("key")
    first = entries.groupBy("folder").agg(F.min("own_place").alias("first"))
    # a folder without directories is contiguous in the other orders: its files follow from its own entry, and only that is sorted there
    flat = (F.col("files") > 0) & (F.col("inside") == 1) & (F.col("folder") != "")
    held = folders.select("folder", F.col("files").alias("folder_files"), "inside", flat.alias("flat"))
    entries = entries.join(first, "folder").join(held, "folder").withColumn("own_before", F.col("own_place") - F.col("first")).drop("first")
    entries = stable(entries, "walk-entries")
    sole = folders.where(flat).select(F.col("folder").alias("entry"), F.col("files").alias("sole"))
    sorted_ = entries.where(~F.col("flat")).join(sole, "entry", "left").withColumn("key", below(F.col("folder"), F.col("name")))
    sorted_ = before(sorted_, "key", all_before=F.coalesce(F.col("sole"), one)).drop("key", "sole")
    some = F.when(F.col("files") > 0, 1).otherwise(0)
    nothing = F.lit(0).cast("long")
    marks = sorted_.select("entry", preorder_key(F.col("folder"), F.col("name")).alias("key"), F.lit(True).alias("mark"), nothing.alias("files"))
    tree = before(marks.unionAll(folders.select("folder", preorder_key(F.col("folder")), F.lit(False), "files")), "key", preorder=some)
    marks = sorted_.select("entry", below(F.col("folder"), F.col("name")).alias("key"), F.lit(True).alias("mark"), nothing.alias("files"))
    paths = before(marks.unionAll(folders.select("folder", "folder", F.lit(False), "files")), "key", by_path=some)
    at = lambda rows, mark, name, to: rows.where(F.col("mark") == mark).select(F.col("entry").alias(to), F.col(name))
    folders = stable(folders.join(at(tree, False, "preorder", "folder"), "folder").join(at(paths, False, "by_path", "folder"), "folder"), "walk-folders")
    end = folders.select("folder", (F.col("preorder") + F.col("inside")).alias("end"))
    sorted_ = sorted_.join(at(tree, True, "preorder", "entry"), "entry").join(at(paths, True, "by_path", "entry"), "entry").join(end, "folder")
    sorted_ = stable(sorted_, "walk-sorted")
    own_entry = sorted_.where(~F.col("file")).select(F.col("entry").alias("folder"), F.col("all_before").alias("_base"), "by_path")
    columns = ["entry", "folder", "file", "all_before", "by_path", "own_place", "own_before", "folder_files"]
    derived = entries.where("flat").join(own_entry, "folder").withColumn("all_before", F.col("_base") + F.col("own_before"))
    leaves = stable(derived.select(columns).unionAll(sorted_.where("file").select(columns)), "walk-leaves")  # of files
    inner = sorted_.where(~F.col("file")).select(columns)  # of directories

    # up: for each entry, the directories beside it that the walk takes at this level
    open_ = sorted_.where("preorder < end").select("entry", "folder", "name", "preorder", "end")
    beside = open_.select("entry", F.explode(F.transform(prefixes(F.col("name"), "/"), lambda x: below(F.col("folder"), x))).alias("folder"))
    skipped = beside.join(folders.select("folder", "preorder", "inside"), "folder").groupBy("entry").agg(F.collect_list(F.struct(F.col("preorder").alias("at"), F.col("inside").alias("n"))).alias("skipped"))
    beside = open_.join(skipped, "entry", "left").select("entry", places(F.col("preorder"), F.col("end"), F.col("skipped"), enough).alias("places"))
    beside = listed(beside, folders, "preorder", "entry")

    # the way of each item to the root
    wanted = files if targets is None else files.join(targets.select("rel_path").distinct(), "rel_path", "left_semi")
    # the same for all files of a folder but for the first step
    steps = F.concat(F.array("folder"), F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("folder"))))
    chain = folders.where("files > 0").select(F.col("folder").alias("here"), F.posexplode(F.slice(steps, 1, F.size(steps) - 1)).alias("level", "entry"))
    beyond_file = F.col("folder_files") - F.col("own_before")
    by_level = W.partitionBy("here").orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    chain = chain.join(inner, "entry").select("here", "level", "entry", "folder", "all_before", "own_place", "own_before", beyond_file.alias("after"))
    chain = stable(chain.withColumn("_taken", F.coalesce(F.sum("after").over(by_level), F.lit(0))), "walk-chains")
    begun = leaves.join(wanted.select(F.col("rel_path").alias("entry")), "entry", "left_semi") if targets is not None else leaves
    begun = begun.select(F.col("entry").alias("rel_path"), "entry", "folder", "all_before", "own_place", "own_before", (beyond_file - 1).alias("after"))
    on = begun.select("rel_path", F.col("folder").alias("here"), F.col("all_before").alias("_start"), F.col("after").alias("_after")).join(chain, "here")
    on = on.select("rel_path", "entry", "folder", "own_place", "own_before", "after", (F.col("_start") - F.col("all_before")).alias("up_taken"), (F.col("_after") + F.col("_taken")).alias("down_taken"))
    zero = F.lit(0).cast("long")
    ways = begun.select("rel_path", "entry", "folder", "own_place", "own_before", "after", zero.alias("up_taken"), zero.alias("down_taken")).unionAll(on)
    ways = stable(ways, "walk-ways")

    own = leaves.select(F.col("entry").alias("item"), "folder", F.col("own_place").alias("place"))
    near = ways.where(F.least("up_taken", "down_taken") < enough).join(own, "folder").where("item <> rel_path").select("rel_path", "item", (F.col("place") < F.col("own_place")).alias("up"), "up_taken", "down_taken")
    near = near.where(F.when(F.col("up"), F.col("up_taken")).otherwise(F.col("down_taken")) < enough).select("rel_path", "item", "up")
    full = F.col("up_taken") + F.col("own_before")
    up = ways.where(full < enough).join(beside.withColumnRenamed("folder", "met"), "entry").where(full + F.col("taken") < enough).select("rel_path", F.col("met").alias("folder"), F.lit(True).alias("up"))

    # down, beyond the root: directories by path
    total = ways.groupBy("rel_path").agg(F.sum("after").alias("down")).where(F.col("down") < enough)
    few = total.join(leaves.select(F.col("entry").alias("rel_path"), F.col("by_path").alias("start")), "rel_path")
    odd = few.select("rel_path", F.explode(prefixes(F.col("rel_path"), ".")).alias("folder")).join(folders.select("folder", "inside", "files"), "folder")
    odd = odd.join(inner.select(F.col("entry").alias("folder"), "by_path"), "folder").select("rel_path", F.struct(F.col("by_path").alias("at"), (F.col("inside") - F.when(F.col("files") > 0, 1).otherwise(0)).alias("n")).alias("s"))
    odd = odd.where("s.n > 0").groupBy("rel_path").agg(F.collect_list("s").alias("skipped"))
    most = folders.where("files > 0").count()
    beyond = few.join(odd, "rel_path", "left").select("rel_path", places(F.col("start"), F.lit(most).cast("long"), F.col("skipped"), enough).alias("places"))
    beyond = listed(beyond, folders, "by_path", "rel_path").join(total, "rel_path").where(F.col("down") + F.col("taken") < enough).select("rel_path", "folder", F.lit(False).alias("up"))
    met = up.unionAll(beyond).join(own.select("folder", "item"), "folder").select("rel_path", "item", "up")
    return near.unionAll(met)
