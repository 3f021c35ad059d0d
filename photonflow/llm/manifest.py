"""Merkle manifest of a dataset: a digest of every row, one of every source, one of all, and a proof for each row.

Rows are leaves. The leaves of a source stand in one order and are folded three by three until one node is left, its subroot;
the subroots of all sources are folded likewise to the root. A bucket is an aligned run of 3^7 nodes of one tree, so
seven levels never need another bucket: tasks take whole buckets as Arrow batches and fold them in DuckDB with ordered
string_agg and sha256. Spark ranks the leaves, combines bucket roots (2,187 times fewer rows each round) and joins the proofs above a
bucket to it, one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photonflow.llm.common import bounded, cut

#: Children of a node, and the levels that a bucket spans.
FAN, DEPTH = 3, 7
BUCKET = FAN**DEPTH
#: Rows that are folded at once: whole buckets until there are as many.
ROWS = 8 * BUCKET
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of different values give one text; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of ``documents`` whose text is ``text``."""
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in COLUMNS)), 256)


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place (from 0) in the group ``g`` by ``order``, and ``n``, the rows of the group.

    Rows are dealt to tasks by ranges of (g, order), so a group with most rows has many tasks, and equal rows are spread as well;
    a row's place is its number within its run and the counts of the group's runs before, which are as many as tasks at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(rows.repartitionByRange(parts, "g", *order, F.rand(1)).withColumn("_run", F.spark_partition_id()), "runs")
    counts = runs.groupBy("g", "_run").agg(F.count("*").alias("m"))
    by_run = W.partitionBy("g").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    counts = cut(counts.select("g", "_run", F.coalesce(F.sum("m").over(by_run), F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy("g")).alias("n")), "run-counts")
    local = F.row_number().over(W.partitionBy("g", "_run").orderBy(*order))
    placed = runs.withColumn("_local", local).join(bounded(counts, counts.count()), ["g", "_run"])
    return placed.withColumn("pos", F.col("before") + F.col("_local") - 1).drop("_run", "_local", "before")


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Batches sorted by (g, b) joined and cut again so that no bucket is in two tables; a table has about ``rows`` rows and a bucket at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        g, b = table["g"], table["b"]
        last = pc.index(pc.and_(pc.equal(g, g[-1]), pc.equal(b, b[-1])), True).as_py()
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def engine():
    """A DuckDB connection for one task: one thread, nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


#: One level up within a bucket: a run of nodes becomes their digest; a node that is alone in its tree stays.
LEVEL = """select g, b, pos // 3 as pos, (any_value(n) + 2) // 3 as n,
  case when any_value(n) = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h
from nodes group by g, b, pos // 3"""


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets -> the node ``DEPTH`` levels above each."""
    con = engine()
    for table in whole_buckets(batches):
        con.register("bucket", table)
        con.execute("create or replace temp table nodes as select g, b, pos, n, h from bucket")
        for _ in range(DEPTH):
            con.execute(f"create or replace temp table nodes as {LEVEL}")
        yield from con.sql("select g, pos, n, h from nodes").to_arrow_table().to_batches()
        con.unregister("bucket")


def climb(batches: Iterator[pa.RecordBatch], leaves: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets, and a row at place -1 of each bucket with what is above it -> the way from each node to the root.

    A step is the digests left and right of a node in its run. For ``leaves`` the way is folded twice: into the proof's digest and, from the
    digest ``bad``, into the root that this digest would give.
    """
    con = engine()
    for table in whole_buckets(batches):
        con.register("bucket", table)
        con.execute("create or replace temp table above as select g, b, steps, subroot, root from bucket where pos = -1")
        con.execute("create or replace temp table nodes as select g, b, pos, n, h from bucket where pos >= 0")
        con.execute(f"create or replace temp table ways as select g, b, pos, pos as p, doc_id, h, bad as folded, []::{STEPS_SQL} as steps from bucket where pos >= 0")
        for _ in range(DEPTH):
            con.execute("create or replace temp table runs as select g, pos // 3 as q, list(h order by pos) as hs from nodes where n > 1 group by g, q")
            con.execute("""create or replace temp table ways as
              with met as (select w.*, array_to_string(hs[1:p % 3], '') as l, array_to_string(hs[p % 3 + 2:], '') as r, hs is not null as up from ways w left join runs on runs.g = w.g and runs.q = w.p // 3)
              select g, b, pos, p // 3 as p, doc_id, h, case when up then sha256(l || folded || r) else folded end as folded, case when up then list_append(steps, {'l': l, 'r': r}) else steps end as steps from met""")
            con.execute(f"create or replace temp table nodes as {LEVEL}")
        if leaves:
            con.execute("create or replace temp table ways as select w.*, a.steps as outer_steps, subroot, root from ways w join above a on a.g = w.g and a.b = w.b")
            [(most,)] = con.sql("select coalesce(max(len(outer_steps)), 0) from ways").fetchall()
            for j in range(1, most + 1):
                con.execute(f"create or replace temp table ways as select * replace (case when len(outer_steps) >= {j} then sha256(outer_steps[{j}].l || folded || outer_steps[{j}].r) else folded end as folded) from ways")
            proof = "sha256(array_to_string(list_transform(list_concat(steps, outer_steps), lambda s: s.l || s.r), ''))"
            out = con.sql(f"select doc_id, h as leaf, subroot, root, {proof} as proof_sha256, folded as folded_root, folded = root as verified from ways")
        else:
            out = con.sql("select w.g, pos, list_concat(w.steps, a.steps) as steps, subroot, root from ways w join above a on a.g = w.g and a.b = w.b")
        yield from out.to_arrow_table().to_batches()
        con.unregister("bucket")


STEPS_SQL = "struct(l varchar, r varchar)[]"


def by_bucket(rows: DataFrame) -> DataFrame:
    """Whole buckets in one task, in order. A bucket has ``BUCKET`` nodes at most, however many its tree has."""
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", "pos")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(g, pos, n, h)`` and the tables above them, ``DEPTH`` levels apart, up to that in which each tree has one node."""
    chain = [nodes]
    while (chain[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = by_bucket(chain[-1].select("g", F.floor(F.col("pos") / BUCKET).cast("long").alias("b"), "pos", "n", "h"))
        chain.append(cut(up.mapInArrow(fold, "g string, pos long, n long, h string"), "bucket-roots"))
    return chain


def ways(nodes: DataFrame, above: DataFrame, leaves: bool) -> DataFrame:
    """``nodes(g, pos, n, h[, bad, doc_id])`` with what ``above(g, pos, steps, subroot, root)`` says of their buckets."""
    none = lambda kind: F.lit(None).cast(kind)
    extra = [F.col("bad"), F.col("doc_id")] if leaves else [F.col("h").alias("bad"), none("long").alias("doc_id")]
    rows = nodes.select("g", F.floor(F.col("pos") / BUCKET).cast("long").alias("b"), "pos", "n", "h", *extra, none(STEPS).alias("steps"), none("string").alias("subroot"), none("string").alias("root"))
    heads = above.select("g", F.col("pos").alias("b"), F.lit(-1).cast("long").alias("pos"), none("long").alias("n"), none("string").alias("h"), none("string").alias("bad"), none("long").alias("doc_id"), "steps", "subroot", "root")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" if leaves else f"g string, pos long, steps {STEPS}, subroot string, root string"
    return by_bucket(rows.unionAll(heads)).mapInArrow(lambda batches: climb(batches, leaves), schema)


def down(chain: list[DataFrame], above: DataFrame) -> DataFrame:
    """What is above the buckets of ``chain[0]``, given what is above the tree of each group (place 0)."""
    for nodes in chain[-2:0:-1]:
        above = cut(ways(nodes, above, False), "ways")
    return above


def proved(leaves: DataFrame) -> DataFrame:
    """``leaves(g, doc_id, leaf, bad)`` -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``g`` is the tree of a leaf, in whose order the subroots stand; leaves of a tree stand by doc_id (null first), then leaf.
    The driver sees the root and the size of the largest tree of each round.
    """
    spark = leaves.sparkSession
    placed = cut(positioned(leaves, ["doc_id", "leaf", "bad"]).withColumnRenamed("leaf", "h"), "leaves")
    chain = grown(placed)
    # the trees' own tree: its leaves are the subroots
    tops = chain[-1].select(F.lit("").alias("g"), F.col("g").alias("tree"), "h")
    tops = cut(positioned(tops, ["tree"]), "subroots")
    over = grown(tops)
    root = over[-1].select("h").first()
    first = spark.createDataFrame([("", 0, [], None, root[0] if root else None)], f"g string, pos long, steps {STEPS}, subroot string, root string")
    outer = ways(tops, down(over, first), False).select(F.col("pos"), "steps", "root")
    heads = cut(tops.join(outer, "pos").select(F.col("tree").alias("g"), F.lit(0).cast("long").alias("pos"), "steps", F.col("h").alias("subroot"), "root"), "tree-ways")
    return ways(placed, down(chain, heads), True)


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Null values have a mark of their own; null sources are one tree, the first; null ids stand first in theirs and are never tampered with. Rows that
    repeat an id stand by their digests; rows that are equal altogether are leaves of their own with equal digests and different proofs. Other columns have no part. An empty table has no rows.
    """
    lines = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select(*(F.col(f"`{c}`") for c in COLUMNS))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return proved(cut(rows.select(tree.alias("g"), "doc_id", leaf(F.col("text")).alias("leaf"), leaf(lines).alias("bad")), "digests"))


_FIELDS = " || ".join(f"coalesce(strlen({{{c}}}::varchar) || ':' || {{{c}}}::varchar, '-')" for c in COLUMNS)
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)), 4294967295::bigint)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + _FIELDS.format(**({c: c for c in COLUMNS} | {"text": text})) + ")"


ORACLE = f"""
with recursive marked as (select *, coalesce('=' || source, '') as g, coalesce({_CRC} % 2 = 0, false) as odd from documents),
hashed as (select row_number() over () as k, g, doc_id, {_leaf_sql('text')} as leaf, case when odd then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql('text')} end as bad from marked),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, bad) - 1 as pos, count(*) over (partition by g) as n from hashed),
up as (
  select g, 0 as lv, pos, n, leaf as h from placed
  union all select g, lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by g, lv, pos // 3, n),
subs as (select g, h as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from up where n = 1),
over_ as (
  select 0 as lv, pos, n, subroot as h from subs
  union all select lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from over_ where n > 1 group by lv, pos // 3, n),
runs as (select g, lv, pos // 3 as q, list(h order by pos) as hs from up where n > 1 group by all),
over_runs as (select lv, pos // 3 as q, list(h order by pos) as hs from over_ where n > 1 group by all),
way as (
  select k, g, 0 as lv, pos as p, bad as folded, '' as proof from placed
  union all select k, w.g, w.lv + 1, p // 3, sha256(array_to_string(hs[1:p % 3], '') || folded || array_to_string(hs[p % 3 + 2:], '')), proof || array_to_string(hs[1:p % 3], '') || array_to_string(hs[p % 3 + 2:], '')
  from way w join runs r on r.g = w.g and r.lv = w.lv and r.q = p // 3),
inner_ as (select k, arg_max(folded, lv) as folded, arg_max(proof, lv) as proof from way group by k),
out_way as (
  select k, 0 as lv, s.pos as p, folded, proof from inner_ join placed using (k) join subs s using (g)
  union all select k, w.lv + 1, p // 3, sha256(array_to_string(hs[1:p % 3], '') || folded || array_to_string(hs[p % 3 + 2:], '')), proof || array_to_string(hs[1:p % 3], '') || array_to_string(hs[p % 3 + 2:], '')
  from out_way w join over_runs r on r.lv = w.lv and r.q = p // 3),
ends as (select k, arg_max(folded, lv) as folded, arg_max(proof, lv) as proof from out_way group by k),
top as (select h as root from over_ where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from placed join subs using (g) join ends using (k) cross join top
"""
