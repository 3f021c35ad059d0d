"""Queries of the media-enrichment operators over the supplied tables, and the same in SQL.

The tables hold no images, so ``events`` stand for a media listing with time stamps in its paths,
``documents`` for descriptions, ``labels`` for what is done or failed, ``conversations`` for replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonflow.config import CONTEXT_ITEM, CONTEXT_TEMPLATE, DESCRIBE_OUTPUT, DESCRIBE_PROMPT, ENHANCE_PROMPT, EXTENSIONS
from photonflow.functions import datetimes, geo, paths, stats, text
from photonflow.functions.template import fill
from photonflow.media.jpeg import SIGNATURE
from photonflow.operators import context, lookup, prompt, walk
from photonflow.operators.ordering import rank_within

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def media(events: DataFrame) -> DataFrame:
    """``event_id, rel_path, path, name`` in six shapes of file name by event_id; every event is one file."""
    day = lambda f: F.date_format("ts", f)
    n, shape = F.col("event_id").cast("string"), F.col("event_id") % 6
    folder = F.concat(day("yyyy"), F.lit("/"), day("yyyy-MM"), F.lit("/"), day("yyyy-MM-dd"), F.lit("/"))
    rel = (
        F.when(shape == 0, F.concat(folder, F.lit("IMG_"), day("yyyyMMdd_HHmmss"), F.lit("_"), n, F.lit(".jpg")))
        .when(shape == 1, F.concat(folder, day("yyyyMMdd"), F.lit("-"), n, F.lit(".JPG")))
        .when(shape == 2, F.concat(folder, F.lit("undated "), n, F.lit(".png")))
        .when(shape == 3, F.concat(F.lit("misc/scan_"), n, F.lit(".txt")))
        .when(shape == 4, F.concat(F.lit("misc/IMG-"), day("yyyyMMdd"), F.lit("-WA"), n, F.lit(".jpeg")))
        .otherwise(F.concat(F.lit("misc/"), day("yyyy"), F.lit("0230_101010_"), n, F.lit(".jpg")))
    )
    out = events.withColumn("rel_path", rel).withColumn("path", F.concat(F.lit("/photos/"), F.col("rel_path")))
    return out.withColumn("name", paths.basename(F.col("path")))


_MEDIA = """
media AS (
  SELECT *, '/photos/' || rel_path AS path, regexp_extract(rel_path, '[^/]*$') AS name FROM (
    SELECT *, CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%Y/%Y-%m/%Y-%m-%d/IMG_%Y%m%d_%H%M%S_') || event_id || '.jpg'
      WHEN 1 THEN strftime(ts, '%Y/%Y-%m/%Y-%m-%d/%Y%m%d-') || event_id || '.JPG'
      WHEN 2 THEN strftime(ts, '%Y/%Y-%m/%Y-%m-%d/undated ') || event_id || '.png'
      WHEN 3 THEN 'misc/scan_' || event_id || '.txt'
      WHEN 4 THEN 'misc/IMG-' || strftime(ts, '%Y%m%d') || '-WA' || event_id || '.jpeg'
      ELSE 'misc/' || strftime(ts, '%Y') || '0230_101010_' || event_id || '.jpg' END AS rel_path
    FROM events))"""
_EXT = r"regexp_extract({0}, '^\.*[^.].*?(\.[^.]*)$', 1)"


def _day(column: str, pattern: str, clock: str) -> str:
    parts = " || ".join(f"regexp_extract({column}, '{pattern}', {i})" for i in (1, 2, 3))
    return f"try_strptime({parts} || '{clock}', '%Y%m%d%H%M%S')"


def _dated(end: str) -> str:
    clock = {"min": "000000", "max": "235959"}[end]
    exact = "try_strptime(" + " || ".join(f"regexp_extract(name, '{datetimes.EXACT}', {i})" for i in range(1, 7)) + ", '%Y%m%d%H%M%S')"
    folders = "list_reverse(string_split(path, '/')[:-2])"
    inner = f"coalesce({_day('d', datetimes.LEADING_DAY, clock)}, {_day('d', datetimes.DASHED_DAY, clock)})"
    walked = f"list_filter(list_transform({folders}, lambda d: {inner}), lambda x: x IS NOT NULL)[1]"
    return f"coalesce({exact}, {_day('name', datetimes.DELIMITED_DAY, clock)}, {_day('name', datetimes.LEADING_DAY, clock)}, {walked})"


_DATED = f"""{_MEDIA},
dated AS (SELECT event_id, ts, user_id, event_type, "value", rel_path, path, name, {_dated('min')} AS dt_min, {_dated('max')} AS dt_max FROM media)"""


def dated(events: DataFrame) -> DataFrame:
    return _dates(media(events))


def _dates(items: DataFrame) -> DataFrame:
    return items.withColumn("_r", datetimes.path_datetime(F.col("path"))).withColumns({"dt_min": F.col("_r.min"), "dt_max": F.col("_r.max")}).drop("_r")


def _display_sql(c: str) -> str:
    return f"CASE WHEN hour({c}) = 0 AND minute({c}) = 0 AND second({c}) = 0 THEN strftime({c}, '%Y-%m-%d') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S') END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(template: str, values: dict[str, str]) -> str:
    """The template as a concatenation in SQL."""
    import re

    parts = [f"coalesce({values[p]}, '')" if i % 2 else _quoted(p) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return " || ".join(parts)


@query(f"WITH {_MEDIA} SELECT event_id, path FROM media WHERE lower({_EXT.format('name')}) IN {EXTENSIONS}")
def scan_filter_ext(spark: SparkSession, sf: str) -> DataFrame:
    return media(_table(spark, sf, "events")).where(paths.has_extension(F.col("name"), EXTENSIONS)).select("event_id", "path")


@query(
    f"""WITH {_MEDIA}, p AS (SELECT 'media' AS kind, event_id AS id, path FROM media UNION ALL SELECT 'page', page_id, url FROM pages),
    n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p)
    SELECT kind, id, name, regexp_extract(path, '^(.*?)/+[^/]*$', 1) AS folder, {_EXT.format('name')} AS ext, left(name, length(name) - length({_EXT.format('name')})) AS base,
    CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth FROM n"""
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    items = media(_table(spark, sf, "events")).select(F.lit("media").alias("kind"), F.col("event_id").alias("id"), "path")
    rows = items.unionAll(_table(spark, sf, "pages").select(F.lit("page"), "page_id", "url"))
    path, name = F.col("path"), paths.basename(F.col("path"))
    return rows.select("kind", "id", name.alias("name"), paths.dirname(path).alias("folder"), paths.extension(name).alias("ext"), paths.stem(name).alias("base"), paths.depth(path).alias("depth"))


@query(f"WITH {_DATED} SELECT event_id, dt_min, dt_max FROM dated")
def datetime_from_path(spark: SparkSession, sf: str) -> DataFrame:
    return dated(_table(spark, sf, "events")).select("event_id", "dt_min", "dt_max")


@query(f"SELECT 'event' AS kind, event_id AS id, {_display_sql('ts')} AS shown FROM events UNION ALL SELECT 'order', o_orderkey, {_display_sql('o_orderdate')} FROM orders")
def datetime_display(spark: SparkSession, sf: str) -> DataFrame:
    shown = lambda t, k, c: _table(spark, sf, t).select(F.lit(t[:-1]).alias("kind"), F.col(k).alias("id"), datetimes.display(F.col(c)).alias("shown"))
    return shown("events", "event_id", "ts").unionAll(shown("orders", "o_orderkey", "o_orderdate"))


_NATURAL = r"list_transform(regexp_extract_all(name, '\D*\d+|\D+$'), lambda r: struct_pack(s := lower(regexp_extract(r, '^\D*')), n := coalesce(try_cast(regexp_extract(r, '\d+$') AS HUGEINT), -1)))"


@query(
    f"""WITH {_MEDIA}, k AS (SELECT event_id, user_id, name, {_NATURAL} AS key FROM media)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY key ASC, event_id) AS INTEGER) AS rank_asc,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY key DESC, event_id) AS INTEGER) AS rank_desc FROM k"""
)
def natural_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    rank = lambda order: rank_within(F.col("user_id"), F.col("name"), order, F.col("event_id"))
    return media(_table(spark, sf, "events")).select("event_id", rank("natural-asc").alias("rank_asc"), rank("natural-desc").alias("rank_desc"))


@query(
    """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name) ASC, p_partkey) AS INTEGER) AS rank_asc,
    CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name) DESC, p_partkey) AS INTEGER) AS rank_desc FROM part"""
)
def name_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    rank = lambda order: rank_within(F.col("p_brand"), F.col("p_name"), order, F.col("p_partkey"))
    return _table(spark, sf, "part").select("p_partkey", rank("name-asc").alias("rank_asc"), rank("name-desc").alias("rank_desc"))


def _item(doc_id: Column) -> Column:
    return F.concat(F.lit("docs/"), doc_id.cast("string"), F.lit(".jpg"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    rel = _item(F.col("doc_id"))
    return _table(spark, sf, "documents").select("doc_id", rel.alias("rel_path"), F.concat(F.lit("/in/"), rel).alias("path"))


def _labelled(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    return _table(spark, sf, "labels").where(condition).select(_item(F.col("doc_id")).alias("rel_path"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def skip_done(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.pending(_listing(spark, sf), _labelled(spark, sf, "quality = 1"), _labelled(spark, sf, "false")).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (quality = 1 OR toxic = 1))")
def skip_failed(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.pending(_listing(spark, sf), _labelled(spark, sf, "quality = 1"), _labelled(spark, sf, "toxic = 1")).select("doc_id")


@query(
    """WITH d AS (SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS done, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS failed FROM documents d)
    SELECT mode, doc_id FROM d, (VALUES ('plain'), ('retry'), ('retry_failed'), ('compat')) m(mode)
    WHERE CASE mode WHEN 'plain' THEN NOT done AND NOT failed WHEN 'retry' THEN true ELSE NOT done END"""
)
def retry_modes(spark: SparkSession, sf: str) -> DataFrame:
    done, failed = _labelled(spark, sf, "quality = 1"), _labelled(spark, sf, "toxic = 1")
    modes = {"plain": {}, "retry": {"retry": True}, "retry_failed": {"retry_failed": True}, "compat": {"compat": True}}
    rows = [lookup.pending(_listing(spark, sf), done, failed, **options).select(F.lit(mode).alias("mode"), "doc_id") for mode, options in modes.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query("SELECT doc_id, '/in/docs/' || doc_id || CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) THEN '.fixed.jpg' ELSE '.jpg' END AS preferred FROM documents d")
def preferred_variant(spark: SparkSession, sf: str) -> DataFrame:
    fixed = _labelled(spark, sf, "toxic = 1").select(paths.fixed_variant(F.col("rel_path")).alias("rel_path")).distinct()
    listing = fixed.withColumn("path", F.concat(F.lit("/in/"), F.col("rel_path")))
    return lookup.with_preferred(_listing(spark, sf), listing).select("doc_id", "preferred")


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN 'quality ' || toxic END AS description FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def sidecar_lookup(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("quality") == 1, F.concat(F.lit("\t quality "), F.col("toxic").cast("string"), F.lit(" \n"))).otherwise(F.lit(" \n"))
    texts = _table(spark, sf, "labels").select(_item(F.col("doc_id")).alias("rel_path"), body.alias("text"))
    return lookup.with_text(_listing(spark, sf), texts, "description").select("doc_id", "description")


@query(f"WITH {_MEDIA} SELECT event_id FROM media WHERE event_type = 'error' AND lower({_EXT.format('name')}) IN ('.jpg', '.jpeg') AND event_id % 2 = 0")
def fixable_semi(spark: SparkSession, sf: str) -> DataFrame:
    items = media(_table(spark, sf, "events"))
    message = F.when(F.col("event_id") % 2 == 0, F.lit(f"Failed: {SIGNATURE} (x)")).otherwise(F.lit("Failed: VipsJpeg: premature end"))
    errors = items.where("event_type = 'error'").select("rel_path", message.alias("error"))
    return lookup.with_error(items.where(paths.has_extension(F.col("name"), (".jpg", ".jpeg"))), errors, SIGNATURE).select("event_id")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    items = dated(_table(spark, sf, "events")).select("rel_path", F.col("dt_min").alias("datetime_min"), F.col("dt_max").alias("datetime_max"))
    return context.nearest(items, K)


_NEAR = f"""{_DATED},
ranked AS (SELECT rel_path, dt_min, dt_max, row_number() OVER (ORDER BY rel_path) AS r FROM dated),
scored AS (
  SELECT t.rel_path, i.rel_path AS item, CAST(abs(date_diff('second', t.dt_max, i.dt_min)) AS DOUBLE) AS score_min, CAST(abs(date_diff('second', t.dt_min, i.dt_max)) AS DOUBLE) AS score_max
  FROM ranked t CROSS JOIN (SELECT unnest(range(-{2 * K}, {2 * K + 1})) AS o) AS offsets JOIN ranked i ON i.r = t.r + o
  WHERE o <> 0 AND t.dt_min IS NOT NULL AND i.dt_min IS NOT NULL
),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rel_path ORDER BY score_max, item) AS INTEGER) AS place FROM scored) WHERE place <= {K})"""


@query(f"WITH {_NEAR} SELECT rel_path, item, score_min, score_max, place FROM near")
def context_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf)


@query(f"WITH {_NEAR} SELECT rel_path, string_agg(place || ':' || item, ',' ORDER BY place) AS items FROM near WHERE item NOT LIKE '%.png' GROUP BY rel_path")
def context_array(spark: SparkSession, sf: str) -> DataFrame:
    known = media(_table(spark, sf, "events")).where(~F.col("name").endswith(".png")).select("rel_path", F.col("name").alias("description"))
    arrays = context.context_arrays(_near(spark, sf), known).where(F.size("context") > 0)
    return arrays.select("rel_path", F.array_join(F.transform("context", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["item"])), ",").alias("items"))


@query(
    f"""WITH RECURSIVE files AS (SELECT '/r/g' || event_id // 64 || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-' || user_id % 3 ELSE '/u' || user_id % 5 END || '/' || event_id || '.jpg' AS path, regexp_extract(path, '^(.*)/', 1) AS folder FROM events),
    every AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:l], '/') AS folder FROM files, range(2, 5) AS u(l) WHERE l <= len(string_split(folder, '/'))),
    folders AS (SELECT e.folder, coalesce(f.files, []) AS files, coalesce(d.dirs, []) AS dirs FROM every e LEFT JOIN (SELECT folder, list(path) AS files FROM files GROUP BY folder) f ON f.folder = e.folder
      LEFT JOIN (SELECT regexp_extract(folder, '^(.*)/', 1) AS folder, list(folder) AS dirs FROM every WHERE folder <> '/r' GROUP BY ALL) d ON d.folder = e.folder),
    walk AS (
      SELECT path, up, [folder] AS waiting, [folder] AS seen, 0 AS found, []::VARCHAR[] AS taken FROM files, (VALUES (true), (false)) AS u(up)
      UNION ALL SELECT path, up, list_concat(list_filter(waiting, lambda x: x <> folder), fresh), list_concat(seen, fresh), found + len(got), got FROM (
        SELECT w.*, f.folder, list_filter(f.files, lambda x: x <> path AND (x < path) = up) AS got,
          list_filter(list_concat(list_filter(f.dirs, lambda x: (x < path) = up), CASE WHEN f.folder = '/r' THEN [] ELSE [regexp_extract(f.folder, '^(.*)/', 1)] END), lambda x: NOT list_contains(seen, x)) AS fresh
        FROM walk w JOIN folders f ON f.folder = CASE WHEN up THEN list_max(waiting) ELSE list_min(waiting) END WHERE found < {2 * K}))
    SELECT path[4:] AS rel_path, unnest(taken)[4:] AS item, up FROM walk"""
)
def walk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Which files does a walk through the tree take before and after each file? One file for each event, some folders beside others that begin with their name."""
    n, user = F.col("event_id"), F.col("user_id")
    inner = F.when(user % 4 == 0, "").when(user % 4 == 1, F.concat(F.lit("-"), (user % 3).cast("string"))).otherwise(F.concat(F.lit("/u"), (user % 5).cast("string")))
    rel = F.concat(F.lit("g"), F.floor(n / 64).cast("string"), inner, F.lit("/"), n.cast("string"), F.lit(".jpg"))
    return walk.walk_candidates(_table(spark, sf, "events").select(rel.alias("rel_path")), 2 * K)


def _section_sql(texts: str, limit: int, length: int) -> str:
    item = f"i || '. ' || CASE WHEN length({texts}[i]) > {length} THEN left({texts}[i], {length}) || '...' ELSE {texts}[i] END || chr(10)"
    items = f"array_to_string(list_transform(range(1, least(len({texts}), {limit}) + 1), lambda i: {item}), '')"
    return f"CASE WHEN len({texts}) > 0 THEN {_template_sql(CONTEXT_TEMPLATE, {'items': items})} ELSE '' END"


@query(f"WITH c AS (SELECT conv_id, list(\"text\" ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, {_section_sql('t', 3, 80)} AS section FROM c")
def context_section(spark: SparkSession, sf: str) -> DataFrame:
    whole = _conversations(spark, sf)
    return whole.select("conv_id", context.context_section(F.col("texts"), CONTEXT_TEMPLATE, CONTEXT_ITEM, 3, 80).alias("section"))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"))


@query("SELECT doc_id, CASE WHEN length(\"text\") > 1000 THEN left(\"text\", 1000) || '...' ELSE \"text\" END AS short FROM documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 1000).alias("short"))


@query(
    f"""WITH n AS (SELECT conv_id, row_number() OVER w AS i, row_number() OVER w || '. ' || CASE WHEN length("text") > 200 THEN left("text", 200) || '...' ELSE "text" END || chr(10) AS item FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, sum(length(item)) OVER (PARTITION BY conv_id ORDER BY i) AS total FROM n WHERE i <= 30)
    SELECT conv_id, {_template_sql(CONTEXT_TEMPLATE, {'items': "string_agg(item, '' ORDER BY i) FILTER (WHERE total <= 600)"})} AS section FROM s GROUP BY conv_id"""
)
def budget_context(spark: SparkSession, sf: str) -> DataFrame:
    return _conversations(spark, sf).select("conv_id", context.context_section(F.col("texts"), CONTEXT_TEMPLATE, CONTEXT_ITEM, 30, 200, 600).alias("section"))


_CAMERA = "CASE WHEN event_id % 3 > 0 THEN 'Maker ' || event_id % 3 END"
_PLACE = "CASE WHEN event_id % 4 > 0 THEN 'Place ' || event_id % 4 END"


def _described(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(media(_table(spark, sf, "events")))


def _shown(items: DataFrame) -> DataFrame:
    n = F.col("event_id")
    camera = F.when(n % 3 > 0, geo.camera(F.lit(" Maker "), (n % 3).cast("string")))
    place = F.when(n % 4 > 0, F.concat(F.lit("Place "), (n % 4).cast("string")))
    return _dates(items).withColumns({"camera": camera, "place": place})


@query(f"""WITH {_DATED} SELECT event_id, {_template_sql(DESCRIBE_PROMPT, {'filename': 'name', 'datetime': _display_sql('dt_min'), 'location': _PLACE, 'camera': _CAMERA})} AS prompt FROM dated""")
def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _described(spark, sf).select("event_id", prompt.describe_prompt(DESCRIBE_PROMPT, c("dt_min"), c("place"), c("camera"), c("name")).alias("prompt"))


@query(f"""SELECT doc_id, {_template_sql(ENHANCE_PROMPT, {'context_section': "''", 'original_description': '"text"'})} AS prompt FROM documents""")
def enhance_prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", prompt.enhance_prompt(ENHANCE_PROMPT, F.lit(""), F.col("text")).alias("prompt"))


_OUTPUT = _template_sql(DESCRIBE_OUTPUT, {"filename": "name", "datetime": f"coalesce({_display_sql('dt_min')}, 'Unknown')", "location": f"coalesce({_PLACE}, 'Unknown')", "camera": f"coalesce({_CAMERA}, 'Unknown')", "content": "'value ' || event_type"})


@query(f"WITH {_DATED} SELECT event_id, {_OUTPUT} AS body FROM dated")
def output_render(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    body = prompt.output_text(DESCRIBE_OUTPUT, F.concat(F.lit("value "), c("event_type")), c("dt_min"), c("place"), c("camera"), c("name"))
    return _described(spark, sf).select("event_id", body.alias("body"))


@query(
    """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS content FROM (
    SELECT conv_id, turn, '<think>a' || chr(10) || 'b</think> ' || chr(10) || "text" || chr(10) || '<think>' || role || '</think>' || CASE WHEN turn % 2 = 0 THEN '<think>open' ELSE '  ' END AS raw FROM conversations)"""
)
def clean_think(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    raw = F.concat(F.lit("<think>a\nb</think> \n"), c("text"), F.lit("\n<think>"), c("role"), F.lit("</think>"), F.when(c("turn") % 2 == 0, "<think>open").otherwise("  "))
    return _table(spark, sf, "conversations").select("conv_id", "turn", text.clean_reply(raw).alias("content"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN "text" ELSE regexp_replace(regexp_replace("text", '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') END AS content FROM documents"""
)
def marker_extract(spark: SparkSession, sf: str) -> DataFrame:
    c, kind = F.col, F.col("doc_id") % 3
    whole = F.when(kind == 0, F.concat(F.lit("Beschrijving: x\nVerbeterde beschrijving:\n"), c("text"))).when(kind == 1, F.concat(F.lit("Locatie: y\nBeschrijving: "), c("text"), F.lit(" \n"))).otherwise(c("text"))
    return _table(spark, sf, "documents").select("doc_id", text.after_marker(whole).alias("content"))


@query(
    """SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN -v ELSE v END, 9) AS degrees
    FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE AS v FROM customer)"""
)
def gps_dms(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    ref = F.when(key % 5 == 0, F.lit(None)).when(key % 2 == 0, "S").otherwise("N")
    degrees = geo.decimal_degrees(F.col("c_nationkey").cast("double"), (key % 60).cast("double"), (key % 59).cast("double"), ref)
    return _table(spark, sf, "customer").select("c_custkey", F.round(degrees, 9).alias("degrees"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 90) || '.5, ' || n_nationkey || '.25' ||
    CASE c_custkey % 3 WHEN 0 THEN ' | ' || n_name || ', ' || r_name ELSE '' END END AS place
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def location_string(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _table(spark, sf, "customer").join(_table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).join(_table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    where = F.when(c("c_custkey") % 7 > 0, F.concat((c("c_custkey") % 90).cast("string"), F.lit(".5, "), c("n_nationkey").cast("string"), F.lit(".25")))
    address = F.when(c("c_custkey") % 3 == 0, F.concat_ws(", ", "n_name", "r_name")).when(c("c_custkey") % 3 == 1, geo.NO_ADDRESS).otherwise("")
    return rows.select("c_custkey", geo.location_string(where, address).alias("place"))


@query(
    """SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' | amenity: ' || n_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', shop: ' || s_nationkey END END AS address
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def poi_format(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _table(spark, sf, "supplier").join(_table(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey"))
    part = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    shop = F.when(c("s_suppkey") % 3 == 0, F.lit("")).otherwise(c("s_nationkey").cast("string"))
    parts = F.array(part("road", c("s_name")), part("amenity", c("n_name")), part("country", c("n_name")), part("shop", shop), part("postcode", c("s_name")))
    parts = F.when(c("s_suppkey") % 4 == 0, F.slice(parts, 1, 1)).otherwise(parts)
    return rows.select("s_suppkey", geo.full_address(c("s_name"), parts).alias("address"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0s' ELSE '1/' || CAST(floor(1 / (1 / (l_quantity + 0.5))) AS BIGINT) || 's' END AS shutter,
    'ISO ' || 100 * l_linenumber AS iso, 'f/' || CAST(l_quantity AS INTEGER) || '.0' AS aperture FROM lineitem"""
)
def exposure_format(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    seconds = F.when(c("l_linenumber") % 2 == 0, c("l_quantity")).otherwise(1 / (c("l_quantity") + 0.5))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geo.shutter(seconds).alias("shutter"), geo.iso(100 * c("l_linenumber")).alias("iso"), geo.aperture(c("l_quantity")).alias("aperture"))


@query(
    """SELECT l_orderkey, l_linenumber, printf('%.0f', v) AS none, printf('%.1f', v) AS one, printf('%.6f', v) AS six FROM (
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice / 8 - 4000 WHEN 1 THEN l_quantity / 20 - 1 ELSE l_extendedprice * l_tax / l_quantity END AS v FROM lineitem)"""
)
def fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as text with decimals, many of them ties or next to one."""
    c = F.col
    kind = c("l_linenumber") % 3
    v = F.when(kind == 0, c("l_extendedprice") / 8 - 4000).when(kind == 1, c("l_quantity") / 20 - 1).otherwise(c("l_extendedprice") * c("l_tax") / c("l_quantity"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(geo.fixed_point(v, n).alias(name) for name, n in (("none", 0), ("one", 1), ("six", 6))))


_PROPS = "json_extract_string(props, '$.\"' || k || '\"')"


@query(
    f"""SELECT event_id, string_agg(k || ': ' || coalesce({_PROPS}, 'null'), ', ' ORDER BY i) AS entries
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k, generate_subscripts(json_keys(props), 1) AS i FROM events) GROUP BY event_id"""
)
def json_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of a JSON object in their order."""
    entries = F.transform(geo.object_entries(F.col("props")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return _table(spark, sf, "events").select("event_id", F.array_join(entries, ", ").alias("entries")).where("entries <> ''")


@query(
    """SELECT c_custkey, 'Street ' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' | shop: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', "é": ' || c_mktsegment END END AS address FROM customer WHERE c_custkey % 5 > 0"""
)
def geocoder_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses and points of interest from a geocoder's JSON replies."""
    n, text = F.col("c_custkey"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    last = F.when(n % 3 == 0, F.lit('"\\"é\\"": ""')).otherwise(text('"\\"\\u00e9\\"": "', F.col("c_mktsegment"), '"'))
    more = F.when(n % 4 == 0, F.lit('"office": 0')).otherwise(text('"shop": "', F.col("c_name"), '", ', last))
    found = text('{"place_id": 1, "address": {"road": "x", ', more, ', "postcode": "1"}, "display_name": "Street ', n, '"}')
    place = geo.decoded_place(F.when(n % 5 > 0, found).otherwise('{"error": "Unable to geocode"}'))
    rows = _table(spark, sf, "customer").select("c_custkey", place.alias("p"))
    return rows.select("c_custkey", geo.full_address(F.col("p.line"), F.col("p.parts")).alias("address")).where("address is not null")


@query(
    """SELECT 'result' AS kind, event_id, event_type AS body FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'error', event_id, 'failed: ' || user_id FROM events WHERE event_type = 'error'"""
)
def error_split(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _table(spark, sf, "events").select("event_id", c("event_id").cast("string").alias("rel_path"), "event_type", F.when(c("event_type") == "error", F.concat(F.lit("failed: "), c("user_id").cast("string"))).alias("error"))
    good, bad = lookup.split_outcomes(rows)
    return good.select(F.lit("result").alias("kind"), "event_id", c("event_type").alias("body")).unionAll(bad.select(F.lit("error"), c("rel_path").cast("long"), "error"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    outcome = F.when(c("event_type") == "error", stats.FAILED).when(c("event_type") == "view", stats.REJECTED).otherwise(stats.DONE)
    return _table(spark, sf, "events").select((c("user_id") % 10).alias("stage"), outcome.alias("outcome"), F.when(c("event_type") == "signup", c("event_id") % 3).otherwise(1).alias("output_count"))


_STATS = """o AS (SELECT user_id % 10 AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'rejected' ELSE 'done' END AS outcome, CASE WHEN event_type = 'signup' THEN event_id % 3 ELSE 1 END AS n FROM events),
s AS (SELECT stage, count(*) AS "input", count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'rejected') AS rejected,
CAST(coalesce(sum(n) FILTER (outcome = 'done'), 0) AS BIGINT) AS "output", coalesce(bool_or(outcome = 'done' AND n <> 1), false) AS diff FROM o GROUP BY stage)"""


@query(f"WITH {_STATS} SELECT * FROM s")
def stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stage_stats(_outcomes(spark, sf), "stage")


@query(
    f"""WITH {_STATS} SELECT stage, CASE WHEN diff THEN "input" || '>' ELSE '' END || CASE WHEN failed > 0 THEN failed || 'F' ELSE '' END || CASE WHEN rejected > 0 THEN rejected || 'R' ELSE '' END || "output" || 'D' AS line FROM s"""
)
def stats_line(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return stats.stage_stats(_outcomes(spark, sf), "stage").select("stage", stats.stats_line(c("input"), c("output"), c("failed"), c("rejected"), c("diff")).alias("line"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, string_split("text", chr(10))[i] AS child FROM documents, unnest(range(1, len(string_split("text", chr(10))) + 1)) AS u(i)""")
def fanout_children(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "child"))


@query(
    """SELECT 'docs/' || coalesce(l.doc_id, d.doc_id) || '.jpg' AS rel_path, CASE WHEN l.doc_id IS NOT NULL THEN 'new ' || l.quality ELSE 'old ' || d.lang END AS body
    FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id"""
)
def upsert_outputs(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    old = _table(spark, sf, "documents").select(_item(c("doc_id")).alias("rel_path"), F.concat(F.lit("old "), c("lang")).alias("body"))
    new = _table(spark, sf, "labels").select(_item(c("doc_id")).alias("rel_path"), F.concat(F.lit("new "), c("quality").cast("string")).alias("body"))
    return lookup.upsert(old, new)


@query("""SELECT doc_id, '{x}' || "text" || ' {} ' || lang AS filled, 'Hello {name}' AS verbatim FROM documents""")
def template_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    good = fill("{{x}}{text} {{}} {lang}", {"text": c("text"), "lang": c("lang")})
    return _table(spark, sf, "documents").select("doc_id", good.alias("filled"), fill("Hello {name}", {}).alias("verbatim"))


@query(
    f"""WITH {_DATED} SELECT rel_path, dt_min, dt_max, '/out/' || rel_path || '.txt' AS output_path, {_OUTPUT} AS body FROM dated d
    WHERE lower({_EXT.format('name')}) IN {EXTENSIONS} AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.event_id)"""
)
def flagship_pending_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Which images are not yet described, when were they taken, and what is stored for them?"""
    c = F.col
    items = media(_table(spark, sf, "events")).where(paths.has_extension(c("name"), EXTENSIONS))
    done = items.join(_table(spark, sf, "labels"), c("event_id") == c("doc_id"), "left_semi").select("rel_path")
    items = _shown(lookup.pending(items, done, done.where("false")))
    body = prompt.output_text(DESCRIBE_OUTPUT, F.concat(F.lit("value "), c("event_type")), c("dt_min"), c("place"), c("camera"), c("name"))
    return items.select("rel_path", "dt_min", "dt_max", paths.output_path("/out", c("rel_path"), ".txt").alias("output_path"), body.alias("body"))
