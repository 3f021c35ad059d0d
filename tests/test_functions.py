"""Column functions against expectations worked out by hand."""

import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from photonflow.functions import datetimes, geo, naturalsort, paths, stats, template, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


NAMES = ["a.jpg", ".jpg", "a.tar.gz", "a.", "..jpg", "a..b", "...", "X.JPG", "_x.jpg", "é 1%20#.png", "", "noext", ".h.jpg"]


def test_paths_agree_with_the_library(spark):
    assert column(spark, NAMES, paths.extension) == [os.path.splitext(n)[1] for n in NAMES]
    assert column(spark, NAMES, paths.stem) == [os.path.splitext(n)[0] for n in NAMES]
    full = ["/a/b/c.jpg", "/c.jpg", "c.jpg", "a/b/", "/a//b"]
    assert column(spark, full, paths.basename) == [os.path.basename(p) for p in full]
    assert column(spark, full, paths.dirname) == [os.path.dirname(p) for p in full]
    assert column(spark, ["/in/a/b.jpg", "/else/b.jpg"], lambda c: paths.relative(c, "/in/")) == ["a/b.jpg", "b.jpg"]
    assert column(spark, ["a/b.c.jpg", "a.b/c"], paths.fixed_variant) == ["a/b.c.fixed.jpg", "a.b/c.fixed"]


def test_two_extension_filters_differ_on_a_bare_suffix(spark):
    assert column(spark, [".jpg", "x.JPG", "x.txt"], lambda c: paths.has_extension(c, (".jpg",))) == [False, True, False]
    assert column(spark, [".jpg", "x.JPG", "x.txt"], lambda c: paths.ends_with_extension(c, (".jpg",))) == [True, True, False]


def test_path_datetime(spark):
    day = lambda y, m, d: (datetime(y, m, d), datetime(y, m, d, 23, 59, 59))
    exact = lambda *a: (datetime(*a), datetime(*a))
    cases = {
        "/p/20191114_122944.jpg": exact(2019, 11, 14, 12, 29, 44), "/p/20191114122944.jpg": exact(2019, 11, 14, 12, 29, 44), "/p/IMG-20191114-WA0001.jpg": day(2019, 11, 14),
        "/p/20191114.jpg": day(2019, 11, 14), "/p/2022/2022-01/2022-01-03/x.jpg": day(2022, 1, 3), "/p/20220103/x.jpg": day(2022, 1, 3), "/p/2019-11-14.jpg": None,
        "/p/20230230_101010.jpg": None, "/p/20191114_252944.jpg": day(2019, 11, 14), "/p/plain.jpg": None, "/20200101/20210101/x.jpg": day(2021, 1, 1), "x": None, "": None,
        "/p/00000101_101010.jpg": None, "/2020-01-01/20230230/x.jpg": day(2020, 1, 1),
    }
    got = column(spark, list(cases), datetimes.path_datetime)
    assert [(g["min"], g["max"]) if g else None for g in got] == list(cases.values())


def test_tag_datetime_display_and_distance(spark):
    tags = ["2020:01:02 03:04:05", "2020:13:02 03:04:05", "x", None]
    assert column(spark, tags, datetimes.tag_datetime)[0] == datetime(2020, 1, 2, 3, 4, 5)
    assert column(spark, tags, datetimes.tag_datetime)[1:] == [None] * 3
    times = [datetime(2020, 1, 2), datetime(2020, 1, 2, 0, 0, 1), None]
    assert column(spark, times, datetimes.display, "timestamp_ntz") == ["2020-01-02", "2020-01-02 00:00:01", None]
    a, b = datetime(2020, 1, 1), datetime(2020, 1, 1, 23, 59, 59)
    row = spark.createDataFrame([(a, b, datetime(2020, 1, 2), datetime(2020, 1, 3))], "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz")
    s = row.select(datetimes.proximity(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).first()["s"]
    assert (s["score_min"], s["score_max"]) == (1.0, 2 * 86400.0)


def test_natural_order_is_that_of_split_digits(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("aB1 20_.9é") for _ in range(rng.randrange(9))) for _ in range(400)]
    key = lambda s: [int(t) if t.isdigit() else t.lower() for t in re.split(r"(\d+)", s)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(naturalsort.natural_key(F.col("n")), "n").collect()
    assert [key(r["n"]) for r in rows] == sorted(map(key, names))


@pytest.mark.parametrize("order,expected", [("natural-asc", ["a2", "A10", "b1"]), ("natural-desc", ["b1", "A10", "a2"]), ("name-asc", ["A10", "a2", "b1"]), ("name-desc", ["b1", "a2", "A10"]), ("other", ["A10", "a2", "b1"])])
def test_sort_orders(spark, order, expected):
    rows = spark.createDataFrame([("b1",), ("A10",), ("a2",)], "n string").orderBy(naturalsort.order_key(F.col("n"), order))
    assert [r["n"] for r in rows.collect()] == expected


def test_strip_truncate_and_clean(spark):
    assert column(spark, [" \t\n 　x y\x1c\x1f\x85 ", "", " ", None], text.strip) == ["x y", "", "", None]
    assert column(spark, ["abc", "abcd", "äöüß"], lambda c: text.truncate(c, 3)) == ["abc", "abc...", "äöü..."]
    replies = ["<think>a</think> b ", "<think>a\nb</think>x<think>c</think>y", "<think>open", "<think>only</think>", "", None]
    assert column(spark, replies, text.clean_reply) == ["b", "xy", "<think>open", "", "", None]
    marked = ["a Beschrijving: b", "Beschrijving: a Verbeterde beschrijving: c", "plain ", "Beschrijving: ", "", None]
    assert column(spark, marked, text.after_marker) == ["b", "c", "plain ", None, None, None]


def test_templates(spark):
    fill = lambda t, **v: spark.range(1).select(template.fill(t, {k: F.lit(x) for k, x in v.items()}).alias("x")).first()["x"]
    assert fill("{a}-{{b}}-{a}", a="{a}") == "{a}-{b}-{a}"
    assert fill("x{missing}", a="1") == "x{missing}"
    assert fill("{", a="1") == "{"
    assert fill("{0}", a="1") == "{0}"
    assert fill("{a}", a=None) == ""
    assert fill("") == ""
    out = lambda t: spark.range(1).select(template.fill_output(t, {"content": F.lit("c")}).alias("x")).first()["x"]
    assert out("[{content}]") == "[c]" and out("{content}{nope}") == "c"
    with pytest.raises(template.TemplateError):
        out("{content.upper}")


def test_geo(spark):
    assert column(spark, [0.008, 0.5, 1.0, 2.0, 0.0, None], geo.shutter, "double") == ["1/125s", "1/2s", "1.0s", "2.0s", None, None]
    degrees = lambda r: spark.range(1).select(geo.decimal_degrees(F.lit(52.0), F.lit(30.0), F.lit(36.0), F.lit(r)).alias("x")).first()["x"]
    assert degrees("N") == pytest.approx(52.51) and degrees("W") == pytest.approx(-52.51) and degrees("") is None and degrees(None) is None
    rows = spark.createDataFrame([("1, 2", "a"), ("1, 2", "N/A"), ("1, 2", None), (None, "a"), ("1, 2", "")], "c string, a string").select(geo.location_string(F.col("c"), F.col("a")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["1, 2 | a", "1, 2", "1, 2", None, "1, 2"]
    cases = [("A", []), ("A", [("road", "r"), ("country", "c")]), ("A", [("amenity", "x"), ("road", "r"), ("shop", "y"), ("office", "")]), (None, [("amenity", "x")])]
    rows = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(cases)], "i int, a string, p array<struct<key:string,value:string>>")
    got = rows.select("i", geo.full_address(F.col("a"), F.col("p")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == ["A", "A", "A | amenity: x, shop: y", None]
    assert column(spark, [None, "", "a"], geo.written_address) == ["N/A", "N/A", "a"]
    names = spark.createDataFrame([(" Canon ", "X1"), ("", "X1"), ("Canon", None), (" ", "")], "a string, b string").select(geo.camera(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in names] == ["Canon X1", "X1", "Canon", None]


def test_stats(spark):
    events = [("a", "done", 1), ("a", "done", 3), ("a", "failed", 0), ("b", "done", 1), ("b", "rejected", 0), ("c", "failed", 0), ("d", "done", 0)]
    rows = stats.stage_stats(spark.createDataFrame(events, "s string, outcome string, output_count int"), "s")
    c = F.col
    lines = rows.select("s", stats.stats_line(c("input"), c("output"), c("failed"), c("rejected"), c("diff")).alias("x"))
    assert {r["s"]: r["x"] for r in lines.collect()} == {"a": "3>1F4D", "b": "1R1D", "c": "1F0D", "d": "1>0D"}


def test_fixed_point_is_that_of_the_exact_binary_value(spark):
    rng = random.Random(1)
    some = lambda: rng.choice([rng.uniform(0, 10), rng.uniform(-200, 200), 10 ** rng.uniform(-12, 18), rng.randrange(10**6) / 64, rng.randrange(400) / 8 - 20, rng.randrange(10**4) / 100])
    values = [some() for _ in range(100_000)] + [k + t / 20 for k in range(-30, 30) for t in range(20)] + [0.0, -0.0, 5e-324, 0.95, 99.95, 9.2e18, float("inf"), float("-inf"), float("nan")]
    for places in (0, 1, 6):
        assert column(spark, values, lambda c: geo.fixed_point(c, places), "double") == [f"{v:.{places}f}" for v in values]  # noqa: B023
    assert column(spark, [None, 2.0**63], lambda c: geo.fixed_point(c, 1), "double") == [None, None]


def test_json_objects_keep_their_order(spark):
    texts = ['{"b":"x\\"y \\u00e9","a":1,"n":null,"t":true,"o":{"k": [1]},"b":"last"}', "{}", "[1]", "no", None]
    got = [None if x is None else [tuple(e) for e in x] for x in column(spark, texts, geo.object_entries)]
    assert got == [[("b", "last"), ("a", "1"), ("n", None), ("t", "true"), ("o", '{"k":[1]}')], [], None, None, None]
    replies = ['{"display_name":"A","address":{"shop":"s","z":0,"f":false,"e":""}}', '{"display_name":"A"}', '{"error":"x"}', "no", None]
    assert column(spark, replies, lambda c: geo.full_address(geo.decoded_place(c)["line"], geo.decoded_place(c)["parts"])) == ["A | shop: s", "A", None, None, None]
