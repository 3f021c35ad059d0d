"""Operators and pipelines over small tables and a tree on disk."""

import os
import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from photonflow import cli
from photonflow.config import load_config
from photonflow.media.jpeg import SIGNATURE
from photonflow.operators import context, infer, lookup, sink, walk
from photonflow.operators.walk import walk_candidates
from photonflow.plans.pipelines import Services, get_pipeline, list_pipelines, run_pipeline
from photonflow.schema import ERRORS, HEADS, IMAGES, OUTPUT
from photonflow.services.geocoder import FakeGeocoder, TransientError, with_retries
from photonflow.services.model import FakeModel
from photonflow.sources.image_tree import Folder, Pack, TreeReader, images_and_errors, read_tree
from photonflow.streaming.incremental import follow_tree
from tests.test_media import jpeg, sample, tiff  # noqa: F401


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "in"
    for name in ("2022/2022-01-03/_x.jpg", "2022/2022-01-03/.h.jpg", "2022/2022-01-04/20220104_101010.JPG", "a.tar.gz", "n.txt", "é 1%20#.png", "geo/g.jpg"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(sample() if name.startswith("geo") else b"x")
    (root / "empty").mkdir()
    return root


def rels(df):
    return sorted(r["rel_path"] for r in df.select("rel_path").collect())


def test_scan(spark, tree):
    files, problems = images_and_errors(read_tree(spark, str(tree), (".jpg", ".png")))
    assert rels(files) == sorted(["2022/2022-01-03/_x.jpg", "2022/2022-01-03/.h.jpg", "2022/2022-01-04/20220104_101010.JPG", "geo/g.jpg", "é 1%20#.png"])
    assert problems.count() == 0
    assert len(rels(read_tree(spark, str(tree)))) == 7
    row = files.where("name = '20220104_101010.JPG'").first()
    assert (row["base"], row["ext"], row["size"]) == ("20220104_101010", ".JPG", 1) and row["path"] == str(tree / "2022/2022-01-04/20220104_101010.JPG")
    _, problems = images_and_errors(read_tree(spark, str(tree / "n.txt")))
    assert problems.first()["error"] == "not a directory"


@pytest.mark.parametrize("deep", [1, 2, 64])
def test_scan_does_not_depend_on_the_split(spark, tree, deep):
    os.symlink(tree, tree / "empty" / "loop")
    rows = spark.read.format("image_tree").option("path", str(tree)).option("target", deep).load()
    assert len(rels(rows)) == 7


def test_scan_of_wide_and_flat_trees(spark, tmp_path):
    root = tmp_path / "wide"
    for i in range(300):
        (root / f"d{i:03d}").mkdir(parents=True)
        (root / f"d{i:03d}" / "x.jpg").write_bytes(b"x")
    for i in range(500):
        (root / f"{i:03d}.jpg").write_bytes(b"y")
    options = {"path": str(root), "partitions": "20", "flat": "100"}
    parts = TreeReader(options).partitions()
    folders = [f for p in parts for f in p.folders]
    assert len(parts) == 20 and [f.shares for f in folders if not f.rel] == [8] * 8 and len(folders) == 308
    assert max(len(p.folders) for p in parts) - min(len(p.folders) for p in parts) <= 1
    batches = list(TreeReader({"path": str(root)}).read(Pack((Folder("", False),))))
    assert sum(b.num_rows for b in batches) == 500
    rows = spark.read.format("image_tree").options(**options).load()
    assert len(rels(rows)) == len(set(rels(rows))) == 800
    assert rels(spark.read.format("image_tree").option("path", f"file://{root}").load()) == rels(rows)


def test_scan_through_a_scheme(spark, tree):
    plain, remote = (read_tree(spark, r, (".jpg", ".png")) for r in (str(tree), f"file://{tree}"))
    columns = ["rel_path", "name", "base", "ext", "size", "error"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, remote.select(columns).collect()))
    odd = remote.where("name like '%#%'").first()
    assert odd["path"].endswith("/%C3%A9%201%2520%23.png")
    asked = infer.ask_model(remote.select("rel_path", "path", F.lit("p").alias("prompt")), FakeModel, "m", 2, image="path")
    assert asked.where("error is not null").count() == 0
    assert read_tree(spark, f"file://{tree}/n.txt").first()["error"] == "not a directory"


def test_stream_of_a_tree(spark, tree, tmp_path):
    store, cp = f"file://{tmp_path}/store", f"{tmp_path}/cp"
    c = load_config(input_dir=str(tree), output_dir=str(tmp_path / "out"), model="m")
    follow = lambda: follow_tree(spark, "describe", c, store, cp, settle=0.0)
    tables = sink.Store(spark, store)
    assert follow() == "describe: 5D" and follow() == "describe: 0D"
    first = held(tables, "describe")
    (tree / "new.jpg").write_bytes(b"n")
    (tree / "geo/g.jpg").write_bytes(sample() + b"more")
    assert follow() == "describe: 2D" and follow() == "describe: 0D"  # the new and the changed one, once each
    second = held(tables, "describe")
    assert set(second) - set(first) == {"new.jpg"} and [k for k in first if first[k] != second[k]] == ["geo/g.jpg"]
    assert tables.read("listing", IMAGES).count() == 6
    tables.drop("describe", spark.createDataFrame([("new.jpg",)], "rel_path string"), OUTPUT)
    assert follow() == "describe: 1D"  # an output that was deleted


def test_skip_matrix(spark):
    for retry, retry_failed, compat in product((False, True), repeat=3):
        items = spark.createDataFrame([("n",), ("o",), ("e",), ("b",)], "rel_path string")
        done, failed = items.where("rel_path in ('o', 'b')"), items.where("rel_path in ('e', 'b')")
        got = rels(lookup.pending(items, done, failed, retry, retry_failed, compat))
        assert got == (["b", "e", "n", "o"] if retry else ["e", "n"] if retry_failed or compat else ["n"])
        reason = items.select("rel_path", lookup.skip_reason(F.col("rel_path").isin("o", "b"), F.col("rel_path").isin("e", "b"), retry, retry_failed).alias("r"))
        kept = rels(reason.where("r is null"))
        assert kept == (["b", "e", "n", "o"] if retry else ["e", "n"] if retry_failed else ["n"])


def brute_nearest(items, k):
    out, order = set(), sorted(items)
    for i, t in enumerate(order):
        near = []
        for j in range(max(0, i - 2 * k), min(len(order), i + 2 * k + 1)):
            c = order[j]
            if j != i and items[t] and items[c]:
                near.append((abs((items[t][0] - items[c][1]).total_seconds()), c))
        out |= {(t, c, n + 1) for n, (_, c) in enumerate(sorted(near)[:k])}
    return out


def test_context_topk_against_brute_force(spark):
    base = datetime(2020, 1, 1)
    items = {f"d{i % 7}/{i * 37 % 101:03d}.jpg": None if i % 11 == 0 else (base + timedelta(seconds=i * 977 % 5000), base + timedelta(seconds=i * 977 % 5000 + (86399 if i % 3 else 0))) for i in range(150)}
    rows = spark.createDataFrame([(k, *(v or (None, None))) for k, v in items.items()], "rel_path string, datetime_min timestamp_ntz, datetime_max timestamp_ntz")
    got = {(r["rel_path"], r["item"], r["place"]) for r in context.nearest(rows, 4).collect()}
    assert got == brute_nearest(items, 4)
    close = context.nearest(rows, 4, window_days=0)
    assert close.where("score_max > 0").count() == 0
    assert context.nearest(rows.limit(0), 4).count() == 0


def test_context_arrays_and_compat(spark):
    near = spark.createDataFrame([("t", "a", 0.0, 0.0, 2), ("t", "b", 0.0, 0.0, 1), ("t", "c", 0.0, 0.0, 3)], "rel_path string, item string, score_min double, score_max double, place int")
    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "rel_path string, description string")
    assert [x["description"] for x in context.context_arrays(near, texts).first()["context"]] == ["B", "A"]
    assert context.context_arrays(near, texts, compat=True).first()["context"] == []


def slow_walk(paths, target, enough, up):
    """What a walk takes that lists a directory at a time."""
    folders = {}
    for here in paths:
        while here:
            folders.setdefault(here.rpartition("/")[0], set()).add(here)
            here = here.rpartition("/")[0]
    full = lambda p: f"/r/{p}" if p else "/r"
    start = target.rpartition("/")[0]
    waiting, seen, found = {start}, {start}, set()
    while waiting and len(found) < enough:
        here = (max if up else min)(waiting, key=full)
        waiting.remove(here)
        entries = {e for e in folders[here] if e != target and (full(e) < full(target)) == up}
        found |= entries - set(folders)
        heard = (entries & set(folders) | ({here.rpartition("/")[0]} if here else set())) - seen
        waiting |= heard
        seen |= heard
    return found


@pytest.mark.parametrize("seed, n, enough", [(1, 70, 4), (2, 150, 12), (3, 40, 1000)])
def test_walk_against_listing_directories(spark, seed, n, enough):
    rng, paths = random.Random(seed), set()
    names = ["a", "a-1", "a b", "ab", "b", "a.d", "B", "é", "2022", "2022-01", "-x", "~"]  # some continue others with characters below the separator
    while len(paths) < n:
        paths.add("/".join([rng.choice(names) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4]))] + [rng.choice(names) + rng.choice(["", "-2", " ", "0"]) + ".jpg"]))
    some = sorted(paths)[:: 1 if enough > 4 else 3]
    items = spark.createDataFrame([(p,) for p in [*paths, some[0], None]], "rel_path string")
    got = [tuple(r) for r in walk_candidates(items, enough, items.where(F.col("rel_path").isin(some))).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, i, up) for t in some for up in (True, False) for i in slow_walk(paths, t, enough, up)}


def test_walk_sorts_files_of_flat_folders_once(spark, monkeypatch):
    paths = [f"{d}/{i:02d}.jpg" for d in ("a", "a-1", "b/c") for i in range(30)] + ["b/x.jpg"]
    sizes, before = {}, walk.before
    monkeypatch.setattr(walk, "before", lambda rows, key, **w: sizes.update(dict.fromkeys(w, rows.count())) or before(rows, key, **w))
    got = {tuple(r) for r in walk_candidates(spark.createDataFrame([(p,) for p in paths], "rel_path string"), 40).collect()}
    assert got == {(t, i, up) for t in paths for up in (True, False) for i in slow_walk(paths, t, 40, up)}
    assert sizes["own_place"] >= len(paths) and max(sizes[n] for n in ("all_before", "preorder", "by_path")) < 20


def test_walk_for_context(spark):
    base = datetime(2020, 1, 1)
    items = [(p, base + timedelta(hours=h), base + timedelta(hours=h)) for p, h in (("a/1.jpg", 1), ("a/2.jpg", 9), ("b/1.jpg", 3), ("b/2.jpg", 4), ("b/3.jpg", 30), ("c/1.jpg", 4), ("z.jpg", 5))] + [("b/4.jpg", None, None)]
    rows = spark.createDataFrame(items, "rel_path string, datetime_min timestamp_ntz, datetime_max timestamp_ntz")
    near = context.nearest(rows, 1, targets=rows.where("rel_path = 'b/2.jpg'"), walk=True)
    assert [(r["item"], r["place"]) for r in near.collect()] == [("b/1.jpg", 1)]  # down it takes b/3 and b/4, and so has enough without c/1
    assert context.nearest(rows.limit(0), 1, walk=True).count() == 0


def test_context_section(spark):
    make = lambda texts, **o: spark.createDataFrame([(texts,)], "t array<string>").select(context.context_section(F.col("t"), "<{items}>", "{number}:{description};", 3, 4, **o).alias("x")).first()["x"]
    assert make(["abcdef", "{items}", "c", "d"]) == "<1:abcd...;2:{ite...;3:c;>"
    assert make([]) == "" and make(["a"], compat=True) == "<>"
    assert make(["aaa", "bbb", "c"], budget=12) == "<1:aaa;2:bbb;>" and make(["aaaa", "bbbb", "c"], budget=10) == "<1:aaaa;>"


def test_retries():
    waits = []
    client = FakeGeocoder(failures=2)
    assert with_retries(lambda: client.reverse(1.0, 2.0), sleep=waits.append)[0] == "Street 1, Town 2" and waits == [2, 4]
    waits.clear()
    with pytest.raises(TransientError):
        with_retries(lambda: FakeGeocoder(failures=9).reverse(1.0, 2.0), sleep=waits.append)
    assert waits == [2, 4, 8, 16]
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], sleep=waits.append)


def test_model_errors_become_rows(spark):
    rows = spark.createDataFrame([("a", "fine"), ("b", "bad one"), ("c", "fine too")], "rel_path string, prompt string")
    got = {r["rel_path"]: (r["content"], r["error"]) for r in infer.ask_model(rows, lambda: FakeModel("bad"), "m", 2).collect()}
    assert got["b"] == (None, "RuntimeError: model refused") and got["a"][0].startswith("reply ") and got["c"][1] is None


def held(store, table="t", schema=OUTPUT):
    return {r[0]: r[1] for r in store.read(table, schema).collect()}


def test_store_latest_wins(spark, tmp_path):
    store = sink.Store(spark, f"file://{tmp_path}/store", buckets=4)
    assert held(store) == {}
    store.put("t", spark.createDataFrame([("a", "1"), ("b", "2"), (None, "x")], OUTPUT))
    store.put("t", spark.createDataFrame([("b", "3"), ("b", "3"), ("c", None)], OUTPUT))
    assert held(store) == {"a": "1", "b": "3", "c": None}
    store.drop("t", spark.createDataFrame([("a",), ("z",)], "rel_path string"), OUTPUT)
    assert held(store) == {"b": "3", "c": None}
    store.put("t", spark.createDataFrame([("a", "4")], OUTPUT))
    for b in range(4):
        store.compact("t", b)
    assert held(store) == {"a": "4", "b": "3", "c": None} and held(sink.Store(spark, f"file://{tmp_path}/store")) == held(store)


def test_store_writes_what_changes_and_merges_a_bucket_at_a_time(spark, tmp_path, monkeypatch):
    size = lambda: {f: f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet")}
    store = sink.Store(spark, f"file://{tmp_path}/store", buckets=4)
    store.put("t", spark.range(20_000).selectExpr("concat('p', id) as rel_path", "sha2(cast(id as string), 512) as text"))
    whole = size()
    store.put("t", spark.range(200).selectExpr("concat('p', id) as rel_path", "sha2(concat('new', id), 512) as text"))
    assert sum(n for f, n in size().items() if f not in whole) < 0.05 * sum(whole.values())
    monkeypatch.setattr(sink, "SEGMENTS", 2)
    store.put("t", spark.createDataFrame([("p5", "x"), ("p6", "y")], OUTPUT))
    parts = [b for _, b in store._state()[1]["live"]["t"]]
    assert sorted(parts.count(b) for b in range(4))[0] == 1 and store.read("t").count() == 20_000  # one bucket is merged
    assert store.read("t").where("rel_path in ('p5', 'p6')").select("text").distinct().count() == 2


def test_store_survives_a_run_that_dies_at_any_step(spark, tmp_path, monkeypatch):
    store = sink.Store(spark, f"file://{tmp_path}/store", buckets=2)
    store.put("t", spark.createDataFrame([("a", "1")], OUTPUT))
    store.put("t_errors", spark.createDataFrame([("b", "bad")], ERRORS), ERRORS)
    good, bad = spark.createDataFrame([("b", "2")], OUTPUT), spark.createDataFrame([("a", "worse")], ERRORS)
    change = {"t": (good, bad, OUTPUT), "t_errors": (bad, good, ERRORS)}
    before, after = ({"a": "1"}, {"b": "bad"}), ({"b": "2"}, {"a": "worse"})
    both = lambda: (held(store), held(store, "t_errors", ERRORS))

    def died(*_):
        raise KeyboardInterrupt

    write = sink.Store._write
    for step in ("first table", "second table", "log"):
        with monkeypatch.context() as m:
            if step == "first table":
                m.setattr(sink.Store, "_write", died)
            elif step == "second table":
                m.setattr(sink.Store, "_write", lambda self, table, *a: write(self, table, *a) if table == "t" else died())
            else:
                m.setattr(sink.Store, "_save", died)
            with pytest.raises(KeyboardInterrupt):
                store.commit(change)
        assert both() == before
    (tmp_path / "store/log/000000000003").write_text('{"live": {"t"')  # died while writing the log
    assert both() == before
    store.commit(change)
    assert both() == after
    with monkeypatch.context() as m:
        m.setattr(sink.Store, "_save", died)
        with pytest.raises(KeyboardInterrupt):
            store.compact("t", 0)
    assert both() == after
    for b in (0, 1, 0, 1):
        store.compact("t", b)
    assert both() == after
    second = sink.Store(spark, f"file://{tmp_path}/store")
    number = second._state()[0]
    store.put("t", good)
    with pytest.raises(Exception, match="exists"):  # another run was first
        second._save(number + 1, {})


def test_heads_are_read_once(spark, tree, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    c = load_config(input_dir=str(tree), output_dir=str(tmp_path / "out"), model="m", enhance_model="e")
    run_pipeline(spark, "describe", c, store)
    tables = sink.Store(spark, store)
    numbers = lambda: {r["rel_path"]: r["mtime"] for r in tables.read("heads", HEADS).collect()}
    first = numbers()
    assert len(first) == 5
    segments = len(tables._state()[1]["live"]["heads"])
    run_pipeline(spark, "enhance", c, store)
    assert len(tables._state()[1]["live"]["heads"]) == segments  # nothing was read again
    os.utime(tree / "geo/g.jpg", (1, 1))
    run_pipeline(spark, "enhance", c.with_options(retry=True), store)
    assert {k for k, v in numbers().items() if v != first[k]} == {"geo/g.jpg"}


def test_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("d/a.jpg", "text", None), ("b.jpg", None, "broke")], "rel_path string, text string, error string")
    assert sink.write_sidecars(rows, str(tmp_path), ".txt", ".error.txt").where("problem is null").count() == 2
    assert (tmp_path / "d/a.jpg.txt").read_text() == "text" and (tmp_path / "b.jpg.error.txt").read_text() == "broke\n"
    again = spark.createDataFrame([("b.jpg", "good", None)], "rel_path string, text string, error string")
    sink.write_sidecars(again, str(tmp_path), ".txt", ".error.txt").collect()
    assert not (tmp_path / "b.jpg.error.txt").exists()
    assert {r["rel_path"]: r["text"] for r in sink.read_sidecars(rows, str(tmp_path), ".txt").collect()} == {"d/a.jpg": "text", "b.jpg": "good"}


def test_pipelines_end_to_end(spark, tree, tmp_path):
    store, out = f"file://{tmp_path}/store", str(tmp_path / "out")
    c = load_config(input_dir=str(tree), output_dir=out, model="m", enhance_model="e", max_context_items=3)
    assert run_pipeline(spark, "geolocate", c, store) == "geolocate: 5D"
    tables = sink.Store(spark, store)
    codes = {r["rel_path"]: r["text"] for r in tables.read("geolocate").collect()}
    assert codes["geo/g.jpg"] == "Street -52, Town 5 | amenity: Cafe -52" and codes["2022/2022-01-03/_x.jpg"] == "N/A"
    services = Services(vision=lambda: FakeModel("20220104"))
    assert run_pipeline(spark, "describe", c, store, services, sidecars=True) == "describe: 1F4D"
    body = tables.read("describe").where("rel_path = 'geo/g.jpg'").first()["text"]
    assert body.startswith("Bestandsnaam: g.jpg\nDatumtijd: 2020-01-02 03:04:05\nLocatie: -52.510000, 5.000000 | Street -52, Town 5 | amenity: Cafe -52\nCamera: Canon X1\n\nBeschrijving:\nreply ")
    assert (tmp_path / "out/geo/g.jpg.txt").read_text() == body
    assert run_pipeline(spark, "describe", c, store, services) == "describe: 0D"
    assert run_pipeline(spark, "enhance", c, store) == "enhance: 1R4D"
    assert run_pipeline(spark, "describe", c.with_options(retry_failed=True), store) == "describe: 1D"
    assert tables.read("describe_errors", ERRORS).count() == 0
    assert run_pipeline(spark, "enhance", c, store) == "enhance: 1D"
    assert run_pipeline(spark, "enhance", c, store) == "enhance: 0D"
    assert run_pipeline(spark, "shortcut", c, store) == "shortcut: 5D"
    assert tables.read("shortcut").where("text like '%/geo/g.jpg.lnk'").count() == 1


def test_repair_and_describe_again(spark, tree, tmp_path):
    broken = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x05\x10\x11data\xff\xd9"
    (tree / "broken.jpg").write_bytes(broken)
    store = f"file://{tmp_path}/store"
    tables = sink.Store(spark, store)
    tables.put("describe_errors", spark.createDataFrame([("broken.jpg", f"x {SIGNATURE}"), ("geo/g.jpg", "other")], ERRORS), ERRORS)
    c = load_config(input_dir=str(tree), output_dir=str(tmp_path / "out"))
    assert run_pipeline(spark, "fix-jpeg", c, store) == "fix-jpeg: 5R1D"
    fixed = tmp_path / "out/broken.fixed.jpg"
    assert fixed.exists() and fixed.stat().st_mtime == pytest.approx((tree / "broken.jpg").stat().st_mtime)
    assert rels(tables.read("describe_errors", ERRORS)) == ["geo/g.jpg"]


def test_command_line_and_registry(spark, tree, tmp_path, capsys):
    assert list(list_pipelines()) == ["describe", "enhance", "geolocate", "shortcut", "fix-jpeg"]
    with pytest.raises(ValueError):
        get_pipeline("nope")
    (tmp_path / "p.txt").write_text(" Say {filename} ")
    (tmp_path / "c.toml").write_text('[image]\nextensions = [".png"]\n[describe]\nmodel = "toml"\n')
    line = cli.main(["describe", str(tree), str(tmp_path / "o"), "--config", str(tmp_path / "c.toml"), "--prompt-file", str(tmp_path / "p.txt"), "--store", f"file://{tmp_path}/s"], spark)
    assert line == "describe: 1D" and line in capsys.readouterr().out
    c = load_config(tmp_path / "c.toml", model="given", prompt=f"@{tmp_path}/p.txt")
    assert (c.model, c.prompt, c.extensions) == ("given", "Say {filename}", (".png",))


def test_stream_of_listings(spark, tmp_path):
    from photonflow.schema import IMAGES
    from photonflow.streaming.incremental import stream_listings

    row = ("/r/a.jpg", "a.jpg", "/r", "a.jpg", "a", ".jpg", 2, 1, 0.0)
    spark.createDataFrame([row], IMAGES).write.parquet(f"{tmp_path}/l/1")
    seen = []
    for _ in range(2):
        stream_listings(spark, f"{tmp_path}/l/*", f"{tmp_path}/cp", lambda df: seen.extend(rels(df)))
    assert seen == ["a.jpg"]
