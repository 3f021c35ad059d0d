"""SimHash groups, components, line groups and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from photonflow.llm import common, graph, lines, simhash
from tests.llm.helpers import SCHEMA, Sets, edge_docs, edge_rows, empty_docs, text


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 70), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
        sets = Sets({x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)})
        for a, b in edges:
            if a is not None and b is not None and a != b:
                sets.join(a, b)
        got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: sets.find(x) for x in sets.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 150])
def test_components_by_joins_and_by_one_task(spark, monkeypatch, few):
    """Above ``FEW_EDGES`` steps are joins; below them a job takes some steps without an exchange but that of the first edges."""
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(rng.randrange(70), rng.randrange(70)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(99, i) for i in range(100, 140)]
    sets = Sets({x for a, b in edges if a != b for x in (a, b)})
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up}
    assert few == 0 or len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before) <= 20


def slow_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("t", [None, "", "  ", "a", "A b", "A B c", "a b c a b c", "É ß x y", "x " * 700])
def test_fingerprint(t):
    assert simhash.fingerprint(t) == slow_print(t)


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_every_close_pair_shares_a_key(spark, blocks):
    rng = random.Random(blocks)
    pairs = []
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        pairs.append(tuple(int(np.uint64(x).view(np.int64)) for x in (a, b)))
    rows = spark.createDataFrame(pairs, "a long, b long")
    met = F.arrays_overlap(simhash.block_keys(F.col("a"), blocks), simhash.block_keys(F.col("b"), blocks))
    assert rows.where(~met).count() == 0


def test_op6_on_dense_groups(spark):
    """Groups whose members are close to some others only, in blocks of many."""
    rng = random.Random(9)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(250):
        x = centre
        for bit in rng.sample(range(12), rng.randrange(7)):
            x ^= 1 << bit
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    sets = Sets(signed)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                sets.join(a, b)
    got = {r["fp"]: r["component"] for r in simhash.near_groups(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert all(got.get(x, x) == sets.find(x) for x in signed)


def test_op6_edges(spark):
    rows = edge_rows()
    got = simhash.op6(edge_docs(spark)).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, t, *_ in rows:
        fps.setdefault(slow_print(t), []).append(i)
    sets = Sets(range(len(fps)))
    keys = list(fps)
    for i, a in enumerate(keys):
        for j in range(i):
            if (a ^ keys[j]).bit_count() <= 3:
                sets.join(i, j)
    low = {}
    for i, k in enumerate(keys):
        for d in fps[k]:
            if d is not None:
                low[sets.find(i)] = min(d, low.get(sets.find(i), d))
    want = sorted((str(d), f"{k:016x}", str(low.get(sets.find(i)))) for i, k in enumerate(keys) for d in fps[k])
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.op6(empty_docs(spark)).count() == 0


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_keep_representatives(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        t = text(rng, 8)
        rows.append((10 * i, t))
        for j in range(rng.randrange(4)):
            w = t.split(" ")
            w[rng.randrange(len(w))] = f"new{i}{j}"
            rows.append((10 * i + j + 1, " ".join(w) if j else t))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets, cut = Sets(range(len(rows))), [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j]):
                sets.join(i, j)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    want = {rows[i][0] for i in range(len(rows)) if sets.find(i) == i}
    got = {r["doc_id"] for r in kept.collect()}
    assert want <= got and len(got - want) <= 2  # fingerprints may miss a pair, and never take unlike texts together


def edited(rng, t, n):
    w = t.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.getrandbits(40)}"
    return " ".join(w)


def near_pairs(sizes):
    """Texts and copies with so many words changed that similarities lie on both sides of .8, with the similarities."""
    rng, rows, want = random.Random(12), [], {}
    for i, size in enumerate(sizes):
        t = " ".join(f"w{rng.getrandbits(40)}" for _ in range(size))
        copy = edited(rng, t, max(1, round(size * rng.uniform(0.018, 0.028))))
        a, b = shingles(t), shingles(copy)
        rows += [(2 * i, t), (2 * i + 1, copy)]
        want[2 * i] = len(a & b) / len(a | b)
    return rows, want


def test_near_copies_of_long_texts_are_compared_as_a_whole(spark):
    rows, want = near_pairs([600] * 60)
    assert sum(0.775 <= x < 0.8 for x in want.values()) >= 5 and sum(0.8 <= x < 0.825 for x in want.values()) >= 5
    got = {r["doc_id"] for r in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= set(want)
    assert not [x for i, x in want.items() if x < 0.8 and i + 1 not in got]  # none is linked that is not near


def test_near_copies_are_found_by_simhash(spark, monkeypatch):
    """Near copies with fingerprints within three bits need no MinHash."""
    monkeypatch.setattr(simhash, "CHOICES", [])
    rng, rows, near = random.Random(31), [], set()
    for i in range(60):
        t = " ".join(f"w{rng.getrandbits(40)}" for _ in range(400))
        rows += [(2 * i, t), (2 * i + 1, edited(rng, t, 2))]
        if (simhash.fingerprint(t) ^ simhash.fingerprint(rows[-1][1])).bit_count() <= simhash.DISTANCE:
            near.add(2 * i + 1)
    got = {r["doc_id"] for r in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 10 and not got & near and got >= {2 * i for i in range(60)}


def test_near_copies_are_found(spark):
    """Recall on near copies alone, no exact ones among them."""
    rows, want = near_pairs([60, 90, 150, 300, 600] * 40)
    got = {r["doc_id"] for r in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, x in want.items() if x >= 0.8]
    assert len(near) > 90 and sum(i + 1 not in got for i in near) >= 0.98 * len(near)


def test_keep_representatives_edges(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 2 and 3 repeat 1; 5 and 6 have no words, nor has the first null text, 4; repeated rows stay as one
    assert [x[1] for x in got if not x[0]] == [-5, 1, 4, 7, 8, 9, 10, 11, 12, 13, 14] and sum(x[0] for x in got) == 1
    assert simhash.keep_representatives(empty_docs(spark)).count() == 0


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def brute_lines(rows):
    """Texts by (id, text), without the lines that came before; lines are linked by edit distance alone."""
    low, spot = -(1 << 63), {}
    for i, t in rows:
        if t is not None:
            th = xxhash.xxh64_intdigest(t.encode(), 42)
            th = th - 2**64 if th >> 63 else th
            for k, line in enumerate(t.split("\n")):
                if norm(line):
                    spot.setdefault(norm(line), set()).add((low if i is None else i, th, k))
    names = list(spot)
    sets = Sets(range(len(names)))
    for i, a in enumerate(names):
        for j in range(i):
            b, most = names[j], int(0.2 * max(len(a), len(names[j])) + 1e-9)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                sets.join(i, j)
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(sets.find(i), set()).update(spot[n])
    gone = {x for g in groups.values() for x in g if x != min(g)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        th = xxhash.xxh64_intdigest(t.encode(), 42)
        th = th - 2**64 if th >> 63 else th
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if ((low if i is None else i), th, k) not in gone)))
    return out


def line_rows():
    rng = random.Random(8)
    pool = [text(rng, 1) + " " + text(rng, 1) for _ in range(25)]
    out = []
    for i in range(60):
        picked = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        for j, line in enumerate(picked):
            if rng.random() < 0.5:
                w = line.split(" ")
                w[rng.randrange(len(w))] += rng.choice(["x", "y", "!"])
                picked[j] = " ".join(w)
        out.append((i, "\n".join(picked + ["", "--"])))
    return out


def test_lines_against_brute_force(spark):
    rows = line_rows() + [(5, "5"), (None, "Again and again this line\nAgain and again this line"), (61, None), (62, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lines.stage(docs)
    assert got.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    found = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=key) == sorted(brute_lines(rows), key=key)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)


def test_lines_recall_against_edit_distance(spark):
    """Lines of any length with one changed character, or every twelfth word changed: found without any fingerprint's say."""
    rng, out = random.Random(21), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    for size in (1, 2, 3, 5, 8, 12, 24, 40) * 12:
        line = " ".join(word() for _ in range(size)) + "abcd"
        at = rng.randrange(len(line))
        other = edited(rng, line, size // 12) if size >= 12 and rng.random() < 0.5 else line[:at] + "0" + line[at + 1 :]
        if distance(line, other) <= int(0.2 * max(len(line), len(other)) + 1e-9):
            out += [(len(out), line), (len(out) + 1, other)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.op2(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    lost = [out[i][1] for i, _ in out[::2] if got[i + 1] == 0]
    assert len(out) > 150 and not [x for x in lost if len(x) <= lines.SHORT] and len(lost) <= 0.05 * len(out) / 2, lost
    assert not any(got[i] for i, _ in out[::2])


def test_lines_recall_by_length_and_share_of_changed_words(spark):
    """At least nine in ten pairs with 5, 10 or 15 % of their words replaced end in one group, from 6 words to 600."""
    rng, rows, plan = random.Random(77), [], []
    common = "the of and to in is that for it was on are as with his they at be this from have or by one had".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
    for share in (5, 10, 15):
        for size in (6, 24, 60, 120, 200, 250, 300, 600):
            for _ in range(25):
                one = [word() for _ in range(size)]
                two = list(one)
                for i in rng.sample(range(size), max(1, round(size * share / 100))):
                    two[i] = word()
                a, b = " ".join(one), " ".join(two)
                if a != b and (size > 60 or distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)):
                    plan.append((share, min(size, 250) if size < 300 else 300))
                    rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = lines.cut(lines.occurrences(docs), "lines")
    group = {r["id"]: r["component"] for r in lines.fuzzy_groups(docs, found, lines.distinct_lines(found)).collect()}
    name = {r["d"]: r["h"] for r in found.select("d", "h").collect()}
    got = {}
    for i, kind in enumerate(plan):
        a, b = name[2 * i], name[2 * i + 1]
        got.setdefault(kind, []).append(group.get(a, a) == group.get(b, b))
    assert sum(map(sum, got.values())) >= 0.95 * len(plan)
    for share in (5, 10, 15):
        pairs = [x for (s, _), v in got.items() if s == share for x in v]
        assert sum(pairs) >= 0.9 * len(pairs), (share, sum(pairs), len(pairs))
    assert not (low := {k: (sum(v), len(v)) for k, v in got.items() if sum(v) < 0.8 * len(v)}), low


def test_lines_run_no_python(spark):
    plan = lines.dedup_lines(spark.createDataFrame(line_rows(), "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_edges(spark):
    docs = edge_docs(spark)
    got = lines.op2(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_lines"] == 0 and by[4]["text_sha256"] == hashlib.sha256(b"").hexdigest() and by[5]["n_lines"] == 1 and by[6]["n_removed"] == 0
    assert by[2]["n_removed"] == by[2]["n_lines"] and by[1]["n_removed"] == 0
    assert lines.stage(docs).columns == docs.columns
    assert lines.op2(empty_docs(spark)).count() == 0


def test_one_word_may_differ_in_a_fingerprint(spark):
    """Fingerprints that differ in one word on either side share a block, whichever it is."""
    rng = random.Random(5)
    for _ in range(3):
        words = [f"w{rng.getrandbits(40)}" for _ in range(12)]
        rows = [(" ".join(words),)] + [(" ".join(words[:i] + ["zz"] + words[i + 1 :]),) for i in range(12)]
        docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
        found = lines.occurrences(docs)
        blocks = {}
        for r in lines.block_rows(found, found.where("brief is not null").select("h", "brief"), found.where("wide is not null").select("h", "wide")).collect():
            blocks.setdefault(r["id"], set()).add(r["k"])
        first = found.first()["h"]
        assert len(blocks) == 13 and all(blocks[first] & b for b in blocks.values())


def test_long_lines_share_blocks_only_if_they_are_similar(spark):
    """Lines of many words from one small vocabulary: each meets its copies with three words in a hundred changed, and few others."""
    rng, rows = random.Random(6), []
    vocabulary = [f"w{rng.getrandbits(30)}" for _ in range(300)]
    for i in range(20):
        line = " ".join(rng.choice(vocabulary) for _ in range(230 + 60 * (i % 4)))
        rows += [(2 * i, line), (2 * i + 1, edited(rng, line, len(line.split(" ")) * 3 // 100))]
    found = lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    wides = found.where("wide is not null").select("h", "wide")
    ids = {r["h"]: r["d"] for r in found.collect()}
    blocks = {}
    for r in lines.block_rows(lines.distinct_lines(found), found.where("brief is not null").select("h", "brief"), wides).collect():
        blocks.setdefault(ids[r["id"]], set()).add(r["k"])
    assert sum(bool(blocks[2 * i] & blocks[2 * i + 1]) for i in range(20)) >= 18
    others = sum(bool(blocks[a] & blocks[b]) for a in range(40) for b in range(a) if a // 2 != b // 2 and min(len(rows[x][1].split(" ")) for x in (a, b)) >= 256)
    assert others <= 2


def table_pairs():
    """Distinct normalised lines of 15 to 400 characters of a supplied table, and those pairs that are similar by brute force over edit distance."""
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    found = duckdb.sql(f"select unnest(string_split(text, chr(10))) from read_parquet('{path}')").fetchall()
    names = sorted({norm(x) for (x,) in found} - {""})  # noqa: F841
    pairs = duckdb.sql("""with n as (select unnest(names) s from (select $names names)) select a.s, b.s from n a, n b
        where a.s < b.s and length(a.s) <= 400 and length(b.s) <= 400 and least(length(a.s), length(b.s)) >= 0.8 * greatest(length(a.s), length(b.s))
        and levenshtein(a.s, b.s) <= floor(0.2 * greatest(length(a.s), length(b.s)) + 1e-9)""", params={"names": names}).fetchall()
    return pairs


def test_lines_recall_on_a_table(spark):
    """At least nine in ten of the pairs that brute force finds end in one group."""
    pairs = table_pairs()
    assert len(pairs) >= 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sorted({x for p in pairs for x in p}))], "doc_id long, text string")
    found = lines.cut(lines.occurrences(docs), "lines")
    group = {r["id"]: r["component"] for r in lines.fuzzy_groups(docs, found, lines.distinct_lines(found)).collect()}
    name = {t: h for t, h in found.join(docs, found.d == docs.doc_id).select("text", "h").collect()}
    got = sum(group.get(name[a], name[a]) == group.get(name[b], name[b]) for a, b in pairs)
    assert got >= 0.9 * len(pairs), (got, len(pairs))


@pytest.mark.parametrize("most", [64, common.BROADCAST_ROWS])
def test_repeated_blocks(spark, monkeypatch, most):
    """Rows of blocks with two members or more, also where the bits are few for the keys."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    rng = random.Random(8)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)] + [0, -1, 1 << 62]
    rows = [(k, i) for i, k in enumerate(keys)] + [(k, 10_000 + i) for i, k in enumerate(keys) if rng.random() < 0.3 or k in (0, -1)]
    number = Counter(k for k, _ in rows)
    got = graph.repeated_blocks(spark.createDataFrame(rows, "k long, id long"))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if number[r[0]] > 1)


def test_letters_rule_out_unlike_lines_only(spark):
    """A block of short unlike lines gives few pairs to judge; no pair within its edit distance is ruled out."""
    rng = random.Random(14)
    syllables = "ing the er an on th re he in ed ver ein \u00fc \u6f22 7".split()
    some = ["".join(rng.choice(syllables) + rng.choice(["", " "]) for _ in range(rng.randrange(8, 24))).strip() for _ in range(150)]
    for t in some[:60]:
        t = list(t)
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "e", "\u6f22"])
        some.append("".join(t))
    rows = [(i, t) for i, t in enumerate(some)] + [(1000, "a b " * 80), (1001, "a b " * 78)]
    marks = spark.createDataFrame(rows, "i int, t string").select("i", F.struct(F.length("t").alias("n"), lines.letters(F.col("t")).alias("bag")).alias("m"))
    pairs = marks.alias("a").join(marks.alias("b"), F.expr("a.i < b.i")).where(lines.may_be_similar(F.col("a.m"), F.col("b.m"))).select("a.i", "b.i")
    got, text = {tuple(r) for r in pairs.collect()}, dict(rows)
    near = {(a, b) for a in text for b in text if a < b and max(map(len, (text[a], text[b]))) <= 400 and distance(text[a], text[b]) <= int(0.2 * max(len(text[a]), len(text[b])) + 1e-9)}
    assert len(near) > 30 and near <= got and len(got) < 0.25 * len(rows) ** 2 / 2


def test_pairs_of_characters_rule_out_unlike_lines_only(spark):
    rng, letters = random.Random(5), "theandorinblesh "
    lines_ = ["".join(rng.choice(letters) for _ in range(rng.choice([9, 40, 80, 230, 300]))) for _ in range(30)]
    for x in lines_[:20]:
        cut_up = list(x)
        for i in rng.sample(range(len(x)), int(0.2 * len(x) * 0.8)):  # as many edits as similar lines may have, nearly
            cut_up[i] = rng.choice(["", "\U0001f600", "x", "ab"[: rng.randint(1, 2)]])
        lines_.append("".join(cut_up))
    texts = spark.createDataFrame(list(enumerate(lines_)), "i int, norm string").withColumn("n", F.length("norm"))
    texts = lines.marks(texts).localCheckpoint()
    a, b = (texts.select(F.col("i").alias(f"i{e}"), F.col("norm").alias(f"t{e}"), F.col("mark").alias(f"m{e}")) for e in "ab")
    near = F.levenshtein("ta", "tb") <= F.floor(F.lit(1 - lines.SIMILARITY + 1e-12) * F.greatest(F.length("ta"), F.length("tb")) + 1e-9)
    told = a.join(b, F.col("ia") < F.col("ib")).select(near.alias("near"), lines.may_be_similar(F.col("ma"), F.col("mb")).alias("by_letters"), lines.may_share_pairs(F.col("ma"), F.col("mb")).alias("may"), (F.greatest(F.length("ta"), F.length("tb")) <= lines.COUNTED).alias("short")).collect()
    assert sum(r["near"] for r in told) >= 15 and all(r["may"] for r in told if r["near"])
    unlike = [r for r in told if not r["near"] and r["by_letters"] and r["short"]]
    assert sum(r["may"] for r in unlike) < 0.6 * len(unlike)  # letters alone let these pass


def test_rounds_end_when_unlike_pairs_are_left(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_PAIRS", 5)
    pairs = spark.createDataFrame([(i, j, i, j) for i in range(30) for j in range(100, 110)], "a long, b long, ca long, cb long")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name, path=None: written.append(name) or cut(df, name, path))
    settled = []

    def settle(some):
        settled.append(some.count())
        return some.where("a = 0 and b = 109")

    got = graph.joined_by_rounds(pairs, lambda p: p.withColumn("score", F.lit(0.5)), settle).collect()
    assert [(r["ca"], r["cb"]) for r in got] == [(0, 109)] and sum(settled) == 300
    assert written.count("open-pairs") == 1  # a second round, as before, would settle as many pairs and join all of them again


def test_schema_has_clashing_names():
    assert {"row", "th", "id", "gone", "_score", "component"} <= {x.split()[0] for x in SCHEMA.split(", ")}


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    kept = simhash.keep_representatives(edge_docs(spark))
    stay = lines.dedup_lines(edge_docs(spark))
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["gone-lines", "kept"]
    assert kept.count() and stay.count() == len(edge_rows())


@pytest.mark.parametrize("few", [0, 10**6])
def test_rounds_join_what_all_pairs_join(spark, monkeypatch, few):
    """Components reached in rounds are those of all passing pairs, whatever the judgement settles at once."""
    monkeypatch.setattr(graph, "FEW_PAIRS", few)
    rng = random.Random(few)
    home = {i: i // 4 for i in range(80)}  # ids 4c .. 4c+3 are in component c
    drawn = {tuple(sorted(rng.sample(range(80), 2), reverse=True)) for _ in range(200)}
    rows = [(a, b, home[a], home[b], rng.choice(["sure", "near", "far", "far", "far", "gone"])) for a, b in sorted(drawn) if home[a] != home[b]]
    kind = spark.createDataFrame([(a, b, k) for a, b, _, _, k in rows], "a long, b long, kind string")
    pairs = spark.createDataFrame([r[:4] for r in rows], "a long, b long, ca long, cb long")

    def judge(p):
        score = F.when(F.col("kind") == "sure", None).when(F.col("kind") == "near", 0.2).otherwise(0.9)
        return common.cut(p.join(kind, ["a", "b"]).where("kind <> 'gone'").select(*p.columns, score.alias("score")), "judged")

    def settle(p):
        return p.join(kind.where("kind = 'near'"), ["a", "b"], "left_semi").select(*p.columns)

    got = graph.components(graph.joined_by_rounds(pairs, judge, settle).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    want = graph.components(pairs.join(kind.where("kind in ('sure', 'near')"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    empty = graph.joined_by_rounds(pairs.limit(0), judge, settle)
    assert empty.count() == 0
