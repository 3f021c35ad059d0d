"""Tables that are awkward in every way that an operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, th long, id long, gone string, _score double, component string, k int, p double, u int, _d int, _source string"
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def text(rng, lines=6):
    return "\n".join(sentence(rng, rng.randrange(6, 40)).capitalize() + "." for _ in range(lines))


def edge_rows():
    rng = random.Random(3)
    base = [text(rng) for _ in range(6)]
    near = base[0].replace("the", "thes", 1)
    long = "\n".join(sentence(rng, 60) for _ in range(600))
    rows = [
        (1, base[0], "en", "a"), (2, base[0], "en", "a"), (3, near, "en", "a"), (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t\n ", "de", None), (7, base[1], "en", "b"), (7, base[1], "en", "b"),
        (8, base[2] + "\n" + base[3].split("\n")[0], "fr", "b"), (9, base[3], "fr", "b"), (None, base[4], "en", "a"), (None, None, None, None), (10, long, "en", "c"), (11, "x" * 70_000, "en", "c"),
        (12, "ünïcödé 漢字 🙂\r\n\x00 end", "xx", "c"), (13, "the " * 3000, "en", "a"), (-5, base[5], "es", "c"), (14, "the", "en", "a"),
    ]
    return [(i, t, l, s, None if t is None else len(t), "r", 1, 2, "g", 0.5, "c", 3, 0.1, 4, 5, "s") for i, t, l, s in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets:
    """Disjoint sets; each is known by its smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
