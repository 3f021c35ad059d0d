"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities.

Documents are summed into cells (source, language, topic). Iterative proportional fitting scales the
cells until the marginals are those wanted; the ratio of fitted to present tokens of a cell, times one
constant, is the probability with which its documents are kept. Documents of one cell need not meet:
the fit works on cells, and each document draws its own number by hash.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonflow.llm.common import cut, new_path, packed, remove, unpacked

log = logging.getLogger(__name__)

DIMS = ("source", "lang", "topic")
#: Share of a category as its present share to this power: 1 leaves it, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.0}
TOPICS = 16
KEEP = 0.5
TOLERANCE, ROUNDS = 1e-6, 100
#: Rounds without progress after which raking gives up.
PATIENCE = 20
#: Counted cells up to which one task fits them, ``AT_ONCE`` rounds in a job, as sums over windows without an exchange or a broadcast,
#: each of which costs the driver a thread. More are grouped and joined across tasks, a round in a job.
FEW_CELLS, AT_ONCE = 10_000, 2
#: Counted cells up to which probabilities are broadcast to the documents.
BROADCAST_CELLS = 100_000
SEED = 20_240


def topic(text: Column) -> Column:
    """MinHash bucket of the words of eight letters or more; texts that share most of them share a topic. -1: no such word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{8,}"), 0)
    low = F.array_min(F.transform(words, lambda w: F.xxhash64(w)))
    return F.coalesce(F.pmod(low, F.lit(TOPICS)).cast("int"), F.lit(-1)).cast("string")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """``row``, the columns of ``docs``, with ``_source``, ``_lang``, ``_topic`` (null is a category of its own), ``_tokens`` and ``_u``, uniform in [0, 1)."""
    name = lambda c: F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("\x00"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "row.doc_id", "row.text"), 11).cast("double") / float(1 << 53)
    return packed(docs).withColumns({"_source": name("source"), "_lang": name("lang"), "_topic": topic(F.col("row.text")), "_tokens": tokens(F.col("row.text")), "_u": u})


def cells(rows: DataFrame) -> DataFrame:
    """``(source, lang, topic, w)``: tokens of each cell, without cells that have none."""
    keys = [F.col(f"_{d}").alias(d) for d in DIMS]
    return rows.groupBy(*keys).agg(F.sum("_tokens").cast("double").alias("w")).where("w > 0")


def with_sums(found: DataFrame, d: str, value: str, name: str, few: bool) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the cell's category of ``d``. ``few``: by a window, for cells in one partition."""
    if few:
        return found.withColumn(name, F.sum(value).over(Window.partitionBy(d)))
    return found.join(found.groupBy(d).agg(F.sum(value).alias(name)), d)


def with_targets(found: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """Adds ``t_<dim>``, the wanted share of the cell's category: present share to a power, summing to 1 over the categories."""
    few = found.count() <= FEW_CELLS
    out = found = found.coalesce(1) if few else found
    for d, power in powers.items():
        total = found.groupBy(d).agg(F.pow(F.sum("w"), F.lit(power)).alias("s")).agg(F.sum("s")).first()[0] or 1.0
        out = with_sums(out, d, "w", "_sum", few).withColumn(f"t_{d}", F.pow(F.col("_sum"), F.lit(power)) / total).drop("_sum")
    return out


def rake(found: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``found(dims, w, t_<dim>)`` -> the same with ``fitted``, whose marginals are ``t_<dim>`` of the total.

    One round scales by each dimension in turn, by sums over categories; one or some rounds are written to the shared folder at a time. It ends when no
    factor differs from 1 by more than ``tolerance``, when ``PATIENCE`` rounds have not brought the largest factor a
    thousandth nearer to 1 than it was at best (on the way to a fit it may grow for some rounds), or after ``rounds``.
    Marginals that contradict each other, as when a source has one language only, have no exact fit; the last round
    is returned, and a warning states how far off it is.
    """
    spark = found.sparkSession
    n, total = found.agg(F.count("*"), F.sum("w")).first()
    total, few = total or 0.0, n <= FEW_CELLS
    gathered = lambda df: df.coalesce(1) if few else df
    path = new_path(spark, "raked")
    state = gathered(cut(gathered(found).withColumn("fitted", F.col("w")), "raked", path))
    best, since, off, done = float("inf"), 0, 0.0, 0
    while done < rounds:
        step, laps = state, min(AT_ONCE if few else 1, rounds - done)
        for i in range(laps):
            step = step.withColumn(f"_off{i}", F.lit(0.0))
            for d in DIMS:
                step = with_sums(step, d, "fitted", "_sum", few).withColumn("_f", F.col(f"t_{d}") * total / F.col("_sum")).drop("_sum")
                step = step.withColumn("fitted", F.col("fitted") * F.col("_f")).withColumn(f"_off{i}", F.greatest(f"_off{i}", F.abs(F.col("_f") - 1))).drop("_f")
            step = step.withColumn(f"_fitted{i}", F.col("fitted"))
        after = new_path(spark, "raked")
        step = gathered(cut(step.drop("fitted"), "raked", after))
        remove(spark, path)
        path = after
        for i, off in enumerate(step.agg(*(F.max(f"_off{i}") for i in range(laps))).first()):
            off, done = off or 0.0, done + 1
            best, since = (off, 0) if off < 0.999 * best else (best, since + 1)
            if ended := off <= tolerance or since >= PATIENCE:
                break
        state = step.select(*found.columns, F.col(f"_fitted{i}").alias("fitted"))
        if ended:
            break
    if rounds and off > tolerance:
        log.warning("raking: a factor is still %.3g off 1", off)
    return state


def probabilities(fitted: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``p`` = min(1, c * fitted / w), with c such that the expected tokens are ``keep`` of all.

    Cells whose p would pass 1 are kept whole and c is found anew for the others, until none is added.
    """
    ratio = F.col("fitted") / F.col("w")
    goal = keep * (fitted.agg(F.sum("w")).first()[0] or 0.0)
    c, seen = 0.0, -1
    while True:
        full = ratio * c >= 1
        n, whole, rest = fitted.agg(F.count_if(full), F.sum(F.when(full, F.col("w")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("fitted")))).first()
        if n == seen or not rest:
            return fitted.withColumn("p", F.least(F.lit(1.0), ratio * c))
        seen, c = n, (goal - whole) / rest


def plan(rows: DataFrame, powers: dict[str, float] = POWERS, keep: float = KEEP) -> DataFrame:
    """``(source, lang, topic, w, fitted, p)`` for described rows."""
    found = cut(cells(rows), "cells")
    return cut(probabilities(rake(with_targets(found, powers)), keep).select(*DIMS, "w", "fitted", "p"), "plan")


def draw(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Described rows with ``_p``, their probability (1 where a row has no tokens), and ``_kept``, whether they are drawn."""
    ends = planned.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.col("p").alias("_p"))
    ends = F.broadcast(ends) if planned.count() <= BROADCAST_CELLS else ends
    met = rows.join(ends, [f"_{d}" for d in DIMS], "left").withColumn("_p", F.when(F.col("_tokens") == 0, 1.0).otherwise(F.coalesce("_p", F.lit(1.0))))
    return met.withColumn("_kept", F.col("_u") < F.col("_p"))


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of each document.

    Equal rows are drawn alike; rows without tokens weigh nothing and are kept; null source or language is a category;
    an empty table gives no rows.
    """
    rows = described(docs.select("doc_id", "source", "lang", "text")).select("row.doc_id", "row.source", "row.lang", *(f"_{d}" for d in DIMS), "_tokens", "_u")
    rows = cut(rows, "described")
    drawn = draw(rows, plan(rows))
    return drawn.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_p").alias("probability"), F.col("_kept").alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged. Rows that repeat id and text are drawn together; null sources, languages and texts are categories; an empty table gives no rows."""
    rows = described(docs)
    return unpacked(draw(rows, plan(rows)).where("_kept"), docs.columns)
