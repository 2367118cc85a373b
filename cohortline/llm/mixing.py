"""Mixing sources to target weights by weighted fair queueing.

The words of all documents are the budget.  Sources, in code point order and null
last, weigh 5, 2, 1, repeating; each one's target is its weighted share of the budget, but at
most three times its own words, and what is cut off goes to the other sources by weight until none is above.

Each source is a queue of its documents in a shuffled order (by hash of the id), passed
through up to three times.  A document's virtual finish time is the words of its source up
to and including it over the source's target; all copies are put in order of finish time by one range
sort and taken from the front while the budget lasts (a copy that would pass it isn't taken).  At
virtual time 1 every source has given its target but for a part of one document.

Every hash, sum and tie rule is fixed, so reruns agree.  Both orders are running totals over
range partitions (:mod:`cohortline.llm.running`): a source of any size spreads over many tasks.

Null text has no words.  Documents without words are returned and nothing is taken of them; a null
``doc_id`` or ``source`` is a value like any other; repeated rows are documents of their own; an empty table
gives an empty result; other columns never enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.running import running_total, with_lookup
from cohortline.llm.tables import written

WEIGHTS = (5, 2, 1)          # by rank of the source, repeating
PASSES = 3                   # how often a document may be taken


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, rank, target)``.

    The fill level (words a weight of one gets) is raised until no source below its limit would
    change: each step is one aggregate, and a source that met its limit stays there."""
    ranked = running_total(
        sources.select(F.col("source").isNull().cast("int").alias("_last"), "source", "source_size", F.lit(1).cast("bigint").alias("_one")),
        ["_last", "source"], "_one", "rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "rank", weight.alias("_weight")), "mix-sources")
    big = "decimal(38,0)"
    limit = (F.col("source_size") * PASSES).cast(big)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    words, weights, capped = total, 0, -1                     # level = words / weights, over the sources below their limit
    while True:
        # a limited source: PASSES x size < level x weight, in whole numbers
        over = F.lit(False) if capped < 0 else limit * F.lit(weights).cast(big) < F.col("_weight").cast(big) * F.lit(words).cast(big)
        row = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, limit)).alias("cut"),
                         F.sum(F.when(~over, F.col("_weight"))).alias("w")).first()
        if row["n"] == capped:
            break
        capped, words, weights = row["n"], total - int(row["cut"] or 0), int(row["w"] or 0)
        if not weights:
            break
    share = (F.col("_weight") * F.lit(words)).cast("double") / F.lit(float(max(weights, 1)))
    target = F.when(over, limit.cast("double")).otherwise(share) if total else F.lit(0.0)
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every document."""
    sizes = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                word_count(F.col("text").cast("string")).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).scalar()
    rows = with_lookup(sizes.withColumn("_tie", F.monotonically_increasing_id()), targets, "source", "_tie")
    shuffled = rows.where("size > 0").withColumn("_shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    queue = running_total(shuffled, ["rank", "_shuffle", "doc_id", "size", "_tie"], "size", "_words", group="rank").drop("_shuffle", "_tie")
    copies = queue.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn(
        "_finish", (F.col("_pass") * F.col("source_size") + F.col("_words")).cast("double") / F.col("target"))
    served = running_total(copies, ["_finish", "rank", "_words", "_pass"], "size", "_served")
    # (rank, _words) names a document: the words of a queue grow with each one
    taken = (served.groupBy("rank", "_words").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
        F.coalesce(F.sum(F.when(F.col("_served") <= budget, F.col("size"))), F.lit(0)).alias("taken")).drop("rank", "_words"))
    wordless = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(wordless)
