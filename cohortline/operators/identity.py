"""User ids that may belong to one customer (root cause 1 of an inflated customer count).

Two ids are linked when they were active in one place (city and country) at
overlapping times; linked ids, over any number of steps and places, form a cluster.

``overlap="span"``: an id's time in a place runs from its first to its last order day
there, and two ids overlap when these spans share a day.  ``overlap="day"``: both
have an order in the place on the same day.

No pair of ids is formed.  The spans of a place that overlap, directly or over
others, are one *island* of its calendar: spans are reduced to the latest end per (place, first day),
and a window over the first days (at most one row per calendar day, however many ids
the place has) starts a new island where no earlier span reaches.  Ids and islands form a two-sided graph
in which only ids seen in several islands connect anything, so components are
computed over islands, and every id takes the component of one of its islands.

Tables with a row per id are merged, never broadcast: Spark judges them by the size of their files, which
unpack to many times that in the driver.

Null city or country is no place: such orders link nothing.  Null ids have no row in the
result; an id without any place is a cluster of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.joins import lookup_join
from cohortline.operators.components import connected_components
from cohortline.session import scratch_path

_PLACE = [S.CITY, S.COUNTRY]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _node(day: str) -> Column:
    """A place and a day as one text (the city's length keeps it unambiguous)."""
    return F.concat_ws("|", F.length(S.CITY).cast("string"), S.CITY, S.COUNTRY, F.col(day).cast("string"))


def stays(clean: DataFrame) -> DataFrame:
    """One row per id and place: first and last order day there."""
    return (clean.where(F.col(S.USER).isNotNull() & F.col(S.CITY).isNotNull() & F.col(S.COUNTRY).isNotNull() & F.col(S.DATE).isNotNull())
            .groupBy(S.USER, *_PLACE).agg(F.min(S.DATE).alias("first_day"), F.max(S.DATE).alias("last_day")))


def islands(spans: DataFrame) -> DataFrame:
    """``city, country, first_day, island``: the island of each first day, named by the day it begins."""
    reach = spans.groupBy(*_PLACE, "first_day").agg(F.max("last_day").alias("reach"))
    w = Window.partitionBy(*_PLACE).orderBy("first_day")
    before = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = reach.withColumn("_before", before).withColumn(
        "_start", F.when(F.col("_before").isNull() | (F.col("_before") < F.col("first_day")), F.col("first_day")))
    return starts.select(*_PLACE, "first_day", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


def visits(clean: DataFrame, overlap: str = "span") -> DataFrame:
    """``user_uuid, node``: the islands (or place days) of every id."""
    if overlap == "day":
        days = clean.where(F.col(S.USER).isNotNull() & F.col(S.CITY).isNotNull() & F.col(S.COUNTRY).isNotNull() & F.col(S.DATE).isNotNull())
        return days.select(S.USER, _node(S.DATE).alias("node")).distinct()
    if overlap != "span":
        raise ValueError("overlap must be 'span' or 'day'")
    spans = _written(stays(clean), "stays")
    return spans.join(islands(spans).hint("merge"), [*_PLACE, "first_day"]).select(S.USER, _node("island").alias("node"))


def identity_clusters(clean: DataFrame, overlap: str = "span") -> DataFrame:
    """``user_uuid, cluster_id, cluster_size``: ``cluster_id`` is the least id of the cluster."""
    seen = _written(visits(clean, overlap), "visits")
    home = _written(seen.groupBy(S.USER).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "homes")
    moved = home.where("n > 1").select(S.USER, F.col("node").alias("u"))
    links = seen.join(moved.hint("merge"), S.USER).where("node <> u").select("u", F.col("node").alias("v")).distinct()
    comps = _written(connected_components(links).select(F.col("id").alias("node"), "comp"), "places")
    placed = _written(lookup_join(home.select(S.USER, "node"), comps, "node", S.USER)
                      .select(S.USER, F.coalesce("comp", "node").alias("comp")), "placed")
    clusters = _written(placed.groupBy("comp").agg(F.min(S.USER).alias("cluster_id"), F.count(F.lit(1)).alias("cluster_size")), "clusters")
    linked = lookup_join(placed, clusters, "comp", S.USER).select(S.USER, "cluster_id", "cluster_size")
    users = clean.where(F.col(S.USER).isNotNull()).select(S.USER).distinct()
    alone = users.join(placed.select(S.USER).hint("merge"), S.USER, "left_anti")
    return linked.unionByName(alone.select(S.USER, F.col(S.USER).alias("cluster_id"), F.lit(1).cast("bigint").alias("cluster_size")))


def identity_excess(clean: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ids beyond one per cluster, by country of the cluster's first order: ``customer_country, uuid_count,
    cluster_count, excess_ids, excess_pct``.  Sums over the rows are the totals, as each cluster counts once."""
    first = clean.where(F.col(S.USER).isNotNull()).groupBy(S.USER).agg(
        F.min(F.struct(F.col(S.DATE), F.col(S.ORDER), F.col(S.COUNTRY))).alias("f"))
    per = (clusters.join(first, S.USER).groupBy("cluster_id")
           .agg(F.count(F.lit(1)).alias("ids"), F.min("f")[S.COUNTRY].alias(S.COUNTRY)))
    out = per.groupBy(S.COUNTRY).agg(F.sum("ids").alias("uuid_count"), F.count(F.lit(1)).alias("cluster_count"))
    excess = F.col("uuid_count") - F.col("cluster_count")
    return out.select("*", excess.alias("excess_ids"), (F.round(excess * 1000.0 / F.col("cluster_count")) / 10).alias("excess_pct"))
