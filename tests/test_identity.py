"""Identity clusters against pairs and union-find in plain Python."""

import datetime as dt
import itertools
import random

import pytest

from cohortline import schema as S
from cohortline.operators import identity as ID


def orders(spark, rows):
    data = [(u, c, k, dt.date(2024, 1, 1) + dt.timedelta(days=d) if d is not None else None, f"o{i:05d}") for i, (u, c, k, d) in enumerate(rows)]
    return spark.createDataFrame(data, f"{S.USER} string, {S.CITY} string, {S.COUNTRY} string, {S.DATE} date, {S.ORDER} string")


def truth(rows, overlap):
    parent = {u: u for u, *_ in rows if u is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    place = {}
    for u, c, k, d in rows:
        if None not in (u, c, k, d):
            place.setdefault((c, k), {}).setdefault(u, []).append(d)
    for users in place.values():
        for (a, x), (b, y) in itertools.combinations(users.items(), 2):
            near = min(x) <= max(y) and min(y) <= max(x) if overlap == "span" else bool(set(x) & set(y))
            if near:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    out = {}
    for u in parent:
        out.setdefault(root(u), []).append(u)
    return {u: (min(us), len(us)) for us in out.values() for u in us}


@pytest.mark.parametrize("overlap", ["span", "day"])
def test_clusters_match_pairs(spark, overlap):
    rnd = random.Random(7)
    rows = []
    for u in range(150):                                     # short visits: chains over towns and time
        for _ in range(rnd.randint(1, 3)):
            town, day = f"t{rnd.randint(0, 25)}", rnd.randint(0, 200)
            rows += [(f"u{u:03d}", town, "X", day + rnd.randint(0, 6)) for _ in range(rnd.randint(1, 2))]
    rows += [(f"h{u:03d}", "HUB", "X", 2 * u + k) for u in range(120) for k in (0, 3)]          # a crowded town, all one chain
    rows += [(f"w{u}", "HUB", "Y", 10 * u) for u in range(5)] + [("nowhere", None, "X", 3), ("nowhere2", None, "X", 3), (None, "HUB", "X", 3), ("undated", "HUB", "X", None)]
    # touching spans in one town: days next to each other don't overlap
    rows += [("s1", "edge", "X", 1), ("s1", "edge", "X", 3), ("s2", "edge", "X", 4), ("s3", "edge", "X", 3)]
    got = ID.identity_clusters(orders(spark, rows).repartition(3), overlap).collect()
    want = truth(rows, overlap)
    assert {r[S.USER]: (r["cluster_id"], r["cluster_size"]) for r in got} == want and len(got) == len(want)
    if overlap == "span":
        assert want["h119"] == ("h000", 120) and want["s3"][0] == "s1" and want["s2"] == ("s2", 1)


def test_large_lookups_are_salted(spark, monkeypatch):
    from cohortline.functions import joins

    rows = [(f"u{i}", f"t{i % 7}", "X", i % 40) for i in range(200)]
    small = sorted(map(tuple, ID.identity_clusters(orders(spark, rows)).collect()))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 3)
    assert sorted(map(tuple, ID.identity_clusters(orders(spark, rows)).collect())) == small


def test_excess_counts_each_cluster_once(spark):
    rows = [("a1", "t", "X", 1), ("a2", "t", "X", 1), ("a3", "t", "X", 1), ("b", "t", "Y", 1), ("a3", "v", "Z", 9)]
    df = orders(spark, rows)
    got = {r[S.COUNTRY]: (r["uuid_count"], r["cluster_count"], r["excess_ids"], r["excess_pct"])
           for r in ID.identity_excess(df, ID.identity_clusters(df)).collect()}
    assert got == {"X": (3, 1, 2, 200.0), "Y": (1, 1, 0, 0.0)}


def test_no_orders(spark):
    assert ID.identity_clusters(orders(spark, [("a", "t", "X", 1)]).limit(0)).count() == 0
