"""Property test: classification and master table vs. a pure-Python brute force."""

import datetime as dt
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortline import schema as S
from cohortline.operators import classify as CL
from cohortline.operators import marts as M
from cohortline.operators.cleaning import clean_orders
from tests.conftest import raw_rows

BASE = dt.date(2020, 1, 1)

order = st.tuples(
    st.sampled_from(["u1", "u2", "u3", "hot"]),
    st.one_of(st.integers(0, 3), st.integers(360, 370), st.integers(700, 740)),   # day offsets near the 365 gap
    st.sampled_from(["app", "web", "touch"]),
    st.integers(-500, 5000),                                                      # cents
)


def brute(orders):
    """orders: list of (user, date, id, platform, cents) -> types, seqs, per-user facts."""
    by_user = defaultdict(list)
    for o in orders:
        by_user[o[0]].append(o)
    types, seqs, facts = {}, {}, {}
    for u, rows in by_user.items():
        rows.sort(key=lambda r: (r[1], r[2]))
        prev = None
        react = 0
        for i, r in enumerate(rows, 1):
            if i == 1:
                t = "new"
            elif (r[1] - prev).days > 365:
                t = "reactivated"
                react += 1
            else:
                t = "retained"
            types[r[2]], seqs[r[2]] = t, i
            prev = r[1]
        counts = Counter(r[3] for r in rows)
        top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        facts[u] = (len(rows), react, top, sum(r[4] for r in rows))
    return types, seqs, facts


@settings(max_examples=12, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(order, min_size=1, max_size=40))
def test_classification_properties(spark, orders):
    spec = [(u, BASE + dt.timedelta(days=d), f"o{i:03d}", p, c) for i, (u, d, p, c) in enumerate(orders)]
    rows = [{"user_uuid": u, "operational_view_date": d.isoformat(), "order_uuid": o, "platform": p,
             "gross_bookings_operational": f"{c / 100:.2f}"} for u, d, o, p, c in spec]
    clean = clean_orders(raw_rows(spark, rows))
    types, seqs, facts = brute(spec)
    got = {r[S.ORDER]: (r["order_type"], r["order_seq"]) for r in CL.classify_orders(clean).collect()}
    assert got == {k: (types[k], seqs[k]) for k in types}
    mct = {r[S.USER]: (r["total_orders"], r["reactivation_count"], r["primary_platform"],
                       round(r["total_gross_bookings_usd"] * 100)) for r in M.master_customer_table(clean).collect()}
    assert mct == facts
    mix = {(r["month"], r["order_type"]): round(r[S.GROSS_USD] * 100) for r in M.revenue_mix_monthly(clean).collect()}
    want = Counter()
    for u, d, o, p, c in spec:
        want[(d.replace(day=1), types[o])] += c
    assert mix == dict(want)
