"""Neighbours, last known values and positions across days, with null keys, null times and hot keys, against plain code."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import carry, phone

START = datetime.datetime(2024, 1, 1)
SCHEMA = "tenant_id long, source string, ts timestamp_ntz, seq long, value long"


def made():
    rng = random.Random(5)
    rows = []
    for seq in range(600):
        tenant, source = rng.choice([None, 0, 1, 1, 1]), rng.choice([None, "", "a", "a"])
        at = None if rng.random() < 0.03 else START + datetime.timedelta(hours=rng.randrange(24 * 9))
        rows.append((tenant, source, at, seq, rng.choice([None, None, 1, 2])))
    return rows


def test_carry_against_plain_code(spark):
    rows, keys, order = made(), ["tenant_id", "source"], ["ts", "seq"]
    df = spark.createDataFrame(rows, SCHEMA)
    last = carry.last_known(df, keys, order, {"known": F.col("value")}, before="was_").select("seq", "known", "was_known")
    out = carry.numbered(carry.neighbour(carry.neighbour(df, keys, order, {"back": "seq"}), keys, order, {"next": "seq"}, ahead=True), keys, order, "n")
    got = {r.seq: (r.back, r.next, r.n, r.known, r.was_known) for r in out.join(last, "seq").collect()}
    groups, want = {}, {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[2] is not None, r[2] or START, r[3]))
        known = None
        for k, r in enumerate(g):
            was, known = known, r[4] if r[4] is not None else known
            want[r[3]] = (g[k - 1][3] if k else None, g[k + 1][3] if k + 1 < len(g) else None, k + 1, known, was)
    assert got == want
    assert out.columns == ["tenant_id", "source", "ts", "seq", "value", "back", "next", "n"]


def test_the_state_before_is_the_last_rows_state(spark):
    rng = random.Random(6)
    rows = [(t, "x", START + datetime.timedelta(hours=rng.randrange(200)), 100 * t + k, rng.choice([*phone._KNOWN, "OTHER"])) for t in range(3) for k in range(80)]
    log = spark.createDataFrame(rows, "tenant_id long, device string, ts timestamp_ntz, seq long, event string")
    found = {}
    for r in phone.states(log).orderBy("tenant_id", "ts", "seq").collect():
        found.setdefault(r.tenant_id, []).append(r)
    for own in found.values():
        assert own[0].was_seen is None and own[0]["was"] is None and not own[0].was_down
        for a, b in zip(own, own[1:]):
            assert (b["was"], b.was_screen, b.was_unlocked, b.was_down, b.was_seen) == (a.active, a.screen, a.unlocked, a.down, True)


def test_edges_join_on_plain_columns(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    plan = carry.neighbour(df, ["tenant_id", "source"], ["ts", "seq"], {"back": "seq"})._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan
