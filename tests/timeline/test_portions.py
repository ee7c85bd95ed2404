"""Buckets are taken in portions of a bounded number of events."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc

from tidemark.operators import build


def test_results_take_buckets_in_pieces(monkeypatch):
    rng = random.Random(6)
    t0 = datetime(2026, 1, 1)
    keys = sorted(rng.randrange(30) for _ in range(3000))
    times = pa.array([t0 + timedelta(minutes=i) for i in range(3000)], pa.timestamp("us"))
    day = pa.array([t0.date()] * 3000)
    rows = pa.table([pa.array(keys), pa.array(["pc"] * 3000), day, times, pa.array(range(3000)), pa.array([rng.random() < 0.5 for _ in keys]), pa.array(["c"] * 3000), pa.array([rng.choice("ab") for _ in keys])], ["tenant_id", "source", "day", "ts", "id", "is_start", "category", "name"])
    found = pa.Table.from_batches(build._effects(iter(rows.to_batches()))).combine_chunks()
    entered = found.append_column("entry", pa.nulls(found.num_rows, build._STATE_TYPE)).append_column("final", pa.array([True] * found.num_rows)).to_batches()
    assert len(entered) == 1
    rows_of = lambda: sorted(str(r) for b in build._results(iter(entered)) for r in b.to_pylist())
    whole = rows_of()
    monkeypatch.setattr(build, "PORTION", 250)
    pieces = list(build._pieces(entered[0]))
    assert len(pieces) > 5 and max(len(p.column("ts").flatten()) for p in pieces) <= 250 + build.BUCKET
    assert rows_of() == whole and sum(p.num_rows for p in pieces) == found.num_rows


def test_buckets_begin_where_their_key_and_day_say(monkeypatch):
    """An import takes buckets of some key-days twice, in streams with other key-days around them."""
    rng = random.Random(7)
    t0 = datetime(2026, 1, 1)
    keys = sorted(rng.randrange(12) for _ in range(3000))
    columns = [keys, ["pc"] * 3000, [t0.date()] * 3000, [t0 + timedelta(seconds=i) for i in range(3000)], list(range(3000)), [rng.random() < 0.5 for _ in keys], ["c"] * 3000, [rng.choice("ab") for _ in keys]]
    types = [pa.int64(), pa.string(), pa.date32(), pa.timestamp("us"), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    rows = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tenant_id", "source", "day", "ts", "id", "is_start", "category", "name"])
    last = rows.filter(pc.greater(rows["tenant_id"], 2))
    monkeypatch.setattr(build, "BUCKET", 100)
    shown = lambda r: str((r["tenant_id"], r["part"], r["id"], r["idle"], sorted(str(x) for x in zip(r["labels"], r["after"], strict=True))))
    taken = lambda table, size: sorted(shown(r) for b in build._effects(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist() if r["tenant_id"] > 2)
    whole = taken(rows, 3000)
    assert max(len(b["id"]) for b in pa.Table.from_batches(build._effects(iter(rows.to_batches()))).to_pylist()) == 100
    monkeypatch.setattr(build, "PORTION", 330)
    assert taken(rows, 37) == whole and taken(last, 53) == whole and taken(last, 3000) == whole
