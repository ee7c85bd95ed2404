"""Signal reports against row-by-row machines on random logs."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import phone, signals

LOG = "tenant_id long, seq long, ts timestamp_ntz, event string"
T0 = datetime(2026, 8, 1)
START, END = T0 + timedelta(hours=9), T0 + timedelta(hours=40)


def made(seed, n=150):
    rng = random.Random(seed)
    known = [*phone.SIGNALS["screen"], *phone.SIGNALS["keyguard"], "DEVICE_SHUTDOWN", "DEVICE_STARTUP", "OTHER"]
    rows = [(0, k, T0 + timedelta(minutes=20 * k + rng.choice([0, 0, 20])), rng.choice(known)) for k in range(n)]
    return [*rows, (1, 1, T0, "SCREEN_INTERACTIVE"), (2, 1, T0 + timedelta(days=9), "SCREEN_INTERACTIVE"), (3, 5, END, "KEYGUARD_SHOWN")]


def ordered(rows, tenant, events=None):
    return sorted((r for r in rows if r[0] == tenant and (events is None or r[3] in events)), key=lambda r: (r[2], r[1]))


def cut(tenant, output, seq, until_seq, a, b, reason):
    a, b = max(a, START), min(b, END)
    return [(tenant, output, seq, until_seq, a, b, reason)] if a < b else []


def one_signal(rows, tenant, on, off, first):
    state, begun, out = first, None, []
    for _, seq, ts, event in ordered(rows, tenant, (on, off)):
        if ts > END:
            break
        if state == (event == on):
            out.append((tenant, "repeat", seq, None, ts, ts, f"repeated_{event.lower()}"))
            continue
        state = event == on
        if state:
            begun = (seq, ts)
        elif begun:
            out += cut(tenant, "interval", begun[0], seq, begun[1], ts, f"{on}_to_{off}")
            begun = None
    return out + (cut(tenant, "interval", begun[0], None, begun[1], END, "open_at_range_end") if begun else [])


def window(rows, tenant):
    screen = unlocked = None
    down, value, since, out = False, None, (None, datetime.min), []
    log = [r for r in ordered(rows, tenant) if r[3] != "OTHER" and r[2] <= END]
    for _, seq, ts, event in log:
        before = (screen, unlocked, down)
        if event.startswith("SCREEN"):
            screen = event == "SCREEN_INTERACTIVE"
        elif event.startswith("KEYGUARD"):
            unlocked = event == "KEYGUARD_HIDDEN"
        else:
            down = event == "DEVICE_SHUTDOWN"
        if before == (screen, unlocked, down):
            out.append((tenant, "anomaly", seq, None, ts, ts, "startup_without_shutdown" if event == "DEVICE_STARTUP" else f"repeated_{event.lower()}"))
        now = False if down else None if screen is None or unlocked is None else screen and unlocked
        if now != value:
            if value is None:
                out += cut(tenant, "unknown", since[0], seq, since[1], ts, "state_unknown")
            elif value:
                out += cut(tenant, "interval", since[0], seq, since[1], ts, f"stopped_by_{event.lower()}")
            value, since = now, (seq, ts)
    if log and value is None:
        out += cut(tenant, "unknown", since[0], None, since[1], END, "state_unknown_at_range_end")
    elif value:
        out += cut(tenant, "interval", since[0], None, since[1], END, "stopped_by_range_end")
    return out


def pairing(rows, tenant, form):
    on, off = phone.SIGNALS["screen"]
    opened, out = None, []
    for _, seq, ts, event in ordered(rows, tenant, (on, off)):
        if event == on and opened:
            out.append((tenant, form, "duplicate_start", seq, None, ts, None, opened[0]))
            opened = (seq, ts) if form == "repaired" else opened
        elif event == on:
            opened = (seq, ts)
        elif opened:
            out.append((tenant, form, "interval", opened[0], seq, opened[1], ts, None))
            opened = None
        else:
            out.append((tenant, form, "orphan_end", seq, None, ts, None, None))
    return out + ([(tenant, form, "open_at_end", opened[0], None, opened[1], None, None)] if opened else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_reports(spark, seed):
    rows = made(seed)
    log = spark.createDataFrame(rows, LOG).repartition(3)
    same = lambda df, want: sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) > 20
    on, off = phone.SIGNALS["keyguard"]
    assert same(signals.signal_report(log, on, off, START, END), [x for t in range(4) for x in one_signal(rows, t, on, off, None)])
    assert same(signals.shutdown_report(log, START, END), [x for t in range(4) for x in one_signal(rows, t, "DEVICE_SHUTDOWN", "DEVICE_STARTUP", False)])
    assert same(signals.window_report(log, START, END), [x for t in range(4) for x in window(rows, t)])
    assert same(signals.pairing_scan(log, "screen"), [x for t in range(4) for f in ("raw", "repaired") for x in pairing(rows, t, f)])


def test_empty_log(spark):
    none = spark.createDataFrame([], LOG)
    for report in (signals.window_report(none, START, END), signals.shutdown_report(none, START, END), signals.pairing_scan(none, "screen")):
        assert report.count() == 0
