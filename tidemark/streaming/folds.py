"""Order-dependent rules as folds: one step function serves batch tables and streams alike.

A fold is (start, step): start() gives the state of a new key, a JSON-able dict; step(state, row) changes it and
returns the values of one output row, or None for no row. Batches are sorted by key and time and go through a task in
Arrow-sized pieces with the state carried along, so a long series needs no more memory than a short one.
"""

from __future__ import annotations

import json
import math
import typing
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.dynamics import Profile, share

Fold = tuple[Callable[[], dict], Callable[[dict, object], tuple | None]]


def over_table(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The fold over each key's rows in order. `schema` starts with the key; a null key is a key of its own."""
    start, step = fold
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                if state is None or k != last:
                    last, state = k, start()
                got = step(state, row)
                if got is not None:
                    out.append((k, *got))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def over_stream(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str, idle: str | None = None) -> DataFrame:
    """The same fold over a stream: each micro-batch is taken in order, the state is kept by key.

    Rows that come in a later micro-batch than their successors are folded late, as the rules say of late data.
    """
    start, step = fold
    names = StructType.fromDDL(schema).fieldNames()

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else start()
        rows = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        out = [(k[0], *got) for row in rows.itertuples(index=False) if (got := step(state, row)) is not None]
        held.update((json.dumps(state),))
        if idle:
            held.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def level_meter(*, fall_db: float = 20.0, hold_ms: float = 1200.0, rms_seconds: float = 0.3, clip: float = 32767 / 32768, floor_db: float = -120.0) -> Fold:
    """Rows (at_ms, seconds, peak, power) of blocks: a peak that falls 20 dB a second, one held 1200 ms first, a smoothed
    RMS, a clip latch. All start from silence, and a block counts for its own length."""

    def start():
        return {"peak": floor_db, "held": floor_db, "quiet": 0.0, "power": 0.0, "clipped": False}

    def db(x):
        return max(floor_db, 20 * math.log10(x)) if x > 0 else floor_db

    def step(s, r):
        block, fall = db(abs(r.peak)), fall_db * r.seconds
        s["peak"] = max(block, s["peak"] - fall, floor_db)
        if block >= s["held"]:
            s["held"], s["quiet"] = block, 0.0
        else:
            s["quiet"] += float(r.seconds)
            if s["quiet"] > hold_ms / 1000:
                s["held"] = max(s["peak"], s["held"] - fall)
        s["power"] += (r.power - s["power"]) * (-math.expm1(-r.seconds / rms_seconds) if rms_seconds > 0 else 1.0)
        s["clipped"] = bool(s["clipped"] or abs(r.peak) >= clip)
        return float(r.at_ms), s["peak"], s["held"], db(math.sqrt(max(0.0, s["power"]))), s["clipped"]

    return start, step


METER = "double, peak_db double, hold_db double, rms_db double, clipped boolean"


def late_bursts(*, fraction: float = 0.75) -> Fold:
    """Rows (due_us, slot_us, period_us): play, wait or drop against the device's clock, and how many were late so far.

    Dropped: more than 0.75 of a period late. Playable: due by half a period after the slot. Before the clock moves
    (no slot yet) everything waits.
    """

    def start():
        return {"late": 0, "dropped": 0}

    def step(s, r):
        if pd.isna(r.slot_us):
            return int(r.due_us), "wait", s["late"], s["dropped"]
        due, slot, period = int(r.due_us), int(r.slot_us), int(r.period_us)
        if due < slot:
            s["late"] += 1
        if due < slot - int(fraction * period):
            s["dropped"] += 1
            return due, "drop", s["late"], s["dropped"]
        return due, "play" if due <= slot + period // 2 else "wait", s["late"], s["dropped"]

    return start, step


def queue_model(*, capacity: int, rate_per_ms: float) -> Fold:
    """Rows (at_ms, amount): a queue that drains at a rate; headroom or dry time at each arrival, underruns so far.

    The first block of a play isn't an underrun; the fill is kept between 0 and the capacity.
    """

    def start():
        return {"at": None, "queued": 0.0, "underruns": 0, "dry_ms": 0.0, "least": None}

    def step(s, r):
        drained = 0.0 if s["at"] is None else (r.at_ms - s["at"]) * rate_per_ms
        room = s["queued"] - drained
        if s["at"] is not None:
            if room < 0:
                s["underruns"] += 1
                s["dry_ms"] += -room / rate_per_ms
            s["least"] = room if s["least"] is None else min(s["least"], room)
        s["queued"] = min(float(capacity), max(0.0, room) + r.amount)
        s["at"] = float(r.at_ms)
        return float(r.at_ms), s["queued"], s["underruns"], s["dry_ms"], s["least"]

    return start, step


def governor(*, step_us: int = 50_000, window: int = 20, up: float = 0.70, down: float = 0.60, late_us: int = 15_000, most_bad: int = 4, dwell_us: int = 10_000_000, most_us: int = 160_000_000, flap_us: int = 60_000_000, grace_us: int = 2_000_000) -> Fold:
    """Rows (at_us, cost_us, late_us, missed) of updates: at the fast rate or the slow one, by a full window of updates.

    Fast falls to slow if the window's mean cost is over `up` of a step or `most_bad` updates were late or after missed
    steps. Slow rises after the dwell, with a mean under `down` and no bad update. A change empties the window. A fall
    within `flap_us` of a rise doubles the dwell, up to a limit; that long at the fast rate puts it back. The first
    `grace_us` are not judged.
    """

    def start():
        return {"n": 0, "from": None, "since": None, "rose": None, "slow": False, "dwell": dwell_us, "costs": [], "bad": [], "falls": 0, "rises": 0}

    def change(s, now, slow):
        s.update({"slow": slow, "since": now, "costs": [], "bad": []})
        s["falls" if slow else "rises"] += 1

    def step(s, r):
        now = int(r.at_us)
        s["n"] += 1
        s["from"] = now if s["from"] is None else s["from"]
        if now - s["from"] >= grace_us:
            s["costs"] = [*s["costs"], max(0.0, float(r.cost_us))][-window:]
            s["bad"] = [*s["bad"], int(r.late_us > late_us or r.missed > 0)][-window:]
            s["since"] = now if s["since"] is None else s["since"]
            full, bad, load = len(s["costs"]) == window, sum(s["bad"]), sum(s["costs"]) / len(s["costs"]) / step_us
            if s["slow"]:
                if full and bad == 0 and load < down and now - s["since"] >= s["dwell"]:
                    s["rose"] = now
                    change(s, now, False)
            else:
                if now - s["since"] >= flap_us:
                    s["dwell"] = dwell_us
                if full and (load > up or bad >= most_bad):
                    if s["rose"] is not None and now - s["rose"] < flap_us:
                        s["dwell"] = min(most_us, 2 * s["dwell"])
                    change(s, now, True)
        return now, s["n"], s["slow"], s["dwell"], s["falls"], s["rises"]

    return start, step


GOVERNOR = "at_us long, updates long, slow boolean, dwell_us long, falls long, rises long"


def range_control(profile: Profile, block_ms: float) -> Fold:
    """Rows (at_ms, target_db), a block each: a gain that starts at 0 dB and goes to its target with the profile's attack
    downwards and its release upwards."""
    attack, release = share(profile.attack_ms, block_ms), share(profile.release_ms, block_ms)

    def start():
        return {"gain": 0.0}

    def step(s, r):
        s["gain"] += (r.target_db - s["gain"]) * (attack if r.target_db < s["gain"] else release)
        return float(r.at_ms), s["gain"]

    return start, step


def heavy_control(step_db: float) -> Fold:
    """Rows (at_ms, target_db), a frame each: a gain that falls at once and rises by a step; the first target sets it."""

    def start():
        return {"gain": None}

    def step(s, r):
        s["gain"] = float(r.target_db) if s["gain"] is None else min(float(r.target_db), s["gain"] + step_db)
        return float(r.at_ms), s["gain"]

    return start, step


def resampler(up: int, down: int, *, stop_db: float = 100.0, passed: float = 0.86) -> Fold:
    """Rows (samples) of blocks of any sizes: (first, samples) of what each completes at up / down times the rate.

    After n samples there are floor(n up / down) of the new rate, the same however the blocks are cut: a polyphase
    low-pass (Kaiser window, `passed` of the lower rate's band), with silence before the first sample. The output lags by
    half the filter; the state is what of the input the filter can still see.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    low = min(1.0, up / down)  # the lower of both bands, in halves of the input's rate
    cut, width = low * (1 + passed) / 2, low * (1 - passed)
    half = math.ceil((stop_db - 8) / (2.285 * math.pi * width) / 2)
    shape = np.i0(0.1102 * (stop_db - 8.7) * np.sqrt(np.maximum(0.0, 1 - np.linspace(-1, 1, 2 * half * up + 1) ** 2)))
    taps = np.sinc(cut * np.arange(-half * up, half * up + 1) / up) * shape
    # each phase passes a constant as it is
    phases = [(p := taps[k::up]) / p.sum() for k in range(up)]

    def start():
        return {"n": 0, "tail": []}

    def step(s, r):
        x = np.concatenate([s["tail"], np.asarray(r.samples if r.samples is not None else [], float)])
        n0, n1 = s["n"], s["n"] + len(x) - len(s["tail"])
        first, last = n0 * up // down, n1 * up // down
        base = n0 - len(s["tail"])  # the input sample of x[0]
        out = []
        for m in range(first, last):
            at, phase = divmod(m * down, up)  # the newest input sample that is seen, and how far on
            h = phases[phase]
            k = at - np.arange(len(h)) - base
            out.append(float(h @ np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, max(0, len(x) - 1))], 0.0)) if len(x) else 0.0)
        s.update({"n": n1, "tail": x[-(2 * half + 1) - down :].tolist()})
        return first, out

    return start, step


def notes(*, split_cents: float = 70.0, bridge: int = 3, least: int = 6) -> Fold:
    """Rows (grid_idx, hz) with hz 0 for silence, ended by a row with a negative hz: notes as they end.

    A point more than `split_cents` from the median of the note so far starts a new one; up to `bridge` silent points
    don't end it; notes under `least` points are dropped.
    """

    def start():
        return {"from": None, "to": None, "hz": []}

    def close(s):
        got = None
        if s["from"] is not None and s["to"] - s["from"] + 1 >= least:
            x = sorted(s["hz"])
            got = s["from"], s["to"], (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        s.update({"from": None, "to": None, "hz": []})
        return got

    def step(s, r):
        if r.hz < 0:
            return close(s)
        if r.hz == 0:
            return close(s) if s["from"] is not None and r.grid_idx - s["to"] > bridge else None
        out = None
        if s["from"] is not None:
            x = sorted(s["hz"])
            middle = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
            if abs(1200 * math.log2(r.hz / middle)) > split_cents or r.grid_idx - s["to"] > bridge + 1:
                out = close(s)
        if s["from"] is None:
            s["from"] = int(r.grid_idx)
        s["to"] = int(r.grid_idx)
        s["hz"].append(float(r.hz))
        return out

    return start, step


def clock_sync(*, burst: int = 8, settle: int = 8, slack_us: int = 1000) -> Fold:
    """Rows (offset_us, error_us): of each burst the sample with the least error counts; the clock is settled when,
    after enough bursts, one lies within the slack of the one before."""

    def start():
        return {"n": 0, "best": None, "bursts": 0, "before": None, "settled": False}

    def step(s, r):
        s["n"] += 1
        if s["best"] is None or r.error_us < s["best"][1]:
            s["best"] = [int(r.offset_us), int(r.error_us)]
        if s["n"] < burst:
            return None
        offset, error = s["best"]
        s["bursts"] += 1
        s["settled"] = bool(s["settled"] or s["bursts"] > settle and abs(offset - s["before"]) <= slack_us)
        s.update({"n": 0, "best": None, "before": offset})
        return s["bursts"], offset, error, s["settled"]

    return start, step


def playhead(*, most: int = 16) -> Fold:
    """Rows (at_us, position_ms, speed, is_query): anchors are kept in time order, the oldest go beyond `most`, one at
    the same time replaces; a query gives the place by the latest anchor at or before it, not under 0, or null."""

    def start():
        return {"anchors": []}

    def step(s, r):
        if not r.is_query:
            kept = [a for a in s["anchors"] if a[0] != int(r.at_us)]
            s["anchors"] = sorted([*kept, [int(r.at_us), float(r.position_ms), float(r.speed)]])[-most:]
            return None
        before = [a for a in s["anchors"] if a[0] <= r.at_us]
        if not before:
            return int(r.at_us), None
        at, position, speed = before[-1]
        return int(r.at_us), max(0.0, position + (r.at_us - at) / 1000 * speed)

    return start, step


def silence_watch(*, timeout_ms: float = 3000.0) -> Fold:
    """Rows (at_ms): how long the series was silent before each, and whether that was past the timeout."""

    def start():
        return {"at": None}

    def step(s, r):
        quiet = 0.0 if s["at"] is None else r.at_ms - s["at"]
        s["at"] = float(r.at_ms)
        return float(r.at_ms), quiet, bool(quiet > timeout_ms)

    return start, step


def in_order(*, most: int = 32) -> Fold:
    """Rows (at_ms, first, last) of byte ranges [first, last): the bytes that have arrived without a gap from the first
    range on; ranges past a gap and repeats are ignored, the latest `most` steps are kept in the state."""

    def start():
        return {"end": None, "steps": []}

    def step(s, r):
        if s["end"] is None:
            s["end"] = int(r.first)
        if r.first > s["end"] or r.last <= s["end"]:
            return float(r.at_ms), s["end"], False
        s["end"] = int(r.last)
        s["steps"] = [*s["steps"], [s["end"], float(r.at_ms)]][-most:]
        return float(r.at_ms), s["end"], True

    return start, step


def drift_servo(*, gain: float = 0.01, smooth: float = 0.1, low: float = 0.5, high: float = 2.0, limit: float = 0.05) -> Fold:
    """Rows (at_ms, error): a resampling ratio near 1 that follows a clamped, smoothed share of the fill error."""

    def start():
        return {"trim": 0.0}

    def step(s, r):
        want = max(-limit, min(limit, gain * r.error))
        s["trim"] += smooth * (want - s["trim"])
        return float(r.at_ms), max(low, min(high, 1 + s["trim"]))

    return start, step


def hold_first() -> Fold:
    """Rows (at_ms): each unit as the next one comes; the first of a play so waits for the second."""

    def start():
        return {"held": None}

    def step(s, r):
        out, s["held"] = s["held"], float(r.at_ms)
        return None if out is None else (out, float(r.at_ms))

    return start, step


def power_average(*, tau_s: float, silent_db: float = -120.0) -> Fold:
    """Rows (at_ms, db): the level whose power follows the input's with a time constant; the first row sets it."""

    def start():
        return {"at": None, "power": 0.0}

    def step(s, r):
        p = 0.0 if r.db <= silent_db else 10 ** (r.db / 10)
        s["power"] += (p - s["power"]) * (1.0 if s["at"] is None else -math.expm1(-(r.at_ms - s["at"]) / 1000 / tau_s))
        s["at"] = float(r.at_ms)
        return float(r.at_ms), 10 * math.log10(s["power"]) if s["power"] > 0 else silent_db

    return start, step


def ballistic(*, fall_db: float, hold_s: float, peak_fall_db: float, silent_db: float = -120.0) -> Fold:
    """Rows (at_ms, db): a bar that rises at once and falls slowly, and a peak that is held before it falls."""

    def start():
        return {"at": None, "level": silent_db, "peak": silent_db, "quiet": 0.0}

    def step(s, r):
        dt = 0.0 if s["at"] is None else (r.at_ms - s["at"]) / 1000
        level = max(float(r.db), s["level"] - fall_db * dt)
        sunk = s["peak"] - (peak_fall_db * dt if s["quiet"] >= hold_s else 0.0)
        quiet = 0.0 if level >= s["peak"] else s["quiet"] + dt
        s.update({"at": float(r.at_ms), "level": level, "peak": max(level, sunk), "quiet": quiet})
        return float(r.at_ms), level, s["peak"]

    return start, step


def follower(*, most: int = 16) -> Fold:
    """Rows (at_us, kind, item, position_ms, speed): a document (kind 'document') makes its item the one that is followed
    and forgets the anchors; an 'anchor' of another item is ignored; 'clear' forgets the anchors, 'reset' the item too;
    a 'query' gives the item and the place in it, or nulls."""
    _, place = playhead(most=most)

    def start():
        return {"item": None, "anchors": []}

    def step(s, r):
        if r.kind in ("document", "clear", "reset"):
            s["anchors"] = []
            if r.kind != "clear":
                s["item"] = int(r.item) if r.kind == "document" else None
            return None
        if r.kind == "anchor":
            return None if s["item"] is None or r.item != s["item"] else place(s, _Anchor(r.at_us, r.position_ms, r.speed, False))
        at, position = place(s, _Anchor(r.at_us, 0.0, 0.0, True))
        return at, s["item"], position

    return start, step


class _Anchor(typing.NamedTuple):
    at_us: int
    position_ms: float
    speed: float
    is_query: bool


def snapshots(*, every: int) -> Fold:
    """Rows (frame, level, heard): a snapshot of the latest level at each multiple of `every` frames is held until the
    heard position has reached it; each row gives the newest that was released, or nulls.

    The multiples that one row reaches share its level and are held as one stretch, [first, last, level], so a row costs
    the same however far its frame is from the one before or from 0. Stretches before `at` have been released.
    """

    def start():
        return {"next": every, "held": [], "at": 0, "out": [None, None]}

    def step(s, r):
        held = s["held"]
        if r.frame >= s["next"]:
            last = int(r.frame // every) * every
            held.append([s["next"], last, float(r.level)])
            s["next"] = last + every
        while s["at"] < len(held) and held[s["at"]][0] <= r.heard:
            stretch = held[s["at"]]
            s["out"] = [min(stretch[1], int(r.heard // every) * every), stretch[2]]
            stretch[0] = s["out"][0] + every
            s["at"] += stretch[0] > stretch[1]
        if 2 * s["at"] > len(held):
            del held[: s["at"]]
            s["at"] = 0
        return int(r.frame), s["out"][0], s["out"][1]

    return start, step
