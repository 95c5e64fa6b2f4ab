"""Small streams of runs with a change in their middle, for the tests alone."""

import random

from veerline.schema import GOAL_SPEC, RECORD

#: Tools of a run by goal, with weights; the last one ends a run.
USUAL = {"mail": {"open": 5, "read": 4, "sort": 3, "reply": 2, "send": 1}, "ledger": {"load": 4, "match": 4, "sum": 3, "note": 1, "book": 2}}
UNUSUAL = {"dump": 5, "upload": 4, "open": 1, "load": 1}
KINDS = ("steady", "sudden", "slow", "passing", "tiring", "release", "skipping", "breaking")
BREAKS = ("duplicate_submission", "premature_abort", "false_success", "missing_progress")


def last(goal):
    return list(USUAL[goal])[-1]


def drawn(rng, weights, n):
    return rng.choices(list(weights), list(weights.values()), k=n)


def calls(rng, kind, share, goal, number):
    """(tool, params, status) of a run; share: how far the stream is beyond its change, from 0 to 1, or None before it."""
    weights, changed = USUAL[goal], share is not None
    if changed and (kind in ("sudden", "release") or kind == "passing" and share < 0.2 or kind == "slow" and rng.random() < share):
        weights = UNUSUAL
    if changed and kind == "skipping":
        weights = {t: w for t, w in weights.items() if t not in ("sort", "match")}
    n = 28 if changed and kind == "tiring" else rng.randint(9, 25)
    tools = [*drawn(rng, weights, n), last(goal)]
    failing = lambda i: 0.03 + (0.03 * i if changed and kind == "tiring" else 0)
    out = [(t, f"{number}.{i}", "error" if rng.random() < failing(i) else "ok") for i, t in enumerate(tools)]
    out[-1] = (*out[-1][:2], "ok")
    broken = BREAKS[number % 4] if changed and kind == "breaking" and number % 3 == 0 else None
    if broken == "duplicate_submission":
        out.append(out[-1])
    elif broken == "premature_abort":
        out = [out[0], (*out[1][:2], "abort")]
    elif broken is not None:
        rest = [c for c in out if c[0] != last(goal)]
        out = rest * 30 if broken == "missing_progress" else [*rest, ("note", "end", "ok")]
        out = [(t, f"{p}/{i}", "ok" if i == len(out) - 1 else s) for i, (t, p, s) in enumerate(out)]
    return out


def stream(kind, n, seed):
    """Rows of n runs, and the index of the first one after the change."""
    rng, rows, onset = random.Random(f"{kind} {seed}"), [], None
    for k in range(n):
        share = (k - n // 2) / (n - n // 2) if k >= n // 2 else None
        if share is not None and onset is None:
            onset = len(rows)
        goal = ("mail", "ledger")[k % 2]
        version = "two" if kind == "release" and share is not None else "one"
        for i, (tool, params, status) in enumerate(calls(rng, kind, share, goal, k)):
            rows.append((float(len(rows)), f"{kind}{k:04d}", "agent", "model", version, goal, i, tool, params, status, 1.0, {}))
    return rows, onset


def table(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def contracts(spark):
    return spark.createDataFrame([(g, last(g), 3, 200, 1) for g in USUAL], GOAL_SPEC)
