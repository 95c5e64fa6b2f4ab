"""The channels and trials one event at a time, written for the tests alone."""

import math
import random

EPS, FLOOR = 1e-9, 1e-4


def distribution(tools):
    return {t: tools.count(t) / len(tools) for t in set(tools)}


def kl(p, q):
    return sum(x * math.log2((x + EPS) / (q.get(t, 0) + EPS)) for t, x in p.items() if x > 0)


def js(p, q):
    m = {t: (p.get(t, 0) + q.get(t, 0)) / 2 for t in {*p, *q}}
    return (kl(p, m) + kl(q, m)) / 2


def channel_scores(tools, dist, window=50, alpha=0.1, slack=0.5):
    """(jsd, ema, stat) of each event."""
    mean = -sum(p * math.log2(p) for p in dist.values())
    out, ema, stat = [], None, 0.0
    for i, t in enumerate(tools):
        score = None
        if i >= window - 1:
            score = js(distribution(tools[i - window + 1 : i + 1]), dist)
            ema = score if ema is None else alpha * score + (1 - alpha) * ema
        stat = max(0.0, stat - math.log2(dist.get(t, FLOOR)) - mean - slack)
        out.append((score, ema, stat))
    return out


def alarms(scores, div=0.15, cus=8.0, patience=5):
    found, over = {}, 0
    for i, (_, ema, stat) in enumerate(scores):
        over = over + 1 if ema is not None and ema > div else 0
        if over >= patience:
            found.setdefault("divergence", i)
        if stat > cus:
            found.setdefault("cusum", i)
    return found


def surprisal(tools, dist):
    return sum(-math.log2(dist.get(t, FLOOR)) for t in tools) / len(tools)


def per_run(runs, order, bad, margin):
    half = len(order) // 2
    loo = [surprisal(runs[r], distribution([t for o in order[:half] if o != r for t in runs[o]])) for r in order[:half]]
    threshold, dist = max(loo) * margin, distribution([t for r in order[:half] for t in runs[r]])
    hits = lambda ids: sum(surprisal(runs[r], dist) > threshold for r in ids)
    return threshold, hits(order[half:]), hits(bad)


def stream(runs, order, bad, window, margin):
    n = len(order)
    cat = lambda ids: [t for r in ids for t in runs[r]]
    dist, cal, null = distribution(cat(order[: n // 2])), cat(order[n // 2 : 3 * n // 4]), cat(order[3 * n // 4 :])
    s = channel_scores(cal, dist, window)
    div, cus = min(max([x[1] for x in s if x[1] is not None], default=0) * margin, 0.9), max(x[2] for x in s) * margin
    false = alarms(channel_scores(null, dist, window), div, cus)
    first = alarms(channel_scores(cal + cat(bad)[: len(null)], dist, window), div, cus)
    return {c: (c in false, first.get(c, -1) - len(cal) if first.get(c, -1) >= len(cal) else None) for c in ("divergence", "cusum")}


def zipf_tools(n, size=300, seed=1):
    rng = random.Random(seed)
    return rng.choices([f"t{i}" for i in range(size)], [1 / (i + 1) for i in range(size)], k=n)
