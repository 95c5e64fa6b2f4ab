"""Trials of classes of runs, sweeps and fingerprints over the driver's tables, each with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from . import experiments as E
from . import records as V
from . import trials
from .queries import _BJ, _BLK, _SEG, _SES, js, query, r6
from .records import ORDER, RECORDS

TRIALS, TOOLS = 3, ("click", "error", "purchase", "signup", "view")


def scored_sql(name: str, events: str, dist: str, keys: str, on: str, window: int, slack: float = 0.5) -> str:
    """Tables that end in one of the name: keys, event_index, ema, stat. events: keys, event_index, tool; dist: on, tool, q."""
    n, last = name, window - 1
    counts = ", ".join(f"sum((tool = '{t}')::INT) OVER w AS n_{t}" for t in TOOLS)
    return f"""{n}h AS (SELECT {on}, -sum(q * log2(q)) AS h FROM {dist} GROUP BY {on}),
{n}v AS (SELECT {on}, tool, coalesce(q, 0) AS q FROM (SELECT DISTINCT {on} FROM {dist}) CROSS JOIN (SELECT unnest({list(TOOLS)}) AS tool) LEFT JOIN {dist} USING ({on}, tool)),
{n}w AS (SELECT {keys}, event_index, {counts} FROM {events} WINDOW w AS (PARTITION BY {keys} ORDER BY event_index ROWS {last} PRECEDING)),
{n}u AS (SELECT {keys}, event_index, unnest({list(TOOLS)}) AS tool, unnest([{', '.join(f'n_{t}' for t in TOOLS)}]) / {window}::DOUBLE AS p FROM {n}w WHERE event_index >= {last}),
{n}j AS (SELECT {keys}, event_index, event_index - {last} AS k, sum({js('p', 'q')}) AS jsd FROM {n}u JOIN {n}v USING ({on}, tool) GROUP BY {keys}, event_index),
{n}m AS (SELECT {keys}, event_index, pow(0.9, k) * sum(CASE WHEN k = 0 THEN 1 ELSE 0.1 END * jsd * pow(0.9, -k)) OVER (PARTITION BY {keys} ORDER BY event_index) AS ema FROM {n}j),
{n}b AS (SELECT {keys}, event_index, sum(-log2(coalesce(q, 1e-4)) - h - {slack}) OVER (PARTITION BY {keys} ORDER BY event_index) AS c FROM {events} JOIN {n}h USING ({on}) LEFT JOIN {dist} USING ({on}, tool)),
{n}c AS (SELECT {keys}, event_index, c - least(0, min(c) OVER (PARTITION BY {keys} ORDER BY event_index)) AS stat FROM {n}b),
{n} AS (SELECT {keys}, event_index, ema, stat FROM {n}c LEFT JOIN {n}m USING ({keys}, event_index))"""


def cells_sql(by: str, run: str, window: int, margin: float) -> str:
    """Tables from pm (benign: by, run_id, pos, n), ij (attacks: by, run_id, pos) and rr (records, joined on run) to ce, the cells
    of stream trials."""
    return f"""st AS (SELECT {by}, CASE WHEN pos < n // 2 THEN 0 WHEN pos < 3 * n // 4 THEN 1 ELSE 2 END AS part, pos, run_id, step_index, tool FROM pm JOIN rr USING ({run})),
sx AS (SELECT {by}, part, tool, row_number() OVER (PARTITION BY {by}, part ORDER BY pos, run_id, step_index) - 1 AS event_index FROM st),
sz AS (SELECT {by}, count(*) FILTER (part = 1) AS onset, count(*) FILTER (part = 2) AS horizon FROM sx GROUP BY {by} HAVING count(*) FILTER (part = 1) > {window} AND count(*) FILTER (part = 2) > {window}),
dq AS (SELECT {by}, tool, count(*) / sum(count(*)) OVER (PARTITION BY {by})::DOUBLE AS q FROM sx WHERE part = 0 GROUP BY {by}, tool),
ax AS (SELECT {by}, tool, row_number() OVER (PARTITION BY {by} ORDER BY pos, run_id, step_index) - 1 AS event_index FROM ij JOIN rr USING ({run})),
ev AS (SELECT {by}, 'null' AS kind, event_index, tool FROM sx JOIN sz USING ({by}) WHERE part = 2 UNION ALL SELECT {by}, 'attack', event_index, tool FROM sx JOIN sz USING ({by}) WHERE part = 1
  UNION ALL SELECT {by}, 'attack', event_index + onset, tool FROM ax JOIN sz USING ({by}) WHERE event_index < horizon),
{scored_sql('sc', 'ev', 'dq', by + ', kind', by, window)},
li AS (SELECT {by}, least(greatest(0, coalesce(max(ema), 0)) * {margin}, 0.9) AS dt, greatest(0, coalesce(max(stat), 0)) * {margin} AS ct FROM sc JOIN sz USING ({by}) WHERE kind = 'attack' AND event_index < onset GROUP BY {by}),
ht AS (SELECT {by}, kind, event_index, onset, sum(coalesce(ema > dt, false)::INT) OVER (PARTITION BY {by}, kind ORDER BY event_index ROWS 4 PRECEDING) = 5 AS a, stat > ct AS b FROM sc JOIN sz USING ({by}) JOIN li USING ({by})),
hc AS (SELECT {by}, kind, event_index, onset, 'divergence' AS channel FROM ht WHERE a UNION ALL SELECT {by}, kind, event_index, onset, 'cusum' FROM ht WHERE b),
fo AS (SELECT {by}, channel, max((kind = 'null')::INT) AS nul, min(event_index - onset) FILTER (kind = 'attack') AS fst, max((kind = 'attack' AND event_index >= onset)::INT) AS aft FROM hc GROUP BY {by}, channel),
ce AS (SELECT {by}, channel, coalesce(nul = 1, false) AS false_alarm, fst AS first_alarm, coalesce(fst >= 0, false) AS detected, CASE WHEN fst >= 0 THEN fst END AS delay, coalesce(aft = 1, false) AS detected_after_onset, horizon, dt AS div_threshold
  FROM sz JOIN li USING ({by}) CROSS JOIN (SELECT unnest(['divergence', 'cusum']) AS channel) LEFT JOIN fo USING ({by}, channel))"""


def classes_sql(keys: str, margin: float, window: int, least_clean: int, least_bad: int) -> str:
    """Tables from cl (keys, run_id, bad) and rr (keys, run_id, step_index, tool) to rt: keys, kind, detection, false."""
    k, run, by = f"{keys}, ", f"{keys}, run_id", f"{keys}, trial"
    return f"""us AS (SELECT {k} run_id, bad FROM (SELECT *, sum(bad::INT) OVER (PARTITION BY {keys}) AS nb, sum((NOT bad)::INT) OVER (PARTITION BY {keys}) AS nc FROM cl SEMI JOIN rr USING ({run})) WHERE nb >= {least_bad} AND nc >= {least_clean}),
od AS (SELECT {k} bad, trial, run_id, row_number() OVER (PARTITION BY {k} bad, trial ORDER BY md5(trial || ':' || run_id), run_id) - 1 AS pos, count(*) OVER (PARTITION BY {k} bad, trial) AS n FROM us, (SELECT unnest(range({TRIALS})) AS trial)),
pm AS (SELECT * EXCLUDE (bad) FROM od WHERE NOT bad), ij AS (SELECT * EXCLUDE (bad, n) FROM od WHERE bad),
{cells_sql(by, run, window, margin)},
x AS (SELECT {by}, run_id, tool, count(*) AS n FROM (SELECT {by}, run_id FROM pm WHERE pos < n // 2) JOIN rr USING ({run}) GROUP BY ALL),
xt AS (SELECT *, sum(n) OVER (PARTITION BY {by}, tool) AS tn, sum(n) OVER (PARTITION BY {by}) AS an, sum(n) OVER (PARTITION BY {by}, run_id) AS rn FROM x),
xl AS (SELECT {by}, run_id, sum(n * -log2(coalesce(CASE WHEN tn > n AND an > rn THEN (tn - n) / (an - rn)::DOUBLE END, 1e-4))) / sum(n) AS s FROM xt GROUP BY {by}, run_id),
xh AS (SELECT {by}, max(s) * {margin} AS threshold FROM xl GROUP BY {by}), xd AS (SELECT {by}, tool, any_value(tn) / any_value(an)::DOUBLE AS p FROM xt GROUP BY {by}, tool),
xc AS (SELECT {by}, run_id, bad FROM od WHERE bad OR pos >= n // 2),
xz AS (SELECT {by}, run_id, bad, avg(-log2(coalesce(p, 1e-4))) AS s FROM xc JOIN rr USING ({run}) LEFT JOIN xd USING ({by}, tool) GROUP BY {by}, run_id, bad),
xr AS (SELECT {keys}, sum((bad AND s > threshold)::INT) / sum(bad::INT)::DOUBLE AS detection, sum((NOT bad AND s > threshold)::INT) / sum((NOT bad)::INT)::DOUBLE AS fpr FROM xz JOIN xh USING ({by}) GROUP BY {keys}),
dd AS (SELECT {k} bad, tool, count(*) / sum(count(*)) OVER (PARTITION BY {k} bad)::DOUBLE AS v FROM us JOIN rr USING ({run}) GROUP BY {k} bad, tool),
dm AS (SELECT {k} tool, sum(CASE WHEN bad THEN 0 ELSE v END) AS p, sum(CASE WHEN bad THEN v ELSE 0 END) AS q FROM dd GROUP BY {k} tool),
rt AS (SELECT {k} 'per run' AS kind, round(detection, 6) AS detection, round(fpr, 6) AS false FROM xr
  UNION ALL SELECT {k} 'stream ' || channel, round(avg(detected::INT), 6), round(avg(false_alarm::INT), 6) FROM ce GROUP BY {k} channel
  UNION ALL SELECT {k} 'divergence of classes', round(sum({js('p', 'q')}), 6), NULL FROM dm GROUP BY {keys}
  UNION ALL SELECT {k} 'tools', count(*)::DOUBLE, NULL FROM dm GROUP BY {keys})"""


def _rows(found, keys=()):
    """The tables of two_classes as one."""
    none = F.lit(None).cast("double").alias("false")
    parts = [found["per_run"].select(*keys, F.lit("per run").alias("kind"), r6("detection", "detection"), r6("fpr", "false")),
             found["stream"].select(*keys, F.concat(F.lit("stream "), "channel").alias("kind"), r6("detection", "detection"), r6("false_alarm", "false")),
             found["jsd"].select(*keys, F.lit("divergence of classes").alias("kind"), r6("jsd", "detection"), none),
             found["vocabulary"].select(*keys, F.lit("tools").alias("kind"), F.col("vocabulary").cast("double").alias("detection"), none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- stream trials: runs of goal g3 stand for the injected ones ---

_G3 = RECORDS + f""", rr AS (SELECT run_id, step_index, tool FROM r), i0 AS (SELECT DISTINCT run_id, goal_id = 'g3' AS bad FROM r),
od AS (SELECT bad, trial, run_id, row_number() OVER (PARTITION BY bad, trial ORDER BY md5(trial || ':' || run_id), run_id) - 1 AS pos, count(*) OVER (PARTITION BY bad, trial) AS n FROM i0, (SELECT unnest(range({TRIALS})) AS trial)),
pm AS (SELECT * EXCLUDE (bad) FROM od WHERE NOT bad), ij AS (SELECT * EXCLUDE (bad, n) FROM od WHERE bad), """


def _classes(spark, sf):
    r = V.records(spark, sf)
    ids = r.select("run_id", "goal_id").distinct()
    order = lambda c: trials.hashed(ids.where(c).select("run_id"), TRIALS)
    return r, order("goal_id <> 'g3'"), order("goal_id = 'g3'")


@query(_G3 + cells_sql("trial", "run_id", 50, 1.2) + """ SELECT CAST(trial AS INTEGER) AS trial, channel, false_alarm, CAST(first_alarm AS BIGINT) AS first_alarm, detected, CAST(delay AS BIGINT) AS delay, detected_after_onset, horizon, round(div_threshold, 6) AS div_threshold FROM ce""")
def stream_trials(spark, sf):
    return trials.stream_trials(*_classes(spark, sf), 50, 1.2).withColumn("div_threshold", F.round("div_threshold", 6))


def _swept(w: int) -> str:
    return f"""(WITH {cells_sql('trial', 'run_id', w, 1.2)} SELECT {w} AS "window", channel, count(*) AS cells, round(avg(detected::INT), 6) AS detection, round(avg(false_alarm::INT), 6) AS false_alarm,
CAST(floor(median(delay)) AS BIGINT) AS median_delay, round(median(div_threshold), 6) AS div_threshold_median, CAST(sum((div_threshold >= 0.9)::INT) AS BIGINT) AS n_capped FROM ce GROUP BY channel)"""


WINDOWS = (50, 200, 800, 3200)


@query(_G3.rstrip(", ") + " UNION ALL ".join(" SELECT * FROM " + _swept(w) for w in WINDOWS))
def window_sweep(spark, sf):
    found = E.window_sweep(*_classes(spark, sf), WINDOWS, 1.2)
    return found.select("window", "channel", "cells", r6("detection", "detection"), r6("false_alarm", "false_alarm"), "median_delay", r6("div_threshold_median", "div_threshold_median"), "n_capped")


# --- two classes of runs, with and without keys ---

_WEEK = "CAST(split_part(run_id, '-w', 2) AS INTEGER)"


def _week():
    return F.substring_index("run_id", "-w", -1).cast("int")


@query(RECORDS + f", rr AS (SELECT 0 AS one, run_id, step_index, tool FROM r), cl AS (SELECT DISTINCT 0 AS one, run_id, goal_id = 'g3' AS bad FROM r), {classes_sql('one', 1.05, 50, 8, 10)} SELECT * EXCLUDE (one) FROM rt")
def two_class_rates(spark, sf):
    r = V.records(spark, sf)
    labels = r.select("run_id", (F.col("goal_id") == "g3").alias("bad")).distinct()
    return _rows(E.two_classes(r, labels, TRIALS, 1.05))


@query(RECORDS + f""", la AS (SELECT DISTINCT run_id, 'p' || (CAST(substr(agent_id, 2) AS BIGINT) % 2) AS pipeline, goal_id AS suite, {_WEEK} % 3 = 1 AS attacked, {_WEEK} % 6 = 1 AS success FROM r),
rr AS (SELECT pipeline, suite, run_id, step_index, tool FROM r JOIN la USING (run_id)), cl AS (SELECT pipeline, suite, run_id, success AS bad FROM la WHERE NOT attacked OR success),
{classes_sql('pipeline, suite', 1.1, 20, 8, 10)} SELECT * FROM rt""")
def injection_rates(spark, sf):
    r = V.records(spark, sf)
    labels = r.groupBy("run_id").agg(F.concat(F.lit("p"), F.substring(F.first("agent_id"), 2, 20).cast("long") % 2).alias("pipeline"), F.first("goal_id").alias("suite"), F.count(F.lit(1)).alias("n_calls"))
    labels = labels.withColumn("attacked", _week() % 3 == 1).withColumn("injection_success", _week() % 6 == 1)
    return _rows(E.injection(r, labels, trials=TRIALS, margin=1.1, window=20), ("pipeline", "suite"))


_TERM = f"CASE WHEN {_WEEK} % 3 = 0 THEN 'baseline' WHEN {_WEEK} % 3 = 1 THEN 'rewarded_serious_exploit' ELSE 'other' END"


@query(RECORDS + f""", rr AS (SELECT goal_id AS model_dir, run_id, step_index, tool FROM r), cl AS (SELECT DISTINCT goal_id AS model_dir, run_id, {_WEEK} % 3 = 1 AS bad FROM r WHERE {_WEEK} % 3 < 2),
{classes_sql('model_dir', 1.1, 50, 40, 30)} SELECT * FROM rt""")
def terminal_rates(spark, sf):
    r = V.records(spark, sf).withColumn("agent_id", F.col("goal_id"))
    kind = F.when(_week() % 3 == 0, "baseline").when(_week() % 3 == 1, "rewarded_serious_exploit").otherwise("other")
    labels = r.select(F.col("agent_id").alias("model_dir"), "run_id").distinct().withColumn("classification", kind)
    return _rows(E.terminal(r, labels, trials=TRIALS, margin=1.1), ("model_dir",))


@query(RECORDS + f", rr AS (SELECT 0 AS one, run_id, step_index, tool FROM r), cl AS (SELECT DISTINCT 0 AS one, run_id, {_WEEK} % 2 = 1 AS bad FROM r), {classes_sql('one', 1.02, 50, 40, 30)} SELECT * EXCLUDE (one) FROM rt")
def exported_rates(spark, sf):
    r = V.records(spark, sf)
    return _rows(E.exported(r, r.select("run_id").distinct().withColumn("hacked", _week() % 2 == 1), trials=TRIALS, margin=1.02))


# --- versions of the whole stream, fingerprints ---

_ALL = _SEG.replace("PARTITION BY agent_id ORDER BY us, event_id", "ORDER BY us, event_id").replace("PARTITION BY agent_id ORDER BY event_index", "ORDER BY event_index")


@query(_ALL + f""", g AS (SELECT segment, any_value(model_version) AS v, count(*) AS n, CAST(min(event_index) AS BIGINT) AS start FROM s GROUP BY 1),
t AS (SELECT segment, tool, count(*)::DOUBLE / any_value(g.n) AS p FROM s JOIN g USING (segment) GROUP BY 1, 2),
k AS (SELECT b.segment, a.v AS v0, b.v AS v1, b.start FROM g a JOIN g b ON a.segment + 1 = b.segment AND a.n >= 10 AND b.n >= 10),
m AS (SELECT k.*, x.tool, x.p, 0.0 AS q FROM k JOIN t x ON x.segment = k.segment - 1 UNION ALL SELECT k.*, x.tool, 0.0, x.p FROM k JOIN t x ON x.segment = k.segment),
n AS (SELECT segment, v0, v1, start, tool, sum(p) AS p, sum(q) AS q FROM m GROUP BY ALL)
SELECT segment, v0 AS from_version, v1 AS to_version, start AS boundary_index, round(sum({js('p', 'q')}), 6) AS jsd FROM n GROUP BY segment, v0, v1, start""")
def global_version_drift(spark, sf):
    d = D.version_drift(V.records(spark, sf).drop("step_index"), ORDER, stream=(), min_segment=10)
    return d.select("segment", F.col("from_version.model_version").alias("from_version"), F.col("to_version.model_version").alias("to_version"), "boundary_index", r6("jsd", "jsd"))


@query(_BLK + _BJ + f""", e AS (SELECT agent_id, 0 AS e, tool FROM b WHERE nb >= 4 AND block = 0 UNION ALL SELECT agent_id, 1, tool FROM b WHERE nb >= 4 AND i >= n - 10),
ec AS (SELECT agent_id, tool, sum((e = 0)::INT) / 10.0::DOUBLE AS p, sum((e = 1)::INT) / 10.0::DOUBLE AS q FROM e GROUP BY 1, 2),
f AS (SELECT d.* FROM d JOIN (SELECT DISTINCT agent_id FROM b WHERE nb >= 2) USING (agent_id) WHERE block = 0), u AS (SELECT DISTINCT agent_id FROM f),
bm AS (SELECT a.agent_id AS a, b.agent_id AS b, x.tool, x.p, 0.0 AS q FROM u a JOIN u b ON a.agent_id < b.agent_id JOIN f x ON x.agent_id = a.agent_id UNION ALL SELECT a.agent_id, b.agent_id, x.tool, 0.0, x.p FROM u a JOIN u b ON a.agent_id < b.agent_id JOIN f x ON x.agent_id = b.agent_id),
bg AS (SELECT a, b, tool, sum(p) AS p, sum(q) AS q FROM bm GROUP BY ALL),
v AS (SELECT 'adjacent' AS kind, jsd FROM j WHERE block = 1 UNION ALL SELECT 'lagged', sum({js('p', 'q')}) FROM ec GROUP BY agent_id UNION ALL SELECT 'between', sum({js('p', 'q')}) FROM bg GROUP BY a, b),
o AS (SELECT kind, list_sort(list(jsd)) AS l, count(*) AS n, median(jsd) AS m FROM v GROUP BY kind)
SELECT kind, n, round(m, 6) AS median, round(l[n // 4 + 1], 6) AS q1, round(l[3 * n // 4 + 1], 6) AS q3 FROM o""")
def fingerprints(spark, sf):
    q = E.fingerprints(V.records(spark, sf), 10)["divergence"]
    return q.select("kind", "n", *(r6(F.abs(c), c) for c in ("median", "q1", "q3")))


# --- timelines of users: false alarms in real and composed orders, alarms at version borders ---


def timeline_sql(keys: str, window: int, margin: float, cap: int) -> str:
    """Tables from pp (keys, agent_id, run_id, place, part: 0 admission, 1 calibration, 2 stream) and r to tc: keys, channel, alarm, delay, horizon."""
    k = keys
    return f"""e0 AS (SELECT {k}, part, tool, row_number() OVER (PARTITION BY {k}, part ORDER BY place, step_index) - 1 AS event_index FROM pp JOIN (SELECT run_id, step_index, tool FROM r) USING (run_id)),
dq AS (SELECT {k}, tool, count(*) / sum(count(*)) OVER (PARTITION BY {k})::DOUBLE AS q FROM e0 WHERE part = 0 GROUP BY {k}, tool),
sz AS (SELECT {k}, count(*) FILTER (part = 1) AS c, least({cap}, count(*) FILTER (part = 2)) AS horizon FROM e0 GROUP BY {k} HAVING count(*) FILTER (part = 1) > {window} AND count(*) FILTER (part = 2) > {window}),
ev AS (SELECT {k}, part, event_index, tool FROM e0 SEMI JOIN sz USING ({k}) WHERE part = 1 OR part = 2 AND event_index < {cap}),
{scored_sql('sc', 'ev', 'dq', k + ', part', k, window)},
li AS (SELECT {k}, least(greatest(0, coalesce(max(ema), 0)) * {margin}, 0.9) AS dt, greatest(0, coalesce(max(stat), 0)) * {margin} AS ct FROM sc WHERE part = 1 GROUP BY {k}),
ht AS (SELECT {k}, event_index, sum(coalesce(ema > dt, false)::INT) OVER (PARTITION BY {k} ORDER BY event_index ROWS 4 PRECEDING) = 5 AS a, stat > ct AS b FROM sc JOIN li USING ({k}) WHERE part = 2),
fo AS (SELECT {k}, 'divergence' AS channel, min(event_index) AS delay FROM ht WHERE a GROUP BY {k} UNION ALL SELECT {k}, 'cusum', min(event_index) FROM ht WHERE b GROUP BY {k}),
tc AS (SELECT {k}, channel, delay IS NOT NULL AS alarm, delay, horizon FROM sz CROSS JOIN (SELECT unnest(['divergence', 'cusum']) AS channel) LEFT JOIN fo USING ({k}, channel))"""


#: Not 2: over five tools, sums of surprisal can be twice the calibration's largest to the last digit, and rounding would decide.
MARGIN = 2.1
_CUM = "sum(n) OVER (PARTITION BY {k} ORDER BY pos) AS cum, sum(n) OVER (PARTITION BY {k}) AS total, max(pos) OVER (PARTITION BY {k}) AS last"
_CUT = "SELECT {k}, pos + 1 AS {name} FROM {rows} WHERE pos + 1 <= last {after} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY abs(cum - {f} * total), pos) = 1"


@query(RECORDS + f""", s0 AS (SELECT agent_id, run_id, count(*) AS n, arg_min(ts, step_index) AS first_ts FROM r GROUP BY 1, 2),
x0 AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY first_ts, run_id) - 1 AS session FROM s0 QUALIFY sum(n) OVER (PARTITION BY agent_id) >= 12 AND count(*) OVER (PARTITION BY agent_id) >= 3),
od AS (SELECT agent_id, -1 AS trial, run_id, n, session AS pos FROM x0 UNION ALL SELECT agent_id, trial, run_id, n, row_number() OVER (PARTITION BY agent_id, trial ORDER BY md5(trial || ':' || run_id), run_id) - 1 FROM x0, (SELECT unnest(range({TRIALS})) AS trial)),
cu AS (SELECT *, {_CUM.format(k='agent_id, trial')} FROM od), c0 AS ({_CUT.format(k='agent_id, trial', name='cut0', rows='cu', after='', f='0.5')}),
c1 AS ({_CUT.format(k='agent_id, trial', name='cut1', rows='cu JOIN c0 USING (agent_id, trial)', after='AND pos + 1 > cut0', f='0.75')}),
pp AS (SELECT agent_id, trial, run_id, pos AS place, (pos >= cut0)::INT + (pos >= cut1)::INT AS part FROM cu JOIN c0 USING (agent_id, trial) JOIN c1 USING (agent_id, trial)),
{timeline_sql('agent_id, trial', 5, MARGIN, 2000)}
SELECT a.agent_id, a.channel, a.alarm AS real_fp, a.horizon AS real_horizon, round(avg(b.alarm::INT), 6) AS composed_fp, count(*) AS composed_cells FROM tc a JOIN tc b ON b.agent_id = a.agent_id AND b.channel = a.channel AND a.trial < 0 AND b.trial >= 0 GROUP BY ALL""")
def timeline_null(spark, sf):
    found = E.timeline_null(V.records(spark, sf).withColumn("model_version", F.lit("v")), TRIALS, 5, MARGIN, 12)
    return found.select("agent_id", "channel", "real_fp", "real_horizon", r6("composed_fp", "composed_fp"), "composed_cells")


@query(_SES + f""", z AS (SELECT agent_id, block, sum(n) AS size, any_value(version) AS version, count(*) AS k FROM s GROUP BY 1, 2),
zn AS (SELECT *, lead(size) OVER w AS size1, lead(version) OVER w AS version1 FROM z WINDOW w AS (PARTITION BY agent_id ORDER BY block)),
re AS (SELECT agent_id, 'real-' || block AS pair, block FROM zn WHERE version <> '' AND version1 <> '' AND size >= {{old}} AND size1 >= {{new}}),
rs AS (SELECT re.agent_id, pair, s.run_id, s.session, s.n, (s.block > re.block)::INT AS side FROM re JOIN s ON s.agent_id = re.agent_id AND s.block IN (re.block, re.block + 1)),
o0 AS (SELECT s.agent_id, 'control-' || s.block AS pair, s.run_id, s.session, s.n, row_number() OVER (PARTITION BY s.agent_id, s.block ORDER BY s.session) - 1 AS pos FROM s JOIN z ON z.agent_id = s.agent_id AND z.block = s.block WHERE z.version <> '' AND z.size >= {{old}} + {{new}} AND z.k >= 3),
ou AS (SELECT *, {_CUM.format(k='agent_id, pair')} FROM o0), oc AS ({_CUT.format(k='agent_id, pair', name='cut0', rows='ou', after='', f='0.6::DOUBLE')}),
os AS (SELECT agent_id, pair, run_id, session, n, (pos >= cut0)::INT AS side FROM ou JOIN oc USING (agent_id, pair) QUALIFY sum(n * (pos < cut0)::INT) OVER (PARTITION BY agent_id, pair) >= {{old}} AND sum(n * (pos >= cut0)::INT) OVER (PARTITION BY agent_id, pair) >= {{new}}),
al AS (SELECT * FROM rs UNION ALL SELECT * FROM os),
h0 AS (SELECT *, row_number() OVER (PARTITION BY agent_id, pair ORDER BY session) - 1 AS pos FROM al WHERE side = 0), hu AS (SELECT *, {_CUM.format(k='agent_id, pair')} FROM h0), hc AS ({_CUT.format(k='agent_id, pair', name='cut0', rows='hu', after='', f='(2.0::DOUBLE / 3)')}),
pp AS (SELECT agent_id, pair, run_id, session AS place, (pos >= cut0)::INT AS part FROM hu JOIN hc USING (agent_id, pair) UNION ALL SELECT agent_id, pair, run_id, session, 2 FROM al WHERE side = 1),
{timeline_sql('agent_id, pair', 3, MARGIN, 2000)},
tl AS (SELECT agent_id, pair, side, tool, ts FROM al JOIN (SELECT run_id, tool, ts FROM r) USING (run_id)),
td AS (SELECT agent_id, pair, tool, count(*) FILTER (side = 0) / any_value(n0)::DOUBLE AS p, count(*) FILTER (side = 1) / any_value(n1)::DOUBLE AS q FROM (SELECT *, count(*) FILTER (side = 0) OVER w AS n0, count(*) FILTER (side = 1) OVER w AS n1 FROM tl WINDOW w AS (PARTITION BY agent_id, pair)) GROUP BY 1, 2, 3),
tj AS (SELECT agent_id, pair, sum({js('p', 'q')}) AS jsd FROM td GROUP BY 1, 2), tg AS (SELECT agent_id, pair, (min(ts) FILTER (side = 1) - max(ts) FILTER (side = 0)) / 86400 AS gap FROM tl GROUP BY 1, 2)
SELECT agent_id, pair, split_part(pair, '-', 1) AS kind, channel, alarm, CAST(delay AS BIGINT) AS delay, horizon, round(jsd, 6) AS jsd, round(gap, 6) AS gap_days FROM tc JOIN tj USING (agent_id, pair) JOIN tg USING (agent_id, pair)""".replace("{old}", "12").replace("{new}", "6"))
def timeline_versions(spark, sf):
    found = E.timeline_versions(V.records(spark, sf), 3, MARGIN, 12, 6)
    return found.select("agent_id", "pair", "kind", "channel", "alarm", "delay", "horizon", r6("jsd", "jsd"), r6("gap_days", "gap_days"))


# --- submissions: a week of a group of users each ---

_SUBMISSION = "'w' || (us // 604800000000) || CASE WHEN CAST(substr(agent_id, 2) AS BIGINT) % 2 = 0 THEN '_even' ELSE '_odd' END"
_SUBS = RECORDS + f""", q0 AS (SELECT {_SUBMISSION} AS agent_id, run_id, step_index, tool FROM r),
q1 AS (SELECT agent_id, count(DISTINCT run_id) AS n_runs FROM q0 GROUP BY 1 HAVING count(DISTINCT run_id) >= 20), q AS (SELECT * FROM q0 SEMI JOIN q1 USING (agent_id)) """


def _submissions(spark, sf):
    r = V.records(spark, sf)
    name = F.concat(F.lit("w"), F.floor(F.col("us") / 604_800_000_000), F.when(F.substring("agent_id", 2, 20).cast("long") % 2 == 0, "_even").otherwise("_odd"))
    return E.submission_runs(r.select(name.alias("agent_id"), "run_id", "step_index", "tool"), 20)


@query(_SUBS + f""", rr AS (SELECT agent_id, run_id, step_index, tool FROM q), i0 AS (SELECT DISTINCT agent_id, run_id FROM q),
pm AS (SELECT agent_id, trial, run_id, row_number() OVER (PARTITION BY agent_id, trial ORDER BY md5(trial || ':' || run_id), run_id) - 1 AS pos, count(*) OVER (PARTITION BY agent_id, trial) AS n FROM i0, (SELECT unnest(range({TRIALS})) AS trial)),
ij AS (SELECT agent_id, trial, run_id, pos FROM pm WHERE false), {cells_sql('agent_id, trial', 'agent_id, run_id', 20, 1.2)}
SELECT agent_id, channel, count(*) AS cells, round(avg(false_alarm::INT), 6) AS fp, CAST(floor(median(horizon)) AS BIGINT) AS median_horizon FROM ce GROUP BY ALL""")
def submission_null(spark, sf):
    """False alarms of each submission against its own runs."""
    return E.submission_null(*_submissions(spark, sf), TRIALS, 1.2, 20).select("agent_id", "channel", "cells", r6("fp", "fp"), "median_horizon")


@query(_SUBS + f""", fa AS (SELECT agent_id, split_part(agent_id, '_', 2) AS family FROM q1), pr AS (SELECT agent_id AS old, lead(agent_id) OVER (PARTITION BY family ORDER BY agent_id) AS new FROM fa QUALIFY new IS NOT NULL),
rr AS (SELECT old, new, 'old/' || run_id AS run_id, step_index, tool FROM pr JOIN q ON q.agent_id = pr.old UNION ALL SELECT old, new, 'new/' || run_id, step_index, tool FROM pr JOIN q ON q.agent_id = pr.new),
i0 AS (SELECT DISTINCT old, new, run_id, run_id[:4] = 'new/' AS bad FROM rr),
od AS (SELECT old, new, bad, trial, run_id, row_number() OVER (PARTITION BY old, new, bad, trial ORDER BY md5(trial || ':' || run_id), run_id) - 1 AS pos, count(*) OVER (PARTITION BY old, new, bad, trial) AS n FROM i0, (SELECT unnest(range({TRIALS})) AS trial)),
pm AS (SELECT * EXCLUDE (bad) FROM od WHERE NOT bad), ij AS (SELECT * EXCLUDE (bad, n) FROM od WHERE bad), {cells_sql('old, new, trial', 'old, new, run_id', 20, 1.2)},
dd AS (SELECT old, new, tool, count(*) FILTER (run_id[:4] = 'old/') AS a, count(*) FILTER (run_id[:4] = 'new/') AS b FROM rr GROUP BY 1, 2, 3),
dp AS (SELECT old, new, tool, a / sum(a) OVER (PARTITION BY old, new)::DOUBLE AS p, b / sum(b) OVER (PARTITION BY old, new)::DOUBLE AS q FROM dd),
dj AS (SELECT old, new, round(sum({js('p', 'q')}), 6) AS jsd FROM dp GROUP BY 1, 2)
SELECT old, new, jsd, channel, count(*) AS cells, round(avg(detected::INT), 6) AS detection, CAST(floor(median(delay)) AS BIGINT) AS median_delay FROM dj JOIN ce USING (old, new) GROUP BY ALL""")
def submission_versions(spark, sf):
    """Divergence and detection between each two successive submissions of a family."""
    found = E.submission_versions(*_submissions(spark, sf), ["even", "odd"], TRIALS, 1.2, 20).where("channel IS NOT NULL")
    return found.select("old", "new", r6("jsd", "jsd"), "channel", "cells", r6("detection", "detection"), "median_delay")
