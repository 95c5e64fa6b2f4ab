"""The queries of the engine over the driver's tables, each with SQL for the same result.

Doubles are rounded to six digits on both sides, since sums are taken in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import text as T
from ..operators import baseline as B
from ..operators import channels as C
from ..operators import detectors as D
from ..operators import distributions as S
from ..operators import runs as R
from ..operators import selection as Q
from ..operators import timelines as L
from . import experiments as E
from . import records as V
from . import trials
from .records import CONTENT, LABELLED, LEDGER, ORDER, RECORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STREAM = ("agent_id",)
WINDOW = 10
#: Words that this data's documents hold, for the pattern queries: a parameter, not a family of the engine.
LEXICON = {"worthless": "worthless", "idiot": "idiot", "scum": r"\bscum\b", "pipe": r"\|"}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def base_and_rest(spark, sf):
    r = V.records(spark, sf)
    return r, V.records(spark, sf, V.CUT), r.where("NOT base")


# --- distributions ---

_D = RECORDS + ", q AS (SELECT tool, count(*) / (SELECT count(*) FROM r WHERE base)::DOUBLE AS q FROM r WHERE base GROUP BY tool)"
_P = ", p AS (SELECT tool, count(*) / (SELECT count(*) FROM r WHERE NOT base)::DOUBLE AS p FROM r WHERE NOT base GROUP BY tool)"


@query(RECORDS + "SELECT tool, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS p FROM r GROUP BY tool")
def tool_distribution(spark, sf):
    return S.tool_distribution(V.records(spark, sf)).select("tool", r6("p", "p"))


@query(RECORDS + """, f AS (SELECT run_id, goal_id AS g FROM r WHERE step_index = 0)
SELECT g AS goal_id, tool, round(count(*) / sum(count(*)) OVER (PARTITION BY g)::DOUBLE, 6) AS p FROM r JOIN f USING (run_id) GROUP BY g, tool""")
def tool_distribution_by_goal(spark, sf):
    return B.freeze(V.records(spark, sf), order=ORDER).tools_by_goal.select("goal_id", "tool", r6("p", "p"))


@query(RECORDS + """, x AS (SELECT DISTINCT goal_id, run_id, tool FROM r WHERE base), n AS (SELECT goal_id, count(DISTINCT run_id) AS n FROM x GROUP BY goal_id)
SELECT goal_id, tool FROM x JOIN n USING (goal_id) GROUP BY goal_id, tool, n HAVING count(*) / n::DOUBLE >= 0.8""")
def expected_tools(spark, sf):
    return B.freeze(base_and_rest(spark, sf)[1], 0.8, ORDER).expected


@query(RECORDS + "SELECT CAST(step_index // 10 AS INTEGER) AS bin, CAST(sum((status IN ('error','abort'))::INT) AS BIGINT) AS err, count(*) AS n FROM r WHERE base GROUP BY 1")
def error_rate_by_length_bin(spark, sf):
    return B.freeze(base_and_rest(spark, sf)[1], order=ORDER).error_rates


@query(RECORDS + "SELECT count(*) AS n_records, count(DISTINCT run_id) AS n_runs FROM r WHERE base")
def baseline_counts(spark, sf):
    return B.freeze(base_and_rest(spark, sf)[1], order=ORDER).counts


@query(_D + "SELECT round(-sum(q * log2(q)), 6) AS entropy FROM q")
def entropy(spark, sf):
    return S.tool_distribution(base_and_rest(spark, sf)[1]).agg(F.round(S.entropy("p"), 6).alias("entropy"))


@query(_D + _P + "SELECT round(coalesce(sum(CASE WHEN p > 0 THEN p * log2((p + 1e-9) / (coalesce(q, 0) + 1e-9)) ELSE 0 END), 0), 6) AS kl FROM p FULL JOIN q USING (tool)")
def kl_divergence(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    return S.kl_divergence(S.tool_distribution(b), S.tool_distribution(a)).select(r6("kl", "kl"))


_JS = """(CASE WHEN {p} > 0 THEN {p} * log2(({p} + 1e-9) / (({p} + {q}) / 2 + 1e-9)) ELSE 0 END
 + CASE WHEN {q} > 0 THEN {q} * log2(({q} + 1e-9) / (({p} + {q}) / 2 + 1e-9)) ELSE 0 END) / 2"""


def js(p: str, q: str) -> str:
    return _JS.format(p=f"coalesce({p}, 0)", q=f"coalesce({q}, 0)")


@query(_D + _P + f"SELECT round(sum({js('p', 'q')}), 6) AS jsd FROM p FULL JOIN q USING (tool)")
def js_divergence(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    return S.js_divergence(S.tool_distribution(a), S.tool_distribution(b)).select(r6("jsd", "jsd"))


@query(LEDGER + f""", x AS (SELECT goal_id, status, tool, count(*) / sum(count(*)) OVER (PARTITION BY goal_id, status)::DOUBLE AS v FROM l GROUP BY 1, 2, 3),
a AS (SELECT goal_id, tool, v AS p FROM x WHERE status = 'ok'), b AS (SELECT goal_id, tool, v AS q FROM x WHERE status = 'error')
SELECT goal_id, round(sum({js('p', 'q')}), 6) AS jsd FROM a FULL JOIN b USING (goal_id, tool) GROUP BY goal_id""")
def corpus_jsd_by_class(spark, sf):
    d = S.tool_distribution(V.ledger(spark, sf), ("goal_id", "status"))
    side = lambda s: d.where(F.col("status") == s).drop("status")
    return S.js_divergence(side("ok"), side("error"), ("goal_id",)).select("goal_id", r6("jsd", "jsd"))


@query(LEDGER + "SELECT goal_id, count(DISTINCT tool) AS vocabulary, count(*) AS n FROM l GROUP BY goal_id")
def vocabulary_size(spark, sf):
    return V.ledger(spark, sf).groupBy("goal_id").agg(F.count_distinct("tool").alias("vocabulary"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, n, round(m, 6) AS median, v[n // 4 + 1] AS q1, v[n // 2 + 1] AS upper, v[3 * n // 4 + 1] AS q3
FROM (SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS m, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_returnflag)""")
def exact_quartiles(spark, sf):
    """Of all prices, by flag."""
    found = Q.medians(V.table(spark, sf, "lineitem"), ("l_returnflag",), "l_extendedprice", q1=Q.QUARTILE, upper=Q.UPPER, q3=Q.THIRD_QUARTILE)
    return found.withColumn("median", F.round("median", 6))


# --- detectors ---


@query(RECORDS + """, e AS (SELECT base, CAST(step_index // 10 AS INTEGER) AS bin, sum((status IN ('error','abort'))::INT)::DOUBLE AS e, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2),
j AS (SELECT a.bin, a.e AS e1, a.n AS n1, b.e AS e2, b.n AS n2, (a.e + b.e) / (a.n + b.n) AS p FROM e a JOIN e b ON a.bin = b.bin AND a.base AND NOT b.base AND b.n >= 30)
SELECT bin, round(e1 / n1, 6) AS baseline_rate, round(e2 / n2, 6) AS observed_rate, round((e2 / n2 - e1 / n1) / CASE WHEN p * (1 - p) = 0 THEN 1e-12 ELSE sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) END, 6) AS z,
  CAST(n2 AS BIGINT) AS n_observed, coalesce((e2 / n2 - e1 / n1) / CASE WHEN p * (1 - p) = 0 THEN 1e-12 ELSE sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) END > 3, false) AS finding FROM j""")
def context_decay(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    f = D.context_decay(b, B.error_rates(a))
    return f.select("bin", r6("baseline_rate", "baseline_rate"), r6("observed_rate", "observed_rate"), r6("z", "z"), "n_observed", (F.col("z") > 3.0).alias("finding"))


_SEG = RECORDS + """, s0 AS (SELECT *, row_number() OVER w - 1 AS event_index, (model_version IS DISTINCT FROM lag(model_version) OVER w)::INT AS new FROM r WINDOW w AS (PARTITION BY agent_id ORDER BY us, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY agent_id ORDER BY event_index) - 1 AS BIGINT) AS segment FROM s0)"""


@query(_SEG + "SELECT agent_id, segment, model_version, count(*) AS n, min(event_index) AS start FROM s GROUP BY agent_id, segment, model_version")
def version_segments(spark, sf):
    s = D.segments(V.records(spark, sf), ORDER)
    return s.groupBy("agent_id", "segment", "model_version").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("start"))


@query(_SEG + f""", g AS (SELECT agent_id, segment, any_value(model_version) AS v, count(*) AS n, min(event_index) AS start FROM s GROUP BY 1, 2),
t AS (SELECT agent_id, segment, tool, count(*)::DOUBLE / any_value(g.n) AS p FROM s JOIN g USING (agent_id, segment) GROUP BY 1, 2, 3),
k AS (SELECT b.agent_id, b.segment, a.v AS v0, b.v AS v1, b.start FROM g a JOIN g b ON a.agent_id = b.agent_id AND a.segment + 1 = b.segment AND a.n >= 10 AND b.n >= 10),
m AS (SELECT k.*, x.tool, x.p, 0.0 AS q FROM k JOIN t x ON x.agent_id = k.agent_id AND x.segment = k.segment - 1 UNION ALL SELECT k.*, x.tool, 0.0, x.p FROM k JOIN t x ON x.agent_id = k.agent_id AND x.segment = k.segment),
n AS (SELECT agent_id, segment, v0, v1, start, tool, sum(p) AS p, sum(q) AS q FROM m GROUP BY ALL)
SELECT agent_id, segment, v0 AS from_version, v1 AS to_version, start AS boundary_index, round(sum({js('p', 'q')}), 6) AS jsd FROM n GROUP BY agent_id, segment, v0, v1, start""")
def version_drift(spark, sf):
    d = D.version_drift(V.records(spark, sf), ORDER, min_segment=10)
    return d.select("agent_id", "segment", F.col("from_version.model_version").alias("from_version"), F.col("to_version.model_version").alias("to_version"), "boundary_index", r6("jsd", "jsd"))


@query(RECORDS + """, x AS (SELECT DISTINCT base, goal_id, run_id, tool FROM r), n AS (SELECT base, goal_id, count(DISTINCT run_id) AS n FROM x GROUP BY 1, 2),
w AS (SELECT base, goal_id, tool, count(*) AS k FROM x GROUP BY 1, 2, 3),
e AS (SELECT goal_id, tool, k / n::DOUBLE AS a FROM w JOIN n USING (base, goal_id) WHERE base AND k / n::DOUBLE >= 0.75)
SELECT e.goal_id, e.tool, 1.0::DOUBLE AS baseline_presence, round(a, 6) AS baseline_presence_actual, round(coalesce(w.k, 0) / n.n::DOUBLE, 6) AS observed_presence, n.n AS n_runs,
  coalesce(w.k, 0) / n.n::DOUBLE < 0.8 AS finding
FROM e JOIN n ON n.goal_id = e.goal_id AND NOT n.base AND n.n >= 10 LEFT JOIN w ON NOT w.base AND w.goal_id = e.goal_id AND w.tool = e.tool""")
def omission(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    f = D.omission(b, B.presence(a, ORDER), 0.75, order=ORDER)
    return f.select("goal_id", "tool", "baseline_presence", r6("baseline_presence_actual", "baseline_presence_actual"), r6("observed_presence", "observed_presence"), "n_runs", (F.col("observed_presence") < 0.8).alias("finding"))


def _specs(spark):
    return spark.createDataFrame([(f"g{k}", "purchase", 15, 12, 1) for k in range(3)], "goal_id string, terminal_tool string, min_steps int, max_steps int, max_duplicate_calls int")


_RUNS = RECORDS + ", f AS (SELECT *, first_value(goal_id) OVER (PARTITION BY run_id ORDER BY us, event_id) AS g FROM r)"


@query(_RUNS + """SELECT run_id, g AS goal_id, 'duplicate_submission' AS kind, tool || ' with identical params called ' || count(*) || 'x' AS detail
FROM f WHERE g IN ('g0', 'g1', 'g2') GROUP BY run_id, g, tool, params_hash HAVING count(*) > 1""")
def goal_persistence_duplicates(spark, sf):
    return D.goal_persistence(V.records(spark, sf), _specs(spark), ORDER).where("kind = 'duplicate_submission'")


@query(_RUNS + """, k AS (SELECT run_id, g, count(*) AS n, arg_max(status, step_index) AS last, bool_or(tool = 'purchase' AND status = 'ok') AS done FROM f WHERE g IN ('g0', 'g1', 'g2') GROUP BY run_id, g)
SELECT run_id, g AS goal_id, 'premature_abort' AS kind, 'aborted after ' || n || ' steps (min 15)' AS detail FROM k WHERE last = 'abort' AND n < 15
UNION ALL SELECT run_id, g, 'false_success', 'run ended ok but terminal tool ''purchase'' never succeeded' FROM k WHERE last = 'ok' AND NOT done
UNION ALL SELECT run_id, g, 'missing_progress', n || ' steps without terminal tool ''purchase''' FROM k WHERE n > 12 AND NOT done""")
def goal_persistence_terminal(spark, sf):
    return D.goal_persistence(V.records(spark, sf), _specs(spark), ORDER).where("kind <> 'duplicate_submission'")


# --- surprisal of runs ---


@query(_D + ", u AS (SELECT run_id, -log2(coalesce(q, 1e-4)) AS s FROM r LEFT JOIN q USING (tool) WHERE NOT base) SELECT run_id, round(avg(s), 6) AS score FROM u GROUP BY run_id")
def run_surprisal(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    return S.mean_surprisal(b, S.tool_distribution(a)).select("run_id", r6("score", "score"))


_LOO = RECORDS + """, o AS (SELECT run_id, goal_id, tool, count(*) AS n FROM r WHERE base GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY goal_id, tool) AS tn, sum(n) OVER (PARTITION BY goal_id) AS an, sum(n) OVER (PARTITION BY run_id) AS rn FROM o),
z AS (SELECT goal_id, run_id, sum(n * -log2(coalesce(CASE WHEN tn > n AND an > rn THEN (tn - n) / (an - rn)::DOUBLE END, 1e-4))) / sum(n) AS score FROM t GROUP BY goal_id, run_id)"""


@query(_LOO + "SELECT goal_id, run_id, round(score, 6) AS score FROM z")
def loo_surprisal(spark, sf):
    return S.leave_one_out(base_and_rest(spark, sf)[1], ("goal_id",)).select("goal_id", "run_id", r6("score", "score"))


@query(_LOO + """, h AS (SELECT goal_id, max(score) * 1.2 AS threshold FROM z GROUP BY goal_id),
d AS (SELECT goal_id, tool, count(*) / sum(count(*)) OVER (PARTITION BY goal_id)::DOUBLE AS p FROM r WHERE base GROUP BY 1, 2),
y AS (SELECT r.goal_id, run_id, avg(-log2(coalesce(p, 1e-4))) AS score FROM r LEFT JOIN d ON d.goal_id = r.goal_id AND d.tool = r.tool WHERE NOT base GROUP BY 1, 2)
SELECT goal_id, round(threshold, 6) AS threshold, count(*) AS n, CAST(sum((score > threshold)::INT) AS BIGINT) AS flagged FROM y JOIN h USING (goal_id) GROUP BY goal_id, threshold""")
def loo_threshold_flags(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    h = S.leave_one_out(a, ("goal_id",)).groupBy("goal_id").agg((F.max("score") * 1.2).alias("threshold"))
    y = S.mean_surprisal(b, S.tool_distribution(a, ("goal_id",)), ("goal_id", "run_id"), ("goal_id",))
    return y.join(h, "goal_id").groupBy("goal_id", r6("threshold", "threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > F.col("threshold")).cast("long")).alias("flagged"))


# --- channels, by agent ---

_EV = _D + ", e AS (SELECT r.*, q, row_number() OVER (PARTITION BY agent_id ORDER BY us, r.event_id) - 1 AS event_index FROM r LEFT JOIN q USING (tool))"
_CNT = ", ".join(f"sum((tool = '{t}')::INT) OVER w AS n_{t}" for t in ("click", "error", "purchase", "signup", "view"))


def _streams(spark, sf):
    _, a, _ = base_and_rest(spark, sf)
    # the frozen baseline is used more than once; it has a row a tool
    return C.numbered(V.records(spark, sf), STREAM, ORDER), written(S.tool_distribution(a), "baseline")


_WIN = _EV + f""", wn AS (SELECT agent_id, event_index, tool, q, list(tool) OVER (PARTITION BY agent_id ORDER BY event_index ROWS {WINDOW - 1} PRECEDING) AS l FROM e),
wd AS (SELECT agent_id, event_index, v.tool, v.q, len(list_filter(l, lambda t: t = v.tool)) / {WINDOW}::DOUBLE AS p FROM wn, (SELECT tool, q FROM q UNION SELECT DISTINCT r.tool, 0.0 FROM r ANTI JOIN q USING (tool)) v WHERE event_index >= {WINDOW - 1}),
wj AS (SELECT agent_id, event_index, sum({js('p', 'q')}) AS jsd FROM wd GROUP BY 1, 2)"""


@query(_EV + f", w AS (SELECT agent_id, event_index, list(tool) OVER (PARTITION BY agent_id ORDER BY event_index ROWS {WINDOW - 1} PRECEDING) AS l FROM e) SELECT agent_id, event_index, x.tool, CAST(count(*) AS BIGINT) AS n FROM w, unnest(l) AS x(tool) WHERE event_index >= {WINDOW - 1} GROUP BY ALL")
def window_tool_counts(spark, sf):
    e, _ = _streams(spark, sf)
    w = Window.partitionBy(*STREAM).orderBy("event_index").rowsBetween(-(WINDOW - 1), 0)
    rows = e.withColumn("held", F.collect_list("tool").over(w)).where(F.col("event_index") >= WINDOW - 1).select(*STREAM, "event_index", F.explode("held").alias("tool"))
    return rows.groupBy(*STREAM, "event_index", "tool").agg(F.count(F.lit(1)).alias("n"))


@query(_WIN + "SELECT agent_id, event_index, round(jsd, 6) AS jsd FROM wj")
def window_jsd(spark, sf):
    e, d = _streams(spark, sf)
    return C.window_scores(e, d, STREAM, WINDOW).where("jsd IS NOT NULL").select("agent_id", "event_index", r6(F.abs("jsd"), "jsd"))


_EMA = _WIN + ", we AS (SELECT agent_id, event_index, jsd, list_reduce(list(jsd) OVER (PARTITION BY agent_id ORDER BY event_index), lambda a, b: 0.1 * b + 0.9 * a) AS ema FROM wj)"


@query(_EMA + "SELECT agent_id, event_index, round(ema, 6) AS ema FROM we")
def ema_jsd(spark, sf):
    e, d = _streams(spark, sf)
    return C.smoothed(C.window_scores(e, d, STREAM, WINDOW), STREAM).where("ema IS NOT NULL").select("agent_id", "event_index", r6("ema", "ema"))


_PAT = _EMA + ", wp AS (SELECT *, sum((ema > 0.15)::INT) OVER (PARTITION BY agent_id ORDER BY event_index ROWS 4 PRECEDING) = 5 AS alarmed FROM we)"


@query(_PAT + "SELECT agent_id, event_index, alarmed FROM wp")
def patience_alarm(spark, sf):
    e, d = _streams(spark, sf)
    return C.patience(C.smoothed(C.window_scores(e, d, STREAM, WINDOW), STREAM), STREAM, 0.15).where("ema IS NOT NULL").select("agent_id", "event_index", "alarmed")


_CUS = _EV + """, h AS (SELECT -sum(q * log2(q)) AS h FROM q), c0 AS (SELECT agent_id, event_index, sum(-log2(coalesce(q, 1e-4)) - h - {slack}) OVER (PARTITION BY agent_id ORDER BY event_index) AS c FROM e, h),
c AS (SELECT agent_id, event_index, c - least(0, min(c) OVER (PARTITION BY agent_id ORDER BY event_index)) AS stat FROM c0)"""


@query(_CUS.format(slack="0.0") + "SELECT agent_id, event_index, round(stat, 6) AS stat FROM c")
def cusum_stat(spark, sf):
    e, d = _streams(spark, sf)
    return C.cusum_scores(e, d, STREAM, 0.0).select("agent_id", "event_index", r6(F.abs("stat"), "stat"))


_ALARM = _PAT + _CUS.format(slack="0.0")[len(_EV):] + """, al AS (SELECT agent_id, 'divergence' AS channel, event_index, ema AS score FROM wp WHERE alarmed UNION ALL SELECT agent_id, 'cusum', event_index, stat FROM c WHERE stat > 1),
fa AS (SELECT agent_id, channel, min(event_index) AS event_index, arg_min(score, event_index) AS score FROM al GROUP BY 1, 2)"""


@query(_ALARM + "SELECT agent_id, channel, event_index, round(score, 6) AS score FROM fa")
def two_regime(spark, sf):
    e, d = _streams(spark, sf)
    return C.two_regime(e, d, STREAM, C.Divergence(window=WINDOW), C.Cusum(slack=0.0, threshold=1.0)).select("agent_id", "channel", "event_index", r6("score", "score"))


@query(_ALARM + "SELECT channel, count(*) AS streams, CAST(median(event_index) AS DOUBLE) AS median_index FROM fa GROUP BY channel")
def first_alarm_delay(spark, sf):
    e, d = _streams(spark, sf)
    f = C.two_regime(e, d, STREAM, C.Divergence(window=WINDOW), C.Cusum(slack=0.0, threshold=1.0))
    return Q.medians(f, ("channel",), "event_index", "median_index").withColumnRenamed("n", "streams")


_HOT = _ALARM.replace(", e AS (SELECT r.*", """, hot AS (SELECT * REPLACE (CASE WHEN CAST(substr(agent_id, 2) AS BIGINT) % 10 < 9 THEN 'hot' ELSE agent_id END AS agent_id) FROM r),
e AS (SELECT hot.*""").replace("ORDER BY us, r.event_id) - 1 AS event_index FROM r LEFT JOIN q", "ORDER BY us, hot.event_id) - 1 AS event_index FROM hot LEFT JOIN q")


@query(_HOT + "SELECT agent_id, channel, event_index, round(score, 6) AS score FROM fa")
def hot_stream_alarms(spark, sf):
    """One agent has nine tenths of all events: its stream is numbered in ranges and scored in blocks."""
    r = V.records(spark, sf)
    r = r.withColumn("agent_id", F.when(F.substring("agent_id", 2, 20).cast("long") % 10 < 9, "hot").otherwise(F.col("agent_id")))
    e = C.numbered(r, STREAM, ORDER, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = written(S.tool_distribution(base_and_rest(spark, sf)[1]), "baseline")
    return C.two_regime(e, d, STREAM, C.Divergence(window=WINDOW), C.Cusum(slack=0.0, threshold=1.0), block=2048).select("agent_id", "channel", "event_index", r6("score", "score"))


_LINES = "l AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber < 7 AND l_partkey % 10 < 9 THEN 'read' ELSE 'p' || l_partkey END AS tool FROM lineitem)"


@query(f"""WITH {_LINES}, d AS (SELECT tool, count(*) / (SELECT count(*) FROM l)::DOUBLE AS p FROM l GROUP BY tool)
SELECT l_suppkey, count(*) AS n, round(avg(-log2(p)), 6) AS bits FROM l JOIN d USING (tool) GROUP BY l_suppkey""")
def skewed_vocabulary(spark, sf):
    """Surprisal of lines by supplier, under a vocabulary of parts of which one entry has most of the lines: its lines are joined apart."""
    tool = F.when((F.col("l_linenumber") < 7) & (F.col("l_partkey") % 10 < 9), "read").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    lines = V.table(spark, sf, "lineitem").select("l_suppkey", tool.alias("tool"))
    known = C.with_probabilities(lines, S.tool_distribution(lines), hot=True)
    return known.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.surprisal("_q")), 6).alias("bits"))


@query(_EMA + _CUS.format(slack="0.5")[len(_EV):] + """, k AS (SELECT agent_id, max(ema) AS e FROM we GROUP BY 1), m AS (SELECT agent_id, max(stat) AS s FROM c GROUP BY 1)
SELECT m.agent_id, round(least(greatest(coalesce(e, 0), 0) * 2, 0.9), 6) AS div_threshold, round(greatest(s, 0) * 2, 6) AS cusum_threshold FROM m LEFT JOIN k USING (agent_id)""")
def calibrated_thresholds(spark, sf):
    e, d = _streams(spark, sf)
    return C.calibrated(e, d, STREAM, WINDOW).select("agent_id", r6("div_threshold", "div_threshold"), r6("cusum_threshold", "cusum_threshold"))


@query(_PAT + """, g AS (SELECT agent_id, min(CASE WHEN alarmed THEN event_index END) AS f, arg_max(ema, event_index) AS s FROM wp GROUP BY 1)
SELECT a.agent_id, f IS NOT NULL AS shifted, f IS NOT NULL AND coalesce(s > 0.15, false) AS persistent, f AS first_alarm_index, round(s, 6) AS final_score FROM (SELECT DISTINCT agent_id FROM r) a LEFT JOIN g USING (agent_id)""")
def persistence_verdict(spark, sf):
    e, d = _streams(spark, sf)
    return C.persistence(e, d, STREAM, C.Divergence(window=WINDOW)).select("agent_id", "shifted", "persistent", "first_alarm_index", r6("final_score", "final_score"))


# --- timelines ---

_SES = RECORDS + """, s0 AS (SELECT agent_id, run_id, count(*) AS n, min(ts) AS first_ts, arg_min(model_version, step_index) AS version FROM r GROUP BY 1, 2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY first_ts, run_id) - 1 AS session FROM s0),
s2 AS (SELECT *, (version IS DISTINCT FROM lag(version) OVER (PARTITION BY agent_id ORDER BY session))::INT AS new FROM s1),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY agent_id ORDER BY session) - 1 AS BIGINT) AS block FROM s2)"""


@query(_SES + "SELECT agent_id, run_id, session, n, version, block FROM s")
def session_blocks(spark, sf):
    return L.version_blocks(L.sessions(V.records(spark, sf))).select("agent_id", "run_id", "session", "n", "version", "block")


@query(_SES + """, z AS (SELECT agent_id, block, sum(n) AS size FROM s WHERE version <> '' GROUP BY 1, 2 HAVING sum(n) >= 20),
b AS (SELECT agent_id, block, size, row_number() OVER (PARTITION BY agent_id ORDER BY size DESC, block) AS k FROM z)
SELECT agent_id, block, CAST(size AS BIGINT) AS size FROM b WHERE k = 1""")
def longest_version_block(spark, sf):
    b = L.longest_block(L.version_blocks(L.sessions(V.records(spark, sf))), 20)
    return b.groupBy("agent_id", "block").agg(F.sum("n").alias("size"))


@query(_SES + """, t AS (SELECT agent_id, session AS pos, n, sum(n) OVER (PARTITION BY agent_id ORDER BY session) AS cum, sum(n) OVER (PARTITION BY agent_id) AS total, max(session) OVER (PARTITION BY agent_id) AS last FROM s),
c0 AS (SELECT agent_id, arg_min(pos + 1, abs(cum - 0.5 * total) * 1000000 + pos) AS c0 FROM t WHERE pos + 1 BETWEEN 1 AND last GROUP BY 1),
c1 AS (SELECT agent_id, c0, arg_min(pos + 1, abs(cum - 0.75 * total) * 1000000 + pos) AS c1 FROM t JOIN c0 USING (agent_id) WHERE pos + 1 BETWEEN c0 + 1 AND last GROUP BY 1, 2)
SELECT agent_id, pos AS session, (pos >= c0)::INT + (pos >= c1)::INT AS part FROM t JOIN c1 USING (agent_id)""")
def session_split(spark, sf):
    s = L.sessions(V.records(spark, sf)).withColumnRenamed("session", "pos")
    return L.split_at(s, (0.5, 0.75)).select("agent_id", F.col("pos").alias("session"), "part")


_BLK = RECORDS + """, i0 AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY agent_id) AS n FROM r),
b AS (SELECT *, n // 10 AS nb, i // 10 AS block FROM i0),
d AS (SELECT agent_id, block, tool, count(*) / 10.0::DOUBLE AS p FROM b WHERE block < nb GROUP BY ALL),
t AS (SELECT agent_id, block, median(ts) AS t, any_value(nb) AS nb FROM b WHERE block < nb GROUP BY 1, 2)"""
_BJ = f""", m AS (SELECT t.agent_id, t.block, x.tool, x.p, 0.0 AS q FROM t JOIN d x ON x.agent_id = t.agent_id AND x.block = 0 WHERE t.block > 0 UNION ALL SELECT t.agent_id, t.block, x.tool, 0.0, x.p FROM t JOIN d x ON x.agent_id = t.agent_id AND x.block = t.block WHERE t.block > 0),
g AS (SELECT agent_id, block, tool, sum(p) AS p, sum(q) AS q FROM m GROUP BY ALL), j AS (SELECT agent_id, block, sum({js('p', 'q')}) AS jsd FROM g GROUP BY 1, 2)"""


def _blocked(spark, sf):
    return L.fixed_blocks(V.records(spark, sf), ORDER, 10)


@query(_BLK + _BJ + "SELECT j.agent_id, CAST(j.block AS BIGINT) AS block, round(jsd, 6) AS jsd, round((t.t - z.t) / 86400, 6) AS lag_days FROM j JOIN t USING (agent_id, block) JOIN t z ON z.agent_id = j.agent_id AND z.block = 0 WHERE t.nb >= 3")
def aging_curve(spark, sf):
    return L.block_pairs(_blocked(spark, sf)).where("kind = 'aging'").select("agent_id", F.col("block").cast("long").alias("block"), r6("jsd", "jsd"), r6("lag_days", "lag_days"))


@query(_BLK + _BJ + """, v AS (SELECT jsd FROM j WHERE block = 1), o AS (SELECT list_sort(list(jsd)) AS l, count(*) AS n, median(jsd) AS m FROM v)
SELECT 'adjacent' AS kind, n, round(m, 6) AS median, round(l[n // 4 + 1], 6) AS q1, round(l[3 * n // 4 + 1], 6) AS q3 FROM o""")
def fixed_blocks_jsd(spark, sf):
    q = L.quartiles(L.block_pairs(_blocked(spark, sf)).where("kind = 'adjacent'"), ("kind",))
    return q.select("kind", "n", *(r6(c, c) for c in ("median", "q1", "q3")))


@query(_BLK + f""", e AS (SELECT agent_id, 0 AS e, tool FROM b WHERE nb >= 4 AND block = 0 UNION ALL SELECT agent_id, 1, tool FROM b WHERE nb >= 4 AND i >= n - 10),
c AS (SELECT agent_id, tool, sum((e = 0)::INT) / 10.0::DOUBLE AS p, sum((e = 1)::INT) / 10.0::DOUBLE AS q FROM e GROUP BY 1, 2) SELECT agent_id, round(sum({js('p', 'q')}), 6) AS jsd FROM c GROUP BY agent_id""")
def lagged_blocks_jsd(spark, sf):
    return L.block_pairs(_blocked(spark, sf)).where("kind = 'lagged'").select("agent_id", r6("jsd", "jsd"))


@query(_BLK + f""", f AS (SELECT d.* FROM d JOIN (SELECT DISTINCT agent_id FROM b WHERE nb >= 2) USING (agent_id) WHERE block = 0), u AS (SELECT DISTINCT agent_id FROM f),
m AS (SELECT a.agent_id AS a, b.agent_id AS b, x.tool, x.p, 0.0 AS q FROM u a JOIN u b ON a.agent_id < b.agent_id JOIN f x ON x.agent_id = a.agent_id UNION ALL SELECT a.agent_id, b.agent_id, x.tool, 0.0, x.p FROM u a JOIN u b ON a.agent_id < b.agent_id JOIN f x ON x.agent_id = b.agent_id),
g AS (SELECT a, b, tool, sum(p) AS p, sum(q) AS q FROM m GROUP BY ALL) SELECT a, b, round(sum({js('p', 'q')}), 6) AS jsd FROM g GROUP BY a, b""")
def between_user_jsd(spark, sf):
    return L.between_users(_blocked(spark, sf), value=lambda jsd: r6(F.abs(jsd), "jsd")).select("a", "b", "jsd")


# --- texts of runs ---


@query(LABELLED + "SELECT run_id, list_sum(list_transform(string_split(sha256(run_id), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', c) - 1 END)) % 5 = 0 AS dev FROM d")
def dev_split(spark, sf):
    return V.labelled(spark, sf).select("run_id", T.is_dev("run_id").alias("dev"))


@query(CONTENT + "SELECT run_id, md5(string_agg(text, chr(10) ORDER BY step_index, text) FILTER (text <> '')) AS digest FROM c GROUP BY run_id")
def run_text_concat(spark, sf):
    return R.run_texts(V.content(spark, sf), "text").select("run_id", F.md5("text").alias("digest"))


@query(CONTENT + """, f AS (SELECT run_id, label, min(step_index) AS place FROM c WHERE label <> '' GROUP BY 1, 2) SELECT run_id, string_agg(label, chr(10) ORDER BY place, label) AS text FROM f GROUP BY run_id""")
def run_text_dedup(spark, sf):
    return R.run_texts(V.content(spark, sf), "label", dedup=True)


def _hits() -> str:
    return ", ".join(f"CASE WHEN regexp_matches(text, '(?i){rx}') THEN '{name}' END" for name, rx in LEXICON.items())


_FLAG = LABELLED + f""", m AS (SELECT *, list_filter([{_hits()}], lambda x: x IS NOT NULL) AS matched FROM d),
v AS (SELECT *, len(matched) >= 1 AS flagged, list_sum(list_transform(string_split(sha256(run_id), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', c) - 1 END)) % 5 = 0 AS dev FROM m)"""


def _verdicts(spark, sf):
    d = V.labelled(spark, sf)
    return R.verdicts(d.drop("text"), d.select("run_id", "text"), LEXICON)


@query(_FLAG + "SELECT run_id, array_to_string(matched, ',') AS matched, flagged FROM v")
def regex_flags(spark, sf):
    return _verdicts(spark, sf).select("run_id", F.array_join("matched", ",").alias("matched"), "flagged")


@query(_FLAG + "SELECT toxic, x.p AS pattern, count(*) AS n FROM v, unnest(matched) AS x(p) GROUP BY 1, 2")
def rule_coverage(spark, sf):
    return R.coverage(_verdicts(spark, sf), ("toxic",))


_RATE = """CAST(coalesce(sum({y}::INT), 0) AS BIGINT) AS n_positive, CAST(coalesce(sum((NOT {y})::INT), 0) AS BIGINT) AS n_negative,
round(sum(({y} AND flagged)::INT) / nullif(sum({y}::INT), 0)::DOUBLE, 6) AS detection, round(sum((NOT {y} AND flagged)::INT) / nullif(sum((NOT {y})::INT), 0)::DOUBLE, 6) AS fpr"""


@query(_FLAG + f"SELECT coalesce(split, 'all') AS split, coalesce(source, 'all') AS source, {_RATE.format(y='toxic')} FROM (SELECT *, CASE WHEN dev THEN 'dev' ELSE 'eval' END AS split FROM v) GROUP BY ROLLUP (split, source)")
def rule_coverage_rollup(spark, sf):
    v = _verdicts(spark, sf).withColumn("split", F.when(F.col("dev"), "dev").otherwise("eval"))
    every = lambda c: F.coalesce(c, F.lit("all")).alias(c)
    return R.rates(v, "toxic", ("split", "source"), rollup=True).select(every("split"), every("source"), "n_positive", "n_negative", r6("detection", "detection"), r6("fpr", "fpr"))


@query(_FLAG + f"SELECT lang, {_RATE.format(y='low')} FROM v GROUP BY lang")
def detection_fpr(spark, sf):
    return R.rates(_verdicts(spark, sf), "low", ("lang",)).select("lang", "n_positive", "n_negative", r6("detection", "detection"), r6("fpr", "fpr"))


# --- localisers; patterns that this data holds stand for the engine's ---

_ERR, _SORRY = r"(^|[ \n])an[ ,.\n]", r"(^|[ \n])en[ ,.\n]"
_LOC = CONTENT + f""", i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, lag(step_index) OVER w AS bef, regexp_matches(text, '(?i){_ERR}') AS err, regexp_matches(text, '(?i){_SORRY}') AS sorry,
  label NOT IN ('orchestrator', 'human') AND NOT contains(label, '(') AS worker, label NOT IN ('user', 'human', 'system') AND NOT contains(label, 'orchestrator') AS local FROM c WINDOW w AS (PARTITION BY run_id ORDER BY step_index)),
k AS (SELECT *, sum(worker::INT) OVER (PARTITION BY run_id ORDER BY i) AS k FROM i),
g AS (SELECT run_id, min(CASE WHEN i = 0 THEN step_index END) AS first, min(CASE WHEN i = least(2, n - 1) THEN step_index END) AS third, min(CASE WHEN i = n // 2 THEN step_index END) AS middle, min(CASE WHEN i = n - 1 THEN step_index END) AS last,
  arg_min(step_index, i) FILTER (err) AS fe, arg_min(coalesce(bef, step_index), i) FILTER (err) AS bfe, arg_min(coalesce(bef, step_index), i) FILTER (sorry) AS bfa, arg_min(step_index, i) FILTER (worker) AS fw, arg_min(step_index, i) FILTER (worker AND k = 2) AS sw, arg_min(step_index, i) FILTER (local) AS fl FROM k GROUP BY run_id)"""


def _localised(spark, sf):
    return R.localised(V.content(spark, sf), _ERR, _SORRY, "(?i)")


@query(_LOC + "SELECT run_id, 'first_error' AS predictor, coalesce(fe, first) AS predicted FROM g UNION ALL SELECT run_id, 'before_first_error', coalesce(bfe, first) FROM g UNION ALL SELECT run_id, 'before_first_apology', coalesce(bfa, first) FROM g")
def first_match_localiser(spark, sf):
    return _localised(spark, sf).where("predictor IN ('first_error', 'before_first_error', 'before_first_apology')")


@query(_LOC + """SELECT run_id, 'first' AS predictor, first AS predicted FROM g UNION ALL SELECT run_id, 'third', third FROM g UNION ALL SELECT run_id, 'middle', middle FROM g UNION ALL SELECT run_id, 'last', last FROM g
UNION ALL SELECT run_id, 'first_worker', coalesce(fw, first) FROM g UNION ALL SELECT run_id, 'second_worker', coalesce(sw, fw, first) FROM g UNION ALL SELECT run_id, 'first_worker_local', coalesce(fl, first) FROM g""")
def positional_localiser(spark, sf):
    return _localised(spark, sf).where("predictor NOT IN ('first_error', 'before_first_error', 'before_first_apology')")


#: The longest message of a run stands for the mistake.
_TRUTH = ", tr AS (SELECT run_id, arg_max(step_index, length(text) * 1000 - step_index) AS mistake_step, arg_max(label, length(text) * 1000 - step_index) AS mistake_agent FROM c GROUP BY run_id)"
_PRED = """, pr AS (SELECT run_id, unnest(['first', 'third', 'middle', 'last', 'first_error', 'before_first_error', 'before_first_apology', 'first_worker', 'second_worker', 'first_worker_local']) AS predictor,
  unnest([first, third, middle, last, coalesce(fe, first), coalesce(bfe, first), coalesce(bfa, first), coalesce(fw, first), coalesce(sw, fw, first), coalesce(fl, first)]) AS predicted FROM g)"""


def _truth(spark, sf):
    c = V.content(spark, sf)
    key = F.length("text") * 1000 - F.col("step_index")
    return c.groupBy("run_id").agg(F.max_by("step_index", key).alias("mistake_step"), F.max_by("label", key).alias("mistake_agent"))


@query(_LOC + _TRUTH + _PRED + """SELECT predictor, count(*) AS n, CAST(sum((predicted = mistake_step)::INT) AS BIGINT) AS step_hits, CAST(sum((abs(predicted - mistake_step) <= 2)::INT) AS BIGINT) AS near_hits,
CAST(sum((c.label = mistake_agent)::INT) AS BIGINT) AS agent_hits FROM pr JOIN tr USING (run_id) LEFT JOIN c ON c.run_id = pr.run_id AND c.step_index = pr.predicted GROUP BY predictor""")
def localiser_scores(spark, sf):
    return R.localiser_scores(_localised(spark, sf), _truth(spark, sf), V.content(spark, sf))


@query(CONTENT + _TRUTH + ", n AS (SELECT run_id, count(*) AS n FROM c GROUP BY 1) SELECT CAST(least(2, mistake_step * 3 // n) AS INTEGER) AS third, count(*) AS runs FROM tr JOIN n USING (run_id) GROUP BY 1")
def position_thirds(spark, sf):
    n = V.content(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return _truth(spark, sf).join(n, "run_id").groupBy(F.least(F.lit(2), F.floor(F.col("mistake_step") * 3 / F.col("n"))).cast("int").alias("third")).agg(F.count(F.lit(1)).alias("runs"))


@query(CONTENT + _TRUTH + ", s AS (SELECT run_id, avg((label = mistake_agent)::INT) AS s FROM c JOIN tr USING (run_id) GROUP BY 1) SELECT round(median(s), 6) AS median_share, count(*) AS runs FROM s")
def routing_weight(spark, sf):
    s = V.content(spark, sf).join(_truth(spark, sf), "run_id").groupBy("run_id").agg(F.avg((F.col("label") == F.col("mistake_agent")).cast("double")).alias("s"))
    return Q.medians(s, (), "s", "median_share").select(r6("median_share", "median_share"), F.col("n").alias("runs"))


@query(CONTENT + ", n AS (SELECT count(*) AS n FROM c GROUP BY run_id) SELECT round(avg(1.0::DOUBLE / n), 6) AS expected FROM n")
def random_hit_rate(spark, sf):
    return V.content(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg(1 / F.col("n")), 6).alias("expected"))


# --- spans: purchases of events stand for prompts, their value for what they show ---

_ASOF = RECORDS + """, k AS (SELECT run_id, step_index, CASE WHEN tool = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS k FROM r),
a AS (SELECT run_id, step_index, last_value(k IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_index ROWS UNBOUNDED PRECEDING) AS bef, first_value(k IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM k)"""


@query(_ASOF + "SELECT run_id, CAST(step_index AS INTEGER) AS step_index, coalesce(aft > coalesce(bef, 0), false) AS covered FROM a")
def asof_prompt_delta(spark, sf):
    r = V.records(spark, sf)
    shows = F.array_join(F.array_repeat(F.lit("Code execution failed"), F.floor("value").cast("int")), " ")
    spans = r.select("run_id", "step_index", F.when(F.col("tool") == "purchase", "LLM").otherwise("TOOL").alias("kind"), shows.alias("l1_text"))
    return R.prompt_delta(spans).select("run_id", "step_index", "covered")


@query(RECORDS + "SELECT run_id, CAST(step_index AS INTEGER) AS step_index, bool_or(status = 'error') OVER (PARTITION BY run_id ORDER BY step_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM r")
def downstream_window_hit(spark, sf):
    r = V.records(spark, sf).withColumn("hit", F.col("status") == "error")
    return R.downstream(r, "hit").select("run_id", "step_index", "near")


@query(CONTENT + f""", g AS (SELECT run_id, bool_or(label = 'user' AND regexp_matches(text, '\\S') AND regexp_matches(text, '(?i){_ERR}')) AS e, arg_max(text, step_index) FILTER (label <> 'user' AND regexp_matches(text, '\\S')) AS m FROM c GROUP BY 1)
SELECT run_id, e AND NOT regexp_matches(coalesce(m, ''), '(?i){_SORRY}') AS flagged FROM g""")
def unacknowledged_error(spark, sf):
    c = V.content(spark, sf)
    side = lambda user: F.when((F.col("label") == "user") == user, F.col("text")).otherwise("")
    steps = c.select("run_id", "step_index", side(True).alias("l2_text"), side(False).alias("l3_text"))
    return R.unacknowledged(steps, _ERR, _SORRY, "(?i)").select("run_id", "flagged")


@query("SELECT doc_id, CAST(CASE WHEN n_chars < 2000 THEN -1 ELSE floor(log2(n_chars // 2000)) END AS INTEGER) AS bin FROM documents")
def token_bins(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.token_bin("n_chars").alias("bin"))


@query(RECORDS + ", b AS (SELECT CAST(step_index // 10 AS INTEGER) AS bin, count(*) AS n, CAST(sum((status = 'error')::INT) AS BIGINT) AS errors FROM r GROUP BY 1) SELECT bin, n, errors, round(errors / n::DOUBLE, 6) AS rate FROM b WHERE n >= 20")
def error_density(spark, sf):
    r = V.records(spark, sf).withColumn("hit", F.col("status") == "error")
    return R.error_density(r, T.step_bin("step_index"), "hit").select("bin", "n", "errors", r6("rate", "rate"))


# --- projections ---


@query("SELECT event_id, substr(sha256(props), 1, 12) AS params_hash FROM events")
def params_hash(spark, sf):
    return V.table(spark, sf, "events").select("event_id", T.short_hash("props").alias("params_hash"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def norm_text(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_text("text")).alias("digest"))


@query("""SELECT c_custkey, lower(regexp_replace(trim(c_mktsegment), '\\s+', '-', 'g')) AS slug, split_part(c_name, '#', 1) AS goal,
CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'auto' WHEN contains(lower(c_mktsegment), 'mach') THEN 'mach' END AS family FROM customer""")
def names(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", T.agent_slug("c_mktsegment").alias("slug"), T.goal_of_instance(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("goal"), T.family_of("c_mktsegment", ["auto", "mach"]).alias("family"))


@query("SELECT run_id, contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'license version 2 0') AS reached FROM (SELECT 'd' || doc_id AS run_id, text FROM documents)")
def reached_boundary(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("run_id"), T.reached(F.array(F.lit("License, Version 2.0")), "text").alias("reached"))


@query("""SELECT o_orderkey, regexp_replace(lower(trim(o_orderpriority)), 's+$', '') AS category, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status,
CAST(TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS INTEGER) AS n, o_orderstatus NOT IN ('None', '') AS has_error, lower(o_orderstatus) = 'true' AS yes, o_orderstatus <> 'None' AS attacked,
array_to_string(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), '+') AS codes, CAST((o_orderkey % 97) // 10 AS INTEGER) AS bin,
CAST((o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 AS DOUBLE) AS duration FROM orders""")
def scalar_projections(spark, sf):
    o = V.table(spark, sf, "orders")
    iso = F.concat(F.lit("PT"), F.col("o_orderkey") % 24, F.lit("H"), F.col("o_orderkey") % 60, F.lit("M"))
    codes = T.codes_of(F.replace("o_orderpriority", F.lit("-"), F.lit(",")))
    return o.select("o_orderkey", T.norm_category("o_orderpriority").alias("category"), T.span_status(F.when(F.col("o_orderstatus") == "F", "Error").otherwise("Unset")).alias("status"),
                    T.int_or_null(F.substring_index("o_orderpriority", "-", 1)).alias("n"), T.has_error("o_orderstatus").alias("has_error"), T.bool_label("o_orderstatus").alias("yes"), T.is_attacked("o_orderstatus").alias("attacked"),
                    F.array_join(codes, "+").alias("codes"), T.step_bin(F.col("o_orderkey") % 97).alias("bin"), F.round(T.duration_ms(iso), 6).alias("duration"))


@query(CONTENT + """SELECT run_id, step_index, label AS seam, split_part(label || ' (x)', ' (', 1) AS speaker, label NOT IN ('orchestrator', 'human') AS worker, label NOT IN ('user', 'human', 'system') AS local_worker FROM c""")
def seam_labels(spark, sf):
    c = V.content(spark, sf)
    seam = T.seam_label(F.lit(""), "label")
    return c.select("run_id", "step_index", seam.alias("seam"), T.speaker(F.concat(seam, F.lit(" (x)"))).alias("speaker"), T.is_worker("label").alias("worker"), T.is_local_worker("label").alias("local_worker"))


@query(RECORDS + """, s AS (SELECT run_id, step_index, props_len FROM (SELECT run_id, step_index, CAST(floor(value) AS BIGINT) AS props_len FROM r) WHERE props_len % 2 = 0)
SELECT r.run_id, CAST(r.step_index AS INTEGER) AS step_index, coalesce(CAST(props_len AS VARCHAR), '[' || tool || ']') AS token FROM r LEFT JOIN s ON s.run_id = r.run_id AND s.step_index = r.step_index""")
def sidecar_join(spark, sf):
    r = V.records(spark, sf)
    s = r.select("run_id", "step_index", F.floor("value").alias("n")).where("n % 2 = 0")
    return r.join(s, ["run_id", "step_index"], "left").select("run_id", "step_index", F.coalesce(F.col("n").cast("string"), F.concat(F.lit("["), F.col("tool"), F.lit("]"))).alias("token"))


@query(RECORDS + """, b AS (SELECT DISTINCT run_id FROM r WHERE base), o AS (SELECT DISTINCT run_id FROM r WHERE NOT base)
SELECT (SELECT count(*) FROM b SEMI JOIN o USING (run_id)) AS straddling, (SELECT count(*) FROM b ANTI JOIN o USING (run_id)) AS baseline_only, (SELECT count(*) FROM o ANTI JOIN b USING (run_id)) AS observed_only""")
def run_sets(spark, sf):
    _, a, b = base_and_rest(spark, sf)
    sides = [x.select("run_id").distinct().withColumn("_x", F.lit(k)) for k, x in ((1, a), (2, b))]
    g = sides[0].unionByName(sides[1]).groupBy("run_id").agg(F.sum("_x").alias("x"))
    count = lambda k: F.count_if(F.col("x") == k)
    return g.agg(count(3).alias("straddling"), count(1).alias("baseline_only"), count(2).alias("observed_only"))


@query(RECORDS + """, k AS (SELECT agent_id, list(DISTINCT tool) AS t FROM r GROUP BY 1) SELECT agent_id, len(list_filter(['click', 'view', 'error'], lambda x: NOT list_contains(t, x))) = 0 AS covered FROM k""")
def tools_covered(spark, sf):
    g = V.records(spark, sf).groupBy("agent_id").agg(F.collect_set("tool").alias("t"))
    return g.select("agent_id", (F.size(F.array_except(F.array(*map(F.lit, ("click", "view", "error"))), "t")) == 0).alias("covered"))


@query(RECORDS + """, i AS (SELECT agent_id, tool, row_number() OVER (PARTITION BY agent_id ORDER BY us, event_id) AS k FROM r) SELECT agent_id, count(*) AS n, CAST(sum((tool = 'view')::INT) AS BIGINT) AS views FROM i WHERE k <= 20 GROUP BY agent_id""")
def horizon(spark, sf):
    e = C.numbered(V.records(spark, sf), STREAM, ORDER).where(F.col("event_index") < 20)
    return e.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("tool") == "view").cast("long")).alias("views"))


# --- trials over the runs of events: those of goal g3 stand for the injected ones ---

TRIALS = 3
_PERM = RECORDS + f""", ids AS (SELECT DISTINCT run_id FROM r WHERE goal_id <> 'g3'),
pm AS (SELECT t.trial, run_id, row_number() OVER (PARTITION BY t.trial ORDER BY md5(t.trial || ':' || run_id), run_id) - 1 AS pos, count(*) OVER (PARTITION BY t.trial) AS n FROM ids, (SELECT unnest(range({TRIALS})) AS trial) t)"""


def _classes(spark, sf):
    r = V.records(spark, sf)
    ids = r.select("run_id", "goal_id").distinct()
    return r, trials.hashed(ids.where("goal_id <> 'g3'").select("run_id"), TRIALS), ids.where("goal_id = 'g3'").select("run_id")


@query(_PERM + """, x AS (SELECT trial, r.run_id, tool, count(*) AS n FROM pm JOIN r USING (run_id) WHERE pos < pm.n // 2 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY trial, tool) AS tn, sum(n) OVER (PARTITION BY trial) AS an, sum(n) OVER (PARTITION BY trial, run_id) AS rn FROM x),
l AS (SELECT trial, run_id, sum(n * -log2(coalesce(CASE WHEN tn > n AND an > rn THEN (tn - n) / (an - rn)::DOUBLE END, 1e-4))) / sum(n) AS s FROM t GROUP BY 1, 2),
h AS (SELECT trial, max(s) * 1.05 AS threshold FROM l GROUP BY 1), d AS (SELECT trial, tool, any_value(tn) / any_value(an)::DOUBLE AS p FROM t GROUP BY 1, 2),
c AS (SELECT trial, run_id, false AS bad FROM pm WHERE pos >= n // 2 UNION ALL SELECT trial, run_id, true FROM (SELECT DISTINCT run_id FROM r WHERE goal_id = 'g3'), (SELECT DISTINCT trial FROM pm)),
z AS (SELECT c.trial, c.run_id, bad, avg(-log2(coalesce(p, 1e-4))) AS s FROM c JOIN r USING (run_id) LEFT JOIN d ON d.trial = c.trial AND d.tool = r.tool GROUP BY 1, 2, 3)
SELECT CAST(trial AS INTEGER) AS trial, round(threshold, 6) AS threshold, CAST(sum((NOT bad)::INT) AS BIGINT) AS n_benign, CAST(sum(bad::INT) AS BIGINT) AS n_injected,
CAST(sum((NOT bad AND s > threshold)::INT) AS BIGINT) AS fp, CAST(sum((bad AND s > threshold)::INT) AS BIGINT) AS tp FROM z JOIN h USING (trial) GROUP BY trial, threshold""")
def per_run_trials(spark, sf):
    r, benign, injected = _classes(spark, sf)
    return trials.per_run_trials(r, benign, injected, 1.05).withColumn("threshold", F.round("threshold", 6))


@query(_PERM + """, s AS (SELECT trial, pos >= n // 2 AS late, CAST(step_index // 10 AS INTEGER) AS bin, sum((status IN ('error', 'abort'))::INT)::DOUBLE AS e, count(*)::DOUBLE AS n FROM pm JOIN r USING (run_id) GROUP BY 1, 2, 3),
j AS (SELECT a.trial, a.e AS e0, a.n AS n0, b.e AS e1, b.n AS n1, (a.e + b.e) / (a.n + b.n) AS p FROM s a JOIN s b ON a.trial = b.trial AND a.bin = b.bin AND NOT a.late AND b.late AND b.n >= 30)
SELECT CAST(t.trial AS INTEGER) AS trial, CAST(coalesce(k, 0) AS BIGINT) AS flags FROM (SELECT DISTINCT trial FROM pm) t LEFT JOIN (SELECT trial, count(*) AS k FROM j WHERE (e1 / n1 - e0 / n0) / CASE WHEN p * (1 - p) = 0 THEN 1e-12 ELSE sqrt(p * (1 - p) * (1 / n0 + 1 / n1)) END > 0.5 GROUP BY 1) USING (trial)""")
def split_half_decay(spark, sf):
    r, benign, _ = _classes(spark, sf)
    return trials.split_half_decay(r, benign, 0.5)


#: The grammar of shell words as RE2 has it; quotes are doubled within SQL's.
_PART = r"""[^ \t\r\n''"\\]+|\\.|''[^'']*''|"(?:[^"\\]|\\.)*\""""
_LEXED = CONTENT + rf""", l AS (SELECT run_id, step_index, label, list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\v\f]'), lambda x: CASE
  WHEN regexp_full_match(x, '(?s)(?:[ \t\r\n]+|{_PART})*') THEN list_transform(regexp_extract_all(x, '(?s)(?:{_PART})+'), lambda w: array_to_string(list_transform(regexp_extract_all(w, '(?s){_PART}'), lambda p: CASE
    WHEN p[1] = chr(39) THEN p[2:-2] WHEN p[1] = '"' THEN regexp_replace(p[2:-2], '\\(["\\])', '\1', 'g') WHEN p[1] = chr(92) THEN p[2:] ELSE p END), ''))
  ELSE list_filter(regexp_split_to_array(x, '[ \t\r\n\v\f\x{{a0}}]+'), lambda w: w <> '') END) AS lines FROM c),
k AS (SELECT run_id, step_index, CASE WHEN len(flatten(lines)) = 0 THEN [label] ELSE list_transform(flatten(lines), lambda w: CASE WHEN regexp_full_match(w, '\p{{Nd}}+(\.\p{{Nd}}+)?') THEN '<num>'
  WHEN regexp_full_match(w, '[0-9a-fA-F-]{{12,}}') THEN '<hex>' WHEN length(w) > 64 THEN '<long>' ELSE w END) END AS words FROM l),
u AS (SELECT run_id, step_index, unnest(words) AS tool, unnest(range(len(words))) AS j FROM k) """


@query(_LEXED + "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY step_index, j) - 1 AS INTEGER) AS step_index, tool FROM u")
def command_tokens(spark, sf):
    c = V.content(spark, sf)
    records = c.select("run_id", "step_index", F.col("label").alias("tool"))
    return E.token_records(records, c.select("run_id", "step_index", F.col("text").alias("l1_text")))


@query(_SEG.replace("PARTITION BY agent_id ORDER BY us, event_id", "ORDER BY us, event_id").replace("PARTITION BY agent_id ORDER BY event_index", "ORDER BY event_index") + "SELECT segment, model_version, count(*) AS n, CAST(min(event_index) AS BIGINT) AS start FROM s GROUP BY segment, model_version")
def global_version_segments(spark, sf):
    s = D.segments(V.records(spark, sf).drop("step_index"), ORDER, stream=())
    return s.groupBy("segment", "model_version").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("start"))


# the rest, by subject: they register themselves
from . import corpus_queries, pattern_queries, trial_queries  # noqa: E402, F401
