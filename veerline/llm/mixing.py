"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in a fixed shuffled order (md5 of the identifier), served PASSES times. A document
is a run of fragments of QUANTUM words at most, as packets are in a network. A fragment's virtual finish time is the
number of its source's words up to its end, divided by the source's target. All fragments of all sources are put in the
order of finish time (ties by source) and taken until the total budget is used up; the last one is cut.

The global order is range-sorted: the words of each range of finish times are added up first (a row a range), which tells
the range in which the budget ends; only that range is sorted, and every fragment is compared with the place found. A
source's taken words differ from its target by less than two fragments.

The place in a queue is a two-level prefix sum, too: sizes are added up by source and hash range, then each range is
summed on its own, so that a source that holds most rows is spread over many tasks. Ranges grow with the rows.

The mix itself deals texts by their range of finish times: one shuffle, in which the few hash ranges that lie
across a border go to both sides. Texts are read again rather than written between.

Defined results: null texts and texts without words have size 0 and are never taken; a null
source is a source of its own, ordered last; repeated rows count as documents of their own;
an empty table gives an empty table; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, drop_staged, staged, table, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take in all, as a multiple of all words; most that a source can give, as a multiple of its size.
BUDGET, MOST = 1.5, 2
#: Times that a queue is served; words of a fragment.
PASSES, QUANTUM = 2, 512
#: Documents of a hash range (more only beyond 16 ** MOST_DIGITS ranges), words of a range of the mix, hash ranges for each of those.
RANGE_ROWS, PART_WORDS, FINER, MOST_DIGITS = 1000, 4_000_000, 8, 5
#: Hash ranges of all sources (of some 80 bytes) that are broadcast; more of them are joined by a shuffle.
MOST_GROUPS = 200_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) of (skey, source, source_size): water-filling in closed form.

    With sources in the order of cap per weight, those are capped that precede the first one
    whose cap is above its share of what the capped ones leave."""
    # one row a source: a table of aggregates
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.lit(weights[-1])
    for k in range(len(weights) - 1):
        weight = F.when((F.col("n") - 1) % len(weights) == k, weights[k]).otherwise(weight)
    w = (ranked.withColumn("weight", weight.cast("long"))
         .withColumn("cap", most * F.col("source_size")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = (w.withColumn("left", left).withColumn("rest", rest)
         .withColumn("open", F.col("cap") * F.col("rest") > F.col("left") * F.col("weight")))
    first = F.struct(F.col("cap") / F.col("weight"), F.col("n"))
    w = (w.withColumn("first", F.min(F.when(F.col("open"), F.struct(first.alias("at"), "left", "rest"))).over(every)))
    share = F.col("first.left") * F.col("weight") / F.col("first.rest")
    capped = F.col("first").isNull() | (first < F.col("first.at"))
    return w.select("skey", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _finish(end: Column, k) -> Column:
    """Virtual finish time of a source's words up to end in pass k."""
    return (end + k * F.col("source_size")) / F.col("target")


def _fragments(k) -> Column:
    """Fragments of a document in pass k: words and finish time."""
    n = F.ceil(F.col("size") / QUANTUM).cast("int")
    one = lambda j: F.struct(
        F.least(F.lit(QUANTUM), F.col("size") - j * QUANTUM).cast("long").alias("words"),
        _finish(F.col("start") + F.least(F.col("size"), (j + 1) * QUANTUM), k).alias("at"))
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array())


class Queues:
    """The queues of docs: their ranges, and where the budget ends in the global order."""

    def __init__(self, docs: DataFrame, size: Column | None = None, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST):
        self.sizes = staged(_sized(docs, size).drop("tie"), "mix")
        n, words = self.sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.budget = int(budget * words)
        self.parts = max(1, -(-self.budget // PART_WORDS))
        self.digits = 1
        while self.digits < MOST_DIGITS and 16**self.digits < max(n / RANGE_ROWS, FINER * self.parts):
            self.digits += 1
        ranges = self.sizes.groupBy("skey", self.range_of().alias("range")).agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
        prefix = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        totals = ranges.groupBy("skey").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
        before = ranges.select("skey", "range", "range_size", F.coalesce(F.sum("range_size").over(prefix), F.lit(0)).alias("before"))
        self.groups = staged(before.join(targets(totals, weights, budget, most), "skey"), "mix-ranges")
        here = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = self.sizes.withColumn("range", self.range_of()).withColumn("upto", F.sum("size").over(here)).join(self.groups, ["skey", "range"])
        self.placed = staged(placed.select("doc_id", "source", "skey", "size", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("start")), "mix-places")
        self.cut = self._cut(16**self.digits)

    def range_of(self) -> Column:
        return F.substring("key", 1, self.digits)

    def _cut(self, ranges: int) -> tuple[float, str, int] | None:
        """Finish time and source of the last fragment taken, and its words that are; None if nothing is."""
        every = F.flatten(F.array(*(_fragments(k) for k in range(PASSES))))
        at = F.least(F.floor(F.col("f.at") * ranges), F.lit(2 * ranges)).cast("long")
        rows = self.placed.select("skey", F.explode(every).alias("f")).select("skey", "f.words", "f.at", at.alias("range"))
        # one row a range of finish times
        sums = rows.groupBy("range").agg(F.sum("words").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("range")))
        last = sums.where(F.col("upto") >= self.budget).orderBy("range").first() if self.budget else None
        if last is None:
            return None
        left = self.budget - (last["upto"] - last["n"])
        # the fragments of one range, in one order
        here = rows.where(F.col("range") == last["range"]).withColumn("upto", F.sum("words").over(Window.orderBy("at", "skey").rowsBetween(Window.unboundedPreceding, 0)))
        end = here.where(F.col("upto") >= left).orderBy("upto").first()
        return end["at"], end["skey"], left - (end["upto"] - end["words"])

    def taken(self, k) -> Column:
        """Words of a document that pass k takes."""
        if self.cut is None:
            return F.lit(0).cast("long")
        at, skey, words = self.cut
        part = lambda f: F.when((f["at"] < at) | ((f["at"] == at) & (F.col("skey") < skey)), f["words"]).when((f["at"] == at) & (F.col("skey") == skey), F.lit(words)).otherwise(F.lit(0))
        return F.aggregate(_fragments(k), F.lit(0).cast("long"), lambda a, f: a + part(f).cast("long"))


def _sized(docs: DataFrame, size: Column | None, *keep: Column) -> DataFrame:
    return docs.select(
        "doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"), F.xxhash64(*docs.columns).alias("tie"), *keep)


def queue(docs: DataFrame, size: Column | None = None, **how) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, start (its place in the queue), first and
    second (words taken in each pass), finish (virtual finish time of the first pass)."""
    q = Queues(docs, size, **how)
    return q.placed.select("doc_id", "source", "size", "source_size", "target", "start", q.taken(0).alias("first"), q.taken(1).alias("second"),
                           F.when(F.col("target") > 0, _finish(F.col("start") + F.col("size"), 0)).alias("finish"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs in the order of virtual finish time, once for each pass that takes
    them; a document at which a source is cut holds the words taken."""
    q = Queues(docs, **how)
    parts = lambda at: F.least(F.floor(at * q.parts), F.lit(q.parts)).cast("int")  # noqa: E731  the last: times beyond 1
    # ranges of finish times in which a hash range's documents may end, in each pass
    g = q.groups.where("target > 0 AND range_size > 0").withColumn("pass", F.explode(F.array(*(F.lit(k) for k in range(PASSES)))))
    first, last = _finish(F.col("before"), F.col("pass")), _finish(F.col("before") + F.col("range_size"), F.col("pass"))
    g = g.where(first <= (q.cut[0] if q.cut else -1.0)).withColumn("part", F.explode(F.sequence(parts(first), parts(last)))).drop("range_size")
    near = F.broadcast if q.groups.count() <= MOST_GROUPS else (lambda x: x)
    rows = _sized(docs, None, F.struct("*").alias("doc")).withColumn("range", q.range_of()).join(near(g), ["skey", "range"])
    here = Window.partitionBy("part", "skey", "range", "pass").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # parts are ranges of finish times: dealt by their numbers, files in order hold the mix in order
    rows = rows.repartitionById(q.parts + 1, F.col("part")).withColumn("start", F.col("before") + F.sum("size").over(here) - F.col("size"))
    rows = rows.withColumn("at", _finish(F.col("start") + F.col("size"), F.col("pass"))).where(F.col("part") == parts(F.col("at")))
    rows = rows.withColumn("taken", q.taken(F.col("pass"))).where("taken > 0")
    words = F.split(F.btrim("doc.text", F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+")
    cut = F.concat_ws(" ", F.slice(words, F.lit(1), F.col("taken").cast("int")))
    out = rows.withColumn("doc", F.col("doc").withField("text", F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(cut)))
    if "n_chars" in docs.columns:
        out = out.withColumn("doc", F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)))
    drop_staged(q.sizes, q.placed)
    return out.sortWithinPartitions("part", "at", "doc.doc_id").select("doc.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), n) AS pos FROM w),
p AS (SELECT *,
        1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lft,
        (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest
      FROM o),
f AS (SELECT min(pos) AS pos FROM p WHERE cap::DOUBLE * rest > lft * weight),
t AS (SELECT p.source, p.source_size,
        CASE WHEN f.pos IS NULL OR p.pos < f.pos THEN p.cap::DOUBLE
             ELSE (SELECT q.lft FROM p q WHERE q.pos = f.pos) * p.weight / (SELECT q.rest FROM p q WHERE q.pos = f.pos) END AS target
      FROM p, f),
c AS (SELECT row_number() OVER () AS id, d.doc_id, d.size, t.source_size, t.target, coalesce('s' || d.source, 'n') AS skey,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT id, skey, least(512, size - 512 * j) AS words, CAST(start + pass * source_size + least(size, 512 * (j + 1)) AS DOUBLE) / target AS finish
      FROM (SELECT *, unnest(range(0, CAST(ceil(size / 512.0) AS BIGINT))) AS j FROM c), (SELECT unnest([0, 1]) AS pass) WHERE target > 0),
u AS (SELECT id, words, sum(words) OVER (ORDER BY finish, skey ROWS UNBOUNDED PRECEDING) AS upto FROM g),
b AS (SELECT floor(1.5 * sum(size)) AS budget FROM d),
k AS (SELECT id, CAST(sum(greatest(0, least(words, budget - upto + words))) AS BIGINT) AS taken FROM u, b GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN k USING (id)
"""
