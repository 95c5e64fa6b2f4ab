"""Near-duplicates: minima of universal hashes, banding, signature verification, exact confirmation, components.

1. Each text becomes its set of distinct shingles (hashed to 64 bits), a hash of that set, and PERMUTATIONS minima
   of universal hashes. Texts of equal sets form a class; only its smallest doc_id goes on.
2. The minima are cut into bands. Representatives whose band is equal share a bucket. In each bucket the most
   central member (the one in the largest buckets over all bands) is the pivot; every other member is compared with
   it on the full sets: as many comparisons as members, not all pairs. Components follow from the links found.
   A bucket's members are dealt over SALTS tasks in joins, so that one with a third of all rows is split.
3. Members of one pivot that are still in several components may be linked with each other. With the sizes a and r
   of what they have beyond the pivot's set and what they lack of it, two members x and y that share nothing beyond
   it differ in a(x) + a(y) + |r(x) - r(y)| shingles or more. So only such pairs are candidates that this bound
   lets pass, or that share a shingle beyond the pivot's set. Shingles that more than RARE members of the pivot
   have beyond its set are left out of a, which only loosens the bound, and needn't be paired. With what is allowed to
   a member, g(x) = allowed * n(x) - a(x), the bound says that the intervals r(x) +- g(x) overlap: a join of intervals,
   cut into strips of r; strips with many members are dealt over up to BLOCKS tasks. The rule is exact: no pair of a bucket is lost, and no
   bucket's pairs are listed.
4. Candidates are dropped if their sizes or signatures rule the similarity out; the rest is confirmed on the full
   sets. Components by large-star and small-star.

The number of rows a band is chosen so that two texts at the very threshold meet in no band with a
probability of 1e-6 at most.

Defined results: null texts and texts without words have size 0 and are linked with nothing; texts with fewer
words than a shingle are one shingle; rows of equal doc_id are one document, with all of its texts; a row whose
doc_id is null is kept and has a null component; an empty table gives an empty table; columns other than doc_id
and text aren't read; doc_ids that are no numbers count as null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import SALTS, components
from .hashing import BASE, mix, shingles, words
from .shared import drop_staged, kept, staged, table
from .token_ids import few

#: Words a shingle and similarity in percent, of near-duplicate stages and of the query.
WORDS, PERCENT = 5, 80
QUERY_WORDS, QUERY_PERCENT = 3, 85
PERMUTATIONS, MISS = 192, 1e-6
#: Standard deviations by which a signature may fall short of the threshold.
SIGMAS = 5
#: Members of a pivot that may share a shingle beyond its set so that they are paired by it.
RARE = 16
#: A document with more than this part of all pairs is joined apart: there are 1 / HOT_SHARE at most on a side.
HOT_SHARE = 0.001
#: Tasks over which the members of a strip are dealt when they meet each other, at most; members for each of them.
BLOCKS, STRIP_ROWS = 16, 500
#: Identifiers (of 8 bytes each) that are broadcast to pick texts; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def bands(percent: int) -> tuple[int, int]:
    """(bands, rows a band)."""
    t = percent / 100
    rows = max(r for r in range(1, PERMUTATIONS + 1) if r == 1 or (1 - t**r) ** (PERMUTATIONS // r) <= MISS)
    return PERMUTATIONS // rows, rows


def least_agreement(percent: int) -> int:
    """Bytes of two signatures that are equal at least, if the texts are similar enough."""
    t = percent / 100
    return max(0, int(PERMUTATIONS * t - SIGMAS * (PERMUTATIONS * t * (1 - t)) ** 0.5))


@lru_cache(maxsize=1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64)
    c = mix(n * np.uint64(BASE))
    return c[:PERMUTATIONS, None] | np.uint64(1), c[PERMUTATIONS:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of (a x + b mod 2 ** 64) >> 32 over a set of 64-bit numbers, for each (a, b)."""
    a, b = _coefficients()
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (a * s[None, i : i + 2048] + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    h = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(BASE) + sig[k : n * rows : rows].astype(np.uint64))
    return h.view(np.int64)


def _sketches(n_words: int, percent: int):
    n, rows = bands(percent)

    def run(batches):
        kept("near_duplicates")
        for batch in batches:
            texts, out = [t or "" for t in batch.column("text").to_pylist()], ([], [], [], [])
            for part in few(texts):
                for h in words(texts[part]):
                    s = shingles(h, n_words)
                    sig = signature(s) if len(s) else None
                    out[0].append(len(s))
                    out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    out[2].append(band_hashes(sig, n, rows) if len(s) else None)
                    out[3].append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_shingles", "set_hash", "bands", "sig"])

    return run


def _agree(least: int):
    """Keeps the pairs whose signatures have so many equal bytes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for c in ("sig_u", "sig_v"))
                batch = batch.filter(pa.array((a == b).sum(axis=1) >= least))
            yield batch.select(["u", "v"])

    return run


def _confirm(n_words: int, percent: int):
    """Keeps the pairs whose sets of shingles are similar enough."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist()
            keep = []
            for part in few([a + b for a, b in zip(left, right, strict=True)]):
                seen = list(dict.fromkeys([*left[part], *right[part]]))
                sets = {t: shingles(h, n_words) for t, h in zip(seen, words(seen), strict=True)}
                for t, o in zip(left[part], right[part], strict=True):
                    a, b = sets[t], sets[o]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return run


def _compare(n_words: int):
    """Sizes of the two sets of each pair (pivot u, member v), of what they share, and what v has beyond u."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist()
            out = ([], [], [], [])
            for part in few([a + b for a, b in zip(left, right, strict=True)]):
                seen = list(dict.fromkeys([*left[part], *right[part]]))
                sets = {t: shingles(h, n_words) for t, h in zip(seen, words(seen), strict=True)}
                for t, o in zip(left[part], right[part], strict=True):
                    more = np.setdiff1d(sets[o], sets[t], assume_unique=True)
                    for column, x in zip(out, (len(sets[t]), len(sets[o]), len(sets[o]) - len(more), more.view(np.int64)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["u", "v", "n_u", "n_v", "both", "more"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (u, v; staged) with both texts. Documents with more than HOT_SHARE of all pairs are few by their number: their
    texts go to SALTS times SALTS tasks, the others' to one."""
    limit, many = HOT_SHARE * pairs.count(), SALTS * SALTS
    for s, other in ("uv", "vu"):
        hot = F.broadcast(pairs.groupBy(s).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(limit, SALTS)).select(s, F.lit(many).cast("long").alias("_k")))
        salts = F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)) - 1)
        side = texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")).join(hot, s, "left").withColumn("_s", F.explode(salts)).drop("_k")
        salted = pairs.join(hot, s, "left").withColumn("_s", F.pmod(F.xxhash64(other), F.coalesce("_k", F.lit(1)))).drop("_k")
        pairs = salted.join(side, [s, "_s"]).drop("_s")
    return pairs


def _salted(rows: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with the columns of one, which has a row a value of keys: it goes to each of the tasks that share the rows
    of a value, which are dealt by another column."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return salted.hint("merge").join(one.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "_s"]).drop("_s")


def _left_over(compared: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) among the members of each pivot that are in different components."""
    rows = compared.select(F.col("u").alias("p"), F.col("v").alias("x"), F.col("n_v").alias("n"), (F.col("n_u") - F.col("both")).alias("r"), "more")
    rows = rows.join(root.select(F.col("u").alias("x"), F.col("v").alias("root")), "x", "left").withColumn("comp", F.coalesce("root", "x")).drop("root")
    open_ = rows.groupBy("p").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("p")
    rows = staged(_salted(rows, open_, ["p"], "x"), "open")
    each = rows.select("p", "x", "comp", F.explode("more").alias("s"))
    often = each.groupBy("p", "s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = staged(_salted(each, often, ["p", "s"], "x"), "shared")
    rare = shared.where(F.col("k") <= RARE)
    by_shingle = rare.alias("l").join(rare.alias("r"), ["p", "s"]).where("l.x < r.x AND l.comp != r.comp").select(F.col("l.x").alias("u"), F.col("r.x").alias("v"))
    common = shared.where(F.col("k") > RARE).groupBy("p", "x").agg(F.count(F.lit(1)).alias("c"))
    sized = rows.join(common, ["p", "x"], "left").select("p", "x", "comp", "n", "r", (F.size("more") - F.coalesce("c", F.lit(0))).alias("a"))
    # what a member differs from others by at least is no more than what is allowed to it and its largest partner
    allowed = F.lit((100 - percent) / (100 + percent) + 1e-9)
    sized = staged(sized.where(F.col("a") <= allowed * (F.col("n") + F.col("n") * 100 / percent)), "sized")
    sized = sized.withColumn("g", allowed * F.col("n") - F.col("a"))
    # strips as wide as the widest interval of a pivot: an interval lies in three at most; two meet in the one of the greater lower end
    wide = sized.groupBy("p").agg(F.greatest(F.lit(1.0), 2 * F.max("g")).alias("width"), F.max("g").alias("widest"))
    # below zero, g must be made up for by another's
    sized = _salted(sized, wide, ["p"], "x").where("g >= -widest").drop("widest")
    strip = lambda at: F.floor(at / F.col("width"))
    low, high = F.col("r") - F.col("g"), F.col("r") + F.col("g")
    # where g is negative, an interval is turned round, and overlaps what holds it whole
    cut = sized.withColumn("strip", F.explode(F.sequence(strip(F.least(low, high)), strip(F.greatest(low, high)))))
    # a strip with one member has no pair; only one with many is dealt over several tasks
    many = cut.groupBy("p", "strip").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("k") / STRIP_ROWS)).cast("long").alias("blocks")
    cut = staged(_salted(cut, many.select("p", "strip", blocks), ["p", "strip"], "x"), "strips")
    left = cut.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    right = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    bound = F.expr("abs(l.r - r.r) <= l.g + r.g")
    meet = left.alias("l").hint("merge").join(right.alias("r"), ["p", "strip", "block"]).where(F.expr("l.x < r.x AND l.comp != r.comp") & bound)
    by_bound = meet.select(F.col("l.x").alias("u"), F.col("r.x").alias("v"))
    return by_shingle.unionByName(by_bound).distinct()


def near_duplicates(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sig binary"
    sketches = staged(texts.mapInArrow(_sketches(n_words, percent), schema), "sketches")
    classes = sketches.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_hash")
    classes = staged(classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    every = classes.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # the members of all buckets that have several
    members = staged(_salted(every, shared, ["bucket"], "rep").select("bucket", "rep", "n"), "members")
    central = staged(members.groupBy("rep").agg(F.sum("n").alias("weight")), "central")
    n = central.count()
    few_ids = (lambda ids: F.broadcast(ids)) if n <= MOST_BROADCAST else (lambda ids: ids)
    texts = staged(texts.join(few_ids(central.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi"), "texts")
    best = members.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("p"))
    pairs = _salted(members, best.select("bucket", (-F.col("p.rep")).alias("u")), ["bucket"], "rep").where(F.col("u") != F.col("rep")).select("u", F.col("rep").alias("v")).distinct()
    pairs = staged(pairs, "pairs")
    schema = "u long, v long, n_u long, n_v long, both long, more array<long>"
    compared = staged(_with_texts(pairs, texts).mapInArrow(_compare(n_words), schema), "compared")
    found = compared.where(100 * F.col("both") >= percent * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v")
    root = components(found)
    more = _left_over(compared, root, percent)
    sides = [classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "uv"]
    more = more.join(sides[0], "u").join(sides[1], "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    more = staged(more.select("u", "v", "sig_u", "sig_v").mapInArrow(_agree(least_agreement(percent)), "u long, v long"), "likely")
    more = _with_texts(more, texts).mapInArrow(_confirm(n_words, percent), "u long, v long").distinct()
    links = components(more.unionByName(root))
    rows = sketches.select("doc_id", "n_shingles", "set_hash").join(classes.select("set_hash", "rep"), "set_hash", "left")
    rows = rows.join(links.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY_WORDS, QUERY_PERCENT)


#: By all pairs that share a shingle, and a closure over the links: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, k, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS x FROM (SELECT doc_id, k, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
s AS (SELECT DISTINCT doc_id, k, x FROM e),
n AS (SELECT w.doc_id, w.k, count(s.x) AS n FROM w LEFT JOIN s ON s.k = w.k GROUP BY w.doc_id, w.k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.a = n.doc_id
"""
