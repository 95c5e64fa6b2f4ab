"""Secret scan with ownership frequency over the whole corpus.

Pass 1 finds spans in each text: the base kinds (assign, access, hex) and further candidates
(long tokens that mix letters and digits). Each candidate's value is hashed.
Pass 2 counts, for each hash, the distinct repositories and the distinct owners that hold it:
distinct (hash, repository) and (hash, owner) pairs are formed first, so that a value found in a
third of all rows is spread over many tasks. Verdicts, in this order:
  copied   COPIED owners or more hold it, or WIDE repositories or more, whoever owns them: an example that people copy
  example  it doesn't look like a credential (too regular, or a placeholder)
  live     a single owner holds it
  shared   two owners or more, but not COPIED
Candidates that aren't within a base span become spans of kind live if they are judged live; they may overlap base
spans. Base spans always stay.

Hashes of more than HOT_SHARE of all spans are few by their number, so they are broadcast; only the others are joined
by a shuffle, where none of them is large.

Here a document is a repository and its source is the owner.

Defined results: null and empty texts have no spans; a null owner is one owner of its own; equal
rows are rated each on its own, but count once for the frequencies if doc_id and owner are equal;
an empty table gives an empty table; columns other than doc_id, text and source aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, staged, table

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run that is long enough is what is left of AKIA[A-Z0-9]+ and [0-9a-f]+ after short ones are dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
LEAST_ASSIGNED = 12
#: Bits a character that a live value has at least; owners, and repositories, from which on a value counts as copied.
LEAST_BITS, COPIED, WIDE = 2.5, 3, 100
#: A value with more than this part of all spans is joined apart: there are 1 / HOT_SHARE such values at most.
HOT_SHARE = 0.001
#: Rows with something to put out (some 200 bytes each) that are broadcast; more of them are joined by a shuffle.
MOST_ROWS = 100_000
PLACEHOLDER = re.compile(r"example|sample|placeholder|dummy|changeme|your|xxxx|0000|1234", re.I | re.A)
_SPAN = "array<struct<kind:string,start:int,end:int,hash:binary,live:boolean>>"
SCHEMA = f"spans {_SPAN}"


def looks_live(value: str) -> bool:
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= LEAST_BITS and not PLACEHOLDER.search(value)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of each base span and candidate of a text, in order of start, then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base, i, reach = sorted((x[1], x[2]) for x in found), 0, -1
    for m in CANDIDATE.finditer(text):
        # both lists are in order: reach is the furthest end of a base span that starts here or before
        while i < len(base) and base[i][0] <= m.start():
            reach, i = max(reach, base[i][1]), i + 1
        value = m[0]
        if reach < m.end() and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.append(("live", m.start(), m.end(), value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan_batches(column: str):
    def run(batches):
        kept("secrets")
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                out.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16],
                             "live": looks_live(v)} for k, a, b, v in scan(text)] if text else [])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("live", pa.bool_())]))
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != column]
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, kind)], [*names, "spans"])

    return run


def spans(docs: DataFrame, copied: int = COPIED, wide: int = WIDE) -> DataFrame:
    """uid, doc_id and spans of each row of docs: structs (start, k, end, kind, verdict, owners, repos), in order of
    start, then kind. Candidates that aren't live are left out."""
    rows = docs.select("doc_id", F.col("source").alias("owner"), "text")
    found = rows.mapInArrow(_scan_batches("text"), f"doc_id {dict(docs.dtypes)['doc_id']}, owner string, {SCHEMA}")
    found = staged(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = found.select("uid", "doc_id", "owner", F.explode("spans").alias("s")).select("uid", "doc_id", "owner", "s.*")
    # one hash and owner, or repository, a row, then one a hash; a null is a value of its own
    own = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    counts = each.groupBy("hash").agg(F.count_distinct(own("owner")).alias("owners"), F.count_distinct(own("doc_id")).alias("repos"), F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "secret-owners")
    limit = HOT_SHARE * (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot, cold = (counts.where(c).drop("n") for c in (F.col("n") > limit, F.col("n") <= limit))
    # 1 / HOT_SHARE rows at most
    few = F.broadcast(hot)
    rated = each.join(few, "hash").unionByName(each.join(few.select("hash"), "hash", "left_anti").join(cold, "hash"))
    verdict = (F.when((F.col("owners") >= copied) | (F.col("repos") >= wide), "copied").when(~F.col("live"), "example")
               .when(F.col("owners") == 1, "live").otherwise("shared"))
    judged = rated.withColumn("verdict", verdict).where((F.col("kind") != "live") | (F.col("verdict") == "live"))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    by_row = judged.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("k"), "end", "kind", "verdict", "owners", "repos"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,verdict:string,owners:bigint,repos:bigint>>")
    # the rows that have spans are few: the others needn't meet them in a join
    with_spans = found.where(F.size("spans") > 0).select("uid", "doc_id").join(by_row, "uid", "left")
    without = found.where(F.size("spans") == 0).select("uid", "doc_id", none.alias("spans"))
    return with_spans.withColumn("spans", F.coalesce("spans", none)).unionByName(without)


def op2_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "live")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    judged = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return d.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"),
                    joined(F.col("spans")).alias("spans"), judged("live").alias("n_live"), judged("copied").alias("n_copied"),
                    F.array_join(F.transform("spans", lambda s: F.concat_ws("/", s["owners"], s["repos"])), ",").alias("owners_repos"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", copied: int = COPIED, wide: int = WIDE) -> DataFrame:
    """docs with the spans that are judged live or shared, base spans and others, put out of the text; no row is dropped.

    Widely copied values and placeholders stay. Spans that overlap are put out as one."""
    names = docs.columns
    rows = staged(docs.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row")), "redact")
    plain = rows.select(F.col("row").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.text").alias("text"))
    bad = spans(plain, copied, wide).select(F.col("doc_id").alias("row"), F.filter("spans", lambda s: s["verdict"].isin("live", "shared")).alias("spans")).where(F.size("spans") > 0)
    bad = staged(bad.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), "secret-spans")
    hit = rows.join(F.broadcast(bad) if bad.count() <= MOST_ROWS else bad, "row", "left")
    rest = lambda at: F.substring("doc.text", at + 1, F.lit(2**31 - 1))
    put = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["text"], F.substring("doc.text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at")))
    merged = F.aggregate("spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), put, lambda acc: F.concat(acc["text"], rest(acc["at"])))
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(merged)
    out = hit.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("doc", F.col("doc").withField("n_chars", F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))))
    return out.withColumn("doc", F.col("doc").withField("text", F.col("text"))).select("doc.*")


#: Places come from the lengths of what is between the matches; values themselves stand for their hashes.
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
{matches},
m AS (SELECT k, kind, o, a, a + length(v) AS z, w FROM (
  SELECT *, CAST(sum(length(g)) OVER q + sum(length(v)) OVER q - length(v) AS BIGINT) AS a FROM e WINDOW q AS (PARTITION BY k, kind ORDER BY i ROWS UNBOUNDED PRECEDING))
  WHERE CASE kind WHEN 'assign' THEN length(w) >= 12 WHEN 'access' THEN length(v) >= 18 WHEN 'hex' THEN length(v) >= 16 ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
f AS (SELECT * FROM m WHERE kind <> 'live' OR NOT EXISTS (SELECT 1 FROM m b WHERE b.k = m.k AND b.kind <> 'live' AND b.a <= m.a AND m.z <= b.z)),
c AS (SELECT w, x, count(*) AS n FROM (SELECT w, unnest(string_split(w, '')) AS x FROM (SELECT DISTINCT w FROM f)) GROUP BY 1, 2),
l AS (SELECT w, -sum(n / length(w)::DOUBLE * log2(n / length(w)::DOUBLE)) >= 2.5 AND NOT regexp_matches(w, '(?i)example|sample|placeholder|dummy|changeme|your|xxxx|0000|1234') AS live FROM c GROUP BY w),
n AS (SELECT w, count(DISTINCT coalesce('s' || source, 'n')) AS owners, count(DISTINCT coalesce('s' || doc_id, 'n')) AS repos FROM f JOIN d USING (k) GROUP BY w),
j AS (SELECT f.*, owners, repos, CASE WHEN owners >= 3 OR repos >= 100 THEN 'copied' WHEN NOT live THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict FROM f JOIN l USING (w) JOIN n USING (w)),
r AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) FILTER (kind <> 'live'), '') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied, string_agg(owners || '/' || repos, ',' ORDER BY a, o) AS owners_repos
  FROM j WHERE kind <> 'live' OR verdict = 'live' GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(owners_repos, '') AS owners_repos
FROM d LEFT JOIN r USING (k)
"""
#: The patterns, with letters in either case spelt out; the value is what an assignment assigns, else all of it.
_PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "live": "[A-Za-z0-9+/_-]{24,}={0,2}",
}
_MATCHES = """x{o} AS (SELECT k, regexp_extract_all(t, '{rx}') AS v, regexp_split_to_array(t, '{rx}') AS g FROM d),
e{o} AS (SELECT k, '{kind}' AS kind, {o} AS o, i, v[i] AS v, g[i] AS g, {value} AS w FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM x{o}))"""
_PARTS = [_MATCHES.format(o=o, kind=kind, rx=rx, value=f"regexp_extract(v[i], '{rx}', 2)" if kind == "assign" else "v[i]") for o, (kind, rx) in enumerate(_PATTERNS.items())]
SQL = _SQL.replace("{matches}", ",\n".join([*_PARTS, "e AS (" + " UNION ALL ".join(f"SELECT * FROM e{o}" for o in range(len(KINDS))) + ")"]))
