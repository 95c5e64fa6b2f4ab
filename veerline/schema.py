"""Tables of the engine as Spark schemas, and a strict reader of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_TEXT = StringType()


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RECORD = _struct(ts=DoubleType(), run_id=_TEXT, agent_id=_TEXT, model=_TEXT, model_version=_TEXT, goal_id=_TEXT, step_index=IntegerType(), tool=_TEXT,
                 params_hash=_TEXT, status=_TEXT, duration_ms=DoubleType(), meta=MapType(_TEXT, _TEXT))
GOAL_SPEC = _struct(goal_id=_TEXT, terminal_tool=_TEXT, min_steps=IntegerType(), max_steps=IntegerType(), max_duplicate_calls=IntegerType())
CONTENT = _struct(run_id=_TEXT, step_index=IntegerType(), tool=_TEXT, l1_text=_TEXT, l2_text=_TEXT, l3_text=_TEXT)
ALARM = _struct(stream=_TEXT, channel=_TEXT, event_index=LongType(), score=DoubleType())

#: Defaults of a goal's contract.
MIN_STEPS, MAX_STEPS, MAX_DUPLICATES = 3, 200, 1
#: Fields that a record may leave out.
OPTIONAL = ("meta",)


class BadRecord(ValueError):
    """A record that lacks a field or has an unknown one."""


def checked(raw: DataFrame) -> DataFrame:
    """Records from a table with a column line of JSON objects: unknown and missing fields are errors, which a
    permissive parser would pass over. Blank lines are left out."""
    names = F.json_object_keys("line")
    known = F.array(*map(F.lit, RECORD.fieldNames()))
    needed = F.array(*(F.lit(n) for n in RECORD.fieldNames() if n not in OPTIONAL))
    fault = (F.when(names.isNull(), F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 80)))
             .when(F.size(F.array_except(names, known)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_except(names, known), ",")))
             .when(F.size(F.array_except(needed, names)) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_except(needed, names), ","))))
    rows = raw.where(F.trim("line") != "").withColumn("fault", fault)
    parsed = F.from_json(F.when(F.col("fault").isNull(), F.col("line")).otherwise(F.raise_error(F.col("fault"))), RECORD, {"mode": "FAILFAST"})
    others = [c for c in raw.columns if c != "line"]
    out = rows.withColumn("record", parsed).select(*others, "record.*")
    return out.withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))
