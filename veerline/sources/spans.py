"""The two readings of a document that depend on the order of its parts: span trees, and results paired with calls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.canonical import plain_or_canonical


def _spans(raw: str) -> list[str] | None:
    """Spans of a trace as JSON without their children, parents first; None if it is no trace."""
    try:
        trace = json.loads(raw)
        stack = list(reversed(trace["spans"]))
        out = []
        while stack:
            span = stack.pop()
            children = span.get("child_spans") or []
            out.append(json.dumps({k: v for k, v in span.items() if k != "child_spans"}))
            stack.extend(reversed(children))
        return out
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


@F.pandas_udf(ArrayType(StringType()))
def _flattened(raw: pd.Series) -> pd.Series:
    return raw.map(_spans)


def spans_of(traces: DataFrame) -> DataFrame:
    """run_id, place, span of traces (run_id, text): the span tree in depth-first order; a null span for no trace."""
    return traces.select("run_id", F.posexplode_outer(_flattened("text")).alias("place", "span"))


def _result(content) -> str:
    """Text of a result: blocks of text are joined, if all are blocks of text."""
    if isinstance(content, list):
        blocks = [b.get("content") or b.get("text") if isinstance(b, dict) else None for b in content]
        if all(isinstance(b, str) for b in blocks):
            return "\n".join(blocks)
    return plain_or_canonical(content)


def _paired(raw: str | None) -> list[str]:
    """The result of each assistant call in order: by identifier, else the first call that has none yet."""
    try:
        messages = json.loads(raw or "[]")
    except ValueError:
        return []
    results: dict[int, str] = {}
    place: dict[str, int] = {}
    waiting: dict[int, None] = {}
    n = 0
    for m in messages if isinstance(messages, list) else []:
        if not isinstance(m, dict):
            continue
        if m.get("role") == "assistant":
            for call in m.get("tool_calls") or []:
                if call.get("id"):
                    place[call["id"]] = n
                waiting[n] = None
                n += 1
        elif m.get("role") == "tool":
            at = place.get(m.get("tool_call_id") or "")
            if at is None:
                if not waiting:
                    continue
                at = next(iter(waiting))
            waiting.pop(at, None)
            results[at] = _result(m.get("content"))
    return [results.get(i, "") for i in range(n)]


@F.pandas_udf(ArrayType(StringType()))
def paired_results(raw: pd.Series) -> pd.Series:
    """Results of the calls in messages (a JSON array), in the order of the calls."""
    return raw.map(_paired)
