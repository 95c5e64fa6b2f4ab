"""What built-in expressions can't say: Python's canonical JSON.

They run as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value) -> str:
    """JSON with sorted keys and Python's spacing and escapes."""
    return json.dumps(value, sort_keys=True, default=str)


def plain_or_canonical(value) -> str:
    return "" if value is None else value if isinstance(value, str) else canonical(value)


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null if a text is none."""
    return raw.map(_recoded(canonical))


@F.pandas_udf(StringType())
def json_text(raw: pd.Series) -> pd.Series:
    """Strings verbatim, null as empty, other JSON values in canonical form."""
    return raw.map(_recoded(plain_or_canonical))


@F.pandas_udf(StringType())
def json_hash(raw: pd.Series) -> pd.Series:
    """First 12 digits of the SHA-256 of the canonical form."""
    return raw.map(_recoded(lambda v: hashlib.sha256(canonical(v).encode()).hexdigest()[:12]))


def _recoded(what):
    def one(raw):
        if raw is None or (isinstance(raw, float) and raw != raw):
            return what(None)
        try:
            return what(json.loads(raw))
        except ValueError:
            return None

    return one
