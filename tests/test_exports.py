"""The package's exports, and channels of a caller's own."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

import veerline
from veerline.operators import channels as C


def test_exports():
    assert all(callable(getattr(veerline, n)) or n.isupper() for n in veerline.__all__) and "freeze" in dir(veerline)
    with pytest.raises(AttributeError, match="nothing"):
        veerline.nothing


@dataclass(frozen=True)
class Unknown:
    """Alarms at tools that the baseline lacks."""

    def verdicts(self, events, dist, stream, on=(), block=None):
        known = events.join(dist.select(*on, "tool", F.lit(True).alias("_k")), [*on, "tool"], "left")
        return known.withColumn("score", F.lit(1.0)).withColumn("alarmed", F.col("_k").isNull())


def test_channels_of_ones_own(spark):
    tools = {"a": "xyxyxyxyxyxzxyzz", "b": "xyxyxyxyxyxyxyxyxy"}
    events = spark.createDataFrame([(s, i, t) for s, ts in tools.items() for i, t in enumerate(ts)], "s string, event_index long, tool string")
    dist = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "tool string, p double")
    own = {"divergence": C.Divergence(window=4, threshold=0.05, patience=2), "cusum": C.Cusum(threshold=3.0), "unknown": Unknown()}
    got = {(r["s"], r["channel"]): (r["event_index"], round(r["score"], 6)) for r in C.regimes(events, dist, ("s",), own).collect()}
    assert got["a", "unknown"] == (11, 1.0) and ("b", "unknown") not in got
    both = {(r["s"], r["channel"]): (r["event_index"], round(r["score"], 6)) for r in C.two_regime(events, dist, ("s",), own["divergence"], own["cusum"]).collect()}
    assert {k: v for k, v in got.items() if k[1] != "unknown"} == both and ("a", "cusum") in both
    with pytest.raises(ValueError, match="no channels"):
        C.regimes(events, dist, ("s",), {})
