"""Pattern families over runs that are cut into pieces, against the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veerline.functions import patterns as P
from veerline.functions import text as T
from veerline.operators import rules
from veerline.operators import runs as R

FAMILIES = {**P.FAMILIES, "spaced": {"two": r"tee\s+(-a\s+)?/var", "late": r"echo\s+[^\n]*build\s+[0-9]"}}
WORDS = ["find", "grep", "verifier", "echo", "build", "12", "tee", "-a", "/var/lib/dpkg/status", ">>", "bypass", "fake", "the", "checker", "pass", "TODO", "message from x", "to you", "<INFORMATION>", "404", "x", "|", "sed -i",
         "ignore", "all", "previous", "api", "key", "", " ", "\t", "\n", "\n\n", " \n\n\n ", "\u2028"]


def content(spark, rows):
    return spark.createDataFrame(rows, "run_id string, step_index int, l1_text string").repartition(3)


@pytest.mark.parametrize("sep", ["\n", ""])
@pytest.mark.parametrize("size", [8, 256])
def test_pieces_hold_what_the_text_holds(spark, sep, size):
    rng = random.Random(f"{sep} {size}")
    rows = [(f"r{r:03d}", i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6))) + rng.choice(["", "\n"])) for r in range(60) for i in range(rng.randint(0, 25))]
    rows += [("null", 0, None), ("blank", 0, ""), ("blank", 1, "\n\n")]
    df = content(spark, rows)
    for dedup in (False, True):
        whole = R.run_texts(df, "l1_text", sep, dedup)
        for name, family in FAMILIES.items():
            want = {r["run_id"]: r["m"] for r in whole.where("text <> ''").select("run_id", T.matched("text", family).alias("m")).collect()}
            got = {r["run_id"]: r["matched"] for r in rules.matches(df, "l1_text", family, sep, dedup, size=size).collect()}
            assert got == want, name
        assert any(want.values())


def test_a_match_across_borders(spark):
    """Over hundreds of blank lines, and from one piece to the next."""
    family = {"two": r"tee\s+(-a\s+)?/var"}
    for lead in range(8):
        rows = [("a", i, "x") for i in range(lead)] + [("a", 100, "tee"), *(("a", 101 + i, " ") for i in range(300)), ("a", 900, "-a"), ("a", 901, "\n\n"), ("a", 902, "/var"), ("b", 0, "tee"), ("b", 1, "y"), ("b", 2, "/var")]
        got = {r["run_id"]: r["matched"] for r in rules.matches(content(spark, rows), "l1_text", family, size=4).collect()}
        assert got == {"a": ["two"], "b": []}


def test_crossings():
    assert rules.crossings(r"a\s+b\s*c\\\\s") == 2
    assert all(rules.crossings(rx) < 10 for f in P.FAMILIES.values() for rx in f.values())
    for bad in (r"[^|]*x", r"\W+", r"(?s)a.b", r"a\nb"):
        with pytest.raises(ValueError, match="lines"):
            rules.crossings(bad)


def test_no_task_holds_a_run(spark):
    plan = rules.matches(content(spark, [("a", i, f"line {i}") for i in range(2000)]), "l1_text", P.COMMAND_RULES)
    assert plan.collect() == [("a", [])] or plan.first()["matched"] == []
    assert re.search("bit_or", plan._jdf.queryExecution().toString())
    assert plan.select(F.size("matched")).first()[0] == 0
