"""Projections of single values: names, identifiers, times, labels, pattern flags. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import FAILURE_SIGNATURES, FLAGS

#: Origin of synthetic times, in seconds.
TS_BASE = 1_760_000_000.0
#: Shell tools whose command's first word names the call.
SHELLS = ("bash_command", "Bash", "bash")
#: Records a step bin; tokens of the first token bin.
BIN_WIDTH, TOKEN_BASE = 10, 2000
DEV_MOD = 5


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tool_name(function, command, shells=SHELLS) -> Column:
    """The first word of a shell call's command, else the function's name."""
    function, command = col(function), col(command)
    return F.when(function.isin(*shells) & command.rlike(r"\S"), F.regexp_extract(command, r"(\S+)", 1)).otherwise(F.coalesce(function, F.lit("")))


def seam_label(name, role) -> Column:
    blank = lambda c: F.nullif(col(c), F.lit(""))
    return F.coalesce(blank(name), blank(role), F.lit(""))


def speaker(label) -> Column:
    """What stands before the first " (" of a label."""
    return F.substring_index(col(label), " (", 1)


def is_worker(label) -> Column:
    return ~F.lower(speaker(label)).isin("orchestrator", "human") & ~F.contains(col(label), F.lit("("))


def is_local_worker(role) -> Column:
    low = F.lower(col(role))
    return ~F.contains(low, F.lit("orchestrator")) & ~low.isin("user", "human", "system")


def goal_of_instance(instance) -> Column:
    """An instance's name up to its last hyphen."""
    return F.regexp_replace(col(instance), "-[^-]*$", "")


def submission_epoch(name) -> Column:
    """Seconds of the date that a name starts with (YYYYMMDD_), in UTC; the origin if there is none."""
    digits = F.regexp_extract(col(name), r"^(\d{8})_", 1)
    days = F.datediff(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.coalesce(days.cast("double") * 86400.0, F.lit(TS_BASE))


def family_of(name, families: list[str]) -> Column:
    """The first of the families, in their order, that a name contains without regard to case."""
    out = None
    for f in families:
        hit = F.contains(F.lower(col(name)), F.lit(f))
        out = F.when(hit, f) if out is None else out.when(hit, f)
    return out


def agent_slug(agent) -> Column:
    slug = F.regexp_replace(F.trim(F.lower(col(agent))), r"\s+", "-")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def short_hash(text) -> Column:
    """The first 12 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 12)


def duration_ms(raw) -> Column:
    """Milliseconds of an ISO 8601 duration of days to seconds; 0 if it can't be read."""
    n = r"(?:(\d+(?:\.\d+)?)"
    pattern = rf"^P{n}D)?(?:T{n}H)?{n}M)?{n}S)?)?$"
    raw = col(raw)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(raw, pattern, k), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(raw.rlike(pattern), (part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)) * 1000).otherwise(F.lit(0.0))


def epoch(raw, fallback) -> Column:
    """Seconds of an ISO 8601 time (UTC, if it names no zone), else the fallback."""
    return F.coalesce(F.try_to_timestamp(col(raw)).cast("double"), col(fallback).cast("double"))


def step_bin(step) -> Column:
    return F.floor(col(step) / BIN_WIDTH).cast("int")


def token_bin(tokens) -> Column:
    """-1 below TOKEN_BASE tokens, then 0, 1, 2 and so on for each doubling."""
    t = F.floor(col(tokens) / TOKEN_BASE)
    return F.when(col(tokens) < TOKEN_BASE, -1).otherwise(F.length(F.bin(t.cast("long"))) - 1).cast("int")


def token_bin_label(b) -> Column:
    low = lambda k: F.pow(F.lit(2.0), k).cast("int") * (TOKEN_BASE // 1000)
    return F.when(col(b) < 0, F.lit(f"<{TOKEN_BASE // 1000}k")).otherwise(F.concat(low(col(b)).cast("string"), F.lit("k-"), low(col(b) + 1).cast("string"), F.lit("k")))


def norm_category(raw) -> Column:
    """Trimmed, lower case, without any s at its end; failures become failure."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col(raw), F.lit("")))), "s+$", "")
    return F.replace(bare, F.lit("failures"), F.lit("failure"))


def norm_text(raw) -> Column:
    """Lower case with a blank for each run of other characters than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(col(raw)), "[^a-z0-9]+", " "))


def is_dev(run_id) -> Column:
    """Whether a run is in the development split: SHA-256 as a number, modulo 5, is 0. As 16 is 1 modulo 5, the sum of its
    parts of eight digits decides.

    No lambdas: a filter on the names of files is worked out by the driver, by several threads at once where a plan scans them more
    than once, and lambdas of one expression share their variables."""
    digits = F.sha2(col(run_id), 256)
    return sum((F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(8)), F.lit(0)) % DEV_MOD == 0


def output_text(l2, l3) -> Column:
    return F.concat(F.coalesce(col(l2), F.lit("")), F.lit("\n"), F.coalesce(col(l3), F.lit("")))


def has_error(value) -> Column:
    return col(value).isNotNull() & ~col(value).isin("None", "")


def span_status(code) -> Column:
    return F.when(col(code) == "Error", "error").otherwise("ok")


def bool_label(value) -> Column:
    return F.coalesce(F.lower(F.trim(col(value).cast("string"))) == "true", F.lit(False))


def int_or_null(value) -> Column:
    """Integers as Python reads them: with blanks around, a sign, and single underscores between digits."""
    text = F.trim(col(value).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(text, "_", "").try_cast("int"))


def is_attacked(attack_type) -> Column:
    return col(attack_type).isNotNull() & (col(attack_type) != "None")


def codes_of(label) -> Column:
    """The codes of a label: none for "0", else its parts at commas."""
    return F.when(col(label) == "0", F.array().cast("array<string>")).otherwise(F.transform(F.split(col(label), ","), lambda c: F.trim(c)))


def without_trailing_commas(text) -> Column:
    return F.regexp_replace(col(text), r",(\s*[\]}])", "$1")


def matched(text, family: dict[str, str], flags: str = FLAGS) -> Column:
    """Names of the patterns that a text holds, in their order."""
    hits = F.array(*(F.when(col(text).rlike(flags + rx), F.lit(name)) for name, rx in family.items()))
    return F.filter(hits, lambda x: x.isNotNull())


def flagged(text, family: dict[str, str], least: int = 1, flags: str = FLAGS) -> Column:
    return F.coalesce(F.size(matched(text, family, flags)) >= least, F.lit(False))


def holds(text, pattern: str, flags: str = FLAGS) -> Column:
    return F.coalesce(col(text).rlike(flags + pattern), F.lit(False))


def prompt_failures(kind, l1) -> Column:
    """Execution failures that a prompt of a language model shows; null for other spans."""
    return F.when(col(kind) == "LLM", F.regexp_count(F.coalesce(col(l1), F.lit("")), F.lit(FLAGS + FAILURE_SIGNATURES["exec_error"])))


def reached(injected, text) -> Column:
    """Whether one of the injected strings, normalised, is in a text, normalised."""
    plain = norm_text(text)
    return F.exists(F.coalesce(col(injected), F.array().cast("array<string>")), lambda s: F.contains(plain, norm_text(s)))
