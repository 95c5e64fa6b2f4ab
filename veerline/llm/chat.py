r"""Conversations as training sequences: rendered whole, encoded once with offsets, with a loss mask over what assistants say.

A turn is rendered as "### role: text</turn>\n". Within a role or text a backslash is put before a backslash, before each # that follows a #, and into
</turn> (and before a colon of a role), so that control strings occur only where the template writes them; taking the
backslashes out again gives the text back. Tokens never cross the borders of a text: the text and what the template writes between texts are pre-tokens apart.

Rows are dealt by ranges of (conv_id, turn) and sorted, and each task renders its rows as they come. A conversation of any length is cut at turns into
segments of about AT_ONCE characters; as tokens don't cross borders of turns, segments side by side are the whole conversation's encoding. The
offsets of all tokens follow from the lengths of their bytes. Spans of assistants' texts and spans of tokens are both sorted, so that a binary
search finds the first and the last token of each span; a token is masked if it shares a character with a span.

The digest of a conversation is read back from the written segments. Those that are whole in one segment are read in place; the others (at the borders of ranges, or
cut) are streamed in order, one conversation in one task, as a digest of one sequence asks for, with a batch in memory.

Defined results: null roles and texts become empty; rows without a conv_id (or one that is no number) are left out; a null turn comes first, rows of equal turn
are in the order of role and text, and repeated rows are turns of their own; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions_for, staged, table
from .token_ids import encoder, vocabulary

OPEN, AFTER_ROLE, CLOSE, SPEAKER = "### ", ": ", "</turn>\n", "assistant"
#: Characters and turns of a segment.
AT_ONCE, MOST_TURNS = 1_000_000, 4096
_SEGMENT = ("conv_id long, segment long, whole boolean, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")

# --- the template ---

_CONTROL = re.compile(r"\\|(?<=#)#|(?<=<)(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:\\.|[^\\:])*): ", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return OPEN + escaped(role).replace(":", "\\:") + AFTER_ROLE


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    out = []
    for turn in text.split(CLOSE)[:-1]:
        m = _ROLE.match(turn, len(OPEN))
        out.append((unescaped(m.group(1)), unescaped(turn[m.end() :])))
    return out


def covered(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token (sorted starts and ends) shares a character with a span (sorted rows of start and end, apart)."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0


def encoded(pieces: list[list[str]], vocab: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, ends) of each list of pieces, whose borders are borders of tokens; offsets count characters of all its pieces."""
    enc = encoder(vocab)
    ids = enc.ids_of([p for parts in pieces for p in parts])
    out, at = [], 0
    for parts in pieces:
        own = np.concatenate([np.zeros(0, enc.kind), *ids[at : at + len(parts)]])
        at += len(parts)
        upto = np.cumsum(enc.token_len[own])
        raw = np.frombuffer("".join(parts).encode(), np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80)  # of the character that a byte belongs to, from 1
        out.append((own, place[upto - enc.token_len[own]] - 1, place[upto - 1]))
    return out


# --- segments ---


class _Segment:
    def __init__(self, conv_id: int, first: bool):
        self.conv_id, self.pieces, self.said, self.turns, self.chars, self.whole = conv_id, [""], [], 0, 0, not first

    def add(self, role: str, text: str) -> None:
        """pieces: what the template writes, a text, what it writes, a text, and so on."""
        text = escaped(text)
        self.pieces[-1] += header(role)
        self.pieces += [text, CLOSE]
        self.said.append(role == SPEAKER)
        self.turns += 1
        self.chars += len(self.pieces[-3]) + len(text)

    def full(self) -> bool:
        return self.chars >= AT_ONCE or self.turns >= MOST_TURNS


def _rows(segments: list[tuple[int, _Segment]], vocab: str) -> pa.RecordBatch:
    cols: dict[str, list] = {c: [] for c in ("conv_id", "segment", "whole", "n_turns", "text", "ids", "starts", "ends", "loss")}
    for (k, s), (ids, starts, ends) in zip(segments, encoded([s.pieces for _, s in segments], vocab), strict=True):
        upto = np.cumsum([len(p) for p in s.pieces])
        spans = np.stack([upto[0:-1:2], upto[1::2]], axis=1)[np.array(s.said, bool)]
        row = (s.conv_id, k, s.whole, s.turns, "".join(s.pieces), ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), covered(starts, ends, spans))
        for c, x in zip(cols.values(), row, strict=True):
            c.append(x)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), kinds, strict=True)], list(cols))


def formatted(conversations: DataFrame, vocab: str) -> DataFrame:
    """conv_id, segment (ascending within a conversation), whole (surely the only segment), n_turns, text (as rendered), ids, starts and ends
    (characters of text) and loss of each token; written once."""

    def run(batches):
        k, now, done, chars = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is not None and (now.conv_id != conv_id or now.full()):
                    if now.conv_id == conv_id:
                        now.whole = False
                    done.append((k, now))
                    k, chars = k + 1, chars + now.chars
                    now, cut = _Segment(conv_id, False), not done[-1][1].whole and done[-1][1].conv_id == conv_id
                    now.whole = not cut
                    if chars >= AT_ONCE:
                        yield _rows(done, vocab)
                        done, chars = [], 0
                elif now is None:
                    now = _Segment(conv_id, True)  # may have begun in the range before
                now.add(role, text)
        if now is not None:
            now.whole = False  # may go on in the next range
            yield _rows([*done, (k, now)], vocab)

    rows = conversations.select(F.col("conv_id").try_cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = ("conv_id", "turn", "role", "text")
    dealt = rows.where("conv_id IS NOT NULL").repartitionByRange(partitions_for(rows.sparkSession), *order).sortWithinPartitions(*order)
    return staged(dealt.select("conv_id", "role", "text").mapInArrow(run, _SEGMENT), "chat")


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> None:
        for role, said in parsed(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        change = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]])))
        for a, b in zip(change[::2], change[1::2], strict=True):
            said = unescaped(text[starts[a] : ends[b - 1]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from what formatted() wrote."""

    def run(batches):
        last, d = None, None
        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                conv_id = batch.column("conv_id")[row].as_py()
                if conv_id != last:
                    if d is not None:
                        done.append((last, *d.row()))
                    last, d = conv_id, _Digest()
                arrays = (np.asarray(batch.column(c)[row].values) if c != "loss" else batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                d.add(batch.column("text")[row].as_py(), *arrays)
            if done:
                yield rows(done)
        if d is not None:
            yield rows([(last, *d.row())])

    def rows(done):
        names = [f.split()[0] for f in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)

    columns = ("conv_id", "text", "starts", "ends", "loss")
    whole = segments.where("whole").select(*columns).mapInArrow(run, _READ)
    rest = segments.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment").select(*columns).mapInArrow(run, _READ)
    return whole.unionByName(rest)


#: A conversation that says what the template writes.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], given.schema)
    return read_back(formatted(given.unionByName(own), vocabulary()))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|#|</turn>')) - len(regexp_extract_all(role || ' ' || text, '#+'))
  + len(regexp_extract_all(role, ':')) + 14 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
