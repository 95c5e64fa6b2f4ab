r"""Words of shell commands in built-in expressions: one grammar of quotes and escapes, with possessive loops throughout, which Java's regular expressions run without
recursion, however long a command is.

A line is blanks, plain characters, \c, '...' and "...". Words are what blanks outside of quotes part. Taken out of its quotes, \c is c, '...' is verbatim, and
"..." knows \" and \\ only. A line with an open quote, or a backslash at its end, falls back to words between white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Words longer than this are told by their kind alone.
LONGEST_WORD = 64
_SPACE = r" \t\r\n"
_QUOTED = r"""'[^']*+'|"(?:[^"\\]++|\\.)*+\""""
_PLAIN = rf"""[^{_SPACE}'"\\]++"""
WORD = rf"(?s)((?:{_PLAIN}|\\.|{_QUOTED})++)"
#: Parts of a word, which may hold blanks only within quotes.
PART = rf"(?s)({_PLAIN}|\\.|{_QUOTED})"
WHOLE = rf"(?s)\A(?:[{_SPACE}]++|{_PLAIN}|\\.|{_QUOTED})*+\z"
#: Where a text's lines end, and what parts words where quotes don't count.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++"


def _bare(part: Column) -> Column:
    """A part without its quotes or its escape."""
    inner = F.substring(part, F.lit(2), F.length(part) - 2)
    return (F.when(part.startswith("'"), inner).when(part.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(part.startswith("\\"), F.substring(part, F.lit(2), F.lit(2))).otherwise(part))


def words_of_line(line: Column) -> Column:
    quoted = F.transform(F.regexp_extract_all(line, F.lit(WORD)), lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(PART)), _bare), ""))
    plain = F.filter(F.split(line, BLANKS), lambda w: w != "")
    return F.when(line.rlike(WHOLE), quoted).otherwise(plain)


def shell_words(text) -> Column:
    """Words of all lines of a text, in order; none for null."""
    return F.flatten(F.transform(F.split(F.coalesce(col(text), F.lit("")), LINE_ENDS), words_of_line))


def command_tokens(text, tool) -> Column:
    """Words of a command's lines; numbers, hexadecimal identifiers and long words by their kind; the tool, if there is no word."""
    kind = lambda w: (F.when(w.rlike(r"(?U)\A\d++(?:\.\d++)?+\z"), "<num>").when(w.rlike(r"\A[0-9a-fA-F-]{12,}+\z"), "<hex>")
                      .when(F.length(w) > LONGEST_WORD, "<long>").otherwise(w))
    words = F.transform(shell_words(text), kind)
    return F.when(F.size(words) > 0, words).otherwise(F.array(col(tool)))
