"""Transcript text functions (TX-1 .. TX-8, TX-10).

All of them are built-in expressions on one string column, so they stay inside
whole-stage code generation and never move a row between JVM and Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.split() and str.strip() treat as
# white space. Java's \s and SQL's trim() know only some of them.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for Java: Unicode white space plus the four separator controls. Many
# times faster than a class that lists the characters.
PY_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """White space removed at both ends."""
    return F.btrim(_c(col), F.lit(PY_SPACE))


def rstrip(col) -> Column:
    """White space removed at the right end."""
    return F.rtrim(_c(col), F.lit(PY_SPACE))


def strip_dots(col) -> Column:
    """TX-3: every leading and trailing ``.`` removed."""
    return F.btrim(_c(col), F.lit("."))


def normalize_letters(col) -> Column:
    """TX-1: a letter-spelled transcript as words, ``"H E | L O"`` -> ``"he lo"``.

    One ``translate`` drops all white space and turns the word mark into a blank.
    """
    return F.trim(F.translate(F.lower(_c(col)), "|" + PY_SPACE, " "))


def ensure_period(col) -> Column:
    """TX-2: stripped text that ends with a full stop."""
    c = strip(col)
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def unescape_hyp(col) -> Column:
    """TX-4: a stored hypothesis without outer dots; ``#`` is a tab, ``*`` a newline."""
    return F.translate(strip_dots(col), "#*", "\t\n")


def first_sentence(col) -> Column:
    """TX-5, training: the text before the first dot, right-stripped, closed by a dot."""
    return F.concat(rstrip(F.substring_index(_c(col), ".", 1)), F.lit("."))


def first_line(col) -> Column:
    """TX-5, generated hypothesis: first line, then dots off, then white space off."""
    return strip(strip_dots(F.substring_index(_c(col), "\n", 1)))


def clean_target(col) -> Column:
    """TX-5, generation target: white space off, then dots off (the opposite order)."""
    return strip_dots(strip(col))


def render_answer(col) -> Column:
    """TX-6: the answer as it stands in a prompt."""
    return F.concat(F.lit(" "), _c(col), F.lit("\n"))


def render_label(col) -> Column:
    """TX-6: the label probe; the leading blank is part of the token."""
    return F.concat(F.lit(" "), _c(col))


def split_words(col) -> Column:
    """TX-7: words between white-space runs, no empty words."""
    c = strip(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, PY_SPACE_RUN))


def normalizer_for(dataset, text) -> Column:
    """TX-8: training transcript by corpus kind, so one job serves mixed corpora.

    ``libri`` is letter-spelled, ``flickr`` and ``voxceleb`` are plain; another name
    is an error. Every transcript ends with a full stop.
    """
    d = _c(dataset)
    plain = d.contains("flickr") | d.contains("voxceleb")
    body = (
        F.when(d.contains("libri"), normalize_letters(text))
        .when(plain, strip(text))
        .otherwise(F.raise_error(F.concat(d, F.lit(" not implemented"))))
    )
    return ensure_period(body)


def checkpoint_path(template, v) -> Column:
    """TX-10: ``{v}`` in a checkpoint template replaced by the sweep variable."""
    return F.replace(_c(template), F.lit("{v}"), _c(v).cast("string"))


def model_tag(path) -> Column:
    """TX-10: second component of a checkpoint path."""
    return F.get(F.split(_c(path), "/"), F.lit(1))
