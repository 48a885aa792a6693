"""Text, ratio and JSON expressions used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    """Timestamp text with seconds and zone offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def percentage(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 unless both are positive."""
    ok = (part > 0) & (whole > 0)
    return F.when(ok, F.lit(100.0) * part.cast("double") / whole.cast("double")).otherwise(0.0)


def drop_rate(dropped: Column, passed: Column) -> Column:
    """``dropped / passed``, 0 when nothing passed."""
    return F.when(passed == 0, F.lit(0.0)).otherwise(
        F.try_divide(dropped.cast("double"), passed.cast("double"))
    )


def drop_label(kernel: Column, parser: Column, analysis: Column, passed: Column) -> Column:
    """Text such as ``Dropped: 1+2+0=3 ( 0.30%)``."""
    total = kernel + parser + analysis
    return F.format_string(
        "Dropped: %d+%d+%d=%d (%5.2f%%)",
        kernel, parser, analysis, total, drop_rate(total, passed) * 100,
    )


def flat_key(*fields: Column) -> Column:
    """One string from several key fields, each closed by a NUL character."""
    return F.concat(*[F.concat(f.cast("string"), F.lit("\0")) for f in fields])


def try_int(text: Column) -> Column:
    """Whole decimal number with optional sign, or null (no blanks, no fractions)."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("long"))


def words(line: Column) -> Column:
    """Line split at every single blank; adjacent blanks give empty words."""
    return F.split(line, " ", -1)


def ascii_word(word: Column) -> Column:
    """Whether a command word consists of ASCII letters only."""
    return word.rlike(r"^[a-zA-Z]+\z")


def strip_line_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \r\n"))
