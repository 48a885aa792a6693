"""Key patterns: linear-time regular expression syntax mapped to Java's.

Both dialects agree on most patterns.  What is mapped: named groups, POSIX classes, ``$`` (end of
text only), ``[`` or ``&&`` inside a class (plain characters), white space, octal numbers and
scripts.  What is refused: look-around, backreferences, possessive quantifiers, the ungreedy flag and
every escape that is not known to both, none of which the source dialect has (or has with another
meaning).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# POSIX class names and their Java spelling.
POSIX_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "ascii": "ASCII",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}

_REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\(\?[ims]*U|[*+?}]\+")
_ESCAPE = (
    r"\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|[pP]\{\^?\w+\}|[pP][A-Z]|0[0-7]{0,2}|[1-7][0-7]{1,2}|.)"
)
_BARE = re.compile(_ESCAPE + r"|\[\^?\]?(?:\\.|[^\]])*\]", re.DOTALL)
_PIECES = re.compile(
    r"(?P<quoted>\\Q.*?(?:\\E|$))|(?P<escape>" + _ESCAPE + r")|(?P<posix>\[:(?P<not>\^?)(?P<name>\w+):\])"
    r"|(?P<group>\(\?P<)|(?P<open>\[\^?\]?)|(?P<close>\])|(?P<and>&&)|(?P<end>\$)|(?P<other>.)",
    re.DOTALL,
)


# Escapes with the same meaning in both dialects, anywhere and outside classes only.
_SAME, _SAME_OUTSIDE = "afnrtdDwW", "AbBz"


class BadPattern(ValueError):
    """A key pattern that does not compile."""


def _escape(text: str, in_class: bool) -> str:
    """The Java spelling of one escape; raises :class:`BadPattern` for any that is not listed."""
    letter = text[1]
    if letter in _SAME or (letter in _SAME_OUTSIDE and not in_class):
        return text
    if letter == "v":  # one character, where Java has a class
        return r"\x0B"
    if letter == "s":  # without the vertical tab that Java counts in
        return r"\t\n\f\r " if in_class else r"[\t\n\f\r ]"
    if letter == "S":
        return r"\S\x0B" if in_class else r"[\S\x0B]"
    if letter in "01234567" and (letter == "0" or len(text) > 2):
        return f"\\x{{{int(text[1:], 8):X}}}"
    if letter in "123456789":
        raise BadPattern(f"backreference {text!r}")
    if letter == "x" and len(text) > 2:
        return text
    if letter in "pP" and len(text) > 2:
        name = text[2:].strip("{}")
        negated = (letter == "P") != name.startswith("^")
        name = name.lstrip("^")
        # One or two letters are a general category, longer names a script.
        return f"\\{'P' if negated else 'p'}{{{name if len(name) < 3 else f'script={name}'}}}"
    if letter.isascii() and not letter.isalnum():
        return text
    raise BadPattern(f"unknown escape {text!r}")


def java_pattern(pattern: str) -> str:
    """The Java pattern that matches the same keys; raises :class:`BadPattern`."""
    out, in_class, multiline = [], False, bool(re.match(r"\(\?[is]*m", pattern))
    if _REFUSED.search(_BARE.sub("", pattern)):
        raise BadPattern(f"unsupported construct in pattern {pattern!r}")
    for piece in _PIECES.finditer(pattern):
        kind, text = piece.lastgroup, piece.group()
        if piece["posix"] and in_class:
            if piece["name"] not in POSIX_CLASSES and piece["name"] != "word":
                raise BadPattern(f"unknown class {text} in pattern {pattern!r}")
            letter = "P" if piece["not"] else "p"
            word = r"\W" if piece["not"] else r"\w"
            name = piece["name"]
            out.append(word if name == "word" else f"\\{letter}{{{POSIX_CLASSES[name]}}}")
        elif kind == "escape":
            out.append(_escape(text, in_class))
        elif text == "\\" or (kind == "quoted" and in_class):
            raise BadPattern(f"unsupported escape in pattern {pattern!r}")
        elif in_class and (kind == "open" or piece["posix"]):
            out.append(text.replace("[", r"\["))
            in_class = not text.endswith("]")
        elif in_class and kind == "and":
            out.append(r"&\&")
        elif kind == "open":
            out.append(text.replace("]", r"\]"))
            in_class = True
        elif kind == "close":
            out.append(text if in_class else r"\]")
            in_class = False
        elif kind == "group" and not in_class:
            out.append("(?<")
        elif kind == "end" and not in_class and not multiline:
            out.append(r"\z")
        else:
            out.append(text)
    # Only \n ends a line for ``.``, ``^`` and ``$``.
    return "(?d)" + "".join(out)


def check_pattern(spark: SparkSession, pattern: str) -> str:
    """Return the Java pattern, or raise :class:`BadPattern` without touching any data."""
    java = java_pattern(pattern)
    try:
        spark.range(1).select(F.lit("").rlike(java)).collect()
    except Exception as error:
        if "PATTERN" not in str(error) and "PatternSyntax" not in str(error):
            raise
        raise BadPattern(f"pattern {pattern!r} does not compile") from error
    return java


def key_matches(key: Column, java: str) -> Column:
    return key.rlike(java)
