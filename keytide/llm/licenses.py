"""License scan: phrases that name a license, and templates of license texts and notices.

Phrases are counted wherever their words stand side by side. Templates are compiled into one token
automaton (:mod:`keytide.llm.templates`); a text is accepted by a template if its mandatory words are there
exactly, in order, with nothing between but what the template's optional and replaceable regions allow.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, raw, slices
from keytide.llm.license_texts import TEMPLATES
from keytide.llm.templates import LOWER, Library

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_SOUGHT = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
#: Score of a text that names a license but is accepted by no template, and weight of a template's share.
NAMED, PARTIAL = 0.75, 0.5

_MATCH = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,first_word:long,end_word:long>>"
)


@cache
def default_library() -> Library:
    return Library(TEMPLATES)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place of a phrase, in order."""
    firsts = {phrase[0] for phrase, _ in _SOUGHT}
    found = []
    for i in [i for i, w in enumerate(words) if w in firsts]:
        found += [(i, label) for phrase, label in _SOUGHT if tuple(words[i : i + len(phrase)]) == phrase]
    return found


def scan(text: bytes, library: Library) -> tuple:
    """One text's row of :func:`find_licenses`, without its id."""
    lowered = text.translate(LOWER)
    words = lowered.split()
    named = phrase_places(words) if b"license" in lowered or b"cc" in lowered else []
    matches, share = library.matches(words)
    base = {label for _, label in named}
    score = 1.0 if matches else max(NAMED if named else 0.0, PARTIAL * share)
    return (
        len(words),
        len(named),
        named[0][0] if named else None,
        named[-1][0] if named else None,
        ",".join(sorted(base)),
        ",".join(sorted(base | {m[0] for m in matches})),
        score,
        [dict(zip(("label", "first_word", "end_word"), m)) for m in matches],
    )


def find_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] | None = None
) -> DataFrame:
    """Licenses that every whole text names or holds, one row per input row.

    Columns: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (of these
    places, null if there are none), ``base_labels`` and ``labels`` (with those of the templates; distinct,
    sorted, comma-joined), ``score`` (1 if a template accepts the text, at least 0.75 if a phrase is there, else
    half the largest share of a template's mandatory words that was reached), ``matches`` (label, first word
    and end of every place that a template accepts). ``templates`` replaces the library; what follows a ``#`` in a
    name is not part of the label.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z in lower case. Null,
    empty and wordless texts have no words and no labels. Repeated rows come back as they go in; an empty
    table gives an empty result; other columns are not looked at. Tasks hold some MB of texts, or one text,
    at a time; time is in step with the words of a text, whatever it repeats.
    """
    own = dict(templates) if templates is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = default_library() if own is None else Library(own)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_MATCH)]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan(t, library) for t in byte_texts(part, "text")]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], _names())

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def _names() -> list[str]:
    return ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
