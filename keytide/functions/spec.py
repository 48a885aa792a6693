"""Report specs: a comma list of fields and ``agg(field)`` terms compiled to Columns.

``report_spec("key,max(size),sum(size)")`` is the whole query language of a report.  Every
aggregate is three Column functions (partial, merge, finish), so that a report can be
pre-aggregated before a shuffle, merged across inputs, accumulated over intervals and streamed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SPEC = "key,max(size),sum(size)"


class BadDescriptor(ValueError):
    """A field or aggregate descriptor that cannot be compiled."""

    def __init__(self, descriptor: str, why: str = "bad aggregate type"):
        super().__init__(f"{why}: {descriptor!r}")
        self.descriptor = descriptor


@dataclass(frozen=True)
class State:
    """One column of aggregate state: ``partial`` over input rows, ``merge`` over states."""

    partial: Callable[[Column], Column]
    merge: Callable[[Column], Column]


@dataclass(frozen=True)
class Aggregate:
    """A mergeable aggregate over one integer column.

    ``states`` are plain aggregate functions (usable in ``agg`` and ``over``); ``finish`` maps the
    merged state columns to the reported value.
    """

    states: tuple[State, ...]
    finish: Callable[..., Column] = lambda state: state


_AGGREGATES: dict[str, Aggregate] = {
    "max": Aggregate((State(F.max, F.max),)),
    "min": Aggregate((State(F.min, F.min),)),
    "sum": Aggregate((State(F.sum, F.sum),)),
    # Whole-number mean, truncated toward zero.
    "avg": Aggregate(
        (State(F.sum, F.sum), State(F.count, F.sum)),
        lambda total, rows: F.call_function("div", total, rows),
    ),
}

# Field name -> whether it holds integers (only those can be aggregated).
_FIELDS: dict[str, bool] = {"key": False, "size": True}

_TERM = re.compile(r"([a-z0-9]+)\(([a-z]+)\)")
_PERCENTILE = re.compile(r"p([0-9]{2,})")


def register_aggregate(name: str, aggregate: Aggregate) -> None:
    """Make ``name(field)`` usable in specs."""
    if not re.fullmatch(r"[a-z][a-z0-9]*", name) or _PERCENTILE.fullmatch(name):
        raise BadDescriptor(name, "not usable as an aggregate name")
    _AGGREGATES[name] = aggregate


def register_field(name: str, is_int: bool) -> None:
    """Make an additional event column usable in specs."""
    if not re.fullmatch(r"[a-z]+", name):
        raise BadDescriptor(name, "not usable as a field name")
    _FIELDS[name] = is_int


@dataclass(frozen=True)
class Term:
    """One output column of a report: a key field, or an aggregate or percentile of a field."""

    name: str
    field: str
    aggregate: str | None = None
    quantile: float | None = None

    @property
    def is_key(self) -> bool:
        return self.aggregate is None


@dataclass(frozen=True)
class ReportSpec:
    """Parsed spec: output columns in the order they were written."""

    terms: tuple[Term, ...]

    @property
    def keys(self) -> list[Term]:
        return [t for t in self.terms if t.is_key]

    @property
    def aggs(self) -> list[Term]:
        """Aggregates that have a single-column state."""
        return [t for t in self.terms if not t.is_key and t.quantile is None]

    @property
    def percentiles(self) -> list[Term]:
        return [t for t in self.terms if t.quantile is not None]

    @property
    def key_names(self) -> list[str]:
        return [t.name for t in self.terms if t.is_key]

    @property
    def value_names(self) -> list[str]:
        return [t.name for t in self.terms if not t.is_key]

    @property
    def columns(self) -> list[str]:
        """Report columns: key fields first, then values, each in spec order."""
        return self.key_names + self.value_names

    @property
    def rank_by(self) -> str | None:
        """Column a report is ranked by: ``sum(size)`` if there, else the last aggregate."""
        values = self.value_names
        return "sum(size)" if "sum(size)" in values else (values[-1] if values else None)

    def with_sum(self) -> ReportSpec:
        """The same spec, with ``sum(size)`` appended if it is missing."""
        if "sum(size)" in self.value_names:
            return self
        return replace(self, terms=(*self.terms, _parse_term("sum(size)")))


def quantile_of(descriptor: str) -> float:
    """Percentile meant by ``pNN...``: two digits, further digits are decimals (p995 = 99.5)."""
    digits = _PERCENTILE.fullmatch(descriptor)
    if not digits:
        raise BadDescriptor(descriptor)
    q = float(int(digits[1]))
    for _ in range(len(digits[1]) - 2):
        q /= 10
    return q


def _parse_term(text: str) -> Term:
    if text in _FIELDS:
        return Term(text, text)
    call = _TERM.fullmatch(text)
    if not call:
        raise BadDescriptor(text)
    name, field = call.groups()
    if name not in _AGGREGATES and not _PERCENTILE.fullmatch(name):
        raise BadDescriptor(text)
    if field not in _FIELDS:
        raise BadDescriptor(field, "unknown field")
    if not _FIELDS[field]:
        raise BadDescriptor(text, "aggregate over a field that is not an integer")
    if name in _AGGREGATES:
        return Term(text, field, aggregate=name)
    return Term(text, field, aggregate=name, quantile=quantile_of(name))


def report_spec(spec: str | ReportSpec = DEFAULT_SPEC) -> ReportSpec:
    """Compile a spec such as ``"key, max(size), p95(size)"``; raises :class:`BadDescriptor`."""
    if isinstance(spec, ReportSpec):
        return spec
    terms = tuple(_parse_term(part.strip()) for part in spec.split(","))
    names = [t.name for t in terms]
    for name in names:
        if names.count(name) > 1:
            raise BadDescriptor(name, "listed twice")
    return ReportSpec(terms)


def aggregate_of(term: Term) -> Aggregate:
    return _AGGREGATES[term.aggregate]
