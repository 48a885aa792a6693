"""Templates of license texts as token automata.

A template is text with two kinds of regions: ``{{...}}`` may be left out, and may hold other regions;
``<<name:n>>`` stands for any words, at most ``n``. All other words are mandatory. Templates are
compiled into one automaton over words whose states are the places between the elements of all templates;
a set of states is one integer with a bit for each. A word moves every state whose element takes it one
place on, an edge goes from the start of a region that may be left out to its end. A text is accepted
if a state behind the last element of a template is reached, wherever its first word stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What separates words: all ASCII but digits and letters; capital letters become small ones.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MARKUP = re.compile(r"\{\{|\}\}|<<[^:>]*:\d+>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


@dataclass(frozen=True)
class Element:
    """One word that must be there, or any word (``None``)."""

    word: bytes | None


@dataclass(frozen=True)
class Template:
    """Elements, and the ranges of them that may be left out."""

    label: str
    elements: tuple[Element, ...]
    skips: tuple[tuple[int, int], ...]

    @property
    def mandatory(self) -> list[bool]:
        out = [e.word is not None for e in self.elements]
        for low, high in self.skips:
            out[low:high] = [False] * (high - low)
        return out

    def reversed(self) -> Template:
        n = len(self.elements)
        return Template(self.label, self.elements[::-1], tuple((n - b, n - a) for a, b in reversed(self.skips)))


def parse(label: str, text: str) -> Template:
    """A template from its markup; regions must be closed, and some word must be mandatory."""
    elements: list[Element] = []
    skips: list[tuple[int, int]] = []
    opened: list[int] = []
    at = 0
    for mark in [*_MARKUP.finditer(text), None]:
        plain = text[at : mark.start() if mark else len(text)]
        elements += [Element(w) for w in words_of(plain.encode())]
        if mark is None:
            break
        at = mark.end()
        if mark[0] == "{{":
            opened.append(len(elements))
        elif mark[0] == "}}":
            if not opened:
                raise ValueError(f"{label}: a region is closed that is not open")
            skips.append((opened.pop(), len(elements)))
        else:
            # n places for any word, from each of which the rest may be left out
            most = int(mark[0].rpartition(":")[2][:-2])
            low = len(elements)
            elements += [Element(None)] * most
            skips += [(low + i, low + most) for i in range(most)]
    made = Template(label, tuple(elements), tuple(sorted(skips)))
    if opened or not any(made.mandatory):
        raise ValueError(f"{label}: an open region, or no mandatory word")
    return made


class Automaton:
    """Several templates in one set of states."""

    def __init__(self, templates: list[Template]):
        self.labels = [t.label for t in templates]
        self.takes: dict[bytes, int] = {}
        self.any = self.start = self.final = 0
        edges: dict[int, int] = {}  # end of a region: states from which it is reached
        self.progress: list[tuple[int, list[float]]] = []
        self.ends: list[tuple[int, int]] = []  # bit behind the last element, number of the template
        offset = 0
        for number, template in enumerate(templates):
            for i, element in enumerate(template.elements):
                bit = 1 << (offset + i)
                if element.word is None:
                    self.any |= bit
                else:
                    self.takes[element.word] = self.takes.get(element.word, 0) | bit
            for low, high in template.skips:
                edges[offset + high] = edges.get(offset + high, 0) | 1 << (offset + low)
            need = template.mandatory
            done = [sum(need[:i]) / sum(need) for i in range(len(need) + 1)]
            self.progress.append((offset, done))
            self.start |= 1 << offset
            last = 1 << (offset + len(need))
            self.final |= last
            self.ends.append((last, number))
            offset += len(need) + 1
        # Ends in ascending order, so that regions that follow each other are passed in one walk; a region
        # inside another has its end before or at the end of that one.
        self.edges = [(sources, 1 << end) for end, sources in sorted(edges.items())]
        self.from_any = 0
        for sources, _ in self.edges:
            self.from_any |= sources
        self.start = self._closed(self.start)
        self.firsts = frozenset(w for w, bits in self.takes.items() if bits & self.start)
        if self.start & self.any:
            raise ValueError("a template begins or ends with a replaceable region")

    def _closed(self, states: int) -> int:
        if states & self.from_any:
            for sources, end in self.edges:
                if states & sources:
                    states |= end
        return states

    def step(self, states: int, word: bytes) -> int:
        return self._closed((states & (self.takes.get(word, 0) | self.any)) << 1)

    def run(self, words: list[bytes], anchored: bool = False) -> tuple[list[tuple[int, int]], float]:
        """``(template, words up to its end)`` of all matches, and the largest share of mandatory words reached.

        Anchored runs begin at the first word only.
        """
        states, reached, found = self.start if anchored else 0, 0, []
        starts = [] if anchored else [i for i, w in enumerate(words) if w in self.firsts]
        at, nth = 0, 0
        while at < len(words):
            if not states:  # on to the next word that can begin a template
                while nth < len(starts) and starts[nth] < at:
                    nth += 1
                if nth == len(starts):
                    break
                at = starts[nth]
            if not anchored:
                states |= self.start
            states = self.step(states, words[at])
            at += 1
            reached |= states
            if states & self.final:
                found += [(number, at) for last, number in self.ends if states & last]
        share = 0.0
        for offset, done in self.progress:
            own = (reached >> offset) & ((1 << len(done)) - 1)
            if own:
                share = max(share, done[own.bit_length() - 1])
        return found, share


class Library:
    """Compiled templates, forward for ends and backward for starts."""

    def __init__(self, templates: dict[str, str]):
        parsed = [parse(label, text) for name, text in templates.items() for label in [name.split("#")[0]]]
        self.labels = [t.label for t in parsed]
        self.forward = Automaton(parsed)
        self.backward = [Automaton([t.reversed()]) for t in parsed]
        self.longest = [len(t.elements) for t in parsed]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], float]:
        """``(label, first word, end)`` of the places where a template is accepted, and the share of mandatory words reached.

        Of the places with the same end the longest counts, then of those with the same first word the longest.
        """
        ends, share = self.forward.run(words)
        spans: dict[tuple[str, int], int] = {}
        for number, end in ends:
            behind = words[max(0, end - self.longest[number]) : end][::-1]
            back, _ = self.backward[number].run(behind, anchored=True)
            start = end - max(length for _, length in back)
            key = (self.labels[number], start)
            spans[key] = max(spans.get(key, 0), end)
        return sorted((label, start, end) for (label, start), end in spans.items()), share
