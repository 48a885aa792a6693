"""Message boundaries of the cache protocols: one step reads one message header from bytes.

A step gets a run of bytes and an offset and returns a :class:`Message`.  Both directions of both
protocols delimit themselves (lines, and bodies announced by their length), so each direction can
be read without the other; requests and replies are matched afterwards, on tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

# Protocol names, verbs, reply words, RESP tags and limits.
MCTEXT, REDIS, INFER, MCBINARY = "mctext", "redis", "infer", "mcbinary"
GET_VERBS = ("get", "gets")
STORE_VERBS = ("set", "add", "replace", "append", "prepend", "cas")
QUIT_VERB = "quit"
REDIS_GET_VERBS = ("get", "mget")
REDIS_FIRST_BYTE = 0x2A
BINARY_FIRST_BYTE = 0x80
LINE_LIMIT = 32 * 1024
CAPTURE_LIMIT = 1024

_WORD = re.compile(rb"[a-zA-Z]+")
_INT = re.compile(rb"[+-]?[0-9]{1,19}")


class Short(Exception):
    """The bytes end before the message header does."""


class Bad(Exception):
    """The bytes are not a message of the protocol."""


class Message(NamedTuple):
    """One message header.

    ``end`` is the offset after the header, ``next`` the offset after its body.  ``unit`` marks a
    request that gets a reply, or the end of a reply.  ``delta`` is set for framed protocols: how
    many more values must follow before a top-level value is complete, relative to before.
    """

    kind: str
    end: int
    next: int
    key: bytes | None = None
    size: int | None = None
    unit: bool = False
    delta: int | None = None


Step = Callable[[bytes, int], Message]


def line(data: bytes, at: int) -> tuple[bytes, int]:
    """Line without its ending, and the offset after it."""
    end = data.find(b"\n", at)
    if end < 0:
        raise Short
    return data[at : end - 1 if end > at and data[end - 1] == 13 else end], end + 1


def whole(text: bytes) -> int:
    if not _INT.fullmatch(text):
        raise Bad
    value = int(text)
    if not -(1 << 63) <= value < 1 << 63:
        raise Bad
    return value


def mctext_request(data: bytes, at: int) -> Message:
    text, end = line(data, at)
    verb, *args = text.rstrip(b" ").split(b" ")
    if not _WORD.fullmatch(verb):
        raise Bad
    verb = verb.decode()
    quiet = bool(args) and args[-1] == b"noreply"
    if verb == QUIT_VERB:
        return Message("quit", end, end)
    if verb in GET_VERBS and args:
        return Message("get", end, end, unit=True)
    if verb in STORE_VERBS and len(args) >= 4 and _INT.fullmatch(args[3]) and int(args[3]) >= 0:
        return Message("store", end, end + int(args[3]) + 2, unit=not quiet)
    return Message("other", end, end, unit=not quiet)


def mctext_reply(data: bytes, at: int) -> Message:
    text, end = line(data, at)
    words = text.split(b" ")
    if words[0] == b"VALUE" and len(words) >= 4:
        size = whole(words[3])
        if size < 0:
            raise Bad
        return Message("value", end, end + size + 2, words[1], size)
    # A statistics listing is one reply, closed by its last line.
    return Message("line", end, end, unit=words[0] != b"STAT")


def resp_value(data: bytes, at: int, capture: int = 0) -> Message:
    """One RESP value header; bulk bodies up to ``capture`` bytes are kept, others only measured."""
    text, end = line(data, at)
    tag, rest = text[:1], text[1:]
    if tag == b"+":
        return Message("status", end, end, rest, delta=-1)
    if tag == b"-":
        return Message("error", end, end, rest, delta=-1)
    if tag == b":":
        return Message("int", end, end, size=whole(rest), delta=-1)
    if tag not in (b"$", b"*"):
        raise Bad
    size = whole(rest)
    if size < 0:
        return Message("nil", end, end, delta=-1)
    if tag == b"*":
        return Message("array", end, end, size=size, delta=size - 1)
    if size > capture:
        return Message("bulk", end, end + size + 2, size=size, delta=-1)
    if len(data) < end + size:
        raise Short
    return Message("bulk", end + size, end + size + 2, data[end : end + size], size, delta=-1)


def redis_request(data: bytes, at: int) -> Message:
    """A command's array header carries the verb, lower-cased, if it can be seen."""
    head = resp_value(data, at, CAPTURE_LIMIT)
    if head.kind != "array":
        return head
    try:
        verb = resp_value(data, head.next, CAPTURE_LIMIT)
    except (Short, Bad):
        return head
    return head._replace(key=verb.key.lower() if verb.kind == "bulk" and verb.key else None)


@dataclass(frozen=True)
class Protocol:
    """How to read both directions of a connection; ``framed`` if values nest."""

    request: Step
    reply: Step
    framed: bool = False


_PROTOCOLS: dict[str, Protocol] = {
    MCTEXT: Protocol(mctext_request, mctext_reply),
    REDIS: Protocol(redis_request, resp_value, framed=True),
}


def register_protocol(name: str, protocol: Protocol) -> None:
    """Make a protocol selectable by name.

    A reply step that yields ``value`` messages with key and size, and a request step that yields
    ``get`` units, is all an unframed protocol needs.
    """
    if name in (INFER, MCBINARY):
        raise ValueError(f"reserved protocol name: {name!r}")
    _PROTOCOLS[name] = protocol


def check_protocol(name: str) -> str:
    if name != INFER and name not in _PROTOCOLS:
        raise ValueError(f"unknown protocol: {name!r}")
    return name


def protocols() -> dict[str, Protocol]:
    return dict(_PROTOCOLS)
