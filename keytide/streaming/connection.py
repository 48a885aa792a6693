"""State of one live connection: what the stateful streaming operator keeps between batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from keytide.functions.protocols import (
    BINARY_FIRST_BYTE,
    INFER,
    LINE_LIMIT,
    MCTEXT,
    REDIS,
    REDIS_FIRST_BYTE,
    REDIS_GET_VERBS,
    Bad,
    Message,
    Protocol,
    Short,
)
from keytide.operators.events import HIT, MISS

_WRAP = 1 << 32
Event = tuple[str, str, int]


def _ahead(seq: int, expected: int) -> int:
    """How far ``seq`` lies after ``expected``, on a 32-bit circle."""
    return (seq - expected + _WRAP // 2) % _WRAP - _WRAP // 2


@dataclass
class Half:
    """One direction: packets that came early, bytes not read yet, and the value being read."""

    from_server: bool
    expected: int | None = None
    early: dict[int, bytes] = field(default_factory=dict)
    unread: bytes = b""
    skip: int = 0
    open_values: int = 0
    items: list[Message] = field(default_factory=list)

    def restart(self) -> None:
        self.unread, self.skip, self.open_values, self.items = b"", 0, 0, []


@dataclass
class Connection:
    """Both directions, and the requests that wait for their replies.

    ``max_pending`` bounds early packets, unread bytes and waiting requests, in bytes each; passing
    it counts as a loss.
    """

    choice: str = INFER
    max_pending: int = LINE_LIMIT
    protocol: str | None = None
    opened: int | None = None
    ignored: bool = False
    synced: bool = False
    last_us: int = 0
    lost: int = 0
    client: Half = field(default_factory=lambda: Half(False))
    server: Half = field(default_factory=lambda: Half(True))
    waiting: deque = field(default_factory=deque)
    waiting_bytes: int = 0
    ended: int = 0

    def add(
        self, steps: dict[str, Protocol], from_server: bool, seq: int, syn: bool, payload: bytes
    ) -> Iterator[Event]:
        """Take one packet; yields events ``(type, key, size)``."""
        if syn:
            seq = (seq + 1) % _WRAP
            if not from_server and seq != self.opened:
                self.__init__(self.choice, self.max_pending, last_us=self.last_us, lost=self.lost)
                self.opened = seq
        half = self.server if from_server else self.client
        if half.expected is None and (syn or payload):
            half.expected = seq
        if not payload or self.ignored:
            return
        ahead = _ahead(seq, half.expected)
        if ahead > 0:
            if len(half.early.get(seq, b"")) < len(payload):
                half.early[seq] = payload
            too_much = sum(map(len, half.early.values())) > self.max_pending
            yield from self._take_early(steps, half, give_up=too_much)
        elif len(payload) + ahead > 0:
            yield from self._deliver(steps, half, payload[-ahead:])
            yield from self._take_early(steps, half)

    def closes(self, from_server: bool, fin: bool, rst: bool) -> bool:
        """Whether this packet ends the connection: a reset, or the second direction's end."""
        if fin:
            self.ended |= 2 if from_server else 1
        return rst or self.ended == 3

    def finish(self, steps: dict[str, Protocol]) -> Iterator[Event]:
        """Read what is left behind gaps: the connection is over or idle."""
        for half in (self.client, self.server):
            while half.early and not self.ignored:
                yield from self._take_early(steps, half, give_up=True)

    def _take_early(self, steps, half: Half, give_up: bool = False) -> Iterator[Event]:
        """Deliver early packets that are due; with ``give_up``, skip one gap first."""
        while half.early:
            seq = min(half.early, key=lambda s: _ahead(s, half.expected))
            gap = _ahead(seq, half.expected)
            if gap > 0 and not give_up:
                return
            payload = half.early.pop(seq)
            if gap > 0:
                give_up = False
                self.lost += gap
                half.expected = seq
                if half.skip >= gap:
                    half.skip -= gap
                else:
                    self._mark()
                yield from self._deliver(steps, half, payload)
            elif len(payload) + gap > 0:
                yield from self._deliver(steps, half, payload[-gap:])

    def _mark(self) -> None:
        """Lost or unreadable bytes: forget both directions and wait for the next request."""
        self.client.restart()
        self.server.restart()
        self.waiting.clear()
        self.waiting_bytes, self.synced = 0, False

    def _deliver(self, steps, half: Half, data: bytes) -> Iterator[Event]:
        half.expected = (half.expected + len(data)) % _WRAP
        if self.protocol is None and not half.from_server:
            self.protocol = self.choice
            if self.choice == INFER:
                self.protocol = REDIS if data[0] == REDIS_FIRST_BYTE else MCTEXT
            self.ignored = self.protocol == MCTEXT and data[0] == BINARY_FIRST_BYTE
        dropped = min(half.skip, len(data))
        half.skip -= dropped
        if self.ignored or (half.from_server and not self.synced):
            return
        half.unread += data[dropped:]
        yield from self._read(steps, half)
        if not half.from_server:
            yield from self._read(steps, self.server)

    def _read(self, steps, half: Half) -> Iterator[Event]:
        protocol = steps[self.protocol]
        step = protocol.reply if half.from_server else protocol.request
        take = self._framed if protocol.framed else self._plain
        data, at = half.unread, 0
        while half.skip == 0 and at < len(data) and not (half.from_server and not self.waiting):
            try:
                message = step(data, at)
            except Short:
                break
            except Bad:
                self._mark()
                return
            half.skip = max(message.next - len(data), 0)
            at = min(message.next, len(data))
            yield from take(half, message)
            if self.ignored:
                return
        half.unread = data[at:]
        if len(half.unread) > self.max_pending or self.waiting_bytes > self.max_pending:
            self._mark()

    def _request(self, verb: str, keys: list[bytes]) -> None:
        self.waiting.append((verb, keys))
        self.waiting_bytes += 1 + sum(map(len, keys))
        self.synced = True

    def _reply(self) -> tuple[str, list[bytes]]:
        verb, keys = self.waiting.popleft()
        self.waiting_bytes -= 1 + sum(map(len, keys))
        return verb, keys

    def _plain(self, half: Half, message: Message) -> Iterator[Event]:
        if not half.from_server:
            self.synced = True
            if message.kind == "quit":
                self.ignored = True
            elif message.unit:
                self._request(message.kind, [])
        elif message.kind == "value" and self.waiting[0][0] == "get":
            yield HIT, message.key.decode("utf-8", "replace"), message.size
        elif message.unit:
            self._reply()

    def _framed(self, half: Half, message: Message) -> Iterator[Event]:
        first = half.open_values == 0
        if first:
            half.open_values, half.items = 1, []
        half.open_values += message.delta
        # Only gets need their parts; of other values just the count is kept.
        if half.from_server:
            needed = self.waiting[0][0] in REDIS_GET_VERBS
        else:
            needed = first or half.items[0].key in (b"get", b"mget")
        if needed:
            half.items.append(message)
        if half.open_values:
            return
        items, half.items = half.items, []
        if not half.from_server:
            verb = (items[0].key or b"").decode("latin-1")
            self._request(verb, [m.key or b"" for m in items[2:]])
            return
        verb, keys = self._reply()
        if verb not in REDIS_GET_VERBS:
            return
        one = verb == REDIS_GET_VERBS[0]
        answers = items if one else items[1:]
        if len(answers) != len(keys) or (items[0].kind == "array") == one:
            return
        for key, answer in zip(keys, answers):
            if answer.kind in ("bulk", "nil"):
                kind = HIT if answer.kind == "bulk" else MISS
                yield kind, key.decode("utf-8", "replace"), answer.size or 0


@dataclass
class Follower:
    """A connection through all its incarnations: what is idle, ended or reset begins anew."""

    steps: dict[str, Protocol]
    idle_us: int
    connection: Connection

    def take(self, us: int, from_server: bool, seq: int, syn: bool, fin: bool, rst: bool, payload: bytes):
        """Take one packet in arrival order; yields ``(us, protocol, *event)``."""
        old = self.connection
        if old.last_us and us - old.last_us > self.idle_us:
            yield from self.finish(old.last_us)
            self.connection = Connection(old.choice, old.max_pending, lost=old.lost)
        connection = self.connection
        connection.last_us = max(us, connection.last_us)
        for event in connection.add(self.steps, from_server, seq, syn, payload):
            yield us, connection.protocol, *event
        if connection.closes(from_server, fin, rst):
            yield from self.finish(us)
            self.connection = Connection(connection.choice, connection.max_pending, last_us=us, lost=connection.lost)

    def finish(self, us: int):
        connection = self.connection
        for event in connection.finish(self.steps):
            yield us, connection.protocol, *event
