"""Closing connections and bounded state, on the connection state itself."""

from keytide.functions.protocols import protocols
from keytide.streaming.connection import Connection
from tests.traffic import bulk, resp, value


def feed(connection, *packets):
    out = []
    for from_server, seq, payload in packets:
        out += connection.add(protocols(), from_server, seq, False, payload)
    return out


def test_close_needs_both_ends_or_a_reset():
    c = Connection()
    assert not c.closes(False, True, False)
    assert not c.closes(False, True, False)
    assert c.closes(True, True, False)
    assert Connection().closes(False, False, True)


def test_requests_without_replies_stay_bounded():
    """Only one direction was captured: waiting requests are dropped, not hoarded."""
    c, seq = Connection(max_pending=500), 1
    for i in range(1000):
        text = resp(b"get", b"key%05d" % i)
        feed(c, (False, seq, text))
        seq += len(text)
    assert c.waiting_bytes <= 500 and len(c.waiting) < 100


def test_unread_and_early_bytes_stay_bounded():
    c = Connection(max_pending=1000)
    feed(c, (False, 1, b"get a\r\n"))
    seq = 1
    for _ in range(100):
        feed(c, (True, seq, b"\0" * 300))
        seq += 300
    assert len(c.server.unread) <= 1000
    late = Connection(max_pending=1000)
    feed(late, (False, 1, b"get a\r\n"), (True, 1, b"VAL"))
    for i in range(100):
        feed(late, (True, 1000 + 300 * i, b"x" * 300))
    assert sum(map(len, late.server.early.values())) <= 1000 + 300


def test_large_values_are_counted_not_kept():
    c = Connection(max_pending=1000)
    found = feed(c, (False, 1, b"get a\r\n"), (True, 1, b"VALUE a 0 100000\r\n"))
    seq = 1 + len(b"VALUE a 0 100000\r\n")
    for _ in range(100):
        found += feed(c, (True, seq, b"x" * 1000))
        seq += 1000
        assert len(c.server.unread) == 0
    found += feed(c, (True, seq, b"\r\n" + value(b"b", b"1") + b"END\r\n"))
    assert found == [("hit", "a", 100000), ("hit", "b", 1)]


def test_reply_split_anywhere():
    text = b"*2\r\n" + bulk(b"hello") + b"$-1\r\n" + bulk(b"x" * 50)
    for cut in range(1, len(text)):
        c = Connection()
        request = resp(b"MGET", b"a", b"b") + resp(b"GET", b"c")
        found = feed(c, (False, 1, request), (True, 1, text[:cut]), (True, 1 + cut, text[cut:]))
        assert found == [("hit", "a", 5), ("miss", "b", 0), ("hit", "c", 50)]
