"""Ends of connections: batch and stream give the same events over random ends, resets, reuse, pauses and losses."""

import random

from pyspark.sql import functions as F

from keytide.functions.protocols import MCTEXT, protocols
from keytide.operators import segments as S
from keytide.operators.conversations import extract_events
from keytide.streaming.connection import Connection, Follower
from tests.traffic import Wire


def random_wire(seed, connections=40, losses=0.0):
    """Exchanges with pieces lost, repeated and swapped, and ends, resets, new starts and pauses between them."""
    rng, wire = random.Random(seed), Wire()
    for c in range(connections):
        port, at = 20_000 + c, rng.randrange(10**6)
        seqs, number = [rng.randrange(2**32) for _ in "cs"], 0

        def send(side, payload=b"", syn=False, fin=False, rst=False, late=0):
            wire.packet(at + late, side, seqs[side], payload, syn=syn, client_port=port)
            wire.rows[-1] = (*wire.rows[-1][:10], fin, rst, wire.rows[-1][12])

        for _ in range(rng.randrange(3, 25)):
            what = rng.choice(["talk"] * 6 + ["syn", "fin", "fin", "fin both", "rst", "pause", "data and fin", "ack"])
            at += 200
            if what == "talk":
                number += 1
                key, size = b"k%d-%d" % (c, number), rng.randrange(40)
                texts = [b"get %s\r\n" % key, b"VALUE %s 0 %d\r\n%s\r\nEND\r\n" % (key, size, b"v" * size)]
                lose = rng.random() < losses
                for side, text in enumerate(texts):
                    step = rng.choice([7, 20, 1000])
                    pieces = [text[i : i + step] for i in range(0, len(text), step)]
                    for i, piece in enumerate(pieces):
                        at += 10
                        if not (lose and i == len(pieces) - 1 and side):
                            # A stream that begins without SYN begins, live, with the packet that comes first.
                            send(side, piece, late=rng.choice([0, 0, 0, 15]) if i else 0)
                            if rng.random() < 0.1:
                                send(side, piece, late=30)
                        seqs[side] = (seqs[side] + len(piece)) % 2**32
                    at += 60
            elif what == "syn":
                seqs = [rng.randrange(2**32) for _ in "cs"]
                for side in (0, 1):
                    send(side, syn=True)
                    seqs[side] = (seqs[side] + 1) % 2**32
                    at += 5
            elif what == "pause":
                at += rng.choice([30, 61, 200]) * 10**6
            elif what == "ack":
                send(rng.randrange(2))
            elif what == "data and fin":
                key = b"last%d" % c
                send(0, b"get %s\r\n" % key, fin=rng.random() < 0.5)
                seqs[0] = (seqs[0] + len(key) + 6) % 2**32
                at += 50
                text = b"VALUE %s 0 1\r\nx\r\nEND\r\n" % key
                send(1, text, fin=rng.random() < 0.5)
                seqs[1] = (seqs[1] + len(text)) % 2**32
                at += 50
            else:
                for side in (0, 1) if what == "fin both" else (rng.randrange(2),):
                    for _ in range(rng.choice([1, 1, 2])):
                        send(side, fin=what != "rst", rst=what == "rst")
                        at += 7
    return wire


def streamed(rows):
    """Events and closing packets of the stream's state, one connection after the other."""
    steps, events, closing = protocols(), [], []
    by_port = {}
    for r in rows:
        from_server = r[5] == 11211
        by_port.setdefault(r[6] if from_server else r[5], []).append((r[2], r[1], from_server, r[7], *r[9:]))
    for port, packets in by_port.items():
        follower = Follower(steps, 60 * 10**6, Connection(MCTEXT))
        for ts, ord_, from_server, seq, syn, fin, rst, payload in sorted(packets, key=lambda p: p[:2]):
            if payload or syn or fin or rst:
                us = int(ts.timestamp() * 10**6 + 0.5)
                idle = bool(follower.connection.last_us) and us - follower.connection.last_us > follower.idle_us
                ended = 0 if idle or syn and not from_server and (seq + 1) % 2**32 != follower.connection.opened else follower.connection.ended
                ended |= (2 if from_server else 1) if fin else 0
                events += [e[2:] for e in follower.take(us, from_server, seq, syn, fin, rst, payload)]
                if rst or ended == 3:
                    closing.append(ord_)
        events += [e[2:] for e in follower.finish(0)]
    return sorted(events), sorted(closing)


def test_batch_closes_where_the_stream_does(spark):
    wire = random_wire(5, 60, losses=0.2)
    index = S.with_flows(S.packet_index(wire.table(spark)))
    closing = streamed(wire.rows)[1]
    assert sorted(r["ord"] for r in S.closing_packets(index).collect()) == closing and len(closing) > 40


def test_batch_equals_stream(spark):
    """Without losses: a live reader waits for lost bytes and then forgets what it read meanwhile, batch does not."""
    for seed in (1, 2):
        wire = random_wire(seed)
        found = extract_events(wire.table(spark), MCTEXT)
        expected, _ = streamed(wire.rows)
        assert sorted((r["type"], r["key"], r["size"]) for r in found.collect()) == expected and len(expected) > 100


def test_ends_of_a_hot_connection_span_slices(spark):
    """Runs of ends of one direction over many slices: the known answer is carried over all of them."""
    rng, wire = random.Random(3), Wire()
    for i in range(600):
        wire.packet(i * 7_000_000, rng.random() < 0.5, 100 + i)
        wire.rows[-1] = (*wire.rows[-1][:10], rng.random() < 0.95, rng.random() < 0.02, b"")
    index = S.packet_index(wire.table(spark))
    found = S.closing_packets(S.with_flows(index))
    assert sorted(r["ord"] for r in found.collect()) == streamed(wire.rows)[1]
    empty = index.filter(F.lit(False))
    assert S.split_at_closes(S.with_flows(empty), empty).count() == 0
