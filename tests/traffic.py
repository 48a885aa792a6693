"""Hand-made conversations as packets."""

import datetime as dt
import random

SCHEMA = (
    "file string, ord long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "seq long, ack long, syn boolean, fin boolean, rst boolean, payload binary"
)
START = dt.datetime(2024, 1, 1)


class Wire:
    """Collects packets of one or more connections."""

    def __init__(self):
        self.rows = []

    def packet(self, us, from_server, seq, payload=b"", syn=False, port=11211, client_port=40000):
        client, server = ("10.0.0.2", client_port), ("10.0.0.1", port)
        src, dst = (server, client) if from_server else (client, server)
        ts = START + dt.timedelta(microseconds=us)
        self.rows.append(
            ("f", len(self.rows), ts, src[0], dst[0], src[1], dst[1], seq % 2**32, 0, syn, False, False, payload)
        )

    def talk(self, exchanges, port=11211, client_port=40000, isn=(100, 900), piece=1460, syn=True, us=0, rng=None):
        """Requests and replies in turn; with ``rng``, pieces are delayed a little and repeated."""
        at, seqs = us, [isn[0] + 1, isn[1] + 1]
        if syn:
            for side in (False, True):
                self.packet(at, side, isn[side], syn=True, port=port, client_port=client_port)
                at += 100
        for texts in exchanges:
            for side, text in zip((False, True), texts):
                for i in range(0, len(text), piece):
                    part = text[i : i + piece]
                    late = rng.choice([0, 0, 0, 25]) if rng else 0
                    self.packet(at + late, side, seqs[side], part, port=port, client_port=client_port)
                    if rng and rng.random() < 0.2:
                        self.packet(at + 40, side, seqs[side], part, port=port, client_port=client_port)
                    seqs[side] += len(part)
                    at += 10
                at += 1000
        return at

    def table(self, spark, rows=None):
        return spark.createDataFrame(self.rows if rows is None else rows, SCHEMA)


def resp(*items):
    return b"*%d\r\n" % len(items) + b"".join(b"$%d\r\n%s\r\n" % (len(i), i) for i in items)


def bulk(data):
    return b"$%d\r\n%s\r\n" % (len(data), data)


def value(key, data):
    return b"VALUE %s 0 %d\r\n%s\r\n" % (key, len(data), data)


def events(frame):
    return sorted((r["type"], r["key"], r["size"]) for r in frame.select("type", "key", "size").collect())


def random_exchanges(seed, n=40):
    """Memcached exchanges with tricky bodies, and the events they must yield."""
    rng, out, want = random.Random(seed), [], []
    for i in range(n):
        kind = rng.randrange(6)
        body = rng.choice([
            b"", b"x" * rng.randrange(300), b"VALUE fake 0 5\r\nhello\r\nEND\r\n" * rng.randrange(4),
            bytes(rng.randrange(256) for _ in range(rng.randrange(200))), b"\n" * rng.randrange(50),
        ])
        key = b"k%d" % i
        if kind == 0:
            out.append((b"set %s 0 0 %d\r\n%s\r\n" % (key, len(body), body), b"STORED\r\n"))
        elif kind == 1:
            out.append((b"get %s\r\n" % key, b"END\r\n"))
        elif kind == 2:
            out.append((b"delete %s\r\n" % key, b"DELETED\r\n"))
        else:
            two = value(key, body) + value(key + b"b", body[:3])
            out.append((b"get %s %sb\r\n" % (key, key), two + b"END\r\n"))
            want += [("hit", key.decode(), len(body)), ("hit", key.decode() + "b", len(body[:3]))]
    return out, sorted(want)
