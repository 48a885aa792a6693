"""Event extraction from packets, in batch."""

import random

import pytest
from pyspark.sql import functions as F

from keytide.functions.protocols import check_protocol
from keytide.operators import messages
from keytide.operators.conversations import extract_events
from keytide.operators.segments import placed_segments, lost_bytes, segments, with_bytes
from tests.traffic import Wire, bulk, events, random_exchanges, resp, value


def extracted(spark, wire, **options):
    return events(extract_events(wire.table(spark), **options))


def test_memcached_multi_get(spark):
    wire = Wire()
    wire.talk([(b"get key1 key2 key3\r\n", value(b"key1", b"hello") + value(b"key2", b"world") + b"END\r\n")])
    assert extracted(spark, wire) == [("hit", "key1", 5), ("hit", "key2", 5)]


def test_memcached_empty_value(spark):
    wire = Wire()
    wire.talk([(b"get key3|foo\r\n", b"VALUE key3|foo 32 0\r\n\r\nEND\r\n")])
    assert extracted(spark, wire) == [("hit", "key3|foo", 0)]


@pytest.mark.parametrize(
    "reply", [b"VALUE key1 42 5\r\nworld\r\nVALUE ", b"VALUE key1 42 5\r\nwor"], ids=["header", "body"]
)
def test_memcached_cut_reply(spark, reply):
    wire = Wire()
    wire.talk([(b"get key1 key2\r\n", reply)])
    assert extracted(spark, wire) == [("hit", "key1", 5)]


def test_memcached_overrun(spark):
    wire = Wire()
    wire.talk([(b"\0" * (1 << 18), b""), (b"get a\r\n", b"\0" * (1 << 18))])
    assert extracted(spark, wire, protocol="mctext") == []


def test_quit_binary_and_unknown_commands(spark):
    wire = Wire()
    wire.talk([(b"get a\r\n", value(b"a", b"1") + b"END\r\n"), (b"quit\r\n", b""),
               (b"get b\r\n", value(b"b", b"1") + b"END\r\n")])
    wire.talk([(b"\x80get b\r\n", value(b"b", b"1") + b"END\r\n")], client_port=40001)
    wire.talk([(b"gat 0 c\r\n", value(b"c", b"1") + b"END\r\n"),
               (b"get d\r\n", value(b"d", b"22") + b"END\r\n")], client_port=40002)
    assert extracted(spark, wire) == [("hit", "a", 1), ("hit", "d", 2)]


def test_noreply_and_pipelining(spark):
    wire = Wire()
    wire.talk([(b"set a 0 0 3 noreply\r\nget\r\nget b\r\nget c\r\ndelete d noreply\r\nget e\r\n",
                value(b"b", b"xx") + b"END\r\nEND\r\n" + value(b"e", b"yyy") + b"END\r\n")])
    assert extracted(spark, wire) == [("hit", "b", 2), ("hit", "e", 3)]


def test_redis_get_and_unknown(spark):
    wire = Wire()
    wire.talk([(resp(b"PING", b"123"), bulk(b"123")), (resp(b"GET", b"hello"), bulk(b"world"))], port=6379)
    assert extracted(spark, wire) == [("hit", "hello", 5)]


def test_redis_misses_errors_mget(spark):
    wire = Wire()
    wire.talk(
        [
            (resp(b"get", b"none"), b"$-1\r\n"),
            (resp(b"get", b"list"), b"-WRONGTYPE\r\n"),
            (resp(b"mget", b"a", b"b"), b"*2\r\n" + bulk(b"x" * 3000) + b"$-1\r\n"),
            (resp(b"LRANGE", b"l", b"0", b"9"), b"*2\r\n*1\r\n" + bulk(b"a") + b"*0\r\n"),
            (resp(b"get", b"empty"), b"$0\r\n\r\n"),
            (resp(b"SET", b"k", b"v" * 5000), b"+OK\r\n"),
            (resp(b"get", b"z" * 2000), bulk(b"1")),
        ],
        port=6379,
    )
    want = [("hit", "", 1), ("hit", "a", 3000), ("hit", "empty", 0), ("miss", "b", 0), ("miss", "none", 0)]
    assert extracted(spark, wire) == want


def test_inference(spark):
    wire = Wire()
    wire.talk([(resp(b"GET", b"foo"), bulk(b"bar"))], client_port=40001)
    wire.talk([(b"get hello\r\n", value(b"hello", b"world") + b"END\r\n")], port=6379, client_port=40002)
    assert extracted(spark, wire) == [("hit", "foo", 3), ("hit", "hello", 5)]


def test_protocol_names():
    assert check_protocol("redis") == "redis"
    with pytest.raises(ValueError):
        check_protocol("http")


def test_invalid_utf8_key(spark):
    wire = Wire()
    wire.talk([(b"get \xff\r\n", value(b"\xff", b"1") + b"END\r\n")])
    assert extracted(spark, wire) == [("hit", "�", 1)]


def test_loss_then_resync(spark):
    """A lost reply header loses its request; what follows the next request is found again."""
    wire = Wire()
    wire.talk([(b"get a\r\n", value(b"a", b"1") + b"END\r\n"), (b"get b\r\n", value(b"b", b"1") + b"END\r\n"),
               (b"get c\r\n", value(b"c", b"1") + b"END\r\n"), (b"get d\r\n", value(b"d", b"1") + b"END\r\n")])
    lost = [r for r in wire.rows if r[12].startswith(b"VALUE b")]
    wire.rows.remove(lost[0])
    assert extracted(spark, wire) == [("hit", "a", 1), ("hit", "d", 1)]
    total = lost_bytes(placed_segments(wire.table(spark))).agg({"lost": "sum"}).first()[0]
    assert total == len(lost[0][12])


def test_loss_inside_a_body_is_harmless(spark):
    wire = Wire()
    wire.talk([(b"get a\r\n", value(b"a", b"x" * 1000) + b"END\r\n"), (b"get b\r\n", value(b"b", b"1") + b"END\r\n")],
              piece=200)
    server = [r for r in wire.rows if r[5] == 11211 and r[12]]
    wire.rows.remove(server[2])
    assert extracted(spark, wire) == [("hit", "a", 1000), ("hit", "b", 1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk_bytes", [256, 4096, 4 << 20])
def test_random_conversation_any_chunking(spark, seed, chunk_bytes):
    """Bodies that look like headers, pieces swapped and repeated, chunk borders anywhere."""
    exchanges, want = random_exchanges(seed)
    wire = Wire()
    wire.talk(exchanges, piece=97, isn=(2**32 - 500, 2**32 - 3000), rng=random.Random(seed))
    assert extracted(spark, wire, protocol="mctext", chunk_bytes=chunk_bytes, line_limit=2048) == want


def test_losses_do_not_depend_on_chunking(spark):
    exchanges, _ = random_exchanges(5, 60)
    wire = Wire()
    wire.talk(exchanges, piece=61)
    rng = random.Random(3)
    rows = [r for r in wire.rows if r[9] or rng.random() > 0.03]
    found = [
        events(extract_events(wire.table(spark, rows), "mctext", chunk_bytes=c, line_limit=2048))
        for c in (300, 5000, 4 << 20)
    ]
    assert found[0] == found[1] == found[2]
    assert found[0]


@pytest.mark.parametrize("together", [1, 3])
def test_chunks_that_are_moved_together(spark, monkeypatch, together):
    """Groups of small chunks have borders anywhere, too; losses do not change that."""
    monkeypatch.setattr(messages, "CHUNK_BYTES", 300 * together)
    exchanges, want = random_exchanges(3)
    wire = Wire()
    wire.talk(exchanges, piece=97, isn=(2**32 - 500, 2**32 - 3000), rng=random.Random(3))
    assert extracted(spark, wire, protocol="mctext", chunk_bytes=300, line_limit=2048) == want
    rng = random.Random(4)
    table = wire.table(spark, [r for r in wire.rows if r[9] or rng.random() > 0.03])
    found = [events(extract_events(table, "mctext", chunk_bytes=c, line_limit=2048)) for c in (300, 4 << 20)]
    assert found[0] == found[1] and found[0]


def test_payloads_go_to_their_chunks_once(spark):
    wire = Wire()
    wire.talk([(b"get k%d\r\n" % i, value(b"k%d" % i, b"x" * 500) + b"END\r\n") for i in range(40)])
    packets = wire.table(spark)
    placed = placed_segments(packets).withColumn("protocol", F.lit("mctext"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = messages.read_messages(with_bytes(placed, packets), chunk_bytes=1024, line_limit=512)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    moved = [line for line in plan if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    assert len(moved) == 2  # the payloads, and short reports of chunks


def test_a_protocol_for_all_connections_moves_no_payload_again(spark):
    """Payloads that were dealt to their chunks stay there when entries are joined, for a literal protocol too."""
    wire = Wire()
    wire.talk([(b"get k%d\r\n" % i, value(b"k%d" % i, b"x" * 500) + b"END\r\n") for i in range(40)])
    packets = wire.table(spark)
    placed = placed_segments(packets).withColumn("protocol", F.lit("mctext"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = messages.read_messages(with_bytes(placed, packets), chunk_bytes=1024, line_limit=512)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    join = next(i for i, line in enumerate(plan) if "ShuffledHashJoin" in line)
    payloads = next(line for line in plan[join:] if "Exchange" in line)
    assert "group#" in payloads and "REPARTITION_BY_COL" in payloads
    assert found.filter("kind = 'value'").count() == 40


def test_streams_of_one_connection_in_two_protocols(spark):
    """Entries of chunks are told apart by the protocol, too."""
    wire = Wire()
    wire.talk([(b"get k%d\r\n" % i, value(b"k%d" % i, b"x" * 500) + b"END\r\n") for i in range(40)])
    packets = wire.table(spark)
    both = F.explode(F.array(F.lit("mctext"), F.lit("redis")))
    read = with_bytes(placed_segments(packets).withColumn("protocol", both), packets)
    small, whole = (
        sorted(messages.read_messages(read, chunk_bytes=c, line_limit=512).drop("chunk").collect(), key=repr)
        for c in (1024, 4 << 20)
    )
    assert small == whole and {r["protocol"] for r in whole} == {"mctext", "redis"}


def test_one_connection_holds_most_packets(spark):
    """A single connection of many chunks next to short ones."""
    wire, want = Wire(), []
    body = b"VALUE nested 0 1\r\n" * 40
    wire.talk([(b"get k%d\r\n" % i, value(b"k%d" % i, body) + b"END\r\n") for i in range(300)])
    want += [("hit", f"k{i}", len(body)) for i in range(300)]
    for n in range(20):
        wire.talk([(b"get s\r\n", value(b"s", b"1") + b"END\r\n")], client_port=41000 + n)
        want.append(("hit", "s", 1))
    assert extracted(spark, wire, chunk_bytes=2048, line_limit=2048) == sorted(want)


def test_reused_port_and_idle(spark):
    wire = Wire()
    wire.talk([(b"get a\r\n", value(b"a", b"1") + b"END\r\n")], isn=(100, 900))
    wire.talk([(b"get b\r\n", value(b"b", b"1") + b"END\r\n")], isn=(7000, 50), us=10_000_000)
    wire.talk([(b"get c\r\n", value(b"c", b"1") + b"END\r\n")], isn=(3 * 10**9, 2 * 10**9), us=120_000_000, syn=False)
    assert extracted(spark, wire) == [("hit", "a", 1), ("hit", "b", 1), ("hit", "c", 1)]
    flows = segments(wire.table(spark)).select("flow").distinct().count()
    assert flows == 3


def test_overlapping_retransmission(spark):
    wire = Wire()
    text = value(b"a", b"0123456789" * 20) + b"END\r\n"
    wire.packet(0, False, 100, syn=True)
    wire.packet(1, True, 900, syn=True)
    wire.packet(2, False, 101, b"get a\r\n")
    wire.packet(5, True, 901 + 50, text[50:100])
    wire.packet(6, True, 901, text[:60])
    wire.packet(7, True, 901 + 40, text[40:180])
    wire.packet(8, True, 901 + 100, text[100:])
    rows = segments(wire.table(spark)).filter("from_server").orderBy("rel_start").collect()
    assert b"".join(bytes(r["bytes"]) for r in rows) == text
    assert all(r["skip"] == 0 for r in rows)
    assert extracted(spark, wire) == [("hit", "a", 200)]
