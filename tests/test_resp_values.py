"""RESP values of a table are put out in short batches."""

from keytide.operators import resp
from tests.traffic import bulk


def test_leaves_come_in_short_batches(spark, monkeypatch):
    values = [(i, b"*3\r\n" + bulk(b"x" * i) + b":%d\r\n*0\r\n" % i) for i in range(25)] + [(25, b"$9\r\nabc"), (26, b"?")]
    expected = [(i, p, t, x, n, s) for i, v in values for p, t, x, n, s in resp.leaves(v, 20)]
    for leaves, size in ((1, 1 << 20), (4, 1 << 20), (1000, 30)):
        monkeypatch.setattr(resp, "BATCH_LEAVES", leaves)
        monkeypatch.setattr(resp, "BATCH_BYTES", size)
        rows = spark.createDataFrame(values, "id long, payload binary").coalesce(1)
        found = resp.decode_resp(rows, capture=20).collect()
        got = [(r.id, r.path, r.tag, None if r.bytes is None else bytes(r.bytes), r.number, r.length) for r in found]
        assert got == expected and all(r.depth == len(r.path) for r in found)
