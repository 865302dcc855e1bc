"""Binary segments and tables."""

import struct

from polystore.operators import log
from polystore.sources import segments as sg


def test_segments(spark, tmp_path):
    good = [(1, 1.5, "SET", b"user:100", b"a"), (2, 2.5, "SET", b"user:101", b"b"), (3, 3.5, "DEL", b"user:100", b"")]
    first = b"".join(sg.frame(*f) for f in good)
    (tmp_path / "0001.log").write_bytes(first + b"garbage that is no frame, longer than a header of a frame")
    bad = bytearray(sg.frame(5, 1.0, "SET", b"k2", b"v2"))
    bad[-1] ^= 1
    (tmp_path / "0002.log").write_bytes(sg.frame(4, 1.0, "SET", b"k1", b"v1") + bytes(bad) + sg.frame(6, 1.0, "SET", b"k3", b"v3"))
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = sg.read_log(spark, str(tmp_path))
    assert [r["lsn"] for r in rows.orderBy("lsn").collect()] == [1, 2, 3, 4]
    assert sorted(map(tuple, log.current(sg.log_rows(rows)).collect())) == [("k1", "v1"), ("user:101", "b")]
    assert list(sg.frames_of(first[:-1])) == good[:2] and list(sg.frames_of(b"")) == []


def test_tables(spark, tmp_path):
    pairs = [(b"key_%04d" % i, b"v%d" % i) for i in range(100)] + [(b"zz", b"gone")]
    body = sg.TABLE_MAGIC + bytes([sg.TABLE_VERSION]) + b"".join(struct.pack(sg.ENTRY, len(k), len(v)) + k + v for k, v in pairs)
    footer = struct.pack(">QQQQIH", len(body), 0, len(body), 0, len(pairs), 0) + struct.pack(">H", 0)
    (tmp_path / "1.sst").write_bytes(body + footer + struct.pack(sg.TRAILER, len(body), sg.TRAILER_MAGIC))
    rows = sg.read_tables(spark, str(tmp_path), deleted=b"gone")
    assert rows.count() == 101 and rows.where("deleted").count() == 1
    state = rows.selectExpr("CAST(key AS STRING) AS key", "value", "deleted")
    assert log.scan(state, "key_0020", "key_0030").count() == 11 and log.get(state, "key_9999").count() == 0
