"""Commands out of a stream of RESP bytes, whatever way it was cut into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Incomplete(Exception):
    """More bytes are needed: so many in all, as far as is known."""

    def __init__(self, needed: int):
        self.needed = needed


class ReplyError(Exception):
    """An error reply, as a value."""


def _number(digits: bytes) -> int | None:
    try:
        return int(digits)
    except ValueError:
        return None


def _text(data: bytes) -> str | bytes:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data


class Reader:
    """Takes chunks, gives values; keeps what isn't complete, and looks at it again when enough is there.

    Malformed input is a value, not a failure: a size that is no number gives None, an integer that
    is none gives 0; negative sizes give None.
    """

    def __init__(self) -> None:
        self.held, self.needed = bytearray(), 0

    def feed(self, chunk: bytes) -> list:
        self.held += chunk
        if len(self.held) < self.needed:
            return []
        out, at, self.needed = [], 0, 0
        while at < len(self.held):
            try:
                value, at = self._value(at)
            except Incomplete as e:
                self.needed = e.needed - at
                break
            out.append(value)
        del self.held[:at]
        return out

    def _line(self, at: int) -> tuple[bytes, int]:
        end = self.held.find(b"\r\n", at)
        if end < 0:
            raise Incomplete(len(self.held) + 1)
        return bytes(self.held[at:end]), end + 2

    def _value(self, at: int):
        line, after = self._line(at)
        kind, rest = line[:1], line[1:]
        if kind == b"+":
            return rest.decode("utf-8", "replace"), after
        if kind == b"-":
            return ReplyError(rest.decode("utf-8", "replace")), after
        if kind == b":":
            return _number(rest) or 0, after
        if kind == b"$":
            size = _number(rest)
            if size is None or size < 0:
                return None, after
            if len(self.held) < after + size + 2:
                raise Incomplete(after + size + 2)
            return _text(bytes(self.held[after : after + size])), after + size + 2
        if kind == b"*":
            size = _number(rest)
            if size is None or size < 0:
                return None, after
            items = []
            for _ in range(size):
                item, after = self._value(after)
                items.append(item)
            return items, after
        return line.decode("utf-8", "replace").split(), after  # an inline command


def encode(value) -> bytes:
    """A reply: None, booleans, integers, texts, lists and dictionaries (flattened)."""
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, Exception):
        return b"-%s\r\n" % str(value).encode()
    if isinstance(value, bool):
        return b":%d\r\n" % value
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, dict):
        value = [x for pair in value.items() for x in pair]
    if isinstance(value, (list, tuple, set)):
        return b"*%d\r\n" % len(value) + b"".join(map(encode, value))
    data = value if isinstance(value, bytes) else str(value).encode()
    return b"$%d\r\n" % len(data) + data + b"\r\n"


def _tokens(value) -> list[str | None]:
    items = value if isinstance(value, list) else [value]
    return [x if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in items]


BLOB = 4096  # bytes of a connection that go on together
ROWS = 64  # of these, what a worker reads before it passes commands on


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conn, seq, chunk) in order, with the chunks of a connection that follow each other joined to some BLOB bytes."""
    for batch in batches:
        n, chunk = batch.num_rows, batch.column(2).cast(pa.binary())
        if not n:
            continue
        if chunk.null_count:
            raise ValueError("a chunk is null")
        at = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + n + 1]
        data = chunk.buffers()[2] or pa.py_buffer(b"")
        number = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.ones(n, dtype=bool)
        new[1:] = number[1:] != number[:-1]
        begin = at[np.maximum.accumulate(np.where(new, np.arange(n), 0))]  # where the connection begins, by row
        blob = (at[:-1] - begin) // BLOB
        new[1:] |= blob[1:] != blob[:-1]
        first = np.flatnonzero(new)
        ends = pa.py_buffer(np.append(at[first], at[-1]).astype(np.int32))
        rows = pa.array(first)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.Array.from_buffers(pa.binary(), len(first), [None, ends, data])], names=["conn", "seq", "chunk"])


def parse(chunks: DataFrame) -> DataFrame:
    """chunks (conn, seq, chunk) as commands (conn, n, tokens).

    All tasks put chunks in order, by ranges, and join them. A connection's bytes mean something
    only in their order, so one task reads what was joined; the task streams: it holds a batch
    of it and one unfinished value, whatever the connection's length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conn, reader, n = None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                conns, numbers, tokens = [], [], []
                for own, chunk in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if reader is None or own != conn:
                        conn, reader, n = own, Reader(), 0
                    for value in reader.feed(chunk):
                        conns.append(own), numbers.append(n), tokens.append(_tokens(value))
                        n += 1
                if conns:
                    yield pa.RecordBatch.from_arrays([pa.array(conns, pa.string()), pa.array(numbers, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], names=["conn", "n", "tokens"])

    sent = chunks.select("conn", "seq", "chunk")
    partitions = max(8, sent.sparkSession.sparkContext.defaultParallelism, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = sent.repartitionByRange(partitions, "conn", "seq").sortWithinPartitions("conn", "seq").mapInArrow(_joined, sent.schema)
    return joined.repartition(partitions, "conn").sortWithinPartitions("conn", "seq").mapInArrow(read, "conn string, n long, tokens array<string>")
