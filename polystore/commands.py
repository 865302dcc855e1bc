"""Commands (lists of tokens) compiled to plans over one change log.

A store is a log DataFrame (lsn, key, kind, op, field, value, ts): what was there before, as one
DataFrame of any size, and the rows this session wrote. Reading commands fold the log with the
engine's operators; a single key is a filter pushed into the log's scan. Replies are Python values.

A key's epoch begins at its last deletion or at the last row of another kind; what came before
doesn't count. A write to a key whose time to live has passed, or that is of another kind, first
logs a deletion, so that neither old fields nor an old time to live come back.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polystore.operators import documents, fulltext, keyvalue, vectors
from polystore.operators.log import latest

SCHEMA = "lsn bigint, key string, kind string, op string, field string, value string, ts double"
NONE = "none"


class CommandError(Exception):
    pass


class Transaction:
    """Writes held back until commit, which logs them as one batch between two marks.

    Reads see the transaction's own writes first. As a context it commits, or rolls back on an error.
    """

    def __init__(self, store: Store):
        self.store, self.held, self.open = store, {}, True

    def _active(self) -> None:
        if not self.open:
            raise CommandError("the transaction is no longer active")

    def set(self, key: str, value: str) -> None:
        self._active()
        self.held[key] = value

    def delete(self, key: str) -> None:
        self._active()
        self.held[key] = None

    def get(self, key: str) -> str | None:
        return self.held[key] if key in self.held else self.store.execute(["GET", key])

    def commit(self) -> None:
        self._active()
        self.open = False
        self.store._append("", "*", "BEGIN")
        for key, value in self.held.items():
            self.store.write(key, "*" if value is None else "string", "DEL" if value is None else "SET", None, value)
        self.store._append("", "*", "COMMIT")

    def rollback(self) -> None:
        self.open = False
        self.held.clear()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.rollback()
        elif self.open:
            self.commit()


class Store:
    def __init__(self, spark: SparkSession, base: DataFrame | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.clock, self.rows = spark, base, clock, []
        self.texts: dict[str, DataFrame] = {}
        self.vectors: dict[str, DataFrame] = {}
        last = base.agg(F.max("lsn")).first()[0] if base is not None else None
        self.lsn = -1 if last is None else last
        self.known: dict[str, tuple[str | None, float | None]] = {}

    # the log

    def _state(self, key: str) -> tuple[str | None, float | None]:
        """(kind of the last writer, when it expires) of a key; looked up in the base once."""
        if key not in self.known:
            self.known[key] = None, None
            if self.base is not None:
                log = self.base.where(F.col("key") == key)
                last = latest(log.where(~F.col("op").isin("EXPIRE", "PERSIST")), ["key"], ["op", "kind"]).first()
                mark = self._expiries(log).first()
                self.known[key] = None if last is None or last["op"] == "DEL" else last["kind"], mark["expire_at"] if mark else None
        return self.known[key]

    def _append(self, key: str, kind: str, op: str, field: str | None = None, value: str | None = None) -> None:
        self.lsn += 1
        self.rows.append((self.lsn, key, kind, op, field, value, float(self.clock())))

    def write(self, key: str, kind: str, op: str, field: str | None = None, value: str | None = None) -> None:
        own, expire_at = self._state(key)
        gone = expire_at is not None and expire_at <= self.clock()
        if op != "DEL" and (gone or kind != "*" and own not in (None, kind)):
            self._append(key, "*", "DEL")
            own, expire_at = None, None
        self._append(key, kind, op, field, value)
        if op in ("DEL", "EXPIRE", "PERSIST"):
            self.known[key] = None if op == "DEL" else own, float(value) if op == "EXPIRE" else None
        else:
            self.known[key] = kind, None if kind == "string" else expire_at

    def begin(self) -> Transaction:
        return Transaction(self)

    def log(self) -> DataFrame:
        own = self.spark.createDataFrame(self.rows, SCHEMA)
        return own if self.base is None else self.base.select(own.columns).unionByName(own)

    def _expiries(self, log: DataFrame) -> DataFrame:
        """(key, expire_at, _set_at): a SET of a string clears the time to live, whatever made it."""
        marks = log.where(F.col("op").isin("EXPIRE", "PERSIST", "DEL") | ((F.col("kind") == "string") & F.col("op").isin("SET", "INCRBY", "APPEND")))
        return latest(marks, ["key"], ["op", "value", "ts"]).select("key", F.when(F.col("op") == "EXPIRE", F.col("value").cast("double")).alias("expire_at"))

    def of(self, kind: str, *keys: str) -> DataFrame:
        """The rows of a kind that still count: of keys alive, after their last deletion or row of another kind."""
        log = self.log()
        if keys:
            log = log.where(F.col("key").isin(*keys))
        gone = log.where((F.col("op") == "DEL") | ~F.col("kind").isin(kind, "*")).groupBy("key").agg(F.max("lsn").alias("_gone"))
        alive = self._expiries(log)
        rows = log.where(F.col("kind") == kind).join(gone, "key", "left").where("_gone IS NULL OR lsn > _gone").join(alive, "key", "left")
        return rows.where(F.col("expire_at").isNull() | (F.col("expire_at") > F.lit(float(self.clock())))).drop("_gone", "expire_at")

    # folds

    def strings(self, *keys: str) -> DataFrame:
        return keyvalue.strings(self.of("string", *keys).select("lsn", "key", "op", "value"))

    def fields(self, kind: str, *keys: str) -> DataFrame:
        """(key, field, value) of hashes, sets and sorted sets."""
        return latest(self.of(kind, *keys), ["key", "field"], ["op", "value"]).where("op <> 'REM'").drop("op")

    def lists(self, *keys: str) -> DataFrame:
        """(key, items): each key's operations in order, folded over its list."""
        steps = self.of("list", *keys).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lsn", "op", "field", "value"))).alias("steps"))

        def apply(items: Column, step: Column) -> Column:
            at = step["field"].cast("int")
            n = F.size(items)
            return (
                F.when(step["op"] == "LPUSH", F.concat(F.array(step["value"]), items))
                .when(step["op"] == "RPUSH", F.concat(items, F.array(step["value"])))
                .when(step["op"] == "LPOP", F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0))))
                .when(step["op"] == "RPOP", F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))))
                .when(step["op"] == "LSET", F.transform(items, lambda x, i: F.when(i == at, step["value"]).otherwise(x)))
                .otherwise(F.slice(items, at + 1, step["value"].cast("int")))
            )

        return steps.select("key", F.aggregate("steps", F.array().cast("array<string>"), apply).alias("items")).where("size(items) > 0")

    def keys(self) -> DataFrame:
        """(key, type) of all keys alive."""
        parts = [self.strings().select("key", F.lit("string").alias("type")), self.lists().select("key", F.lit("list").alias("type"))]
        parts += [self.fields(k).select("key", F.lit(k).alias("type")).distinct() for k in ("hash", "set", "zset")]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    # replies

    def _string(self, key: str) -> str | None:
        row = self.strings(key).first()
        return row["value"] if row else None

    def _items(self, key: str) -> list[str]:
        row = self.lists(key).first()
        return list(row["items"]) if row else []

    def _fields(self, kind: str, key: str) -> dict[str, str]:
        return {r["field"]: r["value"] for r in self.fields(kind, key).orderBy("field").collect()}

    def _ranked(self, key: str) -> list[tuple[str, float]]:
        rows = self.fields("zset", key).select(F.col("field").alias("member"), F.col("value").cast("double").alias("score"))
        return [(r["member"], r["score"]) for r in rows.orderBy("score", "member").collect()]

    def _type(self, key: str) -> str:
        if self._string(key) is not None:
            return "string"
        if self._items(key):
            return "list"
        return next((k for k in ("hash", "set", "zset") if self.fields(k, key).limit(1).count()), NONE)

    def execute(self, tokens: list[str]):
        """The reply to a command."""
        if not tokens:
            raise CommandError("empty command")
        name, args = tokens[0].upper(), list(tokens[1:])
        f = getattr(self, "do_" + name.lower().replace(".", "_"), None)
        if f is None:
            raise CommandError(f"unknown command '{tokens[0]}'")
        try:
            return f(*args)
        except TypeError as e:
            if "positional argument" in str(e):
                raise CommandError(f"wrong number of arguments for '{name}'") from e
            raise

    # server

    def do_ping(self, text: str = "PONG"):
        return text

    def do_echo(self, text: str):
        return text

    def do_command(self, *_):
        return sorted(n[3:].replace("_", ".").upper() for n in dir(self) if n.startswith("do_"))

    def do_info(self, *_):
        return {"rows": str(self.log().count()), "keys": str(self.do_dbsize())}

    def do_dbsize(self):
        return self.keys().count()

    def do_flushdb(self):
        for r in self.keys().collect():
            self.write(r["key"], "*", "DEL")
        return "OK"

    do_flushall = do_flushdb

    def do_compact(self):
        """Rows that a later deletion hides leave this session's part of the log."""
        last = {r[1]: r[0] for r in self.rows if r[3] == "DEL"}
        self.rows = [r for r in self.rows if r[0] >= last.get(r[1], -1)]
        return "OK"

    # strings

    def do_get(self, key):
        return self._string(key)

    def do_set(self, key, value, *flags):
        flags_ = [x.upper() for x in flags]
        there = self._string(key) is not None if {"NX", "XX"} & set(flags_) else None
        if "NX" in flags_ and there or "XX" in flags_ and not there:
            return None
        self.write(key, "string", "SET", None, value)
        if "EX" in flags_ and int(flags[flags_.index("EX") + 1]) > 0:
            self.do_expire(key, flags[flags_.index("EX") + 1])
        return "OK"

    def do_setnx(self, key, value):
        return int(self.do_set(key, value, "NX") is not None)

    def do_setex(self, key, seconds, value):
        return self.do_set(key, value, "EX", seconds)

    def do_mget(self, *keys):
        found = {r["key"]: r["value"] for r in self.strings(*keys).collect()}
        return [found.get(k) for k in keys]

    def do_mset(self, *pairs):
        for key, value in zip(pairs[::2], pairs[1::2], strict=True):
            self.do_set(key, value)
        return "OK"

    def do_incrby(self, key, amount):
        now = self._string(key) or "0"
        try:
            total = int(now) + int(amount)
        except ValueError as e:
            raise CommandError("value is not an integer") from e
        self.write(key, "string", "INCRBY", None, str(int(amount)))
        return total

    def do_incr(self, key):
        return self.do_incrby(key, "1")

    def do_decr(self, key):
        return self.do_incrby(key, "-1")

    def do_decrby(self, key, amount):
        return self.do_incrby(key, str(-int(amount)))

    def do_append(self, key, text):
        self.write(key, "string", "APPEND", None, text)
        return len(self._string(key) or "")

    def do_strlen(self, key):
        return len(self._string(key) or "")

    # keys

    def do_del(self, *keys):
        gone = [k for k in dict.fromkeys(keys) if self._type(k) != NONE]
        for k in gone:
            self.write(k, "*", "DEL")
        return len(gone)

    def do_exists(self, *keys):
        return sum(self._type(k) != NONE for k in keys)

    def do_expire(self, key, seconds):
        self.write(key, "*", "EXPIRE", None, repr(self.clock() + max(0, int(seconds))))
        return 1

    def do_ttl(self, key):
        if self._type(key) == NONE:
            return -2
        row = self._expiries(self.log().where(F.col("key") == key)).first()
        return -1 if row is None or row["expire_at"] is None else int(row["expire_at"] - self.clock())

    def do_persist(self, key):
        if self.do_ttl(key) < 0:
            return 0
        self.write(key, "*", "PERSIST")
        return 1

    def do_type(self, key):
        return self._type(key)

    def do_keys(self, pattern="*"):
        return [r["key"] for r in keyvalue.keys_like(self.keys(), pattern).orderBy("key").collect()]

    # hashes, sets, sorted sets

    def _add(self, kind: str, key: str, pairs: dict[str, str]) -> int:
        there = self._fields(kind, key)
        for field, value in pairs.items():
            self.write(key, kind, "SET", field, value)
        return len(set(pairs) - set(there))

    def _remove(self, kind: str, key: str, fields: tuple[str, ...]) -> int:
        gone = [f for f in dict.fromkeys(fields) if f in self._fields(kind, key)]
        for f in gone:
            self.write(key, kind, "REM", f)
        return len(gone)

    def do_hset(self, key, *pairs):
        return self._add("hash", key, dict(zip(pairs[::2], pairs[1::2], strict=True)))

    def do_hget(self, key, field):
        return self._fields("hash", key).get(field)

    def do_hdel(self, key, *fields):
        return self._remove("hash", key, fields)

    def do_hgetall(self, key):
        return self._fields("hash", key)

    def do_hkeys(self, key):
        return list(self._fields("hash", key))

    def do_hvals(self, key):
        return list(self._fields("hash", key).values())

    def do_hexists(self, key, field):
        return int(field in self._fields("hash", key))

    def do_hlen(self, key):
        return len(self._fields("hash", key))

    def do_hincrby(self, key, field, amount):
        total = int(self._fields("hash", key).get(field, "0")) + int(amount)
        self._add("hash", key, {field: str(total)})
        return total

    def do_sadd(self, key, *members):
        return self._add("set", key, dict.fromkeys(members, "1"))

    def do_srem(self, key, *members):
        return self._remove("set", key, members)

    def do_smembers(self, key):
        return list(self._fields("set", key))

    def do_sismember(self, key, member):
        return int(member in self._fields("set", key))

    def do_scard(self, key):
        return len(self._fields("set", key))

    def _sets(self, keys) -> DataFrame:
        return self.fields("set", *keys).select("key", F.col("field").alias("member"))

    def do_sunion(self, *keys):
        return sorted(r["member"] for r in keyvalue.union(self._sets(keys), list(keys)).collect())

    def do_sinter(self, *keys):
        return sorted(r["member"] for r in keyvalue.intersect(self._sets(keys), list(keys)).collect()) if keys else []

    def do_sdiff(self, first, *rest):
        return sorted(r["member"] for r in keyvalue.difference(self._sets((first, *rest)), first, list(rest)).collect())

    def do_zadd(self, key, *pairs):
        return self._add("zset", key, {m: repr(float(s)) for s, m in zip(pairs[::2], pairs[1::2], strict=True)})

    def do_zrem(self, key, *members):
        return self._remove("zset", key, members)

    def do_zscore(self, key, member):
        return dict(self._ranked(key)).get(member)

    def do_zincrby(self, key, amount, member):
        total = (self.do_zscore(key, member) or 0.0) + float(amount)
        self._add("zset", key, {member: repr(total)})
        return total

    def do_zrank(self, key, member):
        return next((i for i, (m, _) in enumerate(self._ranked(key)) if m == member), None)

    def do_zrange(self, key, start, stop, flag=""):
        rows = _part(self._ranked(key), int(start), int(stop))
        return [list(r) for r in rows] if flag.upper() == "WITHSCORES" else [m for m, _ in rows]

    def do_zcard(self, key):
        return len(self._ranked(key))

    # lists

    def do_lpush(self, key, *values):
        for v in values:
            self.write(key, "list", "LPUSH", None, v)
        return len(self._items(key))

    def do_rpush(self, key, *values):
        for v in values:
            self.write(key, "list", "RPUSH", None, v)
        return len(self._items(key))

    def _pop(self, key: str, op: str, at: int):
        items = self._items(key)
        if not items:
            return None
        self.write(key, "list", op)
        return items[at]

    def do_lpop(self, key):
        return self._pop(key, "LPOP", 0)

    def do_rpop(self, key):
        return self._pop(key, "RPOP", -1)

    def do_lrange(self, key, start, stop):
        return _part(self._items(key), int(start), int(stop))

    def do_llen(self, key):
        return len(self._items(key))

    def do_lindex(self, key, index):
        items, i = self._items(key), int(index)
        return items[i] if -len(items) <= i < len(items) else None

    def do_lset(self, key, index, value):
        n, i = len(self._items(key)), int(index)
        if not -n <= i < n:
            raise CommandError("index out of range")
        self.write(key, "list", "LSET", str(i % n), value)
        return "OK"

    def do_ltrim(self, key, start, stop):
        items = self._items(key)
        left = _part(list(range(len(items))), int(start), int(stop))
        self.write(key, "list", "LTRIM", str(left[0] if left else 0), str(len(left)))
        return "OK"

    # documents, text, vectors

    def _documents(self, coll: str) -> DataFrame:
        rows = self.fields("doc", coll)
        return rows.select(F.col("field").alias("doc_id"), F.try_parse_json("value").alias("body")).where("body IS NOT NULL")

    def do_doc_insert(self, coll, doc_id, body):
        doc = json.loads(body)
        if not isinstance(doc, dict):
            raise CommandError("a document is an object")
        self.write(coll, "doc", "SET", doc_id, json.dumps(doc | {"_id": doc_id}))
        return "OK"

    def do_doc_get(self, coll, doc_id):
        row = self._documents(coll).where(F.col("doc_id") == doc_id).select(F.to_json("body").alias("j")).first()
        return row["j"] if row else None

    def do_doc_update(self, coll, doc_id, patch):
        now = self.do_doc_get(coll, doc_id)
        if now is None:
            return None
        self.write(coll, "doc", "SET", doc_id, json.dumps(json.loads(now) | json.loads(patch)))
        return self.do_doc_get(coll, doc_id)

    def do_doc_delete(self, coll, doc_id):
        return self._remove("doc", coll, (doc_id,))

    def do_doc_query(self, coll, filters="{}"):
        return [r["j"] for r in documents.find(self._documents(coll), json.loads(filters)).select(F.to_json("body").alias("j")).collect()]

    def do_search_index(self, ns, doc_id, text):
        new = self.spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
        old = self.texts.get(ns)
        self.texts[ns] = new if old is None else old.where(F.col("doc_id") != doc_id).unionByName(new)
        return "OK"

    def do_search_bm25(self, ns, query, limit="10"):
        if ns not in self.texts:
            return []
        hits = fulltext.search(self.texts[ns], query, int(limit), stemming=True)
        return [[r["doc_id"], r["score"], r["snippet"]] for r in fulltext.with_snippets(hits, self.texts[ns], query).orderBy("pos").collect()]

    def do_vector_search(self, ns, numbers, top="10", metric="cosine"):
        if ns not in self.vectors:
            return []
        return [[r["vec_id"], r["score"]] for r in vectors.nearest(self.vectors[ns], [float(x) for x in numbers.split(",")], int(top), metric.lower()).orderBy("pos").collect()]

    def do_vector_insert(self, ns, vec_id, numbers):
        new = self.spark.createDataFrame([(vec_id, [float(x) for x in numbers.split(",")])], "vec_id string, embedding array<float>")
        old = self.vectors.get(ns)
        self.vectors[ns] = new if old is None else vectors.insert(old, new, len(old.first()["embedding"]))
        return "OK"


def _part(items: list, start: int, stop: int) -> list:
    """start..stop, both inclusive; negative numbers count from the end."""
    n = len(items)
    low = max(0, n + start) if start < 0 else start
    high = n + stop if stop < 0 else min(n - 1, stop)
    return items[low : high + 1] if low <= high else []
