"""Commands end to end."""

import pytest

from polystore.commands import CommandError, Store


@pytest.fixture()
def store(spark):
    now = [1000.0]
    s = Store(spark, clock=lambda: now[0])
    s.now = now
    return s


def say(store, line):
    return store.execute(line.split(" "))


def test_strings(store):
    assert say(store, "PING") == "PONG" and say(store, "ECHO hi") == "hi"
    assert say(store, "SET msg hello") == "OK" and say(store, "GET msg") == "hello"
    assert say(store, "SETNX msg x") == 0 and say(store, "SETNX new x") == 1
    assert say(store, "APPEND msg _more") == 10 and say(store, "STRLEN msg") == 10
    assert say(store, "INCRBY n 5") == 5 and say(store, "DECR n") == 4 and say(store, "GET n") == "4"
    assert say(store, "MGET msg none n") == ["hello_more", None, "4"]
    assert say(store, "DEL msg none") == 1 and say(store, "GET msg") is None
    with pytest.raises(CommandError):
        say(store, "INCR new")
    with pytest.raises(CommandError):
        say(store, "NOSUCH x")


def test_expiry(store):
    say(store, "SET a 1 EX 10")
    assert say(store, "TTL a") == 10 and say(store, "TTL none") == -2
    store.now[0] += 4
    assert say(store, "TTL a") == 6 and say(store, "PERSIST a") == 1 and say(store, "TTL a") == -1
    say(store, "EXPIRE a 5")
    say(store, "INCR a")  # a write of a string clears its time to live
    assert say(store, "TTL a") == -1
    say(store, "EXPIRE a 5")
    store.now[0] += 5
    assert say(store, "GET a") is None and say(store, "TYPE a") == "none"


def test_epochs(store):
    say(store, "SET a 10 EX 5")
    store.now[0] += 10
    assert say(store, "INCR a") == 1 and say(store, "GET a") == "1"
    say(store, "HSET h f 1")
    say(store, "EXPIRE h 5")
    store.now[0] += 10
    assert say(store, "HSET h g 2") == 1 and say(store, "HGETALL h") == {"g": "2"} and say(store, "TTL h") == -1
    say(store, "HSET x f 1")
    say(store, "SET x v")
    assert say(store, "TYPE x") == "string" and say(store, "HGETALL x") == {}
    say(store, "HSET x g 2")
    assert say(store, "HGETALL x") == {"g": "2"} and say(store, "GET x") is None
    again = Store(store.spark, store.log(), clock=store.clock)  # the same log, read as a base
    store.now[0] += 1
    assert say(again, "HGETALL x") == {"g": "2"} and say(again, "SET x s") == "OK" and say(again, "HGETALL x") == {}


def test_transactions(store):
    say(store, "SET a 1")
    with store.begin() as t:
        t.set("a", "2")
        t.set("b", "3")
        t.delete("c")
        assert t.get("a") == "2" and say(store, "GET a") == "1"
    assert say(store, "MGET a b") == ["2", "3"]
    with pytest.raises(CommandError):
        t.set("a", "4")
    with pytest.raises(RuntimeError), store.begin() as t:
        t.delete("a")
        assert t.get("a") is None
        raise RuntimeError
    assert say(store, "GET a") == "2" and say(store, "DBSIZE") == 2


class Plain:
    """The store as a dictionary with a clock: {key: [kind, value, expire_at]}."""

    def __init__(self, now):
        self.now, self.data = now, {}

    def alive(self, key):
        own = self.data.get(key)
        return own is not None and (own[2] is None or own[2] > self.now[0])

    def of(self, key, kind, empty):
        return self.data[key][1] if self.alive(key) and self.data[key][0] == kind else type(empty)()

    def put(self, key, kind, value):
        stays = self.alive(key) and self.data[key][0] == kind and kind != "string"
        self.data[key] = [kind, value, self.data[key][2] if stays else None]


def test_random_steps_agree_with_a_dictionary(store):
    import random

    rng, plain = random.Random(12), Plain(store.now)
    for step in range(90):
        key, x = rng.choice("kl"), rng.choice("xyz")
        kind = rng.choice(["set", "incr", "hset", "sadd", "zadd", "rpush", "lpop", "hdel", "expire", "wait", "del", "read"])
        if kind == "set":
            say(store, f"SET {key} 7")
            plain.put(key, "string", "7")
        elif kind == "incr":
            n = int(plain.of(key, "string", "") or "0") + 1
            assert say(store, f"INCR {key}") == n, step
            plain.put(key, "string", str(n))
        elif kind == "hset":
            h = dict(plain.of(key, "hash", {}))
            assert say(store, f"HSET {key} {x} {step}") == (x not in h), step
            plain.put(key, "hash", h | {x: str(step)})
        elif kind == "sadd":
            s = dict(plain.of(key, "set", {}))
            assert say(store, f"SADD {key} {x}") == (x not in s), step
            plain.put(key, "set", s | {x: "1"})
        elif kind == "zadd":
            z = dict(plain.of(key, "zset", {}))
            say(store, f"ZADD {key} {step % 7} {x}")
            plain.put(key, "zset", z | {x: float(step % 7)})
        elif kind == "rpush":
            items = [*plain.of(key, "list", []), x]
            assert say(store, f"RPUSH {key} {x}") == len(items), step
            plain.put(key, "list", items)
        elif kind == "lpop":
            items = plain.of(key, "list", [])
            assert say(store, f"LPOP {key}") == (items[0] if items else None), step
            if items:
                plain.put(key, "list", items[1:])
        elif kind == "hdel":
            h = plain.of(key, "hash", {})
            assert say(store, f"HDEL {key} {x}") == (x in h), step
            if x in h:
                plain.put(key, "hash", {f: v for f, v in h.items() if f != x})
        elif kind == "expire" and plain.alive(key):
            say(store, f"EXPIRE {key} 3")
            plain.data[key][2] = store.now[0] + 3
        elif kind == "wait":
            store.now[0] += rng.choice([1, 2])
        elif kind == "del":
            store.write(key, "*", "DEL")
            plain.data.pop(key, None)
        else:
            assert say(store, f"GET {key}") == (plain.of(key, "string", "") or None), step
            assert say(store, f"HGETALL {key}") == plain.of(key, "hash", {}), step
            assert say(store, f"SMEMBERS {key}") == sorted(plain.of(key, "set", {})), step
            assert say(store, f"ZRANGE {key} 0 -1") == [m for _, m in sorted((s, m) for m, s in plain.of(key, "zset", {}).items())], step
            assert say(store, f"LRANGE {key} 0 -1") == plain.of(key, "list", []), step


def test_collections(store):
    assert say(store, "HSET h f 1 g 2") == 2 and say(store, "HSET h f 3") == 0 and say(store, "HGETALL h") == {"f": "3", "g": "2"}
    assert say(store, "HINCRBY h f 4") == 7 and say(store, "HDEL h g none") == 1 and say(store, "HKEYS h") == ["f"]
    assert say(store, "RPUSH l a b c d") == 4 and say(store, "LPUSH l z") == 5
    assert say(store, "LINDEX l -1") == "d" and say(store, "LSET l 1 A") == "OK" and say(store, "LRANGE l 0 1") == ["z", "A"]
    assert say(store, "LTRIM l 1 3") == "OK" and say(store, "LPOP l") == "A" and say(store, "RPOP l") == "c" and say(store, "LLEN l") == 1
    say(store, "SADD s 1 2 3")
    say(store, "SADD t 2 3 4")
    assert say(store, "SINTER s t") == ["2", "3"] and say(store, "SUNION s t") == ["1", "2", "3", "4"] and say(store, "SDIFF s t") == ["1"]
    assert say(store, "ZADD z 100 a 50 b 70 c") == 3 and say(store, "ZRANGE z 0 1") == ["b", "c"] and say(store, "ZRANK z a") == 2
    assert say(store, "ZINCRBY z 60 b") == 110.0 and say(store, "ZRANGE z -1 -1 WITHSCORES") == [["b", 110.0]]
    assert say(store, "KEYS ?") == ["h", "l", "s", "t", "z"] and say(store, "DBSIZE") == 5 and say(store, "TYPE z") == "zset"


def test_documents_text_and_vectors(store):
    store.execute(["DOC.INSERT", "items", "i1", '{"title": "Book", "price": 25}'])
    assert '"Book"' in say(store, "DOC.GET items i1")
    assert len(store.execute(["DOC.QUERY", "items", '{"price": {"$gte": 20}}'])) == 1
    assert '"price":30' in store.execute(["DOC.UPDATE", "items", "i1", '{"price": 30}'])
    assert say(store, "DOC.DELETE items i1") == 1 and say(store, "DOC.GET items i1") is None
    store.execute(["SEARCH.INDEX", "ns", "d1", "relational databases keep tables"])
    store.execute(["SEARCH.INDEX", "ns", "d2", "vectors keep numbers"])
    assert store.execute(["SEARCH.BM25", "ns", "databases"])[0][0] == "d1"
    say(store, "VECTOR.INSERT v a 1,0")
    say(store, "VECTOR.INSERT v b 0,1")
    assert say(store, "VECTOR.SEARCH v 1,0 1") == [["a", 1.0]]
