"""Operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from polystore.functions import words
from polystore.functions.words import stem, terms_of
from polystore.operators import bloom, documents, fulltext, keyvalue, log, vectors
from polystore.sources import resp


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


# strings

OPS = "lsn bigint, key string, op string, value string"


def test_string_fold(spark):
    steps = [(1, "counter", "SET", "10"), (2, "counter", "INCRBY", "5"), (3, "counter", "INCRBY", "-2"), (4, "counter", "APPEND", "_appended"), (5, "new", "APPEND", "x"), (6, "gone", "SET", "1"), (7, "gone", "DEL", None), (8, "bad", "SET", "word"), (9, "bad", "INCRBY", "1")]
    assert got(keyvalue.strings(frame(spark, steps, OPS))) == [("counter", "13_appended"), ("new", "x")]
    counted = {r["key"]: (r["value"], r["error"]) for r in keyvalue.counters(frame(spark, [s for s in steps if s[2] != "APPEND"], OPS)).collect()}
    assert counted == {"counter": (13, False), "bad": (None, True)}


def simulate(steps):
    state = {}
    for _, key, op, value in sorted(steps):
        if op == "SET":
            state[key] = value
        elif op == "DEL":
            state.pop(key, None)
        elif op == "APPEND":
            state[key] = state.get(key, "") + value
        else:
            state[key] = str(int(state.get(key, "0")) + int(value))
    return sorted(state.items())


def test_string_fold_of_random_logs(spark):
    rng = random.Random(7)
    steps = [(i, f"k{rng.randrange(8)}", op := rng.choice(["SET", "DEL", "INCRBY", "INCRBY", "APPEND"]), None if op == "DEL" else str(rng.randrange(1, 9))) for i in range(150)]
    assert got(keyvalue.strings(frame(spark, steps, OPS))) == simulate(steps)


def test_nx_and_xx(spark):
    log_ = frame(spark, [(1, "a", "SET", "1"), (2, "a", "SET", "2"), (3, "b", "SET", "1"), (4, "b", "DEL", None), (5, "b", "SET", "3")], OPS)
    assert got(keyvalue.set_if_absent(log_)) == [("a", "1"), ("b", "3")]
    sets, guarded = frame(spark, [(2, "a", "SET", "1")], OPS), frame(spark, [(1, "a", "SET", "early"), (3, "a", "SET", "late"), (4, "b", "SET", "never")], OPS)
    assert got(keyvalue.set_if_present(sets, guarded)) == [("a", "late")]


# lists, sets, sorted sets


def test_lists(spark):
    rows = frame(spark, [(i, "tasks", f"task{i}") for i in range(1, 5)], "lsn bigint, key string, value string")
    tasks = keyvalue.pushed(rows.limit(0), rows)
    assert [r["value"] for r in keyvalue.lrange(tasks, 0, -1).orderBy("pos").collect()] == ["task1", "task2", "task3", "task4"]
    assert got(keyvalue.lindex(tasks, 1)) == [("tasks", "task2")] and got(keyvalue.lindex(tasks, -1)) == [("tasks", "task4")] and got(keyvalue.lindex(tasks, 9)) == []
    assert [r["value"] for r in keyvalue.lset(tasks, 1, "x").orderBy("pos").collect()] == ["task1", "x", "task3", "task4"]
    assert [r["value"] for r in keyvalue.ltrim(tasks, 1, 2).orderBy("pos").collect()] == ["task2", "task3"]
    out, left = keyvalue.popped(tasks, left=1, right=1)
    assert {r["value"] for r in out.collect()} == {"task1", "task4"} and {r["value"] for r in left.collect()} == {"task2", "task3"}
    assert got(keyvalue.lrange(tasks, 3, 1)) == [] and len(got(keyvalue.lrange(tasks, -100, 100))) == 4 and got(keyvalue.lrange(tasks, 0, -100)) == []
    head = keyvalue.pushed(rows, rows)
    assert [r["value"] for r in keyvalue.lrange(head, 0, 3).orderBy("pos").collect()] == ["task4", "task3", "task2", "task1"]


def test_sets(spark):
    sets = frame(spark, [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 4)], "key string, member int")
    members = lambda df: sorted(r["member"] for r in df.collect())
    assert members(keyvalue.union(sets, ["a", "b"])) == [1, 2, 3, 4]
    assert members(keyvalue.intersect(sets, ["a", "b"])) == [2, 3] and members(keyvalue.intersect(sets, ["a", "none"])) == []
    assert members(keyvalue.difference(sets, "a", ["b"])) == [1]


def test_sorted_sets(spark):
    board = frame(spark, [("l", "p1", 100.0), ("l", "p2", 250.5), ("l", "p3", 70.0), ("l", "p0", 100.0)], "key string, member string, score double")
    assert {r["member"]: r["rank"] for r in keyvalue.ranked(board).collect()} == {"p3": 0, "p0": 1, "p1": 2, "p2": 3}
    assert [r["member"] for r in keyvalue.zrange(board, 0, 1).orderBy("rank").collect()] == ["p3", "p0"]
    assert [r["member"] for r in keyvalue.zrange(board, -2, -1).orderBy("rank").collect()] == ["p1", "p2"]


def test_hashes(spark):
    steps = frame(spark, [(1, "u", "name", "Grace"), (2, "u", "role", "Eng"), (3, "u", "name", "Ada")], "lsn bigint, key string, field string, value string")
    assert keyvalue.hgetall(keyvalue.hset(steps)).first()["entries"] == {"name": "Ada", "role": "Eng"}


# expiry and keys


def test_expiry(spark):
    keys = frame(spark, [("a", "2024-01-01 00:00:10"), ("b", None), ("c", "2023-12-31 00:00:00")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("expire_at"))
    now = F.lit("2024-01-01 00:00:08.5").cast("timestamp")
    assert got(keyvalue.ttl(keys, now)) == [("a", 1), ("b", -1), ("c", -2)]
    assert [r["key"] for r in keyvalue.live(keys, now).collect()] == ["a", "b"]
    assert {r["ttl"] for r in keyvalue.ttl(keyvalue.persist(keys), now).collect()} == {-1}
    assert {r["ttl"] for r in keyvalue.ttl(keyvalue.expire(keys, F.lit(-5), now), now).collect()} == {-2}


@pytest.mark.parametrize("pattern", ["*", "a?c", "a[bc]d", "a[!b]d", "a.c", "a[", "user:*:x", "[]]", "a\\b", "[a-c]x", "é*"])
def test_globs(spark, pattern):
    from fnmatch import fnmatchcase

    names = ["abc", "abd", "acd", "a.c", "a[", "user:1:x", "user::x", "]", "a\\b", "bx", "dx", "a\nc", "été", ""]
    keys = frame(spark, [(n,) for n in names], "key string")
    assert sorted(r["key"] for r in keyvalue.keys_like(keys, pattern).collect()) == sorted(n for n in names if fnmatchcase(n, pattern))


# documents

USERS = [("u1", {"name": "Alice", "age": 30, "status": "active", "tags": ["admin", "dev"]}), ("u2", {"name": "Bob", "age": 20, "status": "pending", "tags": ["dev"]}), ("u3", {"name": "Charlie", "age": 45, "status": "active", "tags": ["lead"]}), ("u4", {"name": None, "age": "30", "ok": True, "deep": {"0": "zero", "list": [[1, 2], 3]}})]


@pytest.fixture(scope="module")
def users(spark):
    import json

    return spark.createDataFrame([(i, json.dumps(b)) for i, b in USERS], "doc_id string, j string").select("doc_id", F.parse_json("j").alias("body"))


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({"status": "active", "age": {"$gte": 30}}, ["u1", "u3"]),
        ({"tags": {"$contains": "dev"}}, ["u1", "u2"]),
        ({"name": {"$contains": "li"}}, ["u1", "u3"]),
        ({"age": 30}, ["u1"]),
        ({"age": "30"}, ["u4"]),
        ({"name": None}, ["u4"]),
        ({"status": {"$ne": "active"}}, ["u2", "u4"]),
        ({"status": {"$nin": ["active"]}}, ["u2", "u4"]),
        ({"status": {"$in": ["pending", None]}}, ["u2", "u4"]),
        ({"age": {"$lt": 45, "$gt": 20}}, ["u1"]),
        ({"name": {"$regex": "^[AB]"}}, ["u1", "u2"]),
        ({"ok": 1}, ["u4"]),
        ({"deep.0": "zero"}, ["u4"]),
        ({"deep.list.0.1": 2}, ["u4"]),
        ({"deep.list.-1": 3}, ["u4"]),
        ({"tags.-1": "dev"}, ["u1", "u2"]),
        ({"tags": ["dev"]}, ["u2"]),
        ({"status": {}}, ["u1", "u2", "u3", "u4"]),
        ({}, ["u1", "u2", "u3", "u4"]),
    ],
)
def test_filters(users, filters, want):
    assert sorted(r["doc_id"] for r in documents.matches(users, filters).collect()) == want


def test_sorting_and_paging(users):
    names = lambda **k: [r["doc_id"] for r in documents.find(users, **k).collect()]
    assert names(sort_by="name") == ["u1", "u2", "u3", "u4"] and names(sort_by="name", reverse=True) == ["u4", "u3", "u2", "u1"]
    assert names(limit=2, offset=1) == ["u2", "u3"]


def test_unknown_operator(users):
    with pytest.raises(ValueError):
        documents.matches(users, {"a": {"$near": 1}})


def test_shallow_merge(spark):
    rows = frame(spark, [("a", {"x": "1", "y": "2"}), ("b", {"x": "3"})], "doc_id string, body map<string,string>")
    out = documents.merge(rows, frame(spark, [("a", {"y": "9", "z": "0"})], "doc_id string, body map<string,string>"))
    assert {r["doc_id"]: r["body"] for r in out.collect()} == {"a": {"x": "1", "y": "9", "z": "0"}, "b": {"x": "3"}}


# text


@pytest.mark.parametrize(("word", "want"), [("connecting", "connect"), ("relational", "relate"), ("databases", "database"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agree"), ("hopping", "hop"), ("happy", "happi"), ("sky", "sky"), ("at", "at"), ("conflated", "conflate"), ("adjustment", "adjust"), ("seeing", "se"), ("freeing", "fre"), ("falling", "fall"), ("hissing", "hiss"), ("dies", "di"), ("feed", "feed"), ("nationalization", "national"), ("vietnamization", "vietnam")])
def test_stems(word, want):
    assert stem(word) == want


def test_snippets():
    shown = fulltext.snippet_of
    text = "one two three four five six seven eight relational databases"
    assert shown(text, "relational") == text.replace("relational", "<b>relational</b>")  # the first window that holds it begins the text
    long = "start " + "filler " * 40 + "alpha beta " + "filler " * 40
    begin = next(i for i in range(len(long)) if long[i - 1] == " " and "alpha beta" in long[i : i + 160]) - 20  # 20 characters before the first window with both
    assert shown(long, "alpha beta") == "..." + long[begin : begin + 160].strip().replace("alpha", "<b>alpha</b>").replace("beta", "<b>beta</b>") + "..."
    assert shown("alpha " + long, "alpha beta", 400).count("<b>") == 3
    assert shown("", "x") == "" and shown("short", "") == "short"


def test_terms():
    assert terms_of("The Résumé ﬁne, don't") == ["re", "sume", "fine", "don"]


def test_search(spark):
    docs = frame(spark, [(1, "ACID relational databases keep tables"), (2, "Vector embeddings and similarity search"), (3, "Trees merge sorted runs of keys"), (4, ""), (5, None)], "doc_id bigint, text string")
    assert fulltext.search(docs, "ACID relational databases", stemming=True).first()["doc_id"] == 1
    assert fulltext.search(docs, "vector embeddings similarity").first()["doc_id"] == 2
    twice = {r["doc_id"]: r["score"] for r in fulltext.search(docs, "vector vector").collect()}
    once = {r["doc_id"]: r["score"] for r in fulltext.search(docs, "vector").collect()}
    assert abs(twice[2] - 2 * once[2]) < 2e-4
    shown = fulltext.with_snippets(fulltext.search(docs, "relational"), docs, "relational").first()["snippet"]
    assert "<b>relational</b>" in shown
    many = fulltext.search_many(fulltext.query_terms(spark, {7: "vector"}), fulltext.postings(docs), fulltext.lengths(docs))
    assert got(many) == [(7, 1, 2, once[2])]


# vectors


def test_nearest(spark):
    rows = frame(spark, [(1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "b"), (3, [0.99, 0.01, 0.0], "b"), (4, [0.0, 0.0, 0.0], None)], "vec_id bigint, embedding array<float>, tag string")
    ids = lambda df: [r["vec_id"] for r in df.orderBy("pos").collect()]
    assert ids(vectors.nearest(rows, [1.0, 0.0, 0.0], 2)) == [1, 3]
    assert ids(vectors.nearest(rows, [1.0, 0.0, 0.0], 2, "euclidean")) == [1, 3] and ids(vectors.nearest(rows, [1.0, 0.0, 0.0], 1, "dot")) == [1]
    assert ids(vectors.nearest(rows, [1.0, 0.0, 0.0], 2, where={"tag": "b"})) == [3, 2] and ids(vectors.nearest(rows, [1.0, 0.0, 0.0], 2, where={"tag": None})) == [4]
    with pytest.raises(ValueError):
        vectors.nearest(rows, [1.0], 1, "hamming")
    with pytest.raises(Exception, match="is not true"):
        vectors.nearest(rows, [1.0, 0.0], 1).collect()
    batch = vectors.nearest_many(frame(spark, [(0, [1.0, 0.0, 0.0])], "query_id bigint, embedding array<float>"), rows, 2)
    assert [(r["query_id"], r["vec_id"]) for r in batch.orderBy("pos").collect()] == [(0, 1), (0, 3)]


def test_inverted_lists(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    centroids = vectors.train_lists(rows, 8, 4)
    assigned = vectors.assign(rows, centroids)
    query = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    exact = got(vectors.nearest(rows, query, 10))
    assert got(vectors.search_lists(rows, assigned, centroids, query, 10, probe=8)) == exact
    some = {r[1] for r in got(vectors.search_lists(rows, assigned, centroids, query, 10, probe=3))}
    assert len(some & {r[1] for r in exact}) >= 5


# log, transactions, filters, protocol


def test_log(spark):
    rows = frame(spark, [(i, f"key_{i:03d}", "SET", str(i)) for i in range(100)] + [(100 + i, f"key_{i:03d}", "DEL", None) for i in range(50)], OPS)
    assert [r["key"] for r in log.current(rows).orderBy("key").collect()] == [f"key_{i:03d}" for i in range(50, 100)]
    assert log.scan(log.current(rows), "key_060", "key_070").count() == 11
    snapshot = log.current(rows.where("lsn < 100"), columns=["value", "lsn"])
    assert log.compact(snapshot, rows, 99).count() == 50
    assert log.get(log.current(rows), "key_010").count() == 0


def test_frames(spark):
    rows = log.frames(frame(spark, [(i, f"k{i}", "SET", "v") for i in range(20)], OPS), 10)
    broken = rows.withColumn("value", F.when(F.col("lsn") == 4, "x").otherwise(F.col("value")))
    assert sorted(r["lsn"] for r in log.valid_prefix(broken).collect()) == [0, 1, 2, 3, *range(10, 20)]
    assert log.purge(rows, 5).select("segment").distinct().count() == 1


def test_transactions(spark):
    rows = frame(spark, [(1, 1, "A", "SET", "100"), (2, 1, "B", "SET", "200"), (3, 2, "A", "SET", "50"), (4, None, "C", "SET", "1")], "lsn bigint, txn_id bigint, key string, op string, value string")
    outcomes = frame(spark, [(1, "COMMIT"), (2, "ROLLBACK")], "txn_id bigint, outcome string")
    assert got(log.current(log.committed(rows, outcomes))) == [("A", "100"), ("B", "200"), ("C", "1")]


def test_bloom(spark):
    keys = frame(spark, [(f"key_{i}",) for i in range(500)], "key string")
    probes = frame(spark, [(f"key_{i}",) for i in range(500)] + [(f"missing_{i}",) for i in range(1000)], "key string")
    bits, hashes = bloom.shape(1000, 0.01)
    found = {r["key"] for r in bloom.maybe(probes, "key", bloom.build(keys, "key", bits, hashes), bits, hashes).collect()}
    assert {f"key_{i}" for i in range(500)} <= found and len(found) < 550
    assert bloom.semi_join(probes, keys, "key", 500).count() == 500


def test_protocol(spark):
    reader = resp.Reader()
    assert reader.feed(b"$abc\r\n:x\r\n*-1\r\n$-1\r\n*?\r\n-ERR no\r\n")[:5] == [None, 0, None, None, None]
    assert isinstance(resp.Reader().feed(b"-ERR no\r\n")[0], resp.ReplyError) and resp.Reader().feed(b"$2\r\n\xff\xfe\r\n") == [b"\xff\xfe"]
    big = b"*2\r\n$3\r\nSET\r\n$50000\r\n" + b"x" * 50_000 + b"\r\n"
    assert [v for i in range(0, len(big), 7) for v in reader.feed(big[i : i + 7])] == [["SET", "x" * 50_000]]
    assert reader.feed(b"*3\r\n$3\r\nSET\r\n$") == [] and reader.feed(b"3\r\nfoo\r\n$3\r\n") == []
    assert reader.feed(b"bar\r\n+OK\r\n:5\r\n$-1\r\nPING now\r\n") == [["SET", "foo", "bar"], "OK", 5, None, ["PING", "now"]]
    assert resp.encode({"a": 1}) == b"*2\r\n$1\r\na\r\n:1\r\n" and resp.encode(None) == b"$-1\r\n" and resp.encode(["x", True]) == b"*2\r\n$1\r\nx\r\n:1\r\n"
    chunks = frame(spark, [("c", 0, b"*1\r\n$4\r"), ("c", 1, b"\nPING\r\n"), ("d", 0, b"ECHO hi\r\n")], "conn string, seq bigint, chunk binary")
    assert got(resp.parse(chunks)) == [("c", 0, ["PING"]), ("d", 0, ["ECHO", "hi"])]


def test_pushdown(spark, small):
    from polystore.tables import event_log

    plan = log.current(log.get(event_log(spark, small).where("user_id = 3"), "user:3"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)" in plan and "html" not in plan


def test_filters_reach_the_scan(spark, small):
    from polystore.plans.document_queries import _events

    plan = documents.matches(_events(spark, small), {"type": "purchase", "user_id": {"$lt": 50}})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "LessThan(user_id,50)" in plan


def test_resp_chunks_are_joined_before_they_are_read(spark, monkeypatch):
    """A connection is ordered and joined by all tasks; the one that parses it gets few rows, of some BLOB bytes."""
    fed = spark.sparkContext.accumulator(0)
    feed = resp.Reader.feed
    monkeypatch.setattr(resp.Reader, "feed", lambda self, chunk: (fed.add(1), feed(self, chunk))[1])
    sent = {c: b"".join(resp.encode(["SET", f"{c}{i}", "x" * (i % 40)]) for i in range(600)) + resp.encode(["SET", "big", "y" * 9000]) for c in "ab"}
    rows = [(c, at * 10 - 7, data[at : at + 7]) for c, data in sent.items() for at in range(0, len(data), 7)] + [("a", -100, b""), ("c", 3, b"PING\r\n")]
    found = resp.parse(frame(spark, rows, "conn string, seq bigint, chunk binary").repartition(5)).collect()
    assert sorted((r["conn"], r["n"], r["tokens"]) for r in found) == sorted([(c, i, ["SET", f"{c}{i}", "x" * (i % 40)]) for c in "ab" for i in range(600)] + [(c, 600, ["SET", "big", "y" * 9000]) for c in "ab"] + [("c", 0, ["PING"])])
    assert fed.value < len(rows) / 50


def test_texts_pass_python_once_and_only_if_they_need_it(spark):
    docs = frame(spark, [(1, "Plain words here"), (2, "Caf\u00e9 ﬁne"), (3, None), (4, "")], "doc_id bigint, text string")
    sizes = fulltext.lengths(docs)
    assert got(sizes) == [(1, 2), (2, 2)]
    assert got(docs.select("doc_id", words.raw_tokens(F.col("text")).alias("t")))[:2] == [(1, ["plain", "words", "here"]), (2, ["cafe", "fine"])]
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "octet_length" in plan, plan
