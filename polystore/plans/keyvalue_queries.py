"""Key-value queries over events, orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystore.operators import keyvalue as kv
from polystore.operators.log import current, latest
from polystore.plans.catalog import query
from polystore.tables import EVENT_LOG_SQL as LOG
from polystore.tables import event_log, table

AS_OF = "2024-01-30 00:00:00"
TYPES = ("click", "error", "purchase", "signup", "view")


def _state(spark: SparkSession, d: str) -> DataFrame:
    return current(event_log(spark, d))


STATE = LOG + ", state AS (SELECT key, arg_max(value, lsn) AS value FROM log GROUP BY key HAVING arg_max(op, lsn) <> 'DEL')\n"


@query(STATE + "SELECT key, value FROM state")
def kv_set(spark, d):
    return _state(spark, d)


@query(
    LOG
    + """, gone AS (SELECT key, max(lsn) AS pos FROM log WHERE op = 'DEL' GROUP BY key)
    SELECT l.key, arg_min(l.value, l.lsn) AS value FROM log l LEFT JOIN gone g ON g.key = l.key
    WHERE l.op = 'SET' AND (g.pos IS NULL OR l.lsn > g.pos) GROUP BY l.key"""
)
def kv_set_nx(spark, d):
    return kv.set_if_absent(event_log(spark, d))


@query(
    LOG
    + """, born AS (SELECT key, min(lsn) AS pos FROM log WHERE value = 'signup' GROUP BY key),
    applied AS (SELECT l.key, l.value, l.lsn FROM log l JOIN born b ON b.key = l.key WHERE l.value = 'signup' OR (l.value = 'click' AND l.lsn > b.pos))
    SELECT key, arg_max(value, lsn) AS value FROM applied GROUP BY key"""
)
def kv_set_xx(spark, d):
    log = event_log(spark, d)
    return kv.set_if_present(log.where("value = 'signup'"), log.where("value = 'click'"))


@query(STATE + "SELECT key, value FROM state WHERE key = 'user:7'")
def kv_get(spark, d):
    return current(event_log(spark, d).where("key = 'user:7'"))


WANTED = "(VALUES (0, 'user:3'), (1, 'user:nobody'), (2, 'user:1'), (3, 'user:3')) AS w(pos, key)"


@query(STATE + f"SELECT CAST(w.pos AS BIGINT) AS pos, w.key, s.value FROM {WANTED} LEFT JOIN state s ON s.key = w.key")
def kv_mget(spark, d):
    wanted = spark.createDataFrame([(0, "user:3"), (1, "user:nobody"), (2, "user:1"), (3, "user:3")], "pos bigint, key string")
    return kv.mget(_state(spark, d), wanted)


@query(
    STATE
    + """SELECT key, value FROM state WHERE key NOT IN ('user:1', 'batch:1')
    UNION ALL SELECT * FROM (VALUES ('user:1', 'x'), ('batch:1', 'y')) AS t(key, value)"""
)
def kv_mset(spark, d):
    log = event_log(spark, d).select("lsn", "key", "op", "value")
    many = spark.createDataFrame([(1 << 62, "user:1", "SET", "x"), (1 << 62, "batch:1", "SET", "y")], "lsn bigint, key string, op string, value string")
    return current(log.unionByName(many))


COUNTS = (
    LOG
    + """, reset AS (SELECT key, max(lsn) AS pos FROM log WHERE value IN ('signup', 'error') GROUP BY key),
    base AS (SELECT l.key, l.pos, r.k, r.op FROM reset l JOIN log r ON r.key = l.key AND r.lsn = l.pos),
    steps AS (SELECT l.key, sum(l.k) AS s FROM log l LEFT JOIN base b ON b.key = l.key WHERE l.value NOT IN ('signup', 'error') AND (b.pos IS NULL OR l.lsn > b.pos) GROUP BY l.key)
    SELECT coalesce(b.key, s.key) AS key, CAST(CASE WHEN b.op = 'SET' THEN b.k ELSE 0 END {sign} coalesce(s.s, 0) AS BIGINT) AS value
    FROM base b FULL JOIN steps s ON s.key = b.key WHERE b.key IS NULL OR b.op = 'SET' OR s.key IS NOT NULL"""
)


def _counting(spark, d, sign: int) -> DataFrame:
    log = event_log(spark, d)
    op = F.when(F.col("value") == "signup", "SET").when(F.col("value") == "error", "DEL").otherwise("INCRBY")
    amount = F.when(F.col("value") == "signup", F.col("k")).otherwise(sign * F.col("k"))
    return kv.counters(log.select("lsn", "key", op.alias("op"), amount.cast("string").alias("value"))).select("key", "value")


@query(COUNTS.replace("{sign}", "+"))
def kv_incrby(spark, d):
    return _counting(spark, d, 1)


@query(COUNTS.replace("{sign}", "-"))
def kv_decrby(spark, d):
    return _counting(spark, d, -1)


@query(LOG + "SELECT key, string_agg(left(value, 1), '' ORDER BY lsn) AS value FROM log GROUP BY key")
def kv_append(spark, d):
    return kv.appended(event_log(spark, d).select("lsn", "key", F.left("value", F.lit(1)).alias("value")))


@query(STATE + "SELECT key, length(value) AS length FROM state")
def kv_strlen(spark, d):
    return kv.strlen(_state(spark, d))


# hashes: key = user, field = event type, value = the last value


def _hash_log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.round("value", 6).alias("value"))


HASH = "WITH h AS (SELECT user_id AS key, event_type AS field, arg_max(round(value, 6), event_id) AS value, min(event_id) AS added_at FROM events GROUP BY user_id, event_type)\n"


def _hashes(spark, d) -> DataFrame:
    return kv.hset(_hash_log(spark, d))


@query(HASH + "SELECT key, field, value, added_at FROM h")
def kv_hset(spark, d):
    return _hashes(spark, d)


@query(HASH + "SELECT key, value FROM h WHERE field = 'purchase'")
def kv_hget(spark, d):
    return kv.hset(_hash_log(spark, d).where("field = 'purchase'")).select("key", "value")


@query(HASH + "SELECT key, field, value FROM h WHERE NOT (field = 'error' AND key % 2 = 0)")
def kv_hdel(spark, d):
    rows = _hashes(spark, d).select("key", "field", "value")
    return kv.without(rows, rows.where("field = 'error' AND key % 2 = 0"), ["key", "field"])


@query(HASH + "SELECT key, string_agg(field || '=' || CAST(added_at AS VARCHAR), ';' ORDER BY field) AS entries FROM h GROUP BY key")
def kv_hgetall(spark, d):
    rows = _hashes(spark, d).select("key", "field", F.col("added_at").cast("string").alias("value"))
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return kv.hgetall(rows).select("key", F.array_join(pairs, ";").alias("entries"))


@query(HASH + "SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM h GROUP BY key")
def kv_hkeys(spark, d):
    return kv.hgetall(_hashes(spark, d)).select("key", F.array_join(F.map_keys("entries"), ",").alias("fields"))


@query(HASH + "SELECT key, string_agg(CAST(added_at AS VARCHAR), ',' ORDER BY field) AS vals FROM h GROUP BY key")
def kv_hvals(spark, d):
    rows = _hashes(spark, d).select("key", "field", F.col("added_at").cast("string").alias("value"))
    return kv.hgetall(rows).select("key", F.array_join(F.map_values("entries"), ",").alias("vals"))


@query("SELECT user_id AS key, bool_or(event_type = 'signup') AS found FROM events GROUP BY user_id")
def kv_hexists(spark, d):
    return kv.hexists(_hashes(spark, d), "signup")


@query(HASH + "SELECT key, count(*) AS length FROM h GROUP BY key")
def kv_hlen(spark, d):
    return kv.hlen(_hash_log(spark, d))


@query(LOG + "SELECT user_id AS key, value AS field, CAST(sum(k) AS BIGINT) AS value FROM log GROUP BY user_id, value")
def kv_hincrby(spark, d):
    return kv.hincrby(event_log(spark, d).select(F.col("user_id").alias("key"), F.col("value").alias("field"), F.col("k").alias("amount")))


# lists: key = user; views are pushed left, the rest right


def _pushes(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("value"), "event_type")
    return kv.pushed(rows.where("event_type = 'view'"), rows.where("event_type <> 'view'"))


def _right(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("value"))
    return kv.pushed(rows.limit(0), rows)


LIST = """WITH l AS (SELECT user_id AS key, CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


@query(
    """WITH p AS (SELECT user_id AS key, CAST(event_id AS VARCHAR) AS value, event_type = 'view' AS head,
        row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS r FROM events)
    SELECT key, value, CASE WHEN head THEN -r ELSE r - 1 END AS idx FROM p"""
)
def kv_lpush(spark, d):
    return _pushes(spark, d)


@query(LIST + "SELECT key, pos AS idx, value FROM l")
def kv_rpush(spark, d):
    return _right(spark, d)


@query(LIST + 'SELECT key, "pos", value FROM l WHERE pos < 2')
def kv_lpop(spark, d):
    return kv.popped(_right(spark, d), left=2)[0]


@query(LIST + 'SELECT key, "pos", value FROM l WHERE pos < n - 1')
def kv_rpop(spark, d):
    return kv.popped(_right(spark, d), right=1)[1]


@query(LIST + 'SELECT key, "pos", value FROM l WHERE pos >= greatest(0, n - 5) AND pos <= n - 2')
def kv_lrange(spark, d):
    return kv.lrange(_right(spark, d), -5, -2)


@query("SELECT user_id AS key, count(*) AS length FROM events GROUP BY user_id")
def kv_llen(spark, d):
    return kv.llen(table(spark, d, "events").select(F.col("user_id").alias("key")))


@query(LIST + "SELECT key, value FROM l WHERE pos = n - 3")
def kv_lindex(spark, d):
    return kv.lindex(_right(spark, d), -3)


@query(LIST + """SELECT key, "pos", CASE WHEN pos = 1 THEN 'changed' ELSE value END AS value FROM l""")
def kv_lset(spark, d):
    return kv.lset(_right(spark, d), 1, "changed")


@query(LIST + 'SELECT key, "pos", value FROM l WHERE pos >= 2 AND pos <= least(n - 1, 10)')
def kv_ltrim(spark, d):
    return kv.ltrim(_right(spark, d), 2, 10)


# sets: key = order priority, member = customer


def _sets(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"))


def _priorities(spark, d) -> list[str]:
    """The distinct priorities: a fixed, small set of values."""
    return [r[0] for r in _sets(spark, d).select("key").distinct().orderBy("key").limit(5).collect()]


SETS = """WITH s AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders),
k AS (SELECT key, row_number() OVER (ORDER BY key) AS i FROM (SELECT DISTINCT key FROM s))
"""


@query(SETS + "SELECT key, member FROM s")
def kv_sadd(spark, d):
    return kv.sadd(_sets(spark, d))


@query(SETS + "SELECT key, member FROM s WHERE member % 3 <> 0")
def kv_srem(spark, d):
    rows = _sets(spark, d).distinct()
    return kv.without(rows, table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("member")), ["member"])


@query(SETS + "SELECT member FROM s JOIN k USING (key) WHERE i = 1")
def kv_smembers(spark, d):
    return kv.union(_sets(spark, d), _priorities(spark, d)[:1])


@query("SELECT c_custkey AS member, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def kv_sismember(spark, d):
    there = _sets(spark, d).select("member").distinct().withColumn("_in", F.lit(True))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("member")).join(there, "member", "left").select("member", F.coalesce("_in", F.lit(False)).alias("found"))


@query(SETS + "SELECT key, count(*) AS length FROM s GROUP BY key")
def kv_scard(spark, d):
    return _sets(spark, d).groupBy("key").agg(F.count_distinct("member").alias("length"))


@query(SETS + "SELECT DISTINCT member FROM s JOIN k USING (key) WHERE i <= 2")
def kv_sunion(spark, d):
    return kv.union(_sets(spark, d), _priorities(spark, d)[:2])


@query(SETS + "SELECT member FROM s JOIN k USING (key) WHERE i = 1 INTERSECT SELECT member FROM s JOIN k USING (key) WHERE i = 2 INTERSECT SELECT member FROM s JOIN k USING (key) WHERE i = 3")
def kv_sinter(spark, d):
    return kv.intersect(_sets(spark, d), _priorities(spark, d)[:3])


@query(SETS + "SELECT member FROM s JOIN k USING (key) WHERE i = 1 EXCEPT SELECT member FROM s JOIN k USING (key) WHERE i IN (2, 3)")
def kv_sdiff(spark, d):
    first, *rest = _priorities(spark, d)[:3]
    return kv.difference(_sets(spark, d), first, rest)


# sorted sets: key = brand, member = part, score = quantity sold


def _zsets(spark, d) -> DataFrame:
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("key"))
    return sold.join(brands, "member").select("key", "member", "score")


ZSETS = """WITH z AS (SELECT p_brand AS key, l_partkey AS member, round(sum(l_quantity), 2) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM z)
"""


@query("SELECT l_suppkey AS key, l_partkey AS member, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY l_suppkey, l_partkey")
def kv_zadd(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member"), F.col("l_quantity").alias("score"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("bigint")).alias("lsn"))  # lines may share a number
    return latest(rows, ["key", "member"], ["score"])


@query(ZSETS + "SELECT key, member, score FROM z WHERE member NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def kv_zrem(spark, d):
    return kv.without(_zsets(spark, d), table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("member")), ["member"]).select("key", "member", "score")


@query(ZSETS + "SELECT key, score FROM z WHERE member = 42")
def kv_zscore(spark, d):
    return _zsets(spark, d).where("member = 42").select("key", "score")


@query("SELECT p_brand AS key, l_partkey AS member, round(sum(l_quantity), 2) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_partkey")
def kv_zincrby(spark, d):
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("key"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("member"), F.col("l_quantity").alias("amount"))
    return kv.zincrby(sold.join(brands, "member")).select("key", "member", F.round("score", 2).alias("score"))


@query(ZSETS + "SELECT key, member, rank FROM r")
def kv_zrank(spark, d):
    return kv.ranked(_zsets(spark, d)).select("key", "member", "rank")


@query(ZSETS + "SELECT key, rank, member FROM r WHERE rank <= 4")
def kv_zrange(spark, d):
    return kv.zrange(_zsets(spark, d), 0, 4).select("key", "rank", "member")


@query(ZSETS + "SELECT key, rank, member, score FROM r WHERE rank >= greatest(0, n - 3)")
def kv_zrange_withscores(spark, d):
    return kv.zrange(_zsets(spark, d), -3, -1)


@query(ZSETS + "SELECT key, count(*) AS length FROM z GROUP BY key")
def kv_zcard(spark, d):
    return _zsets(spark, d).groupBy("key").agg(F.count("*").alias("length"))


# keyspace: the last event of a user is the key's last write; it lives for k hours


def _keys(spark, d) -> DataFrame:
    last = latest(event_log(spark, d), ["key"], ["ts", "value", "k"])
    as_written = F.col("ts")
    return kv.expire(last.withColumnRenamed("value", "type"), F.col("k") * 3600, as_written).withColumn("expire_at", F.when(F.col("type") == "purchase", F.lit(None)).otherwise(F.col("expire_at")))


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


KEYS = (
    LOG
    + f""", last AS (SELECT key, arg_max(ts, lsn) AS ts, arg_max(value, lsn) AS type, arg_max(k, lsn) AS k FROM log GROUP BY key),
keys AS (SELECT key, type, ts, CASE WHEN type = 'purchase' THEN NULL ELSE ts + to_hours(CAST(k AS INTEGER)) END AS expire_at FROM last),
live AS (SELECT * FROM keys WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{AS_OF}')
"""
)


@query(KEYS + "SELECT key, type, expire_at FROM live")
def kv_live_keys(spark, d):
    return kv.live(_keys(spark, d), _as_of()).select("key", "type", "expire_at")


@query(KEYS + "SELECT key, expire_at FROM keys")
def kv_expire(spark, d):
    return _keys(spark, d).select("key", "expire_at")


@query(KEYS + f"SELECT key, CASE WHEN expire_at IS NULL THEN -1 WHEN expire_at <= TIMESTAMP '{AS_OF}' THEN -2 ELSE CAST(floor(epoch(expire_at) - epoch(TIMESTAMP '{AS_OF}')) AS BIGINT) END AS ttl FROM keys")
def kv_ttl(spark, d):
    return kv.ttl(_keys(spark, d), _as_of())


@query(KEYS + "SELECT key, type, CAST(NULL AS TIMESTAMP) AS expire_at FROM live")
def kv_persist(spark, d):
    return kv.persist(kv.live(_keys(spark, d), _as_of())).select("key", "type", "expire_at")


NAMES = "('user:1'), ('user:2'), ('user:2'), ('user:nobody')"


@query(KEYS + f"SELECT count(*) AS n FROM (VALUES {NAMES}) AS w(key) JOIN live USING (key)")
def kv_exists(spark, d):
    wanted = spark.createDataFrame([("user:1",), ("user:2",), ("user:2",), ("user:nobody",)], "key string")
    return wanted.join(kv.live(_keys(spark, d), _as_of()), "key").agg(F.count("*").alias("n"))


@query(KEYS + f"SELECT w.key, coalesce(live.type, 'none') AS type FROM (SELECT DISTINCT key FROM (VALUES {NAMES}) AS v(key)) w LEFT JOIN live ON live.key = w.key")
def kv_type(spark, d):
    wanted = spark.createDataFrame([("user:1",), ("user:2",), ("user:nobody",)], "key string")
    return wanted.join(kv.live(_keys(spark, d), _as_of()).select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


@query(KEYS + "SELECT key, type FROM live WHERE key NOT IN ('user:1', 'user:2', 'user:3')")
def kv_del(spark, d):
    gone = spark.createDataFrame([("user:1",), ("user:2",), ("user:3",)], "key string")
    return kv.without(kv.live(_keys(spark, d), _as_of()).select("key", "type"), gone, ["key"])


@query("SELECT c_name AS key FROM customer WHERE c_name GLOB 'Customer#*1?' OR c_name GLOB '[!C]*'")
def kv_keys_glob(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_name").alias("key"))
    return keys.where(F.col("key").rlike(kv.glob("Customer#*1?")) | F.col("key").rlike(kv.glob("[!C]*")))


@query(KEYS + "SELECT count(*) AS n FROM live")
def kv_dbsize(spark, d):
    return kv.live(_keys(spark, d), _as_of()).agg(F.count("*").alias("n"))
