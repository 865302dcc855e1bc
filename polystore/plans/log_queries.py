"""Change-log, run and transaction queries over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.operators import bloom
from polystore.operators import log as lg
from polystore.plans.catalog import query
from polystore.plans.keyvalue_queries import STATE
from polystore.sources import resp, runs
from polystore.tables import EVENT_LOG_SQL as LOG
from polystore.tables import event_log, table


def _log(spark, d) -> DataFrame:
    return event_log(spark, d).select("lsn", "key", "op", "value")


@query(STATE + "SELECT key, value FROM state WHERE key = 'user:3'")
def lsm_get(spark, d):
    return lg.current(lg.get(_log(spark, d), "user:3"))


@query(STATE + "SELECT key, value FROM state WHERE key BETWEEN 'user:1' AND 'user:5'")
def lsm_scan(spark, d):
    return lg.current(lg.scan(_log(spark, d), "user:1", "user:5"))


@query(STATE + "SELECT key, value FROM state WHERE key LIKE 'user:1%'")
def prefix_scan(spark, d):
    return lg.current(lg.prefix(_log(spark, d), "user:1"))


@query(STATE + "SELECT key, value FROM state WHERE key <> 'user:2' UNION ALL SELECT * FROM (VALUES ('user:2', 'put'), ('new:1', 'put')) AS t(key, value)")
def lsm_put(spark, d):
    put = spark.createDataFrame([(1 << 62, "user:2", "SET", "put"), (1 << 62, "new:1", "SET", "put")], "lsn bigint, key string, op string, value string")
    return lg.current(lg.append(_log(spark, d), put))


@query(STATE + "SELECT key, value FROM state WHERE key NOT IN ('user:2', 'user:4')")
def lsm_delete(spark, d):
    gone = spark.createDataFrame([(1 << 62, "user:2", "DEL", None), (1 << 62, "user:4", "DEL", None)], "lsn bigint, key string, op string, value string")
    return lg.current(lg.append(_log(spark, d), gone))


@query(LOG + ", cut AS (SELECT max(lsn) AS m FROM log) SELECT key, arg_max(value, lsn) AS value, arg_max(op, lsn) AS op, max(lsn) AS lsn FROM log, cut WHERE lsn > m / 2 GROUP BY key")
def lsm_flush(spark, d):
    log = _log(spark, d)
    half = log.agg(F.max("lsn") / 2).first()[0]
    path = runs.scratch(spark, "flush")
    runs.write_run(lg.latest(log.where(F.col("lsn") > half), ["key"], ["value", "op", "lsn"]), "key", path)
    return runs.read_run(spark, path)


@query(LOG + "SELECT key, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log GROUP BY key HAVING arg_max(op, lsn) <> 'DEL'")
def lsm_compact(spark, d):
    log = _log(spark, d)
    half = int(log.agg(F.max("lsn") / 2).first()[0] or 0)
    snapshot = lg.current(log.where(F.col("lsn") <= half), columns=["value", "lsn"])
    # keys that the older half deleted and the newer one left alone stay away: the snapshot has no row of them
    return lg.compact(snapshot, log, half)


@query(STATE + "SELECT key, value FROM state")
def wal_recover(spark, d):
    return lg.current(lg.valid_prefix(lg.frames(_log(spark, d), 1000)))


FRAMES = LOG + ", frames AS (SELECT lsn // 1000 AS segment, lsn, op, key, value FROM log)\n"


@query(FRAMES + "SELECT segment, lsn, op, key, value FROM frames")
def wal_append(spark, d):
    return lg.frames(_log(spark, d), 1000).where(F.col("crc") == lg.checksum("op", "lsn", "key", "value")).select("segment", "lsn", "op", "key", "value")


@query(FRAMES + ", bad AS (SELECT segment, min(lsn) AS b FROM frames WHERE lsn % 777 = 500 GROUP BY segment) SELECT f.segment, f.lsn FROM frames f LEFT JOIN bad ON bad.segment = f.segment WHERE b IS NULL OR f.lsn < b")
def wal_valid_prefix(spark, d):
    rows = lg.frames(_log(spark, d), 1000)
    broken = rows.withColumn("value", F.when(F.col("lsn") % 777 == 500, F.lit("garbage")).otherwise(F.col("value")))
    return lg.valid_prefix(broken).select("segment", "lsn")


@query(FRAMES + "SELECT segment, count(*) AS n FROM frames WHERE segment >= least(3, (SELECT max(segment) FROM frames)) GROUP BY segment")
def wal_purge(spark, d):
    return lg.purge(lg.frames(_log(spark, d), 1000), 3).groupBy("segment").agg(F.count("*").alias("n"))


_WRITTEN: dict[tuple[str, str], str] = {}


def _run(spark, d) -> DataFrame:
    """The orders as a sorted run, written once a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _WRITTEN:
        path = runs.scratch(spark, "orders")
        runs.write_run(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice")), "o_orderkey", path)
        _WRITTEN[at] = path
    return runs.read_run(spark, _WRITTEN[at])


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def sst_write_read(spark, d):
    return _run(spark, d)


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey = 100")
def sst_get(spark, d):
    return runs.get(_run(spark, d), "o_orderkey", 100)


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey BETWEEN 200 AND 900")
def sst_range_scan(spark, d):
    return runs.between(_run(spark, d), "o_orderkey", 200, 900)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi_join(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return bloom.semi_join(orders, keys, "o_custkey", keys.count())


@query("SELECT event_type, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def bench_percentiles(spark, d):
    p = F.percentile("value", [0.5, 0.95, 0.99])
    rows = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), p.alias("p"))
    return rows.select("event_type", "least", "mean", "most", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


# transactions: one for each user and day, committed if it holds a purchase


def _transactions(spark, d) -> tuple[DataFrame, DataFrame]:
    log = event_log(spark, d).withColumn("txn_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    outcomes = log.groupBy("txn_id").agg(F.when(F.bool_or(F.col("value") == "purchase"), "COMMIT").otherwise("ROLLBACK").alias("outcome"))
    return log.select("lsn", "txn_id", "key", "op", "value"), outcomes


TXN = LOG + ", t AS (SELECT *, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS txn_id FROM log), good AS (SELECT DISTINCT txn_id FROM t WHERE value = 'purchase')\n"


@query(TXN + "SELECT key, arg_max(value, lsn) AS value FROM t WHERE txn_id IN (SELECT txn_id FROM good) GROUP BY key HAVING arg_max(op, lsn) <> 'DEL'")
def txn_commit_replay(spark, d):
    return lg.current(lg.committed(*_transactions(spark, d)))


@query(TXN + "SELECT txn_id, count(*) AS n FROM t WHERE txn_id NOT IN (SELECT txn_id FROM good) GROUP BY txn_id")
def txn_rollback(spark, d):
    log, outcomes = _transactions(spark, d)
    return log.join(outcomes.where("outcome = 'ROLLBACK'"), "txn_id", "left_semi").groupBy("txn_id").agg(F.count("*").alias("n"))


@query(STATE + "SELECT key, CASE WHEN key = 'user:3' THEN 'mine' ELSE value END AS value FROM state WHERE key <> 'user:5' UNION ALL SELECT 'user:3', 'mine' WHERE NOT EXISTS (SELECT 1 FROM state WHERE key = 'user:3')")
def txn_read_your_writes(spark, d):
    mine = spark.createDataFrame([("user:3", "SET", "mine"), ("user:5", "DEL", None)], "key string, op string, value string")
    return lg.overlay(lg.current(_log(spark, d)), mine)


@query("SELECT event_type AS conn, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, 'SET ' || event_id || ' ' || event_type AS tokens FROM events")
def resp_parse(spark, d):
    """Every event as a SET command, cut into chunks of seven bytes, and parsed again."""
    sent = table(spark, d, "events").select(
        F.col("event_type").alias("conn"),
        "event_id",
        F.concat(F.lit("*3\r\n$3\r\nSET\r\n$"), F.length(F.col("event_id").cast("string")), F.lit("\r\n"), F.col("event_id"), F.lit("\r\n$"), F.length("event_type"), F.lit("\r\n"), F.col("event_type"), F.lit("\r\n")).alias("sent"),
    )
    cuts = F.sequence(F.lit(0), F.ceil(F.length("sent") / 7).cast("int") - 1)
    chunks = sent.select("conn", "event_id", "sent", F.explode(cuts).alias("i")).select("conn", (F.col("event_id") * 1000 + F.col("i")).alias("seq"), F.substring("sent", F.col("i") * 7 + 1, F.lit(7)).cast("binary").alias("chunk"))
    return resp.parse(chunks).select("conn", "n", F.array_join("tokens", " ").alias("tokens"))
