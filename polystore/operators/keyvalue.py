"""Strings, hashes, lists, sets, sorted sets and expiry over all keys at once.

Shapes: strings (key, value); hashes (key, field, value); lists (key, idx, value), where idx only
orders; sets (key, member); sorted sets (key, member, score); keys (key, type, expire_at).
Emptied keys don't exist; the type of a key is that of its last writer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.operators.log import latest

# strings


def since_last(log: DataFrame, ops: list[str]) -> DataFrame:
    """Rows of each key's last epoch: those after its last row whose op is in ops, and that row's op and value as base."""
    reset = latest(log.where(F.col("op").isin(*ops)), ["key"], ["lsn", "op", "value"])
    base = reset.select("key", F.col("lsn").alias("_since"), F.col("op").alias("base_op"), F.col("value").alias("base"))
    return log.where(~F.col("op").isin(*ops)).join(base, "key", "left").where(F.col("_since").isNull() | (F.col("lsn") > F.col("_since"))).drop("_since")


def set_if_absent(log: DataFrame) -> DataFrame:
    """Each SET applies only if the key has no value: the first one after the last deletion stays."""
    sets = since_last(log, ["DEL"])
    return sets.groupBy("key").agg(F.min_by("value", "lsn").alias("value"))


def set_if_present(sets: DataFrame, guarded: DataFrame) -> DataFrame:
    """sets create or overwrite; guarded ones only overwrite."""
    born = sets.groupBy("key").agg(F.min("lsn").alias("_born"))
    rows = guarded.join(born, "key").where("lsn > _born").select("key", "lsn", "value").unionByName(sets.select("key", "lsn", "value"))
    return latest(rows, ["key"], ["value"])


def counters(log: DataFrame) -> DataFrame:
    """SET, DEL and INCRBY (decrements are negative) with the amount in value: (key, value, error).

    A base that isn't a whole number gives a null value and error.
    """
    steps = since_last(log, ["SET", "DEL"]).groupBy("key").agg(F.sum(F.col("value").try_cast("bigint")).alias("_steps"))
    base = latest(log.where(F.col("op").isin("SET", "DEL")), ["key"], ["op", "value"]).select("key", F.col("op").alias("_op"), F.col("value").alias("_base"))
    both = base.join(steps, "key", "full_outer").where("_op IS NULL OR _op = 'SET' OR _steps IS NOT NULL")
    start = F.when(F.col("_op") == "SET", F.col("_base").try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return both.select("key", (start + F.coalesce("_steps", F.lit(0))).alias("value"), start.isNull().alias("error"))


def strings(log: DataFrame) -> DataFrame:
    """Any mix of SET, DEL, INCRBY and APPEND: (key, value).

    Only each key's last epoch is gathered, in order, and folded: the result of APPEND depends on it.
    """
    steps = since_last(log, ["SET", "DEL"]).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("lsn", "op", "value"))).alias("_steps")
    )
    base = latest(log.where(F.col("op").isin("SET", "DEL")), ["key"], ["op", "value"]).select("key", F.when(F.col("op") == "SET", F.col("value")).alias("_base"))
    both = base.join(steps, "key", "full_outer")

    def apply(state: Column, step: Column) -> Column:
        added = (F.coalesce(state, F.lit("0")).try_cast("bigint") + step["value"].try_cast("bigint")).cast("string")
        return F.when(step["op"] == "APPEND", F.concat(F.coalesce(state, F.lit("")), step["value"])).otherwise(added)

    folded = F.aggregate(F.coalesce("_steps", F.array().cast("array<struct<lsn:bigint,op:string,value:string>>")), F.col("_base"), apply)
    return both.select("key", folded.alias("value")).where("value IS NOT NULL")


def appended(log: DataFrame) -> DataFrame:
    """APPEND only: values in order."""
    ordered = F.array_sort(F.collect_list(F.struct("lsn", "value")))
    return log.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("value"))


def strlen(state: DataFrame) -> DataFrame:
    return state.select("key", F.coalesce(F.length("value"), F.lit(0)).cast("bigint").alias("length"))


def mget(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, key) in its order, null where a key is missing."""
    return wanted.join(state, "key", "left").select("pos", "key", "value")


# hashes


def hset(log: DataFrame) -> DataFrame:
    """(lsn, key, field, value) folded: last value by field, and how often the field was new (once)."""
    return log.groupBy("key", "field").agg(F.max_by("value", "lsn").alias("value"), F.min("lsn").alias("added_at"))


def hgetall(hashes: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return hashes.groupBy("key").agg(F.map_from_entries(entries).alias("entries"))


def hexists(hashes: DataFrame, field: str) -> DataFrame:
    """(key, found) of every key."""
    return hashes.groupBy("key").agg(F.bool_or(F.col("field") == field).alias("found"))


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count_distinct("field").alias("length"))


def hincrby(log: DataFrame) -> DataFrame:
    """(key, field, amount) folded: amounts add up whatever their order, from 0 where the field was absent."""
    return log.groupBy("key", "field").agg(F.sum("amount").alias("value"))


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """hdel, srem, zrem and del: rows without those named."""
    return rows.join(gone.select(*on).distinct(), on, "left_anti")


def only(rows: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(named.select(*on).distinct(), on, "left_semi")


# lists


def pushed(left: DataFrame, right: DataFrame) -> DataFrame:
    """LPUSH and RPUSH logs (lsn, key, value) as one list of each key: (key, idx, value)."""
    order = Window.partitionBy("key").orderBy("lsn")
    head = left.select("key", (-F.row_number().over(order)).cast("bigint").alias("idx"), "value")
    tail = right.select("key", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), "value")
    return head.unionByName(tail)


def placed(lists: DataFrame) -> DataFrame:
    """lists with pos (from 0) and n, the length."""
    own = Window.partitionBy("key")
    return lists.withColumns({"pos": (F.row_number().over(own.orderBy("idx")) - 1).cast("bigint"), "n": F.count("*").over(own)})


def span(start: int, stop: int) -> Column:
    """Whether pos lies in start..stop of n elements; negative numbers count from the end."""
    n, at = F.col("n"), F.col("pos")
    low = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    high = n + stop if stop < 0 else F.least(n - 1, F.lit(stop))
    return (at >= low) & (at <= high)


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    return placed(lists).where(span(start, stop)).select("key", "pos", "value")


ltrim = lrange


def lindex(lists: DataFrame, index: int) -> DataFrame:
    at = F.col("n") + index if index < 0 else F.lit(index)
    return placed(lists).where(F.col("pos") == at).select("key", "value")


def lset(lists: DataFrame, index: int, value: str) -> DataFrame:
    at = F.col("n") + index if index < 0 else F.lit(index)
    return placed(lists).select("key", "pos", F.when(F.col("pos") == at, F.lit(value)).otherwise(F.col("value")).alias("value"))


def popped(lists: DataFrame, left: int = 0, right: int = 0) -> tuple[DataFrame, DataFrame]:
    """(what the pops return, what they leave)."""
    rows = placed(lists)
    inside = (F.col("pos") >= left) & (F.col("pos") < F.col("n") - right)
    return rows.where(~inside).select("key", "pos", "value"), rows.where(inside).select("key", "pos", "value")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


# sets


def sadd(log: DataFrame) -> DataFrame:
    """(key, member) folded: each member once."""
    return log.select("key", "member").distinct()


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(*keys)).select("member").distinct()


def intersect(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all keys, by one grouped count."""
    found = sets.where(F.col("key").isin(*keys)).groupBy("member").agg(F.count_distinct("key").alias("_n"))
    return found.where(F.col("_n") == len(set(keys))).select("member")


def difference(sets: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """Members of first and of none of the rest, in one pass."""
    found = sets.where(F.col("key").isin(first, *rest)).groupBy("member").agg(
        F.bool_or(F.col("key") == first).alias("_in"), F.bool_or(F.col("key") != first).alias("_out")
    )
    return found.where("_in AND NOT _out").select("member")


# sorted sets


def zincrby(log: DataFrame) -> DataFrame:
    """(key, member, amount) folded: amounts add up to scores, from 0 where the member was absent."""
    return log.groupBy("key", "member").agg(F.sum("amount").alias("score"))


def ranked(zsets: DataFrame) -> DataFrame:
    """zsets with rank, from 0, by score and then member, and n."""
    own = Window.partitionBy("key")
    return zsets.withColumns({"rank": (F.row_number().over(own.orderBy("score", "member")) - 1).cast("bigint"), "n": F.count("*").over(own)})


def zrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    if start >= 0 and stop >= 0:  # a plain row_number filter lets the planner keep the first of each group before the shuffle
        order = Window.partitionBy("key").orderBy("score", "member")
        rows = zsets.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= stop + 1)
        return rows.where(F.col("_row") > start).select("key", (F.col("_row") - 1).cast("bigint").alias("rank"), "member", "score")
    return ranked(zsets).withColumn("pos", F.col("rank")).where(span(start, stop)).select("key", "rank", "member", "score")


# keyspace and expiry


def live(keys: DataFrame, as_of: Column) -> DataFrame:
    return keys.where(F.col("expire_at").isNull() | (F.col("expire_at") > as_of))


def expire(keys: DataFrame, seconds: Column, as_of: Column) -> DataFrame:
    """Sets expire_at of every key; negative seconds expire at once."""
    return keys.withColumn("expire_at", as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(seconds, F.lit(0)).cast("decimal(18,6)")))


def ttl(keys: DataFrame, as_of: Column) -> DataFrame:
    """-2 if expired, -1 without expiry, else whole seconds left."""
    left = F.floor(F.unix_micros(F.col("expire_at").cast("timestamp")) / 1e6 - F.unix_micros(as_of.cast("timestamp")) / 1e6).cast("bigint")
    return keys.select("key", F.when(F.col("expire_at").isNull(), -1).when(F.col("expire_at") <= as_of, -2).otherwise(left).cast("bigint").alias("ttl"))


def persist(keys: DataFrame) -> DataFrame:
    return keys.withColumn("expire_at", F.lit(None).cast(keys.schema["expire_at"].dataType))


def glob(pattern: str) -> str:
    """A shell pattern (*, ?, [seq], [!seq]) as an anchored regular expression."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close]
            negated = inner.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inner[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = close
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", c, flags=re.ASCII) if ord(c) < 128 else c)
        i += 1
    return "".join(out) + "$"


def keys_like(keys: DataFrame, pattern: str) -> DataFrame:
    return keys.where(F.col("key").rlike(glob(pattern)))
