"""Document queries: collections made of events, orders and parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.operators import documents as docs_
from polystore.operators.log import current
from polystore.plans.catalog import query
from polystore.tables import EVENT_LOG_SQL as LOG
from polystore.tables import event_log, table

K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _events(spark, d) -> DataFrame:
    """Bodies with a schema: the props are parsed once."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("doc_id"),
        F.struct(F.col("event_type").alias("type"), "user_id", F.from_json("props", "struct<k:bigint>").alias("props"), F.when(F.col("event_type") == "purchase", F.round("value", 4)).alias("paid")).alias("body"),
    )


def _variants(spark, d) -> DataFrame:
    """The same without a schema."""
    return _events(spark, d).select("doc_id", F.parse_json(F.to_json("body")).alias("body"))


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_type", " ").alias("words")).alias("body"))


def _tagged(spark, d) -> DataFrame:
    """A document a user, with sorted tags, without a schema."""
    tags = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_sort(F.collect_set("event_type")).alias("tags"))
    return tags.select("doc_id", F.parse_json(F.to_json(F.struct("tags"))).alias("body"))


TAGS = "WITH u AS (SELECT user_id AS doc_id, list_sort(list_distinct(list(event_type))) AS tags FROM events GROUP BY user_id)\n"


@query(f"SELECT event_id AS doc_id, {K} AS k, event_type AS type FROM events")
def doc_path(spark, d):
    return docs_.project(_events(spark, d), {"k": "props.k", "type": "type"})


@query(TAGS + "SELECT doc_id, '\"' || tags[1] || '\"' AS first_tag, '\"' || tags[-1] || '\"' AS last_tag FROM u")
def doc_path_array(spark, d):
    return docs_.project(_tagged(spark, d), {"first_tag": "tags.0", "last_tag": "tags.-1"})


@query(LOG + "SELECT user_id AS doc_id, arg_max(value, lsn) AS type, arg_max(k, lsn) AS k FROM log GROUP BY user_id")
def doc_insert(spark, d):
    rows = event_log(spark, d).select("lsn", F.col("user_id").alias("doc_id"), F.lit("SET").alias("op"), F.struct(F.col("value").alias("type"), "k").alias("body"))
    return docs_.project(current(rows, ["doc_id"], ["body"]), {"type": "type", "k": "k"})


@query(LOG + "SELECT user_id AS doc_id, arg_max(value, lsn) AS type, arg_max(k, lsn) AS k FROM log WHERE user_id = 5 GROUP BY user_id")
def doc_get(spark, d):
    rows = event_log(spark, d).where("user_id = 5").select("lsn", F.col("user_id").alias("doc_id"), F.lit("SET").alias("op"), F.struct(F.col("value").alias("type"), "k").alias("body"))
    return docs_.project(current(rows, ["doc_id"], ["body"]), {"type": "type", "k": "k"})


@query(
    LOG
    + """, last AS (SELECT user_id AS doc_id, arg_max(value, lsn) AS type, CAST(arg_max(k, lsn) AS VARCHAR) AS k FROM log GROUP BY user_id),
    paid AS (SELECT user_id AS doc_id, CAST(max(lsn) AS VARCHAR) AS at_lsn FROM log WHERE value = 'purchase' GROUP BY user_id)
    SELECT l.doc_id, CASE WHEN p.at_lsn IS NULL THEN l.type ELSE 'paid' END AS type, l.k, p.at_lsn AS purchase FROM last l LEFT JOIN paid p ON p.doc_id = l.doc_id"""
)
def doc_update(spark, d):
    log = event_log(spark, d).withColumn("doc_id", F.col("user_id"))
    bodies = log.select("lsn", "doc_id", F.lit("SET").alias("op"), F.create_map(F.lit("type"), F.col("value"), F.lit("k"), F.col("k").cast("string")).alias("body"))
    paid = log.where("value = 'purchase'").groupBy("doc_id").agg(F.create_map(F.lit("type"), F.lit("paid"), F.lit("purchase"), F.max("lsn").cast("string")).alias("body"))
    return docs_.project(docs_.merge(current(bodies, ["doc_id"], ["body"]), paid), {"type": "type", "k": "k", "purchase": "purchase"})


@query(LOG + "SELECT user_id AS doc_id, arg_max(k, lsn) AS k FROM log GROUP BY user_id HAVING arg_max(value, lsn) <> 'signup'")
def doc_delete(spark, d):
    """A signup deletes the user's document; what comes later inserts it again."""
    op = F.when(F.col("value") == "signup", "DEL").otherwise("SET")
    rows = event_log(spark, d).select("lsn", F.col("user_id").alias("doc_id"), op.alias("op"), F.struct("k").alias("body"))
    return docs_.project(current(rows, ["doc_id"], ["body"]), {"k": "k"})


@query("SELECT event_type AS collection, count(*) AS n FROM events GROUP BY event_type")
def doc_count(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("collection")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def doc_index_lookup(spark, d):
    parts = _parts(spark, d)
    first = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return docs_.project(docs_.lookup(parts, docs_.index(parts, "brand"), first), {"name": "name"})


@query(f"SELECT event_id AS doc_id FROM events WHERE event_type = 'purchase' AND {K} >= 50 AND user_id < 50")
def doc_filter_and(spark, d):
    return docs_.matches(_events(spark, d), {"type": "purchase", "props.k": {"$gte": 50}, "user_id": {"$lt": 50}}).select("doc_id")


@query(f"SELECT event_id AS doc_id FROM events WHERE {K} = 7")
def doc_eq(spark, d):
    return docs_.matches(_variants(spark, d), {"props.k": 7}).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE NOT (event_type = 'purchase' AND round(value, 4) = 0) AND event_type <> 'view'")
def doc_ne(spark, d):
    return docs_.matches(_events(spark, d), {"paid": {"$ne": 0.0}, "type": {"$ne": "view"}}).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE event_type = 'purchase' AND round(value, 4) > 20")
def doc_gt(spark, d):
    return docs_.matches(_events(spark, d), {"paid": {"$gt": 20}}).select("doc_id")


@query(f"SELECT event_id AS doc_id FROM events WHERE {K} >= 90")
def doc_gte(spark, d):
    return docs_.matches(_variants(spark, d), {"props.k": {"$gte": 90}}).select("doc_id")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_size < 10")
def doc_lt(spark, d):
    return docs_.matches(_parts(spark, d), {"size": {"$lt": 10}}).select("doc_id")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_retailprice <= 1000 AND p_brand <= 'Brand#3'")
def doc_lte(spark, d):
    return docs_.matches(_parts(spark, d), {"price": {"$lte": 1000}, "brand": {"$lte": "Brand#3"}}).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE event_type IN ('view', 'signup', 'none')")
def doc_in(spark, d):
    return docs_.matches(_events(spark, d), {"type": {"$in": ["view", "signup", "none"]}}).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE NOT (event_type = 'purchase' AND round(value, 4) IN (0, 1)) AND event_type NOT IN ('view', 'click')")
def doc_nin(spark, d):
    return docs_.matches(_events(spark, d), {"paid": {"$nin": [0.0, 1.0]}, "type": {"$nin": ["view", "click"]}}).select("doc_id")


@query(TAGS + "SELECT doc_id FROM u WHERE list_contains(tags, 'signup')")
def doc_contains_array(spark, d):
    return docs_.matches(_tagged(spark, d), {"tags": {"$contains": "signup"}}).select("doc_id")


@query("SELECT p_partkey AS doc_id FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'd b')")
def doc_contains_str(spark, d):
    parts = _parts(spark, d)
    return docs_.matches(parts, {"name": {"$contains": "ring"}}).union(docs_.matches(parts, {"name": {"$contains": "d b"}})).select("doc_id").distinct()


@query("SELECT p_partkey AS doc_id FROM part WHERE regexp_matches(p_name, '^(red|small) .*[lt]t?$')")
def doc_regex(spark, d):
    return docs_.matches(_parts(spark, d), {"name": {"$regex": "^(red|small) .*[lt]t?$"}}).select("doc_id")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_size * p_size % 7 = 2")
def doc_udf_filter(spark, d):
    @F.pandas_udf("boolean")
    def square_ends(size: pd.Series) -> pd.Series:
        return size * size % 7 == 2

    return docs_.find(_parts(spark, d), where=square_ends("body.size"), limit=None).select("doc_id")


def _positions(rows: DataFrame, *columns) -> DataFrame:
    """A page with its places: the rows are few, so one window over them is cheap."""
    from pyspark.sql.window import Window

    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*columns)).cast("bigint"))


def _page(spark, d, reverse: bool, limit: int, offset: int) -> DataFrame:
    events = _events(spark, d)
    rows = docs_.find(events, sort_by="paid", reverse=reverse, limit=limit, offset=offset)
    return _positions(rows, *docs_.ordered(events, "paid", reverse)).select("pos", "doc_id")


PAID = "CASE WHEN event_type = 'purchase' THEN round(value, 4) END"


@query(f"SELECT row_number() OVER (ORDER BY {PAID} ASC NULLS LAST, event_id) AS pos, event_id AS doc_id FROM events QUALIFY pos <= 200")
def doc_sort_asc(spark, d):
    return _page(spark, d, False, 200, 0)


@query(f"SELECT row_number() OVER (ORDER BY {PAID} DESC NULLS FIRST, event_id) AS pos, event_id AS doc_id FROM events QUALIFY pos <= 200")
def doc_sort_desc(spark, d):
    return _page(spark, d, True, 200, 0)


@query(f"SELECT row_number() OVER (ORDER BY {PAID} ASC NULLS LAST, event_id) - 30 AS pos, event_id AS doc_id FROM events QUALIFY pos BETWEEN 1 AND 25")
def doc_page(spark, d):
    return _page(spark, d, False, 25, 30)


@query(f"SELECT row_number() OVER (ORDER BY {K} DESC, event_id) - 5 AS pos, event_id AS doc_id, {K} AS k FROM events WHERE {K} >= 40 AND event_type <> 'error' QUALIFY pos BETWEEN 1 AND 50")
def doc_query(spark, d):
    events = _events(spark, d)
    rows = docs_.find(events, {"props.k": {"$gte": 40}, "type": {"$ne": "error"}}, sort_by="props.k", reverse=True, limit=50, offset=5)
    return _positions(rows, *docs_.ordered(events, "props.k", True)).select("pos", "doc_id", F.col("body.props.k").alias("k"))
