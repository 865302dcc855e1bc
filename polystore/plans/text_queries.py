"""Full-text queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystore.functions.words import STOP_WORDS, is_term, raw_tokens
from polystore.operators import fulltext as ft
from polystore.plans.catalog import query
from polystore.tables import table

ASKED = "tion thble thor"

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
#: Decomposed accents split words: each accented letter becomes its letter and a gap.
TOKENS = f"""WITH raw AS (
    SELECT doc_id, regexp_extract_all(strip_accents(regexp_replace(lower(coalesce(text, '')), '([áàâäãåéèêëíìîïóòôöõúùûüýÿñç])', '\\1 ', 'g')), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents
), tok AS (
    SELECT doc_id, term FROM (SELECT doc_id, unnest(words) AS term FROM raw) WHERE length(term) >= 2 AND term NOT IN ({_STOP})
), post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
st AS (SELECT count(*) AS total_docs, CAST(sum(length) AS BIGINT) AS total_terms FROM len)
"""


@query(TOKENS + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, min(term) AS first_term, max(term) AS last_term FROM tok GROUP BY doc_id")
def ft_tokenize(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.filter(raw_tokens(F.col("text")), is_term).alias("terms"))
    return docs.where(F.size("terms") > 0).select("doc_id", F.size("terms").cast("bigint").alias("n_tokens"), F.array_min("terms").alias("first_term"), F.array_max("terms").alias("last_term"))


@query()
def ft_stem_vocab(spark, d):
    return ft.vocabulary(table(spark, d, "documents"))


@query(TOKENS + "SELECT doc_id, term, tf FROM post")
def ft_postings(spark, d):
    return ft.postings(table(spark, d, "documents"))


@query(TOKENS + "SELECT doc_id, length FROM len")
def ft_doc_length(spark, d):
    return ft.lengths(table(spark, d, "documents"))


@query(TOKENS + ", kept AS (SELECT * FROM len WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT count(*) AS total_docs, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_terms FROM kept")
def ft_delete(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return ft.statistics(ft.lengths(table(spark, d, "documents").join(gone, "doc_id", "left_anti")))


@query(TOKENS + "SELECT total_docs, total_terms FROM st")
def ft_stats(spark, d):
    return ft.statistics(ft.lengths(table(spark, d, "documents")))


@query(TOKENS + "SELECT term, count(*) AS df FROM post GROUP BY term")
def ft_df(spark, d):
    return ft.document_frequency(ft.postings(table(spark, d, "documents")))


@query(
    TOKENS
    + """, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('tion', 'thble', 'thor') GROUP BY term),
    sc AS (SELECT p.doc_id, round(sum(ln(1 + (total_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (total_terms / total_docs)))), 4) AS score
        FROM post p JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY p.doc_id)
    SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM sc QUALIFY pos <= 20"""
)
def ft_bm25(spark, d):
    return ft.search(table(spark, d, "documents"), ASKED, 20)


@query()
def ft_bm25_stemmed(spark, d):
    return ft.search(table(spark, d, "documents"), "the things that nations ordered", 20, stemming=True)


@query()
def ft_snippet(spark, d):
    docs = table(spark, d, "documents")
    return ft.with_snippets(ft.search(docs, ASKED, 10), docs, ASKED)
