"""Every registered query against its SQL, on the small tables."""

import math
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from polystore.functions.words import STOP_WORDS, stem

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value if isinstance(value, (bool, int, float, str)) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_against_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def plain_terms(text, stemming=False):
    words = re.findall(r"\w+", unicodedata.normalize("NFKD", text or "").lower())
    words = [w for w in words if len(w) > 1 and w not in STOP_WORDS]
    return [stem(w) for w in words] if stemming else words


def plain_search(docs, query, top, stemming):
    counted = {i: Counter(plain_terms(t, stemming)) for i, t in docs}
    sizes = {i: sum(c.values()) for i, c in counted.items() if c}
    average = sum(sizes.values()) / len(sizes)
    scores = Counter()
    for term in plain_terms(query, stemming):
        df = sum(term in c for c in counted.values())
        for i, c in counted.items():
            if c[term]:
                scores[i] += math.log(1 + (len(sizes) - df + 0.5) / (df + 0.5)) * c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * sizes[i] / average))
    best = sorted(((round(x, 4), i) for i, x in scores.items()), key=lambda p: (-p[0], p[1]))[:top]
    return [(k + 1, i, x) for k, (x, i) in enumerate(best)]


def plain_snippet(text, query, length=160):
    words = set(re.findall(r"\w+", query.lower()))
    begins = [m.start() for m in re.finditer(r"\w+", text.lower())]
    held = [sum(w in text.lower()[b : b + length] for w in words) for b in begins]
    best = begins[held.index(max(held))] if held and max(held) else 0
    start = max(0, best - 20)
    part = text[start : start + length].strip()
    marked = re.sub("|".join(sorted(map(re.escape, words), key=len, reverse=True)), r"<b>\g<0></b>", part, flags=re.IGNORECASE)
    return "..." * (start > 0) + marked + "..." * (start + length < len(text))


def test_text_queries_without_sql(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    vocabulary = {w for _, t in docs for w in plain_terms(t)}
    assert rows(["term", "stem"], [(r["term"], r["stem"]) for r in QUERIES["ft_stem_vocab"](spark, small).collect()]) == rows(["term", "stem"], [(w, stem(w)) for w in vocabulary])
    stemmed = QUERIES["ft_bm25_stemmed"](spark, small).collect()
    assert [(r["pos"], r["doc_id"], r["score"]) for r in sorted(stemmed, key=lambda r: r["pos"])] == plain_search(docs, "the things that nations ordered", 20, True)
    shown = {r["doc_id"]: r["snippet"] for r in QUERIES["ft_snippet"](spark, small).collect()}
    best = plain_search(docs, "tion thble thor", 10, False)
    assert shown == {i: plain_snippet(dict(docs)[i], "tion thble thor") for _, i, _ in best}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_of_oracles():
    assert set(ORACLES) <= set(QUERIES)
