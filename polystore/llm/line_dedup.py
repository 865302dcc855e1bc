"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an equal line, or one within an edit of a single word (a word replaced,
inserted or left out), comes earlier by (doc_id, line number). Lines of fewer than MIN_WORDS words
are never removed; lines of fewer than NEAR_WORDS words only if an equal line comes earlier.

Each distinct line emits its deletion variants as hashed keys: the line without its i-th word, for
every i, and the line itself. Two lines are within one edit only if a variant of one equals a
variant of the other: both without word i (replaced), or one without word i and the other whole
(inserted). Equal variants are met by grouping and a join on the grouped least line, never pairwise,
and the words of the met lines are compared before one is removed. Keys of all variants of a line
come from running combinations (exclusive or) of 64-bit position hashes over its words.

Only lines that can have a partner emit variants: an edit of one word leaves either the first or
the last HALF words as they are (FEW words of lines of up to 2 * HALF words), so both lines share one
of these hashes; and it leaves all of a line but one quarter as it is. Neither test loses a pair. Texts of lines leave their task only if a
bitmap of fixed size says they may be wanted.

Words are runs of non-white-space, lines end at line feeds. Null texts have one empty line; a null
doc_id comes first; rows equal in doc_id and text are one document, so they don't remove each
other's lines; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polystore.llm.common import cut, key_filter, maybe_in, text_or_empty

MIN_WORDS, NEAR_WORDS = 3, 5  # one word of five is a likeness of 0.8
HALF, FEW = 5, 2  # words that stand for half of a long line, and of a short one
SPACES = " \t\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def _spaced(line: Column) -> Column:
    """The line with one space between its words and none around them."""
    plain = ~(F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")))
    for c in SPACES[1:]:
        plain = plain & ~F.contains(line, F.lit(c))
    return F.when(plain, line).otherwise(F.btrim(F.regexp_replace(line, SPACE, " ")))


def _at_least(spaced: Column, n: int) -> Column:
    """Whether it has n words."""
    return F.substring_index(spaced, " ", n - 1) != spaced


def _order(doc_id: Column, at: Column) -> Column:
    """Where a line stands, as one number."""
    first = F.coalesce(doc_id, F.lit(-(1 << 63)))
    return (first.cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(12,0)") + at).cast("decimal(38,0)")


def _exploded(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def line_table(docs: DataFrame) -> DataFrame:
    """Every line with words: (doc_id, text_hash, at, h1, h2, halves); halves: hashes of its ends, null if it has too few words for an edit."""
    spaced = F.col("spaced")
    rows = _hashed(_exploded(docs)).withColumn("spaced", _spaced(F.col("line")))
    ends = lambda n: [F.xxhash64(F.lit(2 * n), F.substring_index(spaced, " ", n)), F.xxhash64(F.lit(2 * n + 1), F.substring_index(spaced, " ", -n))]
    long, short = _at_least(spaced, 2 * HALF), ~_at_least(spaced, 2 * HALF + 1)  # lines of 2 * HALF words meet both kinds
    halves = F.when(long & short, F.array(*ends(HALF), *ends(FEW))).when(long, F.array(*ends(HALF))).when(_at_least(spaced, NEAR_WORDS), F.array(*ends(FEW)))
    return rows.where(_at_least(spaced, MIN_WORDS)).select("doc_id", "text_hash", "at", "h1", "h2", halves.alias("halves"))


def _parts(lines: DataFrame) -> DataFrame:
    """(place, part) of each line (place, line): hashes of its words without one quarter.

    Of two lines within one edit, of n words and of n or n + 1, all quarters of n but one are equal,
    counted from the front before it and from the back after it.
    """
    words, n = F.col("words"), F.size("words")
    parts = []
    for more in (0, 1):
        short = n - more
        for j in range(4):
            low, high = F.floor(short * j / 4).cast("int"), F.floor(short * (j + 1) / 4).cast("int")
            parts.append(F.xxhash64(F.lit(j), short, F.slice(words, F.lit(1), low), F.slice(words, high + more + 1, n - high - more)))
    return lines.select("place", F.split("line", " ").alias("words")).select("place", F.explode(F.array(*parts)).alias("part"))


def _variants(lines: DataFrame) -> DataFrame:
    """(place, i, key) of each line (place, line): the variant without word i (i = -1: whole); a key tells the words left and their number."""
    sums = F.aggregate(
        F.transform("words", lambda w, k: F.struct(F.xxhash64(w, k).alias("stay"), F.xxhash64(w, k - 1).alias("move"))),
        F.expr("named_struct('stay', 0L, 'move', 0L, 'before', CAST(array() AS ARRAY<BIGINT>), 'through', CAST(array() AS ARRAY<BIGINT>))"),
        lambda s, x: F.struct(
            s["stay"].bitwiseXOR(x["stay"]).alias("stay"),
            s["move"].bitwiseXOR(x["move"]).alias("move"),
            F.concat(s["before"], F.array(s["stay"])).alias("before"),
            F.concat(s["through"], F.array(s["move"].bitwiseXOR(x["move"]))).alias("through"),
        ),
    )
    each = lines.select("place", F.split("line", " ").alias("words")).select("place", F.size("words").alias("n"), sums.alias("sums"))
    each = each.select("place", "n", F.col("sums.stay").alias("stay"), F.col("sums.move").alias("move"), F.posexplode(F.arrays_zip("sums.before", "sums.through")).alias("i", "x"))
    gone = F.xxhash64(F.col("n") - 1, F.col("x.before").bitwiseXOR(F.col("move")).bitwiseXOR(F.col("x.through")))
    both = F.array(F.struct("i", gone.alias("key")), F.struct(F.lit(-1).alias("i"), F.xxhash64("n", "stay").alias("key")))
    return each.select("place", F.inline(F.when(F.col("i") == F.col("n") - 1, both).otherwise(F.array(F.struct("i", gone.alias("key"))))))


def _within_one_edit(a: str, b: str) -> Column:
    """Whether two lists of words differ by at most one word replaced, inserted or left out."""
    differs = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x != y)
    first = F.array_position(differs, F.lit(True)).cast("int")
    rest = lambda x, at: F.slice(x, at, F.greatest(F.lit(0), F.size(x) - at + 1))
    gap = F.size(a) - F.size(b)
    return (
        F.when(first == 0, F.abs(gap) <= 1)
        .when(gap == 0, rest(a, first + 1) == rest(b, first + 1))
        .when(gap == 1, rest(a, first + 1) == rest(b, first))
        .when(gap == -1, rest(a, first) == rest(b, first + 1))
        .otherwise(F.lit(False))
    )


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines that an earlier line within one edit precedes."""
    halves = distinct.where("halves IS NOT NULL").select("h1", "place", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.count("*").alias("times")).where("times > 1").select("half")
    able = cut(halves.join(met, "half", "left_semi").select("h1", "place").distinct())
    # only lines that may be among those leave the scan
    text = _hashed(_exploded(docs)).where(F.length("line") >= 2 * NEAR_WORDS - 1).select("doc_id", "at", "h1", "line")
    text = maybe_in(text, F.col("h1"), key_filter(able.select(F.col("h1").alias("key"))))
    text = text.select("h1", _order(F.col("doc_id"), F.col("at")).alias("place"), "line")
    lines = cut(text.join(able, ["h1", "place"], "left_semi").dropDuplicates(["place", "h1"]).select("place", _spaced(F.col("line")).alias("line")))
    parts = cut(_parts(lines))
    met = parts.groupBy("part").agg(F.count("*").alias("times")).where("times > 1").select("part")
    lines = cut(lines.join(parts.join(met, "part", "left_semi").select("place").distinct(), "place", "left_semi"))
    variants = cut(_variants(lines))
    deleted = variants.where("i >= 0")
    same = deleted.groupBy("key", "i").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    both = (
        variants.groupBy("key")
        .agg(F.min(F.when(F.col("i") < 0, F.col("place"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("place"))).alias("gone"))
        .where("whole IS NOT NULL AND gone IS NOT NULL")
    )
    replaced = deleted.join(same.select("key", "i", "first"), ["key", "i"]).select("place", "first")
    inserted = variants.join(both, "key").select("place", F.when(F.col("i") < 0, F.col("gone")).otherwise(F.col("whole")).alias("first"))
    met = replaced.union(inserted).where("first < place").distinct()
    own, other = lines.select("place", F.col("line").alias("own")), lines.select(F.col("place").alias("first"), F.col("line").alias("other"))
    pairs = met.join(own, "place").join(other, "first").withColumns({"own": F.split("own", " "), "other": F.split("other", " ")})
    return pairs.where(_within_one_edit("own", "other")).select("place").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, near): the lines to remove; near: an equal line doesn't precede it, one within an edit does."""
    table = cut(line_table(docs))
    place = _order(F.col("doc_id"), F.col("at"))
    distinct = cut(table.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("halves").alias("halves")))
    near = near_lines(docs, distinct).withColumn("_near", F.lit(True))
    firsts = distinct.select("h1", "h2", "place").join(near, "place", "left").select("h1", "h2", F.col("place").alias("first"), F.coalesce("_near", F.lit(False)).alias("near"))
    rows = table.select("doc_id", "text_hash", "at", "h1", "h2").join(firsts, ["h1", "h2"])
    return rows.where((place > F.col("first")) | F.col("near")).select("doc_id", "text_hash", "at", (place == F.col("first")).alias("near")).distinct()


def _by_document(docs: DataFrame, parts: list[Column]) -> DataFrame:
    """parts of each document, with `gone`: sorted struct(at, near) of the lines to remove."""
    removed = removed_lines(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct("at", "near"))).alias("gone"))
    rows = docs.select(*parts, F.col("doc_id").alias("_own_id"), F.xxhash64(text_or_empty()).alias("_own_hash"))
    return rows.join(removed, (F.col("_own_hash") == F.col("_hash")) & F.col("_own_id").eqNullSafe(F.col("_id")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<at:int,near:boolean>>")))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, removed) of each row; removed: the numbers of the removed lines, from 0."""
    rows = _by_document(docs, [F.col("doc_id"), F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines")])
    near = F.size(F.filter("gone", lambda x: x["near"])).cast("long")
    return rows.select("doc_id", "n_lines", (F.size("gone") - near).cast("long").alias("n_exact"), near.alias("n_near"), F.array_join(F.transform("gone", lambda x: x["at"].cast("string")), ",").alias("removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns, without the lines to remove; those left without a word go, n_chars follows the text."""
    names = docs.columns
    rows = _by_document(docs, [F.col(n) for n in names])
    at = F.transform("gone", lambda x: x["at"])
    kept = F.filter(F.split(text_or_empty(), "\n", -1), lambda line, k: ~F.array_contains(at, k))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("text", text).where((F.size("gone") == 0) | (F.btrim(F.col("text"), F.lit(SPACES + "\n")) != ""))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.size("gone") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*names)


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos, ls[p] AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS g(p)
), cut AS (
    SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM lines
), known AS (
    SELECT *, len(w) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS turn FROM cut WHERE len(w) >= 3
), firsts AS (
    SELECT line, doc_id, pos, w, n FROM known WHERE turn = 1 AND n >= 5
), ends AS (
    SELECT *, unnest(list_concat(
        CASE WHEN n >= 10 THEN [['long head', array_to_string(w[1:5], ' ')], ['long tail', array_to_string(w[n-4:n], ' ')]] ELSE [] END,
        CASE WHEN n <= 10 THEN [['head', array_to_string(w[1:2], ' ')], ['tail', array_to_string(w[n-1:n], ' ')]] ELSE [] END)) AS half FROM firsts
), pairs AS (
    SELECT a.line, a.w AS a, b.w AS b FROM ends a JOIN ends b ON a.half = b.half AND (b.doc_id, b.pos) < (a.doc_id, a.pos) AND abs(a.n - b.n) <= 1
), placed AS (
    SELECT line, a, b, coalesce(list_position(list_transform(generate_series(1, least(len(a), len(b))), lambda i: a[i] <> b[i]), true), 0) AS p FROM pairs
), near AS (
    SELECT DISTINCT line FROM placed
    WHERE p = 0 OR (len(a) = len(b) AND a[p+1:] = b[p+1:]) OR (len(a) = len(b) + 1 AND a[p+1:] = b[p:]) OR (len(a) + 1 = len(b) AND a[p:] = b[p+1:])
), removed AS (
    SELECT doc_id, pos, turn = 1 AS is_near FROM known LEFT JOIN near USING (line) WHERE turn > 1 OR near.line IS NOT NULL
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(count(r.pos) FILTER (NOT r.is_near) AS BIGINT) AS n_exact, CAST(count(r.pos) FILTER (r.is_near) AS BIGINT) AS n_near,
       coalesce(string_agg(CAST(r.pos AS VARCHAR), ',' ORDER BY r.pos), '') AS removed
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""
