"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only.

A term (a lower-cased run of non-white-space, by its 64-bit hash) is in the lexicon if its inverse
document frequency lies in a band: it occurs in at least two documents, and in between LEAST and
MOST of all. The lexicon can't outgrow (mean distinct terms of a document) / LEAST entries, however
many documents there are, because each entry takes up LEAST of all documents' terms; it goes into
the plan as a literal hash table. A fingerprint is a list of signatures: each is the hash of the
document's sorted distinct lexicon terms within one random subset of the lexicon. Subsets of
several rates (1/2 to 1/512) let short and long documents alike share some signatures after an
edit. Where fewer than one in FEW of a document's terms are in the band, as in a large group of near
copies, whose terms are all too frequent, all its terms take the band's place, so that these texts
have as many signatures as any others. The first signature is of the whole band, so that texts
always have one. Likeness is the share of signatures that are equal, of those that
either has.

The next document is found by dealing the rows into ranges of ids with the first rows of the next
range as guests, and a window within each range: texts are shuffled once, no task sees more than
its ranges, and a range's limits are quantiles of the ids.

Null texts are empty; a null doc_id comes first; rows alike in doc_id follow each other by text;
repeated rows are rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.llm.common import text_or_empty

LEAST, MOST = 1 / 400, 1 / 10  # of all documents
#: (bits, subsets): a subset of so many bits holds 1 / 2**bits of the lexicon.
SUBSETS = ((1, 2), (3, 4), (5, 8), (7, 12), (9, 6))
FEW = 10
MOST_ENTRIES = 1 << 21  # of the lexicon, as it stands in the plan
RANGE_ROWS, MOST_RANGES = 64, 8192
SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Sorted distinct hashes of the terms."""
    hashed = F.transform(F.split(F.lower(text), SPACE), lambda t: F.xxhash64(t))
    return F.array_sort(F.array_distinct(F.array_remove(hashed, F.xxhash64(F.lit("")))))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> list[int]:
    """Hashes of the terms in the band."""
    n = docs.count()
    low, high = max(2, math.ceil(least * n)), most * n
    counted = docs.select(F.explode(terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    found = counted.where((F.col("n") >= low) & (F.col("n") <= max(high, low))).select("term").limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"over {MOST_ENTRIES} terms in the band: documents are so long that `least` must be larger")
    return sorted(r[0] for r in found)


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)  # folded to a literal once a query


def _table(words: list[int]) -> tuple[Column, int]:
    """The lexicon as a hash table: an array of slots, each with its few entries."""
    slots = 1 << max(1, len(words)).bit_length()
    out: list[list[int]] = [[] for _ in range(slots)]
    for w in words:
        out[w % slots].append(w)
    return _literal(out, "array<array<bigint>>"), slots


def _subset(k: int) -> tuple[int, int, int]:
    """(shift, mask, value) of the k-th subset; each rate reads bits of its own."""
    shift = 4
    for bits, many in SUBSETS:
        if k < many:
            return shift, (1 << bits) - 1, k
        k, shift = k - many, shift + bits
    raise IndexError(k)


def _within(shift: int, mask: int, value: int):
    return lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(mask)) == F.lit(value)


N_SUBSETS = sum(many for _, many in SUBSETS)


def with_signatures(rows: DataFrame, text: Column, words: list[int], to: str) -> DataFrame:
    """rows with the signatures of text in the column named by to."""
    table, slots = _table(words)
    own, band = f"_{to}_terms", f"_{to}_band"
    rows = rows.withColumn(own, terms(text))
    rows = rows.withColumn(band, F.filter(own, lambda h: F.array_contains(F.get(table, F.pmod(h, F.lit(slots)).cast("int")), h)))
    few = F.size(band) * FEW < F.size(own)
    rows = rows.withColumn(band, F.when(few | (F.size(band) == 0), F.struct(F.lit("all").alias("of"), F.col(own).alias("terms"))).otherwise(F.struct(F.lit("band").alias("of"), F.col(band).alias("terms"))))
    band_terms = F.col(f"{band}.terms")
    signatures = [F.xxhash64(f"{band}.of", band_terms)]
    for k in range(N_SUBSETS):
        shift, mask, value = _subset(k)
        signatures.append(F.xxhash64(F.filter(band_terms, _within(shift, mask, value))))
    nothing = F.xxhash64(F.array().cast("array<bigint>"))
    raw = f"_{to}_raw"
    rows = rows.withColumn(raw, F.array(*signatures))
    return rows.withColumn(to, F.transform(raw, lambda x: F.nullif(x, nothing))).drop(own, band, raw)


def _text_of(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), ":")


def likeness(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    there = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    return total(same).cast("double") / total(there)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc_id, text and more) with next_<column>: that of the next row by doc_id, the first after the last."""
    found = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    ranges = max(1, min(MOST_RANGES, found["n"] // RANGE_ROWS))
    limits: list[int] = []
    if found["ids"]:
        parts = [i / ranges for i in range(1, ranges)] or [0.5]
        limits = sorted({found["least"], *rows.agg(F.percentile_approx("doc_id", parts, 10 * ranges)).first()[0]})
    bounds, steps = _literal(limits, "array<bigint>"), [1 << k for k in range(len(limits).bit_length() - 1, -1, -1)]
    # the last limit that is at most the id, by halving
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), lambda low, step: F.when(F.get(bounds, low + step) <= F.col("doc_id"), low + step).otherwise(low))
    last = max(0, len(limits) - 1)
    first_id = found["least"] if found["ids"] == found["n"] else None
    rows = rows.withColumn("_range", F.greatest(at, F.lit(0)))
    begins = (F.col("_range") > 0) & (F.get(bounds, F.col("_range")) == F.col("doc_id"))
    place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    none = F.array().cast("array<struct<range:int,guest:int>>")
    seats = F.concat(
        F.array(place(F.col("_range"), 0)),
        F.when(begins, F.array(place(F.col("_range") - 1, 1))).otherwise(none),
        F.when(F.col("doc_id").eqNullSafe(F.lit(first_id).cast("long")), F.array(place(F.lit(last), 2))).otherwise(none),
    )
    dealt = rows.withColumn("_seat", F.explode(seats)).withColumns({"_range": F.col("_seat.range"), "_guest": F.col("_seat.guest")}).drop("_seat")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_guest = 0").drop("_range", "_guest")


def fingerprint_documents(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    words = lexicon(rows, least, most)
    own = with_signatures(rows, F.col("text"), words, "own")
    paired = with_next(own, ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    paired = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    paired = with_signatures(paired, F.col("edited"), words, "other")
    return paired.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        _text_of("own").alias("fingerprint"),
        _text_of("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
