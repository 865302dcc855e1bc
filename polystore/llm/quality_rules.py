"""Line-first quality rules.

Base statistics decide first: a text of too few words, or of which too large a part lies in
repeated 8-word windows, fails. Then each line is judged on its own by rules of punctuation,
navigation, boilerplate and stuttering; failing lines are removed, and a text that loses more than
a fixed part of its words is rejected. No rule takes more than time in proportion to the line.

A null text has no words and so fails the base; blank lines are neither judged nor removed;
repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.llm.common import map_rows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50  # of the words, by removed lines
MIX = np.uint64(0x9E3779B97F4A7C15)
BLANKS = " \t\v\f\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Punctuation: a line made of marks rather than words, one that shouts, or a list of cells.
NO_LETTER = re.compile(r"[\W\d_]")
MARKS = re.compile(r"[^\w\x20\x09-\x0D]")
SHOUT = re.compile(r"!!+|\?\?+")
#: Navigation: what menus, breadcrumbs and pagers begin with, and what stands between their short entries.
ENTRIES = (
    "home", "menu", "search", "next", "previous", "prev", "back", "login", "log in", "sign in", "sign up", "register", "share", "tweet", "print", "close",
    "skip to content", "skip to main content", "read more", "more", "top", "contact", "contact us", "about", "about us", "faq", "sitemap", "site map", "help",
    "startseite", "menü", "suche", "weiter", "zurück", "anmelden", "kontakt", "impressum", "über uns", "hilfe",
    "accueil", "rechercher", "suivant", "précédent", "connexion", "plan du site", "aide",
    "inicio", "buscar", "siguiente", "anterior", "iniciar sesión", "contacto", "ayuda",
)
BETWEEN = re.compile(r"[|»›>/·•-]|[\x20\x09-\x0D]{2,}")
LONGEST_ENTRY = 30
#: Boilerplate: phrases of cookie notes, rights notes and script warnings, in lower case.
PHRASES = (
    "all rights reserved", "copyright (c)", "copyright ©", "copyright 19", "copyright 20", "cookie policy", "cookies policy", "cookie notice", "cookie settings", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "requires javascript", "require javascript", "javascript is disabled", "subscribe to our newsletter", "click here to", "lorem ipsum", "powered by ",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
)
MIN_LETTERS, MAX_MARKS, MAX_SEPARATORS, MAX_SHOUTS = 0.5, 0.25, 0.15, 0.3
MAX_STUTTER = 0.5  # of a line's words, equal to the word before


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in windows of 8 words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    mixed = number.astype(np.uint64) * MIX
    for k in (1, 2, 4):  # equal windows have equal sums, so without two equal sums there is none
        mixed = (mixed[: len(mixed) - k] ^ (mixed[: len(mixed) - k] >> np.uint64(31))) * MIX + mixed[k:]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    key = number[:n].copy()  # number of the window that starts here, exact: renumbered after each word
    for k in (1, 2, 4):  # windows of 2, 4, 8 words from two halves
        m = len(number) - k
        _, number = np.unique(number[:m] * (len(number) + 1) + number[k:], return_inverse=True)
    key = number
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def navigation(line: str) -> bool:
    """Whether it is an entry of a menu, alone or before other short entries."""
    line = line.strip(BLANKS)
    if not line[:20].lower().startswith(ENTRIES):
        return False
    first, *more = BETWEEN.split(line)
    if first.strip(BLANKS).lower() not in ENTRIES:
        return False
    return all(len(x) <= LONGEST_ENTRY and not MARKS.search(x) for x in (m.strip(BLANKS) for m in more))


def bad_line(line: str, phrases: bool = True) -> bool:
    """Whether the rules reject a line that has words, in time in proportion to it; phrases: it may hold some."""
    visible = len(line) - line.count(" ")
    if len(line) - len(NO_LETTER.findall(line)) < MIN_LETTERS * visible:
        return True
    if visible >= 20:
        words = line.count(" ") + 1
        if len(MARKS.findall(line)) > MAX_MARKS * visible or line.count("|") > MAX_SEPARATORS * words and line.count("|") > 2:
            return True
        if len(SHOUT.findall(line)) > MAX_SHOUTS * words:
            return True
    if navigation(line):
        return True
    w = line.encode().split()
    if len(w) > 5 and sum(map(eq, w, w[1:])) > MAX_STUTTER * len(w):
        return True
    return phrases and holds_phrase(line)


def holds_phrase(text: str) -> bool:
    low = text.lower()
    return any(p in low for p in PHRASES)


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed, text without bad lines)."""
    text = text or ""
    words = text.encode().split()  # by ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS + "\n"))
    lines = text.split("\n")
    full = [line.strip(BLANKS) != "" for line in lines]
    with_words = [line for line, f in zip(lines, full, strict=True) if f]
    dup = len(with_words) - len(set(with_words))
    repeated = repeat_words(words)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words
    phrases = holds_phrase(text)
    bad = [f and bad_line(line, phrases) for line, f in zip(lines, full, strict=True)]
    lost = sum(len(line.encode().split()) for line, b in zip(lines, bad, strict=True) if b)
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * n_words
    clean = "\n".join(line for line, b in zip(lines, bad, strict=True) if not b) if any(bad) else text
    return n_words, word_chars, len(SYMBOLS.findall(text)), dup, repeated, failed, kept, sum(bad), clean


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its statistics, the verdict, the number of removed lines and the words left."""

    def make():
        def work(rows):
            out = []
            for r in rows:
                *stats, removed, clean = judge(r["text"])
                out.append((r["doc_id"], *stats, removed, len(clean.encode().split())))
            return out

        return work

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(
        picked, make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, n_clean_words long",
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without the lines they reject, with all their columns; n_chars follows the text."""
    names = docs.columns

    def make():
        def work(rows):
            out = []
            for r in rows:
                verdict = judge(r["text"])
                if verdict[6]:
                    out.append(tuple(verdict[8] if c == "text" else len(verdict[8]) if c == "n_chars" else r[c] for c in names))
            return out

        return work

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def _listed(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


#: The same rules in SQL.
ORACLE = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), windows AS (
    SELECT rid, p, array_to_string(ws[p : p + 7], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 7)) AS g(p)
), twice AS (
    SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), repeated AS (
    SELECT rid, count(DISTINCT p + j) AS n FROM twice, unnest(generate_series(0, 7)) AS g(j) GROUP BY rid
), cut AS (
    SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), full_lines AS (
    SELECT rid, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw, length(replace(line, ' ', '')) AS visible,
           length(line) - length(replace(line, ' ', '')) + 1 AS gaps, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
    FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), entries AS (
    SELECT *, list_transform(string_split_regex(bare, '[|»›>/·•-]|[\x20\x09-\x0D]{{2,}}'), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS es FROM full_lines
), judged AS (
    SELECT rid, line, len(lw) AS n,
           length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) < {MIN_LETTERS} * visible
           OR visible >= 20 AND (
               length(regexp_replace(line, '[\p{{L}}\p{{N}}_\x20\x09-\x0D]', '', 'g')) > {MAX_MARKS} * visible
               OR length(line) - length(replace(line, '|', '')) > greatest({MAX_SEPARATORS} * gaps, 2)
               OR len(regexp_extract_all(line, '!!+|\?\?+')) > {MAX_SHOUTS} * gaps)
           OR lower(es[1]) IN ({_listed(ENTRIES)}) AND len(list_filter(es[2:], lambda x: length(x) > {LONGEST_ENTRY} OR regexp_matches(x, '[^\p{{L}}\p{{N}}_\x20\x09-\x0D]'))) = 0
           OR len(lw) > 5 AND len(list_filter(list_zip(lw[1 : len(lw) - 1], lw[2:]), lambda x: x[1] = x[2])) > {MAX_STUTTER} * len(lw)
           OR len(list_filter([{_listed(PHRASES)}], lambda x: contains(lower(line), x))) > 0 AS bad
    FROM entries
), lines AS (
    SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (bad), 0) AS lost FROM judged GROUP BY rid
), stats AS (
    SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup, 0) AS dup, coalesce(r.n, 0) AS repeated, coalesce(removed, 0) AS removed, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN repeated r USING (rid) LEFT JOIN lines USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(repeated AS BIGINT) AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * repeated > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * repeated > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * n_words AS kept,
       CAST(removed AS BIGINT) AS n_removed_lines, CAST(n_words - lost AS BIGINT) AS n_clean_words
FROM stats
"""
