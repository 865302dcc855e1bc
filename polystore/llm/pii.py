"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base spans (e-mail, IP address, payment card, international phone) are always reported; they carry
a score all the same. The other kinds (bank account by mod 97, national id, local phone, cards of 13
to 15 digits by Luhn, secrets such as tokens, keys and passwords) are reported when their score
reaches the threshold and they don't overlap a span that is already there. A secret is a long run of
letters and digits of high entropy, confirmed by a known prefix or a word like `token` before it, or
a shorter value behind such a word and `=` or `:`.

Null texts count as empty; positions are code points, ends exclusive; repeated rows are searched
each; other columns are ignored; an empty table gives an empty result. All searches take time in
proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from polystore.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "national_id", "short_card", "secret")
THRESHOLD = 0.5
BEFORE, AFTER = 48, 24  # code points in which words count as nearby
RAISE, LOWER = 0.35, 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![\w+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
DIGIT = re.compile(r"[0-9]")
#: Secrets: a long run by itself, one of a known make, and a value behind a word that names it.
RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
MADE = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}|sk[-_](?:live_)?[A-Za-z0-9]{20}|xox[abprs]-[0-9A-Za-z-]{10}|eyJ[A-Za-z0-9_-]{10}")
NAMED = re.compile(r"(?:api[_\x20-]?key|access[_\x20-]?key|token|password|passwd|pwd|secret|passwort|mot de passe|contraseña)[\"']?\x20?[=:]\x20?[\"']?([^\x20\x09-\x0D\"'<>,;]{8,}+)", re.IGNORECASE)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]{1,12} )?PRIVATE KEY-----")
ENTROPY = 3.0  # bits a character of a run

#: Words near a span that speak for and against its kind.
FOR = {
    "email": ("mail", "contact", "write to", "courriel", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "móvil", "appel", "anruf"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "tax id", "national id"),
    "secret": ("token", "secret", "passw", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "credential", "bearer", "auth", "mot de passe", "contraseña"),
}
FOR |= {"local_phone": FOR["phone"], "short_card": FOR["card"]}
AGAINST = ("order", "invoice", "isbn", "version", "serial", "tracking", "part no", "build")
#: What a kind scores by its pattern and checks alone.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.5, "local_phone": 0.3, "short_card": 0.4, "secret": 0.3}
MADE_RAISE = 0.4  # a secret of a known make


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it and a dotted domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m.groups()))]


def chains(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].replace(" ", "").replace("-", "")) for m in CHAIN.finditer(text)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


def accounts(text: str) -> list[tuple[int, int]]:
    """Of a proposed run, the longest beginning that ends at a gap (or at its end) and passes mod 97."""
    out = []
    for m in IBAN.finditer(text):
        ends = [m.end(), *(m.start() + i for i, c in enumerate(m[0]) if c == " ")]
        for end in sorted(ends, reverse=True):
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                out.append((m.start(), end))
                break
    return out


def entropy(run: str) -> float:
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def secrets(text: str) -> list[tuple[int, int]]:
    """Runs with letters and digits and of high entropy, key blocks, and values behind a word that names them; none overlap."""
    mixed = lambda x: DIGIT.search(x) and any(map(str.isalpha, x))
    out = [m.span() for m in KEY_BLOCK.finditer(text)]
    out += [m.span() for m in RUN.finditer(text) if mixed(m[0]) and entropy(m[0][:4096]) >= ENTROPY]
    out += [m.span(1) for m in NAMED.finditer(text) if mixed(m[1])]
    return covered(out)


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones, sorted."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]).lower()
    s = START[kind] + RAISE * any(w in near for w in FOR[kind]) - LOWER * any(w in near for w in AGAINST)
    if kind == "secret" and (MADE.match(text, start, end) or text.startswith("-----BEGIN", start)):
        s += MADE_RAISE
    return round(min(1.0, max(0.0, s)), 2)


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans, by kind and then start; base kinds first."""
    text = text or ""
    proposed: dict[str, list[tuple[int, int]]] = {"email": emails(text)} if "@" in text else {}
    if DIGIT.search(text):
        numbers = chains(text)
        proposed["ip"] = addresses(text)
        proposed["card"] = [(s, e) for s, e, d in numbers if 16 <= len(d) <= 19 and luhn(d)]
        proposed["phone"] = phones(text) if "+" in text else []
        proposed["iban"] = accounts(text)
        proposed["national_id"] = [m.span() for m in NATIONAL_ID.finditer(text) if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000"] if "-" in text else []
        proposed["local_phone"] = [m.span() for m in LOCAL_PHONE.finditer(text)] if numbers else []
        proposed["short_card"] = [(s, e) for s, e, d in numbers if 13 <= len(d) <= 15 and luhn(d)]
        proposed["secret"] = secrets(text)
    spans = [Span(k, s, e, score(k, text, s, e)) for k in BASE for s, e in proposed.get(k, ())]
    taken = covered([(x.start, x.end) for x in spans])
    for kind in ADDED:
        starts, own = [b for b, _ in taken], []
        for start, end in proposed.get(kind, ()):
            before = bisect_left(starts, end) - 1  # the last taken span that begins before this one ends
            if before >= 0 and taken[before][1] > start:
                continue
            s = score(kind, text, start, end)
            if s >= threshold:
                own.append(Span(kind, start, end, s))
        spans += own
        taken = covered(taken + [(x.start, x.end) for x in own]) if own else taken
    place = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(spans, key=lambda x: (place[x.kind], x.start))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, the digest of the base spans, all spans and their scores, the number of secrets, and whether it has a span."""

    def make():
        def work(rows):
            out = []
            for r in rows:
                spans = find(r["text"], threshold)
                base = [x for x in spans if x.kind in BASE]
                counts = [sum(x.kind == k for x in base) for k in BASE]
                added = Counter(x.kind for x in spans)
                out.append((r["doc_id"], *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{x.score:.2f}" for x in spans), added["secret"], len(spans) > 0))
            return out

        return work

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(picked, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_secret long, found boolean")
