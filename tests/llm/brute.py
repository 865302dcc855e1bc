"""Plain versions of the corpus operators, to hold results against."""

import re
import unicodedata
from collections import Counter

from polystore.llm import quality_rules  # for its lists of words alone

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, words string, p double, hash bigint, at int, n int, size int, place int, chunk int"


def hard_rows():
    """Nulls, empty and long texts, ties, repeats, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 997}" for i in range(20000))
    near = " ".join(f"near{i}" for i in range(60))
    texts = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
        (2, "one two three four five six seven eight nine ten eleven twelve", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \n\t \n", "b"),
        (6, long, "hot"),
        (7, near + "\n" + near, "hot"),
        (8, near.replace("near30", "other"), "hot"),
        (8, near.replace("near30", "other"), "hot"),
        (None, "no id here but words enough for a line that counts", "hot"),
        (10, "Ärger über ﬁne 日本語 😀 text x▁y a\u0000b", "c"),
        (11, "x", "hot"),
        (12, "mail a.b@c.de or +1 (212) 555-0100, ip 10.0.0.1, card 4111 1111 1111 1111", "hot"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "k", "w", 0.5, 1, 2, 3, 4, 5, 6) for i, t, s in texts]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def within_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def removed_lines(rows):
    """{(doc_id, text): {line number: near}} of distinct (doc_id, text) rows."""
    docs = sorted({(r[0] if r[0] is not None else -(1 << 63), r[0], r[1] or "") for r in rows}, key=lambda x: (x[0], x[2]))
    lines = sorted(((order, k, line, i, t) for order, i, t in docs for k, line in enumerate(t.split("\n")) if len(words(line)) >= 3), key=lambda x: (x[0], x[1]))
    first, out = {}, {}
    for order, k, line, i, t in lines:
        w = words(line)
        if line in first and first[line] < (order, k):
            out.setdefault((i, t), {})[k] = False
        elif line not in first:
            near = len(w) >= 5 and any(len(words(x)) >= 5 and at < (order, k) and within_one_edit(w, words(x)) for x, at in first.items())
            if near:
                out.setdefault((i, t), {})[k] = True
        first.setdefault(line, (order, k))
    return out


def components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def repeat_words(w, k=8):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({i + j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(k)})


def _is(kinds, c):
    return unicodedata.category(c)[0] in kinds


def bad_line(line):
    """The rules of a line, in plain words."""
    w = words(line)
    visible = [c for c in line if c != " "]
    letters = [c for c in visible if _is("L", c)]
    marks = [c for c in visible if not _is("LN", c) and c not in "_ \t\n\v\f\r"]
    gaps = line.count(" ") + 1
    if len(letters) < 0.5 * len(visible):
        return True
    if len(visible) >= 20 and (len(marks) > 0.25 * len(visible) or line.count("|") > max(2, 0.15 * gaps)):
        return True
    if len(visible) >= 20 and len([r for r in re.findall(r"!+|[?]+", line) if len(r) > 1]) > 0.3 * gaps:
        return True
    strip = lambda x: x.strip(" \t\v\f\r\n")
    entries = [strip(x) for x in re.split(r"[|»›>/·•-]|[ \t\n\v\f\r][ \t\n\v\f\r]+", strip(line))]
    if entries[0].lower() in quality_rules.ENTRIES and all(len(x) <= 30 and all(_is("LN", c) or c in "_ \t" for c in x) for x in entries[1:]):
        return True
    if len(w) > 5 and sum(x == y for x, y in zip(w, w[1:])) > 0.5 * len(w):
        return True
    return any(p in line.lower() for p in quality_rules.PHRASES)


def cleaned(text):
    """The text without bad lines, or None if the rules reject it."""
    w = words(text)
    if len(w) < 20 or 100 * repeat_words(w) > 30 * len(w):
        return None
    lines = text.split("\n")
    good = [x for x in lines if not words(x) or not bad_line(x)]
    lost = len(w) - sum(len(words(x)) for x in good)
    return "\n".join(good) if 100 * lost <= 50 * len(w) else None


def alike(x, y, k=5):
    """Whether the sets of k-word shingles have a Jaccard similarity of 0.8."""
    sets = []
    for t in (x, y):
        w = [a.lower() if a.isascii() else "".join(c.lower() if c.isascii() else c for c in a) for a in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return sets[0] == sets[1] or 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])
