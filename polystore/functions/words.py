"""Words of texts: normal form, tokens and stems."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The stop words. Those with an apostrophe never meet a token, which has none.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between
both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's
i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on
once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've
this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've
your yours yourself yourselves
""".split()

#: Suffixes and what replaces them where the stem has a measure over 0; the first that fits counts.
REPLACED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
#: Suffixes that go where the stem has a measure over 1; the first that fits counts.
REMOVED = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

TOKEN = r"[\p{L}\p{N}_]+"


def _pattern(word: str) -> str:
    """c and v for the consonants and vowels of a word; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _pattern(word).count("vc")


def stem(word: str) -> str:
    """The word without common English endings."""
    word = word.lower()
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = next((e for e in ("ed", "ing") if word.endswith(e)), "")
        rest = word[: len(word) - len(ending)]
        if ending and "v" in _pattern(rest):
            word = rest
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":  # vowels too: "seeing" gives "se"
                word = word[:-1]
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    found = next((s for s in REPLACED if word.endswith(s)), None)
    if found and _measure(word[: -len(found)]) > 0:
        word = word[: -len(found)] + REPLACED[found]
    found = next((s for s in REMOVED if word.endswith(s)), None)
    if found and _measure(word[: -len(found)]) > 1:
        word = word[: -len(found)]
    return word


ROWS = 64  # texts that a worker holds as Python objects at once


@F.arrow_udf(StringType())
def decomposed(texts: pa.Array) -> pa.Array:
    """Compatibility decomposition, for which Spark has no function."""
    parts = [pa.array([t if t is None else unicodedata.normalize("NFKD", t) for t in texts.slice(at, ROWS).to_pylist()], pa.string()) for at in range(0, len(texts), ROWS)]
    return pa.concat_arrays(parts) if parts else texts


decomposed = decomposed.asNondeterministic()  # so that a filter on what comes of it doesn't run it again, in workers of its own


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def raw_tokens(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    other = F.when(F.octet_length(text) > F.char_length(text), text)  # ASCII texts stay as they are, and out of Python
    return F.regexp_extract_all(F.lower(F.coalesce(decomposed(other), text)), F.lit(TOKEN), F.lit(0))


def is_term(token: Column) -> Column:
    return (F.length(token) >= 2) & ~token.isin(*STOP_WORDS)


def normal_words(text: str) -> list[str]:
    return re.findall(r"\w+", (text if text.isascii() else unicodedata.normalize("NFKD", text)).lower())


class Terms:
    """The terms of texts, in a worker; stems are kept, a bounded number of them."""

    def __init__(self, stemming: bool):
        self.stemming, self.stop, self.stems = stemming, frozenset(STOP_WORDS), {}

    def of(self, text: str | None) -> list[str]:
        words = [w for w in normal_words(text or "") if len(w) >= 2 and w not in self.stop]
        if not self.stemming:
            return words
        if len(self.stems) > 200_000:
            self.stems.clear()
        return [self.stems.get(w) or self.stems.setdefault(w, stem(w)) for w in words]


def terms_of(text: str, stemming: bool = False) -> list[str]:
    """The terms of a query text, on the driver."""
    words = [w for w in normal_words(text) if len(w) >= 2 and w not in STOP_WORDS]
    return [stem(w) for w in words] if stemming else words
