"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table of the pre-tokens that the vocabulary itself holds as single
words, with their lengths in tokens; it has at most one entry for each piece of the vocabulary,
whatever the corpus. The second tier is a cache in each Python worker: a pre-token that the table
lacks is encoded once and remembered. Pre-tokens are never shuffled, and no pass over the corpus
comes first.

Counting by pre-token is exact because no piece of the vocabulary has a word start inside it or
holds a line feed, so that no merge crosses these cuts. A vocabulary of which this isn't true is
detected, and whole texts are encoded instead.

Null texts count as empty and have no tokens; repeated rows are counted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from polystore.llm.common import map_rows

MARK = "▁"  # how the library writes a space inside pieces
CACHE_ENTRIES = 300_000
LONG = 64  # longer pre-tokens aren't remembered
#: A segment is spaces and what follows them, or what follows a line feed directly.
SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def can_cut(processor) -> bool:
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and processor.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"


def frequent_lengths(processor) -> dict[str, int]:
    """The words that are pieces of the vocabulary, with the number of tokens each has."""
    words = [p[1:] for p in map(processor.id_to_piece, range(processor.get_piece_size())) if p[:1] == MARK and len(p) > 1 and MARK not in p[1:]]
    return {"": 1} | {w: len(ids) for w, ids in zip(words, processor.encode(words), strict=True)}  # "": a lone space


class Lengths(dict):
    """Tokens of a word after a space: the broadcast table, and what this worker has met besides."""

    def __init__(self, processor, frequent: dict[str, int]):
        super().__init__(frequent)
        self.processor, self.frequent = processor, frequent
        self.line_feed = len(processor.encode("\n"))

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(word))
        if len(word) <= LONG:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def segment(self, text: str) -> int:
        """Of spaces and a word, or of a word that no space precedes (after a line feed)."""
        if text[0] == " ":
            return self[text[1:]]
        key = "\n" + text
        n = self.get(key)
        if n is None:
            n = len(self.processor.encode(key)) - self.line_feed
            if len(text) <= LONG and len(self) < CACHE_ENTRIES:
                self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, first = 0, True
        for line in text.replace(MARK, " ").split("\n"):
            total += not first  # the line feed before it
            if first or line:
                words = (" " + line if first else line).split(" ")
                if "" in words[1:]:
                    total += sum(map(self.segment, SEGMENT.findall(" " + line if first else line)))
                else:
                    if words[0]:
                        total += self.segment(words[0])
                    total += sum(map(self.__getitem__, words[1:]))
            first = False
        return total


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; over_limit: more than limit tokens."""
    processor = load(model)
    cut = can_cut(processor)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(processor) if cut else {})

    def make():
        own = load(model)
        lengths = Lengths(own, frequent.value)
        count = lengths.count if cut else (lambda text: len(own.encode(text)))

        def work(rows):
            out = []
            for r in rows:
                text = r["text"] or ""
                n = count(text)
                out.append((r["doc_id"], len(text.encode()), n, n > limit))
            return out

        return work

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(picked, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
