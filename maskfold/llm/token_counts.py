"""Token counts by byte-pair merging, without token ids.

A text's symbols are its characters.  A heap holds the adjacent pairs that a piece of the vocabulary joins, best
rank first (ties: the leftmost); the symbols are a linked list.  Popping a pair merges it and pushes its
two new neighbours.  The count is the initial symbols minus the merges; a character that no piece holds can't
merge and counts its UTF-8 bytes (byte fallback).

The rules of the text model are read from the vocabulary file: spaces become U+2581, and one goes
before any text that isn't empty.  No piece has a U+2581 after another character (checked when the file is
read), so no merge crosses such a place and a text is the sum of its words; each Python worker keeps the
counts of the last words it met, at most ``CACHE_WORDS`` of at most ``CACHE_LENGTH`` characters,
which changes its speed and nothing else.  Longer runs are merged whole.

Nothing is shuffled; a task holds one Arrow batch.  Edge cases: a null or empty text has 0 tokens; texts
are counted whole, however long; strings of special tokens inside a text are ordinary text;
null and repeated ids keep a row each; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, functions as F

from .common import text_of

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")  # "\n" is a word only if no piece holds it
CACHE_WORDS, CACHE_LENGTH = 400_000, 48


def merge_count(word: str, ranks: dict[str, int]) -> int:
    """How many merges byte-pair encoding makes in a word."""
    n = len(word)
    symbols = list(word)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    if not heap:
        return 0
    heapify(heap)
    right, left, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        rank, i = heappop(heap)
        a, j = symbols[i], right[i]
        if not a or j >= n:
            continue
        joined = a + symbols[j]
        if ranks.get(joined) != rank:  # one of the two has grown since this pair was pushed
            continue
        merges += 1
        symbols[i], symbols[j] = joined, ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(joined + symbols[k])) is not None:
                heappush(heap, (r, i))
        h = left[i]
        if h >= 0 and (r := ranks.get(symbols[h] + joined)) is not None:
            heappush(heap, (r, h))
    return merges


class WordCounts(dict):
    """Token counts of words, made when first asked for."""

    def __init__(self, ranks: dict[str, int], alphabet: set[str]):
        super().__init__()
        self.ranks, self.alphabet = ranks, alphabet

    def __missing__(self, word: str) -> int:
        unknown = [c for c in word if c not in self.alphabet]
        n = len(word) - merge_count(word, self.ranks)
        if unknown:
            n += sum(len(c.encode()) - 1 for c in unknown)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, WORDS.findall(SPACE + text.replace(" ", SPACE))))


def read_vocabulary(model_file: str) -> tuple[dict[str, int], set[str]]:
    """(rank of every piece that a merge can make, equal for equal scores; the characters that are pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in ids}
    place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    if any(SPACE in p.lstrip(SPACE) for p in score) or any("\n" in p for p in score):
        raise ValueError(f"{model_file}: a piece crosses the end of a word")
    if model.normalize("  a éﬁ ") != f"{SPACE * 3}a{SPACE}éﬁ{SPACE}":
        raise ValueError(f"{model_file}: its text normalisation is not the one built here")
    return {p: place[s] for p, s in score.items() if len(p) > 1}, {p for p in score if len(p) == 1}


@cache
def counts_of(model_file: str) -> WordCounts:
    """One per Python worker: its words serve the following tasks too."""
    return WordCounts(*read_vocabulary(model_file))


def token_count(model_file: str, text_col: str = "text") -> Column:
    """The number of tokens of a text as a Column."""
    @F.arrow_udf("long")
    def count(texts):
        import pyarrow as pa

        return pa.array(map(counts_of(model_file).text, texts.to_pylist()), pa.int64())

    return count(text_of(text_col))
