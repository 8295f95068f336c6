"""Hierarchical multi-length packing of token sequences.

Each Spark task packs the documents of its input partition as they stream by, so
nothing is shuffled and a lost task is simply packed again:

* a document is its token ids and a closing id; every full window of it is a sequence
  of its own, and the rest is routed to the smallest context-size tier that holds it;
* from the longest tier down, a window takes the longest waiting rest of its tier, and
  its gap is filled from shorter tiers: whole rests by best fit first, then the head of one
  that is cut to the gap;
* what can't fill a window waits for the next documents; at the end of a task the last
  tokens become windows of power-of-two lengths.  So no sequence needs padding;
* the written windows of one tier are dealt to step groups of equal token counts (``balance``): windows
  are counted by task and tier, and the counts before a task give its first window's number, so that one group per
  tier at most is short, whatever the number of tasks.

A task holds at most about ``flush_tokens`` tokens and one document at a time.

Edge cases: a null text counts as empty and an empty one is its closing id alone; null
and repeated ids are packed as they come (each row is a document); very long texts are cut
into full windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from functools import cache

from pyspark.sql import DataFrame, Window, functions as F

from .common import text_of

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, tier int, task int, in_tier long")
LATIN = re.compile("[\\x00-\u024f]*")


class TextIds:
    """Token ids (little-endian unsigned 32-bit) of whole texts.

    ``ranks_file`` is the tokenizer's vocabulary for a faster encoder of the same byte-pair merges, which
    gets the texts of Latin letters alone; there both cut words alike.  All others, and those that may hold a
    special token, go to the tokenizer itself."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.fast = Tokenizer.from_file(tokenizer_file), None
        if ranks_file:
            import base64

            import tiktoken
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def documents(self, texts: list[str]) -> list[bytes]:
        from array import array
        out: list = [None] * len(texts)
        if self.fast is not None:
            out = [self.fast(t).astype("<u4", copy=False).tobytes() if LATIN.fullmatch(t) and "<|" not in t else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out


@cache
def text_ids(*files) -> TextIds:
    """One per Python worker: it serves the following tasks too."""
    return TextIds(*files)


class Packer:
    """Packs (document, ids) pairs; ``take()`` yields finished (tier, pieces)."""

    def __init__(self, window: int = 1024, tiers: int = 3, flush_tokens: int = 1 << 20):
        self.window, self.flush_tokens = window, flush_tokens
        self.tiers = [window >> k for k in range(tiers)]
        self.pools: dict[int, list] = {t: [] for t in self.tiers}  # (length, order, document, start)
        self.waiting, self.order, self.done = 0, 0, []

    def put(self, doc, start: int, length: int) -> None:
        tier = min(t for t in self.tiers if t >= length)
        insort(self.pools[tier], (length, self.order, doc, start))
        self.order += 1
        self.waiting += length

    def pop(self, tier: int, at: int):
        piece = self.pools[tier].pop(at)
        self.waiting -= piece[0]
        return piece

    def add(self, doc, n_tokens: int) -> None:
        whole = n_tokens - n_tokens % self.window
        for start in range(0, whole, self.window):
            self.done.append((self.window, [(doc, start, self.window)]))
        if n_tokens > whole:
            self.put(doc, whole, n_tokens - whole)
        if self.waiting > self.flush_tokens:
            self.flush()

    def filler(self, below: int, gap: int):
        """The longest waiting rest of a tier up to ``below`` that fits the gap whole,
        else the head of the shortest that is longer."""
        for t in self.tiers:
            if t <= below and (at := bisect_right(self.pools[t], gap, key=lambda p: p[0])):
                return self.pop(t, at - 1)
        for t in reversed(self.tiers):
            if (at := bisect_left(self.pools[t], gap, key=lambda p: p[0])) < len(self.pools[t]):
                length, order, doc, start = self.pop(t, at)
                if length > gap:
                    self.put(doc, start + gap, length - gap)
                return gap, order, doc, start
        return None

    def flush(self, last: bool = False) -> None:
        for tier in self.tiers:
            while self.pools[tier]:
                length, _, doc, start = self.pop(tier, -1)
                pieces, gap = [(doc, start, length)], tier - length
                while gap and (found := self.filler(tier, gap)):
                    length, _, doc, start = found
                    pieces.append((doc, start, length))
                    gap -= length
                if not gap:
                    self.done.append((tier, pieces))
                    continue
                for doc, start, length in pieces:  # nothing is left to fill it: nothing else waits
                    self.put(doc, start, length)
                break
        if last:
            self.tail()

    def tail(self) -> None:
        rest = [p for t in self.tiers for p in reversed(self.pools[t])]
        self.pools = {t: [] for t in self.tiers}
        left = self.waiting
        self.waiting = 0
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            left -= size
            pieces, room = [], size
            while room:
                length, order, doc, start = rest.pop(0)
                if length > room:
                    rest.insert(0, (length - room, order, doc, start + room))
                    length = room
                pieces.append((doc, start, length))
                room -= length
            self.done.append((size, pieces))

    def take(self):
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", window: int = 1024,
         tiers: int = 3, end_id: int = 0, flush_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: its token ids (little-endian unsigned 32-bit), where it lies in its
    document and in its sequence, the sequence's tier (its length) and its number within task and tier."""

    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                 pa.int64()]
        encoder, packer = text_ids(tokenizer_file, ranks_file, pattern), Packer(window, tiers, flush_tokens)
        end, sequence, in_tier = struct.pack("<I", end_id), task << 33, {}

        def rows():
            nonlocal sequence
            cols = [[] for _ in names]
            for tier, pieces in packer.take():
                offset, n = 0, in_tier.get(tier, 0)
                in_tier[tier] = n + 1
                for (doc_id, ids), start, length in pieces:
                    for c, v in zip(cols, (doc_id, start, length, ids[4 * start: 4 * (start + length)], len(ids) // 4,
                                           sequence, offset, tier, task, n)):
                        c.append(v)
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += 256
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, tokens in zip(ids, encoder.documents(texts)):
                    tokens += end
                    packer.add((doc_id, tokens), len(tokens) // 4)
                if packer.done:
                    yield rows()
        packer.flush(last=True)
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)


def balance(packed: DataFrame, step_tokens: int = 1 << 16) -> DataFrame:
    """``packed`` (a written table: tasks number their windows as they run) with step_group instead of task and in_tier."""
    windows = packed.where("offset = 0").groupBy("tier", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = windows.select("tier", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))  # tasks x tiers rows
    number = (F.col("__first") + F.col("in_tier")) * F.col("tier")
    return packed.join(first, ["tier", "task"]).withColumn(
        "step_group", F.shiftleft(F.col("tier").cast("long"), 40) + F.floor(number / step_tokens)).drop("__first", "task", "in_tier")
