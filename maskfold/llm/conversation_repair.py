"""Conversation structure repair: the cheapest edits that give every conversation the roles
``(s?(ua)+)?``, found by a dynamic programme that streams over rows in turn order.

1. Rows are told apart by (role, text): a hash of both, counted per conversation with Spark's partial aggregation,
   gives the first turn of whatever repeats (rows that don't repeat never get there).
2. Rows are dealt by conversation, sorted by turn and streamed through ``mapInArrow``.  The carried state
   is four costs (nothing yet, after s, u, a), their order as edit strings, and four running SHA-256 digests
   of the repaired text: no text is kept, whatever the conversation's length.
3. Each row leaves one byte of backpointer per state.  A conversation of more than ``SPILL_ROWS`` rows hands
   full chunks of them out as rows of the written result (Spark's own table in the shared folder, so a
   lost executor costs nothing else); a second pass over those chunks, last first, traces the edits back.

Edits: keep K (0), rerole to user or assistant R (1), delete D (2), insert an empty user or assistant row I (5).
Blank rows and repeats must go; keeping a truncated row costs 5 more.  Of edits of equal cost the ASCII-least
string wins.  Strings at the same row never are prefixes of one another (inserts belong to the edit after
them), so the order of two of them is known from the order of their predecessors.

Edge cases: a null role or text is one space; rows of a null conversation id are one conversation; null turns
come first and rows of the same turn go by role and text; repeated rows are repeats; a conversation without
rows has zeros, an empty audit and the digest of the empty string; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, stage_table

SPILL_ROWS = 1 << 16
COSTS = {"R": 1, "D": 2, "I": 5, "truncated": 5}
END, NEXT = {0, 3}, {0: 2, 1: 2, 2: 3, 3: 2}  # states that may end; the state after an insert
LEGAL = {"su", "ua", "au"}
REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def rows_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present) of a table of turns; a null role or text is one space."""
    space = F.lit(" ")
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), space).alias("text"), F.lit(True).alias("present"))


def damage(rows: DataFrame) -> DataFrame:
    """Damage a twentieth of ``rows_of`` each by crc32(``conv_id:turn``) % 20 (a null as one space): 0 drops the row, 1 empties
    its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.  A dropped row stays as one that
    isn't present, so that its conversation is still known."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with their fault as the row alone shows it (blank, truncated), a key of role and text,
    and the first turn of keys that repeat in their conversation."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WS)), -1, 1)
    key = F.unhex(F.md5(F.concat(F.octet_length("role"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumns({
        "key": key, "blank": last == "", "truncated": (last != "") & ~last.isin(".", "!", "?")})
    repeated = stage_table(rows.where("present and not blank").groupBy("conv_id", "key")
                           .agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
                           .select(F.col("conv_id").alias("of"), F.col("key").alias("again"), "first"), "repeated-turns")
    return rows.join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("again")) & ~F.col("blank")
                     & F.col("present"), "left").select(
        "conv_id", "turn", "role", "text", "present", "blank", "truncated", "key", F.col("first").isNotNull().alias("repeats"),
        F.col("turn").eqNullSafe(F.col("first.turn")).alias("at_first"))


@cache
def moves(initial: str, must_go: bool, truncated: bool, costs: tuple) -> list[tuple]:
    """All useful (from, to, cost, edits, output) of a row; output counts the inserted rows and tells whether the row stays."""
    price = dict(costs)
    best: dict[tuple, tuple] = {}
    for start in range(4):
        state, cost, edits = start, 0, ""
        for inserts in range(4):
            found = [(state, price["D"], "D")]
            if not must_go:
                kept = price["truncated"] * truncated
                target = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)
                if target is not None:
                    found.append((target, kept, "K"))
                found.append((NEXT[state], price["R"] + kept, "R"))
            for to, more, letter in found:
                new = (cost + more, edits + letter, inserts)
                if (start, to) not in best or new[:2] < best[start, to][:2]:
                    best[start, to] = new
            state, cost, edits = NEXT[state], cost + price["I"], edits + "I"
    return [(a, b, *v) for (a, b), v in sorted(best.items())]


class Programme:
    """The dynamic programme of one conversation."""

    def __init__(self, costs: tuple):
        import hashlib
        self.costs, self.price = costs, dict(costs)
        self.cost = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.digest = [hashlib.sha256(), None, None, None]
        self.back = bytearray()

    @staticmethod
    def written(digest, state: int, rows: list[bytes | None]):
        """The digest after ``rows`` (each ``role:text``; None: inserted), from ``state`` on.  Only the last may be
        a row of the conversation."""
        digest = digest.copy()
        for row in rows:
            digest.update(b"\n" if state else b"")
            state = NEXT[state]
            digest.update(row if row is not None else b"user:" if state == 2 else b"assistant:")
        return digest

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best = [None] * 4
        for a, b, cost, edits, inserts in moves(role[:1], must_go, truncated, self.costs):
            if self.cost[a] is not None:
                new = (self.cost[a] + cost, self.rank[a], edits, a, inserts)
                if best[b] is None or new < best[b]:
                    best[b] = new
        order = {k: i for i, k in enumerate(sorted((x[1], x[2]) for x in best if x))}
        digest = [None] * 4
        for b, x in enumerate(best):
            self.back.append(0 if x is None else x[3] | x[4] << 2 | "DKR".index(x[2][-1]) << 4)
            if x is None:
                continue
            _, _, edits, a, inserts = x
            shown = {"D": None, "K": role, "R": "user" if b == 2 else "assistant"}[edits[-1]]
            output = [None] * inserts + ([] if shown is None else [f"{shown}:{text}".encode()])
            digest[b] = self.written(self.digest[a], a, output) if output else self.digest[a]
        self.cost, self.digest = [x and x[0] for x in best], digest
        self.rank = [order[x[1], x[2]] if x else 0 for x in best]

    def end(self) -> tuple[int, int, str, str]:
        """(cost, last state, inserts after the last row, digest) of the best edits."""
        found = []
        for start in range(4):
            state, cost, edits = start, self.cost[start], ""
            for _ in range(4):
                if cost is not None and state in END:
                    found.append((cost, self.rank[start], edits, start))
                    break
                cost, state, edits = None if cost is None else cost + self.price["I"], NEXT[state], edits + "I"
        cost, _, edits, state = min(found)
        return cost, state, edits, self.written(self.digest[state], state, [None] * len(edits)).hexdigest()


def trace(back: bytes, state: int) -> tuple[str, int]:
    """(edits, state before them) that lead to ``state`` through a chunk of backpointers."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        x = back[at + state]
        out.append("I" * (x >> 2 & 3) + "DKR"[x >> 4])
        state = x & 3
    return "".join(reversed(out)), state


def streamed(rows: DataFrame, *first: str) -> DataFrame:
    """``rows`` dealt by conversation, each conversation's rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text")


def by_conversation(batches, names: list[str]):
    """(conv_id, iterator of its rows) over sorted Arrow batches, one batch in memory."""
    from itertools import groupby

    def each():
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield from zip(*(part.column(c).to_pylist() for c in names))

    return groupby(each(), key=lambda r: r[0])


def repair(rows: DataFrame, costs: dict | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``rows_of``, perhaps damaged): turns missing between the
    first and last, faults (each row's first), neighbouring roles that aren't su, ua or au, and the cheapest
    repair's cost, edits and SHA-256 of its ``role:text`` rows."""
    price = tuple(sorted((COSTS | (costs or {})).items()))
    names = ["conv_id", "turn", "role", "text", "present", "blank", "truncated", "key", "repeats", "at_first"]
    schema = f"conv_id long, chunk long, back binary, state int, {REPORT}"

    def run(batches):
        import pyarrow as pa

        columns = ["conv_id", "chunk", "back", "state", *(f.split()[0] for f in REPORT.split(", "))]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string()]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=columns)

        out, size = [], 0
        for conv, turns in by_conversation(batches, names):
            work, chunk, low, high, distinct = Programme(price), 0, None, None, 0
            blanks = repeats = cut = illegal = 0
            before = last_key = None
            for _, turn, role, text, present, blank, truncated, key, again, at_first in turns:
                if not present:
                    continue
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                repeat = again and not (at_first and key != last_key)
                last_key = key
                if before is not None:
                    illegal += before + role[:1] not in LEGAL
                before = role[:1]
                blanks += blank
                repeats += repeat and not blank
                cut += truncated and not repeat
                work.add(role, text, blank or repeat, truncated)
                if len(work.back) >= 4 * spill_rows:
                    yield batch([(conv, chunk, bytes(work.back), *[None] * 9)])
                    work.back, chunk = bytearray(), chunk + 1
            cost, last, inserts, digest = work.end()
            edits, state = trace(work.back, last)
            out.append((conv, chunk, None, state if chunk else None, 0 if low is None else high - low + 1 - distinct,
                        blanks, repeats, cut, illegal, cost, edits + inserts, digest))
            size += len(edits)
            if len(out) >= 2048 or size > 1 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    found = stage_table(streamed(marked(rows)).mapInArrow(run, schema), "repairs")
    report = found.where("back is null").drop("back")
    return report.join(traced(found), F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn(
        "audit", F.concat(F.coalesce("head", F.lit("")), "audit")).drop("of", "head", "chunk", "state")


def traced(found: DataFrame) -> DataFrame:
    """(of, head): the edits of the conversations whose backpointers went out in chunks, up to the last chunk."""
    def run(batches):
        import pyarrow as pa

        for conv, chunks in by_conversation(batches, ["conv_id", "chunk", "back", "state"]):
            state = None
            for _, chunk, back, known in chunks:
                if back is None:
                    state = known
                    continue
                edits, state = trace(back, state)
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()),
                                                  pa.array([edits])], names=["of", "chunk", "edits"])

    pieces = found.where("state is not null or back is not null").select("conv_id", "chunk", "back", "state")
    sorted_ = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("chunk"))
    return sorted_.mapInArrow(run, "of long, chunk long, edits string").groupBy("of").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda c: c["edits"]), "").alias("head"))


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position from 1, role, text, edit): the repaired conversations, row by row.  Each conversation's
    edits are streamed ahead of its rows."""
    def run(batches):
        import pyarrow as pa

        def each():
            for conv, turns in by_conversation(batches, ["conv_id", "turn", "role", "text", "ahead"]):
                edits, state, position = iter(""), 0, 0
                for _, _, role, text, ahead in turns:
                    if ahead:
                        edits = iter(text + ".")
                        letter = next(edits)
                    else:
                        while letter == "I":
                            state, position = NEXT[state], position + 1
                            yield conv, position, "user" if state == 2 else "assistant", "", "I"
                            letter = next(edits)
                        if letter != "D":
                            state, position = 1 if letter == "K" and role[:1] == "s" else NEXT[state], position + 1
                            yield conv, position, role if letter == "K" else "user" if state == 2 else "assistant", text, letter
                        letter = next(edits)
                while letter == "I":
                    state, position = NEXT[state], position + 1
                    yield conv, position, "user" if state == 2 else "assistant", "", "I"
                    letter = next(edits)

        from itertools import batched
        for some in batched(each(), 1024):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*some), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["conv_id", "position", "role", "text", "edit"])

    turns = rows.where("present").select("conv_id", "turn", "role", "text", F.lit(False).alias("ahead"))
    heads = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"), F.lit(True).alias("ahead"))
    return streamed(turns.unionByName(heads), F.desc("ahead")).mapInArrow(
        run, "conv_id long, position long, role string, text string, edit string")
