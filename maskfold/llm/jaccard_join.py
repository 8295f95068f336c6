"""N-gram Jaccard join by grouped prefixes, and the classes of linked documents.

A document's set holds the hashes of its distinct shingles of ``k`` words (all words as one, if
it has fewer).  Two documents link when |x & y| / |x | y| >= a / b.

1. Sets.  One pass hashes each whole text to its set's size and 128-bit fingerprint.
   Documents of equal sets are one class from here on, so copies never meet in pairs.
2. Document frequencies.  One text of each class is hashed again.  Chunks of half a million tokens or more send them,
   packed, to ranges of the hash space: 6 bytes a token and its holder's place in the chunk (3 bytes, of which
   two mostly compress away), whatever the number of ranges.  A token that several classes of a chunk hold
   goes once, with their number; so a passage that a third of all texts share is one entry a chunk.  A range adds
   the numbers up and sends back only tokens that two or more classes hold: an intersection can have no others.
3. Prefixes.  Tokens are ordered rarest first.  Two linked sets share a token among their first
   n - ceil(a n / b) + 1, so a class whose prefix is all tokens of its own has no links and
   leaves.  That is most classes; passages that many documents share stay at the end of the order.
4. Groups.  Classes with identical prefix and size are one group.  Groups meet by prefix token,
   if the tokens from there on are enough for the overlap that their sizes need.
5. Verification with the whole sets, in two steps, so that a large group of near copies isn't
   paired in full: first each group's members against its first one, and each token's groups against
   the one with the fewest tokens of its own; then only pairs whose two sides
   aren't connected yet, expanded to members.  Every link between different components is found, so
   the components are exact.

Tokens are 64-bit hashes, of which 48 bits and the range are kept: 51 bits for small tables, 61 for 100 TB (some
2 million ranges).  Two sets of n tokens share one by chance with a probability of n * n / 2 ** bits (at 100 TB, 300 tokens: 4e-14),
and it matters only for a pair that is one token short of a link.  A row of a chunk for a range has some 60 bytes beside
its tokens, of which it has ten or more up to about 6 TB and four at 100 TB.  Nothing is capped.

Edge cases: null texts and texts without words have an empty set, size 0, and link with
nothing; a null id sorts after every other, and rows that share it, or any id, link by their texts
only; rows that repeat an id and text form one class;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import MAX_LONG, id_of, stage_table, text_of
from .components import components

WIDTH = 6  # bytes of a token that are sent beside its range
LOW = np.uint64((1 << 8 * WIDTH) - 1)
LEAST_TOKENS, MOST_TOKENS = 500_000, 8_000_000  # of a chunk, and of a range on average
CHUNK_CLASSES = 1 << 23
DEALT = ("to long, chunk long, tokens binary, who binary, many binary, counts binary, nodes binary, sizes binary, "
         "own binary, own_who binary")
SHARED = ("chunk long, tokens binary, who binary, dfs binary, many binary, dfs_many binary, nodes binary, sizes binary, "
          "own binary, own_who binary")


def chunk_sets(texts, k: int):
    """(tokens of all texts one after the other, sizes, fingerprint high, low) of a chunk."""
    from .words import U, mix64, shingle_sets

    sets = shingle_sets(texts, k)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, U)
    sums = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        total = np.zeros(len(tokens) + 1, U)
        np.cumsum(mix64(tokens * U(salt) + U(salt >> 1)), out=total[1:])
        at = np.concatenate(([0], np.cumsum(sizes)))
        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return tokens, sizes, sums[0], sums[1]


def hash_of(col: str = "text"):
    return F.unhex(F.md5(text_of(col)))


def members_of(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        from .words import column_chunks
        for b in batches:
            for at, texts in column_chunks(b.column(1)):
                _, sizes, k1, k2 = chunk_sets(texts, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)),
                                                  *map(pa.array, (k1, k2, sizes))], names=["id", "text_hash", "k1", "k2", "n"])

    return docs.mapInArrow(run, "id long, text_hash binary, k1 long, k2 long, n long")


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte: equal high bytes follow each other and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(data, width: int) -> np.ndarray:
    """The numbers of several ``planes``, one after the other."""
    parts = [np.frombuffer(d, np.uint8).reshape(width, -1).T for d in data]
    out = np.zeros((sum(map(len, parts)), 8), np.uint8)
    if parts:
        out[:, :width] = np.concatenate(parts)
    return out.view("<u8").ravel()


def joined(data, kind) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers starts, and its length."""
    start = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return start, np.diff(np.concatenate((start, [len(x)])))


def representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text): one text of each class."""
    texts = docs.groupBy("id", "text_hash").agg(F.first("text").alias("text"))  # rows that repeat an id and text fold here
    return texts.join(classes.select("first.id", "first.text_hash", "node"), ["id", "text_hash"]).select("node", "text")


def tokens_at_once(total: int) -> int:
    """The size of chunks and ranges: it grows with the square root of the corpus, so that a chunk has some ten tokens
    for a range, and is bounded."""
    return int(min(MOST_TOKENS, max(LEAST_TOKENS, (10 * total) ** 0.5)))


def deal(texts: DataFrame, k: int, ranges: int, chunk_tokens: int) -> DataFrame:
    """Each chunk of classes (node, text) sends every range of the hash space the tokens that one class of the chunk
    holds, with the class's place in the chunk, and once those that several hold, with their number.
    One row a chunk is for the chunk itself: its nodes, their sizes, and who holds the latter tokens."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .words import U, column_chunks, shingle_sets
        names = [f.split()[0] for f in DEALT.split(", ")]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 8)
        chunk = TaskContext.get().partitionId() << 32
        nodes, sets, held = [], [], 0

        def rows():
            sizes = np.array([len(x) for x in sets], np.int64)
            tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            sets.clear()
            where = ((tokens >> U(32)) * U(ranges)) >> U(32)
            tokens = (tokens & LOW) | (where << U(8 * WIDTH))
            where = where.astype(np.uint32)
            order = np.argsort(tokens, kind="stable").astype(np.int32)
            start, count = runs(tokens[order])
            several = np.repeat(count > 1, count)  # in token order
            own, own_who = tokens[order[several]], who[order[several]]
            many, counts = tokens[order[start[count > 1]]], count[count > 1]
            also = where[order[start[count > 1]]]
            alone = np.sort(order[~several])  # by class again
            by_range = alone[np.argsort(where[alone], kind="stable")]
            tokens, who, where = tokens[by_range], who[by_range], where[by_range]
            by_range = np.argsort(also, kind="stable")
            many, counts, also = many[by_range], counts[by_range], also[by_range]
            out = [(chunk % ranges, chunk, None, None, None, None, np.array(nodes, np.int64).tobytes(), sizes.tobytes(),
                    own.tobytes(), planes(own_who, 3))]
            here = np.union1d(where, also)
            cuts = zip(here.tolist(), np.searchsorted(where, here), np.searchsorted(where, here, "right"),
                       np.searchsorted(also, here), np.searchsorted(also, here, "right"))
            for r, a, z, c, d in cuts:
                out.append((r, chunk, planes(tokens[a:z], WIDTH), planes(who[a:z], 3), planes(many[c:d], WIDTH),
                            planes(counts[c:d], 4), None, None, None, None))
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 4096]), kinds)], names=names)

        for b in batches:
            for at, part in column_chunks(b.column(1)):
                new = shingle_sets(part, k)
                nodes += b.column(0).slice(at, len(part)).to_pylist()
                sets += new
                held += sum(map(len, new))
                if held > chunk_tokens or len(sets) > CHUNK_CLASSES:
                    yield from rows()
                    chunk, nodes, sets, held = chunk + 1, [], [], 0
        if sets:
            yield from rows()

    return texts.mapInArrow(run, DEALT)


def shared_tokens(dealt: DataFrame) -> DataFrame:
    """What each chunk needs of the ranges: its tokens that two or more classes hold, and how many do.  A range
    gets a token once a chunk at most, so no task holds all occurrences of one."""
    names = [f.split()[0] for f in SHARED.split(", ")]

    def count(rows):
        import pandas as pd

        lists = rows[rows["nodes"].isna()]
        heads = rows[rows["nodes"].notna()].reindex(columns=names)
        if not len(lists):
            return heads
        chunk = lists["chunk"].tolist()
        top = np.uint64((int(lists["to"].iloc[0]) << 8 * WIDTH) % 2**64)
        one, many = numbers(lists["tokens"], WIDTH) | top, numbers(lists["many"], WIDTH) | top
        who, counts = numbers(lists["who"], 3), numbers(lists["counts"], 4)
        of_one = np.repeat(np.arange(len(chunk)), [len(x) // WIDTH for x in lists["tokens"]])
        of_many = np.repeat(np.arange(len(chunk)), [len(x) // WIDTH for x in lists["many"]])
        tokens = np.concatenate((one, many))
        order = np.argsort(tokens, kind="stable")
        start, length = runs(tokens[order])
        held = np.concatenate((np.ones(len(one), np.int64), counts.astype(np.int64)))
        df = np.zeros(len(tokens), np.int64)
        df[order] = np.repeat(np.add.reduceat(held[order], start), length)
        df = np.minimum(df, 2**32 - 1).astype("<u4")
        df, df_many = df[:len(one)], df[len(one):]
        kept = df > 1
        one, of_one, who, df = one[kept], of_one[kept], who[kept], df[kept]
        found = []
        for i in np.union1d(of_one, of_many).tolist():
            a, z = np.searchsorted(of_one, (i, i + 1))
            c, d = np.searchsorted(of_many, (i, i + 1))
            found.append((chunk[i], one[a:z].tobytes(), planes(who[a:z], 3), df[a:z].tobytes(), many[c:d].tobytes(),
                          df_many[c:d].tobytes()))
        found = pd.DataFrame(found, columns=names[:6]).reindex(columns=names)
        return pd.concat([heads, found]) if len(heads) else found

    return dealt.groupBy("to").applyInPandas(count, SHARED)


def prefixes(shared: DataFrame, a: int, b: int) -> DataFrame:
    """(node, n, f, tokens, prefix) of the classes that may have links: f tokens that others hold too,
    and those of them in the prefix, rarest first.  A chunk's classes are taken together."""
    def run(rows):
        import pandas as pd

        head, lists = rows[rows["nodes"].notna()].iloc[0], rows[rows["nodes"].isna()]
        nodes, n = np.frombuffer(head["nodes"], np.int64), np.frombuffer(head["sizes"], np.int64)
        many = joined(lists["many"], np.uint64)
        order = np.argsort(many)
        several = np.frombuffer(head["own"], np.uint64)  # all of them are in ``many``: their ranges know them
        of_several = order[np.searchsorted(many, several, sorter=order)]
        tokens = np.concatenate((joined(lists["tokens"], np.uint64), several))
        df = np.concatenate((joined(lists["dfs"], "<u4"), joined(lists["dfs_many"], "<u4")[of_several]))
        own = np.concatenate((numbers(lists["who"], 3), numbers([head["own_who"]], 3))).astype(np.int64)
        f = np.bincount(own, minlength=len(n))
        prefix = n + (-a * n) // b + 1  # n - ceil(a n / b) + 1
        alone = n - f
        stays = (f > 0) & (alone < prefix)
        kept = stays[own]
        tokens, df, own = tokens[kept], df[kept], own[kept]
        order = np.lexsort((tokens, df, own))
        tokens, own = tokens[order].view(np.int64), own[order]
        who = np.flatnonzero(stays)
        lo = np.searchsorted(own, who, "left")
        hi = np.searchsorted(own, who, "right")
        return pd.DataFrame({"node": nodes[who], "n": n[who], "f": f[who],
                             "tokens": pd.Series([tokens[x:y] for x, y in zip(lo, hi)], dtype=object),
                             "prefix": pd.Series([tokens[x:x + m] for x, m in zip(lo, (prefix - alone)[who])], dtype=object)})

    return shared.groupBy("chunk").applyInPandas(run, "node long, n long, f long, tokens array<long>, prefix array<long>")


def verify(pairs: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    two = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (pairs.join(one, "b").join(two, "a")
            .where((a + b) * overlap >= a * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def enough(a: int, b: int, x: str, y: str):
    """The tokens from the shared one on suffice for the overlap that the two sizes need."""
    return (a + b) * F.least(f"{x}.rest", f"{y}.rest") >= a * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def link_components(sets: DataFrame, a: int, b: int) -> DataFrame:
    """(node, component) of the nodes that have links, from (node, n, f, tokens, prefix)."""
    members = stage_table(sets.withColumn("g", F.struct("n", F.xxhash64("prefix"), F.md5(F.array_join("prefix", ","))))
                          .withColumn("g", F.md5(F.to_json("g"))).select("g", "node", "n", "f", "prefix"), "members")
    groups = members.groupBy("g").agg(F.min("node").alias("lead"), F.first("n").alias("n"), F.first("f").alias("f"),
                                      F.first("prefix").alias("prefix"))
    postings = stage_table(
        groups.select("g", "lead", "n", "f", F.posexplode("prefix").alias("at", "token"))
        .select("token", "g", "lead", "n", (F.col("f") - F.col("at")).alias("rest"), (F.col("n") - F.col("f")).alias("alone")),
        "postings")
    leads = stage_table(groups.select("g", "lead"), "leads")

    # first step: members against the first of their group, groups against the token's centre
    centres = stage_table(
        postings.groupBy("token").agg(F.count("*").alias("groups"), F.min(F.struct("alone", "lead", "n", "rest")).alias("c"))
        .where("groups > 1").select(F.col("token").alias("of"), "c.*"), "centres").alias("y")
    stars = (postings.alias("x").join(centres, F.col("x.token") == F.col("y.of"))
             .where((F.col("x.lead") != F.col("y.lead")) & enough(a, b, "x", "y"))
             .select(F.col("y.lead").alias("a"), F.col("x.lead").alias("b")).distinct())
    inside = (members.select("g", F.col("node").alias("b")).join(leads.select("g", F.col("lead").alias("a")), "g")
              .where("a <> b").select("a", "b"))
    pairs = stage_table(stars.unionByName(inside), "star-pairs")
    found = stage_table(verify(pairs, sets, a, b), "star-links")
    first = stage_table(components(found), "components")

    # second step: pairs of groups whose members lie in different components
    placed = stage_table(
        members.select("g", "node").join(first, "node", "left")
        .select("g", "node", F.coalesce("component", "node").alias("part")), "placed")
    parts = postings.join(placed.select("g", "part").distinct(), "g").select("token", "g", "part", "n", "rest")
    mixed = parts.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("n").alias("least_n")) \
        .where("lo <> hi").select("token", "least_n")
    smallest = F.greatest("least_n", F.ceil(F.col("n") * a / b))  # a partner's size is at least that
    still = stage_table(parts.join(stage_table(mixed, "mixed"), "token")
                        .where((a + b) * F.col("rest") >= a * (F.col("n") + smallest)).drop("least_n"), "open")
    x, y = still.alias("x"), still.alias("y")
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part"))
                  & ((F.col("x.g") < F.col("y.g")) | ((F.col("x.g") == F.col("y.g")) & (F.col("x.part") < F.col("y.part"))))
                  & enough(a, b, "x", "y")) \
        .select(F.col("x.g").alias("g_x"), F.col("x.part").alias("part_x"), F.col("y.g").alias("g_y"),
                F.col("y.part").alias("part_y")).distinct()
    left = placed.select(F.col("g").alias("g_x"), F.col("part").alias("part_x"), F.col("node").alias("a"))
    right = placed.select(F.col("g").alias("g_y"), F.col("part").alias("part_y"), F.col("node").alias("b"))
    expanded = stage_table(meet.join(left, ["g_x", "part_x"]).join(right, ["g_y", "part_y"]).select("a", "b"), "open-pairs")
    more = stage_table(verify(expanded, sets, a, b), "open-links")
    if more.isEmpty():
        return first
    part = placed.select("node", "part")
    joined = components(more.join(part.select(F.col("node").alias("a"), F.col("part").alias("p")), "a")
                        .join(part.select(F.col("node").alias("b"), F.col("part").alias("q")), "b")
                        .select(F.col("p").alias("a"), F.col("q").alias("b")))
    joined = stage_table(joined.select(F.col("node").alias("part"), "component"), "joined")
    return part.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("component"))


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, text_hash (``hash_of`` its text), n (size of its set), part (the number of
    its component) and component (smallest id reachable by links)."""
    a, b = threshold
    texts = docs.select(id_of(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", hash_of("text"))
    members = stage_table(members_of(texts, k), "sets")
    # ids may be null or repeat, so a class is a node under a number of its own, fixed by the writing
    classes = stage_table(
        members.where("n > 0").groupBy("k1", "k2").agg(
            F.first("n").alias("n"), F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("first"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    at_once = tokens_at_once(total)
    dealt = deal(representatives(texts, classes), k, max(8, ceil(total / at_once)), at_once)
    sets = stage_table(prefixes(shared_tokens(dealt), a, b), "prefixes")
    linked = stage_table(link_components(sets, a, b).join(classes.select("node", "least"), "node"), "linked")
    least = stage_table(linked.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    labels = stage_table(classes.join(linked.drop("least").join(least, "component"), "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("part"), F.coalesce("smallest", "least").alias("component")), "labels")
    return members.join(labels, ["k1", "k2"], "left").select(
        F.nullif("id", F.lit(MAX_LONG)).alias("id"), "text_hash", "n", "part",
        F.nullif(F.coalesce("component", "id"), F.lit(MAX_LONG)).alias("component"))
