"""Word vectors: vocabulary tables, static vectors pooled over documents, nearest entries
(FN-22, MDL-21, JN-09, FN-11).

A vocabulary is (word string, v array<double>), one row a word.  Documents become rows of words only as
(document, word, count), so a word that a document repeats moves once.
"""

from __future__ import annotations

import gc
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import staged
from .knn import knn


def word_counts(docs: DataFrame, words: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, word, n): how often each document has each word; folded inside the row, so nothing is shuffled."""
    ws = docs.select(id_col, F.array_sort(words).alias("_ws"))
    # runs of equal words in the sorted array; no filter on it, which would make the words a second time
    starts = F.filter(F.sequence(F.lit(0), F.size("_ws") - 1),
                      lambda i: (i == 0) | (F.get("_ws", i) != F.get("_ws", i - 1)))
    ws = ws.withColumn("_at", F.when(F.size("_ws") > 0, starts))
    runs = F.transform("_at", lambda a, i: F.struct(
        F.get("_ws", a).alias("word"), (F.coalesce(F.get("_at", i + 1), F.size("_ws")) - a).cast("long").alias("n")))
    return ws.select(id_col, F.explode(runs).alias("_r")).select(id_col, "_r.word", "_r.n")


def pooled_vectors(counts: DataFrame, vocabulary: DataFrame, d: int, id_col: str = "doc_id", normalize: bool = True) -> DataFrame:
    """MDL-21: (id, n_words, n_known, x): the mean of the vectors of a document's known words (each of unit length
    first, if ``normalize``).  A document without known words is not there.  The counts meet the vocabulary by an
    equi-join on the word, which AQE may split for hot words; sums per document fold before the shuffle."""
    v = V.row_l2_normalize(V.as_double_array("v")) if normalize else V.as_double_array("v")
    table = staged(vocabulary.select("word", v.alias("v")), "word-vectors")
    known = counts.join(table, "word", "left")
    sums = [F.sum(F.coalesce(F.get("v", F.lit(k)) * F.col("n"), F.lit(0.0))).alias(f"_s{k}") for k in range(d)]
    out = known.groupBy(id_col).agg(F.sum("n").alias("n_words"),
                                    F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), *sums)
    return out.where("n_known > 0").select(id_col, "n_words", "n_known", F.array(
        *[F.col(f"_s{k}") / F.col("n_known") for k in range(d)]).alias("x"))


SLICE = 128  # words of a row that are paired together
FOLD = 250_000  # words of a task whose pairs are folded together, whatever an Arrow batch holds
HELD, GROUP = 1_500_000, 1_000_000  # folded pairs that a task holds at once; pairs, as they occur, of a packed group
MAX_SENT = 32_000_000  # bytes of words that are sent to every task
MAX_KEPT = 24_000_000  # numbers of word vectors that the driver keeps, in files of its own
MAX_COLUMNS = 2_000_000  # numbers of them that are sent to a task, and that it sums, at once


def _added(key: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(key)
    key = key[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    return key[first], np.add.reduceat(worth[order], first) if len(first) else worth[:0]


def _pair_sums(batches, window: int, numbered):
    """(names, their number, keys, sums) of bounded numbers of words of an Arrow stream of slices: the key of places a <= b is a times
    the number of names plus b.  ``numbered`` gives the names and the place of each word of a dictionary, -1 if it has none."""
    unit = math.lcm(*range(1, window + 1))

    def folded(held):
        lists = pa.chunked_array(held).combine_chunks()
        coded, length = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names, place = numbered(coded.dictionary)
        code = np.append(place, -1)[coded.indices.fill_null(len(place)).to_numpy(zero_copy_only=False)]
        start = np.repeat(np.cumsum(length) - length, length)
        at, end = np.arange(len(code)) - start, start + np.repeat(length, length)
        keys, worth, most = [], [], max(1, len(names))
        for j in range(1, window + 1):
            here = np.nonzero((at < SLICE) & (np.arange(len(code)) + j < end))[0]  # a slice's last words only follow others
            x, y = code[here], code[here + j]
            low = np.minimum(x, y)
            keys.append((low * most + np.maximum(x, y))[low >= 0])
            worth.append(np.full(len(keys[-1]), unit // j, np.int64))
        return names, most, *_added(np.concatenate(keys), np.concatenate(worth))

    held, n = [], 0
    for b in batches:
        lists, at = b.column(0), 0
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(lists):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + FOLD - n, "right")))
            held.append(lists.slice(at, to - at))
            n, at = n + int(ends[to - 1]) - before, to
            if n + SLICE + window > FOLD:  # another slice may not fit
                yield folded(held)
                held, n = [], 0
    if n:
        yield folded(held)


def _slices(docs: DataFrame, words: str, window: int) -> DataFrame:
    """Documents in slices that overlap by the window."""
    ws = F.col(words)
    last = F.floor((F.size(ws) - 1) / SLICE).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(ws, i * SLICE + 1, SLICE + window))
    # not a filter on the words, which would make them a second time
    return docs.select(F.explode(F.when(F.size(ws) > 1, slices)).alias("ws"))


def _pairs(docs: DataFrame, words: str, window: int) -> DataFrame:
    """(a, b, x): unordered pairs of words, a <= b, at most ``window`` places apart; x sums unit / distance as whole numbers.
    Documents come in slices and a task folds a bounded number of words at once, whatever the texts and the Arrow batches are."""
    def numbered(dictionary):
        order = pc.sort_indices(dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        return dictionary.take(order), place

    def run(batches):
        for names, most, key, sums in _pair_sums(batches, window, numbered):
            for at in range(0, len(key), 100_000):
                k, x = key[at:at + 100_000], sums[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k // most)), names.take(pa.array(k % most)), pa.array(x)], names=["a", "b", "x"])

    return _slices(docs, words, window).mapInArrow(run, "a string, b string, x long").groupBy("a", "b").agg(F.sum("x").alias("x"))


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _spread(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _packed_pairs(docs: DataFrame, words: str, window: int, known, n_words: int) -> DataFrame:
    """(_g, _n, _ks, _xs): the pairs of ``known`` words, a broadcast array, in packed groups: each pair's key (place of a times their
    number, plus place of b) once, in order as differences, and its x.  Groups are dealt by a hash of the key and bounded in size."""
    groups = max(1, math.ceil(n_words * window / GROUP))

    def numbered(dictionary):
        return known.value, pc.index_in(dictionary, value_set=known.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def packed(g, key, sums):
        return g, len(key), _squeezed(np.diff(key, prepend=0)), _squeezed(sums)

    def dealt(key, sums):
        g = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(groups)
        order = np.argsort(g, kind="stable")
        ends = np.searchsorted(g[order], np.arange(groups + 1, dtype=np.uint64))
        for i in np.nonzero(np.diff(ends))[0]:
            own = order[ends[i]:ends[i + 1]]
            yield packed(int(i), key[own], sums[own])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    def merged(held):
        key, sums = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        held.clear()
        return _added(key, sums)

    def run(batches):
        held, n = [], 0
        for _, _, key, sums in _pair_sums(batches, window, numbered):
            held.append((key, sums))
            n += len(key)
            if n >= HELD:
                held = [merged(held)]
                n = len(held[0][0])
                if n >= HELD // 2:
                    yield batch([*dealt(*held.pop())])
                    n = 0
        if n:
            yield batch([*dealt(*merged(held))])

    def added(table):
        return pa.Table.from_batches([batch([packed(table["_g"][0].as_py(), *merged([*_unpacked(table)]))])])

    names, kinds = ["_g", "_n", "_ks", "_xs"], "_g int, _n int, _ks binary, _xs binary"
    return _slices(docs, words, window).mapInArrow(run, kinds).groupBy("_g").applyInArrow(added, kinds)


def _unpacked(rows):
    """(keys, sums) of each packed group."""
    for n, ks, xs in zip(*(rows.column(c).to_pylist() for c in ("_n", "_ks", "_xs"))):
        yield np.cumsum(_spread(ks, n)), _spread(xs, n)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(word, context, x) from unordered pairs (a, b, x); a pair of equal words is one row."""
    ways = [F.struct(F.col(p).alias("word"), F.col(q).alias("context"), "x") for p, q in (("a", "b"), ("b", "a"))]
    return pairs.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(ways[0])).otherwise(F.array(*ways))))


def _weighted(pairs: DataFrame, window: int) -> DataFrame:
    """Pairs whose x is their weight; one of equal words counts for either order."""
    return pairs.withColumn("x", F.col("x") * F.when(F.col("a") == F.col("b"), 2).otherwise(1) / F.lit(float(math.lcm(*range(1, window + 1)))))


def cooccurrences(docs: DataFrame, words: str = "ws", window: int = 4) -> DataFrame:
    """(word, context, weight): words at most ``window`` places apart, each pair weighted by 1 / distance, folded
    before the shuffle, where a pair is one row for both orders."""
    return _both_ways(_weighted(_pairs(docs, words, window), window)).withColumnRenamed("x", "weight")


def _basis(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, the matrix that makes columns with these products orthonormal)."""
    values, turn = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    return values, turn * np.where(values > 1e-12 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def _sums_per_word(pairs: DataFrame, n: int, width: int, terms) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, their sums): ``terms(a, b, x)`` names which pairs count and yields, ``width`` times, what they add to a and to b.
    A task sums its pairs densely, one task a core."""
    def run(batches):
        total, seen = np.zeros((width, n)), np.zeros(n, bool)

        for batch in batches:
            for key, x in _unpacked(batch):
                own, more = terms(key // n, key % n, x)
                a, b = key[own] // n, key[own] % n
                other = a != b  # a pair of equal words counts once
                seen[a] = seen[b] = True
                for k, (left, right) in enumerate(more):
                    total[k] += np.bincount(a, left, n)
                    total[k] += np.bincount(b[other], right[other], n)
        places = np.nonzero(seen)[0]
        for at in range(0, len(places), 10_000):
            own = places[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(t[own]) for t in total)], names=names)

    names = ["place", *(f"_{k}" for k in range(width))]
    some = pairs.coalesce(pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(
        run, ", ".join(f"{c} {'double' if k else 'long'}" for k, c in enumerate(names)))
    found = some.groupBy("place").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    return found["place"].to_numpy(), [found[c].to_numpy() for c in names[1:]]


def _freed(spark) -> None:
    """Spark deletes the shuffle files of jobs that nobody holds any more, which else stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _sent_vectors(ws: DataFrame, kept: DataFrame, n: int, n_words: int, d: int, window: int, rounds: int, folder: str) -> DataFrame:
    """``fitted_vectors`` of ``n`` words (word, id, first columns v) on the driver: the words, and parts of their columns, are sent to
    the tasks.  The columns of a round are a file in ``folder``."""
    spark, ordered = ws.sparkSession, kept.orderBy("id")
    names = ordered.select("word").toArrow()["word"].combine_chunks().cast(pa.string())
    known = spark.sparkContext.broadcast(names)
    pairs = staged(_packed_pairs(ws, "ws", window, known, n_words), "cooccurrences")
    unit = math.lcm(*range(1, window + 1))

    def counted(a, b, x):
        return slice(None), [(x * (1 + (a == b)), x)]  # of equal words for either order

    s = np.zeros(n)
    places, found = _sums_per_word(pairs, n, 1, counted)
    s[places] = found[0] / unit
    sent_sums, total = spark.sparkContext.broadcast(s), s.sum()
    known.unpersist()
    _freed(spark)

    def product(part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        sent, width = spark.sparkContext.broadcast(part), part.shape[1]

        def terms(a, b, x):
            s, v = sent_sums.value, sent.value
            pmi = np.log(x * (1 + (a == b)) / unit * total / (s[a] * s[b]))
            own = pmi > 0
            a, b, pmi = a[own], b[own], pmi[own]
            return own, ((pmi * v[b, k], pmi * v[a, k]) for k in range(width))

        found = _sums_per_word(pairs, n, width, terms)
        sent.destroy()
        _freed(spark)
        return found

    def first(own: list[int]) -> np.ndarray:
        found = ordered.select(*[F.get("v", F.lit(k)).alias(f"_{k}") for k in own]).toArrow()
        return np.stack([c.to_numpy() for c in found.columns], 1)

    step, columns = max(1, MAX_COLUMNS // max(1, n)), None
    for i in range(rounds):
        made = np.memmap(f"{folder}/{i}", np.float64, "w+", shape=(max(1, n), d))
        for at in range(0, d, step):
            own = range(at, min(at + step, d))
            places, sums = product(first(own) if columns is None else np.array(columns[:n, own.start:own.stop]))
            for k, x in zip(own, sums):
                made[places, k] = x
            del sums
            pa.default_memory_pool().release_unused()
        parts = range(0, n, 100_000)
        values, turn = _basis(sum((made[p:p + 100_000].T @ made[p:p + 100_000] for p in parts), np.zeros((d, d))))
        for p in parts:
            made[p:p + 100_000] = made[p:p + 100_000] @ turn
        columns = made  # orthonormal
        if i:
            os.unlink(f"{folder}/{i - 1}")
    scale, out = np.sqrt(np.sqrt(np.maximum(values, 0))), None  # columns times root singular values
    places = np.sort(places)
    for at in range(0, max(1, len(places)), 100_000):
        own = places[at:at + 100_000]
        v = pa.ListArray.from_arrays(np.arange(0, len(own) * d + 1, d, dtype=np.int32), pa.array(np.asarray(columns[own] * scale).ravel()))
        part = staged(spark.createDataFrame(pa.table({"word": names.take(pa.array(own)), "v": v})), "fitted-vectors")
        out = part if out is None else out.unionByName(part)
    return out


def fitted_vectors(docs: DataFrame, words: Column, d: int = 32, window: int = 4, least: int = 5, rounds: int = 3,
                   seed: int = 5) -> DataFrame:
    """MDL-21 without given vectors: (word, v).  The positive pointwise mutual information of words and contexts is
    a distributed sparse matrix; a randomised range finder multiplies it with d columns a few times, and each product
    is a sum per word.  Up to a bounded number of words, the driver holds the columns and sends them to the tasks; with more,
    a product is a join with them, and only d x d matrices reach the driver.  Words that occur less than ``least`` times have no vector (the
    feature's own parameter)."""
    ws = docs.select(words.alias("ws"))
    kept = ws.select(F.explode("ws").alias("word")).groupBy("word").count().where(F.col("count") >= least)
    # words are numbers from here on
    kept = staged(kept.select("word", F.monotonically_increasing_id().alias("id"), "count"), "kept-words").where("word is not null")
    draws = F.array(*[(F.pmod(F.xxhash64("word", F.lit(seed * 1000 + k)), F.lit(2000001)) / 1000000.0 - 1.0) for k in range(d)])
    n, size, n_words = kept.agg(F.count("*"), F.sum(F.octet_length("word") + 4), F.sum("count")).first()
    if n * d <= MAX_KEPT and (size or 0) <= MAX_SENT:
        with tempfile.TemporaryDirectory() as folder:
            return _sent_vectors(ws, kept.select("word", "id", draws.alias("v")), n, n_words or 0, d, window, rounds, folder)

    pairs = _pairs(ws, "ws", window)
    for c in ("a", "b"):
        pairs = pairs.join(kept.select(F.col("word").alias(c), "id"), c).drop(c).withColumnRenamed("id", f"_{c}")
    pairs = pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "x")
    pairs = _weighted(staged(pairs, "cooccurrences"), window)

    sums = staged(_both_ways(pairs).groupBy("word").agg(F.sum("x").alias("s")), "word-sums")
    total = sums.agg(F.sum("s")).first()[0] or 1.0
    for c in ("a", "b"):
        pairs = pairs.join(sums.select(F.col("word").alias(c), F.col("s").alias(f"_{c}")), c)
    pmi = F.log(F.col("x") * total / (F.col("_a") * F.col("_b")))
    m = _both_ways(staged(pairs.select("a", "b", pmi.alias("x")).where("x > 0"), "pointwise-information"))
    columns = staged(kept.select(F.col("id").alias("word"), draws.alias("v")), "word-draws")

    def rotated(df: DataFrame, matrix: np.ndarray) -> DataFrame:
        cols = [F.array(*[F.lit(float(c)) for c in matrix[:, j]]) for j in range(matrix.shape[1])]
        return df.select("word", F.array(*[V.dot(F.col("v"), c) for c in cols]).alias("v"))

    def gram(df: DataFrame) -> np.ndarray:
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))) for i, j in upper]).first()
        g = np.zeros((d, d))
        for (i, j), x in zip(upper, row):
            g[i, j] = g[j, i] = x or 0.0
        return g

    for _ in range(rounds):
        joined = m.join(columns.select(F.col("word").alias("context"), "v"), "context")
        product = joined.groupBy("word").agg(*[F.sum(F.col("x") * F.get("v", F.lit(k))).alias(f"_{k}") for k in range(d)])
        product = staged(product.select("word", F.array(*[f"_{k}" for k in range(d)]).alias("v")), "word-columns")
        values, turn = _basis(gram(product))
        columns = staged(rotated(product, turn), "word-basis")  # orthonormal columns
    columns = rotated(columns, np.diag(np.sqrt(np.sqrt(np.maximum(values, 0)))))  # columns times root singular values
    return columns.withColumnRenamed("word", "id").join(kept, "id").select("word", "v")


def nearest_entries(queries: DataFrame, vocabulary: DataFrame, exclusions: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """JN-09: (query, word, cosine): the entry of largest cosine for every (query, v), ties to the smallest word.
    ``exclusions`` is (query, word), at most a short list a query.  Null, empty and zero vectors have no direction:
    such entries are never found, and such queries get a null.  Entries of another length are an error.

    Entries of one direction are one row, of which as many of the smallest words are kept as a query may exclude
    (and one more).  Directions are found by the exact cell join on unit vectors (a smaller distance is a larger cosine)."""
    def directed(df: DataFrame, key: str) -> DataFrame:
        v = V.as_double_array("v")
        df = df.select(key, v.alias("v")).where((F.size("v") > 0) & (V.l2_norm("v") > 0))
        return df.withColumn("v", V.row_l2_normalize("v")).withColumn("_key", F.transform("v", lambda c: F.round(c, 12) + 0.0))

    spark = queries.sparkSession
    excluded = None if exclusions is None else staged(exclusions.select("query", "word").distinct(), "exclusions")
    most = 0 if excluded is None else excluded.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    entries = staged(directed(vocabulary, "word").distinct(), "entries")
    ways = staged(entries.groupBy("_key").agg(F.min("v").alias("v")).withColumn("way", F.monotonically_increasing_id()), "directions")
    by_word = Window.partitionBy("way").orderBy("word")
    words = entries.select("word", "_key").join(ways.select("_key", "way"), "_key").select("way", "word").withColumn(
        "_r", F.row_number().over(by_word)).where(F.col("_r") <= most + 1).drop("_r")
    asked = staged(directed(queries, "query"), "asked")
    points = staged(asked.groupBy("_key").agg(F.min("v").alias("v")).withColumn("point", F.monotonically_increasing_id()), "points")
    near = knn(points, ways, most + 1, q_id="point", r_id="way", x_col="v", ties=True).select(
        F.col("qid").alias("point"), F.col("rid").alias("way"))
    cosine = near.join(points.select("point", F.col("v").alias("a")), "point").join(ways.select("way", F.col("v").alias("b")), "way") \
        .select("point", "way", F.round(V.dot("a", "b"), digits).alias("cosine"))
    found = asked.select("query", "_key").join(points.select("_key", "point"), "_key").join(cosine, "point").join(words, "way")
    if excluded is not None:
        found = found.join(excluded, ["query", "word"], "left_anti")
    best = found.groupBy("query").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "word")).alias("b")).select(
        "query", "b.word", (-F.col("b.c")).alias("cosine"))
    return queries.select("query").distinct().join(best, "query", "left")
