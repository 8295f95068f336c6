"""ECOD (MDL-10, WIN-04): empirical-CDF outlier scores.

Per dimension, over the fitted population (train and test together, as the
scorer does at scoring time):

    O_l = -ln ECDF(v)          ECDF(v)  = #(x <= v) / n
    O_r = -ln ECDF_right(v)    ECDF_r(v) = #(x >= v) / n
    O_a = O_l if skew < 0 else O_r      (population skewness of the dimension)

    score = greatest(sum O_l, sum O_r, sum O_a)

Ranks need one range partitioning and no join on values: approximate quantiles cut each dimension into value
ranges, exact counts per range (a small table) give each range its offset, and a window inside a range ranks its rows.
A value that alone fills a range is a range of its own and needs no window, so a hot value is never in one task.
Fitted tables (``fit_ecdf``) can be written, and later rows ranked against them (``fitted_terms``).

A null or NaN component has no rank.  ``nulls="error"`` (default) stops with a message; with
``nulls="neutral"`` the component is left out of its dimension's ECDF and adds 0 to its row, which stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

TERMS = ("o_l", "o_r", "o_a")
CHUNK = 32  # range edges are searched in two steps of about this many


def value_ranges(long: DataFrame, keys, n_ranges: int | None = None) -> DataFrame:
    """One row per key: its edges (chunked), the edges that are hot values, its count and whether it is skewed to the left."""
    keys = list(keys)
    n = max(2, n_ranges or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col("v")
    at = F.percentile_approx(v, [i / n for i in range(1, n)], max(10000, 20 * n))
    per = long.where(v.isNotNull()).groupBy(*keys).agg(
        at.alias("_p"), F.count("*").alias("_n"), F.sum(v).alias("_s1"), F.sum(v * v).alias("_s2"), F.sum(v * v * v).alias("_s3"))
    mu = F.col("_s1") / F.col("_n")
    m3 = F.col("_s3") / F.col("_n") - 3 * mu * F.col("_s2") / F.col("_n") + 2 * mu * mu * mu
    edges = F.array_sort(F.array_distinct("_p"))
    per = per.select(*keys, "_n", (m3 < 0).alias("_neg"), "_p", edges.alias("_edges"))
    hot = F.filter("_edges", lambda e: F.size(F.filter("_p", lambda x: x == e)) > 1)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_edges") - 1) / CHUNK).cast("int")),
                         lambda i: F.slice("_edges", i * CHUNK + 1, CHUNK))
    per = per.select(*keys, "_n", "_neg", hot.alias("_hot"), chunks.alias("_chunks"))
    # the last chunk needs no top: a value above all others is in it
    tops = F.transform(F.slice("_chunks", F.lit(1), F.size("_chunks") - 1), lambda c: F.element_at(c, -1))
    return per.withColumn("_tops", tops)


def range_of(v: Column) -> Column:
    """The number of v's range, in order: even for a range, odd for a hot value; null for a null."""
    chunk = F.when(F.size("_tops") > 0, F.size(F.filter("_tops", lambda t: t < v))).otherwise(0)
    below = chunk * CHUNK + F.size(F.filter(F.get("_chunks", chunk), lambda e: e < v))
    return F.when(v.isNotNull(), 2 * below + F.array_contains("_hot", v).cast("int"))


def _in_ranges(long: DataFrame, ranges: DataFrame, keys) -> DataFrame:
    return long.join(ranges, keys, "left").withColumn("_range", range_of(F.col("v"))).drop("_hot", "_chunks", "_tops")


def _offsets(placed: DataFrame, keys) -> DataFrame:
    """(keys, range, value, before, in): rows of the lower ranges and of this one, and its value, which is the only one of a
    hot value's range; keys x ranges rows."""
    n = placed.where("_range is not null").groupBy(*keys, "_range").agg(F.count("*").alias("_in"), F.min("v").alias("_value"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return n.select(*keys, "_range", "_value", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))


def _terms(le: Column, lt: Column) -> list[Column]:
    """The three terms from the numbers of values up to and below v; 0 for a missing value."""
    left, right = -F.log(le / F.col("_n")), -F.log((F.col("_n") - lt) / F.col("_n"))
    both = (left, right, F.when(F.col("_neg"), left).otherwise(right))
    return [F.coalesce(t, F.lit(0.0)).alias(c) for c, t in zip(TERMS, both)]


def with_terms(long: DataFrame, keys, n_ranges: int | None = None) -> DataFrame:
    """The rows of ``long`` (keys, v, others) with the terms of v instead of v; rows without a value have zeros."""
    keys = list(keys)
    others = [c for c in long.columns if c not in (*keys, "v")]
    ranges = staged(value_ranges(long, keys, n_ranges), "value-ranges")
    placed = _in_ranges(long, ranges, keys)
    offsets = staged(_offsets(placed, keys), "range-offsets").drop("_value")
    at = placed.join(offsets, [*keys, "_range"], "left")
    single = at.where("_range is null or _range % 2 = 1")
    single = single.select(*keys, *others, *_terms(F.col("_before") + F.col("_in"), F.col("_before")))
    return single.unionByName(_spread_terms(at.where("_range % 2 = 0"), keys, others))


def _spread_terms(spread: DataFrame, keys, others) -> DataFrame:
    """The terms of rows whose range holds several values, by one window inside each range."""
    order = Window.partitionBy(*keys, "_range").orderBy("v")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spread = spread.withColumns({"_le": F.count("*").over(upto), "_lt": F.rank().over(order) - 1})
    return spread.select(*keys, *others, *_terms(F.col("_before") + F.col("_le"), F.col("_before") + F.col("_lt")))


def _checked(v, nulls: str):
    """The value; null where it is missing and may be."""
    missing = v.isNull() | F.isnan(v)
    if nulls == "neutral":
        return F.when(~missing, v)
    return F.when(missing, F.raise_error(F.lit("a component is missing; pass nulls='neutral' to keep such rows"))).otherwise(v)


def ecod_long(df: DataFrame, id_cols=("row_id",), x_col: str = "x", group_cols=(), nulls: str = "error") -> DataFrame:
    """ECOD over array vectors.  Returns (group..., id..., dim, o_l, o_r, o_a)
    per (row, dimension), so any subspace sum can be taken from it."""
    g, ids = list(group_cols), list(id_cols)
    long = df.select(*g, *ids, F.posexplode(x_col).alias("dim", "v")).withColumn("v", _checked(F.col("v").cast("double"), nulls))
    return with_terms(long, [*g, "dim"]).select(*g, *ids, "dim", *TERMS)


def _greatest(rows, by, out_col: str) -> DataFrame:
    s = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in TERMS])
    return s.select(*by, F.greatest(*TERMS).alias(out_col))


def ecod_scores(df: DataFrame, id_cols=("row_id",), x_col: str = "x", group_cols=(),
                out_col: str = "score", nulls: str = "error") -> DataFrame:
    """Full-space ECOD score per row."""
    g, ids = list(group_cols), list(id_cols)
    return _greatest(ecod_long(df, ids, x_col, g, nulls), [*g, *ids], out_col)


def ecod_subspace_scores(o_long: DataFrame, masks_long: DataFrame, id_cols=("row_id",),
                         group_cols=(), out_col: str = "score") -> DataFrame:
    """MDL-19 for ECOD: the score on every masked view in one job.  The ECDF of a
    dimension does not depend on which other dimensions are kept, so each
    subspace score is the greatest of the three sums over its own dimensions.
    ``masks_long`` is (subspace_id, dim) for the kept dimensions (small)."""
    j = o_long.join(masks_long.select("subspace_id", "dim"), "dim")
    return _greatest(j, [*group_cols, "subspace_id", *id_cols], out_col)


def ecod_columns(df: DataFrame, cols, out_col: str = "score", keep=(), nulls: str = "error") -> DataFrame:
    """ECOD over plain numeric columns of a table that has no row id.  Hot values get their terms from a bounded table.
    If one column has other values too, they are ranked with their rows; if several have, rows get a number when they are written
    once, their values are unpivoted and ranked, and the sums join them by the number."""
    cols = list(cols)

    def values(names):
        return F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)])

    long = df.select(F.explode(values(cols)).alias("t")).select("t.dim", _checked(F.col("t.v"), nulls).alias("v"))
    ranges = staged(value_ranges(long, ["dim"]), "value-ranges")
    offsets = staged(_offsets(_in_ranges(long, ranges, ["dim"]), ["dim"]), "range-offsets")
    hot = staged(offsets.where("_range % 2 = 1").join(ranges.select("dim", "_n", "_neg"), "dim").select(
        "dim", "_value", *_terms(F.col("_before") + F.col("_in"), F.col("_before"))), "hot-values")
    # the columns that have values outside the hot ones: as many numbers as columns
    spread = sorted(r["dim"] for r in offsets.where("_range % 2 = 0").select("dim").distinct().collect())
    wide = df.select(F.struct(*keep, *cols).alias("_row"))
    for i, c in enumerate(cols):
        own = hot.where(F.col("dim") == i).select(F.col("_value").alias(f"_v{i}"), *[F.col(t).alias(f"_{t}{i}") for t in TERMS])
        # a column has fewer hot values than ranges, so this side is bounded
        wide = wide.join(F.broadcast(own), F.col(f"_row.{c}").cast("double") == F.col(f"_v{i}"), "left")
    at_once = [sum((F.coalesce(F.col(f"_{t}{i}"), F.lit(0.0)) for i in range(len(cols))), F.lit(0.0)).alias(f"_s{t}") for t in TERMS]
    left = F.array(*[F.struct(F.lit(i).alias("dim"), F.when(F.col(f"_v{i}").isNull() & ~F.isnan(F.col(f"_row.{cols[i]}").cast("double")),
                                                         F.col(f"_row.{cols[i]}").cast("double")).alias("v")) for i in spread])
    wide = wide.select("_row", *at_once, left.alias("_left"))
    sums = [f"_s{t}" for t in TERMS]

    def ranked(rows, others):
        """Terms of (dim, v); 0 for a value that is missing or already taken."""
        placed = _in_ranges(rows, ranges, ["dim"])
        none = placed.where("_range is null").select("dim", *others, *[F.lit(0.0).alias(t) for t in TERMS])
        some = placed.where("_range is not null").join(offsets.select("dim", "_range", "_before"), ["dim", "_range"])
        return none.unionByName(_spread_terms(some, ["dim"], others))

    if len(spread) > 1:  # several values of a row are ranked apart and come back to it by its number
        wide = staged(wide.withColumn("_rid", F.monotonically_increasing_id()), "numbered-rows")
        each = ranked(wide.select("_rid", F.explode("_left").alias("t")).select("_rid", "t.dim", "t.v").where("v is not null"), ["_rid"])
        wide = wide.join(each.groupBy("_rid").agg(*[F.sum(t).alias(t) for t in TERMS]), "_rid", "left")
    elif spread:  # a row's only one takes the row along
        wide = ranked(wide.select("_row", *sums, F.explode("_left").alias("t")).select("_row", *sums, "t.dim", "t.v"), ["_row", *sums])
    else:
        wide = wide.select("*", *[F.lit(0.0).alias(t) for t in TERMS])
    total = [F.col(f"_s{t}") + F.coalesce(F.col(t), F.lit(0.0)) for t in TERMS]
    return wide.select(*[F.col(f"_row.{c}").alias(c) for c in (*keep, *cols)], F.greatest(*total).alias(out_col))


# ---------------------------------------------------------------- many overlapping populations at once
RANGE_ROWS = 20_000  # rows of a value range that are ranked together


def ecod_cells(df: DataFrame, pattern: Column, members: np.ndarray, shown: np.ndarray, id_col: str = "row_id",
               x_col: str = "x") -> DataFrame:
    """ECOD in many populations that share rows, such as the datasets and runs of a grid: a value is cut into its range and
    sorted once, and its rank in every population is a running count of members.

    ``pattern`` numbers a row's memberships: a row of pattern p is in population (family, member) if
    ``members[p, family, member]``, and gets terms in a family's populations if ``shown[p, family]``.  Returns (id, family,
    member, o_l, o_r, o_a) with one array over the dimensions per term; NaN where the id has no such dimension.  Rows of one
    id add up.  Shuffled are the values once and the shown terms once.  A missing component stops the job."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    members, shown = np.ascontiguousarray(members, np.int64), np.asarray(shown, bool)
    n_patterns, families, n_members = members.shape
    cells = members.reshape(n_patterns, -1)
    rows = df.select(F.col(id_col).alias("_id"), pattern.cast("int").alias("_pattern"),
                     F.transform(F.col(x_col).cast("array<double>"), lambda v: _checked(v, "error")).alias("_x"))
    n = max(2, math.ceil(df.count() / RANGE_ROWS))
    # d x n numbers reach the driver
    cuts = rows.select(F.posexplode("_x").alias("dim", "v")).groupBy("dim").agg(
        F.percentile_approx("v", [i / n for i in range(1, n)], max(10000, 20 * n)).alias("p")).collect()
    width = 1 + max((r["dim"] for r in cuts), default=-1)
    edges: dict = {}
    for r in cuts:
        at, times = np.unique(np.array(r["p"]), return_counts=True)
        edges[r["dim"]] = at, times > 1
    sent = spark.sparkContext.broadcast(edges)

    def cut(batches):
        """Every value with its dimension and range: even for a range, odd for a hot value."""
        for b in batches:
            ids, pat, x = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            length = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            v, row = x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length)
            dim = np.arange(len(v)) - np.repeat(np.cumsum(length) - length, length)
            order = np.argsort(dim, kind="stable")
            v, row, dim, place = v[order], row[order], dim[order], np.zeros(len(v), np.int64)
            for k, a, z in _runs(dim):
                at, hot = sent.value[k]
                below = np.searchsorted(at, v[a:z])
                same = np.minimum(below, len(at) - 1)
                place[a:z] = 2 * below + (hot[same] & (at[same] == v[a:z]))
            for a in range(0, len(v), 65536):
                s = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[s])), pa.array(pat[row[s]], pa.int32()), pa.array(dim[s], pa.int32()),
                                                  pa.array(place[s], pa.int32()), pa.array(v[s])], names=["_id", "_pattern", "_dim", "_range", "_v"])

    long = rows.mapInArrow(cut, f"_id {kind}, _pattern int, _dim int, _range int, _v double")
    v = F.col("_v")
    counted = long.groupBy("_dim", "_range", "_pattern").agg(
        F.count("*").alias("_n"), F.sum(v).alias("_s1"), F.sum(v * v).alias("_s2"), F.sum(v * v * v).alias("_s3"))

    def below(t):
        """Of one dimension, per range: members in lower ranges and in this one, in all, and the sign of the skewness, by population."""
        at, which = np.unique(t["_range"].to_numpy(), return_inverse=True)
        pat = t["_pattern"].to_numpy()
        inside = np.zeros((len(at), n_patterns), np.int64)
        np.add.at(inside, (which, pat), t["_n"].to_numpy())
        inside = inside @ cells
        total = inside.sum(0)
        m1, m2, m3 = (np.bincount(pat, t[c].to_numpy(), n_patterns) @ cells / np.maximum(total, 1) for c in ("_s1", "_s2", "_s3"))
        neg = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1 < 0).astype(np.int64)
        facts = np.stack((np.cumsum(inside, 0) - inside, inside, np.broadcast_to(total, inside.shape), np.broadcast_to(neg, inside.shape)), 1)
        return pa.table({"_dim": pa.array([t["_dim"][0].as_py()] * len(at), pa.int32()), "_range": pa.array(at, pa.int32()),
                         "_facts": pa.array([f.tobytes() for f in facts], pa.binary())})

    facts = staged(counted.groupBy("_dim").applyInArrow(below, "_dim int, _range int, _facts binary"), "range-facts")
    schema = f"_id {kind}, _family int, _dim int, _terms binary"

    def terms(ids, dim, pat, le, lt, total, neg):
        """Rows of the families that show them; counts, totals and signs are rows x populations."""
        parts = []
        for f in range(families):
            own, s = np.nonzero(shown[pat, f])[0], slice(f * n_members, (f + 1) * n_members)
            n_all = total[own, s]
            left, right = -np.log(le[own, s] / n_all), -np.log((n_all - lt[own, s]) / n_all)
            both = np.stack((left, right, np.where(neg[own, s], left, right)), 1)
            parts.append(pa.table({"_id": ids.take(pa.array(own)), "_family": pa.array(np.full(len(own), f, np.int32)),
                                   "_dim": pa.array(dim[own], pa.int32()), "_terms": _fixed(both)}))
        return pa.concat_tables(parts)

    def ranked(t, own):
        """One range of one dimension, sorted once."""
        if not len(t):
            return pa.table({"_id": t["_id"], "_family": t["_dim"], "_dim": t["_dim"], "_terms": pa.array([], pa.binary())})
        before, _, total, neg = np.frombuffer(own["_facts"][0].as_py(), np.int64).reshape(4, -1)
        order = np.argsort(t["_v"].to_numpy(), kind="stable")
        value, pat = t["_v"].to_numpy()[order], t["_pattern"].to_numpy()[order]
        upto = np.vstack((np.zeros((1, cells.shape[1]), np.int64), np.cumsum(cells[pat], 0))) + before
        le, lt = upto[np.searchsorted(value, value, "right")], upto[np.searchsorted(value, value, "left")]
        return terms(t["_id"].combine_chunks().take(pa.array(order)), t["_dim"].to_numpy()[order], pat, le, lt,
                     np.broadcast_to(total, le.shape), np.broadcast_to(neg, le.shape))

    def single(batches):
        """Rows of hot values, whose counts are those of their range."""
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                c = b.slice(a, 4096)
                before, inside, total, neg = _matrix(c.column(3), np.int64).reshape(c.num_rows, 4, -1).transpose(1, 0, 2)
                yield from terms(c.column(0), c.column(1).to_numpy(), c.column(2).to_numpy(), before + inside, before, total, neg).to_batches()

    spread = long.where("_range % 2 = 0").groupBy("_dim", "_range").cogroup(
        facts.where("_range % 2 = 0").groupBy("_dim", "_range")).applyInArrow(ranked, schema)
    hot = long.where("_range % 2 = 1").join(facts, ["_dim", "_range"]).select("_id", "_dim", "_pattern", "_facts").mapInArrow(single, schema)

    def gathered(batches):
        """Rows sorted by id and family become one row per population, with arrays over the dimensions."""
        held = None  # the rows of the last id and family, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            keys = t.select(["_id", "_family"]).combine_chunks()
            new = np.ones(len(t), bool)
            if len(t) > 1:
                new[1:] = pc.or_(*[pc.not_equal(keys[c].slice(1), keys[c].slice(0, len(t) - 1)) for c in ("_id", "_family")]).to_numpy()
            last = len(t) - 1 - int(np.argmax(new[::-1]))
            if last:
                yield from _gather(t.slice(0, last), new[:last], width, n_members)
            held = t.slice(last)
        if held is not None and len(held):
            new = np.zeros(len(held), bool)
            new[0] = True
            yield from _gather(held, new, width, n_members)

    out = spread.unionByName(hot).where("_id is not null").repartition("_id", "_family").sortWithinPartitions("_id", "_family")
    out = out.mapInArrow(gathered, f"_id {kind}, family int, member int, {', '.join(f'{c} array<double>' for c in TERMS)}")
    return out.withColumnRenamed("_id", id_col)


def _runs(sorted_keys: np.ndarray):
    """(key, start, end) of the runs of equal keys."""
    if len(sorted_keys):
        at = np.concatenate(([0], np.nonzero(np.diff(sorted_keys))[0] + 1, [len(sorted_keys)]))
        yield from zip(sorted_keys[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist())


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of one width as a binary column."""
    size = rows[0].nbytes if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(rows.tobytes())])


def _matrix(column, kind) -> np.ndarray:
    """A binary column whose values have one length, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _gather(t, new: np.ndarray, width: int, n_members: int):
    """One row per (id, family) and member: the terms at their dimensions; rows of one dimension add up."""
    starts = np.nonzero(new)[0]
    group, dim, terms = np.cumsum(new) - 1, t["_dim"].to_numpy(), _matrix(t["_terms"], np.float64)
    at = np.arange(0, len(starts), max(1, 2_000_000 // max(1, width * 3 * n_members)))
    for a, z in zip(at, [*at[1:], len(starts)]):
        s = slice(starts[a], starts[z] if z < len(starts) else len(t))
        sums, seen = np.zeros((z - a, width, 3 * n_members)), np.zeros((z - a, width), bool)
        np.add.at(sums, (group[s] - a, dim[s]), terms[s])
        seen[group[s] - a, dim[s]] = True
        sums[~seen] = np.nan
        each = sums.reshape(z - a, width, 3, n_members).transpose(2, 0, 3, 1)  # term, id, member, dimension
        own = t.take(pa.array(np.repeat(starts[a:z], n_members)))
        flat = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64())) for x in each]
        yield pa.RecordBatch.from_arrays([own["_id"].combine_chunks(), own["_family"].combine_chunks(),
                                          pa.array(np.tile(np.arange(n_members, dtype=np.int32), z - a)), *flat],
                                         names=["_id", "family", "member", *TERMS])


def ecod_view_scores(rows: DataFrame, views, id_cols=("row_id",), group_cols=(), out_col: str = "score") -> DataFrame:
    """MDL-19 over gathered terms (one array per term and row, as of ``ecod_cells``): (group..., subspace_id, id..., score) of
    every (subspace_id, mask) of ``views``, the greatest of the three sums over the mask's dimensions.  Nothing is shuffled.
    A row that has none of a mask's dimensions has no score on it."""
    keys = [(s, np.array([u == 1 for u in mask], np.float64)) for s, mask in views]

    @F.arrow_udf("array<double>")
    def scores(left: pa.Array, right: pa.Array, skewed: pa.Array) -> pa.Array:
        three = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (left, right, skewed)]
        d = three[0].shape[1]
        kept = np.array([np.pad(m[:d], (0, max(0, d - len(m)))) for _, m in keys]).reshape(len(keys), d).T
        some = ~np.isnan(three[0])
        best = np.max([np.where(some, x, 0.0) @ kept for x in three], 0)
        flat = pa.array(best.ravel(), mask=(some @ kept == 0).ravel())
        return pa.FixedSizeListArray.from_arrays(flat, len(keys)).cast(pa.list_(pa.float64()))

    ids = F.array(*[F.lit(s) for s, _ in keys])
    out = rows.select(*group_cols, *id_cols, F.posexplode(scores(*TERMS)).alias("_at", out_col)).where(F.col(out_col).isNotNull())
    return out.select(*group_cols, F.get(ids, F.col("_at")).alias("subspace_id"), *id_cols, out_col)


# ---------------------------------------------------------------- a fitted table and rows that come later
def fit_ecdf(df: DataFrame, x_col: str = "x", nulls: str = "error") -> tuple[DataFrame, DataFrame]:
    """(ranges, values): per dimension its ranges with their counts, and its distinct values with the numbers of
    values up to and below them."""
    long = df.select(F.posexplode(x_col).alias("dim", "v")).withColumn("v", _checked(F.col("v").cast("double"), nulls)).where("v is not null")
    ranges = staged(value_ranges(long, ["dim"]), "value-ranges")
    distinct = staged(_in_ranges(long, ranges, ["dim"]).groupBy("dim", "_range", "v").agg(F.count("*").alias("_c")), "fitted-values")
    inside = distinct.groupBy("dim", "_range").agg(F.sum("_c").alias("_in"))
    before = Window.partitionBy("dim").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(inside.select("dim", "_range", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before")), "range-offsets")
    upto = Window.partitionBy("dim", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = distinct.join(offsets, ["dim", "_range"]).withColumn("_le", F.col("_before") + F.sum("_c").over(upto)) \
        .select("dim", "_range", "v", "_le", (F.col("_le") - F.col("_c")).alias("_lt"))
    starts = offsets.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("_range", "_before", "_in"))).alias("_starts"))
    return ranges.join(starts, "dim"), values


def fitted_terms(df: DataFrame, ranges: DataFrame, values: DataFrame, id_cols=("row_id",), x_col: str = "x",
                 nulls: str = "error") -> DataFrame:
    """(id..., dim, o_l, o_r, o_a) of rows ranked among the fitted values, which they don't change.  A value outside the
    fitted ones counts one value on its far side."""
    ids = list(id_cols)
    long = df.select(F.struct(*ids).alias("_ids"), F.posexplode(x_col).alias("dim", "v")).withColumn("v", _checked(F.col("v").cast("double"), nulls))
    new = long.join(ranges, "dim", "left").withColumn("_range", range_of(F.col("v")))
    # values of the ranges below; a hot value's own range holds it alone
    lower = F.aggregate("_starts", F.lit(0).cast("long"), lambda a, e: F.when(e["_range"] < F.col("_range"), e["_before"] + e["_in"]).otherwise(a))
    same = F.aggregate("_starts", F.lit(0).cast("long"), lambda a, e: F.when(e["_range"] == F.col("_range"), e["_in"]).otherwise(a))
    new = new.select("dim", "_range", "v", "_ids", "_n", "_neg", lower.alias("_lower"), same.alias("_same"), F.lit(True).alias("_new"))

    def scored(rows, le, lt):
        le, lt = F.greatest(le, F.lit(1)), F.least(lt, F.col("_n") - 1)
        return rows.select(*[F.col(f"_ids.{c}").alias(c) for c in ids], "dim",
                           *_terms(F.when(F.col("v").isNotNull(), le), F.when(F.col("v").isNotNull(), lt)))

    single = scored(new.where("_range is null or _range % 2 = 1"), F.col("_lower") + F.col("_same"), F.col("_lower"))
    old = values.where("_range % 2 = 0").select("dim", "_range", "v", F.struct("v", "_le", "_lt").alias("_at"), F.lit(False).alias("_new"))
    both = new.where("_range % 2 = 0").unionByName(old, allowMissingColumns=True)
    upto = Window.partitionBy("dim", "_range").orderBy("v", "_new").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_at", F.last("_at", ignorenulls=True).over(upto)).where("_new")
    le = F.coalesce("_at._le", "_lower")
    return single.unionByName(scored(both, le, F.when(F.col("_at.v") == F.col("v"), F.col("_at._lt")).otherwise(le)))
