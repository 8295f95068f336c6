"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

Templates are (licence, text) rows, several forms a licence: full texts, the notices recommended for headers, titles of long
licences, one-line forms and identifiers.  Passages of a text are, from every line with an anchor word on, the next 1, 2, 3, 5, ...
lines (``WINDOWS``, as many as are left), the single sentences of that line, and the whole text of a file with a licence file's
name.  Every template has an anchor word.  Weights are tf * idf, with idf over the licences; words in no template weigh 1, like words
in all of them.  A file takes the licence of highest cosine over its passages, if that reaches ``threshold``; ties go to the
smaller name.

1. One pattern over whole texts finds the lines with an anchor; other texts go no further.
2. Passages become (passage, word, tf) rows and meet the template weights by word.  Templates are a given, fixed
   list of a few thousand words, so that side is a broadcast.
3. A directory has the licence of the licence files (or, if there are none,
   of the headers) in it that occurs most often; a file without one inherits from the nearest ancestor
   directory that has one, by equi-joins of each distinct directory's ancestors.  Files then meet their directory's result,
   which is one row per directory, so AQE may split a hot directory.

Files are told apart by the key that the caller gives; it may repeat for files of the same text only.

Edge cases: null texts and paths count as empty; empty texts match nothing; rows that repeat are
each returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, stage_table, text_of
from .license_templates import TEMPLATES

WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z0-9]+)?$"
ANCHORS = ("licensed", "license", "licence", "released", "permission", "redistribution", "redistribute", "warranty", "unencumbered", "reserved")
ANCHOR = "(?i)(?:^|[^a-z0-9])(?:" + "|".join(ANCHORS) + ")(?:$|[^a-z0-9])"
WINDOWS = (1, 2, 3, 5, 8, 13, 21, 34)


def weigh(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, dict[str, float]]], dict[str, float]]:
    """(licence and unit vector of each template, idf per word)."""
    words = [(name, re.findall(WORD, text.lower())) for name, text in templates]
    held: dict[str, set] = {}
    for name, ws in words:
        for w in ws:
            held.setdefault(w, set()).add(name)
    n = len({name for name, _ in templates})
    idf = {w: math.log((1 + n) / (1 + len(names))) + 1 for w, names in held.items()}
    vectors = []
    for name, ws in words:
        v = {w: ws.count(w) * idf[w] for w in ws}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {w: x / norm for w, x in v.items()}))
    return vectors, idf


def passages(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(file, whole, pos, kind, passage): the passages to compare; kind is a window's lines, or below 0 a sentence's number."""
    own = files.select(F.col(key).alias("file"), F.coalesce(path, F.lit("")).rlike(LICENCE_FILE).alias("whole"),
                       text_of(text).alias("text")).where(F.col("text").rlike(ANCHOR))
    lines = own.select("file", "whole", F.split("text", "\n", -1).alias("lines"),
                       F.when(F.col("whole"), F.col("text")).alias("all"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(ANCHOR))
    each = lines.select("file", "whole", "all", F.posexplode(F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.slice("lines", i + 1, WINDOWS[-1]).alias("next")))).alias("nth", "t"))
    size, nexts = F.size("t.next"), F.col("t.next")
    before = {w: v for v, w in zip((0, *WINDOWS), WINDOWS)}
    windows = [F.when((size >= w) | (size > before[w]), F.struct(F.lit(w).alias("kind"), F.array_join(F.slice(nexts, 1, w), "\n").alias("p")))
               for w in WINDOWS]
    parts = F.split(F.regexp_replace(F.get(nexts, F.lit(0)), "([.!?])[ \t]+", "$1\n"), "\n", -1)
    sentences = F.when(F.size(parts) > 1, F.transform(parts, lambda p, i: F.struct((-1 - i).alias("kind"), p.alias("p"))))
    whole = F.when((F.col("nth") == 0) & F.col("whole"), F.array(F.struct(F.lit(0).alias("kind"), F.col("all").alias("p"))))
    none = F.array().cast("array<struct<kind:int,p:string>>")
    kinds = F.concat(F.filter(F.array(*windows), lambda w: w.isNotNull()), F.coalesce(sentences, none), F.coalesce(whole, none))
    return each.select("file", "whole", F.col("t.at").alias("pos"), F.explode(kinds).alias("k")).select(
        "file", "whole", "pos", "k.kind", F.col("k.p").alias("passage"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, key: str = "key", path: str = "path",
         text: str = "text") -> DataFrame:
    """(file, license, score, whole) of the files with a passage that matches; whole: it has a licence file's name."""
    vectors, idf = weigh(templates)
    spark = files.sparkSession
    by = ["file", "whole", "pos", "kind"]
    words = (passages(files, key, path, text)
             .select(*by, F.explode(F.regexp_extract_all(lower_ascii(F.col("passage")), F.lit(f"({WORD})"))).alias("word"))
             .groupBy(*by, "word").agg(F.count("*").alias("tf")))
    weights = spark.createDataFrame(list(idf.items()), "word string, idf double")
    rows = spark.createDataFrame([(t, name, w, x) for t, (name, v) in enumerate(vectors) for w, x in v.items()],
                                 "template int, license string, word string, weight double")
    # both are the templates' words: a fixed list given by the caller
    weighted = words.join(F.broadcast(weights), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    unit = weighted.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by))))
    scores = (unit.join(F.broadcast(rows), "word").groupBy(*by, "template", "license", "norm")
              .agg((F.sum(F.col("x") * F.col("weight"))).alias("dot"))
              .withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold))
    return (scores.groupBy("file", "whole").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("license"))).alias("best"))
            .select("file", "best.license", (-F.col("best.neg")).alias("score"), "whole"))


def parent_of(path):
    """The directory of a path; the root is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherit(files: DataFrame, found: DataFrame, key: str = "key", path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, the columns to keep, license, score, origin, from_dir): origin is 'own', 'inherited' or 'none'."""
    placed = files.select(F.col(key).alias("file"), *keep, parent_of(F.coalesce(path, F.lit(""))).alias("dir"))
    own = placed.join(found, "file", "left")
    votes = own.where("license is not null").groupBy("dir", "whole", "license").agg(F.count("*").alias("n"))
    by_dir = stage_table(votes.groupBy("dir").agg(F.min(F.struct((~F.col("whole")).alias("headers"), (-F.col("n")).alias("neg"), "license")).alias("b"))
                         .select(F.col("dir").alias("of"), F.col("b.license").alias("dir_license")), "directories")
    parts = F.split("dir", "/")
    above = (placed.select("dir").distinct()
             .select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"))
             .select("dir", "depth", F.when(F.col("depth") == 0, "").otherwise(
                 F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).alias("ancestor")))
    nearest = stage_table(above.join(by_dir, F.col("ancestor") == F.col("of"))
                          .groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("n"))
                          .select("dir", F.col("n.ancestor").alias("near"), F.col("n.dir_license").alias("near_license")), "nearest")
    return own.join(nearest, "dir", "left").select(
        "file", *keep, F.coalesce("license", "near_license").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("near_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("near")).alias("from_dir"))
