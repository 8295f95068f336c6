"""Registered queries of this sub-package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskfold.sources.tables import table

from .common import stage_table, text_of
from .chat_format import preference_format, with_altered_answers
from .conversation_repair import damage, repair, rows_of
from .exact_dedup import exact_dedup
from .hnsw import nearest
from .html_content import main_text
from .jaccard_join import jaccard_classes
from .license_scan import ANCHOR, TEMPLATES, WINDOWS, WORD, inherit, scan, weigh
from .line_dedup import line_dedup
from .mixing import mix
from .packing import balance, pack
from .token_counts import token_count
from .toxicity import fit_toxicity, held_out, toxicity_score
from .whitening import whitening

QUERIES: dict[str, tuple] = {}
LICENCE_FILES = 50  # every so manieth document of op1 has a licence file's name


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


@query("op4_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER (PARTITION BY content ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(content) AS text_sha256
FROM t
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


@query("op5_line_dedup", r"""
WITH l AS (
  SELECT doc_id, i, list_extract(ls, i) AS line,
         translate(trim(list_extract(ls, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (
  SELECT key, min(doc_id) AS first_id FROM l WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> k.first_id, false) AS dropped
  FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def tokenizer_files() -> dict:
    """The public byte-level vocabulary as tokenizer, as ranks, and its pre-tokenisation."""
    import public_tokenizers as tokenizers_of
    return {"tokenizer_file": tokenizers_of.path("byte_bpe_50k.json"),
            "ranks_file": tokenizers_of.path("byte_bpe_50k.tiktoken"), "pattern": tokenizers_of.PATTERN}


@query("op3_mixing", r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS hash, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         count(*) AS copies
  FROM documents GROUP BY ALL),
s AS (
  SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, sum(copies) AS n_rows,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER w AS j, sum(3 * source_size) OVER w - 3 * source_size AS caps,
         sum(weight) OVER w - weight AS weights, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
l AS (SELECT (total - caps)::DOUBLE / (all_weight - weights) AS level FROM o
      WHERE cap >= (total - caps)::DOUBLE / (all_weight - weights) * weight ORDER BY j LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
             greatest(1, ceil(source_size / 250000), ceil(n_rows / 5000))::BIGINT AS shards FROM o, l),
i AS (SELECT *, unnest(range((copies - 1) // per + 1)) AS piece
      FROM (SELECT *, greatest(1, least(5000, 250000 // greatest(size, 1))) AS per FROM d)),
q0 AS (SELECT i.*, least(per, copies - piece * per) AS held, t.source_size, t.target, t.shards,
              CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || hash || '|' || piece), 1, 15) AS BIGINT) AS draw
       FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, draw % shards AS shard,
         sum(size * held) OVER (PARTITION BY source, draw % shards ORDER BY draw, doc_id, hash, piece
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size * held AS before
  FROM q0),
h AS (
  SELECT source, shard, sum(size * held) AS shard_size,
         CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size * held)::DOUBLE / any_value(source_size) ELSE 0 END AS votes
  FROM p GROUP BY source, shard),
b AS (SELECT count(*) AS n, sum(votes) AS total, greatest(1, least(1024, sum(shard_size) // (1000 * count(*)))) AS block,
             sum(shard_size) // greatest(1, least(1024, sum(shard_size) // (1000 * count(*)))) AS blocks FROM h),
r AS (SELECT h.*, b.block, b.blocks, greatest(0, floor(votes * greatest(0, blocks - n / 2) / total + 0.5) - 1)::BIGINT AS sure,
             floor(votes * (blocks + n / 2 + 1) / total + 0.5)::BIGINT + 1 AS most FROM h, b),
c AS (SELECT source, shard, votes / (2 * k + 1) AS quotient
      FROM (SELECT source, shard, votes, unnest(range(sure, most)) AS k FROM r)),
g AS (SELECT source, shard, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, shard) AS place FROM c),
w AS (SELECT source, shard, count(*) AS won FROM g WHERE place <= (SELECT any_value(blocks) - sum(sure) FROM r) GROUP BY source, shard),
q AS (SELECT r.source, r.shard, shard_size, least((sure + coalesce(won, 0)) * block, 3 * shard_size) AS words
      FROM r LEFT JOIN w ON r.source IS NOT DISTINCT FROM w.source AND r.shard = w.shard)
SELECT doc_id, size, source_size, target, p.source,
       CAST(coalesce(words // nullif(shard_size, 0), 0) * size
            + greatest(0, least(size, words - coalesce(words // nullif(shard_size, 0), 0) * shard_size - (before + copy * size))) AS BIGINT) AS taken
FROM (SELECT *, unnest(range(held)) AS copy FROM p) p JOIN q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of the packed documents with a checksum instead of their ids, dealt to step groups."""
    pieces = pack(docs, **tokenizer_files()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return balance(stage_table(pieces, "pieces")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x, least(x, min(y)) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", main_text(pages).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0)).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _licence_sql() -> str:
    vectors, idf = weigh(TEMPLATES)
    weights = ", ".join(f"({t}, '{n}', '{w}', {x!r}::DOUBLE)" for t, (n, v) in enumerate(vectors) for w, x in v.items())
    idfs = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    windows = ", ".join(map(str, WINDOWS))
    return f"""
WITH tpl(template, license, word, weight) AS (VALUES {weights}),
idf(word, idf) AS (VALUES {idfs}),
f AS (SELECT doc_id, md5(coalesce(text, '')) AS hash, coalesce(source, '') || CASE WHEN coalesce(lang, 'en') = 'en' THEN '' ELSE '/' || lang END AS dir,
             coalesce(doc_id % {LICENCE_FILES} = 0, false) AS whole, coalesce(text, '') AS text FROM documents),
c AS (SELECT * FROM f WHERE regexp_matches(text, '{ANCHOR}')),
g AS (SELECT DISTINCT doc_id, hash, whole, text, string_split(text, chr(10)) AS ls FROM c),
a AS (SELECT * FROM (SELECT doc_id, hash, whole, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM g) WHERE regexp_matches(ls[i], '{ANCHOR}')),
pw AS (SELECT doc_id, hash, whole, i, w AS kind, array_to_string(ls[i:i + w - 1], chr(10)) AS p
       FROM a, (SELECT w, lag(w, 1, 0) OVER (ORDER BY w) AS less FROM (SELECT unnest([{windows}]) AS w)) WHERE len(ls) - i + 1 > less),
ps AS (SELECT doc_id, hash, whole, i, -unnest(range(1, len(s) + 1)) AS kind, unnest(s) AS p
       FROM (SELECT *, string_split(regexp_replace(ls[i], '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM a) WHERE len(s) > 1),
pa AS (SELECT doc_id, hash, whole, min(i) AS i, 0 AS kind, any_value(text) AS p FROM a WHERE whole GROUP BY doc_id, hash, whole),
w AS (SELECT doc_id, hash, i, kind, word, count(*) AS tf
      FROM (SELECT doc_id, hash, i, kind, unnest(regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS word FROM (FROM pw UNION ALL FROM ps UNION ALL FROM pa))
      GROUP BY ALL),
x AS (SELECT doc_id, hash, i, kind, w.word, tf * coalesce(idf, 1.0) AS x FROM w LEFT JOIN idf ON idf.word = w.word),
n AS (SELECT doc_id, hash, i, kind, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT x.doc_id, x.hash, x.i, x.kind, template, license, round(sum(x * weight) / any_value(norm), 9) AS score
      FROM x JOIN tpl ON tpl.word = x.word
      JOIN n ON n.doc_id IS NOT DISTINCT FROM x.doc_id AND n.hash = x.hash AND n.i = x.i AND n.kind = x.kind GROUP BY ALL),
b AS (SELECT doc_id, hash, license, score,
             row_number() OVER (PARTITION BY doc_id, hash ORDER BY score DESC, license) AS k FROM s WHERE score >= 0.8),
o AS (SELECT f.doc_id, f.dir, f.whole, b.license, b.score FROM f LEFT JOIN b ON b.doc_id IS NOT DISTINCT FROM f.doc_id AND b.hash = f.hash AND b.k = 1),
v AS (SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY whole DESC, count(*) DESC, license) AS k
      FROM o WHERE license IS NOT NULL GROUP BY dir, whole, license),
d AS (SELECT dir, license FROM v WHERE k = 1)
SELECT o.doc_id, coalesce(o.license, own.license, up.license) AS license, o.score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN own.license IS NOT NULL OR up.license IS NOT NULL THEN 'inherited'
            ELSE 'none' END AS origin,
       CASE WHEN o.license IS NULL THEN coalesce(own.dir, up.dir) END AS from_dir
FROM o LEFT JOIN d own ON own.dir = o.dir LEFT JOIN d up ON up.dir = split_part(o.dir, '/', 1) AND up.dir <> o.dir
"""


@query("op1_license_scan", _licence_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the file source/doc_id.txt, and source/lang/doc_id.txt in languages other than English; every
    LICENCE_FILES-th id is called LICENSE.doc_id there.  Files are told apart by id and text."""
    lang = F.coalesce("lang", F.lit("en"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("|", number, F.md5(text_of())).alias("key"), "text", F.concat(
            F.coalesce("source", F.lit("")), F.when(lang == "en", "/").otherwise(F.concat(F.lit("/"), lang, F.lit("/"))),
            F.when(F.col("doc_id") % LICENCE_FILES == 0, F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))).alias("path"))
    return inherit(files, scan(files), keep=("doc_id",)).drop("file")


@query("op2_chat_formatting", r"""
WITH r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT c, max(turn) AS last FROM r WHERE role = 'assistant' GROUP BY c),
an AS (SELECT xor(r.c, 1) AS c, max(text) AS other FROM r JOIN la ON la.c = r.c AND r.turn = la.last WHERE role = 'assistant' GROUP BY r.c),
t AS (
  SELECT DISTINCT 2 * c AS conv_id, turn, role, text FROM r
  UNION SELECT 2 * r.c + 1, turn, role, CASE WHEN role = 'assistant' AND turn = la.last THEN coalesce(an.other, '') ELSE text END
  FROM r LEFT JOIN la ON la.c = r.c LEFT JOIN an ON an.c = r.c),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown,
         CASE WHEN role = 'assistant' THEN '01' ELSE '00' END AS mask
  FROM t),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id // 2 AS pair, min(conv_id) AS x, max(conv_id) AS y FROM n GROUP BY 1 HAVING min(conv_id) <> max(conv_id)),
p AS (
  SELECT CASE WHEN ny.n > nx.n THEN y ELSE x END AS chosen, CASE WHEN ny.n > nx.n THEN x ELSE y END AS rejected
  FROM h JOIN n nx ON nx.conv_id = x JOIN n ny ON ny.conv_id = y),
c AS (
  SELECT p.chosen, p.rejected,
         coalesce(min(a.i) FILTER (WHERE b.i IS NULL OR a.role <> b.role OR a.text <> b.text) - 1, max(a.i))::INTEGER AS n_common
  FROM p JOIN o a ON a.conv_id = p.chosen LEFT JOIN o b ON b.conv_id = p.rejected AND b.i = a.i
  GROUP BY ALL)
SELECT c.chosen, c.rejected, c.n_common,
  (SELECT coalesce(string_agg(shown, '' ORDER BY i), '') FROM o WHERE conv_id = c.chosen AND i <= c.n_common) AS prompt,
  (SELECT coalesce(string_agg(shown, '' ORDER BY i), '') FROM o WHERE conv_id = c.chosen AND i > c.n_common) AS chosen_text,
  (SELECT coalesce(string_agg(mask, '' ORDER BY i), '') FROM o WHERE conv_id = c.chosen AND i > c.n_common) AS chosen_mask,
  (SELECT coalesce(string_agg(shown, '' ORDER BY i), '') FROM o WHERE conv_id = c.rejected AND i > c.n_common) AS rejected_text,
  (SELECT coalesce(string_agg(mask, '' ORDER BY i), '') FROM o WHERE conv_id = c.rejected AND i > c.n_common) AS rejected_mask
FROM c
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another last answer; the masks as one digit per segment of the completion."""
    out = preference_format(with_altered_answers(table(spark, sf_dir, "conversations")))
    digits = {f"{side}_mask": F.array_join(F.transform(f"{side}_segments", lambda s: s["mask"].cast("string")), "")
              for side in ("chosen", "rejected")}
    return out.withColumns(digits).select("chosen", "rejected", "n_common", "prompt", "chosen_text", "chosen_mask",
                                          "rejected_text", "rejected_mask")


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_of
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"),
        token_count(tokenizers_of.path("piece_bpe_32k.model")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where the exact sum is beyond a long; ``deviation_exact`` has its digits."""
    return whitening(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened", "explained", "identity_error", "deviation_exact", "residual")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(rows_of(table(spark, sf_dir, "conversations"))))
