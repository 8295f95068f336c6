"""Round trips of the packer and the fast encoder."""
import random
import zlib

import numpy as np
import pytest

from maskfold.llm.packing import Packer, TextIds, balance, pack

P = pytest.importorskip("public_tokenizers")
FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ODD = ["", " ", "a  b", "  a   b", "x <|endoftext|> y\n z", "a<|endoftext|>b  c", "é  \t q ", " lead", "tail ", "a\x1c b", "it's we 've  ",
       "\n\n \n x", "١٢ 3", "日本 x ſ ŉ ²³ ½ _", "a  b  c", "Straße weiß\r\n ja", "x" * 5000 + " " * 50 + "y"]


def ids(texts):
    t = TextIds(FILES[0]).tokenizer
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("files", [FILES, FILES[:1]])
def test_both_encoders_agree(files):
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice(["ab", " ", "c.", "\n", "é", "1", "  ", "'s", "\t"]) for _ in range(80)) for _ in range(200)]
    latin = [chr(c) for c in range(0x250)]
    texts += ["".join(draw.choices(latin, k=40)) for _ in range(3000)]
    encoder = TextIds(*files)
    assert encoder.documents(texts) == ids(texts)


@pytest.mark.parametrize("flush", [1, 5000, 10**9])
def test_packer_covers_all_without_padding(flush):
    draw = random.Random(1)
    sizes = [draw.choice([1, 3, 300, 700, 1024, 5000, draw.randint(1, 1500)]) for _ in range(300)]
    p = Packer(flush_tokens=flush)
    for i, n in enumerate(sizes):
        p.add(i, n)
    p.flush(last=True)
    covered = {}
    for tier, pieces in p.take():
        assert sum(n for _, _, n in pieces) == tier <= 1024 and tier & (tier - 1) == 0
        for doc, start, n in pieces:
            covered.setdefault(doc, []).append((start, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == n


def test_pack(edge, empty, spark):
    rows, docs = edge
    got = pack(docs, *FILES).collect()
    sequences, documents = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        documents.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p[1] for p in parts) == parts[0][2]
    for (i, text, _), tokens in zip(rows, ids([t or "" for _, t, _ in rows])):
        if i == 13:  # given twice
            continue
        joined = b"".join(b for _, b, _ in sorted(documents[i]))
        assert joined == tokens + bytes(4) and zlib.crc32(joined) and all(n == len(joined) // 4 for *_, n in documents[i])
    assert pack(empty, *FILES).count() == 0


def test_short_step_groups_do_not_grow_with_the_tasks(make_docs, tmp_path, spark):
    """Of each tier, all step groups but one hold as many tokens as a step, however many tasks packed."""
    docs = make_docs([(i, "word " * (50 + 37 * i % 900), "a") for i in range(300)])
    short = {}
    for tasks in (2, 16):
        at = str(tmp_path / str(tasks))
        pack(docs.repartition(tasks), *FILES).write.parquet(at)
        got = balance(spark.read.parquet(at), step_tokens=4096)
        sums = got.groupBy("tier", "step_group").sum("length").collect()
        assert sum(r[2] for r in sums) == spark.read.parquet(at).groupBy().sum("length").first()[0]
        assert len({r.step_group for r in sums}) == len(sums) and all(r[2] <= 4096 for r in sums)
        short[tasks] = {t: sum(r[2] < 4096 for r in sums if r.tier == t) for t in {r.tier for r in sums}}
    assert all(n <= 1 for by in short.values() for n in by.values())
