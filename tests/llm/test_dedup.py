"""Exact and line dedup against brute force."""
import hashlib
import re
from collections import defaultdict

from maskfold.llm.exact_dedup import exact_dedup
from maskfold.llm.line_dedup import line_dedup

LAST = 2**63 - 1


def test_exact_dedup(edge, empty):
    rows, docs = edge
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), LAST if i is None else i, i))
    want = []
    for content, members in groups.items():
        members.sort(key=lambda m: m[:2])
        want += [(i, members[0][2], len(members), k == 0, hashlib.sha256(content.encode()).hexdigest())
                 for k, (_, _, i) in enumerate(members)]
    got = [(r.id, r.keep_id, r.group_size, r.kept, r.sha) for r in exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup(empty).count() == 0


def test_one_row_stays_of_rows_that_repeat_in_full(make_docs):
    rows = [(1, "a b", "x")] * 3 + [(2, "ab", "x"), (None, "q", "x"), (None, "q", "x"), (3, "", "x"), (3, None, "x")]
    got = exact_dedup(make_docs(rows)).collect()
    kept = [r for r in got if r.kept]
    assert sorted((str(r.keep_id), r.group_size) for r in kept) == [("1", 4), ("3", 2), ("None", 2)] and len(got) == 8
    assert all(r.id == r.keep_id for r in kept)


def brute_lines(rows, min_docs=2):
    holders = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    rows = [(LAST if i is None else i, t or "") for i, t, _ in rows]
    for i, t in rows:
        for line in t.split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or i == min(holders[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_line_dedup(edge, empty):
    rows, docs = edge
    for min_docs in (2, 3):
        got = line_dedup(docs, min_docs=min_docs)
        assert got.columns[:-2] == docs.columns
        found = sorted((LAST if r.doc_id is None else r.doc_id, r.text, r["__n_lines"], r["__n_dropped"])
                       for r in got.collect())
        assert found == brute_lines(rows, min_docs)
    assert line_dedup(empty).count() == 0


def test_one_long_document_of_equal_lines(make_docs):
    text = "\n".join(["the same line again"] * 5000 + [f"own line number {i}" for i in range(500)])
    rows = [(5, text, "a"), (2, "the same line again", "a")]
    got = {r.doc_id: r for r in line_dedup(make_docs(rows)).collect()}
    assert got[5]["__n_dropped"] == 5000 and got[5].text.count("\n") == 499 and got[2]["__n_dropped"] == 0
