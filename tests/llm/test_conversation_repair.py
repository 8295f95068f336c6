"""Repair of conversations against a search through all edits."""
import hashlib
import random
import re
import zlib

import pytest

from maskfold.llm.conversation_repair import COSTS, damage, repair, repaired, rows_of

WHITE = " \t\n\x0b\f\r"
FORM = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def search(rows, faults, costs):
    """(cost, audit, repaired rows) by trying every edit of every row; no state is shared between them."""
    best = []

    def go(i, cost, audit, out, inserts):
        shape = "".join(r[0][:1] or "?" for r in out)
        if (best and (cost, audit) > best[0][:2] and cost > best[0][0]) or not re.fullmatch("s?(ua)*u?", shape):
            return
        if i == len(rows) and FORM.fullmatch(shape):
            best.append((cost, audit, out))
            best.sort(key=lambda b: b[:2])
        if inserts < 3:
            for role in ("user", "assistant"):
                go(i, cost + costs["I"], audit + "I", [*out, (role, "")], inserts + 1)
        if i < len(rows):
            (_, role, text), fault = rows[i], faults[i]
            go(i + 1, cost + costs["D"], audit + "D", out, 0)
            if fault in ("", "truncated"):
                more = costs["truncated"] * (fault == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + costs["R"], audit + "R", [*out, (new, text)], 0)

    go(0, 0, "", [], 0)
    return best[0]


def expected(rows, costs):
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(WHITE)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = search(rows, faults, costs)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def made(seed, conversations, longest=6):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Hi.", "Hi.", "Well then", "", None, " \n", "Ok! ", "why?\t", "é.", "end.\x1c", "x"]
    rows = []
    for c in range(conversations):
        for t in range(draw.randint(1, longest)):
            turn = draw.choice([t, t, t, t + 2, None, 0])
            rows.append((c if c else None, turn, draw.choice(roles), draw.choice(texts)))
    return rows


def frame(spark, rows):
    from maskfold.session import ship_package
    ship_package(spark)
    extra = [(*r, "x", 1, False) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, key string, chunk int, present boolean") \
        .repartition(3)


def check(spark, rows, costs, spill, do_damage=True):
    price = COSTS | costs
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    turns = rows_of(frame(spark, rows))
    turns = damage(turns) if do_damage else turns
    report = repair(turns, costs, spill)
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    assert len(got) == len(by)
    texts = {}
    for r in sorted(repaired(turns, report).collect(), key=lambda r: r.position):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, own in by.items():
        now = damaged(own) if do_damage else sorted(
            [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in own],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want, out = expected(now, price)
        assert got[conv] == want, (conv, now)
        assert texts.get(conv, []) == out


@pytest.mark.parametrize("costs,spill", [({}, 1 << 16), ({}, 2), ({"I": 1, "D": 3, "R": 2}, 1), ({"I": 1, "D": 1, "R": 1, "truncated": 1}, 3)])
def test_repair_is_the_cheapest(spark, costs, spill):
    check(spark, made(len(costs) + spill, 150, 4 if costs else 6), costs, spill)


def test_undamaged_rows(spark):
    check(spark, made(77, 100, 5), {}, 1 << 16, do_damage=False)


def test_hand_values(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "No."),
            (2, 0, "user", "Same."), (2, 0, "user", "Same."), (2, 5, "assistant", "cut"), (3, None, None, None)]
    got = {r.conv_id: r for r in repair(rows_of(frame(spark, rows))).collect()}
    assert (got[1].audit, got[1].cost, got[1].illegal) == ("KKDK", 2, 1)
    assert (got[2].duplicate, got[2].truncated, got[2].gaps, got[2].audit, got[2].cost) == (1, 1, 4, "DDD", 6)
    assert (got[3].blank, got[3].gaps, got[3].audit, got[3].cost) == (1, 0, "D", 2)
    assert got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_giant_conversation_and_an_empty_table(spark):
    n = 20_000
    rows = [(7, i, "tool", f"row {i}.") for i in range(n)]  # both parities stay open to the end
    got = repair(rows_of(frame(spark, rows)), spill_rows=1000).collect()
    assert len(got) == 1 and got[0].audit == "R" * n and got[0].cost == n
    got = repair(rows_of(frame(spark, rows[1:])), spill_rows=1000).first()
    assert got.audit == "D" + "R" * (n - 2) and got.cost == n
    assert repair(damage(rows_of(frame(spark, [])))).count() == 0


def test_long_text(spark):
    long = "word " * 200_000 + "end."
    got = repair(rows_of(frame(spark, [(1, 0, "user", long), (1, 1, "assistant", "A."), (1, 2, "user", long)]))).first()
    assert (got.duplicate, got.audit, got.cost) == (1, "KKD", 2)
    assert got.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:A.".encode()).hexdigest()
