import hashlib
import random
import zlib

import pytest

from tesselar.llm import conversations as C

BLANKS = " \t\n\v\f\r"


def brute(codes):
    """Least (cost, edits) by state, turn after turn."""
    best = {0: (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for q, (c, a) in list(out.items()):
                to = 3 if q == 2 else 2
                out[to] = min(out.get(to, (c + 5, a + "I")), (c + 5, a + "I"))
        return out

    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    for ch in codes:
        late = 5 if ch.isupper() else 0
        new = {}
        for q, (c, a) in inserted(best).items():
            ways = [(q, c + 2, a + "D")]
            if ch != "#":
                ways.append((3 if q == 2 else 2, c + 1 + late, a + "R"))
                if (q, ch.lower()) in keep:
                    ways.append((keep[q, ch.lower()], c + late, a + "K"))
            for to, *way in ways:
                new[to] = min(new.get(to, tuple(way)), tuple(way))
        best = new
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def plain(rows):
    """The contract by rows (conv_id, turn, role, text), one turn after the other."""
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    for conv, turns in by.items():
        after = []
        for turn, role, text in turns:
            say = lambda x: " " if x is None else str(x)
            fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
            role, text = say(role), say(text)
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            role = "user" if fault == 4 else role
            after += [(turn, role, text)] * (2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen, count = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in after:
            bare = text.strip(BLANKS)
            first = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not bare:
                kind, code = "blank", "#"
            elif (role, text) in seen:
                kind, code = "duplicate", "#"
            elif bare[-1] not in ".!?":
                kind, code = "truncated", first.upper()
            else:
                kind, code = None, first
            seen.add((role, text))
            codes += code
            if kind:
                count[kind] += 1
        cost, audit = brute(codes)
        lines, at, state = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = 3 if state == 2 else 2
                lines.append(("user" if state == 2 else "assistant") + ":")
                continue
            _, role, text = after[at]
            at += 1
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[:1] == "s" else 3 if state == 2 else 2
            lines.append(f"{role if edit == 'K' else 'user' if state == 2 else 'assistant'}:{text}")
        numbers = [t for t, _, _ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def dialogues(seed, n=60, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ü"])
            text = rng.choice(["Good.", "What?", "no end", "", " \n", None, "a. b", f"Text {turn}!", "Żółw…", "ok. "])
            number = rng.choice([turn, turn, turn, turn + 2, 1, None])
            rows.append((conv, number, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_the_auction_finds_the_first_cheapest_edits():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 8, 15, 16, 17, 33, 70):
        for _ in range(60 if n < 20 else 6):
            codes = "".join(rng.choice("uauasxSUAX") for _ in range(n))
            cost, edits, last = C.solve(codes)
            assert (cost, edits + "I" * (C.END[last] // 5)) == brute(codes)


def test_literal_cases():
    assert C.solve("suaua")[:2] == (0, "KKKKK")
    assert C.solve("ua" * 20)[:2] == (0, "K" * 40)
    assert C.solve("")[:2] == (0, "")
    assert C.solve("u")[:2] == (2, "D")
    assert C.solve("uu")[:2] == (1, "KR")
    assert C.solve("uA")[:2] == (4, "DD")


def test_prices_never_exceed_an_arc_and_what_lies_ahead():
    codes = "usaxUAsua" * 5
    arcs, price = C.prices(codes, C.END, (0,))
    assert all(price[k] <= cost + price[node] for k, here in enumerate(arcs) for _, cost, node in here)
    assert price[0] == brute(codes)[0]


@pytest.mark.parametrize("piece", [3, 256])
def test_against_plain_form(spark, piece):
    rows = dialogues(5) + [(1000, k, "user" if k % 2 else "assistant", f"t{k % 23}{'.' if k % 7 else ''}") for k in range(300)]
    rows += [(1001, 5, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as times", "2 as edit").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(df), C.RepairConfig(piece=piece)).collect()}
    assert got == plain(rows)


def test_all_rows_of_one_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows is cut into pieces; earlier turns are known in later pieces."""
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"n {k}.", f"m {k % 50}!", ""])) for k in range(2000)] + [(8, 1, "user", "Hm.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(df), C.RepairConfig(piece=20)).collect()}
    assert got == plain(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (2, 0, "assistant", "Yes."), (2, 1, "user", ""), (2, 2, "assistant", "So?"), (3, 0, "user", "")]
    for piece in (1, 256):
        got = C.repair(spark.createDataFrame(rows, SCHEMA), C.RepairConfig(piece=piece), lines=True).collect()
        lines = {}
        for r in got:
            lines[r.conv_id] = lines.get(r.conv_id, []) + [(x.edit, x.role, x.text) for x in r.lines or ()]
        assert lines == {1: [("K", "system", "Be kind."), ("K", "user", "Hi."), ("R", "assistant", "Hello.")], 2: [("R", "user", "Yes."), ("K", "assistant", "So?")], 3: []}
        assert {r.conv_id: r.audit for r in got if r.audit is not None} == {1: "KKR", 2: "RDK", 3: "D"}


def test_no_rows_and_lost_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(none)).count() == 0
    lost = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = C.repair(C.damaged(spark.createDataFrame(lost, SCHEMA))).collect()
    assert len(got) == len(lost) > 5
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_ids_and_a_very_long_text(spark):
    rows = [("x", 0, "user", "long " * 100_000 + "."), ("x", 1, "assistant", "Yes."), ("y", 0, None, None)]
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string")))).collect()}
    assert got == plain(rows)
