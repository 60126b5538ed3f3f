"""Repair of conversations against searches that list whole edit strings, and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from presswire.llm import repair

RIGHT = re.compile(r"(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, cost long, digest string"


def cheapest(turns):
    """Whole edit strings in the order of cost, then letters."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, at, roles = heapq.heappop(heap)
        if at == len(turns) and RIGHT.fullmatch(roles):
            return cost, letters
        if len(roles) > len(turns) + 3:
            continue
        if at < len(turns):
            turn = turns[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, roles))
            if turn != "-":
                heapq.heappush(heap, (cost + turn.isupper(), letters + "K", at + 1, roles + turn.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + turn.isupper(), letters + "R", at + 1, roles + role))
        for role in "ua":
            heapq.heappush(heap, (cost + 2, letters + "I", at, roles + role))


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3, 1])  # the small ones collide all the time
def test_edits_against_a_search(modulus):
    draw = random.Random(5)
    cases = ["".join(t) for n in range(3) for t in itertools.product("suaxSUAX-", repeat=n)]
    cases += ["".join(draw.choice("ssuuaaxUA-") for _ in range(draw.randint(3, 5))) for _ in range(60)]
    for turns in cases:
        chain, cut = repair.Chain(), draw.randint(0, len(turns))
        for part in filter(None, (turns[:cut], turns[cut:])):
            chain.add([repair.edits(part, entry, modulus) for entry in range(4)])
        assert chain.best() == cheapest(turns), turns


def test_order_of_trails():
    draw = random.Random(6)
    for modulus in (repair.MODULUS, 2):
        trails = repair.Trails(modulus)
        texts = {0: ""}
        for _ in range(400):
            node = draw.choice(list(texts))
            letter = draw.choice("DI")
            texts[trails.child(node, letter)] = texts[node] + letter
        for _ in range(3000):
            a, b = draw.choice(list(texts)), draw.choice(list(texts))
            assert trails.less(a, b) == (texts[a] < texts[b]) and trails.text(a) == texts[a]


def plain(rows):
    """One conversation, (turn, role, text) after damage, told in one go."""
    space = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        last = text.strip(space)[-1:]
        kind = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        seen.add((role, text))
        kinds.append(kind)
        if kind is not None:
            counts[kind] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {"": (0, "", "")}  # by the last letter of the roles, "" none
    step = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def closed(now):
        for _ in range(4):
            for state, (cost, letters, told) in list(now.items()):
                role = "a" if state == "u" else "u"
                new = cost + 2, letters + "I", told + "\n" + {"u": "user", "a": "assistant"}[role] + ":"
                now[role] = min(now.get(role, new), new)
        return now

    best = closed(best)
    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (cost, letters, told) in best.items():
            to = [(state, (cost + 3, letters + "D", told))]
            if kind not in (0, 1):
                if (state, role[:1]) in step:
                    to.append((role[:1], (cost + (kind == 2), letters + "K", told + "\n" + role + ":" + text)))
                new = "a" if state == "u" else "u"
                to.append((new, (cost + 2 + (kind == 2), letters + "R", told + "\n" + {"u": "user", "a": "assistant"}[new] + ":" + text)))
            for name, found in to:
                after[name] = min(after.get(name, found), found)
        best = closed(after)
    cost, letters, told = min(best[s] for s in ("", "a") if s in best)
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256(told[1:].encode()).hexdigest())


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        conv_rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        conv_rows.extend([(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1))
    return out


def as_rows(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}
    assert df.count() == len(found)
    return found


def test_query_against_a_plain_repair(spark):
    from presswire.llm.queries import op12_structure_repair

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = {conv: plain(turns) for conv, turns in harmed(rows).items()}
    assert as_rows(op12_structure_repair(spark, sf)) == wanted


def test_segments_and_chunks(spark, monkeypatch):
    """A long conversation in many segments, with returning texts, null turns and ties."""
    monkeypatch.setattr(repair, "SPAN", 8)
    draw = random.Random(7)
    rows = [(9, turn, draw.choice(["system", "user", "assistant", "tool", "", None]), draw.choice(["A b.", "c", "D!", " \t", None, "x?"]) if turn % 3 else f"t{turn}.")
            for turn in range(-40, 120) if draw.random() < 0.9]
    rows += [(9, None, "user", f"n{i}.") for i in range(20)] + [(8, 2**62, "user", "far."), (8, -2**62 - 1, "assistant", "away."), (8, 2**62, "user", "far.")]
    found = as_rows(repair.report(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)))
    mine = sorted((r for r in rows if r[0] == 9), key=lambda r: (r[1] is not None, r[1] or 0))
    # rows of one turn: by role, then the digest of conversation, role and text
    def tie(r):
        role, text = " " if r[2] is None else r[2], " " if r[3] is None else r[3]
        return r[1] is not None, r[1] or 0, role, hashlib.sha256(f"2=9{len(role)}:{role}{text}".encode()).digest()
    mine.sort(key=tie)
    assert found[9] == plain([(t, " " if a is None else a, " " if b is None else b) for _, t, a, b in mine])
    assert found[8][0] is None and found[8][2] == 1  # as many gaps do not fit in a long


def test_odd_rows(spark):
    big = "word " * 400_000 + "end."
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, None, None), (None, 0, "user", "a"), (None, 0, "user", "a"),
            (3, 5, "assistant", big), (4, 1, "user", "\u00a0"), (5, 0, "User", "Q?"), (6, 0, "system", "Be."), (6, 1, "user", "?"), (6, 2, "assistant", "!")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    found = as_rows(repair.report(frame))
    assert found[1][:7] == (0, 0, 1, 0, 1, 3, "KKD") and found[2][:7] == (0, 1, 0, 0, 0, 3, "D")
    assert found[None][:7] == (0, 0, 1, 1, 1, 6, "DD") and found[4][3] == 1 and found[5][6] == "D"
    assert found[3][5:7] == (2, "IK") and found[6][:7] == (0, 0, 0, 0, 0, 0, "KKK")
    turns = {}
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: (r.conv_id, r.position)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns.keys() == {1, 3, 6} and turns[3] == ["user:", f"assistant:{big}"]
    for conv, (*_, sha) in found.items():
        assert sha == hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest()
    none = repair.report(spark.createDataFrame([], ROWS))
    assert none.count() == 0 and repair.repaired(spark.createDataFrame([], ROWS)).count() == 0


def test_conversations_that_are_gone(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "b.", False)], "conv_id long, turn long, role string, text string, lost boolean")
    found = as_rows(repair.report(rows, "lost"))
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and found[2][6] == "KI"
