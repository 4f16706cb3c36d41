import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversations as C

BARE = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [row] * (2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        held = BARE.findall(text)
        out.append(C.BLANK if not held else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if held[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(initials, marks):
    """(cost, edits, roles), from the last row backwards, comparing whole strings."""
    may = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def closed(rest):
        for _ in range(3):
            rest = {q: min(([rest[q]] if q in rest else []) + [(c + 2, "I" + e, (r, *x)) for r, (c, e, x) in rest.items() if r in ("u", "a") and (q, r) in may], default=None) for q in ("", "s", "u", "a")}
            rest = {q: x for q, x in rest.items() if x}
        return rest

    rest = closed({"": (0, "", ()), "a": (0, "", ())})
    for first, mark in zip(reversed(initials), reversed(marks), strict=True):
        new = {}
        for q in ("", "s", "u", "a"):
            found = [(rest[q][0] + 3, "D" + rest[q][1], rest[q][2])] if q in rest else []
            if mark not in (C.BLANK, C.DUPLICATE):
                for role, edit, price in ((first, "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if (q, role) in may and role in rest:
                        c, e, x = rest[role]
                        found.append((c + price + (mark == C.TRUNCATED), edit + e, (role, *x)))
            if found:
                new[q] = min(found)
        rest = closed(new)
    return rest[""]


def every_edit(initials, marks):
    """The same by trying all sequences of edits."""
    best = None
    inserted = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product("KDua", repeat=len(initials)):
        for more in itertools.product(inserted, repeat=len(initials) + 1):
            cost, audit, roles = 2 * len(more[0]), "I" * len(more[0]), list(more[0])
            for first, mark, e, after in zip(initials, marks, edits, more[1:], strict=True):
                if e != "D" and mark in (C.BLANK, C.DUPLICATE):
                    break
                cost += {"K": 0, "D": 3}.get(e, 2) + (e != "D" and mark == C.TRUNCATED) + 2 * len(after)
                audit += (e if e in "KD" else "R") + "I" * len(after)
                roles += ([] if e == "D" else [first if e == "K" else e]) + list(after)
            else:
                if GRAMMAR.fullmatch("".join(roles)) and all(len(r) == 1 for r in roles):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_viterbi_finds_the_cheapest_and_then_the_least_edits():
    rnd = random.Random(3)
    for n, times, check in ((1, 12, every_edit), (2, 40, every_edit), (3, 8, every_edit), (4, 300, cheapest), (9, 200, cheapest), (40, 20, cheapest)):
        for _ in range(times):
            initials, marks = [rnd.choice("ssuuuaax") for _ in range(n)], [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            path = C.Viterbi()
            for i, m in zip(initials, marks, strict=True):
                path.row(i if i in "sua" else "", m)
            assert path.end() == check(initials, marks)[:2], (initials, marks)
    assert C.Viterbi().end() == (0, "")


def report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own} - {None}
        marks, initials = faults(own), [r[2][:1] for r in own]
        cost, audit, roles = cheapest([i if i in ("s", "u", "a") else "x" for i in initials], marks)
        kept, lines, of = iter(own), [], iter(roles)
        for e in audit:
            row = next(kept) if e != "I" else None
            if e != "D":
                role = {"u": "user", "a": "assistant", "s": "system"}[next(of)]
                lines.append(f"{row[2] if e == 'K' else role}:{row[3] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a, b) not in C.LEGAL for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, marks.count(1), marks.count(2), marks.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "...", "long " * 50_000 + ".", "é?  \n", "?", None, "日本。"]
    out = [(c, rnd.choice([t, t, t, t + 2, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "User"]), rnd.choice(texts[:4] * 4 + texts) if rnd.random() < 0.4 else f"text {c} {t}.") for c in range(150) for t in range(rnd.randrange(1, 9))]
    out += [(500, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 5 > 0)) for t in range(2500)]
    out += [(c, t, "user", "one row.") for c in range(600, 700) for t in [c % 7]]  # some lose their only row
    out += [(None, 0, "user", "no id."), (None, None, None, None), (None, 1, "assistant", "yes."), (1, 0, "user", "again."), (1, 0, "user", "again.")]
    return out


def test_report_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("kind", "copy", "fault", "audit", "is_row"):  # columns whose names the operator uses for its own
        df = df.withColumn(c, df.turn)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_report(df.repartition(5)).collect()}
    want = report(rows)
    assert got == want
    assert want[min(c for c in want if c and c >= 600 and want[c][6] == "" and not any(want[c][:6]))][7] == hashlib.sha256(b"").hexdigest()


def test_repaired_rows_have_the_structure(spark, rows):
    damaged = C.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = {}
    for r in C.repaired(damaged, C.assessed(damaged)).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append(r)
    for own in out.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert GRAMMAR.fullmatch("".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")


def test_empty_table(spark):
    assert C.repair_report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
