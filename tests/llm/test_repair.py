import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHING, SF
from veilwatch.llm import queries, repair
from veilwatch.llm import role_grammar as G

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\f\r"
LEGAL = re.compile("(s?(ua)+)?")


def every_repair(codes):
    """Least (cost, audit) over all edits with at most four inserts; exponential."""
    best = None
    n = len(codes)
    for slots in itertools.product(range(3), repeat=n + 1):
        if sum(slots) > 4:
            continue
        choices = []
        for k in range(n + 1):
            choices += [["Iu", "Ia"]] * slots[k]
            if k < n:
                kind, state = divmod(codes[k], 3)
                own = ["D"] if state == G.MUST_GO else ["D", "Ru", "Ra"] + (["K"] if kind < 3 else [])
                choices.append([f"{o}@{k}" for o in own])
        for edits in itertools.product(*choices):
            cost, audit, roles = 0, "", ""
            for e in edits:
                e, _, at = e.partition("@")
                audit += e[0]
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e[0]]
                if at and e != "D":
                    cost += codes[int(at)] % 3 == G.TRUNCATED
                roles += e[1:] if e[0] in "RI" else "sua"[codes[int(at)] // 3] if e == "K" else ""
            if LEGAL.fullmatch(roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_states(codes):
    """Least (cost, audit) and kept roles by whole strings over the states of the pattern."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(front):
        todo = list(front.items())
        while todo:
            state, value = todo.pop()
            for r in "ua":
                to = moves.get((state, r))
                new = (value[0] + 2, value[1] + "I", value[2] + [("I", r, None)])
                if to and (to not in front or new[:2] < front[to][:2]):
                    front[to] = new
                    todo.append((to, new))
        return front

    front = {"": (0, "", [])}
    for k, code in enumerate(codes):
        kind, state = divmod(code, 3)
        after = {}
        for at, (cost, audit, out) in inserted(front).items():
            options = [("D", 3, at, None)]
            if state != G.MUST_GO:
                extra = state == G.TRUNCATED
                options += [("R", 2 + extra, moves.get((at, r)), r) for r in "ua"]
                if kind < 3:
                    options.append(("K", extra, moves.get((at, "sua"[kind])), None))
            for letter, price, to, role in options:
                new = (cost + price, audit + letter, [*out, (letter, role, k)])
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        front = after
    ends = [v for s, v in inserted(front).items() if s in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def run(codes):
    own = G.automaton()
    live, shared, backs = own.run(0, codes)
    cost, at, roles = own.last(live)
    return shared + cost, "".join(b.letters for b in G.walked(backs, at)) + "I" * len(roles)


def test_grammar_and_its_stacks():
    own = G.automaton()
    for n in range(6):
        for word in itertools.product("sua", repeat=n):
            tops = {0}
            for symbol in word:
                tops = {t for top in tops for t in own.shifted(top, symbol)}
            assert any(map(own.accepts, tops)) == bool(LEGAL.fullmatch("".join(word)))
    assert len(own.stacks()) == 8


def test_least_repair_of_short_conversations():
    for n in range(3):
        for codes in itertools.product(range(12), repeat=n):
            assert run(codes) == every_repair(codes) == by_states(codes)[:2], codes
    rng = random.Random(1)
    for _ in range(25):
        codes = tuple(rng.randrange(12) for _ in range(3))
        assert run(codes) == every_repair(codes), codes


def test_least_repair_of_long_conversations():
    rng = random.Random(2)
    for n in (5, 9, 30, 200):
        for _ in range(60):
            codes = tuple(rng.choice([3, 3, 6, 6, 0, 4, 7, 5, 8, 9, 11]) for _ in range(n))
            assert run(codes) == by_states(codes)[:2]


def expected(rows):
    """The contract's columns by plain code, per conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        rows_of = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows_of += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: report(r) for c, r in convs.items()}


def report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()[:16], r[2].encode()))
    seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        body = text.rstrip(WS)
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        counts[fault] += 1
        codes.append(("sua".find(role[:1]) if role[:1] in tuple("sua") else 3) * 3 + {
            "": 0, "truncated": 1}.get(fault, 2))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    cost, audit, edits = by_states(codes)
    lines = []
    for letter, role, at in edits:
        given = {"u": "user", "a": "assistant"}.get(role)
        if letter == "I":
            lines.append(f"{given}:")
        elif letter != "D":
            lines.append(f"{given or rows[at][1]}:{rows[at][2]}")
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    return queries.op11_conversation_repair(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bits", [repair.SEGMENT_BITS, 1])
def test_query_equals_plain_code(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(repair.repair, "__defaults__", (bits,))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF[:-3]}01/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rng = random.Random(3)
    for conv in range(2000, 2040):  # long and faulty ones
        for turn in range(rng.randrange(1, 60)):
            rows.append((conv, turn * 2, rng.choice(["user", "assistant", "system", "tool", ""]),
                         rng.choice(["Yes.", "No", "Why?", f"Line {turn}.", f"cut {turn}", " \n", ""])))
    got = write(spark, tmp_path, rows)
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    assert got[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                      "audit", "repaired_sha256"}


def test_nulls_copies_and_extremes(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "x" * 100_000 + "."),
            (1, None, None, None), (2, 5, "user", None), (3, None, "user", "A."), (3, None, "assistant", "B."),
            (4, -5, "user", "A!"), (4, 9, "assistant", "B?")]
    rows += [(5, 1, "user", "Again.")] * 50 + [(5, 2, "assistant", "Once.")] + [(6, 3, "system", " ")] * 5
    want = expected(rows)
    for r in write(spark, tmp_path, rows):
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    ends = spark.createDataFrame([(1, -2 ** 63, "user", "A."), (1, 2 ** 63 - 1, "assistant", "B.")], SCHEMA)
    assert repair.repair(ends)[1].first()["gaps"] is None


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "More"), (1, 3, "assistant", "A."),
            (2, 0, "tool", "T."), (2, 1, "assistant", "A.")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in CLASHING})
    turns, report = repair.repair(docs)
    by = {r["conv_id"]: r for r in report.collect()}
    assert (by[1]["audit"], by[1]["cost"]) == by_states([0, 3, 4, 6])[1::-1]
    assert (by[2]["audit"], by[2]["cost"]) == ("RK", 2)
    lines = turns.where("conv_id = 2").orderBy("place", "step").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in lines] == [("user", "T.", "R"), ("assistant", "A.", "K")]
    kept = "".join(r["role"][0] for r in turns.where("conv_id = 1 AND edit <> 'D'").orderBy("place", "step").collect())
    assert LEGAL.fullmatch(kept)


def test_empty_table(spark, tmp_path):
    turns, report = repair.repair(spark.createDataFrame([], SCHEMA))
    assert turns.count() == report.count() == 0
    assert write(spark, tmp_path, []) == []


def test_a_conversation_over_many_segments(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]),
             rng.choice([f"Line {k}.", f"cut {k}", "Yes."])) for k in range(3000)]
    got = {bits: repair.repair(spark.createDataFrame(rows, SCHEMA), bits)[1].first() for bits in (3, 12)}
    want = report([r[1:] for r in rows])[:7]
    assert tuple(got[3])[1:] == tuple(got[12])[1:] == want


