"""Repair of conversations: the algebra against all edits, the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.llm import turn_repair as tr

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_edit(rows):
    """Cheapest cost and least audit over all edits with at most two insertions in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 2)] + ([] if r == "-" else [("K", r.lower(), 5 * r.isupper())] + [("R", x, 1 + 5 * r.isupper()) for x in "ua"]) for r in rows]
    for picked in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(g + p[1] for g, p in zip(ins, [*picked, ("", "", 0)]))
            if GRAMMAR.fullmatch(roles):
                audit = "".join("I" * len(g) + p[0] for g, p in zip(ins, [*picked, ("", "", 0)]))
                found = (5 * sum(map(len, ins)) + sum(p[2] for p in picked), audit)
                best = min(best or found, found)
    return best


def by_algebra(g, rows, cuts=()):
    segments = ["".join(rows[a:z]) for a, z in zip((0, *cuts), (*cuts, len(rows)))]
    whole, back = tr.CLOSING, []
    for e in reversed(g.products(segments)):
        whole = tr.Pair(e, whole)
        back.append((e, whole))
    end = min(tr.ENDS, key=lambda j: (whole.cost[j], whole.rank[j]))
    state, edits = 0, ""
    for e, w in reversed(back):
        after = w.middle[tr.at(state, end)]
        edits += "".join(tr.told(e, state, after))
        state = after
    return whole.cost[end], (edits + tr.CLOSING.edits[tr.at(state, end)]).translate(tr.AUDIT)


RULES = ("ua", chr(tr.FIRST) * 2, "u" + chr(tr.FIRST), "--", "uu", "sS", "a-")


@pytest.mark.parametrize("rules", [(), RULES])
def test_all_short_conversations(rules):
    g = tr.Grammar(rules)
    for n in (1, 2, 3):
        for rows in itertools.product(tr.ALPHABET, repeat=n):
            if n < 3 or hash(rows) % 6 == 0:
                assert by_algebra(g, rows) == every_edit(rows), rows


def plain_repair(rows):
    """A row-by-row search over states, with whole audits: cost, audit and repaired turns. rows: (role, text, symbol)."""
    at = {0: (0, "", ())}
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    names = {"u": "user", "a": "assistant"}

    def inserted(at):
        for _ in range(2):
            for s, (c, audit, turns) in list(at.items()):
                for x in "ua":
                    if s in step[x]:
                        found = (c + 5, audit + "I", (*turns, (names[x], "")))
                        if step[x][s] not in at or found[:2] < at[step[x][s]][:2]:
                            at[step[x][s]] = found
        return at

    for role, text, symbol in rows:
        new = {}
        for s, (c, audit, turns) in inserted(dict(at)).items():
            options = [(c + 2, audit + "D", turns, s)]
            if symbol != "-":
                cut, r = 5 * symbol.isupper(), symbol.lower()
                if s in step.get(r, {}):
                    options.append((c + cut, audit + "K", (*turns, (role, text)), step[r][s]))
                options += [(c + cut + 1, audit + "R", (*turns, (names[x], text)), step[x][s]) for x in "ua" if s in step[x]]
            for c2, a2, t2, s2 in options:
                if s2 not in new or (c2, a2) < new[s2][:2]:
                    new[s2] = (c2, a2, t2)
        at = new
    return min(v for s, v in inserted(at).items() if s in (0, 3))


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations_in_segments(seed):
    rng = random.Random(seed)
    g = tr.Grammar(RULES)
    for _ in range(60):
        rows = rng.choices(tr.ALPHABET, [2, 1, 9, 9, 1, 1, 2, 2, 1], k=rng.randrange(1, 120))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(5)))) if len(rows) > 1 else ()
        assert by_algebra(g, rows, tuple(cuts)) == plain_repair([("", "", s) for s in rows])[:2]


def expected(rows):
    """The contract, row by row in plain Python; rows: (conv_id, turn, role, text)."""
    every, after = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in every:
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        some = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        turns = {r[0] for r in some} - {None}
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in some:
            words = text.strip(" \t\n\v\f\r")
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("-" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
        illegal = sum(a[1][:1] + z[1][:1] not in ("su", "ua", "au") for a, z in zip(some, some[1:]))
        cost, audit, repaired = plain_repair([(r[1], r[2], s) for r, s in zip(some, symbols)])
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(tr.query(spark, sf)) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "What? ", "Ünïcode…", "long " * 20_000 + ".", ".", " "]
    roles = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "User"]
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(77, 0, "user", "same.")] * 50 + [(78, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(3000)] + [(79, 10**15 * i, "user", "x.") for i in range(4)]
    rows += [(900 + i, 0, "user", "One.") for i in range(60)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).withColumn("part", F.lit("clash")).withColumn("times", F.lit("clash"))
    d.write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(tr.query(spark, str(tmp_path))) == expected(rows)
    d.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert tr.query(spark, f"{tmp_path}/none").count() == 0


def test_rules_are_the_commonest_pairs(spark):
    words = spark.createDataFrame([("uauaua", 10), ("suauaS", 3), ("uuuu", 1)], "symbols string, n long")
    assert tr.learned(words, 1) == ("ua",)
    rules = tr.learned(words)
    assert rules[0] == "ua" and rules[1] == chr(tr.FIRST) * 2 and tr.learned(words.limit(0)) == ()
    assert all(len(s) == 1 for s in tr.Grammar(rules).compressed(["uauaua"]))
