"""Repair of conversations against all edits written out, and the query against a plain version."""

import collections
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from nearfield.llm import conversation_repair as repair
from nearfield.llm.conversation_repair import Row

GRAMMAR = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, letters) over all edits, with up to two rows inserted between any two."""
    inserted = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    options = []
    for row in rows:
        edits, stays = [("D", 3, "")], row.fault == "truncated"
        if row.fault not in ("blank", "duplicate"):
            edits += [("K", stays, row.role[:1] or "?"), ("R", 2 + stays, "u"), ("R", 2 + stays, "a")]
        options.append([("I" * len(i) + e, 2 * len(i) + c, i + g) for i in inserted for e, c, g in edits])
    options.append([("I" * len(i), 2 * len(i), i) for i in inserted])
    return min((sum(x[1] for x in c), "".join(x[0] for x in c)) for c in itertools.product(*options) if GRAMMAR.fullmatch("".join(x[2] for x in c)))


def plain(rows):
    """The same over a table of whole texts."""
    legal = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

    def closed(states):
        for _ in range(3):
            for a, (c, s) in list(states.items()):
                b = legal[a][1]
                states[b] = min(states.get(b, (c + 3, "")), (c + 2, s + "I"))
        return states

    states = closed({0: (0, "")})
    for row in rows:
        after, stays = collections.defaultdict(list), row.fault == "truncated"
        for a, (c, s) in states.items():
            after[a].append((c + 3, s + "D"))
            if row.fault not in ("blank", "duplicate"):
                letter, b = legal[a]
                after[b].append((c + 2 + stays, s + "R"))
                if row.role[:1] == letter:
                    after[b].append((c + stays, s + "K"))
                if a == 0 and row.role[:1] == "s":
                    after[1].append((c + stays, s + "K"))
        states = closed({b: min(x) for b, x in after.items()})
    return min(states[a] for a in (0, 3) if a in states)


def found(rows):
    *edits, last = repair.edits(iter(rows))
    return (last[2], "".join(e[0] for e in edits)), edits


def draw(rnd, most, roles, faults):
    return [Row(i, rnd.choice(roles), "x", rnd.choice(faults)) for i in range(rnd.randint(1, most))]


def test_edits_against_all_edits():
    rnd = random.Random(7)
    for _ in range(120):
        rows = draw(rnd, 3, ["user", "assistant", "system", "tool", ""], [None, None, "blank", "duplicate", "truncated"])
        assert found(rows)[0] == brute(rows), rows


def test_edits_of_long_conversations():
    rnd = random.Random(8)
    for _ in range(300):
        rows = draw(rnd, 60, rnd.choice([["user", "assistant"], ["system", "user"], ["system"], ["tool", "assistant"]]), rnd.choice([[None], ["blank"], [None, "truncated", "duplicate"]]))
        best, edits = found(rows)
        assert best == plain(rows), rows
        assert [row.turn for _, _, row in edits if row is not None] == list(range(len(rows)))
        assert GRAMMAR.fullmatch("".join((role or row.role)[:1] for letter, role, row in edits if letter != "D"))


def held(search):
    count, todo = 0, [search.root]
    while todo:
        node = todo.pop()
        count += 1 + len(node.rows)
        todo += node.children
    return count


def test_memory_is_bounded():
    rnd, search, most = random.Random(9), repair.Survivors(), 0
    for i in range(5000):
        list(search.step(Row(i, rnd.choice(["user", "assistant"]), "x", None), False))
        most = max(most, held(search))
    assert most < 100
    search = repair.Survivors()
    for i in range(5000):  # deletions that every survivor has become certain at once
        list(search.step(Row(i, "user", None, "duplicate"), True))
    assert held(search) < 20


def plain_digest(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text) in order."""
    seen, marked = set(), []
    for turn, role, text in rows:
        core = text.rstrip(WHITE)
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append(Row(turn, role, text, fault))
    turns = [r.turn for r in marked if r.turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = collections.Counter(r.fault for r in marked)
    illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, letters = plain(marked) if marked else (0, "")
    out, state, left = [], "", iter(marked)
    for letter in letters:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        legal = "assistant" if state == "u" else "user"
        role = row.role if letter == "K" else legal
        state = role[:1]
        out.append(f"{role}:{row.text if row else ''}")
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_query(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: plain_digest(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, own in by.items()}


def test_query_against_a_plain_version(spark, tmp_path):
    rnd = random.Random(10)
    texts = ["Yes.", "No!", "Why", " \t", "", None, "So? \n", "é ü. ", "x" * 50000 + ".", "one.two", "😀!"]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool"]), rnd.choice(texts)) for c in [*range(60), None] for t in [*range(rnd.randint(1, 9)), None]]
    rows += rows[:20] + [(1000, k, "user", "the same.") for k in range(300)] + [(1001, k, "system", f"{k}.") for k in range(40)] + [(c, 0, "user", "Only.") for c in range(2000, 2040)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"_conv": F.lit("x"), "_place": F.lit(1)})
    got = repair.damage_and_repair(table.repartition(5)).collect()
    want = plain_query(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(v[6] == "" for v in want.values())
    assert repair.damage_and_repair(table.limit(0)).count() == 0
    plan = repair.repair_digests(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # one shuffle brings each conversation together


def test_repaired_rows(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "user", "So."), ("b", 0, "system", "Rules."), ("b", 1, "assistant", "Yes.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    a = [tuple(r)[1:] for r in got if r.conv_id == "a"]
    assert a == [(1, "K", None, 0, "user", "Hi."), (None, "D", "duplicate", 1, "user", None), (2, "R", None, 2, "assistant", "So.")]
    b = [tuple(r)[1:] for r in got if r.conv_id == "b"]
    assert b == [(1, "K", None, 0, "system", "Rules."), (2, "I", None, None, "user", ""), (3, "K", None, 1, "assistant", "Yes.")]


def test_over_a_table(spark):
    import duckdb

    from nearfield.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM read_parquet('{folder}/conversations.parquet')").fetchall()
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, folder).collect()} == plain_query(rows)
