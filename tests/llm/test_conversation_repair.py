"""op13 against an exhaustive search over edits, and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same_rows

from siltstone.llm import registry
from siltstone.llm.conversation_repair import CUT_ROWS, repair_conversations, repaired_turns

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """The first fault of each (role, text), in order."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def applied(audit, rows):
    """What an audit makes of rows: (cost, lines), or None if the roles do not fit."""
    kinds, at, cost, lines, letters = faults(rows), 0, 0, [], ""
    for x in audit:
        wanted = "user" if letters in ("", "s") or letters[-1] == "a" else "assistant"
        if x == "I":
            cost, lines, letters = cost + 3, [*lines, f"{wanted}:"], letters + wanted[0]
            continue
        (role, text), fault = rows[at], kinds[at]
        at += 1
        if x == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        role = role if x == "K" else wanted
        cost += (0 if x == "K" else 3) + (3 if fault == "truncated" else 0)
        lines, letters = [*lines, f"{role}:{text}"], letters + (role[:1] or "?")
    return (cost, "\n".join(lines)) if GRAMMAR.fullmatch(letters) else None


def exhaustively(rows):
    """Every way to edit, with up to two insertions in every gap."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = gaps[0] + "".join(a + b for a, b in zip(letters, gaps[1:], strict=True))
            found = applied(audit, rows)
            if found and (best is None or (found[0], audit) < best[:2]):
                best = (found[0], audit, found[1])
    return best


CASES = [[random.Random(seed).choice([("user", "a."), ("assistant", "b!"), ("system", "s."), ("user", "cut"), ("assistant", " "), ("", "x."), ("other", "y."), ("assistant", "c")]) for _ in range(random.Random(seed + 1000).randrange(1, 5))] for seed in range(150)]


def frame(spark, cases):
    rows = [(i, t, role, text) for i, case in enumerate(cases) for t, (role, text) in enumerate(case)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_against_exhaustive_search(spark):
    found = {r.conv_id: r for r in repair_conversations(frame(spark, CASES)).collect()}
    for i, case in enumerate(CASES):
        cost, audit, text = exhaustively(case)
        r, kinds = found[i], faults(case)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), case
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(case))


def test_repaired_turns_are_what_was_hashed(spark):
    turns = frame(spark, CASES)
    lines = {}
    for r in sorted(repaired_turns(turns).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair_conversations(turns).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()


def test_long_conversation_is_parsed_like_short_ones(spark):
    """Audits that are cut into parts: held against a plain dynamic programme with whole strings."""
    pick = random.Random(5)
    rows = [(pick.choice(["user", "user", "assistant", "assistant", "system"]), f"{pick.randrange(900)}{pick.choice(['.', '!', '', ''])}") for _ in range(CUT_ROWS * 3 + 17)]
    (r,) = repair_conversations(frame(spark, [rows])).collect()
    states, kinds = {"": (0, "")}, faults(rows)

    def closed(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                t = "a" if s == "u" else "u"
                states[t] = min(states.get(t, (c + 3, a + "I")), (c + 3, a + "I"))
        return states

    states = closed(states)
    for (role, _), kind in zip(rows, kinds, strict=True):
        new = {s: (c + 4, a + "D") for s, (c, a) in states.items()}
        for s, (c, a) in states.items():
            if kind in ("blank", "duplicate"):
                continue
            t, more = "a" if s == "u" else "u", 3 if kind else 0
            for letter, cost, state in [("R", 3, t)] + ([("K", 0, t)] if role[0] == t else []) + ([("K", 0, "s")] if role[0] == "s" and s == "" else []):
                new[state] = min(new.get(state, (c + cost + more, a + letter)), (c + cost + more, a + letter))
        states = closed(new)
    assert (r.cost, r.audit) == min(states[""], states["a"])
    assert hashlib.sha256(applied(r.audit, rows)[1].encode()).hexdigest() == r.repaired_sha256


@pytest.fixture(scope="module")
def talks(tmp_path_factory):
    """Null ids, turns, roles and texts, gaps, repeated rows, a conversation that is dropped whole, a very long text."""
    path = tmp_path_factory.mktemp("talks")
    gone = next(i for i in range(1000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "all gone.")]
    for i in range(120):
        pick = random.Random(i)
        for t in range(pick.randrange(1, 7)):
            rows.append((i if i % 11 else None, None if pick.random() < 0.05 else t * pick.choice([1, 1, 2]), pick.choice(["user", "assistant", "system", None, "", "user"]), pick.choice(["hi.", "yes!", "no", None, "", "  ", "Why?", "a\nb.", "é."])))
    rows += [(5, 2, "user", "twice."), (5, 2, "user", "twice."), (6, 9, "assistant", "long " * 200_000)]
    columns = list(zip(*rows, strict=True))
    table = {"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string()), "key": pa.array(range(len(rows))), "digest": pa.array(["x"] * len(rows))}
    pq.write_table(pa.table(table), path / "conversations.parquet")
    return str(path), gone


def test_damaged_talks_match_sql(spark, talks):
    name = "op13_conversation_repair"
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], talks[0])
    (r,) = registry.queries()[name](spark, talks[0]).filter(f"conv_id = {talks[1]}").collect()
    assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_given_conversations_match_sql(spark):
    name = "op13_conversation_repair"
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")
