"""Conversation repair against SQL, and against a search over all edits."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from conftest import rows

from packetlens.llm import repair
from packetlens.llm.repair import START, Conversation, Path, damaged, repair_audits, repaired_messages, search

GOOD = re.compile(r"(s?(ua)+)?")
STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def plainly(messages):
    """Cost and audit of the cheapest edits, by a table over message counts and states."""
    best = {"": (0, "")}

    def insert(paths):
        for _ in range(3):
            for state, (cost, audit) in list(paths.items()):
                new = "a" if state == "u" else "u"
                paths[new] = min(paths.get(new, (10**9, "")), (cost + 2, audit + "I"))
        return paths

    best = insert(best)
    for initial, gone, cut in messages:
        found = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, "D")]
            if not gone:
                ways.append(("a" if state == "u" else "u", cost + 2 + cut, "R"))
                if initial and initial in STATES[state]:
                    ways.append((initial, cost + cut, "K"))
            for new, c, letter in ways:
                found[new] = min(found.get(new, (10**9, "")), (c, audit + letter))
        best = insert(found)
    return min(best[s] for s in ("", "a") if s in best)


def test_query_equals_sql(spark, sf, oracle):
    assert rows(repair.QUERIES["op12_structure_repair"](spark, sf)) == oracle(repair.ORACLES["op12_structure_repair"])


def test_search_equals_all_edit_sequences():
    """Every audit of up to seven edits for short conversations."""
    for n in range(4):
        for kinds in itertools.product([("s", False, False), ("u", False, True), ("a", False, False), ("x", False, False), ("u", True, False)], repeat=n):
            found = []
            for length in range(n, n + 4):
                for letters in itertools.product("KRDI", repeat=length):
                    if sum(x != "I" for x in letters) != n:
                        continue
                    cost, said, at = 0, "", 0
                    for x in letters:
                        initial, gone, cut = kinds[at] if at < n else ("", False, False)
                        if x != "I":
                            at += 1
                        if x == "D":
                            cost += 3
                        elif x == "I":
                            cost, said = cost + 2, said + ("a" if said[-1:] == "u" else "u")
                        elif gone:
                            break
                        else:
                            cost += cut + (0 if x == "K" else 2)
                            said += initial if x == "K" else ("a" if said[-1:] == "u" else "u")
                    else:
                        if GOOD.fullmatch(said):
                            found.append((cost, "".join(letters)))
            (path,) = search([Path(0, "", START)], list(kinds), True)
            assert (path.cost, path.audit) == min(found)


@pytest.mark.parametrize("segment", [1, 2, 5, 256])
def test_segments_change_nothing(monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    for _ in range(300):
        weights = rng.dirichlet([1, 3, 3, 1])
        messages = [(str(rng.choice(list("suax"), p=weights)), rng.random() < 0.2, rng.random() < 0.3) for _ in range(int(rng.integers(0, 40)))]
        talk = Conversation()
        for i, (initial, gone, cut) in enumerate(messages):
            talk.add(i, initial, "blank" if gone else "truncated" if cut else None)
        assert talk.close()[-2:] == plainly([(a, g, c and not g) for a, g, c in messages])


def test_a_giant_conversation_is_repaired_in_bounded_steps():
    talk, n = Conversation(), 100_000
    for i in range(n):
        talk.add(i, "u", None)
        assert len(talk.paths) <= 4 and len(talk.segment) <= 256
    *_, illegal, cost, audit = talk.close()
    assert (illegal, cost, audit) == (n - 1, n, "KR" * (n // 2))


def brute(conversations):
    """The query's rows from (conv_id, turn, role, text)."""
    out = []
    for conv in {c for c, *_ in conversations}:
        after = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if how:
                text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
                after += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in after:
            solid = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plainly([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        said, at = [], 0
        for x in audit:
            fits = "assistant" if said and said[-1][0][:1] == "u" else "user"
            if x == "I":
                said.append((fits, ""))
                continue
            _, role, text = after[at]
            at += 1
            if x != "D":
                said.append((role if x == "K" else fits, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((audit, faults.count("blank"), conv, cost, faults.count("duplicate"), gaps, illegal, sha, faults.count("truncated")))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(8)
    texts = ["Yes.", "No", "", None, " \n", "Really?\n ", "é漢🙂!", "long words. " * 500]
    out = [(int(rng.integers(0, 60)), None if rng.random() < 0.05 else int(rng.integers(0, 12)), rng.choice(["user", "assistant", "system", None, "", "tool"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05]), str(rng.choice(texts[:3])) if rng.random() < 0.3 else rng.choice(texts)) for _ in range(700)]
    out = [(c, t, None if r is None else str(r), None if x is None else str(x)) for c, t, r, x in out]
    out += [(None, i, "user", f"{i}.") for i in range(9)] + [(500, None, "user", "a.")] * 3
    # a conversation that loses its only row
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*out, (lost, 0, "user", "x.")]


def test_query_equals_brute_force(spark, talks, tmp_path):
    spark.createDataFrame([(*t, 7, "x", "y") for t in talks], "conv_id long, turn long, role string, text string, n int, audit string, present string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(repair.QUERIES["op12_structure_repair"](spark, str(tmp_path))) == brute(talks)


def test_messages_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "user", "Hi."), ("a", 3, "user", "So"), ("b", 1, "system", "Be.")], "conv_id string, turn int, role string, text string")
    audits = repair_audits(df)
    assert {r["conv_id"]: (r["cost"], r["audit"], r["duplicate"], r["truncated"]) for r in audits.collect()} == {"a": (6, "KDR", 1, 1), "b": (3, "D", 0, 0)}
    said = [tuple(r) for r in repaired_messages(df, audits).collect()]
    assert said == [("a", 0, "K", "user", "Hi."), ("a", 1, "R", "assistant", "So")]
    none = df.where("false")
    assert repair_audits(none).count() == 0 and repaired_messages(none, repair_audits(none)).count() == 0
    assert damaged(none).count() == 0
