"""Conversation repair against exhaustive search, a row-by-row search for long ones, and cases with known answers."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from noteloom.llm import dialogs, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(initial, fault) of rows in order, the plain way."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append((role[:1], "gone" if not bare or (role, text) in seen else "fine" if bare[-1] in ".!?" else "cut"))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters, repaired): the least of all edits, row by row, states as the last initial written."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(held):
        for _ in range(3):
            for last, (cost, letters, out) in list(held.items()):
                for new in set(follow[last]) & set("ua"):
                    role = {"u": "user", "a": "assistant"}[new]
                    held[new] = min(held.get(new, (1 << 40,)), (cost + 3, letters + "I", out + (f"{role}:",)))
        return held

    best = inserted(best)
    for (role, text), (initial, fault) in zip(rows, faults(rows)):
        after = {}
        for last, (cost, letters, out) in best.items():
            options = [(last, cost + 4, "D", out)]
            if fault != "gone":
                more = 3 * (fault == "cut")
                if initial and initial in follow[last]:
                    options.append((initial, cost + more, "K", out + (f"{role}:{text}",)))
                for new in set(follow[last]) & set("ua"):
                    options.append((new, cost + 3 + more, "R", out + (f"{ {'u': 'user', 'a': 'assistant'}[new] }:{text}",)))
            for new, c, letter, o in options:
                after[new] = min(after.get(new, (1 << 40,)), (c, letters + letter, o))
        best = inserted(after)
    cost, letters, out = min(best[q] for q in ("", "a") if q in best)
    return cost, letters, list(out)


def every_edit(kinds):
    """(cost, letters) by trying all edits with at most two insertions in a place."""
    best = (1 << 40, "")
    for choice in itertools.product("DKR", repeat=len(kinds)):
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            state, cost, letters, good = 0, 0, "", True
            for k, n in enumerate(gaps):
                for _ in range(n):
                    state, cost, letters = dialogs.NEXT[state], cost + 3, letters + "I"
                if k == len(kinds):
                    break
                found = [(c, to) for letter, c, to in dialogs.arcs(kinds[k])[state] if letter == choice[k]]
                if not found:
                    good = False
                    break
                cost, state, letters = cost + found[0][0], found[0][1], letters + choice[k]
            if good and state in dialogs.ACCEPTED:
                best = min(best, (cost, letters))
    return best


def test_tight_arcs_find_the_least_of_all_edits():
    for n in range(4):
        for kinds in itertools.product(range(12), repeat=n):
            if n < 3 or sum(kinds) % 7 == 0:
                assert dialogs.solve(bytes(kinds)) == every_edit(kinds), kinds


def test_blocks_of_any_cut_agree_with_the_whole():
    made = random.Random(7)
    for _ in range(200):
        kinds = bytes(made.randrange(12) for _ in range(made.randrange(1, 40)))
        cuts = sorted({0, len(kinds), *(made.randrange(len(kinds) + 1) for _ in range(3))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        enter = [dialogs.ENTER]
        for part in parts:
            enter.append(dialogs.times(enter[-1], dialogs.matrix(part)))
        leave, v = [dialogs.LEAVE], tuple(dialogs._inserting(list(dialogs.LEAVE)))
        for part in reversed(parts[1:]):
            v = dialogs.behind(dialogs.matrix(part), v)
            leave.append(v)
        state, letters = 0, ""
        for k, part in enumerate(parts):
            more, state = dialogs.paths(part, enter[k], leave[len(parts) - 1 - k], k == len(parts) - 1)[state]
            letters += more
        assert letters == dialogs.solve(kinds)[1]


def answers(spark, rows, dropped=None):
    reports, edited = dialogs.repair(spark.createDataFrame(rows, SCHEMA), dropped)
    digests = {r["conv_id"]: r for r in dialogs.digests(edited).collect()}
    return {r["conv_id"]: (r, digests[r["conv_id"]]) for r in reports.collect()}, edited


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_long_and_short_conversations(spark):
    made = random.Random(3)
    text = lambda: made.choice(["", "One.", "Two!", "open end", f"{made.random()}.", f"{made.random()}", "ünïcode ?\n "])
    role = lambda: made.choice(["system", "user", "assistant", "tool", "", "us"])
    rows = [(conv, turn, role(), text()) for conv, n in [(1, 3000), (2, 1), (3, 40), *((k, k % 9 + 1) for k in range(4, 60))] for turn in range(n)]
    found, edited = answers(spark, rows)
    for conv in {r[0] for r in rows}:
        mine = [(r[2], r[3]) for r in rows if r[0] == conv]
        cost, letters, repaired = cheapest(mine)
        report, digest = found[conv]
        assert (report["cost"], digest["audit"], digest["repaired_sha256"]) == (cost, letters, sha(repaired)), conv
        kinds = faults(mine)
        assert report["illegal"] == sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(kinds, kinds[1:]))
        assert report["truncated"] == sum(f == "cut" for _, f in kinds)
        assert report["blank"] + report["duplicate"] == sum(f == "gone" for _, f in kinds)
        assert report["gaps"] == 0
    rebuilt = {}
    for r in dialogs.messages(edited).orderBy("conv_id", "at", "place").collect():
        rebuilt.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert sha(rebuilt[1]) == found[1][1]["repaired_sha256"]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (7, 5, "user", "A."), (7, 5, "user", "A."), (7, 9, "assistant", "B."), (8, 0, "user", "gone."), (9, None, "user", ""), (10, 1, "user", "x" * 300_000), (10, 2, "assistant", "Long.")]
    held = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "edits": F.lit("x"), "state": F.lit(2), "kept": F.lit(False)})
    reports, edited = dialogs.repair(held, dropped=F.col("conv_id") == 8)
    digests = {r["conv_id"]: r for r in dialogs.digests(edited).collect()}
    found = {r["conv_id"]: r for r in reports.collect()}
    assert set(found) == {None, 7, 8, 9, 10} == set(digests)
    assert (found[7]["gaps"], found[7]["duplicate"], found[7]["cost"], digests[7]["audit"]) == (3, 1, 4, "KDK")
    assert digests[7]["repaired_sha256"] == sha(["user:A.", "assistant:B."])
    assert (found[None]["blank"], found[None]["gaps"], digests[None]["audit"]) == (1, 0, "DKI")
    assert tuple(found[8][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) == (0,) * 6 and digests[8]["audit"] == ""
    assert digests[8]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (found[9]["blank"], found[9]["cost"], digests[9]["audit"]) == (1, 4, "D")
    assert (found[10]["truncated"], digests[10]["audit"]) == (1, "KK")


def test_empty_table(spark):
    reports, edited = dialogs.repair(spark.createDataFrame([], SCHEMA))
    assert reports.count() == dialogs.digests(edited).count() == dialogs.messages(edited).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A? b! c.") for c in range(40) for t in range(5)]
    held = queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in held} == {"A? b! c.", "A b c", ""} and {r["role"] for r in held} == {"assistant", "user"}
    assert any(r["dropped"] for r in held) and len(held) > len(rows)
