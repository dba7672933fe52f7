import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from weftline.llm import conversations, queries

WHITE = " \t\n\r\x0b\x0c"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """The contract read literally: every sequence of edits, the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    goes = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def then(cost, letter, turn, *state):
            tail = best(*state)
            if tail:
                found.append((cost + tail[0], letter + tail[1], turn + tail[2]))

        if inserted < 3:
            for r in goes[last].replace("s", ""):
                then(3, "I", (({"u": "user", "a": "assistant"}[r], ""),), i, r, inserted + 1)
        if i < len(rows):
            role, text = rows[i][2:]
            then(4, "D", (), i + 1, last, 0)
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role and role[0] in goes[last]:
                    then(extra, "K", ((role, text),), i + 1, role[0], 0)
                for name in ("user", "assistant"):
                    if name[0] in goes[last]:
                        then(3 + extra, "R", ((name, text),), i + 1, name[0], 0)
        return min(found, default=None)

    cost, audit, made = best(0, "", 0)
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def invented(seed, n, turns=9):
    rng = random.Random(seed)
    texts = ["Hello.", "What?", "no end", "", " \t", "Hello.", "é!", "x.", "Well. ", None, "end.\x0b", "a "]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", None]
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, turns)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            out.append((c, None if rng.random() < 0.1 else t + 3 * (rng.random() < 0.1), role, rng.choice(texts)))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    kept = damage(rows)
    return sorted(((c, *plain([r for r in kept if r[0] == c])) for c in {r[0] for r in rows}), key=str)


@pytest.mark.parametrize("piece_turns", [conversations.PIECE_TURNS, 3])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, piece_turns):
    rows = invented(1, 120) + [(None, 1, "user", "Hi."), (None, 2, None, None), (500, None, None, None), (501, 4, "user", "long. " * 50_000)] + [(600, t, "user", "") for t in range(3)]
    rows += [(700, t, "user", "same.") for t in range(14)] + [(701, 5, "user", "same.")] * 9 + [(c, 0, "user", "Gone?") for c in range(800, 860)]
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", audit string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(conversations.repair_conversations, "__defaults__", ("conv_id", "turn", "role", "text", piece_turns))
    got = [tuple(r) for r in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert any(g[-2] == "" for g in got)


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert conversations.fold_pieces(conversations.repair_conversations(rows)).collect() == []


def test_block_tables_say_what_single_steps_say():
    t = conversations.tables()
    rng = random.Random(2)
    for _ in range(200):
        symbols = [rng.randrange(conversations.SYMBOLS) for _ in range(rng.randrange(40))]
        bounds, cost = t.backward(symbols, t.end)
        vector = conversations.AT_END
        for s in reversed(symbols):
            vector = conversations.before(s, vector)
        assert tuple(c + cost for c in t.vectors[bounds[0]]) == vector
    assert len(t.vectors) < 100


def test_a_long_conversation_is_worked_on_by_many_tasks(spark):
    """No task of the passes holds more than a piece of the one conversation."""
    rows = spark.range(6000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id, if(id % 5 = 0, '', '.')) AS text")
    pieces = conversations.repair_conversations(rows, piece_turns=1000)
    got = pieces.collect()
    assert sorted(r.piece for r in got) == list(range(12)) and {r.pieces for r in got} == {12}
    assert max(len(r.repaired) for r in got) <= 1001
    [whole] = conversations.fold_pieces(pieces).collect()
    [at_once] = conversations.fold_pieces(conversations.repair_conversations(rows)).collect()
    assert whole == at_once
