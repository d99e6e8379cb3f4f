import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from veracity.llm import viterbi_repair as V
from veracity.llm.queries import op13_viterbi_repair

LETTERS = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        row = (conv, turn, "user" if h == 4 else role, text)
        out += [row, row] if h == 3 else [row]
    return out


def in_order(rows):
    """One conversation's rows as the operator takes them."""
    def key(r):
        conv, turn, role, text = r
        name = "-" if conv is None else str(conv)
        return turn is not None, turn or 0, hashlib.md5(f"{name}:{len(role)}:{role}{text}".encode()).digest()
    return sorted(rows, key=key)


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        inked = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_audit(rows, found):
    """(cost, audit, lines) by a forward search that keeps the least (cost, audit) of each prefix of the roles' pattern."""
    nxt = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ())}

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def inserted(table):
        for _ in range(4):
            for s, (c, a, lines) in list(table.items()):
                for x in "ua":
                    if x in nxt[s]:
                        better(table, nxt[s][x], (c + 5, a + "I", (*lines, LETTERS[x] + ":")))
        return table

    for (_, _, role, text), fault in zip(rows, found, strict=True):
        table = {}
        for s, (c, a, lines) in inserted(best).items():
            better(table, s, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            stays = 5 if fault else 0
            if role[:1] in nxt[s]:
                better(table, nxt[s][role[:1]], (c + stays, a + "K", (*lines, f"{role}:{text}")))
            for x in "ua":
                if x in nxt[s]:
                    better(table, nxt[s][x], (c + 1 + stays, a + "R", (*lines, f"{LETTERS[x]}:{text}")))
        best = table
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def plain(rows, damaged):
    by_conv = defaultdict(list)
    for r in damaged:
        by_conv[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = in_order(by_conv[conv])
        turns = {r[1] for r in own if r[1] is not None}
        found = faults(own)
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        cost, audit, lines = plain_audit(own, found)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [(r["conv_id"], tuple(r[c] for c in cols)) for r in df.collect()]
    assert len(got) == len({c for c, _ in got})
    return dict(got)


def conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        mood = rng.random()
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "admin"])
            if mood < 0.5:
                role = ["user", "assistant"][turn % 2]
            end = rng.choice([".", "!", "", ".", " ."] if mood < 0.8 else [""])
            text = rng.choice(["", " \n", None, "same" + end, f"text {rng.randint(0, 9)} {end}", f"one {turn}{end} \t", f"zwei {turn * 7}{end}"])
            rows.append((conv, None if rng.random() < 0.03 else turn + rng.randint(0, 1), role, text))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_plain_search_is_least():
    """The forward search against all edit sequences of small cases."""
    rng = random.Random(5)
    for _ in range(40):
        rows = [(1, i, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["", "a.", "b.", "c", "a."])) for i in range(rng.randint(0, 3))]
        found = faults(rows)
        options = []
        for audit in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(rows) * 2 + 3)):
            if sum(x != "I" for x in audit) != len(rows):
                continue
            for free in itertools.product("ua", repeat=sum(x in "IR" for x in audit)):
                free, at, cost, roles, ok = list(free), 0, 0, "", True
                for x in audit:
                    if x == "I":
                        cost, roles = cost + 5, roles + free.pop(0)
                        continue
                    fault, role = found[at], rows[at][2]
                    at += 1
                    if x == "D":
                        cost += 2
                        continue
                    ok &= fault not in ("blank", "duplicate")
                    cost += (x == "R") + (5 if fault == "truncated" else 0)
                    roles += role[0] if x == "K" else free.pop(0)
                if ok and LEGAL.match(roles):
                    options.append((cost, "".join(audit)))
        assert min(options) == plain_audit(rows, found)[:2]


@pytest.mark.parametrize("chunk", [3, 256])
def test_against_plain_search(spark, chunk):
    rows = conversations(1, [*range(60), None], 12)
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = V.damage(df)
    assert sorted(damaged.collect(), key=repr) == sorted(plain_damage(rows), key=repr)
    assert made(V.audit(df, damaged, chunk)) == plain(rows, plain_damage(rows))


@pytest.mark.parametrize("kind", ["mixed", "truncated", "blank", "twice"])
def test_conversation_over_many_parts(spark, kind):
    """Half of all rows are one conversation, which lies in several parts; in the uniform ones no run forgets its end."""
    rows = conversations(2, range(30), 8)
    rng = random.Random(3)
    for i in range(400):
        role = rng.choice(["user", "assistant", "system", "user"]) if kind == "mixed" else ["user", "assistant"][i % 2]
        text = {"mixed": f"{i}" + rng.choice(["", ".", "!"]), "truncated": f"open {i}", "blank": " ", "twice": f"again {i % 5}."}[kind]
        rows.append((7, 100 + i, role, text))
    rows = [r for r in rows if r[0] != 7 or r[1] is not None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = V.audit(df, V.damage(df), 16)
        assert made(got) == plain(rows, plain_damage(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_fix_up_passes_meet_and_end():
    """A run from the wrong end gives the same vectors as from the right one once they have met; a basis answers every end."""
    rng = random.Random(9)
    costs = V.Costs()
    ends = [costs.number(v) for v in (V._ENDS, (5, 5, 0, 5), (2, 0, 5, 1))]
    for _ in range(200):
        rows = bytes(4 * rng.choice([0, 0, 0, 1, 2, 3]) + rng.randint(0, 3) for _ in range(rng.randint(1, 60)))
        old, new = rng.sample(ends, 2)
        start = costs.start(rows, old)
        assert costs.start(rows, new, old, start) == costs.backward(rows, new)[-1]
        run = V._Run(0, 0, basis=costs.basis(rows))
        for e in ends:
            assert run.from_basis(costs.vectors[e]) == costs.vectors[costs.start(rows, e)]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (1, 5, "user", "x" * 300_000), (1, 5, "user", "x" * 300_000), (1, 6, "assistant", "ok."),
            (2, None, "", ""), (3, 9, "admin", "yes!"), (3, -(2**62), "user", "go."), (3, -(2**62), "user", "go.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("kind", "part", "seq", "uid", "audit", "h", "n"):
        df = df.withColumn(c, df["role"])
    assert made(V.audit(df, V.damage(df))) == plain(rows, plain_damage(rows))
    none = spark.createDataFrame([], SCHEMA)
    assert V.audit(none, V.damage(none)).collect() == []
    # all rows of a conversation dropped
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "a.")], SCHEMA)
    assert made(V.audit(one, V.damage(one))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert made(op13_viterbi_repair(spark, sf)) == plain(rows, plain_damage(rows))
