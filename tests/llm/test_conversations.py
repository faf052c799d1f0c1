from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from attestry.llm import queries, repair, trie

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """First fault of each row: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(initials, found):
    """Least cost and edits, by trying everything row by row over the whole conversation."""
    grammar = lambda given, r: r == "s" if given is None and r == "s" else r == ("u" if given in (None, "s", "a") else "a")

    @cache
    def best(i, given, inserted):
        ways = []
        if i == len(initials) and given in (None, "a"):
            ways.append((0, ""))
        if inserted < 4:
            step = "a" if given == "u" else "u"
            more = best(i, step, inserted + 1)
            if more:
                ways.append((more[0] + 3, "I" + more[1]))
        if i < len(initials):
            cut = 3 if found[i] == 3 else 0
            options = [("D", 4, given)]
            if found[i] in (0, 3):
                options += [("K", cut, initials[i])] if grammar(given, initials[i]) else []
                options += [("R", 3 + cut, r) for r in "ua" if grammar(given, r)]
            for letter, cost, after in options:
                rest = best(i + 1, after, 0)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1]))
        return min(ways, default=None)

    return best(0, None, 0)


def replayed(rows, audit):
    out, i = [], 0
    for letter in audit:
        given = out[-1][0] if out else None
        step = "assistant" if given == "user" else "user"
        if letter == "I":
            out.append((step, ""))
            continue
        if letter == "K":
            out.append(rows[i])
        elif letter == "R":
            out.append((step, rows[i][1]))
        i += 1
    return out


def slow_repair(table):
    one = lambda x: " " if x is None else x
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, [])
        hit = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        rows = [r[1:] for r in rows]
        found, initials = faults(rows), [r[0][:1] for r in rows]
        cost, audit = cheapest(tuple(initials), tuple(found))
        text = "\n".join(f"{r}:{t}" for r, t in replayed(rows, audit))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, found.count(1), found.count(2), found.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation_table(seed, convs=25, most=30):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "done. ", None, "é。", "a\nb."]
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t, t + 2, None, t - 1])
            out.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ai"]), rng.choice(texts) if rng.random() < 0.6 else f"line {rng.random()}."))
    out += [(None, 1, "user", "No id."), (None, None, "assistant", "No id either."), (-7, 0, "system", "Alone.")]
    return out


def written(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("own")).withColumn("pos", F.lit(3)).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("seed", range(3))
def test_repair_against_trying_everything(spark, tmp_path, seed):
    rows = conversation_table(seed)
    got = {r["conv_id"]: tuple(r) for r in queries.op12_conversation_repair(spark, written(spark, tmp_path, rows)).collect()}
    assert got == slow_repair(rows)


def test_segments_and_ranges_change_nothing(spark):
    rows = conversation_table(9, convs=6, most=60)
    held = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    pick = lambda fixed: (sorted(map(tuple, fixed.audits.collect())), sorted(map(tuple, repair.digests(fixed.rows).collect())))
    whole = pick(repair.repair(held))
    assert pick(repair.repair(held, segment=3, per_range=20)) == whole
    assert pick(repair.repair(held, segment=1)) == whole


def test_signatures_one_by_one():
    digits = "0147a3b9f5"
    for signature in map("".join, itertools.product(digits, repeat=3)):
        roles, found = ["suax"[int(c, 16) // 4] for c in signature], [int(c, 16) % 4 for c in signature]
        cost, told, tail = repair.chain([[dict(zip(("enter", "leave", "cost", "audit"), w)) for w in repair.solve(signature)[-1]]])
        assert (cost, told[0][1] + tail) == cheapest(tuple(roles), tuple(found)), signature


def test_repair_of_empty_and_long(spark, tmp_path):
    assert queries.op12_conversation_repair(spark, written(spark, tmp_path / "none", [])).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 60_000 + f"{t}.") for t in range(4)]
    assert {r["conv_id"]: tuple(r) for r in queries.op12_conversation_repair(spark, written(spark, tmp_path / "long", rows)).collect()} == slow_repair(rows)


def slow_trie(table):
    convs = {}
    for conv, turn, role, text in table:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [r[2:] for r in sorted(rows)] for c, rows in convs.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = int(c - (c % 5 if c >= 0 else -(-c % 5)))
        built = turns.get(family, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            node = nodes.setdefault(tuple(built[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(built):
                node["ends"].append(c)
    out = []
    for path, node in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        has = {p[:-1] for p in nodes if p}
        out.append((
            min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(node["members"]), sum(len(p) == len(path) + 1 for p in below),
            sum(p not in has for p in below), sum((len(nodes[p]["members"]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain_prefixes(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice([t, None, t // 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, "", "c" * 50])) for c in rng.sample(range(-10, 60), 40) for t in range(rng.choice([1, 3, 12, 20]))]
    rows += [(None, 1, "user", "no id")]
    got = queries.op13_prefix_trie(spark, written(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_trie(rows)


def test_trie_of_one_long_conversation_and_of_none(spark, tmp_path):
    assert queries.op13_prefix_trie(spark, written(spark, tmp_path / "none", [])).count() == 0
    rows = [(5, t, "user", f"turn {t}") for t in range(70)] + [(6, t, "user", f"turn {t}") for t in range(65)]
    got = queries.op13_prefix_trie(spark, written(spark, tmp_path / "long", rows))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_trie(rows)


def test_ranges_change_nothing(spark):
    rows = spark.createDataFrame([(c, t, "user", f"{t if t < 4 else c % 3}") for c in range(30) for t in range(c % 11)], SCHEMA)
    convs = rows.select("conv_id").distinct()
    pick = lambda per: sorted(map(tuple, trie.prefix_trie(convs, trie.numbered_turns(rows, per), per).collect()), key=repr)
    assert pick(7) == pick(100_000)
