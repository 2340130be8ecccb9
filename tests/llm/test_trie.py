"""The conversation trie against brute force: shared starts, hot copies, long conversations, ties and odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stratawave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, pos long, key string"


def brute(rows):
    """Nodes by dictionaries of whole paths."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            data = f"{len(role.encode())}:{role}{text}".encode()
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(data).digest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in turns.items():
        h = 0 if c % 5 == 0 else zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + v[h:])
    nodes = defaultdict(lambda: {"convs": [], "ends": [], "children": set()})
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            node = nodes[paths[c][:d]]
            node["convs"].append(c)
            if d == len(paths[c]):
                node["ends"].append(c)
            else:
                node["children"].add(paths[c][d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, node in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not node["children"]
            saved[p[:d]] += (len(node["convs"]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((x["convs"][0], len(p), nodes[p[:-1]]["convs"][0] if p else -1, len(x["convs"]), len(x["children"]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, x["ends"])).encode()).hexdigest()) for p, x in nodes.items())


def result(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*x, "n", 1, "k") for x in rows], SCHEMA).repartition(parts)


def conversations(seed, convs=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(0, 14))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], ["", "a", "Ü bé", None, "long " * 20][int(rng.integers(0, 5))]))
    return rows


@pytest.mark.parametrize(("size", "per_shard"), [(64, 10_000), (3, 7), (1, 3), (4, 40)])
def test_against_brute_force(spark, size, per_shard):
    rows = conversations(size)
    rows += [(c, t, "user", f"{t}") for c in range(500, 800, 5) for t in range(6)]  # a hot group of copies
    rows += [(c, t, "user", f"{t}") for c in range(800, 830, 5) for t in range(4)]  # and its prefixes
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(60)] + [(1005, t, "user", f"long {t % 7}") for t in range(50)]
    rows += [(1001, t, "user", "x") for t in range(2)]
    got = trie.trie(*trie.rebuilt(trie.ordered(made(spark, rows))), size=size, per_shard=per_shard)
    assert result(got) == brute(rows)


def test_odd_rows(spark):
    rows = [(7, None, None, None), (7, None, "user", ""), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "bot", "y"),
            (None, 1, "user", "no id"), (12, 5, "user", "b" * 300_000), (10, 2, "", None), (10, -1, None, ""), (-3, 0, "a", "b")]
    want = brute([r for r in rows if r[0] != -3])
    assert result(trie.trie(*trie.rebuilt(trie.ordered(made(spark, [r for r in rows if r[0] != -3]))))) == want
    assert trie.trie(*trie.rebuilt(trie.ordered(made(spark, rows)))).filter("depth = 0").first()["n_convs"] == 4
    assert trie.trie(*trie.rebuilt(trie.ordered(made(spark, rows).limit(0)))).count() == 0


def test_roles_and_texts_are_told_apart(spark):
    rows = [(5, 1, "ab", "c"), (10, 1, "a", "bc"), (15, 1, "ab", "c")]
    got = trie.trie(*trie.rebuilt(trie.ordered(made(spark, rows))))
    assert sorted(r["n_convs"] for r in got.filter("depth = 1").collect()) == [1, 2]


def test_turns_are_numbered_within_hot_conversations(spark):
    turns = trie.ordered(made(spark, [(3, t, "u", str(t)) for t in range(5000)] + [(4, 0, "u", "x")], 9))
    got = turns.filter("conv_id = 3").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 5001))
    assert [r["size"] for r in got] == [len(str(t)) for t in range(5000)]
