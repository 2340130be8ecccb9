"""Merkle manifest: positions, runs and proofs against whole trees built level by level."""

import hashlib
import random
from collections import defaultdict

import pytest
from corpus_rows import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from stratawave.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        lead = i - i % 3
        out += [(level[lead:i], level[i + 1:lead + 3])]
        i //= 3
    return out


@given(st.integers(1, 800))
@settings(max_examples=80, deadline=None)
def test_positions_are_the_completion_order(n):
    done, sizes = [], manifest.counts(n)
    for e in range(1, n + 1):  # nodes that are complete with leaf e, lower levels first
        done += [(j, (e - 1) // 3 ** j) for j in range(len(sizes)) if e == min(n, ((e - 1) // 3 ** j + 1) * 3 ** j)]
    assert len(done) == sum(sizes)
    assert [manifest.position(j, i, n) for j, i in done] == list(range(len(done)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 242, 243, 244, 486, 487, 730, 2188])
def test_runs_and_siblings(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    tops = []
    for start in range(0, n, manifest.BLOCK):
        run = manifest.build(leaves[start:start + manifest.BLOCK], start, n)
        first = manifest.position(0, start, n)
        tops.append(run[-1])
        for i in {start, min(n, start + manifest.BLOCK) - 1, (start + n) // 2} & set(range(start, min(n, start + manifest.BLOCK))):
            assert manifest.siblings(run, first, i, n) == [("".join(a), "".join(b)) for a, b in path_of(levels, i)][:len(manifest.siblings(run, first, i, n))]
            assert manifest.fold(leaves[i], [("".join(a), "".join(b)) for a, b in path_of(levels, i)]) == levels[-1][0]
    assert tops == levels[min(len(levels) - 1, manifest.LEVELS)]


def brute(rows, cut):
    def leaf(doc_id, text, lang, source, n_chars):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    trees = defaultdict(list)
    for r in rows:
        text = r[1].replace("\n", "") if r[1] is not None and cut(r[0]) else r[1]
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], text, *r[2:]), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = levels_of([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = path_of(built[s], i) + path_of(top, k)
            node = x[3]
            for a, b in path:
                node = h(*a, node, *b)
            out.append((x[4], x[2], built[s][-1][0], top[-1][0], h(*("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs, monkeypatch):
    extra = random.Random(4)
    rows = [(i, f"a\nb {i}" if i % 3 else f"text {i}", "en", extra.choice(["hot", "hot", "Ü", "cold", None, "z"]), i) for i in range(2000)]
    rows += [(*x[:2], *x[2:], len(x[1] or "")) for x in TEXTS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit("x")).withColumn("tree", F.lit(1)).repartition(5)
    cut = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    for levels in (5, 2):  # two levels: five tiers
        monkeypatch.setattr(manifest, "LEVELS", levels)
        monkeypatch.setattr(manifest, "BLOCK", 3 ** levels)
        got = sorted((tuple(r) for r in manifest.proofs(frame, cut).collect()), key=str)
        assert got == brute(rows, lambda i: i is not None and i % 2 == 0)


def test_whole_rows_verify(spark, docs, none):
    got = manifest.proofs(docs).collect()
    assert len(got) == len(TEXTS)
    assert all(r["verified"] for r in got)
    assert manifest.proofs(none).count() == 0
    one = manifest.proofs(docs.filter("doc_id = 12")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"]
    assert one["proof_sha256"] == h()
