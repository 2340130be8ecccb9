import numpy as np
import pytest
from stratawave.llm import shingles, simhash


def words_of(rng, n):
    return [f"w{i}" for i in rng.integers(0, 30_000, n)]


def changed(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"x{rng.integers(0, 1 << 40)}"
    return out


def brute(texts):
    """Least index that each text reaches over pairs of similarity 0.8 or more, and those pairs' number."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root, n = list(range(len(texts))), 0
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return root, len(links)


@pytest.mark.parametrize("crowd", [64, 3])
def test_stage_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "PIVOTS", 2)
    rng = np.random.default_rng(5)
    texts = []
    for i in range(60):  # one to three words changed: similarities from below 0.8 to 0.96
        base = words_of(rng, int(rng.integers(60, 300)))
        texts += [" ".join(base), *(" ".join(changed(rng, base, int(rng.integers(1, 4)))) for _ in range(i % 4))]
    base = words_of(rng, 120)
    texts += [" ".join(changed(rng, base, int(rng.integers(1, 5)))) for _ in range(80)]  # a group beyond the crowd
    texts += ["one two", "one two three", "ONE  two", "word"]
    root, n = brute(texts)
    assert n > 100
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.stage(spark, frame, "").collect()) == sorted(set(root))


def test_recall_of_bands_at_the_limit():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(1000):  # 80 of 100 shingles in common
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        missed += not set(shingles.band_keys(x[:90]).tolist()) & set(shingles.band_keys(x[10:]).tolist())
    assert missed <= 1


def test_null_and_empty(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (None, None), (3, "a b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.stage(spark, frame, "").collect()) == [1, 3]
    assert simhash.stage(spark, frame.limit(0), "").count() == 0


def test_linked_fingerprints_are_candidates(spark):
    rng = np.random.default_rng(7)
    base = words_of(rng, 4000)
    apart = words_of(rng, 4000)
    texts = [" ".join(base), " ".join(changed(rng, base, 1)), " ".join(apart)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shingles.sketches(frame).localCheckpoint()
    of = {r["doc_id"]: r["node"] for r in rows.collect()}
    assert {r["print"] for r in rows.collect()} == {shingles.signed(shingles.majority(shingles.shingles(t))) for t in texts}
    no_bands = rows.withColumn("keys", rows["keys"].cast("array<long>")).selectExpr("doc_id", "digest", "node", "n", "print", "array_except(keys, keys) AS keys")
    found = shingles.links(no_bands, frame, simhash.links).collect()
    assert {(r["a"], r["b"]) for r in found} == {(min(of[0], of[1]), max(of[0], of[1]))}


def test_pairs_of_fingerprints(spark):
    rows = spark.createDataFrame([(1, 9, 7), (2, 9, 7), (3, 9, 4), (4, 9, -1), (5, 0, 7)], "node long, n int, print long")
    got = {(r["a"], r["b"]) for r in shingles.close(rows, simhash.links).collect()}
    assert got == {(1, 2), (1, 3)}  # an empty set is no candidate


def test_a_pair_is_one_row(spark):
    sketch = [0] * shingles.SKETCH
    sets = [(key, node, 100, node, sketch, [5, 6, 7], [node % 2]) for key in (5, 6, 7) for node in (1, 2, 3)]
    keyed = spark.createDataFrame(sets, "key long, node long, n int, part long, sketch array<long>, all array<long>, met array<long>")
    assert sorted((r["a"], r["b"]) for r in shingles._compared(keyed).collect()) == [(1, 2), (2, 3)]
