"""The trained models against plain versions that see all rows at once."""

import math
import zlib

import numpy as np
import pytest

from stratawave.llm import language, quality


def test_language_against_plain_ftrl(spark, monkeypatch):
    """One learner, plain dictionaries and loops; copies of one text are one row that counts 1 + ln(copies) times."""
    monkeypatch.setattr(language, "LEARNERS", 1)
    monkeypatch.setattr(language, "PASSES", 2)
    words = {"en": "the house and the tree", "de": "das haus und der baum", "fr": "la maison et le chat"}
    rows = [(i, f"{w} {i % 7}", lang) for i, (lang, w) in enumerate(list(words.items()) * 30)]
    rows += [(1000 + i, "der hund", "de") for i in range(40)] + [(3000, None, "en"), (3001, "text", None), (None, "chat", "fr")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    known = [r for r in rows if r[0] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    langs = sorted({r[2] for r in known})
    grams = {t: dict(zip(*(x.tolist() for x in language.counts(t)), strict=True)) for _, t, _ in known if t}
    texts = [t for _, t, _ in known if t]
    idf = {g: math.log((1 + len(texts)) / (1 + sum(g in grams[t] for t in texts))) + 1 for t in texts for g in grams[t]}
    sql = spark.createDataFrame([(r[0],) for r in known], "doc_id long").selectExpr("doc_id", "pmod(xxhash64('fold', doc_id), 5) = 0 AS c").collect()
    calibrates = {r["doc_id"]: r["c"] for r in sql}
    copies = {}
    for i, t, lang in known:
        if t and any(map(str.isalpha, t)) and not calibrates[i]:
            copies[t, lang] = copies.get((t, lang), 0) + 1
    stored = [(langs.index(lang), np.stack([list(grams[t]), list(grams[t].values())]).astype("<i4").tobytes(), t, n) for (t, lang), n in copies.items()]
    hashed = spark.createDataFrame([(bytearray(g), y) for y, g, _, _ in stored], "grams binary, y int").selectExpr("xxhash64(grams, y) AS h", "grams", "y").collect()
    place = {(bytes(r["grams"]), r["y"]): r["h"] for r in hashed}
    z, n2 = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= language.L1:
            return 0.0
        return -(z[k] - math.copysign(language.L1, z[k])) / ((language.BETA + math.sqrt(n2[k])) / language.ALPHA + language.L2)

    for _ in range(2):
        for y, _, t, c in sorted(stored, key=lambda r: (place[r[1], r[0]], r[1], r[0])):
            x = {g: (1 + math.log(n)) * idf[g] for g, n in grams[t].items()}
            size = math.sqrt(sum(v * v for v in x.values()))
            w = {(g, j): weight((g, j)) for g in x for j in range(len(langs))}
            logits = [sum(v / size * w[g, j] for g, v in x.items()) for j in range(len(langs))]
            top = max(logits)
            p = [math.exp(v - top) for v in logits]
            for g, v in x.items():
                for j in range(len(langs)):
                    d = v / size * (p[j] / sum(p) - (j == y)) * (1 + math.log(c))
                    old = n2.get((g, j), 0.0)
                    z[g, j] = z.get((g, j), 0.0) + d - (math.sqrt(old + d * d) - math.sqrt(old)) / language.ALPHA * w[g, j]
                    n2[g, j] = old + d * d
    assert model.languages == langs
    want = np.zeros_like(model.weights)
    for (g, j) in z:
        want[g, j] = weight((g, j))
    np.testing.assert_allclose(model.weights, want, atol=1e-9)
    assert (want != 0).sum() > 50


def test_quality_against_one_ridge(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "b", "Cc!", "12", "dddd"], rng.integers(1, 60))) + "." * int(rng.integers(0, 9)) for _ in range(400)]
    y = [int(len(t) % 2 == 0 or len(t) > 90) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, labels, features=32).collect()}
    x = np.array([quality.statistics(t) for t in texts], np.float32).astype(float)
    crc = [zlib.crc32(str(i).encode()) % 4 for i in range(400)]
    part = [zlib.crc32(f"{i}c".encode()) % 5 == 0 for i in range(400)]
    fit = [i for i in range(400) if i % 3 and crc[i] != 2 and not part[i]]
    back = [i for i in range(400) if i % 3 and crc[i] != 2 and part[i]]
    mean = x[fit].mean(0)
    kernel = quality.Kernel(mean, np.sqrt(np.maximum(0, (x[fit] ** 2).mean(0) - mean ** 2)), 32, 1)
    phi, target = kernel(x), np.array(y, float)
    ridge = np.diag([*[1.0] * 32, 0.0]) * quality.PENALTY * len(fit) / 32
    raw = phi @ np.linalg.solve(phi[fit].T @ phi[fit] + ridge, phi[fit].T @ target[fit])
    at = np.clip(((raw[back] + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = sorted(set(at.tolist()))
    rate = [(sum(target[back][at == b]), sum(at == b)) for b in used]
    pools = [[(b + 0.5) / quality.BINS * 2 - 0.5, h, n] for b, (h, n) in zip(used, rate, strict=True)]
    merged = True
    while merged:  # pool the first pair that falls, until none does
        merged = False
        for k in range(len(pools) - 1):
            (s, h, n), (s2, h2, n2) = pools[k], pools[k + 1]
            if h / n >= h2 / n2:
                pools[k:k + 2] = [[(s * n + s2 * n2) / (n + n2), h + h2, n + n2]]
                merged = True
                break
    want = 0.999 * np.interp(raw, [p[0] for p in pools], [(p[1] + 0.1) / (p[2] + 0.2) for p in pools]) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-6)
