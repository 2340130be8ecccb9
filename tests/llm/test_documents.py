"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from corpus_rows import TEXTS, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from stratawave.llm import exact, language, mixing, packing, perplexity, quality, sharding, simhash, tokenfile, tokens
from stratawave.llm.common import components, stored


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    size, weight = Counter(), {}
    for _, text, _, source in TEXTS:
        size[source] += len(words(text))
    for i, s in enumerate(sorted(size, key=lambda x: (x is None, x))):
        weight[s] = (5, 2, 1)[i % 3]
    open_, left, target = set(size), 1.5 * sum(size.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 2 * size[s] for s in full})
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mix_stage_repeats_whole_documents(spark, docs):
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["text"] for r in out.collect()} <= {t for _, t, _, _ in TEXTS}


@given(n=st.integers(1, 5000), seed=st.integers(0, 2**70))
@settings(max_examples=60, deadline=None)
def test_permutation(n, seed):
    x = np.arange(n)
    y = sharding.permuted(x, n, seed)
    assert sorted(y) == list(range(n))
    assert (sharding.permuted(y, n, seed, back=True) == x).all()


def test_shards(docs):
    got = sharding.shards(docs, 4).collect()
    assert sorted(r["row_number"] for r in got) == list(range(len(TEXTS)))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["shard"], r["slot"]) == sharding.place_of(r["row_number"], len(TEXTS), 4)
        assert sharding.row_at(r["shard"], r["slot"], len(TEXTS), 4) == r["row_number"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in TEXTS)


@pytest.mark.parametrize("block", [3, 64, exact.BLOCK])
def test_exact(docs, block):
    got = exact.duplicates(docs, block).collect()
    groups = defaultdict(list)
    for i, t, _, _ in TEXTS:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            want[i, keep, len(ids), left == 1, hashlib.sha256(t.encode()).hexdigest()] += 1
            left = 0
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_tells_equal_hashes_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(exact, "_signed", lambda block: len(block) % 2)
    got = exact.duplicates(docs, 16)
    assert got.filter("kept").count() == len({lower(t) for _, t, _, _ in TEXTS})


def brute_print(text):
    w = [x.encode() for x in words(lower(text))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for _, t, _, _ in TEXTS:
        assert simhash.fingerprint(t) == brute_print(t)
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_print(t)) for i, t, _, _ in TEXTS]
    seen = {p: {p} for _, p in prints}
    for _ in prints:
        for p in seen:
            for q in seen:
                if (p ^ q).bit_count() <= 2:
                    seen[p] = seen[q] = seen[p] | seen[q]
    want = Counter((i, f"{p:016x}", min((j for j, q in prints if q in seen[p] and j is not None), default=None)) for i, p in prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    table = simhash.decoder()
    assert len(np.unique(table)) == 4096 and (np.bincount(table) == 2048).all()
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(63, flips, replace=False):
                y[i] ^= np.int64(1) << np.int64(b)
        a, b = simhash.golay_keys(x), simhash.golay_keys(y)
        assert all(set(a[1][a[0] == i]) & set(b[1][b[0] == i]) for i in range(len(x)))


@pytest.mark.parametrize("crowd", [1, 64])
def test_links_connect_everything_near(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    x = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(25)})
    frame = spark.createDataFrame([(simhash.signed(v),) for v in x], "print long")
    parts = {r["node"] % (1 << 64): r["component"] for r in components(simhash.links(frame), "test").collect()}
    root = list(range(len(x)))
    for _ in x:
        for i in range(len(x)):
            for j in range(i):
                if (x[i] ^ x[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = [parts.get(v, simhash.signed(v)) for v in x]
    assert len(set(zip(got, root, strict=True))) == len(set(got)) == len(set(root))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = dict(plain(components(edges, "path")))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(-50, int(b)) for b in rng.integers(0, 40, 6)] * 2
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = plain(components(spark.createDataFrame(pairs, "a long, b long"), "random"))
    assert sorted(got) == sorted(root.items())


def test_components_take_few_stages(spark):
    """Spark keeps a thread of the driver for each stage of the last minute, so stages are what the driver's memory grows with."""
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11), (11, 12), (20, 20)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("components", "components")
    try:
        components(edges, "few")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    assert 0 < len(stages) <= 45


FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def whole(encoder, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,spaced", FILES)
def test_encoder_equals_whole_texts(name, spaced):
    encoder = tokens.Encoder(tokens.vocabulary(name), spaced, most=6)
    texts = [t for _, t, _, _ in TEXTS] + ["", None, " a", "a ", "\na b\n", "a\n\n\nb", "Σας ΑΣ Σ.", "İstanbul ǅ", "é ́x", "a  b", "\x01 a", "a. .b ,"]
    assert list(encoder(texts)) == whole(encoder, texts)


ENCODERS = {}


@given(text=st.text(st.sampled_from(list("abEé .,'\n\t1²_ßΣ́  \x01\x1c<|>")), max_size=40))
@settings(max_examples=300, deadline=None)
@pytest.mark.parametrize("name,spaced", FILES)
def test_encoder_on_random_texts(name, spaced, text):
    encoder = ENCODERS.setdefault(name, tokens.Encoder(tokens.vocabulary(name), spaced))
    assert list(encoder([text])) == whole(encoder, [text])


def test_token_files(spark, docs, tmp_path):
    path = tokens.vocabulary("word_bpe_49k.json")
    files = tokenfile.write_tokens(docs, f"file:{tmp_path}", path, 1)
    got = sorted(tokenfile.read_tokens(files, with_ids=True).collect(), key=lambda r: (r["part"], r["nth"]))
    encoder = tokens.Encoder(path, False)
    want = sorted(((i, [*np.frombuffer(b, "<u4").tolist(), 1]) for (i, *_), b in zip(TEXTS, whole(encoder, [t for _, t, _, _ in TEXTS]), strict=True)), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i or 0, x) for i, x in want)
    before = 0
    for r in got:
        assert r["start"] == before and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        before += r["n_tokens"]
    assert {r["doc_id"] for r in tokenfile.read_tokens(files, {7, 11}).collect()} == {7, 11}


def test_token_file_is_plain_zstandard_and_checked(tmp_path):
    path = str(tmp_path / "x.zst")
    writer = tokenfile.Writer(path, 2)
    for i in range(3):
        writer.add(i, np.arange(i * 100))
    writer.close()
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()[:200] == np.arange(100, dtype="<u2").tobytes()
    data = bytearray((tmp_path / "x.zst").read_bytes())
    reader = tokenfile.Reader(path)
    data[int(reader.starts[1]) + 12] ^= 1
    (tmp_path / "x.zst").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(path).ids(1)


@pytest.mark.parametrize("room", [16, 1024])
def test_packing(docs, room):
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path, 0, room).collect()
    encoder = tokens.Encoder(path, True)
    want = Counter()
    for (i, *_), b in zip(TEXTS, whole(encoder, [t for _, t, _, _ in TEXTS]), strict=True):
        ids = [*np.frombuffer(b, "<u4").tolist(), 0]
        for s in range(0, len(ids), room):
            want[i, s, len(ids[s:s + room]), zlib.crc32(np.array(ids[s:s + room], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    packs = defaultdict(list)
    for r in got:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in packs.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= room
    assert sorted(packs) == list(range(len(packs)))


def test_python_tasks_hold_no_free_memory():
    # In a process of its own, like a worker that has read five batches and waits for its next task.
    code = """
import re
import pyarrow as pa
from stratawave.llm import tokens

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def texts(batch):
    for x in batch.column(0).to_pylist():
        yield [len(x)]

source = lambda n: (pa.record_batch([pa.array([str(i % 7) * 4000 for i in range(10_000)])], names=["text"]) for _ in range(n))
task = tokens.batches(texts, pa.schema([("n", pa.int64())]))
before = held()
tokens.worker_state()["encoders"] = bytearray(60 << 20)
assert sum(b.num_rows for b in task(source(5))) == 50_000
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(out.stdout) < 20


def test_stored_hands_out_batches_of_few_rows(spark):
    def sizes(source):
        for batch in source:
            yield pa.record_batch([[batch.num_rows]], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    rows = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")
    assert sorted(r["n"] for r in stored(rows, "sizes", 1000).collect()) == [500, 1000, 1000]
    assert [r["n"] for r in stored(rows, "sizes").collect()] == [2500] and spark.conf.get(key) == usual
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        stored(spark.range(1).selectExpr("raise_error('DIVIDE_BY_ZERO') AS x"), "sizes", 1000)
    assert spark.conf.get(key) == usual


def test_texts_reach_the_tokenizer_in_small_batches(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "stored", lambda df, label, batch=0: asked.append((label, batch)) or stored(df, label, batch))
    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "'some words' AS text")
    assert packing.pack(docs).count() == 2500
    assert asked == [("pieces", 1000)]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
@settings(max_examples=60, deadline=None)
def test_patterns_hold_every_piece(histogram):
    found = packing.patterns(histogram, 64)
    used = Counter()
    for n, pack in found:
        assert n > 0 and sum(pack) <= 64
        for length in pack:
            used[length] += n
    assert used == Counter(histogram)


def test_quality_learns_from_unheld_rows_only(spark, docs, sf):
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.scores(texts, labels).collect()}
    assert len(got) == texts.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert {r["doc_id"]: r["score"] for r in quality.scores(texts, turned).collect()} == pytest.approx({i: r["score"] for i, r in got.items()})
    odd = quality.scores(docs, labels).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality.scores(docs, labels.filter("false")).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id")
    n, right = got.selectExpr("count(*)", "sum(CAST((score >= 0.7) = (quality = 1) AS INT))").first()
    assert right / n > 0.97


def test_isotonic_pools():
    at, rate = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 5, 1, 9]), np.array([10, 10, 10, 10]))
    assert len(at) == 3 and (np.diff(rate) > 0).all()


def test_language(spark, docs, none, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(texts)
    found = language.identify(texts, model).select("row.*", "lang_pred")
    assert found.filter("lang_pred = lang").count() / texts.count() > 0.9
    odd = plain(language.identify(docs, model).select("row.text", "lang_pred", language.F.col("`score`")))
    assert len(odd) == len(TEXTS)
    for text, lang, score in odd:
        assert (lang == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= score <= 1
    again = texts.withColumn("lang", language.F.when(language.remainder(language.F.col("doc_id"), 5) != 0, language.F.col("lang")))
    assert (language.train(again).weights == model.weights).all()
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none)).collect()} == {"und"}
    kept = language.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text = '1234 5678 !!'").count() == 0


@pytest.mark.parametrize("size", [7, 12])
def test_lm_scores_by_hand(spark, docs, size):
    ids = spark.createDataFrame([(1,), (2,), (7,), (None,)], "doc_id long")
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in perplexity.scores(docs, ids, size).collect())
    split = [[x.encode() for x in words(lower(t))] for _, t, _, _ in TEXTS]
    top = sorted(Counter(w for x in split for w in x).items(), key=lambda x: (-x[1], x[0]))[:size - 2]
    entry = {w: i for i, (w, _) in enumerate(top, 2)}
    rows = [[1, *(entry.get(w, 0) for w in x), 1] for x in split]
    pairs = [list(zip(r, r[1:], strict=False)) for r in rows]
    b = Counter(p for x in pairs for p in x)
    t = Counter(p for (i, *_), x in zip(TEXTS, pairs, strict=True) if i in (1, 2, 7) for p in x)
    scale = sum(t.values()) / sum(b.values())

    def loss(c, k, p):
        left = sum(n for q, n in c.items() if q[0] == p[0]) * k
        right = sum(n for q, n in c.items() if q[1] == p[1]) * k
        alone = (right + 1) / (sum(c.values()) * k + size)
        return -np.log((c[p] * k + perplexity.PRIOR * alone) / (left + perplexity.PRIOR))

    others = [[w for w in x if w not in entry] for x in split]
    ob = Counter(w for x in others for w in x)
    ot = Counter(w for (i, *_), x in zip(TEXTS, others, strict=True) if i in (1, 2, 7) for w in x)
    assert ob and (ot or size == 12)
    within = sum(ot.values()) / sum(ob.values())

    def gain(w):
        n = sum(ot.values()) + len(ob)
        return np.log((ob[w] * within + 1) / n) - np.log((ot[w] + 1) / n)

    want = Counter((i, len(x), round(float(np.mean([loss(t, 1, p) - loss(b, scale, p) for p in x]) + sum(map(gain, o)) / len(x)), 4))
                   for (i, *_), x, o in zip(TEXTS, pairs, others, strict=True))
    assert set(k[:2] for k in got) == set(k[:2] for k in want)
    assert sorted(k[2] for k in got.elements()) == pytest.approx(sorted(k[2] for k in want.elements()), abs=2e-3)


def test_empty_tables(spark, none, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix(none).count() == sharding.shards(none).count() == exact.duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == packing.pack(none).count() == quality.scores(none, labels).count() == 0
    assert perplexity.scores(none, labels).count() == language.identify(none, language.train(none)).count() == 0
    files = tokenfile.write_tokens(none, f"file:{tmp_path}", tokens.vocabulary("word_bpe_49k.json"), 1)
    assert tokenfile.read_tokens(files).count() == 0
