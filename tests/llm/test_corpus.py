"""Registered queries and the pipeline on the smallest tables."""

import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from compare import difference, duck
from stratawave.llm import exact, language, mixing, packing, simhash

from stratawave import llm


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_oracle(spark, sf, name):
    assert difference(entry.queries()[name](spark, sf).toPandas(), duck(sf).execute(entry.oracle_sql()[name]).df()) is None


def test_names():
    assert sorted(int(x[2:].split("_")[0]) for x in llm.QUERIES) == list(range(1, 14))
    assert {"pipeline", *llm.QUERIES} <= set(entry.queries())


def least_of_groups(rows):
    """Least doc_id of each group of texts whose five-word shingles have a similarity of 0.8 or more, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))))
    group = [i for i, _ in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for _ in rows:
        before = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if before == group:
            return set(group)
    return set(group)


def test_pipeline_by_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = language.stage(spark, docs, sf)
    model = language.train(docs)
    want = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if (p := model(r["text"]))[0] != "und" and p[1] >= language.LEAST_SCORE}
    assert {r["doc_id"] for r in first.collect()} == want
    second = exact.stage(spark, first, sf)
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(r["doc_id"] for r in exact.duplicates(first).filter("kept").collect())
    third = simhash.stage(spark, second, sf)
    assert {r["doc_id"] for r in third.collect()} == least_of_groups([(r["doc_id"], r["text"]) for r in second.collect()])
    fourth = mixing.stage(spark, third, sf)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(third).collect()}
    counts = {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    last = packing.stage(spark, fourth, sf)
    got = corpus_pipeline.run(spark, sf)
    assert sorted(got.drop("sequence_id", "offset").collect()) == sorted(last.drop("sequence_id", "offset").collect())
    assert [x for x, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "packing"]


def test_pipeline_survives_odd_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
