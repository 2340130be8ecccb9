"""Stored model tables: newest version per model, replaced versions, named models."""

import pytest

from stratawave.sources.models import load_models, save_models


def test_newest_version_of_each_model(spark, tmp_path):
    path = str(tmp_path / "models")
    make = lambda rows: spark.createDataFrame(rows, "model string, regime string, b array<double>")
    save_models(make([("a", "low", [1.0]), ("a", "high", [2.0]), ("b", "low", [3.0])]), path, "v1")
    save_models(make([("a", "pooled", [4.0])]), path, "v2")
    got = {(r["model"], r["version"], r["regime"]) for r in load_models(spark, path).collect()}
    assert got == {("a", "v2", "pooled"), ("b", "v1", "low")}
    assert {r["regime"] for r in load_models(spark, path, models=["a"], version="v1").collect()} == {"low", "high"}
    # The same version again replaces its rows and leaves the other version alone.
    save_models(make([("a", "again", [5.0])]), path, "v2")
    got = {(r["model"], r["regime"]) for r in load_models(spark, path, make([])).collect()}
    assert got == {("a", "again"), ("b", "low")}
    assert load_models(spark, path, make([])).columns[:2] == ["model", "version"]


def test_version_names(spark, tmp_path):
    with pytest.raises(ValueError):
        save_models(spark.createDataFrame([("a",)], "model string"), str(tmp_path), "x/y")
