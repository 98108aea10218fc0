"""The command line, from dialogues to memories, texts and graphs."""

from __future__ import annotations

import json

import pytest

from palimpsest.__main__ import run
from palimpsest.plans import compress

SAID = {"conv_id": 7, "dialogue": [{"role": "user", "content": "My name is Ada and Bob works at Acme."}, {"role": "assistant", "content": "Acme is a company. Who is Carol?"}, {"role": "user", "content": "Carol works for Acme."}]}


def test_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "said.json").write_text(json.dumps(SAID))
    (tmp_path / "own.json").write_text(json.dumps({"preset": "aggressive", "budget": 300, "rounds": 5}))
    assert run(spark, ["health"]).startswith("ok")
    run(spark, ["extract", at("said.json"), at("memory")])
    facts = {(r.subject, r.predicate, r.object) for r in spark.read.json(at("memory/facts")).collect()}
    assert ("User", "has name", "Ada") in facts and ("Carol", "works at", "Acme") in facts
    run(spark, ["merge", at("both"), at("memory"), at("memory")])
    assert spark.read.json(at("both/facts")).count() == len(facts)
    run(spark, ["visualize", at("memory"), at("graph"), "--form", "dot"])
    assert spark.read.json(at("graph")).first().text.startswith("digraph")
    run(spark, ["export", at("memory"), at("rows"), "--form", "csv"])
    assert spark.read.option("header", True).csv(at("rows")).filter("type = 'fact'").count() == len(facts)
    run(spark, ["compress", at("said.json"), at("out"), "--config", at("own.json")])
    got = spark.read.json(at("out")).first()
    assert got.conv_id == 7 and "Acme" in got.text and got.compressed_tokens > 0
    assert "entity_recall" in run(spark, ["evaluate", at("said.json"), "--config", at("own.json")])


def test_settings(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"preset": "aggressive", "budget": 300}))
    c = compress.read_config(str(tmp_path / "own.json"))
    assert (c.budget, c.form) == (300, compress.PRESETS["aggressive"].form)
    (tmp_path / "bad.json").write_text(json.dumps({"what": 1}))
    with pytest.raises(ValueError):
        compress.read_config(str(tmp_path / "bad.json"))
