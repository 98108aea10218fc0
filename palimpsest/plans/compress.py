"""From turns to a compressed context: extraction, passes, text, ratio."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens_quarter
from palimpsest.ir import Memory
from palimpsest.operators import evaluation, extraction, temporal
from palimpsest.plans import generation, passes


@dataclass(frozen=True)
class Config:
    """What a compression does; presets by name."""

    budget: int = 2048
    form: str = "structured"
    recency: int = 10
    min_confidence: float = 0.5
    similarity: float = 0.85
    min_sequence: int = 3
    gap: int = 5
    min_importance: float = 0.1
    dead: bool = True
    fold: bool = True
    temporal: bool = True
    prune: bool = True
    rounds: int = 100


PRESETS = {"default": Config(), "aggressive": Config(budget=1024, form="bullets", recency=5, min_confidence=0.6, min_importance=0.2),
           "conservative": Config(budget=4096, recency=20, min_confidence=0.3, min_importance=0.05, temporal=False)}


def config(said: str | dict | Config = "default") -> Config:
    """A preset's name, or values over the default's; what is unknown is an error."""
    if isinstance(said, Config):
        return said
    if isinstance(said, str):
        if said not in PRESETS:
            raise ValueError(f"unknown preset {said}; there are {', '.join(PRESETS)}")
        return PRESETS[said]
    if odd := set(said) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings {', '.join(sorted(odd))}")
    return replace(Config(), **said)


def read_config(path: str) -> Config:
    """Settings of a JSON file, or of a YAML file where a YAML library is there; `preset` names what they are laid over."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(text) or {}
    else:
        values = json.loads(text)
    return config({**vars(config(values.pop("preset", "default"))), **values})


def optimise(memory: Memory, c: Config) -> Memory:
    """The passes in their order, once."""
    memory = passes.checkpointed(memory)
    if c.dead:
        memory = passes.checkpointed(passes.dead_memory(memory, c.recency, min_confidence=c.min_confidence))
    if c.fold:
        memory = passes.fold_facts(memory, c.similarity)
    if c.temporal:
        memory = passes.checkpointed(temporal.compress(memory, c.min_sequence, c.gap))
    if c.prune:
        memory = passes.checkpointed(passes.prune(memory, c.budget, c.min_importance, rounds=c.rounds))
    return memory


def tokens_of(turns: DataFrame) -> DataFrame:
    """(conv_id, original_tokens) of all turns as lines."""
    return turns.groupBy("conv_id").agg(F.floor((F.sum(F.length(F.concat("role", F.lit(": "), "content"))) + F.count(F.lit(1)) - 1) / 4).cast("long").alias("original_tokens"))


def compress(turns: DataFrame, said: str | dict | Config = "default", memory: Memory | None = None) -> DataFrame:
    """(conv_id, text, original_tokens, compressed_tokens, ratio); an empty conversation has ratio 1."""
    c = config(said)
    return written(turns, optimise(memory or extraction.extract(turns), c), c)


def written(turns: DataFrame, memory: Memory, c: Config) -> DataFrame:
    """What compress() returns, of a memory that the passes are done with."""
    text = generation.adaptive(memory, c.form, c.budget).select("conv_id", "text")
    out = tokens_of(turns).join(text, "conv_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    n = tokens_quarter(F.col("text"))
    return out.select("conv_id", "text", "original_tokens", n.alias("compressed_tokens"), F.when(F.col("original_tokens") > 0, n / F.col("original_tokens")).otherwise(1.0).alias("ratio"))


def evaluate(turns: DataFrame, said: str | dict | Config = "default") -> DataFrame:
    """(conv_id, ratio, fact_recall, entity_recall, tokens_saved): a compression against all that was extracted; of nothing, all is kept."""
    c = config(said)
    whole = passes.checkpointed(extraction.extract(turns))
    kept = optimise(whole, c)
    out = written(turns, kept, c).select("conv_id", "ratio", (F.col("original_tokens") - F.col("compressed_tokens")).alias("tokens_saved"))
    for name, recall in (("fact_recall", evaluation.fact_recall(whole.facts, kept.facts)), ("entity_recall", evaluation.entity_recall(whole.entities, kept.entities))):
        out = out.join(recall.select("conv_id", F.col("recall").alias(name)), "conv_id", "left")
    return out.fillna(1.0, ["fact_recall", "entity_recall"])


def compress_incremental(memory: Memory, new_turns: DataFrame, said: str | dict | Config = "default") -> DataFrame:
    """New turns into the memory there is, then all passes again."""
    grown = extraction.extract_incremental(memory, new_turns)
    return compress(grown.turns, said, grown)


def prefixes(turns: DataFrame, every: int = 5) -> DataFrame:
    """turns of the prefixes that are compressed as a conversation grows: after each `every` turns, and at its end."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    steps = n.select("conv_id", F.explode(F.array_union(F.when(F.col("n") >= every, F.sequence(F.lit(every).cast("bigint"), F.col("n"), F.lit(every).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.array("n"))).alias("upto"))
    return turns.join(steps, "conv_id").filter(F.col("turn") < F.col("upto"))
