"""Passes, hooks and resolvers that users bring."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.ir import Memory

STAGES = ("pre_extraction", "post_extraction", "pre_optimization", "post_optimization", "pre_generation", "post_generation", "on_error", "on_complete")
KINDS = ("pass", "extractor", "generator", "storage", "hook")


@dataclass
class Plugin:
    """A function with a name, a kind, and the settings that it needs."""

    name: str
    run: Callable
    kind: str = "pass"
    required: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if missing := set(self.required) - set(self.settings):
            raise ValueError(f"{self.name} needs {', '.join(sorted(missing))}")

    def __call__(self, memory: Memory) -> Memory:
        return self.run(memory, **self.settings)


class Registry:
    """Plugins by name; a new one replaces one of its name."""

    def __init__(self):
        self._all: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> Plugin:
        self._all[plugin.name] = plugin
        return plugin

    def unregister(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def get(self, name: str) -> Plugin | None:
        return self._all.get(name)

    def of(self, kind: str) -> list[Plugin]:
        return [p for p in self._all.values() if p.kind == kind]

    def names(self) -> list[str]:
        return list(self._all)


def as_pass(name: str, **settings) -> Callable[[Callable], Plugin]:
    """A decorator: a function of a memory becomes a plugin."""
    return lambda f: Plugin(name, f, settings=settings)


def load(where: str) -> list[Plugin]:
    """The plugins that a module, a file or a folder of files defines."""
    path = Path(where)
    files = sorted(path.glob("*.py")) if path.is_dir() else [path] if path.suffix == ".py" else []
    modules = []
    for f in files:
        spec = importlib.util.spec_from_file_location(f.stem, f)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        modules.append(module)
    modules = modules or [importlib.import_module(where)]
    return [x for m in modules for x in vars(m).values() if isinstance(x, Plugin)]


def template(name: str) -> str:
    """Source of an empty plugin."""
    return f'from palimpsest.plugins import as_pass\n\n\n@as_pass("{name}")\ndef {name.replace("-", "_")}(memory):\n    return memory\n'


class Pipeline:
    """Passes in order; each can be taken out by name."""

    def __init__(self, plugins: Iterable[Plugin] = ()):
        self.plugins = list(plugins)

    def add(self, plugin: Plugin) -> Pipeline:
        self.plugins.append(plugin)
        return self

    def remove(self, name: str) -> Pipeline:
        self.plugins = [p for p in self.plugins if p.name != name]
        return self

    def __call__(self, memory: Memory) -> Memory:
        for p in self.plugins:
            memory = p(memory)
        return memory


class Hooks:
    """Callbacks by stage, higher priority first, those of one priority in order; what fails is collected."""

    def __init__(self):
        self._all: dict[str, list[list]] = {s: [] for s in STAGES}
        self.errors: list[tuple[str, str, Exception]] = []

    def register(self, stage: str, name: str, run: Callable, priority: int = 0) -> None:
        self._all[stage].append([priority, name, run, True])
        self._all[stage].sort(key=lambda h: -h[0])

    def enable(self, name: str, on: bool = True) -> None:
        for hooks in self._all.values():
            for h in hooks:
                if h[1] == name:
                    h[3] = on

    def execute(self, stage: str, value):
        """value through the stage's hooks; a hook that returns None leaves it."""
        for _, name, run, on in self._all[stage]:
            if on:
                try:
                    out = run(value)
                    value = value if out is None else out
                except Exception as e:
                    self.errors.append((stage, name, e))
        return value


@as_pass("filter_low_confidence", threshold=0.5)
def filter_low_confidence(memory: Memory, threshold: float) -> Memory:
    return ir.remove_facts(memory, memory.facts.filter(F.col("confidence") < threshold).select("conv_id", "fact_id"))


@as_pass("boost_recent", factor=1.2, window=5)
def boost_recent(memory: Memory, factor: float, window: int) -> Memory:
    """Importances of what the last turns mention times factor, at most 1; facts gain by how recent they are."""
    n = ir.turn_counts(memory.turns)
    ents = memory.entities.join(n, "conv_id", "left")
    near = F.coalesce(F.col("num_turns") - ir.last_turn(F.col("mentions")) <= window, F.lit(False))
    ents = ents.withColumn("importance", F.when(near, F.least(F.lit(1.0), F.col("importance") * factor)).otherwise(F.col("importance")))
    facts = memory.facts.join(n, "conv_id", "left")
    share = F.coalesce(F.array_max("source_turns") / F.greatest(F.col("num_turns"), F.lit(1)), F.lit(0.0))
    facts = facts.withColumn("importance", F.least(F.lit(1.0), F.col("importance") * (share * (factor - 1) + 1)))
    return memory.with_(entities=ir.conform(ents, "entities"), facts=ir.conform(facts, "facts"))


@as_pass("entity_centric", k=10)
def entity_centric(memory: Memory, k: int) -> Memory:
    """Facts stay that name one of the k most important entities, or an alias of it."""
    from palimpsest.operators.selection import top_k

    top = top_k(memory.entities, k, [F.desc("importance"), F.col("ord")], "conv_id")
    names = top.select("conv_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).select("conv_id", F.lower("n").alias("n")).distinct()
    ends = memory.facts.select("conv_id", "fact_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("n")).join(names, ["conv_id", "n"], "left_semi").select("conv_id", "fact_id")
    return ir.remove_facts(memory, memory.facts.select("conv_id", "fact_id").join(ends, ["conv_id", "fact_id"], "left_anti"))
