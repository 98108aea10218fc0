"""Memory to text: lines are numbered columns, and one ordered aggregate a conversation joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.functions.text import sentence, tokens_quarter
from palimpsest.ir import Memory
from palimpsest.operators import temporal
from palimpsest.operators.selection import top_k

SHOWN_TYPES = ("person", "organization", "project", "concept", "location", "product", "other")


def spoken(subject: Column, predicate: Column, obj: Column, negated: Column, kind: Column) -> Column:
    """A fact as a sentence."""
    plain = F.concat(subject, F.lit(" "), predicate, F.lit(" "), obj, F.lit("."))
    of = F.concat(subject, F.lit(" has "), predicate, F.lit(" of "), obj, F.lit("."))
    no = F.concat(subject, F.lit(" does not "), predicate, F.lit(" "), obj, F.lit("."))
    return F.when(negated, no).when((kind == "attribute") & ~F.lower(predicate).isin("is", "are", "was", "were"), of).otherwise(plain)


def listed(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    return (F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.array_join(items, " and "))
            .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1))))


def joined(lines: DataFrame, separator: str = "\n", name: str = "text") -> DataFrame:
    """(conv_id, text) of lines (conv_id, at, line), in the order of at."""
    got = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return got.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), separator).alias(name))


def _line(df: DataFrame, section: int, text: Column, *order: Column) -> DataFrame:
    at = F.struct(F.lit(section).alias("s"), *[(order[k] if k < len(order) else F.lit(0)).cast("double").alias(f"o{k}") for k in range(3)])
    return df.select("conv_id", at.alias("at"), text.alias("line"))


def _top(df: DataFrame, k: int, *groups: str) -> DataFrame:
    return top_k(df, k, [F.desc("importance"), F.col("ord")], "conv_id", *groups)


def described(memory: Memory) -> DataFrame:
    """(conv_id, ent_id, said): type, three attributes and the top fact of each entity."""
    ends = memory.facts.select("conv_id", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("lname"),
                               F.struct("importance", (-F.col("ord")).alias("o")).alias("rank"), F.concat_ws(" ", "predicate", "object").alias("top"))
    top = ends.groupBy("conv_id", "lname").agg(F.max_by("top", "rank").alias("top"))
    attrs = F.array_join(F.transform(F.slice(F.map_entries("attributes"), 1, 3), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    parts = F.concat_ws("; ", F.when(F.col("type") != "other", F.col("type")), F.when(F.size("attributes") > 0, attrs), "top")
    return memory.entities.withColumn("lname", F.lower("name")).join(top, ["conv_id", "lname"], "left").select("conv_id", "ent_id", F.when(parts == "", "mentioned in conversation").otherwise(parts).alias("said"))


def structured(memory: Memory) -> DataFrame:
    """(conv_id, text): sections of entities by type, facts by subject, and the timeline."""
    rank = F.array_position(F.array(*map(F.lit, SHOWN_TYPES)), F.col("type"))
    shown = _top(memory.entities, 10, "type").filter(F.col("type").isin(*SHOWN_TYPES)).join(described(memory), ["conv_id", "ent_id"])
    convs = lambda df: df.select("conv_id").distinct()
    ents = [_line(convs(memory.entities), 0, F.lit("## Key Entities")),
            _line(shown.select("conv_id", "type").distinct(), 1, F.concat(F.lit("\n### "), F.initcap("type"), F.lit("s")), rank),
            _line(shown, 1, F.concat(F.lit("- **"), "name", F.lit("**: "), "said"), rank, F.col("rank"))]
    by = memory.facts.groupBy("conv_id", "subject").agg(F.sum("importance").alias("importance"), F.min(F.struct((-F.col("importance")).alias("i"), "ord")).alias("ord"))
    subjects = _top(by, 15).select("conv_id", "subject", F.col("rank").alias("srank"))
    facts = _top(memory.facts, 5, "subject").join(subjects, ["conv_id", "subject"])
    facts_ = [_line(convs(memory.facts), 0, F.lit("## Key Information")), _line(subjects, 1, F.concat(F.lit("\n**"), "subject", F.lit(":**")), F.col("srank")),
              _line(facts, 1, F.concat(F.lit("- "), "predicate", F.lit(" "), "object"), F.col("srank"), F.col("rank"))]
    spans = temporal.sequence_facts(memory.sequences).select("conv_id", "seq_id", "start_turn", "end_turn")
    seq = memory.sequences.join(spans, ["conv_id", "seq_id"])
    evts = top_k(memory.events, 15, [F.col("turn"), F.col("ord")], "conv_id")
    time = [_line(convs(memory.events.select("conv_id").unionByName(memory.sequences.select("conv_id"))), 0, F.lit("## Timeline")),
            _line(convs(memory.sequences), 1, F.lit("\n### Event Sequences")), _line(seq, 2, F.format_string("- Turns %d-%d: %s", "start_turn", "end_turn", "summary"), F.col("ord")),
            _line(convs(memory.events), 3, F.lit("\n### Key Events")), _line(evts, 4, F.format_string("- [Turn %d] %s", "turn", "description"), F.col("rank"))]
    return sections(*[joined(reduce(DataFrame.unionByName, x)) for x in (ents, facts_, time)])


def sections(*parts: DataFrame) -> DataFrame:
    """Texts of the parts that a conversation has, a blank line between."""
    every = reduce(DataFrame.unionByName, (p.select("conv_id", F.lit(k).alias("at"), F.col("text").alias("line")) for k, p in enumerate(parts)))
    return joined(every.filter("line != ''"), "\n\n")


def narrative(memory: Memory) -> DataFrame:
    """(conv_id, text): a paragraph each for names, sure facts, other facts, sequences, events."""
    say = spoken(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated"), F.col("fact_type"))
    gather = lambda df, c: df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))), lambda r: r["x"]).alias("xs"))
    para = lambda df, before, sep, after="": df.select("conv_id", F.concat(F.lit(before), F.array_join("xs", sep), F.lit(after)).alias("text"))
    every = F.row_number().over(_by_importance())
    names = gather(_top(memory.entities, 5), F.col("name")).select("conv_id", F.concat(F.lit("This conversation involves "), listed(F.col("xs")), F.lit(".")).alias("text"))
    high = gather(memory.facts.filter("importance >= 0.7").withColumn("rank", every), say)
    middle = gather(_top(memory.facts.filter("importance >= 0.4 and importance < 0.7"), 10), say)
    seq = gather(memory.sequences.withColumn("rank", F.col("ord")), F.col("summary"))
    evts = gather(_top(memory.events, 5), F.col("description"))
    return sections(names, para(high, "", " "), para(middle, "Additionally, ", " "), para(seq, "Key events: ", "; ", "."), para(evts, "Notable occurrences: ", "; ", "."))


def _by_importance():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy(F.desc("importance"), "ord")


def bullets(memory: Memory) -> DataFrame:
    """(conv_id, text): names, facts, sequences and events as bullets."""
    dot = lambda c: F.concat(F.lit("• "), c)
    names = _top(memory.entities, 5).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]), ", ").alias("n"))
    said = sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated"))
    parts = [_line(names, 0, dot(F.concat(F.lit("Participants: "), "n"))), _line(_top(memory.facts, 15), 1, dot(said), F.col("rank")),
             _line(memory.sequences, 2, dot(F.col("summary")), F.col("ord")), _line(_top(memory.events, 5), 3, dot(F.col("description")), F.col("rank"))]
    return joined(reduce(DataFrame.unionByName, parts))


def as_json(memory: Memory) -> DataFrame:
    """(conv_id, text): entities, facts and events as one JSON object, importances to three places."""
    imp = F.bround("importance", 3).alias("importance")
    pack = lambda df, name, *cols: df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("x")))), lambda r: r["x"]).alias(name))
    e = pack(memory.entities, "entities", F.col("name"), F.col("type"), imp)
    f = pack(memory.facts, "facts", F.col("subject"), F.col("predicate"), F.col("object"), F.col("confidence"), imp)
    v = pack(memory.events, "events", F.col("description"), F.col("event_type").alias("type"), F.col("turn"), imp)
    out = e.join(f, "conv_id", "full_outer").join(v, "conv_id", "full_outer")
    return out.select("conv_id", F.to_json(F.struct("entities", "facts", "events")).alias("text"))


def limited(memory: Memory, ratio: DataFrame) -> DataFrame:
    """(conv_id, text) with fewer lines the smaller ratio, of (conv_id, ratio), is."""
    said = sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated"))

    def part(df: DataFrame, head: str, least: int, scale: int, line: Column) -> DataFrame:
        own = df.join(ratio, "conv_id").withColumn("rank", F.row_number().over(_by_importance())).filter(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("ratio") * scale)))
        return joined(_line(own.select("conv_id").distinct(), 0, F.lit(head)).unionByName(_line(own, 1, line, F.col("rank"))))

    return sections(part(memory.entities, "## Key Entities", 3, 10, F.concat(F.lit("- **"), "name", F.lit("**"))),
                    part(memory.facts, "## Key Information", 5, 20, F.concat(F.lit("- "), said)), part(memory.events, "## Timeline", 3, 10, F.concat(F.lit("- "), F.col("description"))))


FORMATS = {"structured": structured, "narrative": narrative, "bullets": bullets, "json": as_json}


def adaptive(memory: Memory, form: str = "structured", budget: int = 2048, tolerance: float = 0.1, rounds: int = 5) -> DataFrame:
    """(conv_id, text, tokens): texts over the budget are made anew with fewer lines, until they fit or the rounds end."""
    from palimpsest.operators.folding import materialised

    sized = lambda df: df.withColumn("tokens", tokens_quarter(F.col("text")))
    first = materialised(sized(FORMATS[form](memory)))
    done, rest = [first.filter(F.col("tokens") <= budget)], first.filter(F.col("tokens") > budget)
    for k in range(rounds):
        if rest.isEmpty():
            break
        ratio = rest.select("conv_id", (F.lit(float(budget)) / F.col("tokens")).alias("ratio"))
        got = materialised(sized(limited(memory, ratio)))
        last = k == rounds - 1
        done.append(got if last else got.filter(F.col("tokens") <= budget * (1 + tolerance)))
        rest = got.filter(F.col("tokens") > budget * (1 + tolerance))
    return reduce(DataFrame.unionByName, done)


def summary_table(memory: Memory) -> DataFrame:
    """(conv_id, entities, facts, relations, events, sequences): what there is."""
    out = ir.turn_counts(memory.turns).select("conv_id")
    for k, df in memory.parts().items():
        if k != "turns":
            out = out.join(df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(k)), "conv_id", "left")
    return out.fillna(0)
