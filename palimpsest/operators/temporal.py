"""Events to sequences and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.fixed import RELATED_EVENTS
from palimpsest.functions.similarity import event_jaccard
from palimpsest.functions.text import ident
from palimpsest.ir import Memory, conform


def linked(gap: int = 5, similarity: float = 0.5) -> Column:
    """Whether an event continues the one before it (columns p_*)."""
    pair = F.concat_ws(">", F.least("p_type", "event_type"), F.greatest("p_type", "event_type"))
    known = [">".join(sorted(p)) for p in RELATED_EVENTS]
    near = F.arrays_overlap("p_participants", "participants") | (
        (F.col("p_type") == F.col("event_type")) & (event_jaccard(F.col("p_description"), F.col("description")) >= similarity)) | pair.isin(*known)
    return F.coalesce((F.col("turn") - F.col("p_turn") <= gap) & near, F.lit(False))


def event_runs(events: DataFrame, gap: int = 5, similarity: float = 0.5) -> DataFrame:
    """events with run, a number of the chain of neighbours that each belongs to."""
    w = Window.partitionBy("conv_id").orderBy("turn", "ord")
    before = {f"p_{n}": F.lag(c).over(w) for n, c in (("turn", "turn"), ("type", "event_type"), ("participants", "participants"), ("description", "description"))}
    return events.withColumns(before).withColumn("run", F.sum(F.when(linked(gap, similarity), 0).otherwise(1)).over(w)).drop(*before)


def dominant(kinds: Column) -> Column:
    """The commonest of an array in order; of equals the first met."""
    n = F.transform(F.array_distinct(kinds), lambda k: F.struct(F.size(F.filter(kinds, lambda x: x == k)).alias("n"), (-F.array_position(kinds, k)).alias("at"), k.alias("k")))
    return F.array_max(n)["k"]


def summary(n: Column, kinds: Column, participants: Column, first: Column, last: Column) -> Column:
    """What a run of events says of itself, by its dominant type."""
    top = dominant(kinds)
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    who = F.array_join(F.slice(F.array_sort(participants), 1, 3), ", ")
    fmt = F.format_string
    return (F.when((top == "question") & (count("answer") > 0), fmt("Q&A exchange with %d questions answered", count("question")))
            .when(top == "question", fmt("Discussion with %d questions", count("question")))
            .when((top == "error") & (count("resolution") > 0), fmt("Encountered and resolved %d of %d issues", count("resolution"), count("error")))
            .when(top == "error", fmt("Encountered %d issues", count("error")))
            .when((top == "action") & (who != ""), fmt("Series of %d actions involving %s", n, who))
            .when(top == "action", fmt("Series of %d actions from turn %d to %d", n, first, last))
            .when(top == "state_change", fmt("%d state changes over turns %d-%d", n, first, last))
            .when(top == "completion", fmt("Completed %d tasks", n))
            .otherwise(fmt("Sequence of %d %s events (turns %d-%d)", n, F.replace(top, F.lit("_"), F.lit(" ")), first, last)))


def sequences(runs: DataFrame, least: int = 3) -> DataFrame:
    """One sequence for each run of at least that many events."""
    item = F.struct("turn", "ord", "evt_id", "event_type", "description", "participants", "importance")
    got = runs.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(item)).alias("e")).filter(F.size("e") >= least)
    kinds = F.transform("e", lambda x: x["event_type"])
    got = got.withColumns({"kinds": kinds, "n": F.size("e"), "who": F.array_distinct(F.flatten(F.transform("e", lambda x: x["participants"]))),
                           "a": F.element_at("e", 1)["turn"], "z": F.element_at("e", -1)["turn"]})
    top = dominant(F.col("kinds"))
    kind = F.when(top.isin("question", "answer"), "qa_exchange").otherwise(F.concat(top, F.lit("_sequence")))
    events = F.transform("e", lambda x: F.struct(x["evt_id"].alias("evt_id"), x["turn"].alias("turn"), x["event_type"].alias("event_type"), x["description"].alias("description"), x["participants"].alias("participants"), x["importance"].alias("importance")))
    return conform(got.select("conv_id", ident("seq_", F.col("conv_id"), F.col("run")).alias("seq_id"), F.col("run").cast("bigint").alias("ord"),
                              summary(F.col("n"), F.col("kinds"), F.col("who"), F.col("a"), F.col("z")).alias("summary"), kind.alias("sequence_type"), events.alias("events")), "sequences")


def sequence_facts(seq: DataFrame) -> DataFrame:
    """(conv_id, seq_id, n, start_turn, end_turn, duration, total_importance, participants) of sequences."""
    turns = F.transform("events", lambda e: e["turn"])
    return seq.select("conv_id", "seq_id", F.size("events").alias("n"), F.array_min(turns).alias("start_turn"), F.array_max(turns).alias("end_turn"),
                      (F.array_max(turns) - F.array_min(turns)).alias("duration"), F.aggregate("events", F.lit(0.0), lambda s, e: s + e["importance"]).alias("total_importance"),
                      F.array_sort(F.array_distinct(F.flatten(F.transform("events", lambda e: e["participants"])))).alias("participants"))


def mergeable(seq: DataFrame, gap: int = 3) -> DataFrame:
    """(conv_id, a, b): sequences whose end and start are near and that share a participant."""
    f = sequence_facts(seq)
    a, b = f.alias("a"), f.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.seq_id") != F.col("b.seq_id")) & (F.abs(F.col("a.end_turn") - F.col("b.start_turn")) <= gap)
                  & F.arrays_overlap("a.participants", "b.participants")).select(F.col("a.conv_id").alias("conv_id"), F.col("a.seq_id").alias("a"), F.col("b.seq_id").alias("b"))


def compress(memory: Memory, least: int = 3, gap: int = 5, similarity: float = 0.5) -> Memory:
    """Runs of events become sequences with a summary; their events go."""
    runs = event_runs(memory.events, gap, similarity)
    seq = sequences(runs, least)
    gone = seq.select("conv_id", F.explode("events.evt_id").alias("evt_id"))
    return memory.with_(events=memory.events.join(gone, ["conv_id", "evt_id"], "left_anti"), sequences=memory.sequences.unionByName(seq))


def phases(turns: DataFrame, least: int = 5) -> DataFrame:
    """(conv_id, phase, start_turn, end_turn, num_turns): fixed blocks of turns, at least that long."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("num_turns")).filter("num_turns > 0")
    size = F.greatest(F.lit(least), F.floor(F.col("num_turns") / 5).cast("int"))
    blocks = n.withColumn("size", size).select("conv_id", "num_turns", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("num_turns") - 1) / F.col("size")).cast("int"))).alias("phase"))
    return blocks.select("conv_id", "phase", (F.col("phase") * F.col("size")).alias("start_turn"), (F.least((F.col("phase") + 1) * F.col("size"), F.col("num_turns")) - 1).alias("end_turn"), "num_turns")


def phase_scores(memory: Memory, least: int = 5) -> DataFrame:
    """Phases with score, n_events, n_facts; a fact counts once in each phase that it touches."""
    p = phases(memory.turns, least)
    size = F.greatest(F.lit(least), F.floor(F.col("num_turns") / 5).cast("int"))
    n = p.select("conv_id", "num_turns").distinct().withColumn("size", size)
    ev = memory.events.join(n, "conv_id").groupBy("conv_id", F.floor(F.col("turn") / F.col("size")).cast("int").alias("phase")).agg(F.sum("importance").alias("imp"), F.count(F.lit(1)).alias("n_events"))
    fa = memory.facts.select("conv_id", "fact_id", F.explode("source_turns").alias("turn")).join(n, "conv_id").groupBy("conv_id", F.floor(F.col("turn") / F.col("size")).cast("int").alias("phase")).agg(F.countDistinct("fact_id").alias("n_facts"))
    total = p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_phases"))
    out = p.join(total, "conv_id").join(ev, ["conv_id", "phase"], "left").join(fa, ["conv_id", "phase"], "left").fillna(0, ["imp", "n_events", "n_facts"])
    turns = F.greatest(F.lit(1), F.col("end_turn") - F.col("start_turn") + 1)
    return out.select("conv_id", "phase", "start_turn", "end_turn", "num_turns", "n_events", "n_facts",
                      (F.col("imp") * 0.4 + (F.col("phase") + 1) / F.col("n_phases") * 0.4 + F.col("n_facts") / turns * 0.2).alias("score"))


def compress_phases(memory: Memory, least: int = 5, cut: float = 0.3, turns: int = 10) -> Memory:
    """The least phases' events become one each, until that share of events is gone; short conversations stay.

    Scores that differ in a sum's last bits are equal, and the first phase goes first.
    """
    s = phase_scores(memory, least).filter(F.col("num_turns") >= turns)
    all_events = F.sum("n_events").over(Window.partitionBy("conv_id"))
    w = Window.partitionBy("conv_id").orderBy(F.round("score", 12), "phase")
    saved = F.when(F.col("n_events") >= 2, F.col("n_events") - 1).otherwise(0)
    before = F.coalesce(F.sum(saved).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = s.withColumns({"all": all_events, "before": before}).filter((F.col("all") - F.col("before") > F.floor(F.col("all") * (1 - cut))) & (F.col("n_events") >= 2))
    phase_of = memory.events.join(picked, "conv_id").filter(F.col("turn").between(F.col("start_turn"), F.col("end_turn")))
    one = phase_of.groupBy("conv_id", "phase", "start_turn", "end_turn").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("importance"), F.min("ord").alias("ord"), F.array_distinct(F.flatten(F.collect_list("participants"))).alias("participants"))
    new = conform(one.select("conv_id", ident("evt_", F.col("conv_id"), F.lit("phase"), F.col("phase")).alias("evt_id"), "ord", F.format_string("Phase summary (turns %d-%d): %d events", "start_turn", "end_turn", "n").alias("description"),
                             F.lit("other").alias("event_type"), F.col("start_turn").alias("turn"), "participants", F.array().cast("array<string>").alias("related_facts"), "importance"), "events")
    return memory.with_(events=memory.events.join(phase_of.select("conv_id", "evt_id"), ["conv_id", "evt_id"], "left_anti").unionByName(new))
