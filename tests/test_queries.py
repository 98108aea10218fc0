"""Queries against their SQL on a small scale factor, and what the entry point gives."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("current_facts", "src_chat_window", "ext_entities", "ext_facts_of_talk", "flt_dead_facts", "join_contradictions", "agg_superseded", "win_event_runs", "agg_sequences", "win_greedy",
         "ctx_pack_balanced", "gen_bullets", "set_diff", "set_union_facts", "ret_bm25", "ret_nearest", "fn_detect_language", "str_recent_context", "agg_histogram", "fn_inverse_relation",
         "agg_pagerank", "fn_rouge", "gen_narrative", "agg_topics", "pass_query_pruning", "gen_adaptive", "win_knapsack", "win_near_duplicates", "str_priority_buffer", "set_smart_merge", "fn_summaries", "win_events_in_order", "fn_hashes", "join_uncached", "str_unseen")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from palimpsest import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    said = [d[0] for d in cur.description]
    assert sorted(said) == cols
    want = sorted((tuple(plain(r[said.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr) == want and want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["scope", "conv_id", "subject", "predicate", "object", "turn"]
