"""Plans: no joins without keys, columns and filters pushed to the scan."""

import re

import pytest

from partita.plans import registry

LIGHT = ["corpus_report", "drop_reasons", "exact_dedup_keep_first", "hash_split", "quality_left_join", "snapshot_diff", "file_stats", "clean_verdict", "detect_key", "polyphony", "excerpt_features", "header_tokens", "tempo_asof", "tick_to_seconds",
         "notes_in_window", "gap_split", "tumbling_5s_degenerate", "held_under_24", "normalize_drums", "majority_vote", "judge_metrics", "wilson_grouping_sets", "spearman_avg_rank", "group_advantage", "per_metric_agreement", "doc_layouts", "training_windows", "window_sliding"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_join_without_keys(spark, sf, name):
    p = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def columns(p, table):
    return {frozenset(c.split(":")[0] for c in re.findall(r"\w+:[^,>]+", s)) for t, s in re.findall(r"/(\w+)\.parquet\].*?ReadSchema: struct<(.*?)>(?:\n|$)", p) if t == table}


def test_scans_read_what_is_used(spark, sf):
    for name, table, want in (("group_advantage", "orders", {"o_orderkey", "o_custkey", "o_totalprice"}), ("exact_dedup_keep_first", "manifest", {"path", "content_hash"}), ("window_tumbling", "events", {"ts", "event_type", "value"})):
        got = columns(plan(registry.QUERIES[name](spark, sf)), table)
        assert got and all(c <= want for c in got), (name, got)
    p = plan(registry.QUERIES["exact_dedup_keep_first"](spark, sf))
    assert "IsNotNull(content_hash)" in p.split("PushedFilters")[1]
