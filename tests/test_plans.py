"""Plans that must hold at scale: pruned scans, pushed filters, no Python where none is needed."""

from __future__ import annotations

import re

import pytest

import mnemolake.plans.insight_queries  # noqa: F401
import mnemolake.plans.more_queries  # noqa: F401
import mnemolake.plans.panel_queries  # noqa: F401
import mnemolake.plans.range_queries  # noqa: F401
import mnemolake.plans.record_queries  # noqa: F401
import mnemolake.plans.rule_queries  # noqa: F401
import mnemolake.plans.search_queries  # noqa: F401
import mnemolake.plans.similarity_queries  # noqa: F401
import mnemolake.plans.source_queries  # noqa: F401
from mnemolake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Rules, graphs, streams and schedules in Python; SQLite through its data source; many searches at once.
PYTHON = {"error_signatures", "vector_round_trip", "graph_active_path", "config_redaction", "stream_failure_bursts", "next_fires", "sqlite_store", "state_store", "batch_routes", "batch_pools", "batch_search"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_stays_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan(QUERIES[name](spark, DATA)))


@pytest.mark.parametrize(("name", "columns"), [("source_distribution", "source:string"), ("daily_counts", "ts:timestamp_ntz"), ("count_by_layer", "doc_id:bigint")])
def test_reads_only_what_it_needs(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(QUERIES[name](spark, DATA))


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_returnflag,R\)", plan(QUERIES["source_seen_counts"](spark, DATA)))


@pytest.mark.parametrize("name", ["log_retention", "change_feed", "list_page", "merged_log", "vector_topk"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, DATA))
