"""Queries against their oracle SQL in DuckDB at the smallest scale; MARLSTONE_ALL=1 runs all of them."""

import datetime
import os

import duckdb
import pytest

from marlstone import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "flagship_retrieval", "bm25_topk", "tier_tag_prefix", "tier_path_key", "dense_topk", "ann_gate", "fusion_rrf_gated", "rerank_fused_tier", "shard_merge", "successor_representation",
    "entity_auto_links", "edge_evidence", "supersedes_chain", "path_key_compaction", "packet_status", "live_truth", "query_classes", "tier_edge_boost", "tenant_visibility", "stream_last_seen", "presence_changes", "stream_presence_changes", "bucket_gap", "feature_correlations", "sliding_access_rate", "evidence_packet", "know_miss", "spectrum_resonance",
    "eval_auc", "document_upsert", "snapshot_merge_newest", "symbol_graph", "claim_edges", "stream_requeries", "stream_tumbling_sessions", "path_functions", "attribution_join", "head_rerank", "sentence_groups", "phrase_hits", "ann_topk", "ann_led", "seed_across_shards", "query_surface", "flux_rank", "flux_rank_circular", "interference_trim", "tier_histories", "query_confidence", "calibration_age",
]
NAMES = sorted(registry.ORACLE) if os.environ.get("MARLSTONE_ALL") else SOME


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = con.execute(registry.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
