"""Every query of the reference's operators runs on the smallest tables and equals its SQL where it has one."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A cross-section; the driver compares all of them.
SOME = ["action_entropy_report", "validate_record", "canonical_groups", "horizon_transitions", "asof_state", "rolling_consensus", "compare_states", "benchmark_analyses", "cluster_bootstrap", "holm_adjust", "fold_result_line", "text_records", "stream_dedupe", "normalize_stream", "match_response", "factors", "hidden_leak_check", "fingerprint", "lineage_remap", "selection_rows", "annotation_map", "custom_udaf", "split_by_hash", "stateful_scorer", "read_jsonl"]


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in relation.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
