"""A cross-section of the registered queries against DuckDB; tools/check.py does them all."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from routescope.plans import catalog
from tools.check import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
SAMPLE = (
    "A1_read_update_dump", "A20_build_documents", "B19_leak_fold", "C2_longest_prefix_match", "C4_fake_links", "C9_snapshot_as_of",
    "C11_time_alignment", "D2_feature_series", "D2_feature_series_global_state", "D12_connection_frequency_verdict", "D16_common_endings",
    "E8_gap_sessions", "E10_ewma_band", "F1_origin_hijack", "F4_interception_patterns", "F5_leaks", "F11_event_feature_job",
    "F15_combined_without_forest", "F17_role_aware", "F29_link_contexts", "J2_tumbling_counts",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_every_query_has_sql_or_a_reason():
    """The routing queries; those of the text operators are tested beside them, where these are present."""
    without = set(catalog.QUERIES) - set(catalog.oracles())
    assert without == {"F14_isolation_forest", "F15_combined_detector", "F20_traffic_job"}  # trees grown by a seeded sample
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.oracles()) <= set(entry.oracle_sql())


def test_entry_without_the_text_operators():
    """Whatever module of theirs is missing, the routing queries are there."""
    hidden = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(e.llm, len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", hidden], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert said == ["None", str(len(catalog.QUERIES)), str(len(catalog.oracles()))]
