"""Ledger stamps next to their boundaries, against the check SQL."""

import os

import duckdb
import pytest

from gradeloom import catalog
from tests.oracle import compare, duck

catalog.load()
SF = "/root/testdata/sf0.001"
NAMES = ["ledger_merge", "ledger_diff", "ledger_pair_merge", "ledger_stamp", "snapshot_ledger", "state_upsert", "stream_ledger", "bank_reset",
         "bank_reset_read", "first_result_canonical", "first_result_fold"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events within a second of six-hour boundaries, some at the exact half second, some before 1970."""
    path = str(tmp_path_factory.mktemp("stamps"))
    for file in os.listdir(SF):
        if file != "events.parquet":
            os.symlink(f"{SF}/{file}", f"{path}/{file}")
    duckdb.sql(f"""COPY (SELECT i AS event_id, (CASE WHEN i % 11 = 0 THEN TIMESTAMP '1969-12-30' ELSE TIMESTAMP '2024-01-01' END + to_hours((i // 50 * 6)::INTEGER)
      - to_microseconds((i * 250000) % 1250000) + to_microseconds(i % 2)) AS ts, i % 7 AS user_id, ['purchase', 'click', 'error', 'signup', 'view'][(i * 7) % 5 + 1] AS event_type,
      (i % 42)::DOUBLE + 0.5 AS value, '{{"k": ' || i % 4 || '}}' AS props FROM range(400) r(i)) TO '{path}/events.parquet' (FORMAT parquet)""")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_stamps_at_half_seconds(spark, folder, name):
    ok, note = compare(catalog.QUERIES[name], catalog.CHECKS[name], spark, folder, duck(folder))
    assert ok, note
