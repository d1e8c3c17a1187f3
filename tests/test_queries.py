"""Registered queries against their SQL (a spread over all operator groups; ``python tests/compare.py`` runs every one)."""

import pytest
from compare import compare, connection
from wireloom.plans import catalogue

SAMPLE = (
    "d1_dedup d3_space_saved d4_top_duplicates a2_prefix_freq a8_anonymised a8_user_map a11_injective w2_streams w6_selected_streams w7_flows "
    "w8_concat_offsets w9_trimmed_segments t1_merge_scans t2_records t2_records_small_blocks t3_record_frames t4_frame_messages t13_type_hits t15_rollup "
    "h1_headers h1_long_headers h2_start_lines h3_keep_ranges k2_fallback_rules k5_merged k9_masked_payload v7_overall v9_http_body_masked r5_overall r7_errors r14_describe "
    "r15_moving_avg p1_layers p9_tcp p12_payload s2_packets a9_checksums sanitise_packets"
).split()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, sf, name):
    rows, error = compare(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], sf)
    assert error is None
    assert rows > 0


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
