"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
# one or two of each module; all others are compared by the same SQL outside the test run
NAMES = (
    "A2_linearize", "A4_table_similarity", "F7_structure_only", "A7_bleu", "A8_rouge_n_turns", "A9_rouge_l", "J3_gold_by_table",
    "J9_fill_cells", "J10_match_boxes", "A14_detection_scores", "A16_entity_scores", "K2_score_map", "S6_coco", "S11_polygon_xml", "S12_rectangle_xml", "K6_coco_by_split",
    "U_3_mix_by_ratio", "E2_summary_chain", "O5_suppress_overlaps", "A1_file_lists", "F12_first_words",
    "A3_header_paths", "A4_nested_tables", "J12_changed_cells", "A2_linearize_spans", "J4_grid_headers", "T1_incremental_scores", "T1_names_sent_twice", "A4_distance_by_blocks", "U_3_mix_batches",
)


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        v = v.item() if hasattr(v, "item") else v
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 125


def test_entry(spark):
    assert entry.entry(spark).columns == ["file", "input"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    got = rows(entry.queries()[name](spark, DATA).toPandas())
    assert got == rows(database.execute(entry.oracle_sql()[name]).df())
