import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
FAST = ["dedup_survivors", "dedup_report", "mpn_collisions", "unit_normalise", "unmapped_units", "decimal_fraction", "lov_validate", "field_accuracy", "review_latest", "source_policy", "url_safety", "terse_attributes", "grounding", "short_runs", "newest_products", "extract_fields", "trust_gate", "joined_pages", "snippet_pages", "page_numbers", "batch_outcomes", "batch_totals", "product_listing", "approved_list", "unit_table", "repaired_text", "search_queries", "usable_features", "compliance_summary"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "pages", "documents", "orders", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, SMALL).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, float) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
    assert text(ours) == text(theirs)
