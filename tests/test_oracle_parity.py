"""Oracle parity inside the test suite on the smallest tables:
a representative subset of the registered queries against their DuckDB SQL."""

import duckdb
import pytest

from forumlens.sources.tables import TABLES
from tests.conftest import SF_SMALL

NAMES = ["token_stats", "vocabulary", "doc_bow", "phrase_scores", "phrase_tokens", "step_summary",
         "upsert_latest", "dist_summary", "link_report", "tag_scores", "time_bins", "user_degrees",
         "doc_degrees", "edge_cosine", "run_lineage", "html_link_separation", "format_tokens", "format_step_records",
         "step_store", "step_guards", "artefact_values", "qa_counts", "landed_search",
         "training_results", "post_slices", "conformed_posts", "flattened_words", "table_rows", "landed_posts",
         "exported_steps", "saved_vocabulary", "asker_of_posts", "lemma_tokens", "post_link_union",
         "phrase_tokens_3gram", "phrase_vocabulary"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from tools.check_oracle import rows_key
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert rows_key(srows, cols) == rows_key(orows, ocols)
