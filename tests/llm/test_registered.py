"""The registered queries of the numbered operators on the smallest tables, against their SQL where they have it."""

import duckdb
import pytest

from spendgrid.llm import queries

from test_queries import _rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_embedding_forest": "vec_id n_links component_id kept", "op2_repeated_windows": "doc_id n_bytes n_removed n_spans kept_sha256", "op3_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_toxicity_scores": "doc_id held_out score predicted", "op5_language_id": "doc_id held_out lang_pred score", "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_telephony_audio": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op8_source_mixing": "doc_id size source_size target taken",
    "op9_ngram_jaccard": "doc_id n_shingles component_id", "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_quality_votes": "doc_id held_out score predicted", "op12_block_max_search": "item_id rank doc_id score",
    "op13_spelling_variants": "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = got.toPandas()
    if name in queries.ORACLE_SQL:
        want = con.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
    else:
        key, table = ("doc_id", "documents")
        assert set(got[key]) == {x for (x,) in con.sql(f"select {key} from {table}").fetchall()}
