"""Names, order and types of the columns that the queries promise, over the smallest driver tables."""

import os

import pytest

from quillspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op4_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_vector_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_hilbert_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns(spark, name):
    promised = CONTRACTS[name].split(", ")
    assert [f"{n} {t}" for n, t in QUERIES[name](spark, SF).dtypes][: len(promised)] == promised
