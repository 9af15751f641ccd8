"""Every query of the subpackage, as registered: columns, types, whole tables, and its SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from quillmill.llm import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")

CONTRACTS = {
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_fertility": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_segmentation": "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, best_score double",
    "op9_edit_counts": "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, n_pretokens bigint, reencoded_pretokens bigint",
    "op10_sharding": "doc_id bigint, text_hash bigint, shard bigint, version bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, str(SF))
    wanted = [tuple(c.split()) for c in CONTRACTS[name].split(", ")]
    assert got.dtypes[: len(wanted)] == wanted
    ids = sorted(r.doc_id for r in got.collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(str(SF / "documents.parquet")).select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, str(SF))
    expected = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    wanted = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM expected").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(wanted, key=repr)
