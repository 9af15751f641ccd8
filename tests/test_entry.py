import re
from pathlib import Path

import pytest

import __spark_entry__
from quillmill import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")


def test_names_match():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_alone():
    for path in (ROOT / "quillmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"quillmill\.llm|from \.+llm|corpus_pipeline", path.read_text()), path


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "block_id", "chunk_id", "char_start", "char_end", "text"] and df.count() > 200


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = catalog.queries()[name](spark, str(SF))
    expected = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert {k: v for k, v in got.dtypes} == {c: {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double"}[str(t)] for c, t in zip(expected.columns, expected.dtypes)}
    order = ", ".join(f'"{c}"' for c in columns)
    wanted = con.sql(f"SELECT {order} FROM expected").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(wanted, key=repr)
