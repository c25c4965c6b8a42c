import pytest
from oracle import connect, rows

from quarrylens.llm import queries

COLUMNS = {
    "p1_found": ["tbl", "row_id"], "p2_found": ["vuln_id_a", "vuln_id_b"], "p3_found": ["tbl", "row_id", "secret"], "p4_found": ["tbl", "repo", "file_path"],
    "p5_found": ["tbl", "row_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns == COLUMNS.get(name, got.columns)
    frame = got.toPandas()
    if name in COLUMNS:
        assert not frame.duplicated().any()
    if name in queries.ORACLE:
        assert rows(frame) == rows(connect(sf_dir).sql(queries.ORACLE[name]).df())
