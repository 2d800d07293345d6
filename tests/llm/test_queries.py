"""Registered queries on the smallest tables, against their SQL where there is one."""

import pytest

from voxloom.llm.queries import QUERIES
from voxloom.llm.sql import ORACLES

from ..compare import FOLDER, connection, rows_of_spark, rows_of_sql

FOUND = {
    "p1_found": ["sample_index"],
    "p2_found": ["copy_id", "keep_id", "table_name"],
    "p3_found": ["sample_index"],
    "p4_found": ["client_a", "client_b"],
    "p5_found": ["id_a", "id_b"],
    "p6_found": ["id_a", "id_b"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "lang", "seg_no"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, FOLDER))
    assert columns == FOUND.get(name, columns)
    assert len(set(rows)) == len(rows) or name not in FOUND
    if name in ORACLES:
        assert (columns, rows) == rows_of_sql(connection(), ORACLES[name])
    else:
        assert rows
