"""Queries with SQL beside DuckDB, on the smallest tables."""

import pytest
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["op1_top_k_inner_product", "op2_decontamination", "op3_chat_tree", "op7_source_mixture", "op8_near_duplicates",
     "op11_turn_repair", "op12_hard_negatives"],
)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    assert compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
