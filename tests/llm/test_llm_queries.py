import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, oracle  # noqa: E402
from gleanery.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    same, mine, theirs, _ = compare(spark, SF, name, queries.queries()[name],
                                    queries.oracle_sql()[name], oracle(SF))
    assert same and mine == theirs and mine


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.queries()
