from pathlib import Path

import pytest

from clueforge.llm.queries import ORACLE, QUERIES

from .. import twins


@pytest.mark.skipif(not Path(twins.FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        twins.same(spark, QUERIES[name], ORACLE[name])
    else:
        rows = QUERIES[name](spark, twins.FOLDER).collect()
        assert not name.endswith("_found") or len(rows) == len(set(rows))
