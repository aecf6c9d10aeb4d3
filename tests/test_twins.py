import importlib
from pathlib import Path

import pytest

from . import twins

MODULES = [importlib.import_module(f"clueforge.plans.{m}") for m in ("quotes", "links", "cooccurrence", "documents", "ingest", "model", "notices", "general")]
PAIRS = {name: (module.QUERIES[name], sql) for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
ROWS_ONLY = {name: query for module in MODULES for name, query in module.QUERIES.items() if name not in PAIRS}


@pytest.mark.skipif(not Path(twins.FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query_equals_its_sql(spark, name):
    twins.same(spark, *PAIRS[name])


@pytest.mark.skipif(not Path(twins.FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_runs(spark, name):
    assert ROWS_ONLY[name](spark, twins.FOLDER).collect() is not None
