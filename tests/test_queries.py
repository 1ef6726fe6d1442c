"""Every registered query of the library against its SQL."""

import pytest

from tests.compare import duck, rows_of, sql_rows
from trialloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    names, got = rows_of(registry.QUERIES[name](spark, sf_dir))
    sql_names, expected = sql_rows(duck(sf_dir), registry.ORACLE_SQL[name])
    assert names == sql_names
    assert got == expected


def test_every_query_has_sql():
    """But for draws by a hash that SQL lacks, and pages as markdown; these have tests of their own."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"rank_weighted_sample", "page_text"}


def test_library_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import trialloom.plans.registry; assert not [m for m in sys.modules if m.startswith('trialloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)
