"""Every query with SQL gives the same rows as DuckDB; the others run and have a schema."""

import pytest

from heliograph.plans import registry
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], sf) == ""


#: No titles or rows of the smallest tables are near enough for these.
MAY_BE_EMPTY = {"cl03_similarity_components", "cl05_density_clusters"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = sorted(map(repr, df.collect()))
    assert got or name in MAY_BE_EMPTY
    assert all(len(r) == len(df.columns) for r in df.limit(5).collect())


def test_bad_json_line_is_an_error(spark, tmp_path):
    from heliograph.sources import connectors

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert [r["a"] for r in connectors.json_lines(spark, str(tmp_path), "a long", skip_corrupt=True).orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception, match="MALFORMED"):
        connectors.json_lines(spark, str(tmp_path), "a long").collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
