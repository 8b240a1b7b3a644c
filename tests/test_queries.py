"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from radiograph.plans import registry

SMALL, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
#: Queries over texts: what they must not find turns up in larger tables only.
TEXTS = ("sql_file_mentions", "sql_table_refs", "affected_tables", "sql_token_walk", "constant_queries", "model_references", "ddl_constraints", "line_classifier")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


def compared(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    cursor = con.execute(f"select {quoted} from ({registry.oracle_sql()[name]})")
    assert plain([tuple(r) for r in got.select(columns).collect()]) == plain(cursor.fetchall())


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    compared(spark, name, SMALL)


@pytest.mark.skipif(not LARGER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", TEXTS)
def test_same_rows_of_larger_texts(spark, name):
    compared(spark, name, LARGER)


@pytest.mark.skipif(not LARGER.exists(), reason="no test tables here")
def test_communities_beat_a_known_partition(spark):
    from radiograph.operators import clusters
    from radiograph.plans import measure_queries
    from radiograph.plans.lineage import cut

    held, links = measure_queries.module_graph(spark, str(LARGER))
    tables = clusters.clustered_tables(held)
    pairs = cut(clusters.relatedness(tables, links))
    known = tables.selectExpr("id as node", "split(name, '_')[0] as community")
    found = clusters.modularity(pairs, clusters.communities(pairs)).first()["q"]
    assert found >= clusters.modularity(pairs, known).first()["q"] - 1e-6 and found > 0
