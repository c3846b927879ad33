"""Every query against its SQL, at the scale that the SQL names."""

import duckdb
import pytest

from lamella.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "double": "double", "string": "string", "boolean": "boolean", "timestamp": "time", "timestamp_ntz": "time", "date": "date", "float": "float"}
DUCK = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "long", "HUGEINT": "huge", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "time", "DATE": "date", "FLOAT": "float", "UBIGINT": "ulong", '"NULL"': "null"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert got[1]
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    expected = rows_of(want.columns, want.fetchall())
    assert got == expected
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    duck_kinds = {c: DUCK.get(str(t), str(t)) for c, t in zip(want.columns, want.types)}
    for c, kind in kinds.items():
        assert duck_kinds[c] in (kind, "huge", "ulong") or {kind, duck_kinds[c]} <= {"int", "long"}, (c, kind, duck_kinds[c])
