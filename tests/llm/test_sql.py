"""The SQL of registered queries against the queries, on tables of odd rows."""

import duckdb
import numpy as np
import pytest

from wordloom.llm import registry, sql


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    r = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{x}" for x in r.integers(0, 300, n))
    base = [prose(80) for _ in range(6)]
    rows = [(i, base[i % 6] + (" tail" * (i % 3)) if i < 24 else prose(60)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, ""), (103, "!!! ..."), (104, "It's  we'll\n\n they've\u00a0 caf\u00e9 \u65e5\u672c 12,5 \t x"), (105, "a b"), (106, "a b"), (107, "ab" * 300), (108, "Caf\u00c9 A B")]
    rows += [(109, "it's"), (110, " 's"), (111, "''ll"), (112, "  \n"), (113, "\n\nword "), (104, "a second text of this id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    m = np.concatenate([c + 0.1 * r.normal(size=(n, 16)) for c, n in zip(r.normal(size=(30, 16)), [1] * 20 + [3] * 8 + [12, 30])]).astype(np.float32)
    m = np.concatenate([m, m[-3:], m[:1] * 2])
    vectors = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_sql_gives_the_same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(sql.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
