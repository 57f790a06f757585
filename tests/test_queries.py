import duckdb
import pytest

from rasterbrook.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tiny_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, tiny_dir, db, name):
    df = queries.QUERIES[name](spark, tiny_dir)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got
    if name in queries.ORACLES:
        found = db.execute(queries.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        want = sorted((tuple(r[columns.index(n)] for n in names) for r in found.fetchall()), key=repr)
        assert len(got) == len(want)
        assert got == want


def test_a_label_of_more_vectors_than_a_frame_is_high(spark, tiny_dir, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id + 1000 * r AS vec_id, embedding, CAST(1 AS INTEGER) AS label FROM '{tiny_dir}/embeddings.parquet', range(17) t(r)) TO '{path}'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    for rows in (queries.QUERIES["jpeg_unmarked"](spark, str(tmp_path)), queries.jpeg_unmarked(spark, tiny_dir, 7).filter("label = 3")):
        got = sorted((r.mcu, r.comp, r.z, r.v, r.error) for r in rows.select("mcu", "comp", "z", "v", "error").collect())
        want = con.execute(f"SELECT mcu, comp, z, v, error FROM ({queries.ORACLES['jpeg_unmarked']})").fetchall()
        assert got == sorted(want)
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tiny_dir}/embeddings.parquet' WHERE label = 3")
