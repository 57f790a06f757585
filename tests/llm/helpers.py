"""Odd documents that every operator is tried on, and comparison with SQL."""

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, id int, w string"

ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "a",
    "One two three.",
    "one two three.",
    "ÀÉ ñandú straße 漢字かな交じり文 🙂👍🏽 x́",
    "\x00\x01\x1c\x85  tab\tnew\r\nline",
    "!!! ??? ### 12345 67.89 don't they'll we've I'd",
    "word " * 30_000,
    "a" * 3_000,
    "ab" * 700 + "!" * 900 + "7" * 500,
    "The end of it all is near, and the end of it all is near again.",
]


def odd(spark, repeat=2):
    """Odd texts, each twice, one without an id, with columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "x", 1, 2, None) for i, t in enumerate(ODD_TEXTS)]
    rows += rows[: len(rows) * (repeat - 1)] + [(None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(rows, names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def check_sql(spark, query, sql, sf_dir, tables):
    """The query's rows against DuckDB's for sql on the same tables."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(n)] for n in names) for r in found.fetchall()), key=repr)
    assert same(df.collect(), names) == want
