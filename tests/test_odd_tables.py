"""Every query of given tables over tables without rows, and over tables with nulls in all columns and repeated rows."""

import os

import pytest

from folioscope import plans

DATA = "/root/testdata/sf0.001"
#: Inline cases read no table.
READING = ("pages", "streams", "ledger", "derived", "restored", "text", "corpus", "registry")
NAMES = sorted(n for n, f in plans.QUERIES.items() if f.__module__.rsplit(".", 1)[-1] in READING)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("tables")
    for f in os.listdir(DATA):
        whole = pq.read_table(f"{DATA}/{f}")
        nulls = pa.table({c: pa.array([None], whole.schema.field(c).type) for c in whole.column_names}, schema=whole.schema)
        some = whole.slice(0, 12)
        for kind, table in (("empty", whole.slice(0, 0)), ("odd", pa.concat_tables([some, some.slice(2, 2), nulls, nulls]))):
            (root / kind).mkdir(exist_ok=True)
            pq.write_table(table, root / kind / f)
    return root


def test_empty_tables(spark, folders):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folders / "empty"):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folders}/empty/{f}'")
    for name in NAMES:
        df = plans.QUERIES[name](spark, f"{folders}/empty")
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        if name in plans.ORACLE_SQL:
            wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
            assert got == sorted(wanted, key=repr), name


def test_odd_tables(spark, folders):
    for name in NAMES:
        if name.startswith("stream_"):
            continue
        plans.QUERIES[name](spark, f"{folders}/odd").write.format("noop").mode("overwrite").save()


def test_footnotes_of_any_text(spark, tmp_path):
    """Short texts of accents, other alphabets, marks of their own or null: the planted marks count, as in the SQL."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["Éé éé.", "Ñé ñ.", "日本語", "Привет, мир", "é" * 300, "😀😀😀", "x¹ and ² and y^3", "²³⁴", "∑∑∑ x₁", "\u00a0\u3000", "", None, "plain"]
    rows = [{"conv_id": i, "turn": t, "role": "user", "text": text} for i, text in enumerate(texts) for t in (0, 3, 4, 5, 6)] + [{"conv_id": None, "turn": 4, "role": None, "text": "é"}]
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, kinds), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    got = [tuple(r) for r in plans.QUERIES["turn_footnotes"](spark, str(tmp_path)).select("doc_id", "n_marks").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(plans.ORACLE_SQL["turn_footnotes"]).fetchall(), key=repr)
