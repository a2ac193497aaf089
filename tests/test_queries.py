"""All registered queries against their SQL on the smallest tables, and streaming against batch."""

import math
import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return "0.0" if value == 0 else f"{value:.5f}" if not value.is_integer() else f"{value:.1f}"
    if isinstance(value, bool) or not hasattr(value, "__index__"):
        return str(value)
    return f"{int(value):.1f}" if isinstance(value, float) else str(int(value))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple(plain(v).removesuffix(".0") for v in row))
    return sorted(out)


def names():
    from sedimenta.plans import oracle

    return sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in DATA.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from sedimenta.plans import oracle, queries

    got = queries.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(oracle.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_reason():
    from sedimenta.plans import oracle, queries

    assert set(queries.queries()) == set(oracle.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100


def test_streaming_keeps_what_is_new(spark, tmp_path):
    from sedimenta.streaming import incremental

    text = "the nightly conversion report lists every mirror folder and every missing image reference of the week "
    first = [(1, text * 3), (2, text * 3), (3, "quite another text about budgets and contracts that nobody has read before today")]
    second = [(4, text * 3), (5, "minutes of the meeting about tokens and packing of long documents into containers")]
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in (first, second):
        spark.createDataFrame(batch, "id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, text string").parquet(source)
        query = incremental.keep_new(spark, stream, "id", "text", target, check)
        query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 3, 5]


def test_streamed_scores_equal_batch(spark, tmp_path):
    from sedimenta.operators import scoring
    from sedimenta.streaming import incremental

    source = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "# Report\n- api"), (2, None)], "id long, text string")
    df.write.parquet(source)
    stream = incremental.scored(spark.readStream.schema("id long, text string").parquet(source), "text").select("id", "score")
    query = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM scored").collect())) == sorted(map(tuple, scoring.score(df, "text").select("id", "score").collect()))
