import math

import duckdb
import pytest

import __spark_entry__ as entry
from tributary.plans import queries
from tributary.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(value(r[c]) for c in columns) for r in df.collect()], key=str)
    if name in ORACLES:
        q = con.execute(ORACLES[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        assert got == sorted([tuple(value(r[names.index(c)]) for c in columns) for r in q.fetchall()], key=str)


def against_sql(spark, path, names):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    for name in names:
        df = QUERIES[name](spark, str(path))
        q = c.execute(ORACLES[name])
        columns = [d[0] for d in q.description]
        assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(q.fetchall(), key=str), name


def test_search_counts_all_lines(spark, tmp_path):
    """More lines than a page may show, the last of them at the end of both texts."""
    long = "".join(f"License {k}\n" for k in range(5200))
    spark.createDataFrame([(1, long, "s"), (2, "other\n" + long, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    against_sql(spark, tmp_path, ["search_diff"])


def test_reports_of_a_large_source_are_bounded(spark, tmp_path, monkeypatch):
    rows = [(k, f"some text\nof number {k % 90}", "hot" if k % 3 else f"s{k % 2}") for k in range(900)] + [(900, "", "hot"), (901, None, "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, texts = [], queries._texts
    monkeypatch.setattr(queries, "_texts", lambda rendered: texts(seen.append(rendered) or rendered))
    against_sql(spark, tmp_path, names := ["notice_roundtrip", "dep5_roundtrip", "tagvalue_roundtrip", "clixml_roundtrip"])
    assert len(seen) == len(names)
    for rendered in seen:
        reports = [r["text"].count("some text") for r in rendered.collect()]
        assert sum(reports) == 900 and 1 < max(reports) <= queries.REPORT_DOCS


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_notice_an_empty_alignment(spark, con, monkeypatch):
    """The queries about diffs fail where no line is ever matched."""
    monkeypatch.setattr(queries.lines, "matches", lambda left, right, pair="pair_id": left.limit(0).select(pair, left.line_no.cast("int").alias("i"), left.line_no.cast("int").alias("j")))
    for name in ("opcodes", "aligned_segments", "diff_rows", "diff_sizes", "text_diff_summary"):
        q = con.execute(ORACLES[name])
        columns = [d[0] for d in q.description]
        assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()), key=str) != sorted(q.fetchall(), key=str), name
