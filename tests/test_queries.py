"""Every registered query against its SQL, over the smallest data."""

import glob
import os

import duckdb
import pytest

from cinequery.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def same(spark, con, query, sql):
    found = query(spark, DATA)
    columns = sorted(found.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=key)
    want = sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=key)
    assert list(map(key, got)) == list(map(key, want))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, name):
    same(spark, database, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_llm_package():
    core = [p for p in glob.glob("cinequery/**/*.py", recursive=True) if "/llm/" not in p]
    assert core and not any("cinequery.llm" in open(p).read() for p in core)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from cinequery import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    with pytest.raises(SystemExit):
        cli.main(["kis"])
    with pytest.raises(SystemExit):
        cli.main(["trake", "--event", "a"])
    out = tmp_path / "a.csv"
    assert cli.main(["kis", "--data", DATA, "--ocr", "GIÁ", "--text", "x", "--rrf-k", "60", "--rows", "5", "--out", str(out)]) == 0
    assert len(out.read_text().splitlines()) == 5
    assert cli.main(["trake", "--data", DATA, "--event", "a", "--event", "b", "--rows", "3"]) == 0
    assert cli.main(["run", "video_summary", "--data", DATA]) == 0
    assert cli.main(["list"]) == 0 and "kis_visual" in capsys.readouterr().out
