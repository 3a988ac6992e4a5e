import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from veilspan.plans import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rounded(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_its_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(rounded(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all("@example.com" in r.text for r in rows)


@pytest.mark.parametrize("name", ["redact_documents", "redact_conversations"])
def test_whole_job_keeps_every_row(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = name.removeprefix("redact_")
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_entry_stands_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert out.stdout.split()[-3:] == [str(len(queries.QUERIES)), str(len(queries.ORACLE)), "False"], out.stderr


def test_entry_stands_without_a_library_of_the_optional_parts(tmp_path):
    """A library that only the optional parts need is absent; a missing module of our own still raises."""
    block = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print('pipeline' in e.queries(), 'email_spans' in e.queries())"
    for name, want in (("tokenizers", "False True"), ("veilspan.operators.policy", None)):
        out = subprocess.run([sys.executable, "-c", block.format(name)], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
        assert (out.returncode == 0 and out.stdout.strip().endswith(want)) if want else out.returncode, out.stderr


NAMES = "Mr. Rolf Amberson of Zenith Harbour Limited lives at 12 Cedar Hill Road and met Ms Ida Quill there.\nMR ROLF AMBERSON SIGNED FOR ZENITH HARBOUR LIMITED TODAY.\n"


@pytest.mark.parametrize(("name", "columns"), [("redact_documents", "1L AS doc_id"), ("redact_conversations", "1L AS conv_id, 1 AS turn")])
def test_whole_job_replaces_names(spark, tmp_path, name, columns):
    spark.createDataFrame([(NAMES,)], "text string").selectExpr(*columns.split(", "), "text").write.parquet(f"{tmp_path}/{name.removeprefix('redact_')}.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).first()
    for x in ("Rolf Amberson", "Zenith Harbour Limited", "12 Cedar Hill Road", "Ida Quill", "ROLF AMBERSON"):
        assert x not in got.text
    assert got.replacements
