"""Spark against the DuckDB oracle, for every named query that has one."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from larkspur.plans.oracles import ORACLE_SQL
from larkspur.plans.registry import QUERIES

def oracle_names():
    """Every oracle: those of one chain share what they write, so the whole set costs seconds a query."""
    return sorted(ORACLE_SQL)


def rows(df, columns):
    plain = df[columns].astype(object)
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in plain.where(plain.notna(), None).values.tolist())


@pytest.mark.parametrize("name", oracle_names())
def test_matches_oracle(spark, sf_dir, name):
    connection = duckdb.connect()
    for f in os.listdir(sf_dir):
        connection.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), connection.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_module_lists_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_all_customer_messages_are_decided(spark, sf_dir):
    every = sorted(r.message_id for r in QUERIES["retrieval_corpus"](spark, sf_dir).select("message_id").collect())
    assert every and sorted(r.query_id for r in QUERIES["decision"](spark, sf_dir).collect()) == every


def test_entry_module_without_the_llm_subpackage(tmp_path):
    """The rest is listed where the subpackage is gone, and where it cannot be imported, which is said."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= names"
    quiet = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, capture_output=True, text=True)
    assert "left out" not in quiet.stderr
    (tmp_path / "larkspur/llm").mkdir()
    (tmp_path / "larkspur/llm/__init__.py").write_text("")
    (tmp_path / "larkspur/llm/queries.py").write_text("import not_installed_anywhere\n")
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, capture_output=True, text=True)
    assert "larkspur.llm.queries is left out: No module named 'not_installed_anywhere'" in told.stderr


def test_retrieved_rows_are_written_again_when_their_files_are_gone(spark, sf_dir):
    from larkspur.plans import registry
    from larkspur.sources.tables import discard

    before = sorted(QUERIES["tfidf_topk"](spark, sf_dir).collect())
    discard(registry.retrieved(spark, sf_dir)[1])
    assert sorted(QUERIES["tfidf_topk"](spark, sf_dir).collect()) == before


def test_retrieval_sees_a_table_that_changes(spark, sf_dir, tmp_path):
    table = tmp_path / "conversations.parquet"
    shutil.copy(f"{sf_dir}/conversations.parquet", table)
    before = QUERIES["tfidf_topk"](spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id % 2 = 0").toPandas().to_parquet(table)
    rows = QUERIES["tfidf_topk"](spark, str(tmp_path)).collect()
    asked = {str(r.query_id) for r in rows}
    assert 0 < len(rows) < before and all(int(q) // 100 % 2 == 0 for q in asked)
