import pytest

import aquilon.plans.round_trips  # noqa: F401
from aquilon.plans.queries import ORACLES, QUERIES

from oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_value_histogram_covers_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").where("value IS NOT NULL")
    assert sum(r.n for r in QUERIES["value_auto_histogram"](spark, sf).collect()) == d.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["trajectory_id", "recombination_time", "did_recombine"] and df.count() > 0


def test_entry_without_the_corpus_part(tmp_path):
    """The other queries work where the corpus modules, or what they need, are missing."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/aquilon", tmp_path / "aquilon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    for code, where in ((say, tmp_path), ("import sys; sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) > 70", top)):
        subprocess.run([sys.executable, "-c", code], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, check=True)
