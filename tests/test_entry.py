"""Driver contract: entry(), queries() and oracle_sql() on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert {"model", "weighted_mean_similarity", "topics_count", "total_pairs"} <= set(df.columns)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_oracle_subset_small():
    names = ["similarity_moments", "model_overall_weighted", "comparison", "negative_summary",
             "extreme_pairs", "tfidf_moments", "answer_validity", "missing_report", "retry_rounds",
             "silhouette", "stream_rate_audit"]
    r = subprocess.run([sys.executable, os.path.join(ROOT, "tests", "oracle_check.py"), SF, *names],
                       capture_output=True, text=True, timeout=1200, cwd=ROOT)
    lines = [l for l in r.stdout.splitlines() if l.startswith(("OK", "FAIL", "ROWS"))]
    assert lines and all(l.startswith("OK") for l in lines), r.stdout[-3000:]


def test_catalog_imports_from_pyspark_zip_without_session(tmp_path):
    """With PySpark loaded from pyspark.zip, no session and another working directory."""
    import glob
    import pyspark

    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = [os.path.join(lib, "pyspark.zip"), *glob.glob(os.path.join(lib, "py4j-*.zip"))]
    code = ("import pyspark, __spark_entry__ as e; assert 'pyspark.zip' in pyspark.__file__;"
            "print(len(e.queries()), len(e.oracle_sql()))")
    env = dict(os.environ, PYTHONPATH=os.pathsep.join([*zips, ROOT]))
    env.pop("SPARK_HOME", None)
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env,
                       cwd=tmp_path, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
    n, m = map(int, r.stdout.split()[-2:])
    assert n >= 95 and m >= 83


@pytest.mark.parametrize("missing", ["tiktoken", "consonance.llm", "corpus_pipeline"])
def test_core_queries_stay_without_an_optional_part(tmp_path, missing):
    """A library, the subpackage or the pipeline that cannot be imported costs the llm queries alone."""
    code = (f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\n"
            "print(len(e.queries()), sum(n == 'pipeline' or n.startswith('op') for n in e.queries()), len(e.oracle_sql()))")
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=120,
                       env=dict(os.environ, PYTHONPATH=ROOT))
    assert r.returncode == 0, r.stderr[-2000:]
    n, llm, oracles = map(int, r.stdout.split()[-3:])
    assert n >= 95 and llm == 0 and oracles >= 83
