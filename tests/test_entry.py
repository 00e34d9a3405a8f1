import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "is_outlier" in out.columns


def test_nothing_outside_the_subpackage_needs_it():
    code = (
        "import importlib.util as u, sys\n"
        "find = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name in ('sparkassay.llm', 'corpus_pipeline') else find(name, *a)\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and 'pipeline' not in e.queries()\n"
        "assert not [m for m in sys.modules if m.startswith('sparkassay.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
