import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 200, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['aerolith.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark, sf):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.columns == ["recording", "n_frames", "n_points", "n_voxels"] and d.count() > 0
