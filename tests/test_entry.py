import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_text_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tickforge"):
        src = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tickforge" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    for gone in ((), ("corpus_pipeline.py",)):  # the pipeline may stay behind, or go too
        for name in gone:
            os.remove(tmp_path / name)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        x = __spark_entry__.entry(spark)
        assert len(x.columns) == 51 and x.count() > 0
