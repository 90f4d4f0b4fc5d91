import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def run(folder, code, cwd):
    return subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(folder)!r}); {code}"], cwd=cwd, capture_output=True, text=True)


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_training_data_folders(tmp_path):
    shutil.copytree(REPO / "shapelake", tmp_path / "shapelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    got = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert 'nn_1' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)", tmp_path)
    assert got.returncode == 0, got.stderr


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; import __spark_entry__ as e; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        "print('ROWS', e.queries()['mh_chain'](s, '').count())"
    )
    got = run(REPO, code, tmp_path)
    assert "ROWS 1600" in got.stdout, got.stderr[-2000:]
