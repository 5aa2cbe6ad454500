"""The driver's contract without the optional package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_llm(tmp_path):
    shutil.copytree(ROOT / "recurva", tmp_path / "recurva", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = ("import bench, __spark_entry__ as c; names = set(c.queries()); assert 'a7_all_metrics' in names; "
            "assert not [n for n in names if n.startswith('op') or n == 'pipeline']; assert set(c.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
