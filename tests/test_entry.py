import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_text_operators(tmp_path):
    """The library's queries stay usable where the text operators are left out, with or without the pipeline's module."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "docketry", tmp_path / "docketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; from docketry.plans import catalog; assert e.queries().keys() == catalog.queries().keys() and len(e.oracle_sql()) == len(e.queries())"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
