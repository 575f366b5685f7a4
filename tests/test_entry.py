import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage(tmp_path):
    for part in ("tessera", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(ROOT / part) if part != "tessera" else None
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessera" / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[2] == "False" and int(done.stdout.split()[0]) > 50
