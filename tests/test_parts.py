"""The library without its training-data part."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder, tmp_path):
    done = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    return [set(x) for x in json.loads(done.stdout.splitlines()[-1])]


def test_rest_works_alone(tmp_path):
    """With and without corpus_pipeline.py, which lies outside the two folders and is only read if they are there."""
    for k, left in enumerate((["corpus_pipeline.py"], [])):
        folder = tmp_path / str(k)
        shutil.copytree(ROOT / "lagweave", folder / "lagweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *left):
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, folder)
        queries, oracles = names(folder, tmp_path)
        assert len(queries) > 150 and oracles <= queries and not any(q == "pipeline" or q.startswith("op1") for q in queries)


def test_errors_of_the_other_part_are_not_hidden(tmp_path):
    """A broken training-data part is no absent one."""
    shutil.copytree(ROOT / "lagweave", tmp_path / "lagweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lagweave" / "llm").mkdir()
    (tmp_path / "lagweave" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lagweave" / "llm" / "queries.py").write_text("import no_such_module\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode != 0 and "no_such_module" in done.stderr
