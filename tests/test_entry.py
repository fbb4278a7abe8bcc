"""The entry point with and without the optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "corpuscope"), tmp_path / "corpuscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; from corpuscope.plans.queries import QUERIES; assert e.queries().keys() == QUERIES.keys(); print('fine')"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_else_imports_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "corpuscope")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "corpuscope.llm" not in file.read(), name
