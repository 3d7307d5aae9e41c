"""The entry point without the operators' subpackage."""

from __future__ import annotations

import subprocess
import sys

from conftest import ROOT


def test_entry_without_llm():
    code = """
import importlib.util, sys
find = importlib.util.find_spec
def hidden(name, *a):
    if name.startswith("quantloom.llm"):
        raise ModuleNotFoundError(name)
    return find(name, *a)
importlib.util.find_spec = hidden
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_the_package_that_is_shipped_can_be_imported(tmp_path):
    import subprocess
    import sys

    import __spark_entry__ as entry

    code = "import quantloom.operators.linking, quantloom.plans.registry as r; print(len(r.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": entry._package(), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0 and int(done.stdout) > 200, done.stderr[-500:]
