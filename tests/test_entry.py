"""The registered queries with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"no {{name}}", name=name)
sys.meta_path.insert(0, Hidden())
"""


def listed(*hidden: str):
    code = "".join(HIDE.format(name=name) for name in hidden) + LIST
    run = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    return run.returncode, run.stdout.split(), run.stderr


def test_without_the_subpackage_or_what_only_it_needs():
    for name in ("rollcall.llm", "rollcall.llm.registered"):
        code, counts, _ = listed(name)
        assert code == 0 and counts[1] == "0" and int(counts[0]) == int(counts[2]) > 80


def test_a_fault_of_the_rest_is_not_hidden():
    code, _, error = listed("rollcall.operators.matching")
    assert code != 0 and "rollcall.operators.matching" in error
