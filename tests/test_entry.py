"""The driver contract without parts of the corpus subpackage."""

import subprocess
import sys

import pytest

from tests.conftest import ROOT

HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:{n}] == {parts!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    q = e.queries()
print(len(q), sum(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in q), sum(issubclass(w.category, RuntimeWarning) for w in said))
"""


@pytest.mark.parametrize("hidden, warned", [("public_tokenizers", True), ("sentencepiece", None), ("tidemark.llm", False)])
def test_other_queries_stay_without_the_corpus(hidden, warned):
    code = HIDE.format(n=len(hidden.split(".")), parts=hidden.split("."))
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, corpus, said = map(int, out.stdout.split())
    assert total - corpus >= 187
    if warned is not None:
        assert corpus == 0 and (said > 0) == warned


def test_a_missing_own_module_is_an_error():
    out = subprocess.run([sys.executable, "-c", HIDE.format(n=3, parts=["tidemark", "operators", "ranks"])], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0
