"""The entry module without the training-text subpackage, or without what it needs."""

import os
import subprocess
import sys

import pytest

from checks.registry import QUERIES
import __spark_entry__ as entry  # noqa: F401  registers them

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# A finder that knows nothing of one module, ahead of all others.
HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Hidden())
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
print(len(entry.queries()), "pipeline" in entry.queries(), any({name!r} in str(w.message) for w in said))
"""


@pytest.mark.parametrize("name", ["logloom.llm", "public_tokenizers", "ahocorasick", "corpus_pipeline"])
def test_the_other_queries_stay(name):
    done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, pipeline, said = done.stdout.split()[-3:]
    assert int(count) >= len(QUERIES) and (pipeline, said) == ("False", "True")
