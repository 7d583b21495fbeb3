import importlib.util
import subprocess
import sys

import pytest

from tests.conftest import ROOT


def names_without(*modules):
    lines = ["import sys, warnings"] + [f"sys.modules[{m!r}] = None" for m in modules]
    lines += ["warnings.simplefilter('always')", "import __spark_entry__ as e", "print(sorted(e.queries()))", "assert set(e.oracle_sql()) <= set(e.queries())"]
    return subprocess.run([sys.executable, "-c", "\n".join(lines)], cwd=ROOT, capture_output=True, text=True)


def test_the_rest_stands_without_the_corpus_operators():
    done = names_without("gatehouse.llm")
    assert done.returncode == 0 and "secret_scan_by_source" in done.stdout and "op1" not in done.stdout and "missing" not in done.stderr


@pytest.mark.skipif(importlib.util.find_spec("gatehouse.llm") is None, reason="the corpus operators are not here")
def test_a_missing_third_party_module_is_told():
    done = names_without("pyarrow")
    assert done.returncode == 0 and "secret_scan_by_source" in done.stdout and "op1" not in done.stdout and "module pyarrow is missing" in done.stderr


def test_a_broken_import_inside_is_an_error():
    done = names_without("gatehouse.functions.text")
    assert done.returncode != 0
