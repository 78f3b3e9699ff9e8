"""The driver contract: optional corpus queries, and the package on workers."""

import os
import subprocess
import sys

from .conftest import ROOT


def run(code: str, cwd: str, **env) -> str:
    e = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=e, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip().splitlines()[-1]


LOAD = f"import sys; sys.path.insert(0, {ROOT!r})\n"


def test_a_missing_library_costs_the_corpus_queries_alone(tmp_path):
    code = LOAD + "sys.modules['xxhash'] = None\nimport __spark_entry__ as E; print(len(E.queries()) >= 96, 'te_nested_oof' in E.queries())"
    assert run(code, str(tmp_path)) == "True True"


def test_workers_import_the_package_from_any_folder(tmp_path):
    code = LOAD + f"""
from foldcraft.session import build_session, ship_package
spark = build_session("local[2]", 2)
ship_package(spark); ship_package(spark)
def f(batches):
    import foldcraft.operators.rank
    for b in batches:
        yield b
print(spark.range(10).mapInArrow(f, "id long").count())
"""
    assert run(code, str(tmp_path)) == "10"
