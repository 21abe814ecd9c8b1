"""The driver's entry without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
found = entry.queries()
assert "daily_kpis" in found and "pipeline" not in found and set(entry.oracle_sql()) <= set(found)
"""


def test_a_missing_library_or_folder_leaves_the_other_queries():
    for name in ("xxhash", "merchantlens.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", WITHOUT.format(name=name)], cwd=ROOT, check=True, timeout=120)
