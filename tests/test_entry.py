"""The driver's contract, with and without the text operators."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and found.columns == ["sample", "contig", "pos", "half", "allele", "n_all", "n_good", "n_good_dubious"]


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_text_operators(tmp_path):
    """A copy of the repository without the optional parts still imports and offers the rest."""
    copy = tmp_path / "copy"
    (copy / "strandlake").mkdir(parents=True)
    for name in os.listdir(f"{REPO}/strandlake"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{REPO}/strandlake/{name}", copy / "strandlake" / name)
    os.symlink(f"{REPO}/__spark_entry__.py", copy / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(copy)!r}); import __spark_entry__ as e; q = e.queries(); assert 'A11_strand_consensus' in q and not any(n.startswith('op') for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
