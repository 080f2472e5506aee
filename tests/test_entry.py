"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_oracles(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators():
    code = "import sys; sys.modules['tessaline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
