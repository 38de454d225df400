"""Write COVERAGE.md: every registered query, its implementing operator and
what it runs on. usage: python tools/coverage_table.py > COVERAGE.md"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailsift.plans.registry import ORACLE, QUERIES  # noqa: E402

# Where each SURVEY §2 id group is implemented.
MODULES = {
    "S": "operators/search.py, sources/adapters.py, sources/mime.py",
    "P": "operators/ingest.py, operators/search.py",
    "W": "operators/ingest.py, operators/maintain.py, operators/delta.py",
    "C": "operators/criteria.py, operators/search.py",
    "T": "operators/criteria.py, operators/search.py, operators/sort.py",
    "F": "functions/*.py, sources/mime.py",
    "B": "operators/batch.py, operators/ingest.py",
    "R": "streaming/stream.py, operators/delta.py",
}


def main():
    print("# COVERAGE\n")
    print("Every SURVEY §2 id is a key of `__spark_entry__.queries()`; all have a DuckDB twin in")
    print("`oracle_sql()`. Generated by `tools/coverage_table.py`.\n")
    print("| key | implemented in | query | oracle |")
    print("| --- | --- | --- | --- |")
    for key, fn in QUERIES.items():
        doc = (fn.__doc__ or "").strip().splitlines()
        what = doc[0] if doc else fn.__name__
        print(f"| `{key}` | {MODULES[key[0]]} | {what.replace('|', '/')} | {'yes' if key in ORACLE else 'rows only'} |")


if __name__ == "__main__":
    main()
