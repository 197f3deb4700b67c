"""Developer tool: compare every registered query with its DuckDB oracle.

usage: python tools_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, "tests")

from kiln.plans import ORACLES, QUERIES  # noqa: E402
from kiln.session import get_session  # noqa: E402
from oracle_harness import compare, duck_connection  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        if name not in ORACLES:
            n = QUERIES[name](spark, sf_dir).count()
            print(f"{name:28s} R   rows={n} {time.time() - t:.1f}s")
            continue
        try:
            problems, stypes, dtypes = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            problems, stypes, dtypes = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], {}, {}
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:28s} {status} {time.time() - t:.1f}s {'; '.join(problems)}")
        if problems:
            print("    spark:", stypes, "\n    duck: ", dtypes)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
