"""Run the registered queries against their checks: python tests/check.py [prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry
    from barline.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    import logging

    logging.disable(logging.CRITICAL)
    con = connect(sf)
    checks = entry.oracle_sql()
    failed = 0
    for name, plan in entry.queries().items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            df = plan(spark, sf)
            if name in checks:
                problem = compare(df, con, checks[name])
                n = ""
            else:
                rows = df.collect()
                problem, n = None, f" rows={len(rows)} {rows[:2]}"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", ""
        took = time.time() - start
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {took:5.1f}s {name}{n[:300]}" + (f"\n     {problem}" if problem else ""), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
