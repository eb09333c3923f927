"""Run registered checks by name prefix: python tests/run_checks.py [sf_dir] [prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from recon.session import build_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.monotonic()
        try:
            df = build(spark, sf)
            if name in oracle:
                problem = difference(df, con, oracle[name])
                note = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                problem, note = None, f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            problem = note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:38s} {time.monotonic() - begun:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
