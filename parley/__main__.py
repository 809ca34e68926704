"""Command line: list the registered queries, run one into a table, or show it.

    python -m parley list
    python -m parley run <key> <data_dir> <out_path> [--format parquet|json]
    python -m parley show <key> <data_dir> [n]
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from .plans.catalog import oracle_sql, queries
    if not argv or argv[0] not in ("list", "run", "show"):
        print(__doc__)
        return 2
    qs = queries()
    if argv[0] == "list":
        from .plans.descriptions import DESCRIPTIONS
        orc = oracle_sql()
        for k in sorted(qs):
            print(f"{k:28s} {'oracle' if k in orc else 'rows-only':9s} {DESCRIPTIONS.get(k, '')}")
        return 0
    from .session import get_session
    spark = get_session()
    key, data_dir = argv[1], argv[2]
    df = qs[key](spark, data_dir)
    if argv[0] == "show":
        df.show(int(argv[3]) if len(argv) > 3 else 20, truncate=80)
        return 0
    out, fmt = argv[3], "parquet"
    if "--format" in argv:
        fmt = argv[argv.index("--format") + 1]
    df.write.mode("overwrite").format(fmt).save(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
