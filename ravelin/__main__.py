"""python -m ravelin [--from MODULE] list | run NAME SF_DIR [OUT]: the queries of a module, without one the engine's own; without OUT twenty rows are shown."""

from __future__ import annotations

import sys
from importlib import import_module

from . import queries, surface
from .session import session


def main(args: list[str]) -> int:
    known = queries.QUERIES | surface.QUERIES
    if args[:1] == ["--from"] and len(args) > 1:
        known, args = import_module(args[1]).QUERIES, args[2:]
    if args == ["list"]:
        print("\n".join(known))
        return 0
    if len(args) in (3, 4) and args[0] == "run" and args[1] in known:
        df = known[args[1]](session(), args[2])
        if len(args) == 4:
            df.write.mode("errorifexists").parquet(args[3])
        else:
            df.show(20, truncate=False)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


def command() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
