"""``python -m framelake QUERY FOLDER [--json]``: run a registered query and print its rows; without a name, list them."""

from __future__ import annotations

import argparse

from framelake.plans import core_data, library
from framelake.session import local_session


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="framelake")
    p.add_argument("query", nargs="?")
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--rows", type=int, default=20)
    given = p.parse_args(args)
    known = {**core_data.QUERIES, **library.QUERIES}
    if given.query is None:
        print("\n".join(sorted(known)))
    elif given.query not in known:
        raise SystemExit(f"unknown query {given.query!r}")
    else:
        found = known[given.query](local_session(), given.folder)
        if given.json:
            print("\n".join(r[0] for r in found.toJSON().map(lambda x: (x,)).take(given.rows)))
        else:
            found.show(given.rows, truncate=60)


if __name__ == "__main__":
    main()
