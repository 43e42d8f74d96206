"""Command line: version, inventory, run, publish, retention, gold."""

from __future__ import annotations

import argparse
import json
import sys

from tabloom import __version__


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    a = sub.add_parser("inventory")
    a.add_argument("path")
    a = sub.add_parser("run")
    a.add_argument("path")
    a.add_argument("--workspace", required=True)
    a.add_argument("--refinement", choices=["rules", "none"], default="rules")
    for name in ("publish", "retention"):
        a = sub.add_parser(name)
        a.add_argument("--workspace", required=True)
    a = sub.add_parser("gold")
    a.add_argument("path")
    args = p.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "gold":
        from tabloom.operators.scoring import validate_gold

        with open(args.path) as f:
            wrong = validate_gold(json.load(f))
        print("\n".join(wrong) or "fine")
        return 3 if wrong else 0
    from tabloom.pipeline import run_path
    from tabloom.session import local_session
    from tabloom.sources.inventory import inventory
    from tabloom.sources.store import Workspace

    if args.command == "retention":
        print("\n".join(Workspace(args.workspace).retain()))
        return 0
    spark = local_session()
    if args.command == "inventory":
        for r in inventory(spark, args.path).orderBy("path").collect():
            print(r["source_id"], r["path"], "" if r["duplicate_of"] is None else f"= {r['duplicate_of']}")
    elif args.command == "run":
        found = run_path(spark, args.path, Workspace(args.workspace), args.refinement)
        print(json.dumps(found, ensure_ascii=False, indent=1))
        return 1 if any("failure" in x for x in found) else 0
    else:
        print(json.dumps(Workspace(args.workspace).publish(spark), indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
