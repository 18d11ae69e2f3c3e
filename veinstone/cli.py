"""Command line: python -m veinstone.cli run|queries|query."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from .plans.config import PRESETS, Config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinstone")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="analyse archives, sources and libraries into a workspace")
    run.add_argument("--sources", help="folder of decompiled sources")
    run.add_argument("--libraries", help="Parquet table of native libraries")
    run.add_argument("--preset", choices=sorted(PRESETS), default="standard")
    for f in fields(Config):
        if f.name == "profile":
            continue
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            run.add_argument(name, action=argparse.BooleanOptionalAction, default=None)
        elif isinstance(f.default, tuple):
            run.add_argument(name, type=lambda s: tuple(x.strip() for x in s.split(",") if x.strip()), default=None)
        elif isinstance(f.default, int):
            run.add_argument(name, type=int, default=None)
        else:
            run.add_argument(name, default=None)
    sub.add_parser("queries", help="list the registered queries")
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="write Parquet here instead of showing rows")
    return p


def config_of(args: argparse.Namespace) -> Config:
    """The preset's settings, overridden by the options given."""
    base = Config().with_preset(args.preset)
    given = {f.name: getattr(args, f.name) for f in fields(Config) if getattr(args, f.name, None) is not None}
    return Config(**{**{f.name: getattr(base, f.name) for f in fields(Config)}, **given})


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from .queries import QUERIES
    from .session import local_session

    if args.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.command == "run" and not (args.input and args.workspace):
        raise SystemExit("--input and --workspace are required")
    spark = local_session()
    if args.command == "query":
        df = QUERIES[args.name](spark, args.folder)
        df.write.parquet(args.out) if args.out else df.show(50, truncate=False)
        return 0
    from .plans.pipeline import Run

    libraries = spark.read.parquet(args.libraries) if args.libraries else None
    out = Run(spark, config_of(args), args.sources, libraries).execute()
    print(json.dumps(out, indent=2, default=str))
    return 1 if out["has_failed"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
