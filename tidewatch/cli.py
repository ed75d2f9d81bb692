"""`python -m tidewatch.cli scan ...`: a scan from the command line."""
from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .functions.text import when
from .plans import report
from .plans.scan import KINDS, Options, scan


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch")
    top.add_argument("--version", action="version", version=f"tidewatch {report.VERSION}")
    p = top.add_subparsers(dest="command", required=True).add_parser("scan", help="compare schedules with what the logs say ran")
    for flag in ("--crontab", "--systemctl-show", "--log-file"):
        p.add_argument(flag, action="append", default=[], metavar="PATH")
    p.add_argument("--crontab-format", choices=("auto", "user", "system"), default="auto")
    p.add_argument("--crontab-user")
    for flag in ("--journal", "--discover", "--exit-zero"):
        p.add_argument(flag, action="store_true")
    for flag in ("--since", "--until", "--now"):
        p.add_argument(flag, metavar="TIME")
    p.add_argument("--tolerance", type=float, default=120.0)
    p.add_argument("--format", choices=("json", "markdown", "both"), default="markdown")
    p.add_argument("--output", metavar="PATH")
    p.add_argument("--ignore", action="append", choices=KINDS, default=[])
    return top


def options(args, clock: datetime) -> Options:
    """Without a file to read, the machine at hand is scanned. Offsets are relative to --now."""
    now = when(args.now, clock) if args.now else clock
    own = not (args.crontab or args.systemctl_show or args.log_file)
    return Options(args.crontab, args.systemctl_show, args.log_file, args.crontab_format, args.crontab_user, when(args.since, now) if args.since else None,
                   when(args.until, now) if args.until else None, args.tolerance, args.discover or own, args.journal or own, frozenset(args.ignore), now)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.tolerance < 0:
        p.error("--tolerance must not be negative")
    try:
        opt = options(args, datetime.now().replace(microsecond=0))
    except ValueError as e:
        p.error(str(e))
    gone = [x for x in (*args.crontab, *args.systemctl_show, *args.log_file) if not os.path.exists(x)]
    if gone:
        print("\n".join(f"tidewatch: no such file: {x}" for x in gone), file=sys.stderr)
        return 2
    result = scan(spark or SparkSession.builder.appName("tidewatch").getOrCreate(), opt)
    made = [report.to_json(result)] * (args.format != "markdown") + [report.to_markdown(result).rstrip()] * (args.format != "json")
    text = "\n\n".join(made) + "\n"
    if args.output:
        try:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        except OSError as e:
            print(f"tidewatch: cannot write {args.output}: {e}", file=sys.stderr)
            return 2
    else:
        sys.stdout.write(text)
    for w in result.warnings:
        print(f"tidewatch: {w.code}: {w.message}", file=sys.stderr)
    return result.exit_code(args.exit_zero)


if __name__ == "__main__":
    raise SystemExit(main())
