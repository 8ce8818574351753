"""Command line: materialise the 16 result tables of one refresh.

    python -m jobmix refresh --from 2025-01-01 --to 2025-03-31 \\
        --rules labels.json [--bu-tag business_unit] [--rate 0.85] \\
        [--bu All] [--env PROD --env PPE] \\
        [--source catalog | --source parquet:/shared/telemetry] \\
        --out /shared/dashboard [--format parquet | --format table]

Inputs come from the catalog's system tables (default) or from a folder
written by ``jobmix.sources.layout.write_tables``.  All tables are computed
through one :class:`~jobmix.plans.dashboard.Dashboard` (shared flag table)
after their columns have been checked.  ``--rules`` names the label rules
(:func:`jobmix.functions.rules.load_rules`); with ``--bu-tag`` alone, spend and
serverless usage take the business unit from that tag.  All tables are written
and overwritten at ``<out>/<name>`` (parquet) or ``<out>.<name>`` (table).
"""

from __future__ import annotations

import argparse
import sys

from jobmix.params import Params, TimeRange


def parse(argv: list[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="jobmix")
    sub = ap.add_subparsers(dest="command", required=True)
    r = sub.add_parser("refresh", help="compute and write all result tables")
    r.add_argument("--from", dest="start", required=True, help="first day (YYYY-MM-DD)")
    r.add_argument("--to", dest="end", required=True, help="last day (YYYY-MM-DD)")
    r.add_argument("--bu", action="append", help="BU choice (repeatable; default All)")
    r.add_argument("--env", action="append", help="environment choice (repeatable; default All)")
    r.add_argument("--rules", help="JSON file with the label rules")
    r.add_argument("--bu-tag", help="tag of the usage records that names the business unit")
    r.add_argument("--rate", default="1.0", help="effective rate that multiplies list prices")
    r.add_argument("--source", default="catalog", help="'catalog' or 'parquet:<root>'")
    r.add_argument("--out", required=True, help="output folder (parquet) or database (table)")
    r.add_argument("--format", choices=("parquet", "table"), default="parquet")
    r.add_argument("--tables", nargs="*", help="only these result tables")
    return ap.parse_args(argv)


def refresh(spark, args: argparse.Namespace) -> list[str]:
    from jobmix.plans.dashboard import Dashboard
    from jobmix.plans.reports import DATASETS, Inputs
    from jobmix.functions.rules import ENV_RULES, load_rules
    from jobmix.sources import Tables

    if not args.rules and not args.bu_tag:
        raise SystemExit("no label rules: pass --rules FILE (or --bu-tag KEY); without them every workspace "
                         "would be Unmapped and the per-BU tables empty")
    rules = load_rules(args.rules) if args.rules else {"bu": (), "env": ENV_RULES}

    if args.source == "catalog":
        tables = Tables.from_catalog(spark)
    elif args.source.startswith("parquet:"):
        tables = Tables.from_parquet(spark, args.source.split(":", 1)[1])
    else:
        raise SystemExit(f"unknown source {args.source!r}")
    if problems := tables.check():
        raise SystemExit(f"input tables do not fit: {problems}")
    params = Params(TimeRange(args.start, args.end), bu=tuple(args.bu or ["All"]),
                    env=tuple(args.env or ["All"]))
    names = args.tables or list(DATASETS)
    unknown = set(names) - set(DATASETS)
    if unknown:
        raise SystemExit(f"unknown result tables: {sorted(unknown)}")
    written = []
    with Dashboard(Inputs(tables, rules["bu"], rules["env"], args.bu_tag, args.rate), params) as dash:
        for name in names:
            writer = dash.table(name).write.mode("overwrite")
            if args.format == "parquet":
                target = f"{args.out}/{name}"
                writer.parquet(target)
            else:
                target = f"{args.out}.{name}"
                writer.saveAsTable(target)
            written.append(target)
    return written


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    from jobmix.session import build_session
    spark = build_session()
    for target in refresh(spark, args):
        print(target)
    return 0
