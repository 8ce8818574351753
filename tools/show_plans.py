"""Write docs/PLANS.md: the physical plan of every result table.

Usage: python tools/show_plans.py [sf_dir] [out.md]

For each table: the plan tree, the scans (pushed filters, partition filters,
read schema) and the number of exchanges.  The two tables whose joins change
shape with size (kpi_headline, job_table) are shown again with broadcasts
forbidden, i.e. the shuffle-join path large inputs take.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def summarize(text: str) -> str:
    tree = text.split("\n\n")[0].replace("== Physical Plan ==\n", "")
    scans = re.findall(r"\(\d+\) Scan parquet.*?\n(?:.*\n)*?ReadSchema: [^\n]*", text)
    lines = []
    for s in scans:
        keep = [x for x in s.split("\n") if x.startswith(("(", "Location", "PushedFilters",
                                                          "PartitionFilters", "ReadSchema"))]
        lines.append("\n".join(keep))
    shuffles = len(re.findall(r"(?<!Broadcast)Exchange \(", tree))
    broadcasts = len(re.findall(r"BroadcastExchange \(", tree))
    return (f"```\n{tree}\n```\n\nshuffle exchanges: {shuffles}, "
            f"broadcasts: {broadcasts}\n\n```\n" + "\n\n".join(lines) + "\n```\n")


def main(argv) -> None:
    from jobmix.plans import registry, reports
    from jobmix.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else os.path.join(ROOT, "docs", "PLANS.md")
    spark = build_session("local[8]", 16)
    inp = registry.inputs(spark, sf_dir)
    p = registry.DEFAULT
    parts = [f"# Physical plans\n\nGenerated by `tools/show_plans.py` on `{sf_dir}` "
             f"(inputs derived from the test tables, date range {p.time_range.min} .. "
             f"{p.time_range.max}, no BU / env filter).\n"]
    for name, fn in reports.DATASETS.items():
        parts.append(f"\n## {name}\n\n" + summarize(formatted(fn(inp, p))))
    spark.conf.set("jobmix.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("kpi_headline", "job_table"):
        parts.append(f"\n## {name}, broadcasts forbidden (shuffle-join path)\n\n"
                     + summarize(formatted(reports.DATASETS[name](inp, p))))
    os.makedirs(os.path.dirname(out), exist_ok=True)
    with open(out, "w") as f:
        f.write("".join(parts))
    print(out)


if __name__ == "__main__":
    main(sys.argv)
