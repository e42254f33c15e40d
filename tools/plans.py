"""Summarise the physical plan of every contract query as Spark plans it for large
inputs (no size-based broadcast of scanned tables; explicit, size-checked broadcasts
stay). Writes markdown to stdout."""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tools.inspect_plan import physical_plan  # noqa: E402
from trustlens.plans import contract  # noqa: E402
from trustlens.session import build_session  # noqa: E402


def short(text: str) -> str:
    return re.sub(r"#\d+L?", "", text)


def summary(df) -> dict:
    out = {"exchange": [], "join": [], "window": [], "scan": [], "broadcast": 0, "reused": 0}
    for n in physical_plan(df).walk():
        if n.name == "Exchange":
            m = re.search(r"Exchange (\w+(\([^)]*\))?)", n.text)
            out["exchange"].append(short(m.group(1)) if m else n.text[:40])
        elif n.name.endswith("Join"):
            m = re.match(r"(\w+) \[([^\]]*)\], \[([^\]]*)\], (\w+)", n.text)
            out["join"].append(f"{n.name} {short(m.group(4))} on {short(m.group(2))}" if m else n.name)
        elif n.name == "Window":
            part, order = ", ".join(n.meta["partitionSpec"]), ", ".join(n.meta["orderSpec"])
            out["window"].append(f"by [{part}] order [{order}]")
        elif n.name == "ReusedExchange":
            out["reused"] += 1
        elif n.name == "BroadcastExchange":
            out["broadcast"] += 1
        elif n.name.startswith("Scan"):
            src = re.search(r"/(\w+)\.parquet", n.text)
            pushed = re.search(r"\[(.*)\]", n.meta.get("PushedFilters", ""))
            name = src.group(1) if src else "materialised"
            filt = [f for f in (pushed.group(1).split(", ") if pushed else []) if f and not f.startswith("IsNotNull")]
            out["scan"].append(name + (f" ({', '.join(filt)})" if filt else ""))
    return out


def main(sf_dir: str) -> None:
    spark = build_session(
        "local[4]",
        4,
        extra={"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"},
    )
    sc = spark.sparkContext
    print("| query | jobs while building | scans (pushed filters) | exchanges (reused) | joins | windows | broadcasts |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in contract.SPARK_BUILDS:
        if name in contract.SERVICE_BUILDS:
            continue
        sc.setJobGroup(name, "building")
        df = contract.queries()[name](spark, sf_dir)
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        s = summary(df)
        s["exchange"].append(f"({s['reused']} reused)") if s["reused"] else None
        cells = [", ".join(s[k]) or "-" for k in ("scan", "exchange", "join", "window")]
        print(f"| {name} | {jobs} | " + " | ".join(cells) + f" | {s['broadcast']} |")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
