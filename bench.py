"""Benchmark: run the contract queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs to completion through the ``noop`` sink (every row computed, nothing
collected to the driver). An untimed warm-up pass runs every query once on the
smallest sibling scale factor (``sf0.001`` next to ``$BENCH_SF_DIR``, else the bench
folder itself), so JVM start-up, JIT and code generation are not charged to the
measured queries; the warm-up time is reported separately. Shuffle bytes written per
query (a volume that grows with the data, unlike scheduling overhead) come from a
second, untimed pass with Spark's event log written to the scratch folder, so logging
never slows the timed pass. Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trustlens.plans.contract import queries  # noqa: E402
from trustlens.session import build_session  # noqa: E402

HEADLINE = (
    "daily_stats",
    "trust_score",
    "industry_benchmarks",
    "business_overview",
    "business_trends",
    "business_benchmark",
    "sentiment_distribution",
    "performance_deltas",
    "rating_trend_monthly",
    "geo_sentiment",
    "geo_insight",
    "list_businesses",
    "trust_band",
    "delta_direction",
    "geo_markers",
    "geo_extent",
    "benchmark_comparison",
    "kpi_cards",
    "key_checks",
)


def shuffle_bytes(event_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, from an uncompressed event log."""
    group_of_stage, written = {}, {}
    for path in glob.glob(os.path.join(event_dir, "*")):
        files = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else [path]
        for f in files:
            with open(f) as fh:
                for line in fh:
                    e = json.loads(line)
                    if e["Event"] == "SparkListenerJobStart":
                        group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                        for sid in e.get("Stage IDs", []):
                            group_of_stage[sid] = group
                    elif e["Event"] == "SparkListenerStageCompleted":
                        info = e["Stage Info"]
                        for acc in info.get("Accumulables", []):
                            if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                                written[info["Stage ID"]] = int(acc.get("Value", 0))
    out: dict[str, int] = {}
    for sid, n in written.items():
        group = group_of_stage.get(sid)
        if group:
            out[group] = out.get(group, 0) + n
    return out


def session(cpus: int, scratch: str, events: str | None = None):
    extra = {"spark.driver.memory": "8g", "spark.local.dir": scratch}
    if events:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": events, "spark.eventLog.compress": "false"})
    return build_session(
        f"local[{cpus}]",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        app="trustlens-bench",
        extra=extra,
    )


def run_all(spark, sf_dir: str, tag: bool = False) -> dict[str, float]:
    q = queries()
    times = {}
    for name in HEADLINE:
        if tag:
            spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="trustlens-bench-")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir

    # Timed pass: no event log, after an untimed warm-up pass.
    spark = session(cpus, scratch)
    t0 = time.perf_counter()
    run_all(spark, warm_dir)
    warmup = round(time.perf_counter() - t0, 3)
    times = run_all(spark, sf_dir)
    spark.stop()

    # Volume pass (untimed): shuffle bytes per query from the event log.
    shuffled = {}
    if os.environ.get("BENCH_SHUFFLE", "1") != "0":
        events = os.path.join(scratch, "events")
        os.makedirs(events)
        spark = session(cpus, scratch, events)
        run_all(spark, sf_dir, tag=True)
        spark.stop()
        shuffled = shuffle_bytes(events)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "warmup_sec": warmup,
                "warmup_dir": warm_dir,
                "shuffle_bytes": {name: shuffled.get(name, 0) for name in HEADLINE},
                "shuffle_mb_total": round(sum(shuffled.get(name, 0) for name in HEADLINE) / 2**20, 1),
            }
        )
    )


if __name__ == "__main__":
    main()
