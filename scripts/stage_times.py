"""Slowest stages and per-job totals from a Spark event log.

Usage: python scripts/stage_times.py <event-log-file-or-folder> [top]
(write one with BENCH_EVENT_LOG=<dir> python bench.py ...)
"""

from __future__ import annotations

import io
import json
import os
import re
import sys


def _lines(path):
    """Event lines from a log file or a rolling event-log folder (.zstd ok)."""
    if os.path.isdir(path):
        files = [f for f in os.listdir(path) if f.startswith("events_")]
        files.sort(key=lambda f: int(re.match(r"events_(\d+)_", f).group(1)))
        paths = [os.path.join(path, f) for f in files]
    else:
        paths = [path]
    for p in paths:
        if p.endswith(".zstd"):
            import zstandard

            with open(p, "rb") as fh:
                reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(p) as fh:
                yield from fh


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages, tasks = {}, {}
    if True:
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                sub, done = info.get("Submission Time"), info.get("Completion Time")
                if sub and done:
                    rdds = ",".join(sorted({r.get("Name", "") for r in info.get("RDD Info", [])
                                            if r.get("Name") and "MapPartitions" not in r["Name"]}))
                    stages[info["Stage ID"]] = (done - sub, rdds or info["Stage Name"],
                                                info["Number of Tasks"])
            elif kind == "SparkListenerTaskEnd":
                sid = ev["Stage ID"]
                ti = ev["Task Info"]
                tasks.setdefault(sid, []).append(ti["Finish Time"] - ti["Launch Time"])
    total = sum(d for d, _, _ in stages.values())
    print(f"{len(stages)} stages, {total / 1000:.1f}s summed stage wall time")
    print("stage  wall_ms  tasks  median_task_ms  max_task_ms  name   (max >> median = skew)")
    for sid, (d, name, n) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        ts = sorted(tasks.get(sid, [0]))
        print(f"{sid:5d} {d:8d} {n:6d} {ts[len(ts) // 2]:15d} {ts[-1]:12d}  {name[:80]}")


if __name__ == "__main__":
    main()
