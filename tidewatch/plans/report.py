"""A scan's result as JSON and as Markdown."""
from __future__ import annotations

import json

from ..functions.text import cell, code
from .scan import Result

TOOL, VERSION = "tidewatch", "0.2"
HEADINGS = (("failure", "Failures"), ("missed", "Missed runs"), ("overlap", "Overlapping runs"))


def _iso(t):
    return t.isoformat() if t else None


def _finding(f) -> dict:
    return {"kind": f.kind, "severity": f.severity, "job_id": f.id, "source": f.source, "message": f.message, "when": _iso(f.when), "details": json.loads(f.details)}


def _run(r) -> dict:
    return {"start": _iso(r.start), "end": _iso(r.end), "duration_seconds": (r.end - r.start).total_seconds() if r.end else None, "pid": r.pid, "exit_code": r.exit_code, "result": r.result}


def as_dict(r: Result) -> dict:
    counts = r.counts
    return {
        "tool": TOOL, "version": VERSION, "generated_at": _iso(r.now),
        "window": {"start": _iso(r.start), "end": _iso(r.end), "tolerance_seconds": r.tolerance},
        "summary": {"jobs": len(r.jobs), "runs": sum(len(j.runs) for j in r.jobs), **counts, "problems": len(r.findings), "warnings": len(r.warnings),
                    "diagnostics": len(r.diagnostics), "log_lines_total": r.lines, "log_lines_parsed": r.understood},
        "sources": r.sources,
        "jobs": [{"id": j.id, "source": j.source, "schedule": j.schedule, "schedules": j.schedules, "origin": j.origin, "user": j.user, "command": j.command, "unit": j.unit, "timer": j.timer,
                  "schedule_understood": j.schedule_ok, "expected_runs": j.expected, "observed_runs": [_run(x) for x in j.runs], "findings": [_finding(f) for f in j.findings]} for j in r.jobs],
        "findings": [_finding(f) for f in r.findings],
        "warnings": [{"code": w.code, "message": w.message, "usage_error": w.usage_error} for w in r.warnings],
        "diagnostics": [{"job_id": d.job_id, "message": d.message, "origin": d.origin} for d in r.diagnostics],
    }


def to_json(r: Result) -> str:
    return json.dumps(as_dict(r), indent=2)


def _table(head: list[str], rows: list[list], right: int) -> list[str]:
    """Rows of a table whose last columns, right of them, are numbers."""
    rule = ["---"] * (len(head) - right) + ["---:"] * right
    return ["| " + " | ".join(map(str, x)) + " |" for x in (head, rule, *rows)] + [""]


def to_markdown(r: Result) -> str:
    n = r.counts
    out = [f"# {TOOL} report", "", f"Window `{r.start}` → `{r.end}` (tolerance {int(r.tolerance)}s), generated {r.now}.", ""]
    out += _table(["Jobs", "Runs", "Missed", "Overlaps", "Failures"], [[len(r.jobs), sum(len(j.runs) for j in r.jobs), n["missed"], n["overlap"], n["failure"]]], 5)
    out += [f"Log lines read {r.lines}, understood {r.understood}.", ""]

    def section(title, items):
        return [f"## {title} ({len(items)})", "", *[f"- {x}" for x in items], ""] if items else []

    out += section("Warnings", [f"{code(w.code)} — {w.message}" for w in r.warnings])
    if not r.findings:
        out += ["No job problems found, but the scan is not conclusive." if r.warnings else "No problems found.", ""]
    for kind, title in HEADINGS:
        out += section(title, [f"{code(f.id)} — {f.message}" for f in r.findings if f.kind == kind])
    rows = [[cell(code(j.id)), j.source, cell(code(j.schedule + ("" if j.schedule_ok else " (?)"))), j.expected, len(j.runs), len(j.findings)] for j in sorted(r.jobs, key=lambda j: j.id)]
    out += ["## Jobs", "", *_table(["Job", "Source", "Schedule", "Expected", "Observed", "Problems"], rows, 3)]
    out += section("Diagnostics", [(f"{code(d.job_id)}: " if d.job_id else "") + d.message for d in r.diagnostics])
    return "\n".join(out).rstrip() + "\n"
