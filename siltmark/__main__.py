"""``python -m siltmark [scan] [PATH]``: scans a repository and writes a report."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from siltmark.schemas import MAX_COMMITS, MIN_FILES


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["scan"]:
        argv = argv[1:]
    p = argparse.ArgumentParser(prog="siltmark", description="Measures the risk in a source repository.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output")
    p.add_argument("--json", action="store_true")
    p.add_argument("--offline", action="store_true")
    p.add_argument("--max-commits", type=int, default=MAX_COMMITS)
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--include-generated", action="store_true")
    p.add_argument("--fail-above", type=float)
    p.add_argument("--min-files", type=int, default=MIN_FILES)
    p.add_argument("--write-ignore-file", action="store_true", help="create the ignore file's template if there is none")
    a = p.parse_args(argv)
    from siltmark.plans import report as plan
    from siltmark.plans.session import local_session
    from siltmark.sinks import reports
    from siltmark.sources.files import ensure_ignore_file

    try:
        if not (Path(a.path) / ".git").exists():
            raise RuntimeError(f"{a.path} is not a git repository")
        if a.write_ignore_file:
            ensure_ignore_file(a.path)
        began = time.time()
        spark = local_session()
        options = plan.Options(a.path, 0, a.offline, a.max_commits, tuple(a.ignore), a.include_generated, a.min_files)
        inputs = plan.ingest(spark, options)
        scores = plan.score(inputs, options)
        row = plan.report(spark, inputs, scores, options, time.time() - began)
        out = a.output or ("siltmark-report.json" if a.json else "siltmark-report.html")
        (reports.write_json if a.json else reports.write_html)(row, out)
        total = plan.summary(scores).first()
        print(reports.terminal_text(total), f"Report:\n  {out}", sep="\n", file=sys.stderr)
        return reports.exit_code(total.repo_total_heat_score, a.fail_above)
    except Exception as e:  # the command's contract: any failure is exit code 2
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
