"""Reports as JSON, HTML and terminal text, and the exit code of a scan."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltmark.functions.strings import dom_id, fixed, listed, risk_tier, thousands


def json_text(report: DataFrame) -> str:
    """The one-row report as indented JSON; ``detail`` is put in as JSON, not as a string."""
    data = json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    for f in [*data["files"], *data["top_risk_files"]]:
        for d in f["dimensions"]:
            d["detail"] = json.loads(d["detail"]) if d["detail"] else None
    return json.dumps(data, ensure_ascii=False, indent=2)


def write_json(report: DataFrame, path: str) -> None:
    with open(path, "w") as out:
        out.write(json_text(report))


def write_dataset(report: DataFrame, path: str) -> None:
    """The report to any store that Spark writes."""
    report.write.mode("overwrite").json(path)


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>Code risk: {repo}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left}}
.low{{color:#287a3e}}.medium{{color:#9a6b00}}.high{{color:#c2410c}}.critical{{color:#b91c1c}}</style></head>
<body><h1>{repo}</h1><p class="{tier}">Heat {heat} of 100 over {files} files and {loc} lines</p>
<h2>Files at risk</h2><table><tr><th>File</th><th>Heat</th><th>Lines</th><th>Left out</th></tr>{rows}</table>
<h2>Warnings</h2><ul>{notes}</ul><script type="application/json" id="report">{data}</script></body></html>
"""


def html_text(report: DataFrame) -> str:
    """A page with the top files and the whole report as embedded JSON."""
    row = report.select("repo_path", fixed(F.col("repo_total_heat_score")).alias("heat"), risk_tier(F.col("repo_total_heat_score")).alias("tier"), F.size("files").alias("n"), thousands(F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["raw"]["loc"])).alias("loc"), "warnings").first()
    top = report.select(F.explode("top_risk_files").alias("f")).select(
        F.col("f.raw.path").alias("path"), dom_id(F.col("f.raw.path")).alias("id"), fixed(F.col("f.final_heat_score")).alias("heat"),
        risk_tier(F.col("f.final_heat_score")).alias("tier"), thousands(F.col("f.raw.loc")).alias("loc"),
        listed(F.transform(F.filter("f.dimensions", lambda d: d["confidence"]["type"] == "not_applicable"), lambda d: d["dim"])).alias("out"),
    )
    rows = "".join(f'<tr id="{r.id}"><td>{html.escape(r.path)}</td><td class="{r.tier}">{r.heat}</td><td>{r.loc}</td><td>{r.out}</td></tr>' for r in top.collect())
    notes = "".join(f"<li>{html.escape(w)}</li>" for w in row.warnings)
    data = json_text(report).replace("</", "<\\/")
    return _PAGE.format(repo=html.escape(row.repo_path), tier=row.tier, heat=row.heat, files=row.n, loc=row.loc, rows=rows, notes=notes, data=data)


def write_html(report: DataFrame, path: str) -> None:
    with open(path, "w") as out:
        out.write(html_text(report))


def terminal_text(summary: Row) -> str:
    lines = [f"Files       {summary.file_count}", f"LOC         {summary.total_loc}"]
    for label, name in (("Complexity", "complexity"), ("Duplication", "duplication"), ("Test", "test"), ("ChangeRisk", "change_risk"), ("Dependency", "dependency")):
        lines.append(f"{label:<12}{summary[f'avg_{name}']:.1f}")
    return "\n".join([*lines, f"Repository heat score: {summary.repo_total_heat_score:.1f} / 100"])


def exit_code(heat: float, fail_above: float | None) -> int:
    """1 if the score is above the limit, else 0; errors are 2."""
    return int(fail_above is not None and heat > fail_above)
