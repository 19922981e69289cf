"""Table schemas and the fixed values of the risk model."""

from __future__ import annotations

# Names, orders, weights and limits that results depend on.
DIMENSIONS = ("complexity", "duplication", "test", "change_risk", "dependency")
WEIGHTS = (0.30, 0.15, 0.25, 0.20, 0.10)
SEVERITIES = ("none", "low", "medium", "high", "critical")
LANGUAGES = ("rust", "javascript", "go")
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_COMMITS = 5000
MIN_FILES = 30
MIN_PERCENTILE_SAMPLE = 5
FORCED_IGNORES = ("target", "node_modules", "dist", "build", "*.generated.*")
COVERAGE_FILES = (
    "lcov.info",
    "coverage/lcov.info",
    "coverage/lcov-report/lcov.info",
    "coverage.xml",
    "coverage/coverage.xml",
    "cobertura.xml",
    "coverage/cobertura.xml",
    "target/coverage/lcov.info",
)
MISSING_PARSE = "语法解析失败"
MISSING_PARTIAL = "语法解析不完整"
MISSING_COVERAGE = "缺少覆盖率报告"
SCHEMA_VERSION, ANALYSIS_VERSION = "2.0", 2

SOURCE_FILES = "path string, language string, source string, size_bytes long"
IF_FIELDS = "if_total int, if_nested int, if_chained int, if_max_depth int"
FUNCTIONS = f"start_line int, end_line int, complexity int, {IF_FIELDS}, tokens string"
PARSED = f"path string, language string, source string, parsed boolean, parse_incomplete boolean, loc int, functions array<struct<{', '.join(f.replace(' ', ':', 1) for f in FUNCTIONS.split(', '))}>>"
COMMITS = "commit_id string, walk_pos int, commit_ts long, author_email string, message string"
FILE_CHANGES = "commit_id string, delta_pos int, old_path string, new_path string, status string, is_binary boolean"
HEAD_FILES = "path string"
DEPENDENCIES = "pos int, name string, version string, ecosystem string"
OSV_BATCH = "pos int, vulns array<struct<id:string,summary:string,database_specific:string>>"
OSV_DETAILS = "id string, summary string, aliases array<string>, database_specific string"
COVERAGE = "path string, pct double"
CONFIDENCE = "struct<type:string,detail:string>"
