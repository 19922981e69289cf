"""Labels and style classes of report values, as column expressions over small tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltmark.functions.strings import confidence_tier, risk_tier
from siltmark.schemas import DIMENSIONS

# What a report shows for each state.
DIMENSION_LABELS = {"complexity": "复杂度", "duplication": "重复代码", "test": "测试", "change_risk": "变更风险", "dependency": "依赖"}
CONFIDENCE_LABELS = {"full": "数据完整", "data_missing": "数据缺失", "not_applicable": "不适用"}
CONFIDENCE_CLASSES = {"full": "color-green", "data_missing": "color-orange", "not_applicable": "color-muted"}
REWRITE_CLASSES = {"detected": "color-orange", "not_detected": "color-green", "unknown": "color-muted"}
SEVERITY_TEXTS = {"none": "None", "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}
SEVERITY_CLASSES = {"low": "score-low", "medium": "score-medium", "high": "score-high", "critical": "score-critical"}
SEVERITY_PILLS = {"none": "pill-muted", "low": "pill-low", "medium": "pill-medium", "high": "pill-high", "critical": "pill-critical"}

# What a report shows for tiers of scores, and of confidence.
RISK_LEVELS = {"low": "低风险", "medium": "中风险", "high": "高风险", "critical": "严重风险"}
SCORE_COLORS = {"low": "color-green", "medium": "color-yellow", "high": "color-orange", "critical": "color-red"}
RISK_TIERS = {"low": "tier-low", "medium": "tier-mid", "high": "tier-high", "critical": "tier-critical"}
HEAT_FILLS = {"low": "fill-green", "medium": "fill-yellow", "high": "fill-orange", "critical": "fill-red"}
CONFIDENCE_COLORS = {"high": "color-green", "medium": "color-yellow", "low": "color-orange"}
CONFIDENCE_PILLS = {"high": "pill-low", "medium": "pill-medium", "low": "pill-high"}


def labelled(value: Column, table: dict[str, str], other: str = "") -> Column:
    """The label of a value; ``other`` for values that the table lacks and for null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(other))


def dimension_label(name: Column) -> Column:
    return labelled(name, DIMENSION_LABELS, "未知")


def dimension_at(idx: Column) -> Column:
    """The label of the dimension at a place from 0."""
    return dimension_label(F.get(F.array(*map(F.lit, DIMENSIONS)), idx))


def confidence_label(confidence: Column) -> Column:
    return labelled(confidence["type"], CONFIDENCE_LABELS, "无数据")


def confidence_reason(confidence: Column) -> Column:
    return F.when(confidence["type"] == "data_missing", confidence["detail"]).otherwise("")


def confidence_class(confidence: Column) -> Column:
    return labelled(confidence["type"], CONFIDENCE_CLASSES, "color-orange")


def rewrite_class(state: Column) -> Column:
    return labelled(state, REWRITE_CLASSES, "color-muted")


def flag_class(flag: Column) -> Column:
    return F.when(flag, "color-orange").otherwise("color-green")


def final_stage_class(score: Column) -> Column:
    return F.when(score < 60, "stage-yellow").otherwise("stage-red")


def tier_class(score: Column, prefix: str = "score") -> Column:
    """The style of a score by its tier, such as ``score-low`` or ``pill-high``."""
    return F.concat(F.lit(f"{prefix}-"), risk_tier(score))


def by_score(score: Column, table: dict[str, str]) -> Column:
    """The label of a score's tier; a missing score counts as 0."""
    return labelled(risk_tier(F.coalesce(score, F.lit(0.0))), table)


def by_confidence(coefficient: Column, table: dict[str, str]) -> Column:
    """The label of the tier of a confidence from 0 to 1; a missing one counts as 0."""
    return labelled(confidence_tier(F.coalesce(coefficient, F.lit(0.0))), table)


def dimension_risk(dimensions: Column, idx: int) -> Column:
    """The score of a file's dimension at a place from 0, 0 beyond the last."""
    return F.coalesce(F.get(dimensions, F.lit(idx))["risk_score"], F.lit(0.0))


def excluded_labels(dimensions: Column) -> Column:
    """Labels of the dimensions (dim, confidence) that don't apply, in their order."""
    out = F.filter(dimensions, lambda d: d["confidence"]["type"] == "not_applicable")
    return F.array_join(F.transform(out, lambda d: dimension_label(d["dim"])), "、")


def affects(affected_files: Column, path: Column) -> Column:
    return F.coalesce(F.array_contains(affected_files, path), F.lit(False))


def mean_or_zero(values: Column) -> Column:
    """The mean of an array, 0 if it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0))


def cut(text: Column, most: int) -> Column:
    """The first ``most`` characters, without a mark of the cut."""
    return F.substring(text, 1, most)
