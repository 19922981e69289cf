"""Score formulas of the risk model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltmark.schemas import SEVERITIES


def clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def cvss_severity(score: Column) -> Column:
    """The severity of a CVSS score; a missing score counts as medium."""
    return F.when(score.isNull(), "medium").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def complexity_raw(cyclomatic: Column, depth: Column, mean_length: Column) -> Column:
    return clamped(cyclomatic * F.lit(0.4) + depth * F.lit(15.0) * F.lit(0.4) + mean_length * F.lit(0.2))


def complexity_bands(cyclomatic: Column, depth: Column) -> Column:
    """Fixed bands of cyclomatic complexity and of nesting depth, 7 to 3."""
    cc = F.when(cyclomatic < 10, 15.0).when(cyclomatic < 20, 50.0).when(cyclomatic < 50, 80.0).otherwise(100.0)
    nesting = F.when(depth <= 4, 15.0).when(depth <= 7, 50.0).when(depth <= 10, 80.0).otherwise(100.0)
    return cc * F.lit(0.7) + nesting * F.lit(0.3)


def complexity_risk(percentile: Column, bands: Column) -> Column:
    return F.coalesce(F.lit(0.5) * percentile + F.lit(0.5) * bands, bands)


def duplication_risk(lines: Column, loc: Column) -> Column:
    return F.when((lines > 0) & (loc > 0), F.least(F.lit(100.0), lines / loc * F.lit(150.0))).otherwise(F.lit(0.0))


def decay(age_seconds: Column) -> Column:
    """Half a weight every six months of 30.44 days; the future counts as now."""
    months = F.greatest(F.lit(0.0), age_seconds.cast("double")) / F.lit(86400.0 * 30.44)
    return F.pow(F.lit(0.5), months / F.lit(6.0))


def change_risk(density: Column, recent: Column, authors: Column) -> Column:
    often = F.least(F.lit(100.0), recent / F.lit(90.0) * F.lit(100.0))
    many = F.least(F.lit(100.0), authors * F.lit(10.0))
    return clamped(density * F.lit(100.0) * F.lit(0.6) + often * F.lit(0.2) + many * F.lit(0.2))


def test_risk(coverage_gap: Column, test_loc: Column, impl_loc: Column, asserts: Column) -> Column:
    density = F.lit(100.0) - F.least(F.lit(100.0), test_loc / F.greatest(impl_loc, F.lit(1)) * F.lit(100.0))
    checking = F.lit(100.0) - F.least(F.lit(100.0), asserts / F.greatest(test_loc, F.lit(1)) * F.lit(20.0))
    shell = F.when((asserts == 0) & (test_loc > 0), F.lit(15.0)).otherwise(F.lit(0.0))
    return clamped(coverage_gap * F.lit(0.40) + density * F.lit(0.25) + checking * F.lit(0.35) + shell)


def dependency_risk(max_rank: Column, findings: Column) -> Column:
    count = F.when(findings == 0, 0.0).when(findings == 1, 60.0).when(findings <= 4, 80.0).otherwise(100.0)
    return clamped(max_rank * F.lit(25.0) * F.lit(0.6) + count * F.lit(0.25))


def consistency(stale_coverage: Column, rewritten: Column, lock_mismatch: Column) -> Column:
    x = F.when(rewritten, 0.7).otherwise(1.0) * F.when(stale_coverage, 0.85).otherwise(1.0) * F.when(lock_mismatch, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.5), x)


def trend(mean: Column, last: Column) -> Column:
    """From the mean and the last of earlier scores; 1 without any."""
    delta = clamped((mean - last) / F.greatest(mean, F.lit(1.0)), -0.3, 0.3)
    return F.coalesce(clamped(F.lit(1.0) - delta * F.lit(0.3), 0.91, 1.09), F.lit(1.0))


def final_heat(base: Column, trend_coefficient: Column) -> Column:
    return clamped(base * trend_coefficient)


# CVSS v3 metric weights, and the weight of an unknown value.
CVSS_METRICS = {
    "AV": ({"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}, 0.5),
    "AC": ({"L": 0.77, "H": 0.44}, 0.5),
    "PR": ({"N": 0.85, "L": 0.62, "H": 0.27}, 0.5),
    "UI": ({"N": 0.85, "R": 0.62}, 0.5),
    "C": ({"H": 0.56, "L": 0.22, "N": 0.0}, 0.2),
    "I": ({"H": 0.56, "L": 0.22, "N": 0.0}, 0.2),
    "A": ({"H": 0.56, "L": 0.22, "N": 0.0}, 0.2),
}


def cvss_v3(vector: Column) -> Column:
    """The base score of a CVSS v3 vector, rounded to a tenth.

    A missing metric weighs 0, an unknown value of one its default; the last of repeated
    metrics counts; privileges weigh the same whatever the scope.
    """
    keys = [*CVSS_METRICS, "S"]

    def value(parts: Column, key: str) -> Column:
        own = F.filter(parts, lambda p: p.startswith(f"{key}:"))
        return F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1000)

    def weight(values: Column, key: str) -> Column:
        table, other = CVSS_METRICS[key]
        out = F.when(values[key].isNull(), F.lit(0.0))
        for name, w in table.items():
            out = out.when(values[key] == name, F.lit(w))
        return out.otherwise(F.lit(other))

    def terms(values: Column) -> Column:
        iss = F.lit(1.0) - (F.lit(1.0) - weight(values, "C")) * (F.lit(1.0) - weight(values, "I")) * (F.lit(1.0) - weight(values, "A"))
        exploit = F.lit(8.22) * weight(values, "AV") * weight(values, "AC") * weight(values, "PR") * weight(values, "UI")
        return F.struct(F.coalesce(values["S"] == "C", F.lit(False)).alias("changed"), iss.alias("iss"), exploit.alias("exploit"))

    def score(t: Column) -> Column:
        impact = F.when(t["changed"], F.lit(7.52) * (t["iss"] - F.lit(0.029)) - F.lit(3.25) * F.pow(t["iss"] - F.lit(0.02), F.lit(15.0))).otherwise(F.lit(6.42) * t["iss"])
        base = F.when(t["changed"], F.lit(1.25) * (impact + t["exploit"]) - F.lit(0.7)).otherwise(impact + t["exploit"])
        return F.round(F.when(impact <= 0, F.lit(0.0)).otherwise(F.least(F.lit(10.0), base)) * 10) / 10

    # Each step is a transform of one item, so that what it takes up many times is computed once a row.
    held = F.array(F.transform(F.split(vector, "/"), F.trim))
    for step in (lambda parts: F.struct(*[value(parts, k).alias(k) for k in keys]), terms, score):
        held = F.transform(held, step)
    return F.when(vector.isNotNull(), held[0])


def cvss_score(database_specific: Column) -> Column:
    """A score from JSON: ``score``, then ``cvss`` as a number, in brackets at the end of its text, or as a v3 vector."""
    json = F.try_parse_json(database_specific)
    number = F.when(F.schema_of_variant(F.try_variant_get(json, "$.score", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(json, "$.score", "double"))
    cvss = F.try_variant_get(json, "$.cvss", "variant")
    kind = F.schema_of_variant(cvss)
    plain = F.when(kind != "STRING", F.try_variant_get(cvss, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(cvss, "$", "string"))
    bracket = F.trim(F.regexp_extract(text, r"\(([^()]*)\)[^()]*$", 1)).try_cast("double")
    vector = F.when(text.startswith("CVSS:3"), cvss_v3(text))
    return F.coalesce(number, plain, bracket, vector)


def detail_severity(database_specific: Column) -> Column:
    """The severity that advisory details give: by CVSS score, else by name; null if neither."""
    score = cvss_score(database_specific)
    name = F.lower(F.get_json_object(database_specific, "$.severity"))
    return F.when(score.isNotNull(), cvss_severity(score)).when(name.isin(*SEVERITIES[1:]), name)
