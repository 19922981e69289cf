"""Layered ignore rules over any number of paths: the last rule that matches an entry or a folder above it decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = r"\\.|\*\*/|\*\*|\*|\?|\[[^\]]+\]|[^\\*?\[]+|."


def _regex(body: Column, anchored: Column) -> Column:
    """A pattern without its slashes at both ends as a regular expression over an entry's path below the rule's folder."""

    def token(t: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), t, F.lit("\\E"))
        one = F.concat(F.lit("["), F.regexp_replace(F.substring(t, 2, 1 << 20), "^!", "^"))
        out = F.when(t == "**/", "(?:.*/)?").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]")
        return out.when(t.startswith("[") & (F.length(t) > 2), one).when(t.startswith("\\"), F.concat(F.lit("\\Q"), F.substring(t, 2, 1), F.lit("\\E"))).otherwise(quoted)

    parts = F.transform(F.regexp_extract_all(body, F.lit(_TOKENS), F.lit(0)), token)
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), F.array_join(parts, ""), F.lit("$"))


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, at, keeps, folders_only, regex) from ignore files (folder, layer, content).

    A folder is empty or ends with a slash; its rules hold for what is below it. Where rules of one folder come from several files, those of
    a higher ``layer`` come later: a user's global excludes and the rules of a repository have the root as their
    folder and lower layers. Blank lines, comments and null contents give no rules; ``!`` keeps what earlier rules
    left out, a slash at the end means folders alone, and one elsewhere ties the pattern to its folder.
    """
    lines = files.select("folder", "layer", F.posexplode(F.split("content", "\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    lines = lines.where("line <> '' and not startswith(line, '#')")
    keeps = F.col("line").startswith("!")
    pattern = F.when(keeps, F.substring("line", 2, 1 << 20)).otherwise(F.regexp_replace("line", r"^\\(?=[#!])", ""))
    bare = F.regexp_replace(pattern, "/+$", "")
    rows = lines.select("folder", F.struct(F.length(F.regexp_replace("folder", "[^/]", "")).alias("depth"), "layer", "n").alias("at"), keeps.alias("keeps"), pattern.endswith("/").alias("folders_only"), bare.alias("bare"))
    return rows.where("bare <> ''").select("folder", "at", "keeps", "folders_only", _regex(F.regexp_replace("bare", "^/+", ""), F.col("bare").contains("/")).alias("regex"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) for each different path of files.

    Each folder above a path, and the path itself, is an entry. Of the rules of the folders above an
    entry the last one that matches it decides, deeper folders being later; what lies below an ignored folder
    can't be kept. An entry meets a row a folder above it, which holds that folder's rules; entries
    are judged once, however many paths they lead to.
    """
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size("parts"))
    leads = paths.select("path").where("path is not null").distinct().withColumn("parts", parts)
    leads = leads.select("path", F.explode(F.transform(depths, lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), "/").alias("entry"), (i < F.size("parts")).alias("is_folder")))).alias("e")).select("path", "e.*")
    entries = leads.select("entry", "is_folder").distinct().withColumn("parts", F.split("entry", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.concat(F.array_join(F.slice("parts", F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    near = entries.select("entry", "is_folder", F.explode(above).alias("folder"))
    held = rules.groupBy(F.col("folder").alias("r_folder")).agg(F.array_sort(F.collect_list(F.struct("at", "keeps", "folders_only", "regex"))).alias("rules"))
    met = near.join(held, F.col("folder") == F.col("r_folder"))
    rest = F.expr("substring(entry, length(folder) + 1)")
    hit = F.filter("rules", lambda r: (F.col("is_folder") | ~r["folders_only"]) & F.regexp_like(rest, r["regex"]))
    last = F.try_element_at(hit, F.lit(-1))
    judged = met.select("entry", "is_folder", last.alias("last")).where("last is not null").groupBy("entry", "is_folder").agg(F.max_by("last.keeps", "last.at").alias("keeps"))
    gone = leads.join(judged.where("not keeps"), ["entry", "is_folder"]).select("path").distinct().withColumn("gone", F.lit(True))
    return paths.select("path").where("path is not null").distinct().join(gone, "path", "left").select("path", F.coalesce("gone", F.lit(False)).alias("ignored"))
