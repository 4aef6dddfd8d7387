"""Library of projects: summaries, dashboards, upserts, backups and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def storage_error(name: Column) -> Column:
    """Class of a storage failure: no space left, storage blocked, or something else."""
    return F.when(name == "QuotaExceededError", "full").when(name.isin("InvalidStateError", "SecurityError", "UnknownError"), "blocked").otherwise("other")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same keys; the rest of `old` stays."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def next_version(versions: DataFrame, project: str, version: str) -> DataFrame:
    """(project, version) of the next reconstruction: one more than the highest, 1 for the first."""
    return versions.groupBy(project).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias(version))


def newest(log: DataFrame, n: int, at: str, *ties: str) -> DataFrame:
    """The n newest rows of a log; a top-n, so no partition holds the whole log."""
    return log.orderBy(F.desc(at), *(F.desc(t) for t in ties)).limit(n)


def count_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, place): counts in falling order, ties as first seen."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def dashboard(projects: DataFrame, objects: DataFrame, texts: DataFrame, hues: DataFrame, fonts: int = 6, families: int = 8) -> DataFrame:
    """(metric, key, value, sample): totals, counts by type and kind, the commonest fonts and hues with their first swatch."""
    from ..functions.numeric import half_up

    row = lambda metric, key, value, sample=F.lit(""): (F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"), sample.alias("sample"))
    n = F.count(F.lit(1))
    totals = projects.agg(n.alias("n"), half_up(F.avg("dna")).alias("dna"))
    out = totals.select(*row("projects", F.lit(""), F.col("n"))).unionAll(totals.select(*row("avg_dna", F.lit(""), F.col("dna"))))
    for metric, table, key in (("type", projects, "design_type"), ("kind", objects, "kind")):
        out = out.unionAll(table.groupBy(key).agg(n.alias("n")).select(*row(metric, F.col(key), F.col("n"))))
    top = texts.groupBy("family").agg(n.alias("n"), F.min("seq").alias("seq")).orderBy(F.desc("n"), "seq").limit(fonts)
    out = out.unionAll(top.select(*row("font", F.col("family"), F.col("n"))))
    hue = hues.groupBy("family").agg(n.alias("n"), F.min("seq").alias("seq"), F.min_by("hex", "seq").alias("hex")).orderBy(F.desc("n"), "seq").limit(families)
    return out.unionAll(hue.select(*row("hue", F.col("family"), F.col("n"), F.col("hex"))))


def browse(projects: DataFrame, text: str = "", or_type: str = "", starred: bool = False, sort: str = "recent") -> DataFrame:
    """The library page: starred ones or all, a text in the name or a type, sorted by recent, name or dna; `place` counts from 1."""
    out = projects.where("starred") if starred else projects
    if text or or_type:
        out = out.where(F.lower("name").contains(text.lower()) | F.lower("design_type").contains((or_type or text).lower()))
    lead, order = {"recent": ("updated_at", F.desc_nulls_last("updated_at")), "name": ("name", F.asc("name")), "dna": ("dna", F.desc("dna"))}[sort]
    return placed(out, order, lead, F.col("id"))


def placed(rows: DataFrame, order: Column, lead: str, *rest: Column) -> DataFrame:
    """The rows with their `place` (from 1) in the order of the column `lead`, then `rest`.

    A place is the number of rows with an earlier lead value, plus one among those of the same. Only
    the counts per lead value (dates, scores, names) are ordered in one task, not the rows.
    """
    counts = rows.groupBy(lead).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(lead).alias("_lead"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(lead).orderBy(*rest))
    return rows.withColumn("_own", own).join(counts, F.col(lead).eqNullSafe(F.col("_lead"))).withColumn("place", (F.col("_before") + F.col("_own")).cast("int")).drop("_lead", "_before", "_own")


def redact(rows: DataFrame, column: str) -> DataFrame:
    """Inline images replaced by their size, as the read model keeps them."""
    from ..functions.numeric import half_up

    c = F.col(column)
    return rows.withColumn(column, F.when(c.startswith("data:"), F.concat(F.lit("[inline:"), half_up(F.length(c) / 1024).cast("string"), F.lit("KB]"))).otherwise(c))


def pack(scenes: DataFrame, active: Column, column: str) -> DataFrame:
    """The active scene's copy is stored once, with the project; here it becomes null (`packed`)."""
    return scenes.withColumn("packed", F.when(~active, F.col(column)))


def unpack(packed: DataFrame, active: DataFrame, keys: list[str], column: str, from_: str) -> DataFrame:
    return packed.drop(column).join(active, keys, "left").withColumn(column, F.coalesce("packed", from_))


def asset_rows(objects: DataFrame) -> DataFrame:
    """Objects as rows of the asset table: people and faces are PERSON, unknown kinds OBJECT."""
    kinds = ["person", "product", "logo", "icon", "vehicle", "building", "object"]
    kind = F.when(F.col("kind").isin("person", "face"), "PERSON").when(F.col("kind").isin(kinds), F.upper("kind")).otherwise("OBJECT")
    return objects.withColumn("asset_kind", kind)


FORMATS, VERSION = ("design-backup", "design-library"), 1


def backup(projects: DataFrame, at: str, version: int = VERSION) -> DataFrame:
    """One JSON line per project: format, version, exportedAt, project. Written as a text file, it is the backup."""
    return projects.select(F.to_json(F.struct(F.lit(FORMATS[0]).alias("format"), F.lit(version).alias("version"), F.lit(at).alias("exportedAt"), F.struct("*").alias("project"))).alias("line"))


def restore(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored, skipped): lines of a known format and version whose project has an id, and the others."""
    x = lines.withColumn("j", F.from_json("line", "format string, version int, exportedAt string, project string"))
    good = F.coalesce(F.col("j.format").isin(*FORMATS) & (F.col("j.version") <= VERSION) & F.get_json_object("j.project", "$.id").isNotNull(), F.lit(False))
    return x.where(good).select(F.col("j.version").alias("version"), F.col("j.project").alias("project")), x.where(~good).select("line")
