"""Change proposals and their lifecycle: pending, approved or rejected, applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import reference_parts, slug

MOVES = {"approve": ("pending", "approved"), "reject": ("pending", "rejected"), "mark_applied": ("approved", "applied")}


def _proposal(df: DataFrame, kind: str, title: Column, refs: Column, changes: Column) -> DataFrame:
    key = F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), F.lit("-"), F.left(F.replace(F.uuid(), F.lit("-")), F.lit(6)))
    cols = df.select(key.alias("proposal_id"), F.lit(kind).alias("category"), F.lit("pending").alias("status"), title.alias("title"), refs.alias("refs"), changes.alias("changes"), F.current_timestamp().alias("created"), F.lit(None).cast("string").alias("note"))
    return cols.withColumn("name", slug(F.col("proposal_id"), F.col("title")))


def create_modify(before: DataFrame, after: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """One proposal for each id whose fields differ, with the differing (field, old, new) as strings; nulls are values."""
    b = after.select(F.col("id"), F.struct(*fields).alias("new"))
    both = before.select(F.col("id"), F.struct(*fields).alias("old")).join(b, "id")
    one = [F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").cast("string").alias("old"), F.col(f"new.{f}").cast("string").alias("new"))) for f in fields]
    changed = both.withColumn("_c", F.filter(F.array(*one), lambda x: x.isNotNull())).where(F.size("_c") > 0)
    return _proposal(changed, "modify", F.concat(F.lit(f"Modify {kind} "), F.col("id").cast("string")), F.array(F.concat(F.lit(f"{kind}/"), F.col("id").cast("string"))), F.col("_c"))


def create_merge(pairs: DataFrame) -> DataFrame:
    """One proposal for each pair(source, target) of type/id references; two types in a pair are an error."""
    s, t = reference_parts(F.col("source")), reference_parts(F.col("target"))
    same = F.when(s["type"] == t["type"], s["type"]).otherwise(F.raise_error(F.lit("a merge needs two entities of one type")).cast("string"))
    return _proposal(pairs, "merge", F.concat(F.lit("Merge "), same, F.lit(" "), s["id"], F.lit(" into "), t["id"]), F.array("source", "target"), F.array(F.struct(F.lit("merge").alias("field"), F.col("source").alias("old"), F.col("target").alias("new"))))


def create_delete(refs: DataFrame) -> DataFrame:
    p = reference_parts(F.col("ref"))
    return _proposal(refs, "delete", F.concat(F.lit("Delete "), p["type"], F.lit(" "), p["id"]), F.array("ref"), F.array(F.struct(F.lit("delete").alias("field"), F.col("ref").alias("old"), F.lit(None).cast("string").alias("new"))))


def move(proposals: DataFrame, ids: DataFrame, action: str, note: str | None = None) -> DataFrame:
    """proposals after approve, reject or mark_applied of ids(proposal_id); an unknown id or another status is an error."""
    old, new = MOVES[action]
    wanted = ids.select("proposal_id").distinct()
    wrong = wanted.join(proposals.where(F.col("status") == old), "proposal_id", "left_anti").limit(5).collect()
    if wrong:
        raise LookupError(f"not {old}: " + ", ".join(r.proposal_id for r in wrong))
    hit = F.col("_hit").isNotNull()
    joined = proposals.join(wanted.withColumn("_hit", F.lit(True)), "proposal_id", "left")
    return joined.withColumn("status", F.when(hit, new).otherwise(F.col("status"))).withColumn("note", F.when(hit & F.lit(note is not None), F.lit(note)).otherwise(F.col("note"))).drop("_hit").select(proposals.columns)


def listed(proposals: DataFrame, status: str) -> DataFrame:
    return proposals.where(F.col("status") == status).orderBy("proposal_id")


def as_json(proposals: DataFrame) -> DataFrame:
    """(proposal_id, json) without empty optional fields."""
    return proposals.select("proposal_id", F.to_json(F.struct(*proposals.columns), {"ignoreNullFields": "true"}).alias("json"))
