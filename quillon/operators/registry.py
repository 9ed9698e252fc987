"""Keyed registries over cycles in batch form: fingerprints, suspicion, compliance, changes, recent events."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RECENT = 64
# Fields that a manifest must have to be transparent.
REQUIRED = ("open_source", "repo_url", "repo_commit", "model_name", "model_version", "training_data_statement", "private_data_attestation")


# Texts that mean yes.
YES = ("1", "true", "yes", "y", "on")


def _rewritten(text: pd.Series, change: Callable = lambda v: v, separators: tuple[str, str] = (",", ":")) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(change(json.loads(t)), sort_keys=True, separators=separators)
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces, ASCII; null where it can't be read."""
    return _rewritten(text)


@F.pandas_udf(StringType())
def spaced_json(text: pd.Series) -> pd.Series:
    """As canonical_json, with a space after commas and colons."""
    return _rewritten(text, separators=(", ", ": "))


@F.pandas_udf(StringType())
def plain_manifest(text: pd.Series) -> pd.Series:
    """A manifest in canonical JSON: texts trimmed, nulls, blanks and empty lists gone, list items as text, open_source true or false."""

    def trimmed(v: object) -> object:
        if v is None or isinstance(v, bool | int | float):
            return v
        if isinstance(v, list):
            return [s for s in (str(x).strip() for x in v if x is not None) if s]
        return str(v).strip()

    def change(m: dict) -> dict:
        out = {k: t for k, t in ((k, trimmed(v)) for k, v in (m or {}).items()) if t is not None and t != "" and t != []}
        if m and "open_source" in m:
            out["open_source"] = m["open_source"] if isinstance(m["open_source"], bool) else str(m["open_source"]).strip().lower() in YES
        return out

    return _rewritten(text, change)


def fingerprint(json_text: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(json_text), 256)


def content_hash(json_text: Column) -> Column:
    """MD5 by which equal chunks are told: of their JSON with sorted keys."""
    return F.md5(spaced_json(json_text).cast("binary"))


def manifest_digest(json_text: Column) -> Column:
    """SHA-256 of a manifest in its plain form: manifests that differ in blanks and nulls only have one digest."""
    return F.sha2(plain_manifest(json_text), 256)


def served(events: DataFrame, key: str, at: str) -> DataFrame:
    """key, first_seen, last_seen, times_served, repeats: of all serves of each key, those of one batch included."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_served"), (F.count("*") - 1).alias("repeats"))


def merge_served(registry: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A registry with a later one folded in."""
    both = registry.unionByName(batch)
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_served").alias("times_served"), (F.sum("times_served") - 1).alias("repeats"))


def reason_counts(events: DataFrame, uid: str, reasons: str) -> DataFrame:
    """uid, reason, n."""
    return events.select(uid, F.explode(reasons).alias("reason")).groupBy(uid, "reason").agg(F.count("*").alias("n"))


def recent(events: DataFrame, by: list[str], order: str, n: int = RECENT) -> DataFrame:
    """The last n events of each group, `age` 1 for the newest."""
    return events.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("age") <= n)


def compliance(manifests: DataFrame, uid: str, at: str, standard_repo: str | None = None, standard_model: str | None = None) -> DataFrame:
    """manifests with missing (required fields without a value), violations, status, and status_changed against the one before of the uid.

    open_source is missing unless it says yes; implementation_files (an array)
    needs an item, implementation_sha256 a value. A commit that is not 7 to 40
    lower-case hex digits, a missing one included, is a violation, and so is the
    standard model's repository under another model's name. Where every field is
    null there is no manifest: all of REQUIRED is missing and nothing violated.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    gone = {c: text(c) == "" for c in REQUIRED} | {"open_source": ~F.lower(text("open_source")).isin(*YES)}
    gone |= {"implementation_files": ~F.coalesce(F.exists("implementation_files", lambda f: F.coalesce(F.trim(f) != "", F.lit(False))), F.lit(False)), "implementation_sha256": text("implementation_sha256") == ""}
    none = F.lit(True)
    for c in gone:
        none = none & F.col(c).isNull()
    named = lambda conds: F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in conds.items()]))
    broken = {"repo_commit_invalid": ~text("repo_commit").rlike(r"\A[0-9a-f]{7,40}\z")}
    if standard_repo is not None:
        broken["repo_url_must_point_to_model_repo"] = (F.rtrim(text("repo_url"), F.lit("/")) == standard_repo.rstrip("/")) & (text("model_name") != F.lit(standard_model or ""))
    out = manifests.withColumn("missing", F.when(none, F.array(*map(F.lit, REQUIRED))).otherwise(named(gone)))
    out = out.withColumn("violations", F.when(none, F.array().cast("array<string>")).otherwise(named(broken)))
    out = out.withColumn("status", F.when((F.size("missing") == 0) & (F.size("violations") == 0), "transparent").otherwise("opaque"))
    return out.withColumn("status_changed", F.coalesce(F.lag("status").over(Window.partitionBy(uid).orderBy(at)) != F.col("status"), F.lit(True)))


def normalise_manifest(manifest: Column) -> Column:
    """A map of texts without null or blank values, trimmed; yes, no and the like as true and false."""
    plain = F.transform_values(manifest, lambda _, v: F.trim(v))
    word = lambda v: F.when(F.lower(v).isin("true", "yes", "1"), "true").when(F.lower(v).isin("false", "no", "0"), "false").otherwise(v)
    return F.transform_values(F.map_filter(plain, lambda _, v: v.isNotNull() & (v != "")), lambda _, v: word(v))


def changes(rows: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """Only rows whose digest differs from that of the key's row before; the first is a change."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(digest))).drop("__b")


def without(registry: DataFrame, removed: DataFrame, key: str, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """The registry without removed keys, and its counts by status."""
    kept = registry.join(removed.select(key), key, "left_anti")
    return kept, kept.groupBy(status).agg(F.count("*").alias("n"))


def status_summary(reports: DataFrame, at: str, status: str, verified: str, provider: str = "provider_", n: int = 32) -> DataFrame:
    """One row for the last n reports: how many there are, are verified, and failed at the provider; status and verification of the newest.

    A failure is a status with the provider's prefix other than its "completed".
    """
    last = reports.orderBy(F.desc(at)).limit(n)
    failed = F.col(status).startswith(provider) & (F.col(status) != provider + "completed")
    return last.agg(
        F.count("*").alias("recent_report_count"),
        F.count_if(verified).alias("verified_report_count"),
        F.count_if(failed).alias("provider_failure_count"),
        F.max_by(status, at).alias("last_status"),
        F.coalesce(F.max_by(verified, at), F.lit(False)).alias("last_proof_verified"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def evidence(rows: DataFrame, reward: str, uid: str, columns: list[str], k: int = 10) -> DataFrame:
    """The k best rows by reward, ties to the smaller uid, with a hash of what they show."""
    top = rows.orderBy(F.desc(reward), F.col(uid)).limit(k)
    return top.select(uid, reward, *columns, F.sha2(F.concat_ws("|", F.col(uid).cast("string"), F.col(reward).cast("string"), *[F.col(c).cast("string") for c in columns]), 256).alias("evidence"))
