"""States of the first layout: one JSON record for each key, with a map from posting ids to entries.

Records come as rows (name, value), as a key-value store exports them, any number of them.  Whether a value is such a
record is asked of it as a VARIANT, so that odd values are seen as what they are; entries are read through a
map type, which keeps their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changes as C

RECORD_SCHEMA = "name string, value string"
#: Names of records are no longer than this; longer ones carry a hash of the key.
LONGEST_NAME = 256
_ENTRY = (
    "struct<jobId:string,contentHash:string,trackedHash:string,firstSeenAt:string,lastSeenAt:string,active:boolean,expiredAt:string,"
    "snapshot:struct<linkedinJobId:string,title:string,company:string,location:string,jobUrl:string,postedAt:string>>"
)
_RECORD = f"struct<stateKey:string,updatedAt:string,jobs:map<string,{_ENTRY}>>"


def legacy_names(key: str | Column) -> tuple:
    """The two names that records of the first layout had, the likelier one first."""
    if isinstance(key, str):
        return f"state_{key}", f"state/{key}"
    return F.concat(F.lit("state_"), key), F.concat(F.lit("state/"), key)


def scoped_name(key: Column, fingerprint: Column) -> Column:
    """The name of a key's record under a fingerprint: the key in URL-safe Base64, or a hash of it where that is too long."""
    encoded = F.rtrim(F.translate(F.replace(F.base64(key.cast("binary")), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))
    name = F.concat(F.lit("state__"), encoded, F.lit("__"), fingerprint)
    hashed = F.concat(F.lit("state__h"), F.left(F.sha2(key, 256), F.lit(40)), F.lit("__"), fingerprint)
    return F.when(F.length(name) <= LONGEST_NAME, name).otherwise(hashed)


def recognised(records: DataFrame) -> DataFrame:
    """The records with kind, legacy | current | other, and the fingerprint that a current one names.

    A legacy record says version 1 or nothing about it; JSON null, texts and other numbers are no version.
    """
    of = lambda path: F.try_variant_get("_v", path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(of(path)), F.lit("-"))
    rows = records.withColumn("_v", F.try_parse_json("value"))
    number = F.when(kind("$.version").rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("_v", "$.version", "double"))
    whole = (kind("$.stateKey") == "STRING") & kind("$.jobs").startswith("OBJECT")
    is_current = (kind("$.queryFingerprint") == "STRING") & (number == 2)
    answer = F.when(whole & ((kind("$.version") == "-") | (number == 1)), "legacy").when(whole & is_current, "current").otherwise("other")
    return rows.withColumn("kind", F.coalesce(answer, F.lit("other"))).withColumn(
        "fingerprint", F.when(F.col("kind") == "current", F.try_variant_get("_v", "$.queryFingerprint", "string"))).drop("_v")


def entries(records: DataFrame) -> DataFrame:
    """The entries of legacy and current records: name, state_key and the columns of a state table, in the record's order.

    A record is one value, so its entries are read in one task; records are spread.
    """
    known = recognised(records).where("kind <> 'other'")
    rows = known.select("name", F.from_json("value", _RECORD).alias("r"))
    each = rows.select("name", F.col("r.stateKey").alias("state_key"), F.posexplode("r.jobs").alias("ordinal", "id", "e"))
    snap = F.col("e.snapshot")
    names = ("linkedinJobId", *C.SNAPSHOT_FIELDS[1:])
    fields = (snap[n].alias(f) for n, f in zip(names, C.SNAPSHOT_FIELDS, strict=True))
    return each.select(
        "name", "state_key", F.col("id").alias("job_id"), F.col("e.contentHash").alias("content_hash"), F.col("e.trackedHash").alias("tracked_hash"),
        F.col("e.firstSeenAt").alias("first_seen_at"), F.col("e.lastSeenAt").alias("last_seen_at"), F.col("e.active").alias("active"),
        F.col("e.expiredAt").alias("expired_at"), F.when(snap.isNotNull(), F.struct(*fields)).alias("snapshot"), F.col("ordinal").cast("long").alias("ordinal"),
    )


def openings(asked: DataFrame, records: DataFrame) -> DataFrame:
    """What opening each asked state (state_key, fingerprint) finds: the two, adopted (a name), reason, migrated_from.

    The record under the key's own name counts alone if there is one: it is adopted if it is current and of the same
    fingerprint, and else taken for damaged.  Without one a legacy record is reported, and nothing is adopted.
    """
    known = recognised(records).select("name", "kind", F.col("fingerprint").alias("said"))
    key = F.col("state_key")
    one, two = legacy_names(key)
    names = F.array(scoped_name(key, F.col("fingerprint")), one, two)
    wanted = asked.select("state_key", "fingerprint", F.posexplode(names).alias("place", "name"))
    found = wanted.join(known, "name", "left").withColumn("there", F.col("kind").isNotNull())
    own, old = F.col("place") == 0, (F.col("place") > 0) & F.col("kind").eqNullSafe("legacy")
    good = own & F.col("kind").eqNullSafe("current") & F.col("said").eqNullSafe(F.col("fingerprint"))
    out = found.groupBy("state_key", "fingerprint").agg(
        F.coalesce(F.bool_or(own & F.col("there")), F.lit(False)).alias("scoped"), F.max(F.when(good, F.col("name"))).alias("adopted"),
        F.min_by(F.when(old, F.col("name")), F.when(old, F.col("place"))).alias("legacy"))
    reason = F.when(F.col("adopted").isNotNull(), None).when(F.col("scoped"), "state_corruption_detected").otherwise("no_prior_state")
    return out.select("state_key", "fingerprint", "adopted", reason.alias("reason"), F.when(~F.col("scoped"), F.col("legacy")).alias("migrated_from"))
