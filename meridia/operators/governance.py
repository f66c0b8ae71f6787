"""Governance: consent, masking, export, erasure, roles, and tenant scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, values
from .membership import upsert_latest

_READ = ("source:read", "event:read", "profile:read", "segment:read", "journey:read", "destination:read", "activation:read", "audit:read", "dlq:read")
_ALL = (
    "source:read", "source:write", "event:read", "event:replay", "profile:read", "profile:delete", "segment:read", "segment:write",
    "journey:read", "journey:write", "destination:read", "destination:write", "activation:read", "dlq:read", "dlq:retry",
    "audit:read", "consent:write", "pii:read", "admin:write",
)
#: What each role may do.
ROLES: dict[str, tuple[str, ...]] = {
    "SUPER_ADMIN": _ALL,
    "TENANT_ADMIN": _ALL,
    "MARKETER": (*_READ, "segment:write", "journey:write", "destination:write", "consent:write"),
    "ANALYST": _READ,
    "OPERATOR": (*_READ, "dlq:retry", "event:replay"),
    "VIEWER": _READ,
}


@dataclass(frozen=True)
class Principal:
    """Who asks: a role, and the tenant it is bound to (None: all tenants)."""

    role: str
    tenant_id: str | None = None

    def can(self, permission: str) -> bool:
        return permission in ROLES.get(self.role, ())

    def scope(self, df: DataFrame, permission: str, tenant_id: str | None = None) -> DataFrame:
        """The rows of the one tenant that the principal may see; every reader goes through this."""
        if not self.can(permission):
            raise PermissionError(f"{self.role} lacks {permission}")
        free = self.tenant_id is None or self.role == "SUPER_ADMIN"
        if not free and tenant_id not in (None, self.tenant_id):
            raise PermissionError(f"{self.role} is bound to tenant {self.tenant_id}")
        tenant = tenant_id or self.tenant_id
        if tenant is None:
            raise PermissionError("a tenant is required")
        return df.filter(F.col("tenant_id") == tenant)


def role_matrix(spark: SparkSession) -> DataFrame:
    rows = [(r, p) for r, granted in ROLES.items() for p in granted]
    return spark.createDataFrame(rows, "role string, permission string")


def masked_traits(traits: Column) -> Column:
    """Traits JSON with email, phone and name masked where they are texts."""
    doc = F.try_parse_json(traits)
    whole = F.try_variant_get(doc, "$", "map<string,variant>")
    out = whole
    for key, mask in (("email", scalars.mask_email), ("phone", scalars.mask_phone), ("name", scalars.mask_name)):
        v = F.try_variant_get(doc, values.json_path([key]), "variant")
        text = F.when(values.json_kind(v) == "string", F.try_variant_get(v, "$", "string"))
        new = F.map_from_arrays(F.array(F.lit(key)), F.array(mask(text).cast("variant")))
        rest = F.map_filter(out, _other(key))
        out = F.when(text.isNotNull(), F.map_concat(rest, new)).otherwise(out)
    return F.to_json(out)


def _other(key: str):
    return lambda k, v: k != key


def visible_profiles(profiles: DataFrame, principal: Principal, tenant_id: str | None = None) -> DataFrame:
    rows = principal.scope(profiles, "profile:read", tenant_id)
    return rows if principal.can("pii:read") else rows.withColumn("traits", masked_traits(F.col("traits")))


def set_consent(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per (tenant, profile, channel, purpose) wins."""
    return upsert_latest(stored, new, ["tenant_id", "profile_id", "channel", "purpose"], "updated_at")


def consent_list(consent: DataFrame, tenant: str, profile: str) -> DataFrame:
    mine = consent.filter((F.col("tenant_id") == tenant) & (F.col("profile_id") == profile))
    return mine.select("channel", "purpose", "status").orderBy("channel", "purpose")


def merge_consent(consent: DataFrame, survivors: DataFrame) -> DataFrame:
    """Consent re-keyed to surviving profiles, where a denial of any merged profile wins.

    ``survivors`` has tenant_id, profile_id, survivor_id for merged profiles.
    """
    moved = consent.join(survivors, ["tenant_id", "profile_id"], "left").withColumn("profile_id", F.coalesce("survivor_id", "profile_id"))
    denied = F.max(F.col("status") == "denied")
    return moved.groupBy("tenant_id", "profile_id", "channel", "purpose").agg(
        F.when(denied, "denied").otherwise(F.max_by("status", "updated_at")).alias("status"), F.max("updated_at").alias("updated_at")
    )


def identifier_inventory(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster: how many identifiers of each namespace it holds."""
    held = nodes.join(members.select("tenant_id", "node_id", "cluster_id"), ["tenant_id", "node_id"])
    counts = held.groupBy("tenant_id", "cluster_id", "namespace").agg(F.count(F.lit(1)).alias("n"))
    return counts


def inventory_values(nodes: DataFrame, key: Column, permitted: bool) -> DataFrame:
    """Decrypted identifiers; what doesn't decrypt is left out, and values are masked without permission."""
    clear = nodes.withColumn("value", scalars.unsealed(F.col("value_encrypted"), key)).filter("value is not null")
    return clear if permitted else clear.withColumn("value", scalars.mask_identifier(F.col("namespace"), F.col("value")))


def export_bundle(
    profiles: DataFrame, identifiers: DataFrame, memberships: DataFrame, consent: DataFrame, wanted: DataFrame
) -> DataFrame:
    """One row per wanted (tenant_id, profile_id): the profile and sorted lists of what is stored about it.

    Every list is aggregated per profile before it is joined, so lists don't multiply.
    """
    keys = ["tenant_id", "profile_id"]

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        mine = df.join(wanted, keys, "left_semi")
        return mine.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    out = profiles.join(wanted, keys, "left_semi")
    for part in (
        listed(identifiers, "identifiers", "namespace", "value"),
        listed(memberships, "memberships", "segment_id", "status"),
        listed(consent, "consent", "channel", "purpose", "status"),
    ):
        out = out.join(part, keys, "left")
    return out


def erase(tables: dict[str, DataFrame], erased: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the erased profiles, how many rows each lost).  Raw events are not among the tables.

    ``erased`` has tenant_id, profile_id; every table has both columns.
    """
    keys = ["tenant_id", "profile_id"]
    kept = {n: df.join(erased, keys, "left_anti") for n, df in tables.items()}
    counts = None
    for name, df in sorted(tables.items()):
        lost = df.join(erased, keys, "left_semi").agg(F.count(F.lit(1)).alias("erased")).select(F.lit(name).alias("table"), "erased")
        counts = lost if counts is None else counts.unionByName(lost)
    return kept, counts
