"""Profile unification: events folded into traits and computed attributes.

``fold`` is declarative: each attribute is an aggregate of its cluster's events in
arrival order, in one shuffle.  It is exact for clusters that never merged.  A
merge keeps the survivor's traits even where the loser's are newer, so
``exact_fold`` folds what was a cluster of its own apart and combines along the merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.scalars import identity_hash
from ..sources.storage import checkpointed, drop_kept, kept
from .identity import jump_tables
from .prefix import before

#: The traits and event names that profiles know.
TRAITS = ("email", "phone", "name", "country")
ORDER_EVENT, VIEW_EVENT = "order_completed", "product_viewed"


def _text_at(document: Column, *path: str) -> Column:
    """The JSON string at a path, or the empty text for any other type."""
    v = F.try_variant_get(document, values.json_path(list(path)), "variant")
    return F.coalesce(F.when(values.json_kind(v) == "string", F.try_variant_get(v, "$", "string")), F.lit(""))


def observed(events: DataFrame, order_event: str = ORDER_EVENT, view_event: str = VIEW_EVENT) -> DataFrame:
    """The values that each envelope contributes, as flat text columns ("" for none)."""
    traits, props, context = (F.try_parse_json(F.col(c)) for c in ("traits", "properties", "context"))
    trait = {f"trait_{t}": _text_at(traits, t) for t in TRAITS}
    for t in ("email", "phone"):  # identifiers win
        trait[f"trait_{t}"] = F.coalesce(F.nullif(F.col(t), F.lit("")), trait[f"trait_{t}"])
    return events.select(
        "tenant_id",
        "event_id",
        "received_at",
        "timestamp",
        *(c.alias(n) for n, c in trait.items()),
        F.col("event_name").alias("last_event_name"),
        F.col("source_id").alias("last_source_id"),
        _text_at(context, "page", "url").alias("last_page_url"),
        F.when(F.col("event_name") == view_event, _text_at(props, "product_id")).otherwise("").alias("last_product_viewed"),
        (F.col("event_name") == order_event).alias("is_order"),
    )


LAST = ("last_event_name", "last_source_id", "last_page_url", "last_product_viewed")
_TEXTS = (*(f"trait_{t}" for t in TRAITS), *LAST)


def fold(seen: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster from ``observed`` rows; version counts the applied events."""
    return folded(partial(seen.dropDuplicates(["tenant_id", "event_id"]).join(clusters, ["tenant_id", "event_id"])))


_ORDERED = ("received_at timestamp", "event_id string")
#: State of ``partial``: the newest values with their place in the order, so that states of any events can be merged.
PARTIAL = (
    "tenant_id string, cluster_id string, "
    + ", ".join(f"{c} struct<{', '.join(_ORDERED)}, {c} string>" for c in _TEXTS)
    + f", last_order struct<{', '.join(_ORDERED)}, timestamp timestamp>, total_events long, total_orders long, "
    "first_seen_at timestamp, last_seen_at timestamp"
)


def partial(rows: DataFrame) -> DataFrame:
    """The state of ``observed`` rows (one per event, with cluster_id), which ``merged`` adds up."""

    def latest(c: str) -> Column:
        return F.max(F.when(F.col(c) != "", F.struct("received_at", "event_id", c))).alias(c)

    return rows.groupBy("tenant_id", "cluster_id").agg(
        *map(latest, _TEXTS),
        F.max(F.when(F.col("is_order"), F.struct("received_at", "event_id", "timestamp"))).alias("last_order"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_if("is_order").alias("total_orders"),
        F.min("timestamp").alias("first_seen_at"),
        F.max("timestamp").alias("last_seen_at"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One state per cluster from several."""
    return states.groupBy("tenant_id", "cluster_id").agg(
        *(F.max(c).alias(c) for c in (*_TEXTS, "last_order")),
        F.sum("total_events").alias("total_events"),
        F.sum("total_orders").alias("total_orders"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def folded(states: DataFrame) -> DataFrame:
    """What ``fold`` gives, from states."""
    return states.select(
        "tenant_id",
        "cluster_id",
        *(F.col(c)[c].alias(c) for c in _TEXTS),
        "total_events",
        "total_orders",
        F.col("last_order")["timestamp"].alias("last_order_at"),
        "first_seen_at",
        "last_seen_at",
        F.col("total_events").alias("version"),
    )


_LINE = ["tenant_id", "line"]


def _below(values: DataFrame, jumps: list[DataFrame], aggregates: dict[str, Callable]) -> DataFrame:
    """Per line, the aggregates over its own row and those of all lines that merged into it, in doubling steps."""
    made = values
    for jump in jumps:
        # What hangs within the jump's length below a line is complete by now, so the next as much joins it.
        lower = made.join(jump.select(*_LINE, "to"), _LINE).select("tenant_id", F.col("to").alias("line"), *aggregates)
        made = checkpointed(made.select(*_LINE, *aggregates).unionByName(lower).groupBy(*_LINE).agg(*(f(n).alias(n) for n, f in aggregates.items())))
    return made


def exact_fold(seen: DataFrame, events: DataFrame, merges: DataFrame) -> DataFrame:
    """What applying every event to its cluster as of then gives, merges included: the columns of ``folded``.

    ``events`` and ``merges`` are those of ``identity.timeline``.  Every line folds its own
    events apart.  A merge keeps the survivor's traits, fills what it lacks, and takes over
    the last activity of a loser that was seen later.  So each value of a line is its own or
    that of one line that merged into it, and following those links, which double in length
    every round, gives the values of the last survivors.
    """
    order = F.struct("received_at", "event_id")
    rows = kept(seen.dropDuplicates(["tenant_id", "event_id"]).drop("received_at").join(events, ["tenant_id", "event_id"]))
    places = {c: F.max(F.when(F.col(c) != "", F.struct(order.alias("at"), F.col(c).alias("v")))).alias(c) for c in _TEXTS}
    own = checkpointed(
        rows.groupBy(*_LINE).agg(
            *places.values(),
            F.max(F.when(F.col("is_order"), F.struct(order.alias("at"), "timestamp"))).alias("order"),
            F.count(F.lit(1)).alias("total_events"),
            F.count_if("is_order").alias("total_orders"),
            F.min("timestamp").alias("first_seen_at"),
            F.max("timestamp").alias("last_seen_at"),
        )
    )
    by = F.struct("received_at", "event_id").alias("by")
    hops = checkpointed(merges.select("tenant_id", F.col("loser").alias("line"), F.col("survivor").alias("to"), by))
    jumps = jump_tables(hops, ["tenant_id"])
    has = {f"has_{c}": F.max for c in _TEXTS}
    sums = {"total_events": F.sum, "total_orders": F.sum, "first_seen_at": F.min, "last_seen_at": F.max}
    flags = own.withColumns({f"has_{c}": F.col(c).isNotNull() for c in _TEXTS})
    whole = checkpointed(_below(flags, jumps, has | sums))

    # When a loser comes in, had the survivor been seen before it?  Its own events and what merged into it earlier tell.
    into = hops.join(whole.select(*_LINE, F.col("last_seen_at").alias("ts"), *has), _LINE)
    into = into.select("tenant_id", F.col("to").alias("line"), F.col("line").alias("loser"), "by", "ts", F.lit(True).alias("is_merge"), *has)
    mine = rows.join(hops.select("tenant_id", F.col("to").alias("line")).distinct(), _LINE, "left_semi")
    mine = mine.select(*_LINE, F.lit(None).cast(into.schema["loser"].dataType).alias("loser"), by, F.col("timestamp").alias("ts"), F.lit(False).alias("is_merge"), *((F.col(c) != "").alias(f"has_{c}") for c in _TEXTS))
    # An event comes after the merges that it causes; of those, older losers come first.
    steps = mine.unionByName(into).withColumn("kind", F.when(F.col("is_merge"), 0).otherwise(1))
    held = {"held": ("max", F.col("ts"))} | {f"held_{c}": ("max", F.when(F.col(f"has_{c}"), True)) for c in _TEXTS}
    steps = before(steps, _LINE, ["by", "kind", "loser"], held).filter("is_merge")
    later = F.col("held").isNull() | (F.col("ts") > F.col("held"))
    taken = checkpointed(steps.withColumns({f"take_{c}": F.col(f"has_{c}") & (F.col(f"held_{c}").isNull() | (later if c in LAST else F.lit(False))) for c in _TEXTS}))
    drop_kept(rows)

    # Per line and field: its own latest value, or the loser whose value it took last.
    picks = taken.groupBy(*_LINE).agg(*(F.max(F.when(F.col(f"take_{c}"), F.struct("by", "loser"))).alias(f"pick_{c}") for c in _TEXTS))
    found = own.join(picks, _LINE, "left")
    fields = []
    for c in _TEXTS:
        pick, mine_at = F.col(f"pick_{c}"), F.col(c)["at"]
        # A loser that came in by the event that set the value came in before it.
        takes = pick.isNotNull() & (mine_at.isNull() | (pick["by"] > F.struct(mine_at["received_at"].alias("received_at"), mine_at["event_id"].alias("event_id"))))
        fields.append(F.struct(F.lit(c).alias("field"), F.when(~takes, F.col(c)["v"]).alias("v"), F.when(takes, pick["loser"]).alias("to")))
    links = checkpointed(found.select(*_LINE, F.inline(F.array(*fields))))
    while not links.filter("to is not null").isEmpty():
        ahead = links.select("tenant_id", "field", F.col("line").alias("to"), F.col("v").alias("_v"), F.col("to").alias("_to"))
        moved = links.join(ahead, ["tenant_id", "field", "to"], "left")
        links = checkpointed(moved.select(*_LINE, "field", F.coalesce("v", "_v").alias("v"), F.col("_to").alias("to")))
    texts = links.groupBy(*_LINE).agg(*(F.max(F.when(F.col("field") == c, F.col("v"))).alias(c) for c in _TEXTS))

    # The last order: a line's own, or a later one of what merged in after it.
    orders = own.select(*_LINE, "order")
    after = hops.join(orders.select("tenant_id", F.col("line").alias("to"), F.col("order").alias("o")), ["tenant_id", "to"])
    last = F.struct(F.col("o")["at"]["received_at"].alias("received_at"), F.col("o")["at"]["event_id"].alias("event_id"))
    open_ = checkpointed(after.filter(F.col("o").isNull() | (F.col("by") > last)).select(*_LINE, "to", "by"))
    ordered = _below(orders.select(*_LINE, F.col("order")["timestamp"].alias("last_order_at")), jump_tables(open_, ["tenant_id"]), {"last_order_at": F.max})
    alive = whole.select(*_LINE, *sums).join(hops.select(*_LINE), _LINE, "left_anti")
    out = alive.join(texts, _LINE).join(ordered, _LINE).join(own.select(*_LINE, F.col("total_events").alias("version")), _LINE)
    return out.select(
        "tenant_id",
        F.concat(F.lit("c_"), F.col("line")["event_id"]).alias("cluster_id"),
        *_TEXTS,
        "total_events",
        "total_orders",
        "last_order_at",
        "first_seen_at",
        "last_seen_at",
        "version",
    )


def changed_fields(seen: DataFrame, clusters: DataFrame) -> DataFrame:
    """(tenant_id, event_id, cluster_id, changed): the fields that each event changed on its profile, by a two-level scan of its events."""
    rows = seen.join(clusters, ["tenant_id", "event_id"])
    held = {f"held_{c}": ("last", F.nullif(F.col(c), F.lit(""))) for c in _TEXTS}
    held |= {"held_first": ("min", F.col("timestamp")), "held_last": ("max", F.col("timestamp"))}
    rows = before(rows, ["tenant_id", "cluster_id"], ["received_at", "event_id"], held)

    def text(c: str, path: str) -> Column:
        return F.when((F.col(c) != "") & ~F.col(c).eqNullSafe(F.col(f"held_{c}")), F.lit(path))

    parts = [
        *(text(f"trait_{t}", f"traits.{t}") for t in TRAITS),
        F.lit("computed_attributes.total_events"),
        *(text(c, f"computed_attributes.{c}") for c in LAST),
        F.when(F.col("is_order"), F.lit("computed_attributes.total_orders")),
        F.when(F.col("is_order"), F.lit("computed_attributes.last_order_at")),
        F.when(F.col("held_first").isNull() | (F.col("timestamp") < F.col("held_first")), F.lit("first_seen_at")),
        F.when(F.col("held_last").isNull() | (F.col("timestamp") > F.col("held_last")), F.lit("last_seen_at")),
    ]
    changed = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return rows.select("tenant_id", "event_id", "cluster_id", changed.alias("changed"))


def updated_feed(seen: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per applied event: tenant_id, event_id, received_at, cluster_id, canonical_user_id, changed_fields, profile_version.

    The version counts the cluster's events up to this one, over the clusters as they are at last.
    """
    rows = changed_fields(seen.dropDuplicates(["tenant_id", "event_id"]), clusters).join(seen.select("tenant_id", "event_id", "received_at"), ["tenant_id", "event_id"])
    rows = before(rows, ["tenant_id", "cluster_id"], ["received_at", "event_id"], {"past": ("sum", F.lit(1))})
    return rows.select(
        "tenant_id",
        "event_id",
        "received_at",
        "cluster_id",
        F.concat(F.lit("customer_"), F.substring("cluster_id", 3, 1_000)).alias("canonical_user_id"),
        F.col("changed").alias("changed_fields"),
        (F.coalesce("past", F.lit(0)) + 1).cast("long").alias("profile_version"),
    )


def by_canonical_id(people: DataFrame, tenant: str, canonical_user_id: str) -> DataFrame:
    """The profile with a canonical user id, in one tenant."""
    return people.filter((F.col("tenant_id") == tenant) & (F.col("canonical_user_id") == canonical_user_id))


def by_id(people: DataFrame, tenant: str, profile_id: str) -> DataFrame:
    """The profile with an id, in one tenant."""
    return people.filter((F.col("tenant_id") == tenant) & (F.col("profile_id") == profile_id))


def lookup(profiles: DataFrame, members: DataFrame, tenant: str, namespace: str, value: str, limit: int = 100) -> DataFrame:
    """Profiles that ever had an identifier, or have it as a trait; newest first.

    ``profiles`` has tenant_id, cluster_id, traits, updated_at; ``members`` the nodes of clusters.
    """
    value = value.strip().lower() if namespace == "email" else value.strip()
    node = F.substring(identity_hash(F.lit(tenant), F.lit(namespace), F.lit(value)), 1, 32)
    hits = members.filter((F.col("tenant_id") == tenant) & (F.col("node_id") == node)).select("tenant_id", "cluster_id")
    mine = profiles.filter(F.col("tenant_id") == tenant)
    by_node = mine.join(hits, ["tenant_id", "cluster_id"], "left_semi")
    by_trait = mine.filter(_text_at(F.try_parse_json("traits"), namespace) == value)
    return by_node.unionByName(by_trait).dropDuplicates(["tenant_id", "cluster_id"]).orderBy(F.col("updated_at").desc(), "cluster_id").limit(limit)
