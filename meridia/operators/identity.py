"""Identity resolution: events that share an identifier belong to one customer, within a tenant.

The final clusters don't depend on the order of events: they are the connected
components of events and identifiers.  A cluster is named after its first event,
which is the one whose cluster survives every merge.

What happened on the way is found set-wise as well.  A line is what an event without
known identifiers begins; it lives until it merges into an older one.  ``merges`` links
every line by the first event that ties it to another.  These links form trees, and what
a tree's lines go through up to the first event that ties the tree to another one is a
running minimum over its lines in order of entry.  The trees are contracted up to there
and the rest is linked anew, in rounds that at least halve their number.
``resolved_feed`` follows those merges up to each event's own time by jumps of doubling
length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity_hash
from ..sources.storage import checkpointed, drop_checkpoint, drop_kept, kept
from .graph import connected_components
from .ingest import IDENTIFIERS
from .joins import attach
from .prefix import before


def extract(events: DataFrame) -> DataFrame:
    """(tenant_id, event_id, received_at, namespace, value, node_id) per identifier of an event.

    An alias adds its previous id as an anonymous id.  Events without identifiers drop out.
    """
    pairs = [F.struct(F.lit(ns).alias("namespace"), F.col(ns).alias("value")) for ns in IDENTIFIERS]
    alias = F.struct(F.lit("anonymous_id").alias("namespace"), F.when(F.col("type") == "alias", F.col("previous_id")).alias("value"))
    found = F.array_distinct(F.filter(F.array(*pairs, alias), lambda x: F.coalesce(x["value"], F.lit("")) != ""))
    rows = events.select("tenant_id", "event_id", "received_at", F.inline(found))
    node = F.substring(identity_hash(F.col("tenant_id"), F.col("namespace"), F.col("value")), 1, 32)
    return rows.withColumn("node_id", node)


def nodes(identifiers: DataFrame) -> DataFrame:
    return identifiers.groupBy("tenant_id", "node_id", "namespace").agg(F.min("value").alias("value"))


def resolve(identifiers: DataFrame) -> DataFrame:
    """(tenant_id, node_id, cluster_id, canonical_user_id, created_at) for every node."""
    order = F.struct("received_at", "event_id")
    per_event = identifiers.groupBy("tenant_id", "event_id").agg(F.min("node_id").alias("a"), F.collect_set("node_id").alias("all"))
    # Each event ties its nodes to the smallest of them: a star, not all pairs.
    edges = per_event.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
    roots = connected_components(edges).withColumnRenamed("node", "node_id")
    first = identifiers.groupBy("tenant_id", "node_id").agg(F.min(order).alias("first"))
    rooted = first.join(roots, "node_id", "left").withColumn("root", F.coalesce("root", "node_id"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return rooted.join(heads, "root").select(
        "tenant_id",
        "node_id",
        F.concat(F.lit("c_"), F.col("head.event_id")).alias("cluster_id"),
        F.concat(F.lit("customer_"), F.col("head.event_id")).alias("canonical_user_id"),
        F.col("head.received_at").alias("created_at"),
    )


def event_clusters(identifiers: DataFrame, members: DataFrame) -> DataFrame:
    """(tenant_id, event_id, cluster_id): late events of a merged cluster go to the survivor by themselves."""
    any_node = identifiers.groupBy("tenant_id", "event_id").agg(F.min("node_id").alias("node_id"))
    return any_node.join(members.select("tenant_id", "node_id", "cluster_id"), ["tenant_id", "node_id"]).drop("node_id")


_EVENT = ["tenant_id", "event_id", "received_at"]


def _lines(identifiers: DataFrame) -> DataFrame:
    """(event's keys, all: the sorted lines that an event's identifiers belong to); a line is (at, event_id) of the event that began it."""
    order = F.struct(F.col("received_at").alias("at"), "event_id")
    rows = identifiers.select(*_EVENT, "node_id")
    firsts = kept(rows.groupBy("tenant_id", "node_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    seen = attach(rows, firsts, ["tenant_id", "node_id"], "n", F.col("event_id"))
    known = F.col("first") < order
    per = seen.groupBy(*_EVENT).agg(
        F.min(F.when(known, F.struct("first", "node_id")))["node_id"].alias("anchor"),
        F.min(F.when(~known, F.col("node_id"))).alias("fresh"),
    )
    # A new identifier belongs with the oldest known one of its event, or with the least of the new ones.
    lead = per.filter("fresh is not null").select("tenant_id", F.col("event_id").alias("_e"), F.coalesce("anchor", "fresh").alias("survivor_id"))
    owned = firsts.withColumn("_e", F.col("first")["event_id"]).join(lead, ["tenant_id", "_e"])
    hops = owned.select("tenant_id", F.col("node_id").alias("cluster_id"), "survivor_id").filter("cluster_id <> survivor_id")
    ends = flat_redirects(hops)
    born = firsts.select("tenant_id", F.col("node_id").alias("_root"), F.col("first").alias("line"))
    led = firsts.join(ends.select("tenant_id", F.col("cluster_id").alias("node_id"), F.col("survivor_id").alias("_root")), ["tenant_id", "node_id"], "left")
    led = led.withColumn("_root", F.coalesce("_root", "node_id")).select("tenant_id", "node_id", "n", "_root")
    led = kept(led.join(born, ["tenant_id", "_root"]).drop("_root"))
    drop_kept(firsts)
    lines = attach(rows, led, ["tenant_id", "node_id"], "n", F.col("event_id"))
    made = kept(lines.groupBy(*_EVENT).agg(F.sort_array(F.collect_set("line")).alias("all")))
    drop_kept(led)
    return made


def merges(identifiers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(tenant_id, loser, survivor, event_id, received_at): the lines that each event merged away, with the oldest, which stays.

    ``members`` is not read: merges are found from the identifiers alone.
    """
    lines = _lines(identifiers)
    found = checkpointed(_merges(lines))
    drop_kept(lines)
    return found


def _trees(edges: DataFrame) -> DataFrame:
    """(tenant_id, v, w, top): every line with its first edge ``w`` and the top of its tree, whose own ``w`` is null.

    The first edges of all lines form trees, each around the one edge that is the first of
    both its ends; the older of these is the top.
    """
    ends = [edges.select("tenant_id", F.col(x).alias("v"), F.struct("w", F.col(y).alias("p")).alias("m")) for x, y in ("ab", "ba")]
    up = ends[0].unionByName(ends[1]).groupBy("tenant_id", "v").agg(F.min("m").alias("m"))
    up = checkpointed(up.select("tenant_id", "v", F.col("m")["w"].alias("w"), F.col("m")["p"].alias("p")))
    tops = up.groupBy("tenant_id", "w").agg(F.min("v").alias("top"), F.count(F.lit(1)).alias("n")).filter("n = 2").select("tenant_id", "top")
    tops = checkpointed(tops)
    own = tops.select("tenant_id", F.col("top").alias("v"), F.lit(True).alias("_is"))
    above = tops.select("tenant_id", F.col("top").alias("p"), F.lit(True).alias("_under"))
    tree = up.join(own, ["tenant_id", "v"], "left").join(above, ["tenant_id", "p"], "left")
    is_top = F.col("_is").isNotNull()
    tree = tree.select(
        "tenant_id", "v", F.when(~is_top, F.col("w")).alias("w"), F.when(is_top, F.col("v")).otherwise(F.col("p")).alias("top"), (is_top | F.col("_under").isNotNull()).alias("ended")
    )
    tree = checkpointed(tree)
    while not tree.filter("not ended").isEmpty():
        ahead = tree.select("tenant_id", F.col("v").alias("top"), F.col("top").alias("_top"), F.col("ended").alias("_ended"))
        tree = checkpointed(tree.join(ahead, ["tenant_id", "top"]).select("tenant_id", "v", "w", F.col("_top").alias("top"), F.col("_ended").alias("ended")))
    return tree.drop("ended")


def _merges(lines: DataFrame) -> DataFrame:
    star = lines.filter(F.size("all") > 1).select(
        "tenant_id", F.struct("received_at", "event_id").alias("e"), F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << 30)).alias("b")
    )
    edges = star.groupBy("tenant_id", "a", "b").agg(F.min("e").alias("e"))
    # Edges of one event are told apart by their younger line, so no two weigh the same.
    w = F.struct(F.col("e")["received_at"].alias("received_at"), F.col("e")["event_id"].alias("event_id"), "b")
    edges = checkpointed(edges.select("tenant_id", "a", "b", w.alias("w")))
    parts = []
    while not edges.isEmpty():
        tree = _trees(edges)
        for x in "ab":
            edges = edges.join(tree.select("tenant_id", F.col("v").alias(x), F.col("w").alias(f"w{x}"), F.col("top").alias(f"t{x}")), ["tenant_id", x])
        # Within a tree, an edge that is no line's first joins what is one already.
        cross = checkpointed(edges.filter("ta <> tb"))
        limits = cross.select("tenant_id", F.explode(F.array("ta", "tb")).alias("top"), "w").groupBy("tenant_id", "top").agg(F.min("w").alias("f"))
        # Up to the first edge to another tree, a tree is one cluster that its lines enter one by one: the oldest so far meets the next.
        held = before(tree, ["tenant_id", "top"], ["w"], {"held": ("min", F.col("v"))})
        steps = checkpointed(held.join(limits, ["tenant_id", "top"], "left").withColumn("settled", F.coalesce(F.col("w").isNull() | (F.col("w") < F.col("f")), F.lit(True))))
        met = steps.filter("settled and w is not null")
        parts.append(met.select("tenant_id", F.greatest("v", "held").alias("loser"), F.least("v", "held").alias("survivor"), F.struct("w.received_at", "w.event_id").alias("e")))
        # What lies beyond starts anew from the oldest line of what the tree is by then; so trees at least halve in number.
        core = steps.filter("settled and f is not null").groupBy("tenant_id", "top").agg(F.min("v").alias("core"))
        late = steps.filter("not settled").join(core, ["tenant_id", "top"]).select("tenant_id", F.col("core").alias("a"), F.col("v").alias("b"), "w")
        for x in "ab":
            mine = core.join(limits, ["tenant_id", "top"]).select("tenant_id", F.col("top").alias(f"t{x}"), F.col("core").alias(f"c{x}"), F.col("f").alias(f"f{x}"))
            inside = F.col(f"w{x}").isNull() | (F.col(f"w{x}") < F.col(f"f{x}"))
            cross = cross.join(mine, ["tenant_id", f"t{x}"]).withColumn(x, F.when(inside, F.col(f"c{x}")).otherwise(F.col(x)))
        rest = cross.select("tenant_id", "a", "b", "w").unionByName(late)
        edges = checkpointed(rest.groupBy("tenant_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    none = edges.select("tenant_id", F.col("a").alias("loser"), F.col("b").alias("survivor"), F.struct("w.received_at", "w.event_id").alias("e"))
    done = reduce(DataFrame.unionByName, parts, none)
    oldest = done.groupBy("tenant_id", "e").agg(F.min("survivor").alias("survivor"))
    return (
        done.drop("survivor")
        .join(oldest, ["tenant_id", "e"])
        .select("tenant_id", "loser", "survivor", F.col("e")["event_id"].alias("event_id"), F.col("e")["received_at"].alias("received_at"))
    )


def _name(line: Column) -> Column:
    return F.concat(F.lit("c_"), line["event_id"])


def merge_history(identifiers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(tenant_id, from_cluster_id, to_cluster_id, event_id, reason): one row per cluster that was merged away."""
    found = merges(identifiers)
    return found.select(
        "tenant_id", _name(F.col("loser")).alias("from_cluster_id"), _name(F.col("survivor")).alias("to_cluster_id"), "event_id", F.lit("deterministic_match").alias("reason")
    )


def jump_tables(hops: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Tables (keys, line, to, by) of jumps of 1, 2, 4, ... hops along a forest given by its hops; ``by`` is that of the last hop."""
    jumps, jump = [], hops
    while not jump.isEmpty():
        jumps.append(jump)
        ahead = jump.select(*keys, F.col("line").alias("to"), F.col("to").alias("_to"), F.col("by").alias("_by"))
        jump = checkpointed(jump.join(ahead, [*keys, "to"]).select(*keys, "line", F.col("_to").alias("to"), F.col("_by").alias("by")))
    return jumps


def timeline(identifiers: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tenant_id, event_id, received_at, line: the oldest line of its cluster when the event arrived; ``merges``)."""
    lines = _lines(identifiers)
    found = checkpointed(_merges(lines))
    order = F.struct("received_at", "event_id")
    events = lines.select(*_EVENT, F.col("all")[0].alias("line"))
    hops = checkpointed(found.select("tenant_id", F.col("loser").alias("line"), F.col("survivor").alias("to"), order.alias("by")))
    weights = events.groupBy("tenant_id", "line").agg(F.count(F.lit(1)).alias("_n"))
    step = checkpointed(hops.join(weights, ["tenant_id", "line"]))
    met = kept(attach(events, step, ["tenant_id", "line"], "_n", F.col("event_id")))
    drop_kept(lines)
    gone = F.coalesce(F.col("by") <= order, F.lit(False))
    moved = met.filter(gone).select(*_EVENT, F.col("to").alias("line"))
    # A line dies before the line that it went to, so the longest jump that ended by the event's time comes first.
    for jump in reversed(jump_tables(hops, ["tenant_id"])):
        ahead = jump.select("tenant_id", "line", F.col("to").alias("_to"), F.col("by").alias("_by"))
        moved = moved.join(ahead, ["tenant_id", "line"], "left").withColumn("line", F.when(F.col("_by") <= order, F.col("_to")).otherwise(F.col("line")))
        moved = checkpointed(moved.select(*_EVENT, "line"))
    return met.filter(~gone).select(*_EVENT, "line").unionByName(moved), found


def resolved_feed(identifiers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per event with identifiers: tenant_id, event_id, received_at, cluster_id, canonical_user_id, merge_occurred, merged_canonical_user_ids.

    The cluster is the one that the event was resolved to when it arrived, which may have
    merged into an older one since; the merged ids are those of the clusters that it merged away.
    """
    events, found = timeline(identifiers)
    customer = lambda line: F.concat(F.lit("customer_"), line["event_id"])
    gone = found.groupBy("tenant_id", "event_id").agg(F.transform(F.sort_array(F.collect_list("loser")), customer).alias("merged"))
    return events.join(gone, ["tenant_id", "event_id"], "left").select(
        *_EVENT,
        _name(F.col("line")).alias("cluster_id"),
        customer(F.col("line")).alias("canonical_user_id"),
        F.col("merged").isNotNull().alias("merge_occurred"),
        F.coalesce("merged", F.array().cast("array<string>")).alias("merged_canonical_user_ids"),
    )


def flat_redirects(merges: DataFrame) -> DataFrame:
    """(tenant_id, cluster_id, survivor_id) with chains of merges followed to their end.

    Each round doubles the length of the chains that are followed, and is checkpointed.
    """
    last = hops = checkpointed(merges.select("tenant_id", "cluster_id", "survivor_id"))
    while True:
        ahead = hops.select("tenant_id", F.col("cluster_id").alias("survivor_id"), F.col("survivor_id").alias("_end"))
        joined = hops.join(ahead, ["tenant_id", "survivor_id"], "left")
        moved = checkpointed(joined.select("tenant_id", "cluster_id", F.coalesce("_end", "survivor_id").alias("survivor_id"), F.col("_end").isNotNull().alias("_moved")))
        drop_checkpoint(last)
        if moved.filter("_moved").isEmpty():
            return moved.drop("_moved")
        last, hops = moved, moved.drop("_moved")
