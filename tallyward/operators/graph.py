"""Account-entity graph: edges, fan-out, star links, rings, and neighbourhood features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.operators.components import connected_components
from tallyward.operators.evaluate import union_all
from tallyward.operators.skew import join_unique
from tallyward.session import cut_lineage, drop_table
from tallyward.sources.schema import ASN_TYPES

# An IP shared by more accounts than this is a network gateway; a component of at
# least this many accounts is a ring.
CAPS = {"ip": 10}
MIN_RING = 5
COORDINATED = ["account_farmer", "spam_bot"]
ENTITY = ["etype", "entity_id"]


def _rank(value: Column, names: Sequence[str]) -> Column:
    """Place of a text in the order of ``names``: 2i + 1 for the i-th of them, an even number for a text between two.

    The smallest place belongs to the smallest text, and an aggregate of numbers is hashed where one of texts is sorted.
    """
    out = F.lit(2 * len(names))
    for i, n in reversed([*enumerate(sorted(names))]):
        out = F.when(value < n, 2 * i).when(value == n, 2 * i + 1).otherwise(out)
    return F.when(value.isNotNull(), out)


def _ranked(rank: Column, names: Sequence[str]) -> Column:
    """The name at a place of :func:`_rank`; NULL for a text between two names."""
    found = [F.when(rank == 2 * i + 1, n) for i, n in enumerate(sorted(names))]
    return F.coalesce(*found)


def entity_edges(events: DataFrame | None = None, accounts: DataFrame | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """(user_id, etype, entity_id, weight, asn_type): exactly one row per account and entity.

    The log is read once for all its entity types, and requests are merged before the shuffle. IP
    edges carry the network type (smallest name when there are several); accounts without a payment
    instrument have no payment edge. ``names`` are those of all network types, where they are known: edges are then
    merged by hashing, without it sorted. A type that is not among them is an error.
    """
    none = F.lit(None).cast("string")
    parts = []
    if events is not None:
        kinds = {"ip": "ip", "device": "device_fp"}
        asn, smallest = F.col("asn_type") if "asn_type" in events.columns else none, F.min("asn_type")
        if names:
            other = F.raise_error(F.concat(F.lit("unknown network type "), asn)).cast("int")
            asn, none, smallest = F.when(asn.isNull() | asn.isin(*names), _rank(asn, names)).otherwise(other), F.lit(None).cast("int"), _ranked(F.min("asn_type"), names)
        used = [
            F.struct(F.lit(t).alias("etype"), F.col(c).alias("entity_id"), (asn if t == "ip" else none).alias("asn_type"))
            for t, c in kinds.items()
            if c in events.columns
        ]
        seen = events.select("user_id", F.inline(F.array(*used))).filter(F.col("entity_id").isNotNull())
        parts.append(seen.groupBy("user_id", *ENTITY).agg(F.count("*").alias("weight"), smallest.alias("asn_type")))
    if accounts is not None:
        pay = accounts.filter(F.col("payment_hash").isNotNull())
        parts.append(
            pay.select("user_id", F.lit("payment").alias("etype"), F.col("payment_hash").alias("entity_id"))
            .groupBy("user_id", *ENTITY)
            .agg(F.lit(1).cast("long").alias("weight"), F.lit(None).cast("string").alias("asn_type"))
        )
    return union_all(parts)


def entity_fanout(edges: DataFrame) -> DataFrame:
    """Accounts per entity, their smallest id, and the network type of an IP.

    ``edges`` has one row per account and entity, so rows are accounts.
    """
    return edges.groupBy(*ENTITY).agg(
        F.count("*").alias("fanout"), F.min("user_id").alias("hub"), F.min("asn_type").alias("asn_type")
    )


def linking_entities(fanout: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Entities shared by at least two accounts and, for capped types, by at most the cap."""
    keep = F.col("fanout") >= 2
    for etype, cap in caps.items():
        keep = keep & ((F.col("etype") != etype) | (F.col("fanout") <= cap))
    return fanout.filter(keep)


def over_cap(fanout: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Number of entities of each capped type that are too widely shared to link accounts."""
    rows = [
        fanout.filter((F.col("etype") == t) & (F.col("fanout") > c)).agg(
            F.lit(t).alias("etype"), F.lit(c).alias("cap"), F.count("*").alias("excluded")
        )
        for t, c in caps.items()
    ]
    return union_all(rows)


def star_links(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(etype, entity_id, src, dst): every account of an entity linked to the smallest one.

    One link per account and entity, never a pair list. The entity side has one row per entity; the
    accounts of a very widely shared entity, linking or over the cap, are spread over several tasks.
    """
    keyed = edges.select("user_id", *ENTITY, F.concat_ws("|", *ENTITY).alias("_e"))
    hubs = entities.select(F.concat_ws("|", *ENTITY).alias("_e"), "hub")
    joined = join_unique(keyed, hubs, "_e")
    return joined.filter(F.col("user_id") != F.col("hub")).select(
        *ENTITY, F.col("user_id").alias("src"), F.col("hub").alias("dst")
    )


def link_counts(entities: DataFrame) -> DataFrame:
    """Links made by each entity type: the sum of (accounts - 1)."""
    return entities.groupBy("etype").agg(
        F.count("*").alias("entities"), F.sum(F.col("fanout") - 1).alias("links")
    ).orderBy("etype")


def component_links(edges: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """(src, dst): the accounts of every linking entity, each linked to the smallest one.

    The two accounts of an entity that two share are known from the counting itself, so only the edges of entities
    with more go to a join, and the table of those is written first: while it is small, the edges are not moved for it.
    """
    ends = edges.groupBy(*ENTITY).agg(F.count("*").alias("fanout"), F.min("user_id").alias("hub"), F.max("user_id").alias("_far"))
    linking = cut_lineage(linking_entities(ends, caps), "linking")
    wide = cut_lineage(linking.filter("fanout > 2").select(*ENTITY, "hub"), "wide")
    two = linking.filter("fanout = 2 and _far != hub").select(F.col("_far").alias("src"), F.col("hub").alias("dst"))
    return two.unionByName(star_links(edges, wide).select("src", "dst"))


def account_components(edges: DataFrame, caps: dict[str, int] = CAPS, stored: bool = False) -> DataFrame:
    """(id, component_id) of accounts linked by shared entities.

    The edge table serves fan-out and links, so the event log is read once and the pairs are written, unless
    ``edges`` are a ``stored`` table.
    """
    pairs = edges.select("user_id", *ENTITY)
    return connected_components(component_links(pairs if stored else cut_lineage(pairs, "pairs"), caps), "src", "dst")


def ring_flags(accounts: DataFrame, components: DataFrame, min_size: int = MIN_RING) -> DataFrame:
    """Component id, size and ring flag of every account; an unlinked account is its own component.

    One component may hold a large part of all accounts, so its size is joined back where the engine can split it.
    """
    sizes = components.groupBy("component_id").agg(F.count("*").alias("_size"))
    sized = join_unique(components, sizes, "component_id")
    members = sized.select(F.col("id").alias("user_id"), "component_id", "_size")
    size = F.coalesce("_size", F.lit(1)).cast("long")
    return accounts.join(members, "user_id", "left").select(
        "user_id",
        "label",
        F.coalesce("component_id", "user_id").alias("component_id"),
        size.alias("component_size"),
        (size >= min_size).alias("ring_flag"),
    )


def ring_report(flags: DataFrame, rows: int = 10, min_size: int = MIN_RING) -> DataFrame:
    """The largest rings with their share of coordinated accounts and most common label."""
    ring = flags.filter(F.col("component_size") >= min_size)
    counts = ring.groupBy("component_id", "label").agg(F.count("*").alias("n"))
    bad = F.when(F.col("label").isin(COORDINATED), F.col("n")).otherwise(0)
    # most frequent label, alphabetically first on a tie
    dominant = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return (
        counts.groupBy("component_id")
        .agg(
            F.sum("n").alias("size"),
            (expr.ratio(F.sum(bad), F.sum("n")) * 100).alias("pct_abusive"),
            dominant.alias("dominant_label"),
        )
        .orderBy(F.desc("size"), "component_id")
        .limit(rows)
    )


def entity_features(fanout: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Node features of entities: log degree and, for IPs, the network type."""
    hot = dict(zip([f"asn_{a}" for a in ASN_TYPES], expr.one_hot(F.col("asn_type"), ASN_TYPES)))
    return fanout.select(*keep, *ENTITY, F.log1p("fanout").alias("log_degree"), *[c.alias(n) for n, c in hot.items()])


def _numbered_pairs(edges: DataFrame) -> DataFrame:
    """(user_id, etype, node) with a number for each entity that several rows share; without one for the others.

    Edges and numbers are written once, so the sources are read once and every later step works on numbers.
    """
    pairs = cut_lineage(edges.select("user_id", "etype", F.concat_ws("|", *ENTITY).alias("_e")), "pairs")
    several = pairs.groupBy("_e").agg(F.count("*").alias("_n")).filter("_n > 1")
    nodes = cut_lineage(several.select("_e", F.monotonically_increasing_id().alias("node")), "nodes")
    numbered = cut_lineage(join_unique(pairs, nodes, "_e", "left").select("user_id", "etype", "node"), "numbered")
    drop_table(pairs)
    return numbered


def propagate(
    features: DataFrame,
    edges: DataFrame,
    cols: Sequence[str],
    etypes: Sequence[str] = ("ip", "device", "payment"),
    rounds: int = 1,
) -> DataFrame:
    """Fixed propagation over the typed graph: account -> entity -> account means, per edge type.

    Each round appends, for each edge type, the mean over the accounts reached through that type
    (itself included), so the result holds the account's own columns and those of its neighbourhood
    one hop further with each round. An entity has one type, so all types share one pass: two
    equi-joins and two combinable averages per round, whatever the number of types. An entity of one
    account hands back what that account has, so those are counted once and only shared ones joined.
    """
    numbered = _numbered_pairs(edges)
    single = [F.count_if(F.col("node").isNull() & (F.col("etype") == t)).alias(f"_{t}_alone") for t in etypes]
    alone = cut_lineage(numbered.filter("node is null").groupBy("user_id").agg(*single), "alone")
    pairs = cut_lineage(numbered.filter("node is not null"), "shared")
    drop_table(numbered)
    out = features.select("user_id", *cols)
    current = list(cols)
    for r in range(1, rounds + 1):
        source = cut_lineage(out, f"round{r}")
        to_entity = join_unique(pairs, source.select("user_id", *current), "user_id").groupBy("node").agg(*[F.avg(c).alias(c) for c in current])
        reached = join_unique(pairs, to_entity, "node")
        names = {(t, c): f"{t}{r}_{c}" for t in etypes for c in current}
        of = {n: F.when(F.col("etype") == t, F.col(c)) for (t, c), n in names.items()}
        sums = [a for n, v in of.items() for a in (F.sum(v).alias(f"_s_{n}"), F.count(v).alias(f"_n_{n}"))]
        both = source.join(alone, "user_id", "left").join(reached.groupBy("user_id").agg(*sums), "user_id", "left")
        means = {}
        for (t, c), n in names.items():
            own = F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"_{t}_alone"), F.lit(0))).otherwise(0)
            total = F.coalesce(F.col(f"_s_{n}"), F.lit(0.0)) + F.when(own > 0, own * F.col(c)).otherwise(0.0)
            means[n] = expr.ratio(total, own + F.coalesce(F.col(f"_n_{n}"), F.lit(0)))
        out = both.select(*source.columns, *[m.alias(n) for n, m in means.items()])
        current = list(names.values())
    return out


def neighbour_degrees(edges: DataFrame, fanout: DataFrame | None = None) -> DataFrame:
    """Per account and edge type: number of entities, and means of their node features.

    Without a given ``fanout`` it is that of the edges, which are read twice and should be a table; what is known of an
    entity of one account is then on its edge, and only shared entities are joined.
    """
    names = ["log_degree", *[f"asn_{a}" for a in ASN_TYPES]]
    if fanout is None:
        nodes = _with_fanout(edges.select("user_id", *ENTITY, "asn_type"), entity_fanout(edges))
    else:
        key = F.concat_ws("|", *ENTITY).alias("_e")
        sizes = fanout.select(key, "fanout", "asn_type")
        nodes = join_unique(edges.select("user_id", *ENTITY, key), sizes, "_e")
    return entity_features(nodes, ["user_id"]).groupBy("user_id", "etype").agg(
        F.count("*").alias("entities"), *[F.avg(c).alias(c) for c in names]
    )


def _with_fanout(edges: DataFrame, fanout: DataFrame, *columns: str) -> DataFrame:
    """Every edge with the fan-out and the network type of its entity, and ``columns`` of ``fanout`` where it is shared.

    ``fanout`` is that of ``edges``. An entity of one account has one edge, with its network type on it, so only shared
    entities go to the join.
    """
    key = F.concat_ws("|", *ENTITY).alias("_e")
    shared = fanout.filter("fanout > 1").select(key, F.col("fanout").alias("_fanout"), F.col("asn_type").alias("_kind"), *columns)
    joined = join_unique(edges.select("user_id", *ENTITY, "asn_type", key), shared, "_e", "left")
    kind = F.when(F.col("_fanout").isNull(), F.col("asn_type")).otherwise(F.col("_kind"))
    return joined.select("user_id", *ENTITY, F.coalesce("_fanout", F.lit(1)).alias("fanout"), kind.alias("asn_type"), *columns)


ETYPES = ("ip", "device", "payment")


# Entities of one account, or of two that are both known from the counting.
FEW = "coalesce(fanout = 1 or (fanout = 2 and hub != far), false)"


def entity_ends(edges: DataFrame) -> DataFrame:
    """(etype, entity_id, fanout, hub, far, kind, node): smallest and largest account of every entity, its network type and,
    if several accounts share it, a number.

    The one grouping of the edges by entity; it is to be written. Rings, neighbourhoods and degrees follow from it, and
    only wider entities are joined with the edges, so only those keep their names. A network type that is not
    one of ``ASN_TYPES`` is NULL.
    """
    ends = edges.groupBy(*ENTITY).agg(
        F.count("*").alias("fanout"), F.min("user_id").alias("hub"), F.max("user_id").alias("far"), F.min(_rank(F.col("asn_type"), ASN_TYPES)).alias("_rank")
    )
    numbered = ends.withColumn("_node", F.monotonically_increasing_id())
    return numbered.select(
        "etype", F.when(~F.expr(FEW), F.col("entity_id")).alias("entity_id"), "fanout", "hub", "far",
        _ranked(F.col("_rank"), ASN_TYPES).alias("kind"), F.when(F.col("fanout") > 1, F.col("_node")).alias("node"),
    )


def wide_edges(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges of entities whose accounts the counting does not tell, as rows of :func:`incident_rows`.

    Those entities are written first: while they are few, the edges are not moved for the join.
    """
    key = F.concat_ws("|", *ENTITY).alias("_e")
    wide = cut_lineage(ends.filter(~F.expr(FEW)).select(key, "node", "fanout", "kind", "hub"), "wide")
    return join_unique(edges.select("user_id", "etype", key), wide, "_e").select("user_id", "etype", "node", "fanout", "kind", "hub")


def incident_rows(ends: DataFrame, wide: DataFrame) -> DataFrame:
    """(user_id, etype, node, fanout, kind, hub) of every edge, from the written tables of ends and of wide edges."""
    rest = ["etype", "node", "fanout", "kind", "hub"]
    one = ends.filter("fanout = 1").select(F.col("hub").alias("user_id"), *rest)
    two = ends.filter("fanout = 2").filter(FEW).select(F.explode(F.array("hub", "far")).alias("user_id"), *rest)
    return union_all([one, two, wide])


def incident_nodes(edges: DataFrame) -> DataFrame:
    """(user_id, etype, node, fanout, kind, hub): every edge with its entity's fan-out, network type, smallest account and,
    if it is shared, number.

    ``edges`` are read twice and should be a table; all that follows works on numbers.
    """
    ends = cut_lineage(entity_ends(edges), "ends")
    return incident_rows(ends, cut_lineage(wide_edges(edges, ends), "wide_edges"))


def incident_links(incident: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """(src, dst): as :func:`component_links`, from edges that carry the smallest account of their entity."""
    return linking_entities(incident, caps).filter("user_id != hub").select(F.col("user_id").alias("src"), F.col("hub").alias("dst"))


def node_profile(incident: DataFrame, etypes: Sequence[str] = ETYPES) -> DataFrame:
    """One row per account, from one combinable pass: per type its entities and their mean log degree, the shares of the
    network types, and the weights of the propagation.

    ``share_t`` is the weight of one entity of type t: types that an account has count alike, and so do the entities of
    one type. ``alone`` is the weight of the entities that no other account has.
    """
    is_t = {t: F.col("etype") == t for t in etypes}
    counts = [F.sum(is_t[t].cast("long")).alias(f"{t}_entities") for t in etypes]
    single = [F.sum((is_t[t] & (F.col("fanout") == 1)).cast("long")).alias(f"_{t}_alone") for t in etypes]
    degrees = [F.avg(F.when(is_t[t], F.log1p("fanout"))).alias(f"{t}_log_degree") for t in etypes]
    kinds = [F.avg(F.when(F.col("etype") == "ip", F.coalesce((F.col("kind") == a).cast("double"), F.lit(0.0)))).alias(f"asn_{a}") for a in ASN_TYPES]
    rows = incident.groupBy("user_id").agg(*counts, *single, *degrees, *kinds)
    present = sum((F.col(f"{t}_entities") > 0).cast("int") for t in etypes)
    rows = rows.withColumns({f"share_{t}": expr.ratio(F.lit(1.0), present * F.col(f"{t}_entities")) for t in etypes})
    alone = sum(F.coalesce(F.col(f"share_{t}") * F.col(f"_{t}_alone"), F.lit(0.0)) for t in etypes)
    return cut_lineage(rows.withColumn("alone", alone).drop(*[f"_{t}_alone" for t in etypes]), "profile")


def propagate_pooled(
    features: DataFrame, incident: DataFrame, profile: DataFrame, cols: Sequence[str], rounds: int = 2, etypes: Sequence[str] = ETYPES
) -> DataFrame:
    """Rounds of account -> entity -> account means, all edge types in one vector.

    Each round appends ``near{r}_{c}`` for every column, so the width grows by the same number of columns a round. An
    entity of one account hands back what that account has, so only shared entities are joined. ``cols`` have no nulls.
    """
    share = F.coalesce(*[F.when(F.col("etype") == t, F.col(f"share_{t}")) for t in etypes])
    shared = join_unique(incident.filter("fanout > 1").select("user_id", "etype", "node"), profile, "user_id")
    pairs = cut_lineage(shared.select("user_id", "node", share.alias("_share")), "pairs")
    own = profile.select("user_id", "alone")
    current = cut_lineage(features.select("user_id", *cols), "round0")
    out = current
    for r in range(1, rounds + 1):
        means = join_unique(pairs, current, "user_id").groupBy("node").agg(*[F.avg(c).alias(c) for c in cols])
        sums = join_unique(pairs, means, "node").groupBy("user_id").agg(*[F.sum(F.col("_share") * F.col(c)).alias(f"_{c}") for c in cols])
        both = own.join(current, "user_id").join(sums, "user_id", "left")
        pooled = both.select("user_id", *[(F.col("alone") * F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in cols])
        current = cut_lineage(pooled, f"round{r}")
        out = out.join(current.withColumnsRenamed({c: f"near{r}_{c}" for c in cols}), "user_id", "left")
    return out
