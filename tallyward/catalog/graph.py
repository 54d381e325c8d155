"""Shared-infrastructure graph, rings, and neighbourhood means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import canon
from tallyward.catalog.registry import BOOL, DBL, INT, TXT, query, sql
from tallyward.operators import evaluate
from tallyward.operators import graph as g
from tallyward.session import cut_lineage
from tallyward.sources import star
from tallyward.sources.schema import ASN_TYPES


def edges(spark, d):
    return g.entity_edges(star.purchase_edges(spark, d), star.people(spark, d), ASN_TYPES)


def edge_table(spark, d, *columns):
    """Columns of the edges, written: for queries that read them several times."""
    return cut_lineage(edges(spark, d).select(*columns), "edges")


def line_edges(spark, d):
    return g.entity_edges(star.shared_lines(spark, d))


@query(
    "entity_edges",
    sql(
        canon.EDGES, "SELECT user_id, etype, entity_id, weight, asn_type FROM edges",
        user_id=INT, etype=TXT, entity_id=TXT, weight=INT, asn_type=TXT,
    ),
)
def entity_edges(spark, d):
    return edges(spark, d)


@query(
    "entity_fanout",
    sql(
        canon.EDGES,
        """SELECT etype, entity_id, count(DISTINCT user_id) AS fanout, min(user_id) AS hub, min(asn_type) AS asn_type
           FROM edges GROUP BY 1, 2""",
        etype=TXT, entity_id=TXT, fanout=INT, hub=INT, asn_type=TXT,
    ),
)
def entity_fanout(spark, d):
    return g.entity_fanout(edges(spark, d))


@query(
    "line_fanout_over_cap",
    sql(
        f"{canon.LINE_EDGES}, {canon.LINKS}",
        "SELECT 'ip' AS etype, 10 AS cap, count(*) AS excluded FROM fanout WHERE fanout > 10",
        etype=TXT, cap=INT, excluded=INT,
    ),
)
def line_fanout_over_cap(spark, d):
    return g.over_cap(g.entity_fanout(line_edges(spark, d)))


@query(
    "capped_links",
    sql(
        f"{canon.LINE_EDGES}, {canon.LINKS}", "SELECT etype, entity_id, src, dst FROM links",
        etype=TXT, entity_id=TXT, src=INT, dst=INT,
    ),
)
def capped_links(spark, d):
    e = line_edges(spark, d)
    return g.star_links(e, g.linking_entities(g.entity_fanout(e)))


@query(
    "link_counts",
    sql(
        f"{canon.EDGES}, {canon.LINKS}",
        "SELECT etype, count(*) AS entities, sum(fanout - 1) AS links FROM linking GROUP BY 1",
        etype=TXT, entities=INT, links=INT,
    ),
)
def link_counts(spark, d):
    return g.link_counts(g.linking_entities(g.entity_fanout(edges(spark, d))))


@query(
    "components",
    sql(
        f"{canon.EDGES}, {canon.LINKS}, {canon.COMPONENTS}", "SELECT id, component_id FROM components",
        id=INT, component_id=INT,
    ),
)
def components(spark, d):
    return g.account_components(edges(spark, d))


@query(
    "components_uncapped",
    sql(
        f"{canon.EDGES}, {canon.LINKS.replace(canon.CAP, '')}, {canon.COMPONENTS}", "SELECT id, component_id FROM components",
        id=INT, component_id=INT,
    ),
)
def components_uncapped(spark, d):
    """Links through entities of any fan-out; an entity adds one link per account, so no cap is needed for size."""
    return g.account_components(edges(spark, d), caps={})


@query(
    "line_components",
    sql(
        f"{canon.LINE_EDGES}, {canon.LINKS}, {canon.COMPONENTS}", "SELECT id, component_id FROM components",
        id=INT, component_id=INT,
    ),
)
def line_components(spark, d):
    return g.account_components(line_edges(spark, d))


RING_CTES = f"{canon.EDGES}, {canon.LINKS}, {canon.COMPONENTS}, {canon.RINGS}"


@query(
    "ring_flags",
    sql(
        RING_CTES, "SELECT user_id, label, component_id, component_size, ring_flag FROM rings",
        user_id=INT, label=TXT, component_id=INT, component_size=INT, ring_flag=BOOL,
    ),
)
def ring_flags(spark, d):
    return g.ring_flags(star.people(spark, d), components(spark, d))


@query(
    "ring_report",
    sql(
        RING_CTES + """, lab AS (SELECT component_id, label, count(*) AS n FROM rings WHERE component_size >= 5 GROUP BY 1, 2),
        best AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY n DESC, label) AS r FROM lab)""",
        """SELECT component_id, sum(n) AS size,
             100.0 * sum(CASE WHEN label IN ('account_farmer', 'spam_bot') THEN n ELSE 0 END) / sum(n) AS pct_abusive,
             max(CASE WHEN r = 1 THEN label END) AS dominant_label
           FROM best GROUP BY 1 ORDER BY size DESC, component_id LIMIT 10""",
        component_id=INT, size=INT, pct_abusive=DBL, dominant_label=TXT,
    ),
)
def ring_report(spark, d):
    return g.ring_report(ring_flags(spark, d))


QUALITY = dict(tp=INT, flagged=INT, targets=INT, precision=DBL, recall=DBL)


@query(
    "ring_quality",
    sql(
        RING_CTES,
        """SELECT tp, flagged, targets, tp / greatest(flagged, 1) AS precision, tp / greatest(targets, 1) AS recall FROM (
             SELECT count(*) FILTER (ring_flag AND bad) AS tp, count(*) FILTER (ring_flag) AS flagged,
               count(*) FILTER (bad) AS targets
             FROM (SELECT *, label IN ('account_farmer', 'spam_bot') AS bad FROM rings))""",
        **QUALITY,
    ),
)
def ring_quality(spark, d):
    return evaluate.flag_quality(ring_flags(spark, d), "ring_flag", F.col("label").isin(g.COORDINATED))


@query(
    "ring_by_label",
    sql(
        RING_CTES,
        """SELECT label, count(*) FILTER (ring_flag) AS flagged, count(*) AS accounts,
             count(*) FILTER (ring_flag) / count(*) AS share FROM rings GROUP BY 1""",
        label=TXT, flagged=INT, accounts=INT, share=DBL,
    ),
)
def ring_by_label(spark, d):
    return evaluate.flag_by_label(ring_flags(spark, d), "ring_flag")


@query(
    "component_sizes",
    sql(
        f"{canon.LINE_EDGES}, {canon.LINKS}, {canon.COMPONENTS}",
        "SELECT size, count(*) AS components FROM (SELECT component_id, count(*) AS size FROM components GROUP BY 1) GROUP BY 1",
        size=INT, components=INT,
    ),
)
def component_sizes(spark, d):
    sizes = line_components(spark, d).groupBy("component_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


@query(
    "entity_node_features",
    sql(
        f"{canon.EDGES}, {canon.LINKS}, kinds AS (SELECT etype, entity_id, min(asn_type) AS asn_type FROM edges GROUP BY 1, 2)",
        "SELECT user_id, etype, count(*) AS entities, avg(ln(1 + fanout)) AS log_degree, "
        + ", ".join(
            f"avg(CASE WHEN k.asn_type = '{a}' THEN 1.0 ELSE 0.0 END) AS asn_{a}"
            for a in ("residential", "mobile", "datacenter", "university", "corporate")
        )
        + " FROM edges e JOIN fanout USING (etype, entity_id) JOIN kinds k USING (etype, entity_id) GROUP BY 1, 2",
        user_id=INT, etype=TXT, entities=INT, log_degree=DBL,
        **{f"asn_{a}": DBL for a in ("residential", "mobile", "datacenter", "university", "corporate")},
    ),
)
def entity_node_features(spark, d):
    e = edge_table(spark, d, "user_id", *g.ENTITY, "asn_type")
    return g.neighbour_degrees(e)


def _means(round_: int, source: str, etype: str, cols: list[str]) -> str:
    tag = f"{etype}{round_}"
    pick = ", ".join(f"avg({c}) AS {c}" for c in cols)
    back = ", ".join(f"avg({c}) AS {tag}_{c}" for c in cols)
    return f"""
{tag}_e AS (SELECT entity_id, {pick} FROM pairs JOIN {source} USING (user_id) WHERE etype = '{etype}' GROUP BY 1),
{tag} AS (SELECT user_id, {back} FROM pairs JOIN {tag}_e USING (entity_id) WHERE etype = '{etype}' GROUP BY 1)"""


KINDS = ["ip", "device", "payment"]
ONE = [f"{t}1_{c}" for t in KINDS for c in ("balance", "flag")]
TWO = [f"{t}2_{c}" for t in KINDS for c in ONE]
OWN = """own AS (SELECT c_custkey AS user_id, ln(10000 + c_acctbal) AS balance,
  CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END AS flag FROM customer)"""


@query(
    "neighbor_means",
    sql(
        f"{canon.EDGES}, {OWN}, pairs AS (SELECT DISTINCT user_id, etype, entity_id FROM edges), "
        + ", ".join(_means(1, "own", t, ["balance", "flag"]) for t in KINDS)
        + ", first AS (SELECT * FROM own LEFT JOIN ip1 USING (user_id) LEFT JOIN device1 USING (user_id) LEFT JOIN payment1 USING (user_id)), "
        + ", ".join(_means(2, "first", t, ONE) for t in KINDS),
        "SELECT * FROM first LEFT JOIN ip2 USING (user_id) LEFT JOIN device2 USING (user_id) LEFT JOIN payment2 USING (user_id)",
        user_id=INT, **{c: DBL for c in ["balance", "flag", *ONE, *TWO]},
    ),
)
def neighbor_means(spark, d):
    own = star.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.log(F.col("c_acctbal") + 10000).alias("balance"),
        (F.col("c_acctbal") < 0).cast("double").alias("flag"),
    )
    return g.propagate(own, edges(spark, d), ["balance", "flag"], rounds=2)


def _pooled(round_: int, source: str, name: str, before: str) -> str:
    cols = ("balance", "flag")
    return f"""
e{round_} AS (SELECT etype, entity_id, {", ".join(f"avg({before}{c}) AS {c}" for c in cols)} FROM shares JOIN {source} USING (user_id) GROUP BY 1, 2),
{name} AS (SELECT user_id, {", ".join(f"sum(share * {c}) AS near{round_}_{c}" for c in cols)} FROM shares JOIN e{round_} USING (etype, entity_id) GROUP BY 1)"""


POOLED = [f"near{r}_{c}" for r in (1, 2) for c in ("balance", "flag")]
SHAPES = ["ip_entities", "device_entities", "payment_entities", "ip_log_degree", "device_log_degree", "payment_log_degree", "asn_datacenter"]


@query(
    "pooled_neighbors",
    sql(
        f"""{canon.EDGES}, {canon.LINKS}, {OWN}, kinds AS (SELECT etype, entity_id, min(asn_type) AS asn_type FROM edges GROUP BY 1, 2),
        sized AS (SELECT user_id, etype, entity_id, count(*) OVER (PARTITION BY user_id, etype) AS n FROM edges),
        shares AS (SELECT s.*, 1.0 / (n * k) AS share FROM sized s JOIN (SELECT user_id, count(DISTINCT etype) AS k FROM edges GROUP BY 1) USING (user_id)),
        shape AS (SELECT user_id, {", ".join(f"count(*) FILTER (etype = '{t}') AS {t}_entities, avg(ln(1 + fanout)) FILTER (etype = '{t}') AS {t}_log_degree" for t in KINDS)},
          avg(CASE WHEN k.asn_type = 'datacenter' THEN 1.0 ELSE 0.0 END) FILTER (etype = 'ip') AS asn_datacenter
          FROM edges JOIN fanout USING (etype, entity_id) JOIN kinds k USING (etype, entity_id) GROUP BY 1), """
        + _pooled(1, "own", "near1", "")
        + ","
        + _pooled(2, "near1", "near2", "near1_"),
        "SELECT * FROM own LEFT JOIN near1 USING (user_id) LEFT JOIN near2 USING (user_id) LEFT JOIN shape USING (user_id)",
        user_id=INT, balance=DBL, flag=DBL, **{c: DBL for c in POOLED}, **{c: INT if c.endswith("entities") else DBL for c in SHAPES},
    ),
)
def pooled_neighbors(spark, d):
    """Two rounds over all edge types, and the shape of each account's neighbourhood."""
    own = star.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.log(F.col("c_acctbal") + 10000).alias("balance"), (F.col("c_acctbal") < 0).cast("double").alias("flag")
    )
    incident = g.incident_nodes(edge_table(spark, d, "user_id", *g.ENTITY, "asn_type"))
    profile = g.node_profile(incident)
    around = g.propagate_pooled(own, incident, profile, ["balance", "flag"], rounds=2)
    return around.join(profile.select("user_id", *SHAPES), "user_id", "left")
