import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import graph as g
from tallyward.operators.components import connected_components
from tests.fixtures import account, accounts, event, events


def labels(df):
    return {r.id: r.component_id for r in df.collect()}


def by_search(edges):
    """Smallest vertex reachable from each vertex, breadth first."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            out |= dict.fromkeys(todo, start)
            todo = [y for x in todo for y in near[x] if y not in out]
            todo = list(dict.fromkeys(todo))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(chain)
    assert labels(connected_components(frame(spark, chain))) == {i: 0 for i in range(301)}


def test_random_graph_with_a_hub(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(7, 1000 + i) for i in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    want = by_search(edges)
    assert labels(connected_components(frame(spark, edges))) == want
    assert labels(connected_components(frame(spark, edges).repartition(5), chunk=40)) == want  # many local forests


def test_string_ids_and_no_edges(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert labels(connected_components(df)) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert labels(connected_components(df.filter("src = 'none'"))) == {}


@pytest.fixture(scope="module")
def world(spark):
    log = []
    n = 0
    for u in range(1, 12):  # ip_wide: 11 accounts, ip_ok: 10 accounts
        for ip in ["ip_wide"] + (["ip_ok"] if 2 <= u else []):
            n += 1
            log.append(event(n, u, n, ip=ip, device_fp=f"own{u}"))
    for u in range(20, 31):  # one device on 11 accounts, on their own IPs
        n += 1
        log.append(event(n, u, n, ip=f"ip{u}", device_fp="farm"))
    for u in (40, 41, 42, 43):  # component of four by payment
        n += 1
        log.append(event(n, u, n, ip=f"ip{u}", device_fp=f"own{u}"))
    pay = {40: "p1", 41: "p1", 42: "p1", 43: "p1"}
    users = [*range(1, 12), *range(20, 31), *pay, 50, 51]
    people = accounts(
        spark, *[account(u, "account_farmer" if u >= 20 else "normal", payment_hash=pay.get(u)) for u in users]
    )
    return g.entity_edges(events(spark, *log), people), people


def test_fanout_and_cap(world):
    edges, _ = world
    fan = g.entity_fanout(edges)
    got = {(r.etype, r.entity_id): r.fanout for r in fan.filter("fanout > 1").collect()}
    assert got == {("ip", "ip_wide"): 11, ("ip", "ip_ok"): 10, ("device", "farm"): 11, ("payment", "p1"): 4}
    assert {(r.etype, r.entity_id) for r in g.linking_entities(fan).collect()} == {
        ("ip", "ip_ok"), ("device", "farm"), ("payment", "p1"),
    }
    assert g.over_cap(fan).first().excluded == 1
    links = {r.etype: r.links for r in g.link_counts(g.linking_entities(fan)).collect()}
    assert links == {"ip": 9, "device": 10, "payment": 3}


def test_star_links_are_one_per_member(world):
    edges, _ = world
    entities = g.linking_entities(g.entity_fanout(edges))
    plain = sorted(map(tuple, g.star_links(edges, entities).collect()))
    assert len(plain) == 9 + 10 + 3 and all(src != dst for *_, src, dst in plain)


def test_ring_flags_and_report(world):
    edges, people = world
    flags = g.ring_flags(people, g.account_components(edges)).persist()
    got = {r.user_id: (r.component_id, r.component_size, r.ring_flag) for r in flags.collect()}
    assert got[1] == (1, 1, False)  # only the over-cap IP
    assert got[2] == (2, 10, True) and got[11] == (2, 10, True)
    assert got[25] == (20, 11, True)
    assert got[43] == (40, 4, False)  # one below the ring size
    assert got[50] == (50, 1, False) and got[51] == (51, 1, False)  # two missing payments do not link
    report = [tuple(r) for r in g.ring_report(flags).collect()]
    assert report == [(20, 11, 100.0, "account_farmer"), (2, 10, 0.0, "normal")]


def test_propagation_by_hand(spark):
    edges = spark.createDataFrame(
        [(1, "device", "d"), (2, "device", "d"), (2, "ip", "i"), (3, "ip", "i"), (3, "ip", "j")],
        "user_id long, etype string, entity_id string",
    )
    x = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 8.0)], "user_id long, x double")
    got = {r.user_id: (r.x, r.ip1_x, r.device1_x, r.payment1_x) for r in g.propagate(x, edges, ["x"]).collect()}
    # account 3: entity i averages 5.5, entity j averages 8
    assert got == {1: (1.0, None, 2.0, None), 2: (3.0, 5.5, 2.0, None), 3: (8.0, 6.75, None, None)}
    two = {r.user_id: r.ip2_device1_x for r in g.propagate(x, edges, ["x"], rounds=2).collect()}
    assert two[3] == 2.0  # reached over account 2


def test_pooled_propagation_equals_brute_force(spark):
    """Two rounds over three types; entities of one account, a shared one of most accounts, and an account without edges."""
    rnd = random.Random(5)
    links = {(u, t, f"{t}{rnd.randrange(n)}") for u in range(40) for t, n in (("ip", 200), ("device", 25), ("payment", 4)) for _ in range(rnd.randrange(3))}
    x = {u: float(rnd.randrange(9)) for u in range(41)}
    edges = spark.createDataFrame(sorted(links), "user_id long, etype string, entity_id string").withColumn("asn_type", F.lit("mobile"))
    incident = g.incident_nodes(edges)
    profile = g.node_profile(incident)
    got = g.propagate_pooled(spark.createDataFrame(sorted(x.items()), "user_id long, x double"), incident, profile, ["x"], rounds=2)
    assert got.columns == ["user_id", "x", "near1_x", "near2_x"]  # the width grows by the same number a round
    values, rounds = dict(x), []
    for _ in range(2):
        by_node = {n: [values[u] for u, *e in links if tuple(e) == n] for n in {e[1:] for e in links}}
        mean = {n: sum(v) / len(v) for n, v in by_node.items()}
        new = {}
        for u in {e[0] for e in links}:
            types = [[mean[e[1:]] for e in links if e[0] == u and e[1] == t] for t in g.ETYPES]
            found = [sum(v) / len(v) for v in types if v]
            new[u] = sum(found) / len(found)
        rounds.append(new)
        values = new
    for r in got.collect():
        for k in (0, 1):
            assert r[2 + k] == (pytest.approx(rounds[k][r.user_id]) if r.user_id in rounds[k] else None)
    shape = {r.user_id: (r.ip_entities, r.asn_mobile, r.asn_datacenter) for r in profile.collect()}
    for u, (n, mobile, other) in shape.items():
        assert n == sum(e[0] == u and e[1] == "ip" for e in links) and (mobile, other) == ((1.0, 0.0) if n else (None, None))


def test_entity_features(spark):
    log = events(spark, event(1, 1, 0, asn_type="mobile"), event(2, 2, 0, asn_type="mobile"))
    r = g.entity_features(g.entity_fanout(g.entity_edges(log))).filter("etype = 'ip'").first()
    assert r.asn_mobile == 1.0 and r.asn_datacenter == 0.0 and r.log_degree == pytest.approx(1.0986122886681098)


def test_components_ignore_row_order(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(80), 100 + rnd.randrange(80)) for _ in range(70)]
    a = labels(connected_components(frame(spark, edges)))
    b = labels(connected_components(frame(spark, edges[::-1]).repartition(7, F.col("dst"))))
    assert a == b == by_search(edges)


@pytest.fixture(scope="module")
def mixed_links(spark):
    """Edges of three types: many entities of one account, some of several, one without a network type."""
    rnd = random.Random(11)
    links = sorted({(u, t, f"{t}{rnd.randrange(n)}") for u in range(30) for t, n in (("ip", 60), ("device", 25), ("payment", 90)) for _ in range(rnd.randrange(4))})
    rows = [(u, t, e, None if e == "ip3" else ["mobile", "corporate"][u % 2]) for u, t, e in links]
    return links, spark.createDataFrame(rows, "user_id long, etype string, entity_id string, asn_type string")


def test_only_shared_entities_are_joined(mixed_links):
    """Entities of one account get no number and no place in a join; what is known of them is on their edge."""
    links, edges = mixed_links
    users = {}
    for u, *e in links:
        users.setdefault(tuple(e), set()).add(u)
    got = [(r.user_id, r.etype, r.node, r.fanout) for r in g.incident_nodes(edges).collect()]
    assert sum(node is None for *_, node, _ in got) == sum(len(v) == 1 for v in users.values())
    assert all((node is None) == (fanout == 1) for *_, node, fanout in got)
    plain = sorted(g.neighbour_degrees(edges, g.entity_fanout(edges)).collect())
    alone = sorted(g.neighbour_degrees(edges).collect())
    assert [tuple(r) for r in alone] == [pytest.approx(tuple(r)) for r in plain] and len(plain) > 40


def test_propagation_with_single_entities_equals_brute_force(spark, mixed_links):
    """Missing values, and an account that has edges but no row."""
    links, edges = mixed_links
    x = {u: None if u % 7 == 0 else float(u % 9) for u in range(29)}
    got = {r.user_id: r for r in g.propagate(spark.createDataFrame(sorted(x.items()), "user_id long, x double"), edges, ["x"], rounds=2).collect()}
    values = {u: {"x": v} for u, v in x.items()}
    mean = lambda v: sum(v) / len(v) if (v := [a for a in v if a is not None]) else None
    for r in (1, 2):
        new = {u: {} for u in x}
        for c in values[0]:
            entity = {e: mean([values[u][c] for u, *f in links if tuple(f) == e and u in x]) for e in {tuple(f) for _, *f in links}}
            for u in x:
                for t in g.ETYPES:
                    new[u][f"{t}{r}_{c}"] = mean([entity[tuple(f)] for v, *f in links if v == u and f[0] == t])
        values = new
        for u in x:
            for name, want in new[u].items():
                assert got[u][name] == (None if want is None else pytest.approx(want)), (u, name)


def test_edges_of_entities_of_two_accounts_are_not_joined(spark, mixed_links, monkeypatch):
    """Components by search over all linking entities, with and without the cap; only wider entities reach the join."""
    links, edges = mixed_links
    users = {}
    for u, *e in links:
        users.setdefault(tuple(e), set()).add(u)
    joined, whole = [], g.star_links

    def noted(pairs, entities):
        joined.extend((r.etype, r.entity_id) for r in entities.collect())
        return whole(pairs, entities)

    monkeypatch.setattr(g, "star_links", noted)
    for caps in ({}, {"device": 3}, {"ip": 1, "device": 2}):
        joined.clear()
        linking = {e: sorted(v) for e, v in users.items() if 2 <= len(v) <= caps.get(e[0], 99)}
        want = by_search([(a, v[0]) for v in linking.values() for a in v[1:]])
        for stored in (False, True):
            assert labels(g.account_components(edges, caps, stored)) == want
        assert set(joined) == {e for e, v in linking.items() if len(v) > 2} and any(len(v) == 2 for v in linking.values())


def test_flags_do_not_read_the_orders(spark, sf):
    from tallyward.sources import star

    whole, without = star.accounts(spark, sf), star.people(spark, sf)
    assert not any("orders" in f for f in without.inputFiles()) and any("orders" in f for f in whole.inputFiles())
    assert sorted(map(repr, whole.drop("created_at").collect())) == sorted(map(repr, without.collect()))


def test_edges_are_grouped_by_entity_once(spark, mixed_links):
    """Every edge follows from the counts or from the join of wide entities, with accounts that are missing or come twice."""
    _, edges = mixed_links
    odd = [(None, "ip", "a", "mobile"), (1, "ip", "a", None), (None, "ip", "b", None), (2, "device", "c", "mobile"), (2, "device", "c", "mobile"), (3, "ip", "d", "unheard"), (4, "ip", "d", "corporate")]
    edges = edges.unionByName(spark.createDataFrame(odd, edges.schema))
    rows, users, kinds = edges.collect(), {}, {}
    for r in rows:
        users.setdefault((r.etype, r.entity_id), []).append(r.user_id)
        kinds.setdefault((r.etype, r.entity_id), []).append(r.asn_type)
    smallest = lambda v: min((x for x in v if x is not None), default=None)
    wanted = [(r.user_id, r.etype, len(e := users[r.etype, r.entity_id]), smallest(e), smallest(kinds[r.etype, r.entity_id])) for r in rows]
    incident = g.incident_nodes(edges)
    got = [(r.user_id, r.etype, r.fanout, r.hub, r.kind) for r in incident.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert {r.entity_id is None for r in g.entity_ends(edges).filter(g.FEW).collect()} == {True}
    for caps in ({}, {"ip": 2, "device": 4}):
        assert labels(connected_components(g.incident_links(incident, caps))) == labels(g.account_components(edges, caps))


def test_edges_are_merged_by_hashing(spark):
    """With the names of the network types no text is an aggregate; the edges are the same, and other names are refused."""
    log = events(spark, *[event(i, i % 3, i, ip=f"ip{i % 2}", asn_type=["mobile", "corporate", None][i % 5 % 3]) for i in range(30)])
    plain, hashed = g.entity_edges(log), g.entity_edges(log, names=g.ASN_TYPES)
    assert sorted(map(repr, hashed.collect())) == sorted(map(repr, plain.collect())) and plain.schema == hashed.schema
    for df in (hashed, g.entity_ends(plain.select("user_id", *g.ENTITY, "asn_type").localCheckpoint())):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="unheard"):
        g.entity_edges(events(spark, event(1, 1, 0, asn_type="unheard")), names=g.ASN_TYPES).collect()
