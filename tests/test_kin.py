"""Lineage, kin paths and motifs against brute force over explicit neighbour sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import kinship as K


def edges(spark, data):
    return spark.createDataFrame(data, "src string, dst string, rel string, t int")


@pytest.fixture(scope="module")
def village(spark):
    """40 people in generations, one father with a third of all children."""
    rng = random.Random(11)
    father, sex = {}, {i: rng.choice([1, 2, 2, None]) for i in range(40)}
    for i in range(6, 40):
        father[i] = 2 if i % 3 == 0 else rng.randrange(0, i // 2)
    data = []
    for child, dad in father.items():
        data.append((str(child), str(dad), "r_sib", 1800 + child))
        if sex[child]:
            data.append((str(dad), str(child), "r_fs" if sex[child] == 2 else "r_fd", 1800 + child))
    for i in range(40):
        for h in {rng.randrange(8) for _ in range(2)}:
            data += [(str(i), f"h{h}", "r_hh", 1800)] * rng.randrange(1, 3)
        data.append((str(i), f"b{i % 3}", "r_cb", 0))
    for _ in range(25):
        a, b = rng.sample(range(40), 2)
        data.append((str(a), str(b), "r_hw", 1850))
    return data


def explicit(data):
    """Directed edge list with all sibling pairs."""
    sib = [(s, d) for s, d, r, _ in data if r == "r_sib"]
    pp = [(s, d, r) for s, d, r, _ in data if r in ("r_fs", "r_fd")]
    pp += [(a, b, "r_sib") for a, fa in sib for b, fb in sib if fa == fb and a != b]
    return pp


def all_pairs(spark):
    return spark.createDataFrame([(str(a), str(b)) for a in range(40) for b in range(40)], "h string, w string")


def test_paths_and_walks_equal_brute_force(spark, village):
    pp = explicit(village)
    nbr = {str(i): set() for i in range(40)}
    mult = {}
    for s, d, _ in pp:
        nbr[s].add(d)
        nbr[d].add(s)
        mult[s, d] = mult.get((s, d), 0) + 1
        mult[d, s] = mult.get((d, s), 0) + 1
    member = {}
    for s, d, r, _ in village:
        if r in ("r_hh", "r_cb"):
            member[s, d] = member.get((s, d), 0) + 1
    groups = {g for _, g in member}
    e = edges(spark, village)
    paths = {(r["h"], r["w"]): r["patri_path_count"] for r in K.kin_path_count(all_pairs(spark), e).collect()}
    walks = {(r["h"], r["w"]): r["n_walks"] for r in K.walk_count_upto2(all_pairs(spark), e).collect()}
    for a in nbr:
        for b in nbr:
            if a == b:
                assert paths[a, b] == 0 and walks[a, b] == 0
                continue
            house = any((a, g) in member and (b, g) in member for g in groups if g.startswith("h"))
            assert paths[a, b] == (b in nbr[a]) + len(nbr[a] & nbr[b]) + house, (a, b)
            two = sum(mult.get((a, z), 0) * mult.get((z, b), 0) for z in nbr)
            shared = sum(member.get((a, g), 0) * member.get((b, g), 0) for g in groups)
            assert walks[a, b] == mult.get((a, b), 0) + two + shared, (a, b)


def test_motifs_equal_brute_force(spark, village):
    pp = explicit(village)
    dads = {d: s for s, d, r in pp if r == "r_fs"}
    sib = {}
    for s, d, r in pp:
        if r == "r_sib":
            sib.setdefault(s, set()).add(d)
    daughters = {}
    for s, d, r in pp:
        if r == "r_fd":
            daughters.setdefault(s, set()).add(d)
    couples = {(s, d) for s, d, r, _ in village if r == "r_hw"} | {(d, s) for s, d, r, _ in village if r == "r_hw"}
    for r in K.match_motifs(all_pairs(spark), edges(spark, village)).collect():
        uncles = sib.get(dads.get(r["h"]), set())
        assert r["m1_father_brother"] == sum((u, r["w"]) in couples for u in uncles)
        assert r["m2_uncle_in_law"] == sum((c, r["w"]) in couples for u in uncles for c in daughters.get(u, ()))


def test_roots_lines_cycles_and_depth(spark, rows):
    chain = [(str(i), str(i + 1)) for i in range(100)]  # i has parent i + 1
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")]
    parents = spark.createDataFrame(chain + cycle, "id string, parent string")
    nodes = spark.createDataFrame([(str(i),) for i in range(101)] + [("a",), ("b",), ("c",), ("x",), ("alone",)], "id string")
    got = {r["id"]: (r["root"], r["depth"]) for r in K.root_ancestor(parents, nodes).collect()}
    assert got["alone"] == ("alone", 0)
    assert got["90"] == ("100", 10) and got["36"] == ("100", 64)
    assert got["0"] == ("100", 100)
    cut = {r["id"]: (r["root"], r["depth"]) for r in K.root_ancestor(parents, nodes, max_steps=64).collect()}
    assert cut["0"] == ("64", 64)  # a walk that is told to end after 64 steps
    assert {got[i][0] for i in "abcx"} == {"a"}
    unknown = K.root_ancestor(parents, nodes, unknown_if_rootless=True).where("id = 'alone'").first()
    assert unknown["root"] is None


def test_first_parent_prefers_the_first_relation(spark, rows):
    e = edges(spark, [("p2", "c", "r_fd", 1), ("p9", "c", "r_fs", 1), ("p1", "d", "r_fd", 1)])
    assert rows(K.first_parent(e)) == [("c", "p9"), ("d", "p1")]


def test_lineage_tag_is_stable_and_bounded(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("root"))
    tags = [r["lineage"] for r in K.lineage_tags(ids).collect()]
    assert all(len(t) == 4 and t[0] == "L" for t in tags) and len(set(tags)) > 800


def test_several_fathers_and_families_equal_brute_force(spark, village):
    data = list(village)
    rng = random.Random(5)
    for child in (7, 9, 12, 20, 21):
        dads = [d for d in rng.sample(range(40), 3) if d != child]
        data += [(str(d), str(child), "r_fs", 1900) for d in dads] + [(str(child), str(d), "r_sib", 1900) for d in dads[:2]]
    data += [("30", "30", "r_fs", 1900), ("30", "30", "r_sib", 1900), ("35", "36", "r_fd", 1900), ("36", "35", "r_fs", 1900)]
    data += [("2", "9", "r_fd", 1901), ("9", "2", "r_sib", 1901)]
    people = [str(i) for i in range(40)]
    pp = {(s, d, r) for s, d, r, _ in data if r in ("r_fs", "r_fd")}
    families = [(s, d) for s, d, r, _ in data if r == "r_sib"]
    sib = {(x, y) for x, f in families for y, g in families if f == g and x != y}
    nbr = {p: {d for s, d, _ in pp if s == p} | {s for s, d, _ in pp if d == p} | {y for x, y in sib if x == p} for p in people}
    homes = {p: {d for s, d, r, _ in data if r == "r_hh" and s == p} for p in people}
    couples = {(s, d) for s, d, r, _ in data if r == "r_hw"} | {(d, s) for s, d, r, _ in data if r == "r_hw"}
    mult = {}
    for s, d in [(s, d) for s, d, r, _ in data if r in ("r_fs", "r_fd")]:
        mult[s, d] = mult.get((s, d), 0) + 1
        mult[d, s] = mult.get((d, s), 0) + 1
    for x, f in families:
        for y, g in families:
            if f == g and x != y:
                mult[x, y] = mult.get((x, y), 0) + 2
    e, asked = edges(spark, data), all_pairs(spark)
    linked = {(r["h"], r["w"]): r["direct_link"] for r in K.direct_link(asked, e).collect()}
    common = {(r["h"], r["w"]): r["n_common"] for r in K.common_neighbors(asked, e).collect()}
    paths = {(r["h"], r["w"]): r["patri_path_count"] for r in K.kin_path_count(asked, e).collect()}
    plain = e.where(~F.col("rel").isin("r_hh", "r_cb"))
    walks = {(r["h"], r["w"]): r["n_walks"] for r in K.walk_count_upto2(asked, plain).collect()}
    for a in people:
        for b in people:
            if a != b:
                n = len(nbr[a] & nbr[b])
                assert linked[a, b] == (b in nbr[a]) and common[a, b] == n, (a, b)
                assert paths[a, b] == (b in nbr[a]) + n + bool(homes[a] & homes[b]), (a, b)
                assert walks[a, b] == mult.get((a, b), 0) + sum(mult.get((a, z), 0) * mult.get((z, b), 0) for z in people), (a, b)
    found = K.match_motifs(asked, e).collect()
    assert len(found) == 1600
    for r in found:
        uncles = [(d, y) for d, c, rel in pp if rel == "r_fs" and c == r["h"] for x, y in sib if x == d]
        assert r["m1_father_brother"] == sum((u, r["w"]) in couples for _, u in uncles)
        assert r["m2_uncle_in_law"] == sum((c, r["w"]) in couples for _, u in uncles for s, c, rel in pp if rel == "r_fd" and s == u)
