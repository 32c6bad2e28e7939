"""Motifs from patterns against walks listed one by one, on regular and irregular families."""

from __future__ import annotations

import random

import pytest

from kinloom.operators import kinship as K


def graph(rng, regular):
    people = [f"p{i}" for i in range(40)]
    edges = []
    for i, child in enumerate(people[6:], 6):
        fathers = [people[rng.randrange(min(i, 12))]] if regular else rng.sample(people[:14], rng.randint(0, 2))
        for father in fathers:
            edges.append((father, child, rng.choice(["r_fs", "r_fd"]), 1))
            edges.append((child, father, "r_sib", 1))
        if not regular and rng.random() < 0.2:
            edges.append((child, rng.choice(people), "r_sib", 1))
    for _ in range(25):
        edges.append((*rng.sample(people, 2), "r_hw", 1))
    for person in people:
        for _ in range(rng.randint(0, 3)):
            edges.append((person, f"house{rng.randrange(8)}", "r_hh", rng.randrange(5)))
        edges.append((person, f"banner{rng.randrange(3)}", "r_cb", 0))
    return people, edges


def brute(edges, pattern):
    """{(a, b): number of walks}, every walk listed."""
    links = {}
    for src, dst, rel, _ in edges:
        links.setdefault(rel, set()).add((src, dst))
    families = {}
    for child, family in links.get("r_sib", ()):
        families.setdefault(family, set()).add(child)
    siblings = {(x, y) for own in families.values() for x in own for y in own if x != y}

    def steps(rel, direction):
        if rel == "r_sib":
            return siblings
        ahead = links.get(rel, set())
        behind = {(y, x) for x, y in ahead}
        return ahead | behind if direction == "any" else ahead if direction in ("down", "out") else behind

    nodes = {x for e in edges for x in e[:2]}
    counts = {(x, x): 1 for x in nodes}
    for rel, direction in pattern:
        onward = {}
        for x, y in steps(rel, direction):
            onward.setdefault(x, []).append(y)
        moved = {}
        for (a, x), n in counts.items():
            for y in onward.get(x, ()):
                moved[a, y] = moved.get((a, y), 0) + n
        counts = moved
    return counts


def random_pattern(rng, length):
    kinds = [("r_fs", "up"), ("r_fs", "down"), ("r_fd", "up"), ("r_fd", "down"), ("r_sib", "any"), ("r_hw", "any"), ("r_hw", "out")]
    return tuple(rng.choice(kinds) for _ in range(length))


@pytest.mark.parametrize("regular", [True, False])
def test_named_and_random_patterns_equal_brute_force(spark, regular):
    rng = random.Random(11 if regular else 12)
    people, edges = graph(rng, regular)
    patterns = dict(K.MOTIFS)
    patterns |= {f"random{n}": random_pattern(rng, n) for n in (2, 4, 5)}
    patterns["two_siblings"] = (("r_sib", "any"), ("r_fs", "up"), ("r_sib", "any"))
    pairs = [(a, b) for a in people for b in people]
    found = K.match_motifs(
        spark.createDataFrame(pairs, "h string, w string"), spark.createDataFrame(edges, "src string, dst string, rel string, t int"), motifs=patterns
    )
    rows = {(r["h"], r["w"]): r for r in found.collect()}
    assert set(rows) == set(pairs)
    for name, pattern in patterns.items():
        expected = brute(edges, pattern)
        assert {p: r[name] for p, r in rows.items() if r[name]} == {p: n for p, n in expected.items() if p in rows}, name


def test_one_pattern_and_bad_patterns(spark):
    edges = spark.createDataFrame([("f", "a", "r_fs", 1), ("f", "b", "r_fs", 1), ("a", "f", "r_sib", 1), ("b", "f", "r_sib", 1)], "src string, dst string, rel string, t int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "h string, w string")
    got = K.match_motif(pairs, edges, [("r_fs", "up"), ("r_fs", "down")], name="shared")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a", 1), ("a", "b", 1)]
    assert sorted(tuple(r) for r in K.match_motif(pairs, edges, [("r_sib", "any")]).collect()) == [("a", "a", 0), ("a", "b", 1)]
    for bad in ((), (("r_fs", "sideways"),)):
        with pytest.raises(ValueError):
            K.match_motif(pairs, edges, bad)
