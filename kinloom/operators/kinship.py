"""Lineage, kin paths and motifs for given pairs.

Every person has at most one known father, so the kin neighbourhood of a person is the
father, the children, and the other children of the father. For a given pair the size of
the common neighbourhood follows from a handful of per-person facts (father, grandfather,
family sizes), looked up by two joins. No neighbour lists are built or intersected, so
neither a prolific father nor a person in many pairs makes the work explode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.session import settle

PATERNAL = ("r_fs", "r_fd")


# -- lineage --------------------------------------------------------------------------


def first_parent(edges: DataFrame, relations: Sequence[str] = PATERNAL) -> DataFrame:
    """One parent per child: the first relation wins, then the smallest parent id."""
    rank = F.lit(len(relations))
    for i, rel in reversed(list(enumerate(relations))):
        rank = F.when(F.col("rel") == rel, F.lit(i)).otherwise(rank)
    used = edges.where(F.col("rel").isin(list(relations)))
    return used.groupBy(F.col("dst").alias("id")).agg(
        F.min_by("src", F.struct(rank.alias("r"), F.col("src"))).alias("parent")
    )


def root_ancestor(
    parents: DataFrame,
    nodes: DataFrame,
    max_steps: int | None = None,
    unknown_if_rootless: bool = False,
) -> DataFrame:
    """Most ancient ancestor per node, by pointer doubling.

    Round r knows the ancestor 2^r steps up; rounds end when nobody moves, or when as many
    steps are known as there are nodes (that happens on cycles only). ``max_steps`` (a power of
    two) cuts the walk on purpose: the root is then the ancestor so far. A node with
    no parent is its own root (or NULL with ``unknown_if_rootless``). On a parent cycle
    all members, and everybody below them, get the smallest id of the cycle. Returns
    (id, root, depth), depth being the number of steps walked.
    """
    base = nodes.select("id").join(parents, "id", "left")
    top = F.coalesce("parent", "id")
    # up: the ancestor `steps` steps away; low / high: smallest and greatest id on the way.
    state = base.select(
        "id",
        top.alias("up"),
        F.col("parent").isNotNull().cast("int").alias("steps"),
        F.least(top, F.col("id")).alias("low"),
        F.greatest(top, F.col("id")).alias("high"),
    )

    def renamed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    walked, limit = 1, max_steps or max(1, base.count())
    state, moved = settle(state), True
    while moved and walked < limit:
        state = state.join(renamed(state, "_"), F.col("up") == F.col("_id"), "left").select(
            "id",
            F.coalesce("_up", "up").alias("up"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.least("low", "_low").alias("low"),
            F.greatest("high", "_high").alias("high"),
            (F.coalesce("_up", "up") != F.col("up")).alias("moved"),
        )
        state = settle(state)
        moved = not state.where("moved").isEmpty()
        state = state.drop("moved")
        walked *= 2
    # A walk that ends on a node with a parent ended inside a cycle, or the line is longer
    # than max_steps. Two walks in a row cover the same ids (equal low and high) only on a
    # cycle, since on a line they share just one node.
    ends = renamed(state, "_")
    beyond = renamed(state, "__")
    out = state.join(ends, F.col("up") == F.col("_id"), "left").join(
        beyond, F.col("_up") == F.col("__id"), "left"
    )
    on_cycle = (
        (F.col("_steps") > 0) & (F.col("_low") == F.col("__low")) & (F.col("_high") == F.col("__high"))
    )
    root = F.when(F.coalesce(on_cycle, F.lit(False)), F.col("_low")).otherwise(F.col("up"))
    if unknown_if_rootless:
        root = F.when(F.col("steps") > 0, root)
    return out.select("id", root.alias("root"), F.col("steps").alias("depth"))


def lineage_tags(roots: DataFrame, buckets: int = fixed.LINEAGE_BUCKETS) -> DataFrame:
    return roots.select("id", S.lineage_tag(F.col("root"), buckets).alias("lineage"))


# -- neighbourhoods -------------------------------------------------------------------


def undirected_neighbors(edges: DataFrame, relations: Sequence[str] = PATERNAL) -> DataFrame:
    """Symmetric distinct adjacency of pairwise relations (sibling memberships stay as they are)."""
    used = edges.where(F.col("rel").isin(list(relations)))
    return (
        used.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        .unionByName(used.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        .distinct()
    )


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """Size of each person's kin neighbourhood: father, children and siblings."""
    plain = undirected_neighbors(edges).groupBy("a").agg(F.count("*").alias("n"))
    links = edges.where(F.col("rel") == "r_sib")
    sizes = links.groupBy("dst").agg(F.count("*").alias("members"))
    siblings = links.join(sizes, "dst").select(F.col("src").alias("a"), (F.col("members") - 1).alias("n"))
    return (
        plain.unionByName(siblings)
        .groupBy(F.col("a").alias("id"))
        .agg(F.sum("n").cast("bigint").alias("n_neighbors"))
        .where(F.col("n_neighbors") > 0)
    )


def kin_facts(edges: DataFrame) -> DataFrame:
    """Per person, in one pass over the edges: smallest father and family, how many of each, children."""
    paternal, member = F.col("rel").isin(list(PATERNAL)), F.col("rel") == "r_sib"
    none = F.lit(None).cast(edges.schema["src"].dataType)
    ends = F.when(
        paternal,
        F.array(
            F.struct(F.col("dst").alias("id"), F.col("src").alias("father"), none.alias("family"), F.lit(0).alias("child")),
            F.struct(F.col("src").alias("id"), none.alias("father"), none.alias("family"), F.lit(1).alias("child")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("src").alias("id"), none.alias("father"), F.col("dst").alias("family"), F.lit(0).alias("child")))
    )
    single = edges.where(paternal | member).select(F.inline(ends))
    return single.groupBy("id").agg(
        F.min("father").alias("father"),
        F.count("father").alias("n_fathers"),
        F.min("family").alias("family"),
        F.count("family").alias("n_families"),
        F.sum("child").alias("n_children"),
    )


def kin_profile(facts: DataFrame) -> DataFrame:
    """Per person: father, sibling group, the same of the father, and family sizes (from ``kin_facts``).

    ``father`` needs a paternal edge (sex known), ``family`` only the sibling membership.
    """
    sizes = facts.where(F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias("n_family"))
    up = facts.select(
        F.col("id").alias("_f"), F.col("father").alias("grandfather"), F.col("family").alias("father_family")
    )
    return (
        facts.join(sizes, "family", "left")
        .join(up, F.col("father") == F.col("_f"), "left")
        .select(
            "id", "father", "family", "grandfather", "father_family", "n_children",
            F.coalesce("n_family", F.lit(0)).alias("n_family"),
        )
    )


def kin_violations(edges: DataFrame) -> DataFrame:
    """How many people break what kin counts take for granted: one father, one family, not one's own.

    Edges of ``build_edges`` break none of it. Where another source does, pairs near those people
    are counted from explicit neighbours (``irregular``).
    """
    father = edges.where(F.col("rel").isin(list(PATERNAL))).groupBy("dst").agg(
        F.count_distinct("src").alias("n"), F.bool_or(F.col("src") == F.col("dst")).alias("own")
    )
    family = edges.where(F.col("rel") == "r_sib").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    return father.agg(
        F.count_if(F.col("n") > 1).alias("several_fathers"), F.count_if("own").alias("own_father")
    ).withColumn("several_families", family.agg(F.count_if(F.col("n") > 1)).scalar())


def _profiled(pairs: DataFrame, profile: DataFrame, a: str, b: str) -> DataFrame:
    out = pairs
    for side, column in (("a", a), ("b", b)):
        renamed = profile.select(*[F.col(c).alias(f"_{side}_{c}") for c in profile.columns])
        out = out.join(renamed, F.col(column) == F.col(f"_{side}_id"), "left")
    return out.na.fill(0, ["_a_n_children", "_b_n_children", "_a_n_family", "_b_n_family"])


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _kin_terms(a: str, b: str) -> dict[str, Column]:
    """0/1 links and common-neighbour counts of a profiled pair, by kind of bridge."""
    ca, cb = F.col(a), F.col(b)
    fa, fb = F.col("_a_father"), F.col("_b_father")
    ga, gb = F.col("_a_family"), F.col("_b_family")
    same_family = ga == gb
    return {
        "parent": F.greatest(_is(fa == cb), _is(fb == ca)),
        "sibling": _is(same_family),
        # Bridge is the father of both, or father of one and child of the other.
        "via_parent": _is(fa == fb) + _is(F.col("_a_grandfather") == cb) + _is(F.col("_b_grandfather") == ca),
        # Bridge is the father of one and a sibling of the other.
        "parent_sibling": _is((F.col("_a_father_family") == gb) & (fa != cb))
        + _is((F.col("_b_father_family") == ga) & (fb != ca)),
        # Bridge is a child of one and a sibling of the other (who is then a child, too).
        "child_sibling": _is(gb == ca) * (F.col("_a_n_children") - _is(fb == ca))
        + _is(ga == cb) * (F.col("_b_n_children") - _is(fa == cb)),
        # Bridge is a third member of the same family.
        "sibling_sibling": _is(same_family) * (F.col("_a_n_family") - 2),
    }


def _different(a: str, b: str) -> Column:
    return F.col(a) != F.col(b)


def irregular(facts: DataFrame) -> DataFrame:
    """The people (id) of whom the facts of ``kin_profile`` do not tell everything (from ``kin_facts``).

    They have several fathers or families (or one several times), a father who is not the
    family, or are the own father or grandfather. Who is the own grandfather by another than
    the smallest father is next to somebody with several fathers.
    """
    father, family = F.col("father"), F.col("family")
    odd = (
        (F.col("n_fathers") > 1)
        | (F.col("n_families") > 1)
        | F.coalesce(family == F.col("id"), F.lit(False))
        | (father.isNotNull() & ~father.eqNullSafe(family))
    )
    up = facts.where(father.isNotNull()).select(F.col("id").alias("_f"), father.alias("_g"))
    own = facts.join(up, (father == F.col("_f")) & (F.col("id") == F.col("_g"))).select("id")
    return facts.where(odd).select("id").unionByName(own).distinct()


def _explicit(pairs: DataFrame, edges: DataFrame, odd: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs one of whose members is irregular or next to somebody who is, with _one, _common and _two.

    Neighbours are listed for the left members of these pairs only.
    """
    pp = edges.where(F.col("rel").isin(list(PATERNAL))).select("src", "dst")
    both = pp.unionByName(pp.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    member = edges.where(F.col("rel") == "r_sib").select("src", F.col("dst").alias("fam"))
    groups = member.join(odd, F.col("src") == F.col("id"), "left_semi").select("fam").distinct()
    zone = (
        odd.unionByName(both.join(odd, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")))
        .unionByName(member.join(groups, "fam", "left_semi").select(F.col("src").alias("id")))
        .distinct()
    )
    asked = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    near = asked.join(zone, F.col("_a") == F.col("id"), "left_semi").union(asked.join(zone, F.col("_b") == F.col("id"), "left_semi")).distinct()

    def reached(start: DataFrame) -> DataFrame:
        """(id, z, m) for the ids of ``start``: everybody next to them, with the number of edges."""
        plain = start.join(both, F.col("id") == F.col("src")).select("id", F.col("dst").alias("z"), F.lit(1).alias("m"))
        others = member.select(F.col("src").alias("z"), "fam")
        siblings = start.join(member, F.col("id") == F.col("src")).select("id", "fam").join(others, "fam")
        siblings = siblings.where(F.col("id") != F.col("z")).select("id", "z", F.lit(2).alias("m"))
        return plain.unionByName(siblings).groupBy("id", "z").agg(F.sum("m").alias("m"))

    left = near.join(reached(near.select(F.col("_a").alias("id")).distinct()), F.col("_a") == F.col("id")).drop("id")
    right = reached(near.select(F.col("_b").alias("id")).distinct()).select(
        F.col("id").alias("_r"), F.col("z").alias("_rz"), F.col("m").alias("_rm")
    )
    steps = left.join(right, (F.col("_b") == F.col("_r")) & (F.col("z") == F.col("_rz")), "left")
    found = steps.groupBy("_a", "_b").agg(
        F.sum(F.when(F.col("z") == F.col("_b"), F.col("m"))).alias("_one"),
        F.count("_rz").alias("_common"),
        F.sum(F.col("m") * F.col("_rm")).alias("_two"),
    )
    return near.join(found, ["_a", "_b"], "left").na.fill(0, ["_one", "_common", "_two"]).select(
        F.col("_a").alias(a), F.col("_b").alias(b), "_one", "_common", "_two"
    )


def _counted(pairs: DataFrame, edges: DataFrame, a: str, b: str, groups: DataFrame | None = None) -> DataFrame:
    """The pairs with the edges between them, their common neighbours, and the walks of two steps.

    The facts are written once; only pairs near an irregular person are counted from neighbours.
    With ``groups`` (id, groups) the pairs also tell whether they have one in common (``_house``).
    """
    t = _kin_terms(a, b)
    one = _is(F.col("_a_father") == F.col(b)) + _is(F.col("_b_father") == F.col(a)) + 2 * t["sibling"]
    common = t["via_parent"] + t["parent_sibling"] + t["child_sibling"] + t["sibling_sibling"]
    two = t["via_parent"] + 2 * t["parent_sibling"] + 2 * t["child_sibling"] + 4 * t["sibling_sibling"]
    facts = settle(kin_facts(edges))
    profile, house = kin_profile(facts), []
    if groups is not None:
        profile = profile.join(groups, "id", "full")
        house = [_is(F.arrays_overlap("_a_groups", "_b_groups")).alias("_house")]
    # Both members are looked up in it.
    profiled = _profiled(pairs, settle(profile), a, b).select(
        *pairs.columns, one.alias("_one"), common.alias("_common"), two.alias("_two"), *house
    )
    odd = settle(irregular(facts))
    if odd.isEmpty():
        return profiled
    names = ("_one", "_common", "_two")
    exact = _explicit(pairs, edges, odd, a, b).withColumnsRenamed({n: f"_x{n}" for n in names})
    rest = [] if groups is None else ["_house"]
    return profiled.join(exact, [a, b], "left").select(
        *pairs.columns, *[F.coalesce(f"_x{n}", n).alias(n) for n in names], *rest
    )


def direct_link(pairs: DataFrame, edges: DataFrame, a: str = "h", b: str = "w") -> DataFrame:
    """Are the two adjacent by a paternal or sibling edge."""
    return _counted(pairs, edges, a, b).select(
        *pairs.columns, (_different(a, b) & (F.col("_one") > 0)).alias("direct_link")
    )


def common_neighbors(pairs: DataFrame, edges: DataFrame, a: str = "h", b: str = "w") -> DataFrame:
    """Number of common kin neighbours of each pair."""
    return _counted(pairs, edges, a, b).select(
        *pairs.columns, F.when(_different(a, b), F.col("_common")).otherwise(0).cast("bigint").alias("n_common")
    )


def shared_groups(pairs: DataFrame, edges: DataFrame, rel: str = "r_hh", a: str = "h", b: str = "w") -> DataFrame:
    """Groups both members belong to, with the number of edge pairs through each.

    A person joins at most one row per group of their own, and the second join is on
    (person, group): groups are never joined with groups.
    """
    member = edges.where(F.col("rel") == rel).groupBy(F.col("src").alias("_p"), F.col("dst").alias("_g")).agg(
        F.count("*").alias("_n")
    )
    first = pairs.select(a, b).distinct().join(member, F.col(a) == F.col("_p")).drop("_p")
    second = member.select(F.col("_p").alias("_q"), F.col("_g").alias("_g2"), F.col("_n").alias("_n2"))
    return (
        first.join(second, (F.col(b) == F.col("_q")) & (F.col("_g") == F.col("_g2")))
        .groupBy(a, b)
        .agg(F.count("*").alias("n_groups"), F.sum(F.col("_n") * F.col("_n2")).alias("n_walks"))
    )


def shares_group(pairs: DataFrame, edges: DataFrame, rel: str = "r_hh", a: str = "h", b: str = "w") -> DataFrame:
    """Pairs that have any group in common."""
    return pairs.join(shared_groups(pairs, edges, rel, a, b), [a, b], "left_semi")


# Groups of a person that fit in a row; with more, pairs and groups are joined row by row.
LISTED = 64


def kin_path_count(pairs: DataFrame, edges: DataFrame, a: str = "h", b: str = "w", name: str = "patri_path_count") -> DataFrame:
    """Direct link + common kin neighbours + 1 for any common household; 0 for a person and itself.

    Households go along with the other facts of a person, unless somebody has very many of them.
    """
    member = settle(edges.where((F.col("rel") == "r_hh") & F.col("dst").isNotNull()).select("src", "dst").distinct())
    if member.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > LISTED).isEmpty():
        listed = member.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("groups"))
        counted = _counted(pairs, edges, a, b, listed)
    else:
        house = shared_groups(pairs, edges, "r_hh", a, b).select(a, b, F.lit(1).alias("_house"))
        counted = _counted(pairs, edges, a, b).join(house, [a, b], "left")
    total = (F.col("_one") > 0).cast("int") + F.col("_common")
    paths = F.when(_different(a, b), total + F.coalesce("_house", F.lit(0))).otherwise(0)
    return counted.select(*pairs.columns, paths.cast("bigint").alias(name))


def walk_count_upto2(pairs: DataFrame, edges: DataFrame, a: str = "h", b: str = "w") -> DataFrame:
    """Walks of length 1 and 2 with multiplicity, plus walks through households and banners.

    A paternal edge counts once in each direction; a sibling edge is listed both ways and
    read both ways, so it weighs 2 (and 4 along two sibling steps).
    """
    houses = shared_groups(pairs, edges, "r_hh", a, b).select(a, b, F.col("n_walks").alias("_hh"))
    banners = shared_groups(pairs, edges, "r_cb", a, b).select(a, b, F.col("n_walks").alias("_cb"))
    joined = _counted(pairs, edges, a, b).join(houses, [a, b], "left").join(banners, [a, b], "left")
    total = F.col("_one") + F.col("_two") + F.coalesce("_hh", F.lit(0)) + F.coalesce("_cb", F.lit(0))
    return joined.select(
        *pairs.columns, F.when(_different(a, b), total).otherwise(0).cast("bigint").alias("n_walks")
    )


# -- motifs ---------------------------------------------------------------------------

# Steps from the left member to the right one: (relation, direction). up leads from child to
# parent, down back; out from the first end of an edge to the second, in back; any both ways.
# A sibling step leads to every other member of a family, whatever its direction.
MOTIFS = {
    "m1_father_brother": (("r_fs", "up"), ("r_sib", "any"), ("r_hw", "any")),
    "m2_uncle_in_law": (("r_fs", "up"), ("r_sib", "any"), ("r_fd", "down"), ("r_hw", "any")),
    "m3_same_household": (("r_hh", "out"), ("r_hh", "in")),
    "m4_banner_endog": (("r_cb", "out"), ("r_cb", "in")),
}
BACK = {"up": "down", "down": "up", "out": "in", "in": "out", "any": "any"}

Steps = tuple[tuple[str, str], ...]


class _Walks:
    """Numbers of walks along patterns, from the ends of the asked pairs towards the middle.

    A walk is a sequence of people and groups; parallel edges are one step. The sibling step is
    taken through families: all their members, less what that counts too often (``surplus``:
    a person with itself, and a second common family). So no list of siblings is made where a
    walk from the left meets one from the right in a family.
    """

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self.known: dict[tuple, DataFrame] = {}

    def links(self, rel: str, direction: str) -> DataFrame:
        """(x, y) of a step."""
        rows = self.edges.where(F.col("rel") == rel)
        ahead = rows.select(F.col("src").alias("x"), F.col("dst").alias("y"))
        behind = rows.select(F.col("dst").alias("x"), F.col("src").alias("y"))
        if direction == "any":
            return ahead.unionByName(behind).distinct()
        return (ahead if direction in ("down", "out") else behind).distinct()

    def members(self) -> DataFrame:
        if "members" not in self.known:
            rows = self.edges.where(F.col("rel") == "r_sib")
            self.known["members"] = settle(rows.select(F.col("src").alias("x"), F.col("dst").alias("family")).distinct())
        return self.known["members"]

    def surplus(self) -> DataFrame:
        """(x, y, e): how often families count y as a sibling of x too many times."""
        if "surplus" not in self.known:
            members = self.members()
            several = members.groupBy("x").agg(F.count("*").cast("long").alias("e"))
            own = several.select("x", F.col("x").alias("y"), "e")
            # Only people with several families can share more than one.
            odd = members.join(several.where(F.col("e") > 1).select("x"), "x", "left_semi")
            met = odd.join(odd.select(F.col("x").alias("y"), "family"), "family").where(F.col("x") != F.col("y"))
            twice = met.groupBy("x", "y").agg((F.count("*") - 1).cast("long").alias("e")).where(F.col("e") > 0)
            self.known["surplus"] = settle(own.unionByName(twice))
        return self.known["surplus"]

    def by_family(self, walks: DataFrame) -> DataFrame:
        return walks.join(self.members(), "x").groupBy("start", "family").agg(F.sum("n").alias("n"))

    def less(self, walks: DataFrame) -> DataFrame:
        """What to take away after a sibling step through families, as negative numbers."""
        counted = walks.join(self.surplus(), "x")
        return counted.select("start", F.col("y").alias("x"), (-F.col("n") * F.col("e")).alias("n"))

    def step(self, walks: DataFrame, rel: str, direction: str) -> DataFrame:
        if rel == "r_sib":
            through = self.by_family(walks).join(self.members(), "family").select("start", "x", "n")
            moved = through.unionByName(self.less(walks))
        else:
            moved = walks.join(self.links(rel, direction), "x").select("start", F.col("y").alias("x"), "n")
        return moved.groupBy("start", "x").agg(F.sum("n").alias("n")).where(F.col("n") != 0)

    def walk(self, side: str, starts: DataFrame, steps: Steps) -> DataFrame:
        """(start, x, n): walks of ``steps`` from every start; patterns that begin alike share them."""
        key = (side, steps)
        if key not in self.known:
            if steps:
                self.known[key] = settle(self.step(self.walk(side, starts, steps[:-1]), *steps[-1]))
            else:
                self.known[key] = starts.select(F.col("start"), F.col("start").alias("x"), F.lit(1).cast("long").alias("n"))
        return self.known[key]

    def halves(self, pairs: DataFrame, steps: Steps) -> list[tuple[DataFrame, DataFrame, str]]:
        """Walks from the left and from the right members of all pairs, and where they meet."""
        middle = len(steps) // 2
        siblings = [i for i, (rel, _) in enumerate(steps) if rel == "r_sib"]
        cut = min(siblings, key=lambda i: abs(2 * i + 1 - len(steps))) if siblings else middle
        back = tuple((rel, BACK[d]) for rel, d in reversed(steps[cut + 1 if siblings else cut :]))
        left = self.walk("a", pairs.select(F.col("a").alias("start")).distinct(), steps[:cut])
        right = self.walk("b", pairs.select(F.col("b").alias("start")).distinct(), back)
        if not siblings:
            return [(left, right, "x")]
        return [(settle(self.by_family(left)), settle(self.by_family(right)), "family"), (settle(self.less(left)), right, "x")]


def _met(pairs: DataFrame, ahead: DataFrame, behind: DataFrame, on: str) -> DataFrame:
    """(a, b, n) of the pairs (a, b); rows of a pair add up to its number of walks."""
    first = pairs.join(ahead.withColumnRenamed("start", "a"), "a")
    second = behind.select(F.col("start").alias("b"), on, F.col("n").alias("m"))
    return first.join(second, ["b", on]).select("a", "b", (F.col("n") * F.col("m")).alias("n"))


# Pairs whose walks meet at a time: this bounds the shuffles that exist together.
PORTION = 1 << 25


def match_motif(pairs: DataFrame, edges: DataFrame, pattern: Steps, a: str = "h", b: str = "w", name: str = "n_matches") -> DataFrame:
    """Number of walks along ``pattern``, a sequence of (relation, direction), from a to b of every pair."""
    return match_motifs(pairs, edges, a, b, {name: tuple(pattern)})


def match_motifs(
    pairs: DataFrame, edges: DataFrame, a: str = "h", b: str = "w", motifs: Mapping[str, Steps] | None = None
) -> DataFrame:
    """Number of matches of each motif (``MOTIFS`` by default) that ends in the given pair.

    A pattern is cut at the sibling step nearest to its middle (or in the middle). Walks are
    counted per start from both ends up to the cut, and each pair joins what the two have in
    common there; all motifs are added up in one aggregate. Many pairs meet in portions of about ``PORTION``.
    """
    motifs = dict(MOTIFS if motifs is None else motifs)
    for name, steps in motifs.items():
        if not steps or any(direction not in BACK for _, direction in steps):
            raise ValueError(f"motif {name!r} needs steps of (relation, {' / '.join(BACK)})")
    asked = settle(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    walks = _Walks(edges)
    halves = [walks.halves(asked, tuple(map(tuple, steps))) for steps in motifs.values()]
    portions = max(1, -(-asked.count() // PORTION))
    done = None
    for p in range(portions):
        part = asked if portions == 1 else asked.where(F.pmod(F.xxhash64("a"), F.lit(portions)) == p)
        rows = part.select("a", "b", F.lit(-1).alias("motif"), F.lit(0).cast("long").alias("n"))
        for i, met in enumerate(halves):
            for ahead, behind, on in met:
                # Written one by one: the shuffles of one are gone before the next one begins.
                rows = rows.unionByName(settle(_met(part, ahead, behind, on).select("a", "b", F.lit(i).alias("motif"), "n")))
        counted = rows.groupBy("a", "b").agg(
            *[F.sum(F.when(F.col("motif") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(motifs)]
        )
        if portions > 1:
            counted = settle(counted)
        done = counted if done is None else done.unionByName(counted)
    return done.select(F.col("a").alias(a), F.col("b").alias(b), *motifs)


def motif_example_counts(matches: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
    """Matches and matching pairs per motif, with its switch; a switched-off motif counts 0."""
    flags = {**fixed.MOTIF_FLAGS, **(flags or {})}
    names = list(flags)
    counted = matches.agg(
        *[F.sum(m).alias(f"n_{m}") for m in names], *[F.count_if(F.col(m) > 0).alias(f"p_{m}") for m in names]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("motif"),
                F.lit(flags[m]).alias("enabled"),
                (F.coalesce(F.col(f"n_{m}"), F.lit(0)) if flags[m] else F.lit(0)).cast("bigint").alias("n_matches"),
                (F.col(f"p_{m}") if flags[m] else F.lit(0)).cast("bigint").alias("n_pairs"),
            )
            for m in names
        ]
    )
    return counted.select(F.inline(rows))
