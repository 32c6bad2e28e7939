"""Timed edges from a person-year panel.

All relations share one table ``edges(src, dst, rel, t)``. The sibling relation is kept
as membership: one row (person, father, r_sib, birth year). Two persons are siblings
when they share the father, and their edge exists from the later birth on, so the time
filters, maskings and counts below give what the list of all sibling pairs would give,
with one row per child instead of n*(n-1) rows per father.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.cleaning import distinct_ids, known_ids_only
from kinloom.operators.ordered import first_row, lagged, nulls_last
from kinloom.session import settle


@dataclass(frozen=True)
class Panel:
    """Column names of a person-year panel and the order of its rows within a person."""

    person: str = "PERSON_ID"
    year: str = "YEAR"
    sex: str = "SEX"
    status: str = "MARITAL_STATUS"
    wife: str = "WIFE_1_ID"
    husband: str = "HUSBAND_ID"
    father: str = "FATHER_ID"
    mother: str = "MOTHER_ID"
    birth: str = "BIRTHYEAR"
    household: str = "HOUSEHOLD_ID"
    village: str = "UNIQUE_VILLAGE_ID"
    region: str = "REGION"
    # Full row order within a person. The first column also cuts a person's rows into
    # slices, so it should be as fine as the data allows.
    order: tuple[str, ...] = ("YEAR",)

    @property
    def row_order(self) -> list[str]:
        return list(self.order)


PANEL = Panel()


def _whole(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("int")


# -- facts per person -------------------------------------------------------------------


def person_facts(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """What edges need of a person's rows, from one aggregate over the panel.

    ``first``: the first row; ``link``: a male's first row that names a partner; ``any`` and
    ``own``: the first row, and the first outside marriage, for the parents; the first known
    sex and birth year. ``build_edges`` stores it once, so the panel is not read for each.
    """
    order = nulls_last(p.row_order)
    married = F.coalesce(F.col(p.status), F.lit(0)) == fixed.MARRIED
    names_partner = (F.col(p.sex) == fixed.MALE) & F.col(p.wife).isNotNull()
    events = [F.col(c).alias(n) for n, c in (("year", p.year), ("sex", p.sex), ("wife", p.wife), ("husband", p.husband))]
    row = F.struct(F.col(p.father).alias("father"), F.col(p.mother).alias("mother"), F.col(p.year).alias("year"))
    return df.where(F.col(p.person).isNotNull()).groupBy(F.col(p.person).alias("person")).agg(
        F.min_by(F.struct(*events, F.col(p.status).alias("status"), F.col(p.region).alias("region")), order).alias("first"),
        F.min_by(F.struct(*events), F.when(names_partner, order)).alias("link"),
        F.min_by(_whole(p.sex), F.when(F.col(p.sex).isNotNull(), order)).alias("sex"),
        F.min_by(_whole(p.birth), F.when(F.col(p.birth).isNotNull(), order)).alias("birth"),
        F.min_by(row, order).alias("any"),
        F.min_by(row, F.struct(married.cast("int").alias("_m"), order.alias("_o"))).alias("own"),
    )


def _fact_events(facts: DataFrame, field: str, method: int) -> DataFrame:
    x = F.col(field)
    return facts.select(
        "person",
        _whole(x["sex"]).alias("sex"),
        S.pick_partner(_whole(x["sex"]), x["wife"], x["husband"]).alias("partner"),
        x["year"].cast("int").alias("year"),
        F.lit(method).alias("method"),
    )


# -- partnership ----------------------------------------------------------------------


def _events(df: DataFrame, p: Panel, year: Column, method: int) -> DataFrame:
    return df.select(
        F.col(p.person).alias("person"),
        _whole(p.sex).alias("sex"),
        S.pick_partner(_whole(p.sex), F.col(p.wife), F.col(p.husband)).alias("partner"),
        year.cast("int").alias("year"),
        F.lit(method).alias("method"),
    )


def status_transitions(df: DataFrame, p: Panel = PANEL, to: int = fixed.MARRIED) -> DataFrame:
    """Rows where the status becomes ``to`` from another known value.

    The previous row counts even when its status is null (then there is no transition);
    the event is dated at the floor midpoint of the two observations.
    """
    seen = df.where(F.col(p.person).isNotNull())
    seen = lagged(seen, [p.person], p.row_order, [p.status, p.year], "_prev")
    changed = seen.where(
        (F.col(p.status) == to)
        & F.col("_prev")[p.status].isNotNull()
        & (F.col("_prev")[p.status] != to)
        & F.col(p.sex).isNotNull()
    )
    return _events(changed, p, S.floor_midpoint(F.col("_prev")[p.year], F.col(p.year)), 1)


def first_observation_in_state(
    df: DataFrame, p: Panel = PANEL, to: int = fixed.MARRIED, facts: DataFrame | None = None
) -> DataFrame:
    """Persons already in the state on their very first row."""
    facts = person_facts(df, p) if facts is None else facts
    return _fact_events(facts.where((F.col("first.status") == to) & F.col("first.sex").isNotNull()), "first", 2)


def first_direct_link(df: DataFrame, p: Panel = PANEL, facts: DataFrame | None = None) -> DataFrame:
    """First row per male that names a partner."""
    facts = person_facts(df, p) if facts is None else facts
    return _fact_events(facts.where(F.col("link").isNotNull()), "link", 3)


def canonical_pairs(events: DataFrame) -> DataFrame:
    """One edge per unordered couple: the earliest event, directed husband -> wife.

    An event without a year makes no edge (``undated_events`` counts those). Ties in the year are settled by method and person, so the result is the same in every run.
    """
    male = F.col("sex") == fixed.MALE
    directed = events.where(F.col("year").isNotNull()).select(
        F.least("person", "partner").alias("a"),
        F.greatest("person", "partner").alias("b"),
        F.when(male, F.col("person")).otherwise(F.col("partner")).alias("src"),
        F.when(male, F.col("partner")).otherwise(F.col("person")).alias("dst"),
        F.col("year").alias("t"),
        "method",
        "person",
    )
    earliest = first_row(directed, ["a", "b"], ["t", "method", "person"], ["src", "dst", "t"])
    return earliest.select("src", "dst", F.lit("r_hw").alias("rel"), "t")


def undated_events(events: DataFrame) -> DataFrame:
    """How many events per method have no year, and so make no edge."""
    return events.groupBy("method").agg(F.count_if(F.col("year").isNull()).alias("n_undated"), F.count("*").alias("n_events"))


def marriage_events(df: DataFrame, p: Panel = PANEL, facts: DataFrame | None = None) -> DataFrame:
    """Events of all three kinds: transitions, first observations, direct links."""
    return (
        status_transitions(df, p)
        .unionByName(first_observation_in_state(df, p, facts=facts))
        .unionByName(first_direct_link(df, p, facts))
    )


def marriage_edges(
    df: DataFrame, p: Panel = PANEL, persons: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """r_hw from transitions, first observations and direct links between known persons."""
    known = persons if persons is not None else distinct_ids(df, p.person)
    events = marriage_events(df, p, settle(person_facts(df, p)) if facts is None else facts)
    events = known_ids_only(events.where(F.col("partner").isNotNull()), "partner", known)
    return canonical_pairs(events)


# -- kinship --------------------------------------------------------------------------


def reference_rows(df: DataFrame, p: Panel = PANEL, facts: DataFrame | None = None) -> DataFrame:
    """Best row per person for the parent columns, with sex and first known birth year.

    Rows of a married woman name her in-laws, so they rank behind all other rows. Both
    candidates (first row at all, first row outside marriage) come from one aggregate;
    the person's first known sex then decides which one counts.
    """
    facts = person_facts(df, p) if facts is None else facts
    chosen = F.when(F.col("sex") == fixed.FEMALE, F.col("own")).otherwise(F.col("any"))
    return facts.select(
        "person",
        "sex",
        "birth",
        chosen["father"].alias("father"),
        chosen["mother"].alias("mother"),
        chosen["year"].cast("int").alias("ref_year"),
    )


def first_birth_year(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """First known birth year per person."""
    known = df.where(F.col(p.person).isNotNull() & F.col(p.birth).isNotNull())
    return known.groupBy(F.col(p.person).alias("person")).agg(
        F.min_by(_whole(p.birth), nulls_last(p.row_order)).alias("birth")
    )


def _with_known_parent(refs: DataFrame, parent: str, persons: DataFrame) -> DataFrame:
    return known_ids_only(refs.where(F.col(parent).isNotNull()), parent, persons)


def parent_child_edges(
    refs: DataFrame,
    parent: str,
    persons: DataFrame,
    son: str,
    daughter: str,
    min_year: int = fixed.MIN_YEAR,
) -> DataFrame:
    """Parent -> child edges split by the child's sex, dated at the child's birth."""
    rel = F.when(F.col("sex") == fixed.MALE, son).when(F.col("sex") == fixed.FEMALE, daughter)
    return (
        _with_known_parent(refs, parent, persons)
        .select(
            F.col(parent).alias("src"),
            F.col("person").alias("dst"),
            rel.alias("rel"),
            F.coalesce("birth", F.lit(min_year)).alias("t"),
        )
        .where(F.col("rel").isNotNull())
    )


def unknown_sex_drops(refs: DataFrame, persons: DataFrame) -> DataFrame:
    """How many children of a known father / mother lack a usable sex."""
    unusable = ~F.coalesce(F.col("sex").isin(fixed.FEMALE, fixed.MALE), F.lit(False))
    parts = [
        _with_known_parent(refs, parent, persons).agg(
            F.lit(parent).alias("parent"), F.count_if(unusable).alias("n_dropped")
        )
        for parent in ("father", "mother")
    ]
    return parts[0].unionByName(parts[1])


def sibling_links(refs: DataFrame, persons: DataFrame, min_year: int = fixed.MIN_YEAR) -> DataFrame:
    """r_sib as membership rows (child, father, birth year)."""
    return _with_known_parent(refs, "father", persons).select(
        F.col("person").alias("src"),
        F.col("father").alias("dst"),
        F.lit("r_sib").alias("rel"),
        F.coalesce("birth", F.lit(min_year)).alias("t"),
    )


def sibling_summary(links: DataFrame) -> DataFrame:
    """Per child: number of siblings, latest edge time and sum of all edge times.

    An edge is dated at the later of two births. The births of one father are counted per
    year first (at most one row per year of the calendar); the sums over older and younger
    siblings are running sums over those counts.
    """
    born = links.groupBy("dst", "t").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("dst").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("dst").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    group = Window.partitionBy("dst")
    born = born.select(
        "dst",
        "t",
        F.sum("n").over(group).alias("size"),
        F.sum("n").over(upto).alias("n_upto"),
        F.coalesce(F.sum(F.col("n") * F.col("t")).over(after), F.lit(0)).alias("t_after"),
        F.max("t").over(group).alias("last_t"),
    )
    return (
        links.join(born, ["dst", "t"])
        .where(F.col("size") > 1)
        .select(
            F.col("src").alias("person"),
            (F.col("size") - 1).cast("bigint").alias("n_siblings"),
            F.col("last_t").cast("int").alias("last_edge_t"),
            ((F.col("n_upto") - 1) * F.col("t") + F.col("t_after")).cast("bigint").alias("sum_edge_t"),
        )
    )


def siblings_of(links: DataFrame, people: Sequence[str]) -> DataFrame:
    """The sibling edges of the named people, in the form (src, dst, rel, t)."""
    asked = links.where(F.col("src").isin(list(people))).select(
        F.col("src").alias("_me"), F.col("dst").alias("_father"), F.col("t").alias("_mine")
    )
    return links.join(asked, links["dst"] == asked["_father"]).where(
        F.col("src") != F.col("_me")
    ).select(
        F.col("_me").alias("src"),
        F.col("src").alias("dst"),
        "rel",
        F.greatest("_mine", "t").alias("t"),
    )


# -- membership -----------------------------------------------------------------------


def membership_edges_timed(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """r_hh: person -> household, one edge per observed row (not de-duplicated)."""
    full = df.where(
        F.col(p.person).isNotNull() & F.col(p.household).isNotNull() & F.col(p.year).isNotNull()
    )
    return full.select(
        F.col(p.person).alias("src"),
        F.col(p.household).alias("dst"),
        F.lit("r_hh").alias("rel"),
        _whole(p.year).alias("t"),
    )


def membership_edges_static_first(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """r_hc: household -> community; nulls are dropped first, then the first row is kept."""
    full = df.where(F.col(p.household).isNotNull() & F.col(p.village).isNotNull())
    first = full.groupBy(F.col(p.household).alias("src")).agg(
        F.min_by(S.code_text(F.col(p.village)), nulls_last([p.year, p.village])).alias("dst")
    )
    return first.select("src", "dst", F.lit("r_hc").alias("rel"), F.lit(fixed.STATIC_TIME).alias("t"))


def membership_edges_first_row(df: DataFrame, p: Panel = PANEL, facts: DataFrame | None = None) -> DataFrame:
    """r_cb: person -> banner; the first row is kept first, then nulls are dropped."""
    facts = person_facts(df, p) if facts is None else facts
    return facts.where(F.col("first.region").isNotNull()).select(
        F.col("person").alias("src"),
        S.code_text(F.col("first.region")).alias("dst"),
        F.lit("r_cb").alias("rel"),
        F.lit(fixed.STATIC_TIME).alias("t"),
    )


def build_edges(df: DataFrame, p: Panel = PANEL, persons: DataFrame | None = None) -> DataFrame:
    """All nine relations as one table; write it partitioned by ``rel``.

    The panel is read five times: for the facts per person, which are stored, twice for the
    status transitions, and for the two household relations.
    """
    facts = settle(person_facts(df, p))
    known = persons if persons is not None else facts.select(F.col("person").cast("string").alias("id"))
    refs = reference_rows(df, p, facts)
    parts = [
        marriage_edges(df, p, known, facts),
        parent_child_edges(refs, "father", known, "r_fs", "r_fd"),
        parent_child_edges(refs, "mother", known, "r_ms", "r_md"),
        sibling_links(refs, known),
        membership_edges_timed(df, p),
        membership_edges_static_first(df, p),
        membership_edges_first_row(df, p, facts),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edge_counts(edges: DataFrame, relations: Sequence[str] = fixed.RELATIONS) -> DataFrame:
    """Edges per relation, zeros included; sibling memberships counted as directed pairs."""
    groups = edges.groupBy("rel", F.when(F.col("rel") == "r_sib", F.col("dst")).alias("_g")).agg(
        F.count("*").alias("n")
    )
    counted = groups.groupBy("rel").agg(
        F.sum(F.when(F.col("rel") == "r_sib", F.col("n") * (F.col("n") - 1)).otherwise(F.col("n"))).alias("n")
    )
    catalogue = edges.sparkSession.createDataFrame([(r,) for r in relations], "rel string")
    return catalogue.join(counted, "rel", "left").select(
        "rel", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_edges")
    )
