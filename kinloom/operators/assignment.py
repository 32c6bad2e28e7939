"""One-to-one assignment of left and right entities, all cohorts in the same loop.

The driver only runs the loop and counts; prices, bids and matches stay in tables. Every
round is settled, so the plan does not grow and a lost executor costs one round at most.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators.ranking import mutual_best
from kinloom.session import settle


def assign_greedy(scores: DataFrame, group: Sequence[str] = ("year",)) -> DataFrame:
    """Best pair first, until one side is used up.

    Each round takes all pairs that are each other's best and removes their members. The
    best remaining pair is always among them, so the result equals taking the pairs one by
    one in falling score order (at least half of the best possible total for scores >= 0).
    """
    group = list(group)
    left, right = [*group, "h"], [*group, "w"]
    rest = settle(scores.select(*group, "h", "w", "score"))
    matched = None
    while True:
        found = settle(mutual_best(rest, left, right))
        if found.isEmpty():
            return rest.limit(0) if matched is None else matched
        matched = found if matched is None else matched.unionByName(found)
        rest = settle(rest.join(found, left, "left_anti").join(found, right, "left_anti"))


class Solution(NamedTuple):
    """An assignment with what proves how good it is."""

    matches: DataFrame  # group columns, h, w, score
    prices: DataFrame  # group columns, swapped, object, price: dual prices of the larger side, 0 where absent
    certificate: DataFrame  # group columns, n_bidders, n_matched, total, bound, epsilon


def _bids(rows: pd.DataFrame, steps: int, keys: list[str]) -> pd.DataFrame:
    """One block: bidders with their best candidates bid in turn until each has an object or is stuck.

    Of every bidder there are the object it holds, its best candidates when the list was made and,
    if it has more, ``beyond``: what the others gained at best then, which bounds them since, as
    prices only rise. A bidder whose list falls below it waits for a new list. Where every list is
    whole and nothing is held yet, ``steps`` coarser rounds come first, which leave their prices.
    """
    out = {k: rows[k].iloc[0] for k in keys}
    rows = rows.assign(_net=rows["price"] - (rows["score"] + rows["base"])).sort_values(["bidder", "_net", "item"], kind="stable")
    bidders = rows["bidder"].to_numpy()
    first = np.flatnonzero(np.append(True, bidders[1:] != bidders[:-1]))
    last = np.append(first[1:], len(rows))
    codes, items = pd.factorize(rows["item"])
    score, base = rows["score"].to_numpy(np.float64), float(rows["base"].iloc[0])
    value = score + base
    price = np.zeros(len(items))
    price[codes] = rows["price"].to_numpy(np.float64)
    n = len(first)
    beyond = rows["beyond"].to_numpy(np.float64)[first]
    lists = [codes[s:e] for s, e in zip(first.tolist(), last.tolist())]
    values = [value[s:e] for s, e in zip(first.tolist(), last.tolist())]
    final = float(rows["epsilon"].iloc[0])
    held = rows["held"].to_numpy(bool)
    holder = np.full(len(items), -1)
    holder[codes[held]] = np.repeat(np.arange(n), last - first)[held]
    whole = bool(np.isneginf(beyond).all()) and bool(rows["alone"].iloc[0]) and not held.any()
    ladder = [max(final, float(rows["range"].iloc[0]) / 8 / 10**k) for k in range(steps)] if whole else []
    for epsilon in [*ladder, final]:
        owner = holder.copy()
        retired: list[int] = []
        stuck: list[int] = []
        waiting = deque(np.setdiff1d(np.arange(n), owner).tolist())
        while waiting:
            b = waiting.popleft()
            net = values[b] - price[lists[b]]
            k = int(net.argmax())
            best = float(net[k])
            if best < beyond[b]:
                stuck.append(b)
                continue
            # Next to nothing counts as nothing: a bid has to move the price.
            if best <= 1e-6 * epsilon:
                retired.append(b)
                continue
            net[k] = -np.inf
            second = max(float(net.max()), beyond[b], epsilon)
            item = lists[b][k]
            price[item] += best - second + epsilon if best > second else min(best, epsilon)
            if owner[item] >= 0:
                waiting.append(int(owner[item]))
            owner[item] = b
    won = np.flatnonzero(owner >= 0)
    left = np.flatnonzero((owner < 0) & (price > 0)) if ladder else won[:0]
    names = bidders[first]
    made = pd.DataFrame(
        {
            # A bidder that gives up comes without an item, as does one that needs a new list (price below 0);
            # a price that coarse rounds left comes without a bidder.
            "item": pd.Series([*items[won].tolist(), *items[left].tolist(), *[None] * (len(retired) + len(stuck))], dtype=object),
            "bidder": pd.Series(
                [*names[owner[won]].tolist(), *[None] * len(left), *names[retired].tolist(), *names[stuck].tolist()], dtype=object
            ),
            "price": np.concatenate([price[won], price[left], np.zeros(len(retired)), np.full(len(stuck), -1.0)]),
        }
    )
    # The score of a holder's pair goes along, so that nobody has to look it up again.
    at = [first[b] + int(np.flatnonzero(lists[b] == item)[0]) for b, item in zip(owner[won].tolist(), won.tolist())]
    made["score"] = np.concatenate([score[at], np.full(len(made) - len(won), np.nan)]) if at else np.full(len(made), np.nan)
    made["base"] = base
    for k in keys:
        made[k] = out[k]
    return made[[*keys, "item", "bidder", "price", "score", "base"]]


# Candidates in the first list of a bidder whose cohort has several blocks.
SHORT = 16
# Offers in a block are at most this many for each bidder it may have, which bounds a task where many bid for much.
DENSE = 128
# Tables of counted rows up to this number are sent to all tasks.
SMALL = 100_000


def _sent(df: DataFrame) -> DataFrame:
    """A settled table, of whose size Spark knows nothing: counted, and broadcast when it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


class _Market:
    """Rounds of an auction over all cohorts. The driver counts; prices, bids and owners stay in tables.

    A bidder's list is made once, at the first prices, and short where a cohort has several blocks,
    so a round moves the lists and not all offers. Who has used up the list gets all its offers
    written aside (``far``), of which each round takes the ``width`` best at its prices.
    """

    def __init__(self, offers: DataFrame, keys: list[str], width: int, block: int, steps: int, market: DataFrame | None = None):
        # offers: keys, bidder, item, score, base, epsilon, range, number (of the cohort's bidders), offered (its
        # offers, if known); a pair is worth score + base, which is one number per cohort
        self.keys, self.width, self.steps = keys, width, steps
        self.known = (*keys, "_block", "bidder", "item", "score", "base", "epsilon", "range", "alone")
        most = F.ceil(F.col("number") / block)
        if "offered" in offers.columns:
            most = F.greatest(most, F.ceil(F.col("offered") / (block * DENSE)))
        blocks = F.greatest(F.lit(1), most).cast("int")
        placed = F.pmod(F.xxhash64("bidder"), blocks).cast("int")
        self.offers = offers.withColumn("alone", blocks == 1).withColumn("_block", placed).select(*self.known)
        length = F.when(F.col("alone"), width).otherwise(min(width, SHORT))
        listed = self._listed(self._priced(self.offers, market), length)
        if market is not None:
            # Prices only rise: who holds nothing and gains nothing at the first prices would give up at once.
            mine = Window.partitionBy(*keys, "bidder")
            gain = F.col("score") + F.col("base") - F.col("price")
            stays = F.col("held") | gain.isNull() | (gain > 1e-6 * F.col("epsilon"))
            listed = listed.withColumn("_stays", F.bool_or(stays).over(mine)).where("_stays")
        self.lists = settle(listed.select(*self.known, "beyond"))
        self.bidders = settle(self.lists.select(*keys, "_block", "bidder").distinct())
        self.stuck: DataFrame | None = None
        self.far: DataFrame | None = None

    def _priced(self, offers: DataFrame, market: DataFrame | None) -> DataFrame:
        if market is None:
            return offers.withColumn("price", F.lit(0.0)).withColumn("held", F.lit(False))
        priced = market.select(*self.keys, "item", "price", F.col("bidder").alias("_holder"))
        joined = offers.join(priced, [*self.keys, "item"], "left").na.fill(0.0, ["price"])
        return joined.withColumn("held", F.coalesce(F.col("_holder") == F.col("bidder"), F.lit(False))).drop("_holder")

    def _listed(self, priced: DataFrame, length: Column) -> DataFrame:
        """The held object and the best candidates, with what the next one gains."""
        mine = Window.partitionBy(*self.keys, "bidder")
        gain = F.col("score") + F.col("base") - F.col("price")
        order = mine.orderBy(F.desc("held"), F.desc(gain), "item")
        placed = priced.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.width + 1)
        least = F.min(F.when(F.col("place") == length + 1, gain)).over(mine)
        placed = placed.withColumn("beyond", F.coalesce(least, F.lit(float("-inf"))))
        return placed.where(F.col("place") <= length).drop("place")

    def _set_aside(self, made: DataFrame) -> None:
        """Write all offers of the bidders that need a new list and had none yet."""
        new = made.where(F.col("item").isNull() & (F.col("price") < 0)).select(*self.keys, "bidder")
        if self.stuck is not None:
            new = new.join(self.stuck, [*self.keys, "bidder"], "left_anti")
        if new.isEmpty():
            return
        new = settle(new)
        found = settle(self.offers.join(_sent(new), [*self.keys, "bidder"], "left_semi"))
        self.stuck = new if self.stuck is None else self.stuck.unionByName(new)
        self.far = found if self.far is None else self.far.unionByName(found)

    def run(self, market: DataFrame | None, epsilon: Column, rounds: int | None = None) -> DataFrame:
        """Bid from the prices of ``market`` until nobody is open, or ``rounds`` times.

        Returns the market then: keys, item, price, bidder, score and base of their pair; an
        item that nobody ever wanted has no row. Prices never fall below those the lists were made at.
        """
        keys, retired, done = self.keys, None, 0
        fields = {f.name: f.dataType for f in self.offers.schema.fields}
        schema = T.StructType(
            [T.StructField(k, fields[k]) for k in [*keys, "item", "bidder"]]
            + [T.StructField(c, T.DoubleType()) for c in ("price", "score", "base")]
        )
        steps = self.steps
        while rounds is None or done < rounds:
            taken = None if market is None else market.where(F.col("bidder").isNotNull()).select(*keys, "bidder")
            free = self.bidders
            for gone in (taken, retired):
                free = free if gone is None else free.join(gone, [*keys, "bidder"], "left_anti")
            # Blocks with a bidder that has nothing; the others in them may be outbid and go on.
            active = None if market is None and retired is None else settle(free.select(*keys, "_block").distinct())

            def wanted(offers: DataFrame, gone: DataFrame | None = retired, active: DataFrame | None = active) -> DataFrame:
                if active is not None:
                    offers = offers.join(active, [*keys, "_block"], "left_semi")
                return offers if gone is None else offers.join(gone, [*keys, "bidder"], "left_anti")

            near = self.lists if self.stuck is None else self.lists.join(self.stuck, [*keys, "bidder"], "left_anti")
            listed = self._priced(wanted(near), market)
            if self.far is not None:
                listed = listed.unionByName(self._listed(self._priced(wanted(self.far), market), F.lit(self.width)))
            listed = listed.withColumn("epsilon", epsilon)
            made = settle(listed.groupBy(*keys, "_block").applyInPandas(lambda rows: _bids(rows, steps, keys), schema))
            done += 1
            if made.isEmpty():
                break
            self._set_aside(made)
            gone = made.where(F.col("item").isNull() & (F.col("price") >= 0)).select(*keys, "bidder")
            retired = gone if retired is None else retired.unionByName(gone)
            kept = (*keys, "item", "price", "bidder", "score", "base")
            bids = made.where(F.col("item").isNotNull()).select(*kept)
            if market is not None:
                bids = bids.unionByName(market.select(*kept))
            # A new bid is above the standing price; of several blocks the highest one holds.
            best = bids.groupBy(*keys, "item").agg(F.max(F.struct("price", "bidder", "score", "base")).alias("_b"))
            market = settle(best.select(*keys, "item", "_b.*"))
        if market is None:
            return self.offers.select(*keys, "item", F.lit(0.0).alias("price"), "bidder", "score", "base").limit(0)
        return market


def auction(
    scores: DataFrame,
    group: Sequence[str] = ("year",),
    epsilon: float | None = None,
    outside: float | None = None,
    width: int = 1024,
    block: int = 16_384,
    steps: int = 4,
) -> Solution:
    """Assignment with the greatest total score, by a scaled auction (Bertsekas 1988, Bertsekas and Castanon 1992).

    The smaller side of each cohort bids for the larger one. A round lists the ``width`` best
    candidates of every bidder without an object, at current prices; blocks of ``block`` bidders
    are tasks that bid until their lists are used up, and the highest bid for each object holds. Large
    blocks settle among themselves what small ones settle from round to round; where bidders have more than
    ``DENSE`` offers on average, blocks are smaller.
    Prices travel from task to task. ``steps`` rounds with a coarse step (range / 8, then a tenth
    each) go ahead, so prices are near their place when the last step begins. Objects that end
    with a price and no owner then bid for the other side in the same way, until each such
    price has gone; this makes the total within (number of bidders) * epsilon of the optimum
    whatever prices the last step began with.

    ``outside`` is the score below which staying unmatched is better. By default a match is
    worth its score plus the cohort's score range above its lowest score, whatever the sign:
    on complete scores the whole smaller side is matched, and where scores are missing a pair
    is given up only if that wins more elsewhere. The default epsilon is a 1/(4n) part of the
    cohort's score range, n being its number of bidders.

    ``certificate`` proves it: by weak duality no assignment is worth more than ``bound``, the
    sum of prices and of what each bidder gains at best at these prices.
    """
    keys = list(group)
    table = settle(scores.select(*keys, "h", "w", F.col("score").cast("double").alias("score")))
    sides = table.groupBy(*keys).agg(
        F.count_distinct("h").alias("_nh"),
        F.count_distinct("w").alias("_nw"),
        F.count("*").alias("offered"),
        F.min("score").alias("_low"),
        (F.max("score") - F.min("score")).alias("range"),
    )
    sides = _sent(settle(sides))
    number = F.least("_nh", "_nw")
    step = F.greatest(F.col("range") / (4.0 * number), F.lit(1e-9)) if epsilon is None else F.lit(float(epsilon))
    # What a match is worth above staying unmatched.
    base = F.lit(-float(outside)) if outside is not None else F.col("range") + step - F.col("_low")
    swapped = F.col("_nw") < F.col("_nh")
    offers = table.join(sides, keys).select(
        *keys,
        F.when(swapped, F.col("w")).otherwise(F.col("h")).alias("bidder"),
        F.when(swapped, F.col("h")).otherwise(F.col("w")).alias("item"),
        "score",
        base.alias("base"),
        step.alias("epsilon"),
        "range",
        number.alias("number"),
        "offered",
    )
    worth = F.col("score") + F.col("base")
    forward = _Market(offers, keys, width, block, steps)
    market = None
    if not forward.lists.where(~F.col("alone")).isEmpty():
        # Cohorts of several blocks: one round for each coarse step, of which only prices stay.
        for k in range(steps):
            coarse = F.greatest(F.col("epsilon"), F.col("range") / (8.0 * 10**k))
            market = forward.run(market, coarse, rounds=1)
            # Nobody bid for the others in this step, so their prices are of no use, and would all have to be bid down in reverse.
            market = market.where(F.col("bidder").isNotNull())
            market = market.withColumn("bidder", F.lit(None).cast(offers.schema["bidder"].dataType))
    market = forward.run(market, F.col("epsilon"))

    # Objects left with a price: they bid for bidders, whose price is what these gain now.
    dear = market.where(F.col("bidder").isNull() & (F.col("price") > 0))
    held = market.where(F.col("bidder").isNotNull())
    if not dear.isEmpty():
        gains = settle(
            held.select(
                *keys, F.col("bidder").alias("item"), (worth - F.col("price")).alias("price"), F.col("item").alias("bidder"), "score", "base"
            )
        )
        priced = market.where(F.col("price") > 0).select(*keys, "item")
        back = offers.join(priced, [*keys, "item"], "left_semi").select(
            *keys, F.col("item").alias("bidder"), F.col("bidder").alias("item"), "score", "base", "epsilon", "range", "number", "offered"
        )
        back = settle(back)
        reverse = _Market(back, keys, width, block, 0, gains).run(gains, F.col("epsilon"))
        held = reverse.where(F.col("bidder").isNotNull()).select(
            *keys, F.col("bidder").alias("item"), F.greatest(worth - F.col("price"), F.lit(0.0)).alias("price"),
            F.col("item").alias("bidder"), "score", "base",
        )
    held = settle(held)
    won = held.join(sides.select(*keys, swapped.alias("swapped")), keys)
    matches = won.select(
        *keys,
        F.when(F.col("swapped"), F.col("item")).otherwise(F.col("bidder")).alias("h"),
        F.when(F.col("swapped"), F.col("bidder")).otherwise(F.col("item")).alias("w"),
        "score",
    )
    prices = won.select(*keys, "swapped", F.col("item").alias("object"), "price")
    total = won.groupBy(*keys).agg(F.count("*").alias("n_matched"), F.sum(worth).alias("total"))
    certificate = dual_bound(offers.withColumn("value", worth), held, keys).join(total, keys, "left").na.fill(0.0, ["total"]).na.fill(0, ["n_matched"])
    return Solution(matches, prices, certificate.select(*keys, "n_bidders", "n_matched", "total", "bound", "epsilon"))


def dual_bound(offers: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upper bound of the total value of any assignment per cohort, from prices of the objects (0 or more).

    An object not in ``prices`` costs nothing. Whoever is matched gains value - price, so the
    total is at most the best gains of all bidders plus all prices.
    """
    keys = list(keys)
    joined = offers.join(prices.select(*keys, "item", "price"), [*keys, "item"], "left").na.fill(0.0, ["price"])
    best = joined.groupBy(*keys, "bidder").agg(
        F.greatest(F.max(F.col("value") - F.col("price")), F.lit(0.0)).alias("gain"), F.first("epsilon").alias("epsilon")
    )
    gains = best.groupBy(*keys).agg(F.count("*").alias("n_bidders"), F.sum("gain").alias("_gains"), F.first("epsilon").alias("epsilon"))
    paid = prices.groupBy(*keys).agg(F.sum("price").alias("_paid"))
    both = gains.join(paid, keys, "left").na.fill(0.0, ["_paid"])
    return both.select(*keys, "n_bidders", (F.col("_gains") + F.col("_paid")).alias("bound"), "epsilon")


def assign_auction(scores: DataFrame, group: Sequence[str] = ("year",), **options) -> DataFrame:
    """The matches of ``auction``: group columns, h, w, score."""
    return auction(scores, group, **options).matches


def assign_one_to_one(scores: DataFrame, method: str = "auction", **options) -> DataFrame:
    if method == "auction":
        return assign_auction(scores, **options)
    if method == "greedy":
        return assign_greedy(scores, **options)
    raise ValueError(f"unknown method {method!r}")


def assignment_correct(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Per left entity with a true partner: is that partner the assigned one."""
    matched = assignment.select("year", "h", F.col("w").alias("_aw"))
    return truth.join(matched, ["year", "h"], "left").select(
        "year", "h", "true_w", F.coalesce(F.col("_aw") == F.col("true_w"), F.lit(False)).alias("correct")
    )


# The functions that run in Python tasks travel with them, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
