"""Exact intensional stability of concepts: how many sets of their customers generate them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid of the largest losses (1 - stability) that a filter may allow.
LOSS_GRID = (1.0, 6.2e-2, 3.9e-3, 1.5e-5, 5.4e-20)
MAX_LOSS = 5.4e-20
MAX_STATES = 500_000


def lower_neighbours(groups: dict[int, int], intent: int) -> list[frozenset[int]]:
    """The maximal proper sub-extents of an extent, as sets of masks: for each attribute outside the intent, the masks having it.

    An extent without any such attribute has one, the empty extent.
    """
    outside = 0
    for mask in groups:
        outside |= mask & ~intent
    found = set() if outside else {frozenset()}
    while outside:
        bit = outside & -outside
        outside ^= bit
        found.add(frozenset(m for m in groups if m & bit))
    return [a for a in found if not any(a < b for b in found)]


#: A whole number as a sparse sum of powers of two: exponent to digit, 1 or -1, of which no two are neighbours. The form is unique.
Powers = dict[int, int]


def powers(terms: dict[int, int]) -> Powers:
    """The sum of coefficient * 2^exponent in its one sparse form; work and memory go with the terms, not with the exponents."""
    out: Powers = {}
    left = sorted(terms.items(), reverse=True)
    at = carry = 0
    while left or carry:
        if not carry:
            at = left[-1][0]
        while left and left[-1][0] == at:
            carry += left.pop()[1]
        if carry & 1:  # the digit that makes the next place even
            above = left[-1][1] if left and left[-1][0] == at + 1 else 0
            out[at] = 1 if ((carry - 1) // 2 + above) % 2 == 0 else -1
            carry -= out[at]
        carry >>= 1
        at += 1
    return out


def added(a: Powers, b: Powers, sign: int = 1) -> Powers:
    """a + sign * b."""
    return powers({e: a.get(e, 0) + sign * b.get(e, 0) for e in a.keys() | b.keys()})


def compared(a: Powers, b: Powers) -> int:
    """-1, 0 or 1: the sign of a - b, which its highest power has."""
    less = added(a, b, -1)
    return less[max(less)] if less else 0


def scaled(number: Powers, exponent: int) -> float:
    """number / 2^exponent as a double; 0 where it is smaller than any."""
    if not number:
        return 0.0
    top = max(number)
    lead = math.fsum(math.ldexp(d, e - top) for e, d in number.items() if e > top - 200)
    return math.ldexp(lead, max(-2000, top - exponent))


def log2_of(number: Powers, exponent: int) -> float:
    """log2(number / 2^exponent) for any exponents; -inf for 0 and less."""
    if not number or number[max(number)] < 0:
        return -math.inf
    top = max(number)
    return top - exponent + math.log2(scaled(number, top))


def log2_share(number: Powers, exponent: int) -> float:
    """log2 of a share of at most 1; next to 1 from the exact loss, which a double of the share would hide."""
    if not number or number[max(number)] < 0:
        return -math.inf
    loss = scaled(added({exponent: 1}, number, -1), exponent)
    return math.log1p(-loss) / math.log(2) if 2 * abs(loss) < 1 else log2_of(number, exponent)


def written(number: Powers) -> str:
    """The number as text, highest power first: +2^70-2^3."""
    return "".join(f"{'+' if d > 0 else '-'}2^{e}" for e, d in sorted(number.items(), reverse=True)) or "0"


def generators(groups: dict[int, int], intent: int, max_states: int = MAX_STATES) -> Powers | None:
    """Subsets of the extent whose common attributes are exactly the intent; None beyond ``max_states`` states.

    groups holds how many customers have each mask. A subset fails if it lies
    within a lower neighbour; inclusion and exclusion over the neighbours,
    equal intersections added up as they arise, counts those that don't. An
    extent of n customers has 2^n subsets; counts stay sums of a few powers of
    two, so n may be of any size.
    """
    place = {m: 1 << i for i, m in enumerate(groups)}
    signed: dict[int, int] = {}  # by the masks of an intersection, as bits
    # the empty set has every attribute in common; it lies within any lower neighbour
    for low in lower_neighbours(groups, intent):
        low = sum(place[m] for m in low)
        fresh: dict[int, int] = {low: -1}
        for known, sign in signed.items():
            both = known & low
            fresh[both] = fresh.get(both, 0) - sign
        for extent, sign in fresh.items():
            signed[extent] = signed.get(extent, 0) + sign
            if not signed[extent]:
                del signed[extent]
        if len(signed) > max_states:
            return None
    sizes = list(groups.values())
    terms = {sum(sizes): 1}
    for extent, sign in signed.items():
        size = 0
        while extent:
            bit = extent & -extent
            size += sizes[bit.bit_length() - 1]
            extent ^= bit
        terms[size] = terms.get(size, 0) + sign
    return powers(terms)


def brute_force_generators(masks: list[int], intent: int) -> int:
    """The same by going through all subsets: for extents of 20 customers at most."""
    if len(masks) > 20:
        raise ValueError("too many customers")
    count = 0
    for chosen in range(1 << len(masks)):
        common = -1
        for i, m in enumerate(masks):
            if chosen >> i & 1:
                common &= m
        count += common == intent
    return count


def kuznetsov(concepts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(intent_mask, n_generators, stability, log2_stability, loss, log2_loss, status) of concepts over profiles (mask, n).

    ``n_generators`` is the exact number, written as a sum of powers of two.
    A concept meets its profiles, whose number thresholds bound, and is
    counted in one task; its customers are only counts, of any size.
    ``status`` is exact, or capped where inclusion and exclusion would exceed
    the state limit; a capped concept has no numbers.
    """
    met = profiles.groupBy("mask").agg(F.sum("n").alias("n"))
    met = met.join(F.broadcast(concepts.select("intent_mask")), F.col("mask").bitwiseAND(F.col("intent_mask")) == F.col("intent_mask"))
    extents = met.groupBy("intent_mask").agg(F.collect_list(F.struct("mask", "n")).alias("groups"))

    def count(frames):
        for frame in frames:
            out = []
            for intent, groups in zip(frame["intent_mask"], frame["groups"], strict=True):
                sizes = {int(g["mask"]): int(g["n"]) for g in groups}
                total, made = sum(sizes.values()), generators(sizes, int(intent))
                if made is None:
                    out.append((intent, None, None, None, None, None, "capped"))
                    continue
                lost = added({total: 1}, made, -1)
                out.append((intent, written(made), scaled(made, total), log2_share(made, total), scaled(lost, total), log2_of(lost, total), "exact"))
            yield pd.DataFrame(out, columns=["intent_mask", "n_generators", "stability", "log2_stability", "loss", "log2_loss", "status"])

    return extents.mapInPandas(count, "intent_mask long, n_generators string, stability double, log2_stability double, loss double, log2_loss double, status string")


def stability_filter(concepts: DataFrame, profiles: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The concepts of exactly known stability that lose ``max_loss`` at most: 1 less the stability as a double.

    A capped concept is none of them; ``kuznetsov`` reports it.
    """
    kept = kuznetsov(concepts, profiles).where((F.col("status") == "exact") & (1 - F.col("stability") <= max_loss)).select("intent_mask")
    return concepts.join(F.broadcast(kept), "intent_mask", "left_semi")
