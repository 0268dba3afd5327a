"""Which pairs of records and settlements of one group (a day's nearest, one amount) can still be listed.

A record meets all settlements of its group, but only a few rows of it go on: pairs are scored in blocks of numpy arrays, with
wording and identifiers, and those that a shortlist's worth of others beats are left out. What is kept is ranked again by the
plan's own expressions, so sums in another order change nothing: ``SLACK`` is far above what they differ by.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DAY_MICROS
from ..schemas import Policy

SLACK = 1e-6
#: Pairs that are scored at once, records and settlements of a group that meet in one call, and records that a call is given.
BLOCK, RECORDS, SETTLEMENTS, CALL = 250_000, 4096, 65_536, 4096


def deal(left: DataFrame, right: DataFrame, group: str, calls: int, records: int = RECORDS, settlements: int = SETTLEMENTS) -> tuple[DataFrame, DataFrame]:
    """Both sides with call, l_part and r_part: groups share calls by hash, and those of too many rows are dealt into parts that all meet."""
    parts = lambda rows, most, name: F.broadcast(rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).filter(F.col(name) > 1))
    many_left, many_right = parts(left, records, "l_parts"), parts(right, settlements, "r_parts")
    call = F.pmod(F.xxhash64(group), F.lit(calls)).cast("int").alias("call")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    sides = []
    for rows, key, mine, other in ((left, "seq", "l", "r"), (right, "pop_seq", "r", "l")):
        joined = rows.join(many_left, group, "left").join(many_right, group, "left")
        sides.append(joined.select(*rows.columns, call, own(key, F.col(f"{mine}_parts")).alias(f"{mine}_part"), every(F.col(f"{other}_parts")).alias(f"{other}_part")))
    return sides[0], sides[1]


def _wording(rows: DataFrame, known: bool, weighed: bool) -> tuple[Column, Column, Column]:
    """Tokens, their weights and the total weight of each row; nothing where they aren't known."""
    none = F.array().cast("array<string>")
    if not known:
        return none.alias("tokens"), F.array().cast("array<double>").alias("weights"), F.lit(0.0).alias("total")
    if weighed:
        return F.map_keys("weights").alias("tokens"), F.map_values("weights").alias("weights"), F.col("total")
    return F.col("tokens"), F.array().cast("array<double>").alias("weights"), F.col("total")


def promising_pairs(left: DataFrame, right: DataFrame, group: Column, policy: Policy, calls: int | None = None) -> DataFrame:
    """seq, pop_seq, place of the pairs within a group that may be listed.

    ``left`` has prepared ledger columns, ``right`` those of settlements with place, doubled and ``group``. Without weights of
    wording, a pair may still gain all that wording can add. Implausible amounts stay only where a record has no plausible one.
    Settlements that are ``doubled`` (merged later) are neither pruned nor counted.
    """
    from .scoring import WORDING

    known = "weights" in left.columns and "total" in right.columns
    # Records are a table already where it matters, so they are counted from its footers.
    calls = calls or max(1, math.ceil(left.count() / CALL))
    stamp = F.unix_micros(F.col("order_date")).alias("at")
    ours = left.select(group.alias("grp"), "seq", F.col("amount_minor").alias("amount"), stamp, "cores", *_wording(left, known, True))
    theirs = right.select("grp", "pop_seq", "place", F.col("gross_amount_minor").alias("amount"), stamp, "cores", *_wording(right, known, False), "doubled")
    theirs = theirs.join(ours.select("grp").distinct(), "grp", "left_semi")
    ours, theirs = deal(ours, theirs, "grp", calls)
    keys = ("call", "l_part", "r_part")
    found = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys))
    return found.applyInArrow(chooser(policy, SLACK + (0.0 if known else WORDING)), "seq bigint, pop_seq bigint, place int")


def chooser(policy: Policy, slack: float, block: int = BLOCK) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of a call: both sides' rows to the pairs that are kept."""
    from .scoring import WORDING

    top, tolerance, span = policy.candidate_shortlist_size, policy.amount_tolerance_minor, max(policy.candidate_search_window_days, 1)

    def numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        column = table[name].combine_chunks()
        return pc.fill_null(column, pa.scalar(0).cast(column.type)).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)

    def texts(tables: tuple[pa.Table, pa.Table], name: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side: codes of all texts in the rows' arrays, one after the other, and where each row's begin."""
        lists = [pa.concat_arrays([c.cast(pa.list_(pa.string())) for c in t[name].chunks] or [pa.array([], pa.list_(pa.string()))]) for t in tables]
        flat = [x.flatten() for x in lists]
        codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]).astype(np.int64) for x in lists]
        return [(codes[: len(flat[0])], starts[0]), (codes[len(flat[0]) :], starts[1])]

    def met(ours: tuple[np.ndarray, np.ndarray], a: int, b: int, theirs: tuple[np.ndarray, np.ndarray], c: int, d: int, weights: np.ndarray | None) -> np.ndarray:
        """Weight (or number) of the codes that rows a to b and c to d have in common, as a matrix."""
        (lc, ls), (rc, rs) = ours, theirs
        mine, other = lc[ls[a] : ls[b]], rc[rs[c] : rs[d]]
        order = np.argsort(other, kind="stable")
        owners = np.repeat(np.arange(d - c), np.diff(rs[c : d + 1]))[order]
        other = other[order]
        low = np.searchsorted(other, mine, "left")
        n = np.searchsorted(other, mine, "right") - low
        rows = np.repeat(np.repeat(np.arange(b - a), np.diff(ls[a : b + 1])), n)
        cols = owners[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
        worth = np.repeat(weights[ls[a] : ls[b]], n) if weights is not None else None
        return np.bincount(rows * (d - c) + cols, worth, (b - a) * (d - c)).reshape(b - a, d - c)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"seq": pa.array([], pa.int64()), "pop_seq": pa.array([], pa.int64()), "place": pa.array([], pa.int32())})
        if not left.num_rows or not right.num_rows:
            return empty
        left, right = left.sort_by("grp"), right.sort_by("grp")
        lg, rg = (numbers(t, "grp")[0] for t in (left, right))
        (amount, has_amount), (at, has_at), total = numbers(left, "amount"), numbers(left, "at"), numbers(left, "total")[0]
        (gross, has_gross), (s_at, s_has_at), s_total = numbers(right, "amount"), numbers(right, "at"), numbers(right, "total")[0]
        doubled = numbers(right, "doubled")[0].astype(bool)
        (lt, rt), (lcore, rcore) = texts((left, right), "tokens"), texts((left, right), "cores")
        weights = pa.concat_arrays([c.flatten() for c in left["weights"].chunks]).to_numpy(zero_copy_only=False)
        wordless, s_wordless = np.diff(lt[1]) == 0, np.diff(rt[1]) == 0
        groups = np.unique(lg)
        la, lb, ra, rb = np.searchsorted(lg, groups), np.searchsorted(lg, groups, "right"), np.searchsorted(rg, groups), np.searchsorted(rg, groups, "right")
        size = rb - ra
        # Groups of no more settlements than a shortlist has keep all their pairs.
        few = np.repeat(np.where(size <= top, size, 0), lb - la)
        rows = [np.repeat(np.arange(len(lg)), few)]
        cols = [np.arange(few.sum()) + np.repeat(np.repeat(ra, lb - la) - (np.cumsum(few) - few), few)]
        for g in np.flatnonzero(size > top):
            c, d = int(ra[g]), int(rb[g])
            step = max(1, block // (d - c))
            for a in range(int(la[g]), int(lb[g]), step):
                b = min(a + step, int(lb[g]))
                ours, own = amount[a:b, None], has_amount[a:b, None] & has_gross[None, c:d]
                off = np.abs(gross[None, c:d] - ours)
                with np.errstate(divide="ignore", invalid="ignore"):
                    agreed = np.where(own & (off <= tolerance), 1.0, np.where(own & (ours > 0), np.maximum(0.0, 1.0 - np.minimum(off / ours, 1.0) * 2.0), 0.0))
                    ratio = gross[None, c:d] / ours
                plausible = (has_amount[a:b, None] & (ours <= 0)) | (own & (ratio >= 0.5) & (ratio <= 2.0))
                days = np.abs((s_at[None, c:d] - at[a:b, None]) // DAY_MICROS)
                date = np.where(has_at[a:b, None] & s_has_at[None, c:d], np.maximum(0.0, 1.0 - days / span), 0.0)
                shared = met(lt, a, b, rt, c, d, weights)
                union = total[a:b, None] + s_total[None, c:d] - shared
                similarity = np.where(wordless[a:b, None] & s_wordless[None, c:d], 1.0, np.divide(shared, union, out=np.zeros(union.shape), where=union > 0))
                if slack > WORDING:  # nothing is known of wording
                    similarity = 0.0
                score = 0.45 * agreed + 0.25 * (met(lcore, a, b, rcore, c, d, None) > 0) + 0.10 * date + WORDING * similarity
                counted = plausible & ~doubled[None, c:d]
                counted = np.where(counted.any(axis=1)[:, None], counted, ~doubled[None, c:d])
                score = np.where(counted, score, -1.0)
                last = np.partition(score, d - c - top, axis=1)[:, d - c - top]
                i, j = np.nonzero(doubled[None, c:d] | (counted & (score + slack >= last[:, None])))
                rows.append(i + a)
                cols.append(j + c)
        i, j = np.concatenate(rows), np.concatenate(cols)
        return pa.table({"seq": left["seq"].take(pa.array(i)).combine_chunks().cast(pa.int64()), "pop_seq": right["pop_seq"].take(pa.array(j)).combine_chunks().cast(pa.int64()), "place": right["place"].take(pa.array(j)).combine_chunks().cast(pa.int32())})

    return choose
