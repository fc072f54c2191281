"""Problem 4: choosing a varied subset by max-sum dispersion over composable core-sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.session import Scratch

#: Records of one core-set task; the tree of core-sets is as deep as the logarithm of the records to this base.
PART = 2000
#: A swap must raise the objective by this share of its size per pick, which bounds the number of swaps.
GAIN = 1e-3
#: Weight of the distance between systems beside the distance of the sets (one minus overlap).
SYSTEM_WEIGHT = 0.25


class _Part:
    """Distances within one part, by sparse counts; memory is the part's tokens and one row per pick."""

    def __init__(self, tokens: list[np.ndarray], systems: np.ndarray):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        _, flat = np.unique(np.concatenate(tokens), return_inverse=True)
        self.flat = flat.reshape(-1)
        self.width = int(self.flat.max()) + 1
        self.systems = systems

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def count(self, marked: np.ndarray) -> np.ndarray:
        """Of each record the sum of ``marked`` over its tokens."""
        return np.add.reduceat(marked[self.flat], self.starts)

    def distance(self, i: int) -> np.ndarray:
        marked = np.zeros(self.width, dtype=np.int64)
        marked[self.row(i)] = 1
        shared = self.count(marked)
        apart = 1 - shared / (self.sizes + self.sizes[i] - shared)
        return apart + SYSTEM_WEIGHT * (self.systems != self.systems[i])


def local_search(tokens: list[np.ndarray], systems: np.ndarray, size: int) -> np.ndarray:
    """Positions of ``size`` records: a greedy start, then swaps while the objective increases.

    The objective is the sum of all pairwise distances, plus the number of tokens covered in the same scale (a
    monotone submodular term, which local search carries along). Ties go to the earlier record.
    """
    n = len(tokens)
    if n <= size:
        return np.arange(n)
    part = _Part(tokens, systems)
    scale = (size - 1) / (2 * max(1.0, part.sizes.mean()))
    times = np.zeros(part.width, dtype=np.int64)
    picked, rows, total = [], [], np.zeros(n)
    free = np.ones(n, dtype=bool)
    while len(picked) < size:
        gain = np.where(free, total + scale * part.count((times == 0).astype(np.int64)), -np.inf)
        best = int(gain.argmax())
        picked.append(best)
        rows.append(part.distance(best))
        total += rows[-1]
        times[part.row(best)] += 1
        free[best] = False
    value = total[picked].sum() / 2 + scale * (times > 0).sum()
    swapped = True
    while swapped:
        swapped = False
        for k in np.argsort([total[p] for p in picked], kind="stable"):
            out = picked[k]
            times[part.row(out)] -= 1
            covers = scale * part.count((times == 0).astype(np.int64))
            gain = np.where(free, total - rows[k] + covers, -np.inf)
            best = int(gain.argmax())
            rise = gain[best] - (total[out] + covers[out])
            if rise > GAIN * value / size:
                free[out], free[best] = True, False
                new = part.distance(best)
                total += new - rows[k]
                picked[k], rows[k] = best, new
                value += rise
                swapped = True
                out = best
            times[part.row(out)] += 1
    return np.sort(np.array(picked))


def _core(size: int):
    def core(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        kept = local_search([np.asarray(t) for t in pdf["tokens"]], pdf["system"].to_numpy(), size)
        return pdf.iloc[kept][["id", "system", "tokens"]]

    return core


def varied_subset(scratch: Scratch, sets: DataFrame, size: int, part: int = PART) -> DataFrame:
    """``id, system, tokens`` of ``size`` records (all, if there are fewer), out of ``sets(id, system, tokens)``.

    Records are dealt to parts by a hash of their id, so a large family or system is spread over all parts. Each part
    is reduced to a core-set of ``size`` by local search; the core-sets are dealt again until one part is left, whose
    local search gives the subset. No task holds more than about ``part`` records. A null system is a system.
    """
    part = max(part, 4 * size)
    rows = sets.select("id", F.coalesce("system", F.lit("")).alias("system"), "tokens").where(F.size("tokens") > 0)
    left = rows.count()
    turn = 0
    while True:
        parts = max(1, math.ceil(left / part))
        # parts are filled to three quarters on average, so that the hash's unevenness keeps them below the bound
        parts = 1 if parts == 1 else math.ceil(left / (0.75 * part))
        dealt = rows.withColumn("part", F.expr(f"pmod(xxhash64(id, {turn}), {parts})"))
        rows = scratch.keep(dealt.groupBy("part").applyInPandas(_core(size), "id long, system string, tokens array<long>"))
        if parts == 1:
            return rows
        left, turn = rows.count(), turn + 1
