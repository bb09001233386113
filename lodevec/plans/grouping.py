"""How an uneven quantizer shares its bits: budgets by reverse water-filling, group sizes, and dimensions to groups."""

from __future__ import annotations

import numpy as np

from lodevec.plans.config import need

BITS = 4.0


def bit_budgets(variance: np.ndarray, groups: int) -> np.ndarray:
    """Bits for each dimension: half the log2 variance above a level such that all bits are spent.

    With heights in falling order the level is the mean height of the first k less what they spend, for the largest k
    whose smallest height is still above it.
    """
    top = float(variance.max(initial=0.0))
    need(top > 0, "all dimensions are constant")
    height = 0.5 * np.log2(np.maximum(variance, top * 1e-12))
    falling = np.sort(height)[::-1]
    levels = (np.cumsum(falling) - BITS * groups) / np.arange(1, len(falling) + 1)
    level = levels[np.flatnonzero(falling >= levels)[-1]]
    return np.maximum(height - level, 0.0)


def group_sizes(budgets: np.ndarray, groups: int, max_dims: int = 0) -> np.ndarray:
    """Dimensions in each group, in falling order, equal sizes in pairs: nearly even at first, then single dimensions
    move between pairs of groups while that brings the loads nearer to their aim (at most 16 times)."""
    pairs, d = groups // 2, len(budgets)
    most = max_dims or -(-d // groups) + 2
    base, more = divmod(d // 2, pairs)
    half = np.array([base + (i < more) for i in range(pairs)])

    def cost(h: np.ndarray) -> float:
        sizes = np.repeat(h, 2)
        loads = np.bincount(dims_to_groups(budgets, sizes), budgets, len(sizes))
        return float(((loads - BITS) ** 2).sum())

    best = cost(half)
    for _ in range(16):
        trials = []
        for i in range(pairs):
            for j in range(pairs):
                if i != j and half[i] > 1 and half[j] < most:
                    moved = half.copy()
                    moved[[i, j]] += (-1, 1)
                    trials.append((cost(moved), tuple(sorted(moved, reverse=True))))
        if not trials or min(trials)[0] >= best - 1e-12:
            break
        best, chosen = min(trials)
        half = np.array(chosen)
    return np.sort(np.repeat(half, 2))[::-1]


def dims_to_groups(budgets: np.ndarray, sizes: np.ndarray, swaps: int = 8) -> np.ndarray:
    """The group of each dimension: the largest budget goes to the lightest group with room (ties: the smaller group,
    then the first), then up to so many swaps that lower the sum of squared loads the most."""
    group, load, room = np.zeros(len(budgets), np.int64), np.zeros(len(sizes)), sizes.copy()
    for dim in np.lexsort((np.arange(len(budgets)), -budgets)):
        g = min((g for g in range(len(sizes)) if room[g]), key=lambda g: (load[g], sizes[g], g))
        group[dim], load[g], room[g] = g, load[g] + budgets[dim], room[g] - 1
    for _ in range(swaps):
        # Swapping a and b moves the difference of their budgets from one load to the other.
        gap = budgets[:, None] - budgets[None, :]
        la, lb = load[group][:, None], load[group][None, :]
        gain = np.where(group[:, None] != group[None, :], la**2 + lb**2 - (la - gap) ** 2 - (lb + gap) ** 2, -np.inf)
        a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[a, b] <= 1e-12:
            break
        x, y = group[a], group[b]
        load[x] -= gap[a, b]
        load[y] += gap[a, b]
        group[a], group[b] = y, x
    return group


def layout(variance: np.ndarray, groups: int, max_dims: int = 0) -> list[np.ndarray]:
    """The dimensions of each group, larger groups first; each dimension is in exactly one."""
    budgets = bit_budgets(variance, groups)
    sizes = group_sizes(budgets, groups, max_dims)
    group = dims_to_groups(budgets, sizes)
    out = [np.flatnonzero(group == g) for g in range(groups)]
    need(sorted(np.concatenate(out)) == list(range(len(variance))) and all(len(x) for x in out), "the layout isn't a partition of the dimensions")
    return out
