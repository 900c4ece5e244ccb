"""Exact order statistics without sorting or gathering the column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Steps of the grid of quantiles a pass takes, accuracy of the sketch they come from, and values that are collected at last.
STEPS = 512
ACCURACY = 4096
SMALL = 4096


def _inside(value, low, high):
    """Strictly between the bounds; None is no bound."""
    test = value.isNotNull()
    if low is not None:
        test = test & (value > F.lit(low))
    return test if high is None else test & (value < F.lit(high))


def order_statistics(df: DataFrame, name: str, ranks: Sequence[int]) -> list[float]:
    """Values at zero-based ranks of a finite double column.

    One mergeable sketch per rank brackets it and the next pass counts exactly how many values lie below, at and inside the
    bracket, so all ranks narrow together, some hundredfold a pass, until few values are left, which are collected. A
    bracket that the sketch has missed shows in the counts and is taken wider.
    """
    value = F.col(name)
    wanted = list(dict.fromkeys(ranks))
    found: dict[int, float] = {}
    # rank: bounds that are known not to hold it, bounds to be tried inside them, margin of the try
    state = {r: (None, None, None, None, 2) for r in wanted}
    while len(found) < len(wanted):
        open_ = [r for r in wanted if r not in found]
        aggregates, names = [], {}
        for r in open_:
            low, high, a, b, _ = state[r]
            # ranks with the same bounds, as all have in the first pass, share one sketch
            if state[r][:4] in names:
                continue
            k = names[state[r][:4]] = len(names)
            inside = _inside(value, a if a is not None else low, b if b is not None else high)
            held = F.when(inside, value)
            grid = F.percentile_approx(held, [s / STEPS for s in range(STEPS + 1)], ACCURACY)
            at = [F.count_if(value < F.lit(a)), F.count_if(value == F.lit(a)), F.count_if(value == F.lit(b))] if a is not None else [F.lit(0)] * 3
            under = F.count_if(value <= F.lit(low)) if low is not None else F.lit(0)
            aggregates.append(F.struct(under.alias("under"), at[0].alias("below"), at[1].alias("at_a"), at[2].alias("at_b"), F.count(held).alias("n"), F.min(held).alias("lo"), F.max(held).alias("hi"), grid.alias("grid")).alias(f"r{k}"))
        row = df.agg(*aggregates).first()
        small = {}
        for r in open_:
            low, high, a, b, margin = state[r]
            seen = row[f"r{names[state[r][:4]]}"]
            if a is None:
                below = seen["under"]
            else:
                if r < seen["below"]:
                    state[r] = (low, high, None, None, margin * 8)
                    continue
                if r < seen["below"] + seen["at_a"]:
                    found[r] = float(a)
                    continue
                below = seen["below"] + seen["at_a"]
                if r >= below + seen["n"]:
                    if a != b and r < below + seen["n"] + seen["at_b"]:
                        found[r] = float(b)
                    else:
                        state[r] = (low, high, None, None, margin * 8)
                    continue
                low, high = a, b
            if seen["lo"] == seen["hi"]:
                found[r] = float(seen["lo"])
            elif seen["n"] <= SMALL:
                small[r] = (low, high, r - below)
            else:
                at = (r - below) / seen["n"] * STEPS
                width = margin * STEPS / ACCURACY + 1
                first, last = int(at - width), int(at + width) + 1
                grid = seen["grid"]
                state[r] = (low, high, float(grid[first]) if first > 0 else float(seen["lo"]), float(grid[last]) if last < STEPS else float(seen["hi"]), margin)
        if small:
            # ranks whose brackets are the same share their values
            brackets = {bracket[:2] for bracket in small.values()}
            hit = F.lit(False)
            for low, high in brackets:
                hit = hit | _inside(value, low, high)
            values = sorted(float(x[0]) for x in df.filter(hit).select(value).collect())
            for r, (low, high, place) in small.items():
                found[r] = [v for v in values if (low is None or v > low) and (high is None or v < high)][place]
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, name: str, percents: Sequence[float], n: int) -> list[float]:
    """Linear interpolation between the two nearest ranks."""
    positions = [p / 100 * (n - 1) for p in percents]
    ranks = [r for pos in positions for r in (int(pos), min(int(pos) + 1, n - 1))]
    values = order_statistics(df, name, ranks)
    out = []
    for i, pos in enumerate(positions):
        low, high = values[2 * i], values[2 * i + 1]
        out.append(low + (high - low) * (pos - int(pos)))
    return out
