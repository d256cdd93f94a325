"""Squarified treemaps: rectangles with areas in proportion to values, laid out for each parent by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def layout(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, width, height) of positive values in descending order, filling the given one.

    Rows grow along the shorter side while the worst aspect ratio of their tiles does not get worse."""
    out: list[tuple[float, float, float, float]] = []
    left, scale = list(values), w * h / sum(values) if values else 0.0
    while left:
        side, row, area, worst = min(w, h), [], 0.0, float("inf")
        while left:
            a = left[0] * scale
            trial = max(max(side * side * t / (area + a) ** 2, (area + a) ** 2 / (side * side * t)) for t in [*row, a])
            if trial > worst:
                break
            row, area, worst = [*row, a], area + a, trial
            left.pop(0)
        depth, at = area / side if side else 0.0, 0.0
        for a in row:
            long = a / depth if depth else 0.0
            out.append((x, y + at, depth, long) if w >= h else (x + at, y, long, depth))
            at += long
        x, y, w, h = (x + depth, y, w - depth, h) if w >= h else (x, y + depth, w, h - depth)
    return out


def treemap(nodes: DataFrame, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """nodes (parent, code, total) with tiles; a parent's children are few, as a classification has at most some dozens."""

    def one(children: pd.DataFrame) -> pd.DataFrame:
        c = children[children["total"] > 0].sort_values(["total", "code"], ascending=[False, True])
        tiles = pd.DataFrame(layout(c["total"].tolist(), 0.0, 0.0, width, height), columns=["x", "y", "w", "h"])
        return pd.concat([c[["parent", "code", "total"]].reset_index(drop=True), tiles], axis=1)

    return nodes.select("parent", "code", "total").groupBy("parent").applyInPandas(one, "parent string, code string, total double, x double, y double, w double, h double")
