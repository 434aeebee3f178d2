"""Random search trees in the plane: growth is serial, so one seed is one row's work."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame


def free(ax: float, ay: float, bx: float, by: float, circles: list[tuple[float, float, float]]) -> bool:
    """Ten samples of the segment, ends included, all outside all circles."""
    for i in range(10):
        t = i / 9
        x, y = ax + (bx - ax) * t, ay + (by - ay) * t
        if any(math.hypot(x - cx, y - cy) <= r for cx, cy, r in circles):
            return False
    return True


def grow(seed: int, start: tuple[float, float], goal: tuple[float, float], side: float, circles: list[tuple[float, float, float]], step: float = 0.5, most: int = 2000) -> list[tuple]:
    """Nodes (id, parent, x, y, on_path) of one tree; nearest node first, steps of fixed length that may overshoot."""
    rnd = random.Random(seed)
    nodes = [(start[0], start[1], -1)]
    end = -1
    for _ in range(most):
        tx, ty = goal if rnd.random() < 0.1 else (rnd.uniform(0, side), rnd.uniform(0, side))
        n = nearest_node(nodes, tx, ty)
        x, y, _p = nodes[n]
        d = math.hypot(tx - x, ty - y)
        if d < 1e-12:
            continue
        nx, ny = x + (tx - x) / d * step, y + (ty - y) / d * step
        if not free(x, y, nx, ny, circles):
            continue
        nodes.append((nx, ny, n))
        if math.hypot(nx - goal[0], ny - goal[1]) <= step:
            end = len(nodes) - 1
            break
    path = set()
    while end >= 0:
        path.add(end)
        end = nodes[end][2]
    return [(i, p, x, y, i in path) for i, (x, y, p) in enumerate(nodes)]


def nearest_node(nodes: list[tuple], x: float, y: float) -> int:
    """The node nearest to a place, the first on ties."""
    return min(range(len(nodes)), key=lambda i: (nodes[i][0] - x) ** 2 + (nodes[i][1] - y) ** 2)


def grow_two(seed: int, start: tuple[float, float], goal: tuple[float, float], side: float, circles: list[tuple[float, float, float]], step: float = 0.5, most: int = 2000) -> list[tuple]:
    """Nodes (id, parent, x, y, on_path) of two trees that grow towards each other from start and goal.

    In each round one tree takes a step to a random place and the other steps towards the new node
    until it reaches it or is blocked; then they change roles. The goal's tree is numbered behind the
    start's; on a path the parents of its nodes lead to the goal.
    """
    rnd = random.Random(seed)
    trees = [[(start[0], start[1], -1)], [(goal[0], goal[1], -1)]]
    meet = None

    def toward(nodes: list[tuple], n: int, tx: float, ty: float) -> int | None:
        x, y, _ = nodes[n]
        d = math.hypot(tx - x, ty - y)
        if d < 1e-12:
            return None
        nx, ny = (tx, ty) if d <= step else (x + (tx - x) / d * step, y + (ty - y) / d * step)
        if not free(x, y, nx, ny, circles):
            return None
        nodes.append((nx, ny, n))
        return len(nodes) - 1

    for turn in range(most):
        one, two = trees[turn % 2], trees[1 - turn % 2]
        tx, ty = rnd.uniform(0, side), rnd.uniform(0, side)
        new = toward(one, nearest_node(one, tx, ty), tx, ty)
        if new is None:
            continue
        gx, gy, _ = one[new]
        at: int | None = nearest_node(two, gx, gy)
        while at is not None and math.hypot(two[at][0] - gx, two[at][1] - gy) > 1e-9:
            at = toward(two, at, gx, gy)
        if at is not None:
            meet = (new, at) if turn % 2 == 0 else (at, new)
            break
    shift = len(trees[0])
    path = set()
    for tree, end in zip((0, 1), meet or (-1, -1)):
        while end >= 0:
            path.add(end + tree * shift)
            end = trees[tree][end][2]
    out = [(i, p, x, y, i in path) for i, (x, y, p) in enumerate(trees[0])]
    return out + [(i + shift, p + shift if p >= 0 else -1, x, y, i + shift in path) for i, (x, y, p) in enumerate(trees[1])]


def grow_trees(seeds: DataFrame, start: tuple[float, float], goal: tuple[float, float], side: float, circles: list[tuple[float, float, float]], both_ways: bool = False) -> DataFrame:
    """(seed, node, parent, x, y, on_path) of a tree, or of two that meet, per row of ``seeds``; a null seed grows nothing."""
    grown = grow_two if both_ways else grow

    def run(batches):
        for b in batches:
            for s in b["seed"].dropna().astype("int64").tolist():
                t = pd.DataFrame(grown(s, start, goal, side, circles), columns=["node", "parent", "x", "y", "on_path"])
                t.insert(0, "seed", s)
                yield t

    return seeds.mapInPandas(run, "seed bigint, node bigint, parent bigint, x double, y double, on_path boolean")
