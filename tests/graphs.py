"""Graphs of the tests, stacked as revisions of one graph so that one run serves all, and their scores in plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque

from depweave.model import DepGraph, stack_revisions

FILE = "id string, path string, lang string, loc int, size long, n_exports int, n_functions int, n_classes int"
EDGE = "src string, dst string"


def graph(spark, nodes, edges, loc=35, trusted=False) -> DepGraph:
    """``nodes`` are paths or ``(path, loc, exports, functions, classes)``; ``edges`` are ``(importer, imported)``."""
    rows = []
    for node in nodes:
        path, lines, exports, functions, classes = (node, loc, 0, 0, 0) if isinstance(node, str) else node
        rows.append((path, path, "python" if path.endswith(".py") else "typescript", lines, 40 * lines, exports, functions, classes))
    return DepGraph.of(
        spark.createDataFrame(rows, FILE), spark.createDataFrame([tuple(e) for e in edges], EDGE), trusted=trusted
    )


def _harbour():
    """A hub that six boats need, and apart from it a ring of four with a tail into it."""
    boats = [f"fleet/boat{i}.py" for i in range(6)]
    ring = [f"ring/gate{i}.ts" for i in range(4)]
    edges = [(b, "quay.py") for b in boats] + [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    return [("quay.py", 90, 5, 3, 1), *boats, *ring, "tail/rope.ts"], [*edges, ("tail/rope.ts", ring[2]), (ring[0], ring[2])]


def _ladder():
    """A chain of thirteen, longer than the rules allow, with two short cuts."""
    steps = [f"step{i:02}.ts" for i in range(13)]
    return steps, [*zip(steps, steps[1:]), (steps[2], steps[5]), (steps[7], steps[9])]


def _quarry():
    """Files on both sides of the limits of the God-module check, and pairs that import each other."""
    nodes = [("rock/big.ts", 301, 2, 21, 0), ("rock/edge.ts", 300, 15, 20, 6), ("rock/wide.py", 20, 16, 2, 7), ("rock/long.py", 900, 1, 1, 1)]
    pairs = [(f"pair/{s}{i}.ts", f"pair/{t}{i}.ts") for i in range(3) for s, t in (("l", "r"), ("r", "l"))]
    return [*nodes, *sorted({a for a, _ in pairs})], pairs


def _mill():
    """Tests by import and by name, entry points of several kinds, and files that nothing reaches."""
    nodes = ["wheel/stone.ts", ("wheel/stone.test.ts", 12, 0, 1, 0), "wheel/grain.ts", "checks/tests/all.ts", "pages/home.ts",
             "routes/sell.ts", "main.ts", ("attic/old.ts", 50, 3, 1, 0), ("attic/box.ts", 8, 0, 0, 0), "index.ts"]
    edges = [("wheel/grain.ts", "wheel/stone.ts"), ("checks/tests/all.ts", "wheel/grain.ts"), ("pages/home.ts", "wheel/grain.ts"),
             ("routes/sell.ts", "wheel/stone.ts"), ("main.ts", "routes/sell.ts"), ("attic/old.ts", "wheel/stone.ts")]
    return nodes, edges


SPECS = {"harbour": _harbour(), "ladder": _ladder(), "quarry": _quarry(), "mill": _mill()}


def stacked(spark) -> DepGraph:
    return stack_revisions({rev: graph(spark, *spec) for rev, spec in SPECS.items()})


class Plain:
    """What the operators say about one graph, worked out from the definitions."""

    def __init__(self, nodes, edges):
        self.facts = {n if isinstance(n, str) else n[0]: (35, 0, 0, 0) if isinstance(n, str) else n[1:] for n in nodes}
        self.paths, self.edges = list(self.facts), set(edges)
        self.out, self.into = Counter(a for a, _ in self.edges), Counter(b for _, b in self.edges)
        self.ahead = {p: self._search(p, 0) for p in self.paths}
        self.behind = {p: self._search(p, 1) for p in self.paths}
        self.rank = self._rank()
        self.score = self._scores()
        comps = {frozenset({p} | {q for q in self.ahead[p] if p in self.ahead[q]}) for p in self.paths}
        self.cycles = sorted(sorted(c) for c in comps if len(c) > 1)
        self.on_cycle = {p for c in self.cycles for p in c}

    def _search(self, start, end):
        near = defaultdict(list)
        for e in self.edges:
            near[e[end]].append(e[1 - end])
        seen, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for to in near[at]:
                if to not in seen:
                    seen[to] = seen[at] + 1
                    queue.append(to)
        del seen[start]
        return seen

    def _rank(self):
        n = len(self.paths)
        rank = dict.fromkeys(self.paths, 1 / n)
        for _ in range(40):
            lost = sum(rank[p] for p in self.paths if not self.out[p])
            fresh = {p: 0.15 / n + 0.85 * lost / n for p in self.paths}
            for a, b in self.edges:
                fresh[b] += 0.85 * rank[a] / self.out[a]
            rank = fresh
        return rank

    def _scores(self):
        def share(values, least=1):
            top = max(least, max(values.values()))
            return {p: v / top for p, v in values.items()}

        parts = [
            (share({p: self.into[p] for p in self.paths}), 0.30), (share(self.rank, 1e-9), 0.25),
            (share({p: self.out[p] for p in self.paths}), 0.15), (share({p: f[0] for p, f in self.facts.items()}), 0.15),
            (share({p: f[1] for p, f in self.facts.items()}), 0.15),
        ]
        return {p: math.floor(round(100 * sum(part[p] * w for part, w in parts), 9) + 0.5) for p in self.paths}

    def blast(self, target, tests, entries):
        """Affected files, greatest distance and score of a change; ``tests`` and ``entries`` are counted by the caller."""
        hops = self.behind[target]
        if not hops:
            return 0, 0, 0.0
        raw = 0.35 * math.sqrt(len(hops) / len(self.paths)) + 0.15 * min(1, max(hops.values()) / 6) + 0.2 * min(1, entries / 5)
        raw += 0.1 * min(1, tests / 8) + 0.1 * self.rank[target] / max(self.rank.values()) + 0.1 * (target in self.on_cycle)
        return len(hops), max(hops.values()), 100 * raw
