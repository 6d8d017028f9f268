"""Packed reach of all files against plain Python: one large component, a hub, a long chain, loose files."""

import random
from collections import Counter

import pytest
from test_kernels import all_distances, cyclic, random_edges

from depweave.operators import bitreach
from depweave.operators.components import strongly_connected

NODES = 330


def edges_of(seed):
    rng = random.Random(seed)
    large = [(i, (i + 1) % 150) for i in range(150)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(80)]
    chain = [(i, i + 1) for i in range(150, 215)] + [(200, 3)]  # a chain that ends outside and one that runs into the component
    hub = [(i, 299) for i in range(220, 299)] + [(299, 300), (300, 299)]
    loose = [(a + 301, b + 301) for a, b in random_edges(seed, 20, 18)]
    return {(a, b) for a, b in large + chain + hub + loose if a != b}


@pytest.fixture(scope="module", params=[1, 2])
def found(request, spark):
    edges = edges_of(request.param)
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    files = spark.createDataFrame([(i,) for i in range(NODES)], "id long")
    numbers = bitreach.numbered(files, strongly_connected(df))
    return all_distances(edges), cyclic(edges), bitreach.bit_reach(df, numbers)


def test_components_share_words(found):
    _, comp, bits = found
    words = {}
    numbered = bits.numbers.collect()
    assert len({(r["word"], r["bit"]) for r in numbered}) == NODES and max(r["word"] for r in numbered) == NODES // 64
    for r in numbered:
        words.setdefault(comp.get(r["id"], r["id"]), set()).add(r["word"])
    assert all(len(w) <= -(-Counter(comp.values()).get(c, 1) // 64) + 1 for c, w in words.items())


def test_counts_and_depths(found):
    pairs, _, bits = found
    ahead, behind, direct, depth, farthest = Counter(), Counter(), Counter(), Counter(), Counter()
    for (s, t), d in pairs.items():
        ahead[s] += 1
        behind[t] += 1
        direct[t] += d == 1
        depth[s], farthest[t] = max(depth[s], d), max(farthest[t], d)
    assert {r["id"]: (r["transitive_imports"], r["depth"]) for r in bits.ahead().collect()} == {
        s: (n, depth[s]) for s, n in ahead.items()
    }
    assert {tuple(r) for r in bits.behind().collect()} == {(t, n, direct[t], farthest[t]) for t, n in behind.items()}
    assert max(depth.values()) > 60  # as long as the chain


def test_pairs_of_every_source(found):
    pairs, _, bits = found
    rows = [tuple(r) for r in bits.pairs().select("src", "dst", "hop").collect()]
    assert len(rows) == len(pairs) and {(s, t): d for s, t, d in rows} == pairs


def test_rows_are_words_and_not_pairs(found):
    pairs, _, bits = found
    rows = bits.levels.count()
    assert 4 * rows < 3 * len(pairs)  # loose files and the chain fill their words thinly
    assert bits.levels.groupBy("id", "word").agg({"bits": "count"}).count() <= NODES * (NODES // 64 + 1)


def test_flags_and_groups(found, spark):
    pairs, _, bits = found
    flags = spark.createDataFrame([(i, i % 3 == 0, None if i % 5 else True) for i in range(NODES)], "id long, third boolean, fifth boolean")
    got = {r["id"]: (r["third"], r["fifth"]) for r in bits.behind(flags, "third", "fifth").collect()}
    want = {}
    for s, t in pairs:
        a, b = want.get(t, (0, 0))
        want[t] = (a + (s % 3 == 0), b + (s % 5 == 0))
    assert got == want
    files = spark.createDataFrame([(i, i % 7) for i in range(NODES)], "id long, group int")
    members = files.where("id % 2 = 0")
    got = {r["id"]: r["same"] for r in bits.behind_of_group(files, members, "same").collect() if r["same"]}
    assert got == dict(Counter(t for s, t in pairs if s % 2 == 0 and s % 7 == t % 7))


def test_no_edges(spark):
    files = spark.createDataFrame([(1,), (2,)], "id long")
    none = spark.createDataFrame([], "src long, dst long")
    bits = bitreach.bit_reach(none, bitreach.numbered(files, spark.createDataFrame([], "id long, comp long")))
    assert bits.ahead().count() == bits.behind().count() == 0
