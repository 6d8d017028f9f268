"""Infill, nearest neighbours and spelling variants against plain Python, with every odd row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from depweave.llm import infill, neighbours, spelling

# Extra columns that share names with columns the operators make.
SCHEMA = "doc_id long, text string, n long, form string, word string, side int, node long, output string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "w", 2, 3, "o") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Infill.


def infill_row(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(key[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["", None, "a", "<", "one <P> two", "<S>", "x<M>", "  \n", "日本語 text é́ 𝒳y", "\u0000\u0001", "ab" * 60_000, "é" * 30_000]
    some += ["".join(rng.choice("ab Cé<P>日\n𝒳") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(some)]
    return [*rows, rows[20], rows[20], (None, "no id here"), (None, None)]


def test_infill_equals_plain_python(spark, texts):
    got = Counter(map(tuple, infill.digest(frame(spark, texts)).collect()))
    assert got == Counter(infill_row(*r) for r in texts)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_outputs_come_back(spark, texts):
    out = infill.transformed(frame(spark, texts))
    assert Counter((r["doc_id"], sha(r["output"])) for r in out.collect()) == Counter((r[0], infill_row(*r)[5]) for r in texts)
    back = Counter(map(tuple, infill.restored(out).collect()))
    assert back == Counter((i, t or "") for i, t in texts)
    odd = spark.createDataFrame([(1, None, None)], "doc_id long, form string, output string")
    assert [tuple(r) for r in infill.restored(odd).collect()] == [(1, "")]
    none = spark.createDataFrame([], SCHEMA)
    assert infill.digest(none).collect() == infill.transformed(none).collect() == []


def test_piece_tables_cut_and_permute():
    table = infill.PieceTable.of(b"abcdef").cut(2, 2, 5)
    assert [bytes(v) for v in table.stream()] == [b"ab", b"", b"cde", b"f"]
    assert table.buffers[0] is table.permuted((3, 2, 1, 0)).buffers[0]
    assert table.permuted((3, 2, 1, 0)).bytes() == b"fcdeab"
    assert table.permuted((3, 2, 1, 0)).permuted((3, 2, 1, 0)).sha256() == hashlib.sha256(b"abcdef").hexdigest()
    assert [bytes(v) for v in table.cut(0, 6).stream()] == [b"", b"ab", b"", b"cde", b"f", b""]


# Nearest neighbours.


def exact(rows, k, every):
    """rows: distinct (id, vector) that take part; the k nearest of each query row."""
    wide = max((len(v) for _, v in rows), default=0)
    x = np.array([list(v) + [0.0] * (wide - len(v)) for _, v in rows]).reshape(-1, wide)
    out = {}
    for (i, _), q in zip(rows, x):
        if i % every == 0:
            scores = np.cumsum(x * q, axis=1)[:, -1]
            near = sorted((-s, j) for s, (j, _) in zip(scores, rows) if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


VECTORS = "vec_id long, embedding array<float>, label int, vid long, block long, score double, low int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4.0, 5) for i, v in rows], VECTORS)


def singles(v):
    return [float(np.float32(x)) for x in v]


def test_neighbours_recall_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 24))
    x = np.concatenate([rng.standard_normal((900, 24)) * rng.uniform(0.2, 3, (900, 1)), centres[rng.integers(0, 8, 400)] + 0.05 * rng.standard_normal((400, 24))])
    rows = [(i, singles(v)) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[7][1]) for i in range(600)]  # nearly a third are one vector
    want = exact(rows, 20, 20)
    got = found(neighbours.nearest(vectors(spark, rows), block_rows=100, chunk_rows=20))
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    assert all(dict(want_all).get(j, s) == s for i, v in got.items() for want_all in [want[i]] for j, s in v)
    right = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert right >= 0.9 * 20 * len(want)
    # Answers among equal vectors are exact: the smallest ids but the query's own.
    assert [j for j, _ in got[2000]] == [j for j, _ in want[2000]]


def test_neighbours_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5, 0.5]), (4, [2.0]), (4, [2.0]), (40, [-1.0, 0.0]), (20, [1.0, 1.0])]
    odd = [(None, [1.0, 2.0]), (60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf]), (140, []), (160, [None, 1.0])]
    got = defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows + odd)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 40]
    assert sorted(got[0]) == [(1, 4, 2.0), (2, 1, 1.0), (3, 20, 1.0), (4, 3, 0.5), (5, 20, 0.0), (6, 40, -1.0)]
    assert sorted(got[40]) == [(1, 20, 0.0), (2, 3, -0.5), (3, 0, -1.0), (4, 1, -1.0), (5, 20, -1.0), (6, 4, -2.0)]
    assert len(got[20]) == 10 and all(v != 20 for _, v, _ in got[20])  # two vectors of one id, both queries
    alone = neighbours.nearest(vectors(spark, [(20, [1.0])])).collect()
    assert alone == neighbours.nearest(vectors(spark, [])).collect() == neighbours.nearest(vectors(spark, odd)).collect() == []


def test_chi_square_points():
    assert abs(neighbours.chi_square_point(0.95, 8) - 15.507) < 1e-3
    assert abs(neighbours.chi_square_point(0.9, 2) - 4.605) < 1e-3


def test_split_tree_deals_out_every_point():
    points = np.random.default_rng(1).standard_normal((500, 3)).round(1)
    nodes = neighbours.split_tree(points, 16)
    leaves = neighbours.leaf_of(points, nodes)
    assert set(leaves.tolist()) == set(range(16)) and max(Counter(leaves.tolist()).values()) < 80
    assert neighbours.leaf_of(points, []).tolist() == [0] * 500
    assert neighbours.split_tree(np.ones((5, 2)), 4) == []


# Spelling variants.


def spelling_rows(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    return variant_rows(n)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variant_rows(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items())


def test_spelling_equals_plain_python(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcàÿ") for _ in range(rng.randint(6, 12))) for _ in range(40)]

    def bent(w):
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            k = rng.randrange(len(w) + 1)
            w = rng.choice((w[:k] + rng.choice("abÀÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abZ") + w[k + 1 :]))
        return w

    docs = [(i, rng.choice(" -\n÷9日").join(bent(rng.choice(base)) for _ in range(60))) for i in range(60)]
    long = "xyz" * 3000
    docs += [(100, f"{long} {long} {long}q {long}q"), (101, f"{long[:4000]}ü{long[4001:]} " * 3), docs[0], docs[0]]
    docs += [(None, "Straßenbahn straßenbahn STRAßENBAHN étéétéé ÉTÉÉTÉÉ étéétéé"), (7, None), (8, ""), (9, "short runs only")]
    got = Counter(map(tuple, spelling.digest(frame(spark, docs)).collect()))
    assert got == spelling_rows(docs)


def test_spelling_roots_follow_forms(spark):
    n = {"colouring": 400, "coloring": 40, "colorings": 3, "xolorings": 2, "aaaaaaa": 3, "aaaaaaaa": 2, "bolouring": 400}
    n |= {"tiepart": 100, "tieparx": 100, "tiepar": 2}
    got = Counter(map(tuple, spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()))
    assert got == variant_rows(n)
    assert {r[0]: r[2] for r in got}["colorings"] == "colouring" and {r[0]: r[1] for r in got}["tiepar"] == "tiepart"


def test_spelling_pairs_of_dense_words(spark):
    """Runs of equal letters, all lengths, both ends: each pair once."""
    words = sorted({"".join(w) for k in (7, 8) for w in __import__("itertools").product("ab", repeat=k)} | {"a" * k for k in range(7, 40)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = Counter(frozenset(r) for r in spelling.one_edit_pairs(df).collect())
    assert got == Counter(frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if one_edit(a, b))


def test_spelling_of_nothing(spark):
    assert spelling.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spelling.digest(frame(spark, [(1, "lonely1 lonelyx lonelyx")])).collect()
    assert [tuple(r) for r in rows] == [("lonelyx", None, "lonelyx", 2, 0, None)]
