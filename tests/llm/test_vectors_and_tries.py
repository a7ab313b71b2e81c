"""op11 to op13 against brute force, on odd rows, and against their SQL."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from commitscope.llm import bitcodes, codebooks, prefixtrie, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label string, n_convs long, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], VECTORS).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clouds(n, width, seed, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    return [(i, (centres[rng.integers(groups)] + rng.normal(size=width)).tolist(), str(i % 3)) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], "a"), (900, None, "a"), (901, [1.0, None], None), (902, [float("nan"), 1.0], None), (903, [float("inf")], "b"), (904, [], "b"), (905, [0.0, 0.0], None), (906, [1e300, -1e300], "c"),
    (1000, [0.5, 0.5], "a"), (1000, [0.5, 0.5], "a"), (1000, [0.25, 0.5, 1.0], None), (907, [0.5, 0.5], "a"),
]


def wide(rows, width):
    return np.array([list(v) + [0.0] * (width - len(v)) for v in rows])


def brute_nearest(rows, every, k=10):
    own = [(i, v) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    if not own:
        return {}
    width = max(len(v) for _, v in own)
    x, ids = wide([v for _, v in own], width), np.array([i for i, _ in own])
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        d = bitcodes.distance(x, x[at])
        hit = [(d[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[at]]
        out.setdefault(ids[at], set()).add((tuple(x[at]), tuple(sorted(hit)[:k])))
    return {q: sorted(h for _, found in each for h in found)[:k] for q, each in out.items()}


@pytest.mark.parametrize("rows", [clouds(3000, 24, 1), clouds(400, 70, 2, 1), ODD + clouds(50, 3, 3), clouds(7, 5, 4), [(i, [1.0, 2.0, 3.0], None) for i in range(300)]])
def test_ann_finds_nearly_all_and_scores_exactly(spark, rows, monkeypatch):
    monkeypatch.setattr(bitcodes, "SHARD_BYTES", 200 * 8 * 24)  # several shards a cell
    got = bitcodes.nearest(vectors(spark, rows), "vec_id % 50 = 0", 10, cells=5 if len(rows) > 100 else None).collect()
    want = brute_nearest(rows, 50)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert found.keys() == want.keys()
    hit = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert all(len(found[q]) == len(want[q]) and found[q] == sorted(found[q]) for q in want)
    assert hit >= 0.99 * sum(map(len, want.values()))


def test_ann_of_nothing(spark):
    none = vectors(spark, [(1, None, None), (100, [0.0], None)])
    assert bitcodes.nearest(none, "vec_id % 100 = 0").count() == 0
    assert bitcodes.nearest(vectors(spark, clouds(20, 4, 1)), "vec_id < 0").count() == 0


def test_codes_bound_the_inner_product():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(500, 96)), rng.normal(size=96)
    turn = bitcodes.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    codes, scalar, size = bitcodes.encode(x, turn)
    signs = (np.unpackbits(codes, axis=1, count=96) * 2.0 - 1) / 96**0.5
    about = size * (signs @ (q @ turn)) / scalar
    slack = bitcodes.SIGMAS * size * np.linalg.norm(q) * np.sqrt((1 - scalar**2) / (scalar**2 * 95))
    assert np.mean(np.abs(about - x @ q) <= slack) > 0.99 and abs(np.mean(about - x @ q)) < 1


def brute_codebooks(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0, i, v, lab) for i, v, lab in rows if usable(v)), key=lambda r: r[:2])
    longest = max(len(r[3]) for r in kept)
    width = -(-longest // parts) * parts
    most = codebooks.limit(width)
    whole = [[max(-most, min(most, math.floor(x * 4096))) if abs(x) < 1e200 else int(math.copysign(most, x)) for x in r[3]] + [0] * (width - len(r[3])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (*kept[i][:2], whole[i]))
    cut = lambda v: [v[p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    x = [cut(v) for v in whole]
    books = [[list(x[i][p]) for i in order[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        sums = {}
        for v in x:
            for p in range(parts):
                sums.setdefault((p, near(p, v[p])[1]), []).append(v[p])
        for (p, j), own in sums.items():
            books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    out, per = [], {}
    for r, v in zip(kept, x):
        found = [near(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        per[r[4]] = per.get(r[4], 0) + error
        out.append((r[2], "".join(f"{j:02x}" for _, j in found), error, r[4]))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, min(per[lab], codebooks.MOST), sha) for i, code, error, lab in out], books


@pytest.mark.parametrize("rows", [clouds(300, 16, 5), clouds(200, 21, 6, 1), ODD[:7] + ODD[8:] + clouds(20, 5, 7), ODD, [(i, [0.1, 0.2], None) for i in range(40)], clouds(5, 9, 8), [(1, [], None)]])
def test_codebooks_equal_brute_force(spark, rows):
    got = codebooks.compress(vectors(spark, rows)).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want, books = brute_codebooks(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    back = codebooks.decode(spark.createDataFrame([(want[0][1],)], "code string"), codebooks.Codebooks(np.array(books, np.int64))).first()["v"]
    assert back == [c for p, b in enumerate(books) for c in b[int(want[0][1][2 * p : 2 * p + 2], 16)]]


def test_codebooks_of_nothing(spark):
    none = codebooks.compress(vectors(spark, [(1, None, None)]))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_equal_bounds_are_visited():
    # the first two entries are equally near; the tree's other side holds the lower index
    tree = codebooks.EntryTree(np.array([[4, 0], [-4, 0], [-4, 1], [4, 1], [0, 9]], np.int64), leaf=1)
    index, d = tree.nearest(np.array([[0, 0], [0, 1], [4, 2], [-9, 9]], np.int64))
    assert index.tolist() == [0, 2, 3, 4] and d.tolist() == [16, 16, 1, 81]


def brute_trie(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    member, ends = {}, {}
    # nodes are named by running hashes, so long conversations stay cheap
    parent, last, depth = {}, {}, {}
    for c in conv:
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        seq = [t[2:] for t in sorted(conv.get(base, []))[:h]] + [t[2:] for t in sorted(conv[c])[h:]]
        node = b""
        member.setdefault(node, []).append(c)
        depth[node] = 0
        for d, t in enumerate(seq):
            up, node = node, hashlib.sha256(node + repr(t).encode()).digest()
            parent[node], last[node], depth[node] = up, t[1], d + 1
            member.setdefault(node, []).append(c)
        ends.setdefault(node, []).append(c)
    kids, sums = {}, {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)
    for n in sorted(member, key=depth.get, reverse=True):
        leaves, saved = int(n not in kids), (len(member[n]) - 1) * len(last.get(n, "").encode())
        sums[n] = (leaves + sum(sums[k][0] for k in kids.get(n, [])), saved + sum(sums[k][1] for k in kids.get(n, [])))
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted((min(member[n]), depth[n], min(member[parent[n]]) if n else None, len(member[n]), len(kids.get(n, [])), *sums[n], sha(n)) for n in member)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, k1 string").repartition(3)


def shared_prefixes():
    rng = random.Random(2)
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, None, "user", "é"), (-7, 1, "user", "minus"), (-5, 1, "user", "five"), (3, 1, "a", "same"), (3, 1, "a", "same"), (3, 1, "a", "other"), (8, 10**12, "u", "far")]
    rows += [(5, t, "user", rng.choice("ab")) for t in range(2600)]  # one conversation of most rows
    rows += [(c, t, "user", "copied") for c in range(100, 160) for t in range(12)]  # copies
    rows += [(c, t, rng.choice(["user", "bot"]), rng.choice("ab")) for c in range(200, 260) for t in range(rng.randint(0, 14))]
    rows += [(300 + 5 * i, t, "user", "step") for i in range(40) for t in range(9 + i)]  # each a turn longer than the one before
    return rows


def test_trie_equals_brute_force(spark):
    rows = shared_prefixes()
    got = prefixtrie.build(conversations(spark, rows)).collect()
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 4)
    monkeypatch.setattr(prefixtrie, "IDS", 3)
    rows = [r for r in shared_prefixes() if r[0] != 5 or r[1] < 30]
    got = prefixtrie.build(conversations(spark, rows)).collect()
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_nothing_and_of_no_turns(spark):
    assert prefixtrie.build(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    alone = prefixtrie.build(conversations(spark, [(7, 1, None, None)])).collect()  # 7's base is absent and crc32 leaves it no turn of its own
    assert sorted(map(tuple, alone)) == brute_trie([(7, 1, None, None)])


@pytest.mark.parametrize("name", ["op11_ann", "op12_codebooks", "op13_prefixtrie", "pii_counts", "mixing_targets", "urlfilter_rules", "merkle_edits"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
