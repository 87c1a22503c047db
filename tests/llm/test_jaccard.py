import random
import re
import time
from collections import defaultdict

from scriptorium.llm import common, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, n=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, share=85):
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(own):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(own):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & own[j])
            if 100 * both >= share * (len(s) + len(own[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(own[i]), str(least.get(root(i), d) if own[i] else d)) for i, (d, _) in enumerate(rows))


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, token int").repartition(parts)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(docs).collect())


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_chains_copies_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(None, None), (None, ""), (1000, None), (1001, " \n"), (1002, "one two"), (1003, "ONE  two"), (1004, "two one"), (1005, "x " * 5000), (1006, "x " * 6000), (None, "one two")]
    base = [word() for _ in range(60)]
    for i in range(40):  # copies that drift: near ones link, far ones only by a chain
        rows.append((i, " ".join(base)))
        base[rng.randrange(60)] = word()
    hot = [word() for _ in range(50)]
    for i in range(100, 160):
        copy = list(hot)
        copy[rng.randrange(50)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(hot)) for i in range(30)] + [(300 + i, " ".join(word() for _ in range(30))) for i in range(30)]
    rows += [(7, " ".join(hot)), (7, " ".join(hot))]
    assert found(spark, rows) == brute(rows)


def test_near_copies_go(spark):
    rows = [(3, "a b c d e"), (2, "a b c d e"), (5, "other words in here now"), (6, None), (None, "a b c d e"), (2, "a b c d e")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, node string")
    kept = sorted((str(r.doc_id), r.node) for r in jaccard.distinct_documents(docs).collect())
    assert kept == [("2", "s"), ("5", "s"), ("6", "s"), ("None", "s")]
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_prefixes_keep_a_common_token():
    import numpy as np

    from scriptorium.llm.links import Bloom

    rng = np.random.default_rng(1)
    shared = Bloom(rng.integers(0, 2**63, 1 << 4).view(np.uint64))
    for _ in range(500):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * rng.uniform(0.8, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            heavy = np.sort(rng.choice(a, len(a) // 2, replace=False))
            for more in ((shared, heavy), (shared,), (None,)):
                assert len(np.intersect1d(jaccard.prefix(a, 85, *more), jaccard.prefix(b, 85, *more)))


def bound(a, b, share=85):
    import numpy as np

    rows, sizes = np.array([jaccard.sketch(a, share), jaccard.sketch(b, share)], np.int64), np.array([len(a), len(b)])
    return jaccard.Sketches(rows, sizes, share).hopes(np.array([0]), np.array([1]))[0]


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    links = apart = 0
    for size in (1, 5, 60, 300, 1500, 2300, 4100, 9000, 20000, 90000):
        for share in (0.0, 0.3, 0.7, 0.86, 0.87, 0.9, 0.95, 1.0):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, size // 50).astype(np.uint64)]))
            if len(b):
                both = len(np.intersect1d(a, b))
                hope, link = bound(a, b), 100 * both >= 85 * (len(a) + len(b) - both)
                assert not link or hope >= 1_000_000 * both // (len(a) + len(b) - both)
                links, apart = links + link, apart + (hope == 0)
    other = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert bound(other, np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))) == 0  # large and unlike
    assert links > 20 and apart > 20


def test_pieces_of_a_group_lose_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.integers(0, 80, int(rng.integers(0, 8)))] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    component = rng.integers(0, 12, 40)
    hope = {(i, j) for i in range(40) for j in range(i + 1, 40) if component[i] != component[j]
            and bound(sets[i], sets[j])}
    known = spark.createDataFrame([(i, len(x), jaccard.sketch(x, 85)) for i, x in enumerate(sets)], "node long, size long, sketch array<bigint>")
    rows = spark.createDataFrame([(t, i, int(component[i])) for t in (5, 6) for i in range(40)], "token long, node long, component long")

    def joined(pairs):
        root = list(range(12))
        for i, j in pairs:
            x, y = root[component[i]], root[component[j]]
            root = [y if r == x else r for r in root]
        return [[a == b for a in root] for b in root]

    for piece in (3, 7, 4096):
        dealt = jaccard.dealt(rows, piece)
        assert {(r.a, r.b) for r in jaccard.met_in_groups(dealt, known, 85, None).collect()} == hope
        out = jaccard.met_in_groups(dealt, known, 85, 1).collect()
        some = [(r.a, r.b) for r in out if r.more is None]
        assert set(some) <= hope and joined(some) == joined(hope)
    assert len(set(some)) < 40 < len(hope) and {r.more for r in out} == {None, 5, 6}


def test_hot_group_in_pieces(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base, rows = [word() for _ in range(80)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(80)] = word()
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(docs, piece=10, a_row=1).collect())
    assert out == brute(rows)


def test_blocks_verify_like_sets(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40)
    sets = {}
    for i in range(30):
        keep = base[rng.random(40) < 0.93]
        sets[i] = [int(x) for x in rng.permutation(np.concatenate([keep, rng.integers(0, 2**63, 2)]))]
    pairs = [(i, j) for i in sets for j in sets if i < j]
    rank = sorted(set(sum(sets.values(), [])), key=lambda x: (x * 7919) % 10007)
    place = {x: k for k, x in enumerate(rank)}
    rows = [(i, sorted(t, key=place.get)) for i, t in sets.items()]
    want = sorted((i, j) for i, j in pairs if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j])))
    p, s = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "node long, tokens array<bigint>")
    for most in (10, 100, 10**6):
        assert sorted(map(tuple, jaccard.verified_in_blocks(p, s, s.selectExpr("node", "size(tokens) AS size"), 85, most).collect())) == want
    assert 0 < len(want) < len(pairs)


def test_unlike_texts_under_one_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "a"), (2, text(1) + " more", "b"), (2, text(2), "c"), (2, text(3), "d"), (2, text(3), "d"), (3, text(3), "e"), (4, "", "f"), (4, None, "g"), (4, text(4), "h"), (None, text(1), "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    out = jaccard.distinct_documents(docs, n=5, share=80)
    assert out.columns == docs.columns
    assert sorted(r.mark for r in out.collect()) == ["a", "c", "d", "f", "g", "h", "i"]


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f g", 77, 1, "x"), (2, "a b c d e f g", 88, 2, "y"), (None, "a b c d e f g", 99, 3, "z"), (4, "q r s t u v", 11, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, node long, row string")
    got = {tuple(r) for r in jaccard.distinct_documents(docs, n=5, share=80).collect()}
    assert got == {rows[0], rows[2], rows[3]}


def test_groups_of_the_same_nodes_meet_once_and_in_turns(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for family in range(6):  # copies that drift, so the first round leaves several components that share many tokens
        base = [word() for _ in range(200)]
        for i in range(12):
            rows.append((100 * family + i, " ".join(base)))
            for _ in range(3):
                base[rng.randrange(200)] = word()
    met, plain = [], jaccard.met_in_groups

    def watched(keys, *rest):
        met.append([(r.key, r.node) for r in keys.collect()])
        return plain(keys, *rest)

    monkeypatch.setattr(jaccard, "met_in_groups", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(docs, most_sent=1).collect())
    assert got == brute(rows)
    assert len(met) > 1 and len({k for turn in met for k, _ in turn}) == sum(len({k for k, _ in turn}) for turn in met)
    groups = defaultdict(set)
    for turn in met:
        for key, node in turn:
            groups[key].add(node)
    assert len({frozenset(g) for g in groups.values()}) == len(groups)


def test_a_cut_lets_its_own_shuffle_files_go(spark):
    tracked = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    common._SWEPT[0] = -10
    common.cut(spark.range(10))
    time.sleep(2)
    before = tracked()
    common._SWEPT[0] = -10
    out = common.cut(spark.range(1000).repartition(3, "id"))
    for _ in range(40):
        if tracked() <= before:
            break
        time.sleep(0.25)
    assert tracked() <= before and out.count() == 1000
