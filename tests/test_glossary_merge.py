import random

from scriptorium.operators import glossary as G

STATS = "en string, zh string, count long, sources array<string>, alternatives map<string,bigint>, pos long"
BASE = "en string, value array<string>, is_list boolean, pos long"


def plain(base, stats):
    """The merge, one term after the other."""
    out, first = [], {}
    for en, value, is_list, _ in sorted(base, key=lambda r: r[3]):
        out.append([en, value, is_list, "kept"])
        first.setdefault(en.lower(), out[-1])
    for en, zh, count, sources, alternatives, _ in sorted(stats, key=lambda r: r[5]):
        value = [zh, *(z for z, n in sorted(alternatives.items(), key=lambda x: (-x[1], x[0])) if n >= 3 and n >= 0.4 * count)]
        at = first.get(en.lower())
        if at is None:
            out.append([en, value, len(value) > 1, "added_list" if len(value) > 1 else "added_scalar"])
            first[en.lower()] = out[-1]
        elif set(at[1]) & set(value):
            out.append([en, None, False, "same"])
        elif count < 8 and not (count >= 3 and set(sources) & set(G.STRONG)):
            out.append([en, None, False, "skipped_low_quality"])
        elif len(value) == 1:
            at[1:] = [value, False, "overwritten"]
        else:
            at[1:] = [value + sorted(set(at[1]) - set(value)), True, "made_list"]
    return sorted(map(str, out))


def test_equals_a_fold_in_order(spark):
    rng = random.Random(6)
    terms = ["火球", "巨龙", "法师", "长剑", "盾牌", "城堡", "弓箭"]
    names = ["Fire", "fire", "FIRE", "Dragon", "dragon", "Sword", "sword", "SWord", "Ice"]
    base = [(en, rng.sample(terms, rng.choice([1, 1, 2])), False, i) for i, en in enumerate(rng.sample(names, 4))]
    base = [(en, v, len(v) > 1, p) for en, v, _, p in base]
    stats = []
    for i in range(60):
        zh, *others = rng.sample(terms, rng.choice([1, 3, 3]))
        count = rng.choice([1, 3, 5, 8, 20])
        stats.append((rng.choice(names) + rng.choice(["", " bolt", " wall", f" {i}"]), zh, count, rng.choice([["A_title_field"], ["D_paren"]]), {o: rng.randint(1, max(1, count)) for o in others}, i))
    stats += [("Alone", "火球", 3, ["D_paren"], {}, 99), ("TWIN", "火球", 20, ["D_paren"], {"巨龙": 10, "法师": 12}, 100)]
    base.append(("Twin", ["雪山"], False, 9))
    got = G.merge(spark.createDataFrame(base, BASE), spark.createDataFrame(stats, STATS)).collect()
    assert sorted(str([r.en, r.value, r.is_list, r.action]) for r in got) == plain(base, stats)
    assert {r.action for r in got} >= {"kept", "same", "made_list", "overwritten", "added_list", "added_scalar", "skipped_low_quality"}


def test_no_terms(spark):
    base = spark.createDataFrame([("a", ["火"], False, 0)], BASE)
    assert [tuple(r) for r in G.merge(base, spark.createDataFrame([], STATS)).collect()] == [("a", ["火"], False, "kept")]
