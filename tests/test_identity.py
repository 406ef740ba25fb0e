"""Fuzzy matching against every pair of names of a block."""

import random

import pytest

from peerlens.functions.text import token_set_ratio
from peerlens.operators import identity


def brute_best(left, right, threshold=0.9):
    out = {}
    for i, block, names in left:
        found = {}
        for j, other, theirs in right:
            if other == block:
                s = max((token_set_ratio(a, b) / 100.0 for a in names for b in theirs), default=0.0)
                if s >= threshold:
                    found[j] = s
        if found:
            top = max(found.values())
            best = min(j for j, s in found.items() if s == top)
            out[i] = (best, top, sum(s == top for s in found.values()))
    return out


def changed(rng, name):
    """A name with words dropped, added or swapped and letters changed, also first ones."""
    words = name.split()
    kind = rng.randrange(5)
    if kind == 0 and len(words) > 1:
        words.pop(rng.randrange(len(words)))
    elif kind == 1:
        words.append(rng.choice(["de", "junior", "x"]))
    elif kind == 2:
        rng.shuffle(words)
    else:
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(words))
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice(["", "o", "ca", "v"]) + words[k][at + rng.randint(0, 1) :] or "z"
    return " ".join(words)


def test_fuzzy_best_is_exact(spark):
    rng = random.Random(2)
    syllables = ["ka", "ta", "rzy", "na", "wis", "niew", "ski", "al", "ek", "san", "dro", "vich", "o", "le", "de", "mar", "tin"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["aleksandrovich", "katarzyna wisniewska"]
    left = [(i, i % 3, [n]) for i, n in enumerate(names)]
    right = [(1000 + i, i % 3, [changed(rng, n)] + ([changed(rng, n)] if i % 4 == 0 else [])) for i, n in enumerate(names[:-2])]
    right += [(1150, 150 % 3, ["oleksandrovich"]), (1151, 151 % 3, ["catarzyna visniewska"]), (1152, 0, [""])]
    schema = "id long, block int, names array<string>"
    got = {r["left_id"]: (r["right_id"], r["score"], r["n_best"]) for r in identity.fuzzy_best(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    want = brute_best(left, right)
    assert got == want and got[150][0] == 1150 and got[151][0] == 1151 and len(got) > 60


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_fuzzy_best_other_thresholds(spark, threshold):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 14))).strip() or "a" for _ in range(60)]
    left = [(i, 0, [" ".join(n.split())]) for i, n in enumerate(names)]
    right = [(100 + i, 0, [changed(rng, " ".join(n.split()))]) for i, n in enumerate(names)]
    schema = "id long, block int, names array<string>"
    got = {r["left_id"]: (r["right_id"], r["score"], r["n_best"]) for r in identity.fuzzy_best(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), threshold=threshold).collect()}
    assert got == brute_best(left, right, threshold)


def test_registered_fuzzy_queries(spark):
    from peerlens.plans.queries import QUERIES, _people

    d = "/root/testdata/sf0.01"
    left, right = ([tuple(r) for r in x.collect()] for x in _people(spark, d))
    want = brute_best(left, right)
    got = {r["left_id"]: (r["right_id"], r["score"], r["n_best"]) for r in QUERIES["fuzzy_block_match"](spark, d).collect()}
    assert got == want and want
    exact = {r["left_id"] for r in QUERIES["identity_exact"](spark, d).collect()}
    reviews = {r["left_id"]: (r["right_id"], round(r["score"] / 0.9, 9)) for r in QUERIES["identity_decision"](spark, d).collect() if r["left_id"] not in exact}
    assert reviews == {i: (j, round(s, 9)) for i, (j, s, n) in want.items() if i not in exact and n == 1} and reviews


def test_resolve_clubs(spark):
    teams = spark.createDataFrame([(1, "real betis", "spain"), (2, "arsenal", "england"), (3, "nowhere", None), (4, "inter", "italy"), (5, "borussia dortmund", "germany")], "id long, name string, country string")
    listed = spark.createDataFrame(
        [(10, "betis", "spain", False), (11, "arsenal", "england", False), (12, "arsenal w", "england", False), (13, "arsenal", "argentina", False), (14, "inter", "italy", False), (15, "inter", None, False), (16, "borusia dortmund", "germany", False), (17, "nowhere", "x", True)],
        "id long, name string, country string, national boolean",
    )
    got = {r["team_id"]: (r["listed_id"], r["score"]) for r in identity.resolve_clubs(teams, listed).collect()}
    assert got == {1: (10, 1.0), 2: (11, 1.0), 5: (16, 0.9)}


def test_clubs_of_one_country_in_other_letters(spark):
    """Countries are compared by normalised names; a club of another country is none."""
    teams = spark.createDataFrame([(1, "real norte fc", "Côte d'Ivoire"), (2, "real sul fc", "Peru"), (3, "leste", None)], "id long, name string, country string")
    listed = spark.createDataFrame([(10, "norte", "cote d ivoire", False), (11, "sul", "Chile", False), (12, "leste", "X", False)], "id long, name string, country string, national boolean")
    got = {r["team_id"]: r["listed_id"] for r in identity.resolve_clubs(teams, listed).collect()}
    assert got == {1: 10, 3: 12}


def _initials(spark):
    """Short names and people, few names for many ids; ids with several names on either side, and without an id."""
    rng = random.Random(5)
    surnames = ["del rio", "rio", "lee", "ny"]
    short = [(rng.randrange(30), f"{rng.choice('KB')}. {rng.choice(surnames).title()}") for _ in range(40)] + [(None, "K. Rio")]
    people = [(100 + rng.randrange(60), f"{rng.choice(['Kim', 'Ken', 'Bo', 'Al'])} {rng.choice(['', 'del '])}{rng.choice(surnames)}") for _ in range(80)]
    want = {(i, j) for i, a in short for j, b in people if b[0] == a[0] and f" {b.lower()}".endswith(f" {a[3:].lower()}")}
    return spark.createDataFrame(short, "id long, name string"), spark.createDataFrame(people, "id long, name string"), want


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_initials_of_common_surnames_in_parts(spark, part):
    """However a surname's people are cut, each pair comes once; pairs aren't made distinct behind the whole join."""
    short, people, want = _initials(spark)
    got = [(r[0], r[1]) for r in identity.initial_matches(short, people, part=part).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_initials_sharing_a_club(spark):
    """As all pairs checked for a common club, without making them: surnames are part of the key that clubs meet by."""
    short, people, want = _initials(spark)
    rng = random.Random(6)
    mine, theirs = ([(i, rng.choice("abcdefgh")) for i in ids for _ in range(3)] for ids in (range(30), range(100, 160)))
    clubs = spark.createDataFrame([*mine, (1, None)], "left_id long, club string"), spark.createDataFrame([*theirs, (101, None)], "right_id long, club string")
    pairs = identity.initial_matches_sharing_club(short, people, *clubs)
    assert sorted((r[0], r[1]) for r in pairs.collect()) == sorted({(i, j) for i, j in want if {c for k, c in mine if k == i} & {c for k, c in theirs if k == j}})


def brute_decide(left, right):
    """As decide: one exact match is linked, several are reviewed, else a unique fuzzy one; a right id linked twice is reviewed."""
    exact, out = {}, {}
    for i, block, names in left:
        for j, other, theirs in right:
            if block == other and set(names) & set(theirs) - {""}:
                exact.setdefault(i, {})[j] = len(set(names) & set(theirs) - {""})
    for i, found in exact.items():
        out[i] = (min(found, key=lambda j: (-found[j], j)), *(("linked", 0.95) if len(found) == 1 else ("review", 0.8)))
    for i, (j, s, n) in brute_best([x for x in left if x[0] not in exact], right).items():
        if n == 1:
            out[i] = (j, "review", round(s * 0.9, 9))
    linked = [j for j, d, _ in out.values() if d == "linked"]
    return {i: (j, "review", 0.85) if d == "linked" and linked.count(j) > 1 else (j, d, s) for i, (j, d, s) in out.items()}


def test_decide_with_names_in_common(spark):
    rng = random.Random(8)
    pool = ["ann lee", "ann leee", "bo rivers", "bo river", "katarzyna wisniewska", "catarzyna visniewska", "cy", "dee dee", "eve adams", "eve adam", ""]
    side = lambda first, n: [(first + i, rng.randrange(4), rng.sample(pool, rng.randint(1, 3))) for i in range(n)]
    left, right = side(0, 60), side(1000, 14)
    schema = "id long, block int, names array<string>"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {x["left_id"]: (x["right_id"], x["decision"], round(x["score"], 9)) for x in identity.decide(l, r).collect()}
    want = brute_decide(left, right)
    assert got == want and {(d, s) for _, d, s in want.values()} >= {("linked", 0.95), ("review", 0.8), ("review", 0.85)} and any(s not in (0.95, 0.85, 0.8) for *_, s in want.values())
    assert {x["left_id"]: (x["right_id"], x["score"], x["n_best"]) for x in identity.fuzzy_best(l, r).collect()} == brute_best(left, right)


def test_many_ids_of_one_name(spark):
    """100,000 ids of a name on either side: ten thousand million pairs of ids, but one of names."""
    many = lambda first, name: spark.range(first, first + 100_000).selectExpr("id", "0 as block", f"array('{name}') as names")
    left, right = many(0, "katarzyna wisniewska"), many(1_000_000, "katarzyna visniewska")
    assert {tuple(r) for r in identity.fuzzy_best(left, right).groupBy("right_id", "n_best").count().collect()} == {(1_000_000, 100_000, 100_000)}
    assert {tuple(r) for r in identity.decide(left, many(1_000_000, "katarzyna wisniewska")).groupBy("right_id", "decision", "score").count().collect()} == {(1_000_000, "review", 0.8, 100_000)}


def test_strict_match_counts_without_pairs(spark):
    """As all pairs, for records of few and many names, ids of several records, unknown values, and a name that 100,000 have."""
    rng = random.Random(9)
    names = [*"abcdefgh", ""]
    side = lambda first, n: [(first + rng.randrange(n), rng.sample(names, rng.choice([1, 1, 2, 2, 3, 4, 6])), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for _ in range(n)]
    schema = "id long, names array<string>, nationality string, born int"
    fits = lambda a, b: a is None or b is None or a == b
    for n in (6, 80):
        left, right = side(0, 80), side(1000, n)
        want = {}
        for i, a, *known in left:
            want.setdefault(i, set()).update(j for j, b, *other in right if set(a) & set(b) - {""} and all(map(fits, known, other)))
        got = {r["left_id"]: (r["n_matches"], r["right_id"]) for r in identity.strict_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
        assert got == {i: (len(js), min(js) if len(js) == 1 else None) for i, js in want.items()}
    many = lambda first: spark.range(first, first + 100_000).selectExpr("id", "array('ann lee', 'a lee') as names", "'x' as nationality", "cast(null as int) as born")
    assert identity.strict_match(many(0), many(1_000_000)).filter("n_matches = 100000").count() == 100_000
