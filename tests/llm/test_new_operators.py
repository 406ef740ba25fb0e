"""Divergence audit, fill-in-middle and n-gram join: against brute force, round trips and on odd inputs."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from peerlens.llm import divergence, fill_in_middle, near_dup, ngram_join, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, output string, form string, value long, rank int, block int, __row string, n_shingles int, rep long, token string, total string"
LONG = "ab cd Éa " * 20000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, LONG, "en", "b"), (5, "one two three four five six", "en", None), (5, "one two three four five six", "en", None), (None, "one two three four five six", None, "a"), (7, "x", "fr", "a"), (8, "one two three four five six", "de", "b"), (9, "a<S>b", "en", "a"), (10, "\U0001f600é\n\nz", "en", "a")]
    return spark.createDataFrame([(*r, "o", "f", 1, 1, 1, "r", 1, 1, "t", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_audit(rows, min_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {t[0] for t in terms}:
        own = [(s, w) for g, s, w in terms if g == lang]
        docs = collections.Counter(x for _, w in own for x in set(w))
        kept = {x for x, k in docs.items() if k >= min_docs}
        per = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            per[s].update(x for x in w if x in kept)
        every = sum(per.values(), collections.Counter())
        p = lambda c, x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for s, c in per.items():
            pairs = [(-sum(abs(p(c, x) - p(d, x)) for x in kept), t.encode()) for t, d in per.items() if t != s]
            high = [(p(every, x) - p(c, x), x.encode()) for x in kept if c[x] and p(c, x) > p(every, x)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(high)[:top])):
                out |= {(lang, s, part, x.decode(), -v, r) for r, (v, x) in enumerate(found, 1)}
    return out


def audit_rows(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_divergence_brute_force(spark):
    rng = random.Random(3)
    words = [*(f"{a}{b}" for a in "abcdeé" for b in "xyz"), "Zoë", "naïve", "don't", "X1y"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "z" * 3]), " ".join(rng.choices(words[rng.randrange(9) :], k=rng.randrange(12)))) for _ in range(400)]
    rows += [("xx", "a", "only once"), ("xx", "b", None), ("yy", "a", "alone")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute_audit(rows, 10, 4)
    assert audit_rows(divergence.audit(df, min_docs=10, top=4)) == want
    # Blocks, chunks and early flushes change nothing.
    assert audit_rows(divergence.audit(df, min_docs=10, top=4, block=2, chunk=3)) == want


def test_divergence_flush_and_pieces(spark, monkeypatch):
    assert [x for part in divergence.terms_of("Ab-ÉC d\n".encode() * 3) for x in part] == ["ab".encode(), "Éc".encode(), b"d"] * 3
    text = b"alpha beta " * 50
    monkeypatch.setattr(divergence, "PIECE_BYTES", 16)
    parts = list(divergence.terms_of(text))
    assert len(parts) > 10 and [x for part in parts for x in part] == text.split()


def test_divergence_exact_shares():
    import numpy as np

    counts = np.array([0, 7, 123456789, 10**12, 4 * 10**16], dtype=np.int64)
    for total in (10**17, 9 * 10**16 + 7, 4 * 10**16 + 5):
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_divergence_odd(odd, nothing):
    got = audit_rows(divergence.audit(odd, min_docs=1))
    assert got == brute_audit([(r["lang"], r["source"], r["text"]) for r in odd.collect()], 1, 50)
    assert divergence.audit(nothing).count() == 0


def test_fill_in_middle_contract(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in queries.op12_fill_in_middle(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
        form = "plain" if not t or re.search("<[PSM]>", t) or c % 100 >= 90 else "spm" if d % 100 < 20 else "psm"
        made = {"plain": t, "psm": f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}", "spm": f"<S>{t[y:]}<P>{t[:x]}<M>{t[x:y]}"}[form]
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (len(t), form, *((None, None) if form == "plain" else (x, y - x)))
        assert (r["output_sha256"], r["restored_sha256"]) == (hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("unit", "pattern"), [("char", r"(?s)."), ("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_fill_in_middle_units(spark, odd, nothing, unit, pattern):
    marks = ("[pre]", "{suf}", "(mid)")
    assert fill_in_middle.transform(nothing, unit=unit).count() == 0
    df = odd.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a  b\n\nc", "\n", "x[pre]", "eins zwei\r\ndrei", "<P>" * 5] * 12)], "doc_id long, text string"), allowMissingColumns=True)
    out = fill_in_middle.transform(df, unit=unit, marks=marks, seed="s", fim_percent=100, spm_percent=50)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("form") == 1 and "__row" in out.columns
    rows = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert len(rows) == df.count()
    for r in rows:
        t = r["text"] or ""
        pieces = re.findall(pattern, t)
        assert r["back"] == t and r["n_units"] == len(pieces)
        assert (r["form"] == "plain") == (not t or any(m in t for m in marks))
        if r["form"] != "plain":
            cuts = set(itertools.accumulate(map(len, pieces), initial=0))
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= cuts
    assert {"psm", "spm", "plain"} == {r["form"] for r in rows}


def test_fill_in_middle_marks(odd):
    for bad in (("", "b", "c"), ("a", "a", "c"), ("<a", "a>", ">"), ("aba", "x", "y" * 2), ("xy", "yz", "w")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(odd, marks=bad)
    with pytest.raises(ValueError):
        fill_in_middle.transform(odd, unit="page")


def shingle_sets(texts, k):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return sets


def brute_join(texts, k=5, percent=80):
    sets = shingle_sets(texts, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def joined(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, **how).collect()}


def test_ngram_join_documents(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op13_ngram_join(spark, DATA).collect()}
    assert got == brute_join(texts)


def test_ngram_join_families(spark, monkeypatch):
    """Families around the threshold, chains, shared passages and short texts; many blocks, flushes and matches."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = {}
    for family in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.randrange(2, 25)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 20))):
                w[rng.randrange(len(w))] = word()
            if family % 3 == 0:
                w = w + passage
            if rng.random() < 0.3:
                base = w if family % 2 else base  # chains
            texts[len(texts)] = " ".join(w)
    texts |= {len(texts) + i: t for i, t in enumerate(["", None, "one", "One", "one two", "a b c d e", "a b c d e f", "A B c d e"])}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    want = brute_join(texts)
    assert joined(df) == want and len({c for _, c in want.values()}) < len(want) - 50
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "HEADS", (0, 0))
    assert joined(df, words=3, percent=60) == brute_join(texts, 3, 60)


def test_ngram_join_odd(spark, odd, nothing):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(odd).collect())
    assert got == {(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 3, 4): 1, (5, 2, 5): 2, (None, 2, 5): 1, (7, 1, 7): 1, (8, 2, 5): 1, (9, 1, 9): 1, (10, 1, 10): 1}
    assert ngram_join.join(nothing).count() == 0 and ngram_join.join(odd.filter("doc_id in (1, 2)")).count() == 2
    strings = ngram_join.join(odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {r["component_id"] for r in strings.filter("n_shingles = 2").collect()} == {"d5"}


def test_ngram_join_repeated_ids(spark):
    """Different texts under one doc_id, and null ids, keep their own links, as in near-duplicate removal."""
    rng = random.Random(5)
    p, q, x = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    df = spark.createDataFrame([(1, p), (1, q), (1, q), (2, p + " x"), (3, q + " y"), (4, "z " + q), (None, p), (None, x), (None, x), (9, "")], "doc_id long, text string")
    want = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.link(df).collect())
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()) == want


@pytest.mark.parametrize("module", [near_dup, ngram_join])
def test_blocks_find_links_that_stars_miss(spark, module):
    """Many near copies of one text, each pair of which is near 80 %: blocks find what no comparison with a head links."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(300)], {}
    for i in range(80):
        w = list(base)
        for at in rng.sample(range(300), rng.choice((3, 4, 5))):
            w[at] = word()
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = module.link(df, words=5) if module is near_dup else module.join(df)
    want = brute_join(texts)
    assert len({c for _, c in want.values()}) not in (1, 80)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: c for i, (_, c) in want.items()}


def test_blocks_stay_small_in_long_lists(spark, monkeypatch):
    """A list's largest component isn't compared with itself, nor sent there, and no group of blocks grows with a list."""
    import numpy as np
    from pyspark.sql import GroupedData

    rng, rows = np.random.default_rng(3), []
    for i in range(1200):
        s = np.sort(np.r_[rng.choice(1 << 40, 30, replace=False) + 100, np.arange(10)]).astype(np.uint64)
        rows.append((5, i, 0 if i < 1100 else i - i % 2, 40, 8, 2, ngram_join.parity(s).tolist(), [int(x) for x in s[:10]] if i < 1199 else [5, 7]))
    members = spark.createDataFrame(rows, "token long, rep long, component long, n long, base int, matches int, bits array<long>, prefix array<long>").withColumn("size", F.lit(1200))
    seen, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: seen.append([r["count"] for r in self.count().collect()]) or apply(self, *a))
    monkeypatch.setattr(ngram_join, "CHUNK", 10)
    assert ngram_join.cross_pairs(members, 80).count() == 0  # parity bits rule all out
    assert sum(seen[0]) <= 1100 * 10 + 100 * 120 and max(seen[0]) < 2000
    alike = members.withColumn("bits", F.array(*[F.lit(0).cast("long")] * ngram_join.PARITY_WORDS)).filter("rep >= 1050")
    monkeypatch.setattr(ngram_join, "PACK", 2_000)
    got = {(r["a"], r["b"]) for r in ngram_join.cross_pairs(alike, 80).collect()}
    # Of shingles 0 to 9 all but the last row hold all: 0 is the smallest shared one, and this is the list of 5.
    assert got == {(a, 1199) for a in range(1050, 1198)} and len(seen[1]) > 64


def test_packs_stay_small_in_large_buckets(spark, monkeypatch):
    """Near-duplicate removal deals blocks into packs by the rows that are placed in them, not by the members of buckets."""
    from pyspark.sql import GroupedData

    one = {"bucket": F.lit(5).cast("long"), "component": F.col("rep"), "n_shingles": F.lit(9).cast("long"), "n": F.lit(900).cast("long")}
    bits = lambda n: F.array(*[F.col("rep") * (2**40 + i) * 977 for i in range(n)])
    members = spark.range(900).toDF("rep").withColumns(one | {"sketch": bits(16), "parity": bits(32), "bands": F.array(*[F.lit(5).cast("long")] * 24)})
    seen, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: seen.append([r["count"] for r in self.count().collect()]) or apply(self, *a))
    monkeypatch.setattr(near_dup, "CHUNK", 10)
    monkeypatch.setattr(near_dup, "PACK", 50)
    near_dup.cross_pairs(members, 10, 80)
    assert sum(seen[0]) == 900 * 90 and max(seen[0]) < 400


def test_marks_are_sent_before_rows_pile_up(spark, monkeypatch):
    """Copies of one text, which add no shingles, are sent on after a number of documents as well."""
    df = spark.createDataFrame([(i, "a b c d e f g" if i % 2 else "") for i in range(3000)], "doc_id long, text string").coalesce(1)
    want = joined(df)
    sent = ngram_join.shared_marks(df, 5, 80).select("key", "found").collect()
    monkeypatch.setattr(ngram_join, "FLUSH_DOCS", 10)
    assert joined(df) == want and len(sent) == 3000
    assert {c for _, c in want.values()} == {1, *range(0, 3000, 2)}


def test_parity_bits_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(7)
    for size in (1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[: size * 3 // 4], rng.integers(0, 1 << 63, size, dtype=np.uint64)])
        differ = int(np.bitwise_count((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint64)).sum())
        assert 0 < differ <= len(np.setxor1d(a, b))


def test_multi_match_prefixes():
    """Two sets that share at least o have m common ones in their first |set| - o + m, and the cost picks m from 1 on."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    for _ in range(300):
        both = rng.choice(60, size=rng.integers(20, 60), replace=False)
        a, b = (np.sort(np.unique(np.r_[both, rng.integers(60, 200, rng.integers(0, 6))])) for _ in range(2))
        o = len(np.intersect1d(a, b))
        for m in range(1, o + 1):
            assert len(np.intersect1d(a[: len(a) - o + m], b[: len(b) - o + m])) >= m
    asks = ngram_join.matches.func
    few = asks(pd.Series([np.array([1, 1, 2, 900, 900])]), pd.Series([20]), pd.Series([100]), pd.Series([80]))
    many = asks(pd.Series([np.array([900] * 40)]), pd.Series([0]), pd.Series([100]), pd.Series([80]))
    assert few[0] == 1 and many[0] == ngram_join.MATCHES


def test_pipeline_stages_keep_columns_and_odd_rows(spark):
    """Null and repeated ids, and columns named as what stages make, go through with their own values."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    extra = {"size": F.lit(7), "copy": F.lit(77), "target": F.lit("t"), "component_id": F.lit(5), "lang_pred": F.lit("zz"), "shingles": F.lit(1.5)}
    docs = docs.withColumns(extra).unionByName(docs.limit(3).withColumns(extra).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("another text of its own begins here and goes on for a while "), "text")))
    schema, given = docs.schema, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == schema.names
    rows = docs.collect()
    assert 0 < len(rows) <= 2 * given
    assert {(r["size"], r["copy"], r["target"], r["component_id"], r["lang_pred"], r["shingles"]) for r in rows} == {(7, 77, "t", 5, "zz", 1.5)}
