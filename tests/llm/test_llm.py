"""Each operator against brute force, an exact round trip or planted cases, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import duckdb
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from peerlens.llm import decontamination, language, mixing, near_dup, pii, quality, queries, sharding, suffix_dedup, tokens, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size long, kept boolean, shard int, __m string"
LONG = "ab cd " * 30000


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows and clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, LONG, "en", "b"), (5, "one two three four five six", "en", None), (5, "one two three four five six", "en", None), (None, "one two three four five six", None, "a"), (7, "x", "fr", "a"), (8, "one two three four five six", "de", "b")]
    return spark.createDataFrame([(*r, 9, None, 1, "m") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def shingle_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_dup_all_pairs(spark, documents):
    got = rows(queries.op1_minhash_odd_sketch(spark, DATA))
    want, n = shingle_components(documents, 4, 80)
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (c, n[i], c == i) for i, c in want.items()}


def test_near_dup_odd(odd, nothing):
    got = near_dup.link(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0] and by[8]["component_id"] == 5 and by[5]["kept"] and not by[8]["kept"]
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(odd).collect()) == ["1", "2", "3", "4", "5", "7"]
    assert near_dup.link(nothing).count() == 0


def test_near_dup_repeated_ids(spark):
    """Different texts under one doc_id, and null ids, keep their own links; repeated rows are one document."""
    rng = random.Random(5)
    p, q, x = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    df = spark.createDataFrame([(1, p), (1, q), (1, q), (2, p + " x"), (3, q + " y"), (4, "z " + q), (None, p), (None, x), (None, x), (9, ""), (9, ""), (9, None)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.link(df).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 1, False): 1, (None, 1, False): 1, (None, None, True): 2, (9, 9, True): 3}
    kept = collections.Counter((r["doc_id"], r["text"]) for r in near_dup.keep_one(df).collect())
    assert kept == {(1, p): 1, (1, q): 1, (None, x): 1, (9, ""): 1, (9, None): 1}


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = np.unique(np.r_[base[:1800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    a, b = (near_dup.odd_sketch(near_dup.minhash(x)) for x in (np.unique(base), other))
    assert abs(near_dup.similarity_of(int(np.bitwise_count((a ^ b).view(np.uint64)).sum())) - 1800 / 2200) < 0.1


def test_decontamination(spark, odd, nothing, documents):
    bench = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_spaced_seeds(spark, DATA).collect()}
    want = set()
    for i, t in documents.items():
        w = decontamination.words(t)
        for k, x in bench:
            v = decontamination.words(x)
            for d in range(-len(v) + 5, len(w)):
                n = sum(w[d + q] == v[q] for q in range(max(0, -d), min(len(v), len(w) - d)))
                if n >= 0.8 * len(v):
                    want.add((i, k))
                    break
    assert want <= got and len(got - want) <= len(want) // 10
    item = "the quick brown fox jumps over the lazy dog near a river bank today".split()
    changed = [*["pad"] * 5, *item, "end"]
    changed[7], changed[12] = "green", "big"
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, "the quick brown cat sat"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "too short"), (12, "")], "item_id long, text string")
    found = decontamination.find_leaks(docs, b).collect()
    assert [(r["doc_id"], r["item_id"], r["matched_words"], r["start_word"]) for r in found] == [(1, 9, 12, 5)]
    assert decontamination.find_leaks(docs, b, block_words=5).count() == 1
    assert decontamination.decontaminate(odd, b).columns == odd.columns
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, b, block_words=5).collect()} == {r["doc_id"] for r in decontamination.decontaminate(docs, b).collect()}
    assert decontamination.decontaminate(odd, b).count() == odd.count() and decontamination.find_leaks(nothing, b).count() == 0
    assert decontamination.decontaminate(odd, b.limit(0)).count() == odd.count()


def found_in(texts, item, **options):
    index = decontamination.Index([(1, item)], **options)
    return [bool(index.matches(t)) for t in texts]


def changed_at(item, places):
    return " ".join(["left", *[f"other{i}" if i in places else w for i, w in enumerate(item)], "right"])


def test_decontamination_recall():
    """Every placing of the words that may differ: items under 12 words are always found, longer ones by 99 % or more."""
    for n in range(1, 22):
        item = [f"w{i}" for i in range(n)]
        may = n - math.ceil(0.8 * n - 1e-9)
        places = list(itertools.combinations(range(n), may))
        hit = found_in([changed_at(item, set(p)) for p in places], " ".join(item))
        assert all(hit) if n < decontamination.SHORT_ITEM else sum(hit) >= 0.99 * len(hit)
        beyond = [changed_at(item, set(p)) for p in itertools.combinations(range(n), may + 1)][:200]
        assert n >= decontamination.MIN_RUN or not any(found_in(beyond, " ".join(item)))
    rng = random.Random(4)
    for n in (30, 50, 100):
        item = [f"w{i}" for i in range(n)]
        hit = found_in([changed_at(item, set(rng.sample(range(n), n // 5))) for _ in range(300)], " ".join(item))
        assert sum(hit) >= 0.99 * len(hit)


def test_decontamination_short_and_unspaced():
    assert found_in(["we say open the gate now", "open a gate", "open the", ""], "Open the gate") == [True, False, False, False]
    assert found_in(["open the gate"], "open the gate", min_item_words=5) == [False]
    question = "日本の首都はどこですか"
    assert decontamination.words("naïve 日本 x1") == ["naïve", "日", "本", "x1"]
    assert found_in(["前文" + question + "後文", "前文" + question.replace("首", "主") + "後文", "日本の山"], question) == [True, True, False]


def test_decontamination_repeated_words(monkeypatch):
    """A text and an item of one repeated word hit at every pair of places; gathered in parts, the diagonals agree."""
    index = decontamination.Index([(1, "a " * 40), (2, "a b " * 20)])
    import numpy as np

    ids = np.array([1, 2] * 150 + [1] * 300)
    whole = index.hits(ids)
    monkeypatch.setattr(decontamination, "HITS", 100)
    assert (index.hits(ids) == whole).all() and len(whole) <= 2 * (len(ids) + 40)


def test_quality(spark, odd, nothing, documents):
    got = rows(queries.op3_quality_llr(spark, DATA))
    for i, t in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c = collections.Counter(tri)
        covered = {j + k for j, x in enumerate(tri) if c[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(odd, labels).collect()
    assert len(out) == odd.count() and not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3, None))
    assert quality.score(nothing, labels).count() == 0 and quality.score(odd, labels.limit(0)).count() == odd.count()


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def grams_of(text, buckets):
    """The buckets of a text's 1-grams and 2-grams, by another library's hash."""
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    pair = lambda x, y: signed(xxhash.xxh64_intdigest(struct.pack("<q", y), xxhash.xxh64_intdigest(struct.pack("<q", x), 42)))
    h = [word(w) for w in regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", text or "")]
    half = buckets // 2
    return [x % half for x in h] + [half + pair(x, y) % half for x, y in itertools.pairwise(h)]


def test_quality_scores(spark, documents):
    """llr and kept against sums over the counted n-grams."""
    docs = documents | {10**6: "a", 10**6 + 1: None, 10**6 + 2: "&&& 'tis naïve— 日本語\u0301 x2 " * 20}
    good = {i for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{DATA}/labels.parquet'").fetchall() if q == 1 and not t}
    grams = {i: grams_of(t, quality.BUCKETS) for i, t in docs.items()}
    raw = collections.Counter(g for x in grams.values() for g in x)
    target = collections.Counter(g for i, x in grams.items() if i in good for g in x)
    share, s = target.total() / raw.total(), quality.SMOOTHING
    weight = {g: math.log((target[g] + s) / (n * share + s)) for g, n in raw.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    weights = quality.fit_weights(df, labels)
    assert len(weights) == quality.BUCKETS and all(weights[g] == pytest.approx(weight.get(g, 0.0)) for g in range(quality.BUCKETS))
    for r in quality.score(df, labels).collect():
        x = grams[r["doc_id"]]
        want = sum(weight[g] for g in x) / len(x) if x else 0.0
        assert r["llr"] == pytest.approx(want, abs=1e-9) and r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_quality_separates_held_out_labels(spark):
    """Weights from half of the labels; the other half is judged, also with symbols moved in front of and inside words."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    bad = docs.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id")
    front = bad.select((F.col("doc_id") + 10**9).alias("doc_id"), F.regexp_replace("text", r"([\p{L}]+)([#*$%&|<>!]+)", "$2$1").alias("text"))
    inside = bad.select((F.col("doc_id") + 2 * 10**9).alias("doc_id"), F.regexp_replace("text", r"(\p{L})([\p{L}]*)([#*$%&|<>!]+)", "$1$3$2").alias("text"))
    got = quality.score(docs.unionAll(front).unionAll(inside), labels.filter(fold == 0)).select("doc_id", "kept", "base_failed", "llr").collect()
    truth = {r["doc_id"]: r["q"] for r in labels.filter(fold == 1).groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    judged = [(truth[r["doc_id"] % 10**9], r["doc_id"] // 10**9, r["kept"]) for r in got if r["doc_id"] % 10**9 in truth and not r["base_failed"]]
    assert all(k for q, _, k in judged if q == 1) and sum(q == 1 for q, *_ in judged) > 100
    for moved in range(3):
        assert [k for q, m, k in judged if q == 0 and m == moved].count(True) == 0
    assert sum(q == 0 for q, *_ in judged) > 20


def test_mixing(spark, odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["copies"] <= 2 for r in got)
    per = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in per.values()) - 1.5 * sum(s for s, _ in per.values())) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in per.values())
    assert mixing.repeat_copies(mixing.mix(odd)).count() == sum(r["copies"] for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mixing_keeps_names_and_values(spark):
    """Columns named as results or internals of the mix go through the repetition with their own values."""
    df = spark.createDataFrame([(i, "s", "a b c", 77, 5, "t", 1, 9.5, 3, "r") for i in range(40)], "doc_id long, source string, text string, copy int, size int, target_source string, copies int, target double, source_size int, w string")
    assert {r["copy"] for r in mixing.mix(df).collect()} == {77} and {r["target_source"] for r in mixing.mix(df).collect()} == {"t"}
    got = mixing.repeat_documents(df)
    assert got.schema == df.schema and got.distinct().exceptAll(df).count() == 0 and 40 < got.count() <= 80
    with pytest.raises(ValueError):
        mixing.repeat_copies(mixing.mix(df))
    numbered = mixing.repeat_copies(mixing.mix(df), "nth").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("nth").alias("m"), F.max("copies").alias("c")).collect()
    assert all(r["n"] == r["m"] == r["c"] for r in numbered)


@pytest.mark.parametrize("doc_id", [None, 3])
def test_mixing_draws_by_row(spark, doc_id):
    """A source whose rows all share one id, or have none, still comes near its target."""
    df = spark.createDataFrame([(doc_id, "a", f"w{i} x y") for i in range(2000)] + [(i, "b", "u v w") for i in range(2000)], "doc_id long, source string, text string")
    for source in ("a", "b"):
        rows_ = mixing.mix(df).filter(F.col("source") == source).collect()
        taken, target = sum(r["size"] * r["copies"] for r in rows_), rows_[0]["target"]
        assert abs(taken - target) < 0.06 * target


def test_mixing_equal_caps(spark):
    """Sources that reach their caps at the same level: all capped, whatever the order."""
    df = spark.createDataFrame([(i, s, "a b") for s in "abcdef" for i in range(10 if s in "ad" else 4 if s in "be" else 2)], "doc_id long, source string, text string")
    per = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(df, total_share=2.5).collect()}
    assert all(t == 2 * n for n, t in per.values())


def test_warc(spark, tmp_path):
    big, small = "é" * 60, "tiny"
    pages = spark.createDataFrame([(3, "u3", big), (1, "u\r\n1", big), (2, "u2", big), (4, "u4", small), (5, "u5", small), (6, None, None), (None, "u", big), (7, "u7", "x" * 300000)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    index = warc.write_warc(warc.classify(pages), folder)
    got = rows(warc.read_warc(index, folder, max_range=1000), "page_id")
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert bytes(got[1]["payload"]).decode() == big and got[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and got[2]["payload_bytes"] == 120
    assert [r["page_id"] for r in warc.read_warc(warc.urls(index, ["u4"]), folder).collect()] == [4]
    assert got[6]["url"] is None and got[1]["url"] == "u%0D%0A1"
    assert warc.round_trip(spark, pages.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_records(spark, tmp_path):
    """Every member is a record with a date and an identifier of its own; files begin with warcinfo; reads are spread."""
    folder = str(tmp_path / "w")
    pages = spark.createDataFrame([(1, f"u{i}", None if i == 3 else "é<p>" * i) for i in range(60)] + [(2, "again", "é<p>" * 40)], "page_id long, url string, html string")
    index = warc.write_warc(warc.classify(pages), folder, max_file_bytes=4000, date="2024-02-29T00:00:00Z")
    seen = []
    for f in tmp_path.glob("w/*.warc.gz"):
        raw, kinds = f.read_bytes(), []
        while raw:
            z = zlib.decompressobj(31)
            fields, body = warc.parse_record(z.decompress(raw))
            raw = z.unused_data
            kinds.append(fields["WARC-Type"])
            seen.append(fields["WARC-Record-ID"])
            assert fields["WARC-Date"] == "2024-02-29T00:00:00Z"
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    files = len(list(tmp_path.glob("w/*.warc.gz")))
    assert len(set(seen)) == len(seen) == 61 + files and files > 2
    read = warc.read_warc(index, folder, max_range=500, task_bytes=1000)
    assert read.count() == 61 and read.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    got = collections.Counter((r["url"], r["record_type"], bytes(r["payload"]).decode()) for r in read.collect())
    assert got == collections.Counter([(f"u{i}", "response", "" if i == 3 else "é<p>" * i) for i in range(60)] + [("again", "revisit", "")])


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab1 2.3@+-()  .@9:") for _ in range(rng.randint(0, 60)))
        assert pii.find(t)[0] == base_spans(t)
    for text, kind, part in [("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("write jane at example dot org please", "email", "jane at example dot org"), ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"), ("to аlice@exаmple.com.", "email", "аlice@exаmple.com"), ("１９２.１６８.１.１", "ip", "１９２.１６８.１.１")]:
        found = pii.find(text)[1]
        assert [(s[3], text[s[0] : s[2]]) for s in found] == [(kind, part)]
    assert pii.find("Look at the dot on it, meet at noon. com")[1] == []
    assert pii.redact("a@b.c x", "email:0:5") == "[email] x"


def signs_by_patterns(text):
    """The text with at and dot signs replaced, by whole-address patterns that take time without bound."""
    word, at, dot = r"[A-Za-z0-9%+-]+", r"(?: *[\[({<] *(?:at|@) *[\])}>] *| +at +| *@ *)", r"(?: *[\[({<] *(?:dot|\.) *[\])}>] *| +dot +|\.)"
    tld = r"(?:com|org|net|edu|gov|info|biz|io|co|ai|eu|uk|us|de|fr|es|it|nl|ch|at)"
    bracket = r"[\[({<] *(?:at|@|dot|\.) *[\])}>]"
    for m in re.finditer(rf"(?<![A-Za-z0-9%+-]){word}(?:{dot}{word})*?{at}{word}(?:{dot}{word})+", text, re.I):
        if re.search(bracket, m[0], re.I):
            return re.sub(dot, ".", re.sub(at, "@", m[0], count=1, flags=re.I), flags=re.I)
    m = re.search(rf"(?<![A-Za-z0-9%+-]){word}(?:(?: +dot +|\.){word})* +at +{word}(?:(?: +dot +|\.){word})*? +dot +{tld}(?![A-Za-z0-9])", text, re.I)
    return re.sub(r" +dot +", ".", re.sub(r" +at +", "@", m[0], count=1, flags=re.I), flags=re.I) if m else None


def test_pii_signs_against_patterns():
    """One disguised address in other words: the same address as whole-address patterns give."""
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    found = 0
    for _ in range(4000):
        dot = lambda: pick(" dot ", ".", " [dot] ", "(dot)", " { . } ", "  dot  ")
        name = lambda: "".join(rng.choice("abc1-") for _ in range(rng.randint(1, 3)))
        local = dot().join(name() for _ in range(rng.randint(1, 2)))
        domain = dot().join([*(name() for _ in range(rng.randint(0, 2))), pick("com", "org", "zzz", "uk")])
        text = "see: " + local + pick(" at ", " [at] ", "(at)", " <@> ", "  at  ", "@", " @ ") + domain + pick("", " :", "; ok", ")")
        want = signs_by_patterns(text)
        got = pii.plain_signs(pii.Mapped(text)).text
        found += want is not None
        assert (want in got) if want and want not in text else got.count("@") == text.count("@") or want is None, (text, want, got)
    assert found > 1000


def test_pii_spans_of_disguises():
    """Identifiers in random disguises among plain words: each span is exactly the disguised source."""
    rng = random.Random(9)
    look = {v: k for k, v in pii.HOMOGLYPHS.items() if v.isalpha()}
    spelled = {v: k for k, v in pii.SPELLED.items() if k in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")}
    hide = {
        "glyphs": lambda t: "".join(look.get(c, c) if rng.random() < 0.5 else c for c in t[:-1]) + look["o"] + ".com",
        "wide": lambda t: "".join(chr(ord(c) + 0xFEE0) for c in t),
        "bold": lambda t: "".join(chr(0x1D400 + ord(c) - 97) if c.isalpha() else c for c in t),
        "signs": lambda t: t.replace("@", rng.choice([" [at] ", "(at)", " at "])).replace(".", rng.choice([" [dot] ", " (dot) "])),
    }
    for _ in range(400):
        before, after = "ünder the old bridge, ", rng.choice(["", " again", ", we said"])
        kind = rng.choice(sorted(hide))
        plain = "".join(rng.choice("acepx") for _ in range(5)) + "@" + "".join(rng.choice("acepx") for _ in range(4)) + ("" if kind == "glyphs" else ".com")
        text = hide[kind](plain)
        assert [(s[3], (before + text)[s[0] : s[2]]) for s in pii.find(before + text + after)[1]] == [("email", text)], (text, kind)
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(9, 11)))
        call = "plus " + rng.choice([" ", "-"]).join(spelled[d] for d in digits)
        assert [(s[3], (before + call)[s[0] : s[2]]) for s in pii.find(before + call + after)[1]] == [("phone", call)]
        call = "+" + "".join(chr(0x0660 + int(d)) for d in digits)
        assert [(s[3], (before + call)[s[0] : s[2]]) for s in pii.find(before + call + after)[1]] == [("phone", call)]


@pytest.mark.parametrize("part", ["a.", "a dot ", "(at) ", "(at) a.", "(at) a dot ", " ", "( ", "one ", "plus ", "a@", "@", "+1(", "dot at ", "１", "1 "])
def test_pii_long_texts_take_time_in_proportion(part):
    def seconds(n):
        began = time.process_time()
        pii.find("(at) " + part * (n // len(part)))
        return time.process_time() - began

    assert seconds(400_000) < 10 * max(0.05, seconds(100_000))


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write john AT mail DOT co DOT uk now", "john AT mail DOT co DOT uk"),
        ("write ana arroba correo punto es hoy", "ana arroba correo punto es"),
        ("an max (ät) post (punkt) de bitte", "max (ät) post (punkt) de"),
        ("à luc arobase poste point fr demain", "luc arobase poste point fr"),
        ("john dot doe at mail.example dot org.", "john dot doe at mail.example dot org"),
        ("to kim at lab dot uni dot edu. Then at noon", "kim at lab dot uni dot edu"),
    ],
)
def test_pii_addresses_in_words(text, span):
    assert [(s[3], text[s[0] : s[2]]) for s in pii.find(text)[1]] == [("email", span)]


@pytest.mark.parametrize(
    "text",
    [
        "He lives at example dot com street.",
        "Come and see us at www dot site dot org for more.",
        "The module one.two.three.four is imported first.",
        "Look at the dot on it, meet at noon. com",
        "We met at noon dot and at two dot in the rain.",
        "El punto de vista está en el punto es claro.",
        "Der Punkt ist, at point de vue, klar.",
        "Uno, dos y tres; one or two of them, seven eight.",
        "Chapter 3.1.4 of version 10.2 costs 12 at 5 per cent.",
        "Page 12-34, 1999-2001, rooms 7 8 9.",
    ],
)
def test_pii_leaves_clean_sentences(text):
    assert pii.find(text)[1] == []


def test_pii_odd(odd, nothing):
    got = pii.detect(odd).collect()
    assert len(got) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got)
    assert pii.detect(nothing).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        t = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def removed(docs, n):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        raw, mark = t.encode(), bytearray(len(t.encode()))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                mark[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        out[i] = (len(raw), sum(mark), sum(m and (j == 0 or not mark[j - 1]) for j, m in enumerate(mark)), hashlib.sha256(bytes(c for c, m in zip(raw, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("limit", [256, 2, 1])
def test_suffix_dedup(spark, limit):
    """On texts that share, repeat and change passages; limits 2 and 1 split groups by longer and longer contexts."""
    rng = random.Random(limit)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    piece = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = piece(60)
    docs = {0: piece(50) + passage, 1: passage + piece(40) + passage, 2: piece(30) + passage[:150] + "x" + passage[151:] + piece(9), 3: "ab" * 200, 4: "ab" * 90, 5: "", 6: passage, 7: passage, 8: piece(3)}
    docs |= {9 + k: passage[:140] + rng.choice(words) + passage[140 + k :] for k in range(6)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove(df, group_contexts=limit).collect()}
    assert got == removed(docs, 100)


def test_suffix_dedup_repeated_ids(spark):
    """Different texts under one doc_id, null ids and repeated rows, in the order of ids, then of a hash of the text."""
    rng = random.Random(11)
    p, q, x = ("".join(rng.choice("abcdefgh ") for _ in range(280)) for _ in range(3))
    rows_in = [(1, "zz " + p), (5, p + " tail one"), (5, q), (5, q), (6, "y" + q + "y"), (7, x), (7, "w" + x), (None, q + "v"), (None, "u" + x), (None, "u" + x)]
    df = spark.createDataFrame(rows_in, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["h"], r["text"]) for r in df.collect()})
    want = removed({i: r[3] for i, r in enumerate(order)}, 100)
    by_row = {(None if r[0] else r[1], r[3]): want[i] for i, r in enumerate(order)}
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove(df).collect())
    assert got == collections.Counter((i, *by_row[i, t]) for i, t in rows_in)
    assert {r["n_removed"] for r in suffix_dedup.remove(df.limit(3)).collect()} == {0, 280}


def test_suffix_dedup_odd(odd, nothing):
    got = suffix_dedup.remove(odd).collect()
    assert len(got) == odd.count() and {r["n_removed"] for r in got if r["doc_id"] != 4} == {0}
    assert suffix_dedup.remove(nothing).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(documents, name):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [*documents.values(), "", " ", "  a  b", "a\n\nb", "héllo 世界 🎉🎉", "<s>x</s><unk>", "▁▁x ▁y", "\t\tx", "x" * 500, "日本語" * 20, "<|endoftext|>a"]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    else:
        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    c = tokens.counter(name)
    assert [c.count(t) for t in texts] == want


def test_token_odd(odd, nothing):
    got = tokens.count_tokens(odd, "piece_bpe_32k.model").collect()
    assert len(got) == odd.count() and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (1, 2)) and next(r for r in got if r["doc_id"] == 4)["over_limit"]
    assert tokens.count_tokens(nothing, "piece_bpe_32k.model").count() == 0


def test_automaton_phrases():
    rng = random.Random(2)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    model = language.fit({"x": sample, "y": "zzz"})
    for _ in range(200):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        n, at, base = 0, 0, language.normal(sample).decode()
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at : at + k + 1] in base:
                k += 1
            at, n = at + k, n + 1
        assert language.phrases([language.encode(t, model)], model)[0, 0] == n


def test_parse_in_blocks_and_other_scripts():
    """Blocks add at most one phrase each; a large alphabet keeps to byte columns and to the model's bound."""
    rng = random.Random(12)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6000))
    latin = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900))
    model = language.fit({"zh": cjk, "xx": latin})
    assert model.n_codes <= 257 and sum(t.nbytes for t in model.tables) <= 4 * model.n_codes * 2 * (len(cjk.encode()) + len(latin) + 2)
    assert language.predict([cjk[100:180], latin[50:90], "12 !", None], model)["lang_pred"].tolist() == ["zh", "xx", "und", "und"]
    small = language.fit({"zh": cjk, "xx": latin}, model_bytes=1 << 20)
    assert sum(t.nbytes for t in small.tables) <= (1 << 20) + 16 * small.n_codes
    coded = [language.encode(latin[7:5000], model), language.encode(cjk[5:2000], model)]
    whole, parts = language.phrases(coded, model, block=1 << 20), language.phrases(coded, model, block=256)
    extra = parts - whole
    assert (extra >= 0).all() and all((extra[i] <= -(-len(c) // 256)).all() for i, c in enumerate(coded))


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    held = [r for r in queries.op9_language_id(spark, d).collect() if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_sample_is_full_under_skew(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    some = [(text(2500), "aa") for _ in range(100)] + [(text(2500), "bb") for _ in range(100)]
    long, copied = (text(1000) * 20_000, "aa"), (text(2500), "bb")
    df = spark.createDataFrame([*some, long, *[copied] * 8000, ("x" + "1 " * 3000, "cc"), *[(str(i) * 5, "cc") for i in range(50)]], "text string, lang string")
    got = language.sample_texts(df)
    assert len(got["aa"]) >= language.SAMPLE_CHARS and len(got["bb"]) >= language.SAMPLE_CHARS and got["cc"].strip() == "x"


def test_language_odd(odd, nothing):
    got = language.identify(odd, odd.select("text", "lang")).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3)) and all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(nothing, nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, nothing.select("text", "lang")).collect()} == {"und"}


def test_sharding(spark, odd, nothing):
    out = queries.op10_shard_pack(spark, "/root/testdata/sf0.01").collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(load) == 16 and max(load.values()) < 1.1 * min(load.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert all((r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, zlib.crc32((texts[r["doc_id"]] or "").encode())) for r in out)
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[texts[r["doc_id"]]].add(r["shard"])
    assert {len(x) for x in by_text.values()} == {1}
    again = queries.op10_shard_pack(spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    got = sharding.shard(odd, 4).collect()
    assert len(got) == odd.count() and next(r for r in got if r["doc_id"] == 1)["size"] == 1
    assert sharding.shard(nothing, 4).count() == 0
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    n = collections.Counter(r["shard"] for r in sharding.shard(hot, 4).collect())
    assert max(n.values()) - min(n.values()) < 100


def test_packing_against_brute_force():
    """Heaviest first, each item to the shard with the largest dot product with what is left of it."""
    rng = random.Random(10)
    for n_shards in (1, 2, 5):
        items = [(rng.randint(1, 50), rng.randint(0, 9), rng.randint(1, 3)) for _ in range(rng.randint(0, 60))]
        total = [sum(x) for x in zip(*items, strict=True)] or [1, 1, 1]
        unit = [tuple(v / (t or 1) for v, t in zip(x, total, strict=True)) for x in items]
        load, chosen = [[0.0] * 3 for _ in range(n_shards)], sharding.pack(items, n_shards)
        for i in sorted(range(len(items)), key=lambda i: -sum(v * v for v in unit[i])):
            dots = [sum(v * (1 / n_shards - had) for v, had in zip(unit[i], load[k], strict=True)) for k in range(n_shards)]
            k = chosen[i]
            assert dots[k] == pytest.approx(max(dots), abs=1e-12)
            load[k] = [a + b for a, b in zip(load[k], unit[i], strict=True)]


def test_pipeline(spark, documents):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in p.STAGES:
        kept.append(p.materialize(stage(spark, kept[-1], DATA), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(any(map(str.isalpha, documents[i])) for i in ids[1]) and all(not any(map(str.isalpha, documents[i])) for i in ids[0] - ids[1])
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(90))]
    more = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(noise)], "doc_id long, text string"), allowMissingColumns=True)
    assert {r["doc_id"] for r in p.language_id(spark, more, DATA).collect()} == ids[1]
    component, _ = shingle_components({i: documents[i] for i in ids[1]}, 5, 80)
    assert ids[2] == set(component.values())
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert ids[2] - ids[3] == {r["doc_id"] for r in decontamination.find_leaks(kept[2], bench).collect()}
    assert kept[5].count() == kept[4].count() and {"shard", "slot"} <= set(kept[5].columns)
