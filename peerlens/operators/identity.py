"""Linking records of two sources: blocking, fuzzy names, decisions."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CLUB_STOP_WORDS, RESERVE_SIDES
from ..functions.storage import written
from ..functions.text import normalize_name, token_set_similarity


def exact_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, overlap: same block and a name in common. left, right: id, block, names array<string>.
    A row per pair: where many ids have the same names, decide counts them by classes instead."""
    l = left.select(F.col("id").alias("left_id"), "block", F.explode(F.array_distinct("names")).alias("name")).filter("name <> ''")
    r = right.select(F.col("id").alias("right_id"), "block", F.explode(F.array_distinct("names")).alias("name")).filter("name <> ''")
    return l.join(r, ["block", "name"]).groupBy("left_id", "right_id").agg(F.count("*").alias("overlap"))


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ids of the same names in the same blocks are one class, as names and blocks alone decide.

    members: id, cls. classes: cls, n (number of its ids), least (its first id), names array<struct<block, name>>; written,
    so that no pairs of ids are made but pairs of classes.
    """
    named = records.select("id", "block", F.explode("names").alias("name")).filter("name <> '' and block is not null")
    sets = named.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("block", "name"))).alias("names"))
    of = sets.select("id", F.sha2(F.to_json("names"), 256).alias("cls"), "names")
    classes = of.groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("id"))["id"].alias("least"), F.first("names").alias("names"))
    return of.select("id", "cls"), written(classes, "name-classes")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left_cls, block, left_name) and (right_cls, right_n, right_id, block, right_name) of classes."""
    l = left.select(F.col("cls").alias("left_cls"), F.explode("names").alias("x")).select("left_cls", "x.block", F.col("x.name").alias("left_name"))
    r = right.select(F.col("cls").alias("right_cls"), F.col("n").alias("right_n"), F.col("least").alias("right_id"), F.explode("names").alias("x"))
    return l, r.select("right_cls", "right_n", "right_id", "x.block", F.col("x.name").alias("right_name"))


def _exact_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_cls, right_id, n: the right id of most common names (the first of them), and how many right ids have one in common."""
    l, r = _sides(left, right)
    met = l.withColumnRenamed("left_name", "name").join(r.withColumnRenamed("right_name", "name"), ["block", "name"])
    pairs = met.groupBy("left_cls", "right_cls").agg(F.count("*").alias("overlap"), F.first("right_n").alias("right_n"), F.first("right_id").alias("right_id"))
    return pairs.groupBy("left_cls").agg(F.sum("right_n").alias("n"), F.min(F.struct(-F.col("overlap"), "right_id"))["right_id"].alias("right_id"))


def _fuzzy_classes(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left_cls, right_id, score, n_best: each pair of different names of a block is scored once."""
    l, r = _sides(left, right)
    names = lambda x, side: x.select("block", F.col(f"{side}_name").alias("name")).distinct().withColumn("id", F.col("name"))
    near = _near_names(names(l, "left"), names(r, "right"), threshold).withColumnsRenamed({"left_id": "left_name", "right_id": "right_name"})
    pairs = near.join(r, ["block", "right_name"]).join(l, ["block", "left_name"]).groupBy("left_cls", "right_cls").agg(F.max("score").alias("score"), F.first("right_n").alias("right_n"), F.first("right_id").alias("right_id"))
    alike = pairs.groupBy("left_cls", "score").agg(F.sum("right_n").alias("n_best"), F.min(F.struct("right_id"))["right_id"].alias("right_id"))
    best = alike.groupBy("left_cls").agg(F.max("score").alias("score"), F.max_by(F.struct("right_id", "n_best"), "score").alias("b"))
    return best.select("left_cls", "b.right_id", "score", "b.n_best")


def _of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    return members.select(F.col("id").alias("left_id"), F.col("cls").alias("left_cls")).join(found, "left_cls").drop("left_cls")


RANKED_PAIRS = 100_000


def _pair_ranks(*sides: DataFrame) -> dict[str, int]:
    """How common letter pairs are among all names, as ranks from 1: the RANKED_PAIRS most common ones, which bounds what comes
    to the driver. Pairs without a rank count as rarest; the ranks decide the work and not the result."""
    names = reduce(DataFrame.unionAll, [s.select("name") for s in sides])
    counted = names.select(F.explode(letter_pairs(F.col("name"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "g").limit(RANKED_PAIRS).collect()
    return {r["g"]: len(top) - i for i, r in enumerate(top)}


def _name_words(name: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"\s+", name) if w))


def _numbered_pairs(words: list[str]) -> list[str]:
    """The letter pairs of words set between blanks, each with the number of times it came before."""
    seen: Counter = Counter()
    out = []
    for w in words:
        padded = f" {w} "
        for i in range(len(w) + 1):
            g = padded[i : i + 2]
            out.append(f"{g}{seen[g]}")
            seen[g] += 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def letter_pairs(names: pd.Series) -> pd.Series:
    return names.map(lambda n: _numbered_pairs(_name_words(n)))


def _compare_keys(names: DataFrame, side: str, threshold: float, ranks: dict[str, int]) -> DataFrame:
    """A row per key of each name (id, block, name), so that any two names which reach the threshold have a key in common.

    Two ways lead there. Either common words make up nearly all of one name: then one of its longest words, taken until
    those left out would cost too much, is a word of the other. Or both names, as words in any order, are near: then few
    of their letter pairs differ, each word counted with a blank at both ends, and in one order of all letter pairs,
    the rarest first, the first ones of both, one more than can differ, have one in common (a prefix filter). Names that
    are near have lengths of the same class or of neighbouring ones, which is part of these keys: left names have their
    own class, right ones those on either side too, so names of other lengths never meet.
    """
    cut = (2 - 2 * threshold) / (2 - threshold)  # the share of a name's characters that can be missing in the other
    ratio = math.log((2 - threshold) / threshold)  # of the lengths of two near names, at most
    left = side == "left"
    mine, theirs = ("a", "b") if left else ("b", "a")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(of: pd.Series) -> pd.Series:
        out = []
        for name in of:
            words = _name_words(name)
            size = len(" ".join(words))
            found = {theirs + w for w in words}
            left_out = 0
            for w in sorted(words, key=lambda w: (-len(w), w)):
                if left_out > cut * size + 1e-9:
                    break
                found.add(mine + w)
                left_out += len(w) + 1
            if size:
                first = sorted(_numbered_pairs(words), key=lambda g: (ranks.get(g, 0), g))[: int(2 * cut * size + 1e-9) + 1]
                at = int(math.log(size) / ratio) if ratio else size
                classes = (at,) if left else (at - 1, at, at + 1)
                found |= {f"g{c} {g}" for c in classes for g in first}
            out.append(sorted(found))
        return pd.Series(out)

    x = names.select(F.col("id").alias(f"{side}_id"), "block", F.col("name").alias(f"{side}_name"))
    return x.withColumn(f"{side}_size", F.length(F.concat_ws(" ", F.array_distinct(F.filter(F.split(f"{side}_name", r"\s+"), lambda w: w != ""))))).withColumn("k", F.explode(keys(f"{side}_name")))


def _near_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """block, left_id, right_id, score of the names (id, block, name) of a block that reach the threshold; each pair of names is scored once."""
    ranks = _pair_ranks(left, right)
    near = F.least("left_size", "right_size") * (2 - threshold) >= F.greatest("left_size", "right_size") * threshold - 1e-9
    pairs = _compare_keys(left, "left", threshold, ranks).join(_compare_keys(right, "right", threshold, ranks), ["block", "k"])
    pairs = pairs.filter(~F.col("k").startswith("g") | near).select("block", "left_id", "right_id", "left_name", "right_name").distinct()
    return pairs.withColumn("score", token_set_similarity(F.col("left_name"), F.col("right_name"))).filter(F.col("score") >= threshold).select("block", "left_id", "right_id", "score")


def fuzzy_best(left: DataFrame, right: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    """left_id, right_id, score, n_best: the best token-set similarity, at least threshold, in the block.

    Exact for every pair of names of a block, without multiplying it out: see _compare_keys for what candidates share.
    A key that much of a large block holds is split by the skew join; each pair of names is scored once, however many ids
    have them.
    """
    (members, l), (_, r) = _classes(left), _classes(right)
    return _of_members(_fuzzy_classes(l, r, threshold), members).select("left_id", "right_id", "score", "n_best")


def resolve_clubs(teams: DataFrame, listed: DataFrame, *, stop_words: tuple[str, ...] = CLUB_STOP_WORDS, reserves: str = RESERVE_SIDES, threshold: float = 0.9) -> DataFrame:
    """team_id, listed_id, score: the one listed club that a team's name stands for.

    teams: id, name, country. listed: id, name, country, national; names normalised. Reserve and national sides and
    clubs of another known country (by its normalised name) are left out. Clubs of the team's whole name, or of its name without stop words,
    come first (1.0), else those of token-set similarity of the threshold (0.9); only a single one is taken.
    """
    country = normalize_name(F.col("country").cast("string"))
    teams = teams.withColumn("country", F.when(F.col("country").isNotNull(), country))
    clubs = listed.filter(~F.coalesce("national", F.lit(False)) & ~F.col("name").rlike(reserves)).withColumn("country", F.when(F.col("country").isNotNull(), country))
    words = F.filter(F.split("name", " "), lambda w: ~w.isin(*stop_words) & (w != ""))
    wanted = teams.withColumn("names", F.array_distinct(F.array("name", F.concat_ws(" ", words))))
    same = F.col("country").isNull() | F.col("listed_country").isNull() | (F.col("country") == F.col("listed_country"))
    known = clubs.select(F.col("id").alias("listed_id"), F.col("name").alias("k"), F.col("country").alias("listed_country"))
    exact = wanted.select("id", "country", F.explode("names").alias("k")).filter("k <> ''").join(known, "k").filter(same).select("id", "listed_id").distinct()
    rest = teams.join(exact.select("id").distinct(), "id", "left_anti")
    named = lambda df: df.select("id", F.lit(0).alias("block"), "name").filter("name <> ''")
    near = _near_names(named(rest), named(clubs), threshold)
    near = near.join(teams.select(F.col("id").alias("left_id"), "country"), "left_id").join(clubs.select(F.col("id").alias("right_id"), F.col("country").alias("listed_country")), "right_id").filter(same)
    both = exact.withColumn("score", F.lit(1.0)).unionByName(near.select(F.col("left_id").alias("id"), F.col("right_id").alias("listed_id"), F.lit(0.9).alias("score")))
    return both.groupBy(F.col("id").alias("team_id")).agg(F.count_distinct("listed_id").alias("n"), F.min("listed_id").alias("listed_id"), F.max("score").alias("score")).filter("n = 1").drop("n")


def decide(left: DataFrame, right: DataFrame, *, threshold: float | None = 0.9) -> DataFrame:
    """left_id, right_id, decision, score: one exact match is linked (0.95), several go to review (0.80), else a
    unique fuzzy match goes to review (0.9 of its score); a right record claimed twice goes to review (0.85).
    threshold: of the fuzzy match; without one only exact names decide."""
    (members, l), (_, r) = _classes(left), _classes(right)
    one = F.col("n") == 1
    e = _exact_classes(l, r).select("left_cls", "right_id", F.when(one, "linked").otherwise("review").alias("decision"), F.when(one, 0.95).otherwise(0.80).alias("score"))
    both = e
    if threshold is not None:
        e = both = written(e, "exact-classes")
        rest = l.join(e.select(F.col("left_cls").alias("cls")), "cls", "left_anti")
        f = _fuzzy_classes(rest, r, threshold).filter("n_best = 1")
        both = e.unionByName(f.select("left_cls", "right_id", F.lit("review").alias("decision"), (F.col("score") * 0.9).alias("score")))
    linked = e.filter("decision = 'linked'").join(l.select(F.col("cls").alias("left_cls"), "n"), "left_cls")
    claims = linked.groupBy("right_id").agg(F.sum("n").alias("claims"))
    twice = (F.col("decision") == "linked") & (F.coalesce("claims", F.lit(0)) > 1)
    decided = both.join(claims, "right_id", "left").select("left_cls", "right_id", F.when(twice, "review").otherwise(F.col("decision")).alias("decision"), F.when(twice, 0.85).otherwise(F.col("score")).alias("score"))
    return _of_members(decided, members).select("left_id", "right_id", "decision", "score")


# Names of a record up to which matches are counted by sets of names, 2 ** NAMES_COUNTED - 1 of them.
NAMES_COUNTED = 4


def _strict_records(df: DataFrame, side: str) -> DataFrame:
    """{side}_id, names, nationality, born, plain: one record of its id, and few names."""
    named = df.select(F.col("id").alias(f"{side}_id"), F.array_sort(F.array_distinct(F.filter("names", lambda x: x.isNotNull() & (x != "")))).alias("names"), "nationality", "born").filter(F.size("names") > 0)
    return named.withColumn("plain", (F.count("*").over(Window.partitionBy(f"{side}_id")) == 1) & (F.size("names") <= NAMES_COUNTED))


def _asked(column: str, side: str) -> Column:
    """array<struct<kind, value>>: what a value is looked up by. A known one (0) of the left meets its equal or an unknown one
    (1) of the right, an unknown one of the left any (2); each of the right is itself and any."""
    x = F.col(column)
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    known, unknown, anything = of(0, x), of(1, F.when(F.lit(False), x)), of(2, F.when(F.lit(False), x))
    if side == "left":
        return F.when(x.isNotNull(), F.array(known, unknown)).otherwise(F.array(anything))
    return F.when(x.isNotNull(), F.array(known, anything)).otherwise(F.array(unknown, anything))


def _counted_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, n, right_id (the first) of plain records, without pairs: right records are counted for each set of their
    names, nationality and birth date; those with one of a left record's names are the counts of its single names, less those of two,
    and so on."""
    subsets = F.explode(F.expr("transform(sequence(1, shiftleft(1, size(names)) - 1), m -> filter(names, (x, i) -> (shiftright(m, i) & 1) = 1))"))

    def keys(df: DataFrame, side: str) -> DataFrame:
        x = df.filter("plain").select(f"{side}_id", subsets.alias("of"), "nationality", "born").withColumn("a", F.explode(_asked("nationality", side)))
        return x.withColumn("b", F.explode(_asked("born", side))).select(f"{side}_id", F.col("of").alias(f"{side}_of"), *[F.col(f"{c}.{f}").alias(f"{side}_{c}_{f}") for c in "ab" for f in ("kind", "value")])

    by = ["right_of", *[f"right_{c}_{f}" for c in "ab" for f in ("kind", "value")]]
    counted = keys(right, "right").groupBy(*by).agg(F.count("*").alias("n"), F.min("right_id").alias("right_id"))
    same = (F.col("left_of") == F.col("right_of"))
    for c in "ab":
        same = same & (F.col(f"left_{c}_kind") == F.col(f"right_{c}_kind")) & F.col(f"left_{c}_value").eqNullSafe(F.col(f"right_{c}_value"))
    odd = F.size("left_of") % 2 == 1
    met = keys(left, "left").join(counted, same)
    return met.groupBy("left_id").agg(F.sum(F.when(odd, F.col("n")).otherwise(-F.col("n"))).alias("n"), F.min("right_id").alias("right_id"))


def _paired_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, n, right_id (the first) of the pairs in which a record has many names or its id several records."""
    def keys(df: DataFrame, side: str) -> DataFrame:
        return df.select(f"{side}_id", F.explode("names").alias("name"), *[F.col(c).alias(f"{side}_{c}") for c in ("nationality", "born")])

    same = F.lit(True)
    for c in ("nationality", "born"):
        same = same & F.coalesce(F.col(f"left_{c}") == F.col(f"right_{c}"), F.lit(True))
    met = lambda l, r: keys(l, "left").join(keys(r, "right"), "name").filter(same).select("left_id", "right_id")
    pairs = met(left.filter("not plain"), right).unionAll(met(left.filter("plain"), right.filter("not plain"))).distinct()
    return pairs.groupBy("left_id").agg(F.count("*").alias("n"), F.min("right_id").alias("right_id"))


def strict_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, decision, score, n_matches for every left record: a name in common, and the same nationality
    and birth date where both sides know them. One match is linked (0.95), several are ambiguous, else there is none.

    left, right: id, names array<string>, nationality, born. Matches are counted without making pairs, however common
    a name is; only records of more than NAMES_COUNTED names, or of an id that has several records, meet in pairs.
    """
    l, r = _strict_records(left, "left"), _strict_records(right, "right")
    found = _counted_matches(l, r).unionByName(_paired_matches(l, r)).groupBy("left_id").agg(F.sum("n").alias("n_matches"), F.min("right_id").alias("right_id"))
    n = F.coalesce("n_matches", F.lit(0).cast("long"))
    return left.select(F.col("id").alias("left_id")).distinct().join(found, "left_id", "left").select(
        "left_id",
        F.when(n == 1, F.col("right_id")).alias("right_id"),
        F.when(n == 1, "linked").when(n > 1, "ambiguous").otherwise("none").alias("decision"),
        F.when(n == 1, 0.95).alias("score"),
        n.alias("n_matches"),
    )


def _initial_keys(short: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left_id, initial, surname) of short names such as "K. Del Rio", and (right_id, initial, surname) of people for every
    ending of their names after the first word; each once."""
    parts = r"^\s*(\p{L})\.\s*(.+)$"
    l = short.select(F.col("id").alias("left_id"), normalize_name(F.regexp_extract("name", parts, 1)).alias("initial"), normalize_name(F.regexp_extract("name", parts, 2)).alias("surname"))
    l = l.filter("initial <> '' and surname <> ''").distinct()
    words = people.select(F.col("id").alias("right_id"), F.split(normalize_name(F.col("name")), " ").alias("w")).filter(F.size("w") > 1)
    ends = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))
    r = words.select("right_id", F.substring(F.col("w")[0], 1, 1).alias("initial"), F.explode(ends).alias("surname"))
    return l, r.join(l.select("initial", "surname").distinct(), ["initial", "surname"], "left_semi").distinct()


# People of one initial and surname who meet the short names of it in one task.
PEOPLE_A_PART = 1_000


def initial_matches(short: DataFrame, people: DataFrame, *, part: int = PEOPLE_A_PART) -> DataFrame:
    """left_id, right_id: names such as "K. Del Rio" and people whose first name begins so and whose name ends in that
    surname, of one word or more. short, people: id, name. An equi-join on surname and initial.

    A common surname is cut into parts of its people, each of which meets all its short names. An id with one short name
    meets a person once; only pairs of ids with several are made distinct, so other pairs are not shuffled.
    """
    l, r = _initial_keys(short, people)
    by = ["initial", "surname"]
    parts = r.groupBy(*by).agg(F.ceil(F.count("*") / part).alias("parts"))
    l = l.withColumn("n", F.count("*").over(Window.partitionBy("left_id"))).join(parts, by)
    l = l.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    r = r.join(parts, by).withColumn("part", F.pmod(F.xxhash64("right_id"), "parts")).drop("parts")
    tasks = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number: few bytes come in, many rows go out
    r = r.repartition(tasks, *by, "part")
    met = lambda x: x.repartition(tasks, *by, "part").join(r, [*by, "part"]).select("left_id", "right_id")
    return met(l.filter("n = 1")).unionAll(met(l.filter("n > 1")).distinct())


def initial_matches_sharing_club(short: DataFrame, people: DataFrame, left_clubs: DataFrame, right_clubs: DataFrame) -> DataFrame:
    """The pairs of initial_matches that share a club. left_clubs: left_id, club; right_clubs: right_id, club.

    Initial, surname and club are one key, so pairs without a common club are never made. Repeated clubs go behind the
    shuffle by that key, which the join uses as well.
    """
    l, r = _initial_keys(short, people)
    by = ["initial", "surname", "club"]
    l = l.join(left_clubs.select("left_id", "club"), "left_id").repartition(*by).distinct()
    r = r.join(right_clubs.select("right_id", "club"), "right_id").repartition(*by).distinct()
    return l.join(r, by).select("left_id", "right_id").distinct()


def sharing_club(candidates: DataFrame, left_clubs: DataFrame, right_clubs: DataFrame) -> DataFrame:
    """The candidates (left_id, right_id) that share a club. left_clubs: left_id, club; right_clubs: right_id, club.
    Each candidate meets all clubs of its left side: where candidates come from initials, initial_matches_sharing_club makes far fewer rows."""
    of_left = candidates.select("left_id", "right_id").join(left_clubs.select("left_id", "club").distinct(), "left_id")
    return of_left.join(right_clubs.select("right_id", "club"), ["right_id", "club"], "left_semi").select("left_id", "right_id").distinct()


def review(queue: DataFrame, links: DataFrame) -> DataFrame:
    """queue (left_id, right_id, score, approve boolean) plus status: pending where nobody has decided, rejected, approved,
    or conflict where an approved record is linked to another one. links: left_id, right_id."""
    other_right = links.select("left_id", F.col("right_id").alias("__r")).groupBy("left_id").agg(F.min("__r").alias("__r"), F.max("__r").alias("__rr"))
    other_left = links.select("right_id", F.col("left_id").alias("__l")).groupBy("right_id").agg(F.min("__l").alias("__l"), F.max("__l").alias("__ll"))
    clash = (F.col("__r") != F.col("right_id")) | (F.col("__rr") != F.col("right_id")) | (F.col("__l") != F.col("left_id")) | (F.col("__ll") != F.col("left_id"))
    status = F.when(F.col("approve").isNull(), "pending").when(~F.col("approve"), "rejected").when(F.coalesce(clash, F.lit(False)), "conflict").otherwise("approved")
    return queue.join(other_right, "left_id", "left").join(other_left, "right_id", "left").select(*queue.columns, status.alias("status"))
