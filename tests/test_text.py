from pyspark.sql import functions as F

from peerlens.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first()["r"]


def test_names(spark):
    assert one(spark, T.normalize_name, "Vinícius José Paixão de Oliveira Júnior") == "vinicius jose paixao de oliveira"
    assert one(spark, T.normalize_name, "N'Golo  KANTÉ") == "n golo kante"
    assert one(spark, T.normalize_name, "Junior") == "junior"
    assert one(spark, T.normalize_name, None) == ""


def test_fees(spark):
    f = lambda x: tuple(one(spark, T.parse_fee, x))
    assert f("€ 45M") == ("disclosed", "permanent", 45e6, "EUR")
    assert f("€ 12,5M") == ("disclosed", "permanent", 125e6, "EUR")
    assert f("Loan") == ("loan_fee", "loan", None, None)
    assert f("N/A") == ("undisclosed", "permanent", None, None)
    assert f(None) == ("unknown", "unknown", None, None)


def test_seasons_and_clock(spark):
    assert tuple(one(spark, T.season_years, "2015/2016")) == (2015, 2016)
    assert tuple(one(spark, T.season_years, "2018")) == (2018, 2018)
    assert one(spark, T.clock_minutes, "89:15") == 89.25
    assert one(spark, T.timestamp_seconds, "00:01:02.500") == 62.5


def test_token_set():
    assert T.token_set_ratio("real madrid", "madrid real") == 100
    assert T.token_set_ratio("real madrid cf", "real madrid") == 100
    assert T.token_set_ratio("", "x") == 0
    assert 50 < T.token_set_ratio("lionel messi", "leonel messi") < 100


def test_names_of_other_scripts(spark):
    """As they are written after decomposition: soft and hard signs part words, as punctuation does; other scripts go."""
    pairs = {
        "Андрій Шевченко": "andrii shevchenko", "Александр Головин": "aleksandr golovin", "Юрий Жирков": "iurii zhirkov", "Щукин Ёлкин": "shchukin elkin", "Ольга": "ol ga", "Лука Модрић": "luka modritsh",
        "Γιώργος Καραγκούνης": "giorgos karagkounes", "Χρήστος Ψ": "khrestos ps", "손흥민": "sonheungmin", "이강인 jr": "igangin", "Østigård Łukasz ß": "ostigard lukasz ss", "田中": "", "محمد Salah": "salah",
    }
    df = spark.createDataFrame(list(pairs.items()), "name string, want string")
    from peerlens.functions.text import normalize_name

    assert {r["name"]: r["got"] for r in df.withColumn("got", normalize_name(df["name"])).collect()} == pairs


def test_common_length_is_that_of_the_table():
    import random

    from peerlens.functions.text import common_length

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert common_length(a, b) == row[-1]
