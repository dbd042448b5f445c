from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.operators.packed import ID_DELIMITERS, Grammar, split_packed
from loomwork.operators.skew import global_row_number, lookup_join

G = Grammar(ID_DELIMITERS, packed_ids=True)
TEXTS = Grammar()


def values(text):
    return [v for v, _ in G.parse(text)]


def test_ordered_alternatives():
    assert values("1,2;3") == ["1", "2", "3"]
    assert values('"1,001,565,307";"1,002"') == ["1001565307", "1002"]
    assert values("['10', '11']") == ["10", "11"]
    assert values('"10,11,12"') == ["10", "11", "12"]
    assert values('5 | "6",,7,') == ["5", "6", "7"]
    assert G.parse('1,"2')[1] == ("2", "open quote")
    assert G.parse("[1, 2")[0] == ("1", "open bracket")
    assert values("") == [] and values(",;|") == []


def test_text_values():
    read = lambda t: [v for v, _ in TEXTS.parse(t)]
    assert read('"Smith, John"; x') == ["Smith, John", "x"] and read("O'Brien, Lee") == ["O'Brien", "Lee"]
    assert read('"a ""b"" c"') == ['a "b" c'] and read(r'"a \"b\" c", d') == ['a "b" c', "d"] and read("2017/10/31") == ["2017/10/31"]
    assert read("[red, 'dark blue', (x; y)] | end") == ["red", "dark blue", "x", "y", "end"]
    assert read('"C:\\", d') == ["C:\\", "d"] and read("rock 'n' roll, b") == ["rock 'n' roll", "b"] and read('"", b') == ["", "b"]
    assert TEXTS.parse('"a" b, c') == [('"a" b', "text after quote"), ("c", None)] and TEXTS.parse('a, "b, c') == [("a", None), ("b", "open quote"), ("c", "open quote")]
    assert TEXTS.parse("x, [a, b") == [("x", None), ("a", "open bracket"), ("b", "open bracket")] and TEXTS.parse("a], b") == [("a]", "stray ]"), ("b", None)]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=8), max_size=6), st.sampled_from(['"', "'"]), st.sampled_from([",", "; ", "|", "\t"]))
@settings(max_examples=150, deadline=None)
def test_quoted_round_trip(texts, q, sep):
    field = sep.join(q + t.replace("\\", "\\\\").replace(q, q + q) + q for t in texts)
    assert TEXTS.parse(field) == [(t, None) for t in texts]


@given(st.lists(st.integers(10**9, 10**10 - 1), max_size=8), st.sampled_from([",", ";", " | ", "\t", "/", ",,"]))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids, sep):
    assert values(sep.join(map(str, ids))) == [str(i) for i in ids]


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "5"), (2, None), (3, " "), (4, "nan"), (5, "7;8,8"), (6, '"9'), (7, "4," * 3000)], "id int, f string").withColumn("value", F.lit(0))
    rows = {(r.id, r.position, r.value, r.error) for r in split_packed(df, "f", ["id"], packed_ids=True).filter("id < 7").collect()}
    assert rows == {(1, 1, "5", None), (5, 1, "7", None), (5, 2, "8", None), (5, 3, "8", None), (6, 1, "9", "open quote")}
    assert split_packed(df, "f", ["id"], packed_ids=True).filter("id = 7").count() == 3000
    assert split_packed(df.filter("id > 99"), "f", ["id"], packed_ids=True).count() == 0


def test_hot_keys_lose_no_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 600, 0).when(F.col("id") == 999, None).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    right = left.filter("k is not null and k <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for hot in (1, 100, 10**9):
        assert lookup_join(left, right, "k", "n", hot_weight=hot).count() == left.filter("k is not null and k <> 3").count()
        assert lookup_join(left, right, "k", "n", "left", hot_weight=hot).count() == 1000


def test_row_numbers_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("o"), "id")
    got = global_row_number(df, ["g"], [F.col("o").asc(), F.col("id").asc()], "rn")
    for g in (0, 1):
        rows = got.filter(F.col("g") == g).orderBy("rn").collect()
        assert [r.rn for r in rows] == list(range(1, len(rows) + 1))
        assert [r.o for r in rows] == sorted(r.o for r in rows)
    assert global_row_number(df.filter("id < 0"), ["g"], [F.col("o").asc()], "rn").count() == 0
