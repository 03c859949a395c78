import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X


def value(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "expected"), [
    ("The rain in spain stays mainly in the plain.", "the rain in spain stays mainly in the plain"),
    ("\n  Fly me to the moon! Let me play among the stars.\n  In other words, hold my hand.\n", "fly me to the moon let me play among the stars in other words hold my hand"),
    ("Saint-Michel e-mail", "saint michel e mail"),
    ("can't 3.14 1,000 a1 a_b __ foo.bar", "can't 3.14 1,000 a1 a_b foo.bar"),
    ("Élan ÉTÉ ΟΔΟΣ", "élan été οδος"),
    ("", ""),
    ("... -- !", ""),
    ("東京タワー and カタカナ", "東 京 タワー and カタカナ"),
    ("ひらaがな 한국어 x", "ひ ら a が な 한국어 x"),
    ("ไทย ก็ดี", "ไ ท ย ก็ ดี"),
    ("漢字3年", "漢 字 3 年"),
])
def test_terms(spark, text, expected):
    assert value(spark, X.terms, text) == expected.split()


def test_jvm_pattern_equals_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pattern = X.WORD
    for script in X._ALONE:  # the JVM's names of scripts
        pattern = pattern.replace(f"\\p{{{script}}}", f"\\p{{Is{script}}}")
    plain = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    odd = spark.createDataFrame([("東京タワー and ไทยก็ดี", ), ("a·b 漢字3年 ひら’が e\u0301t\u00e9 _x1_",)], "text string")
    docs = docs.select("text").unionByName(odd)
    assert docs.where(~X.words(F.col("text")).eqNullSafe(plain)).count() == 0


def test_words_and_gaps_rebuild_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for text, words, gaps in docs.select("text", X.words(F.col("text")), X.gaps(F.col("text"))).collect():
        assert "".join(g + w for g, w in zip(gaps, [*words, ""])) == text


@pytest.mark.parametrize(("term", "expected"), [("", []), ("a", ["$a$"]), ("é", ["$é$"]), ("ab", ["$ab", "ab$"]), ("cliff", ["$cl", "cli", "lif", "iff", "ff$"]), ("aaaa", ["$aa", "aaa", "aaa", "aa$"])])
def test_trigrams(spark, term, expected):
    assert value(spark, X.trigrams, term) == expected


@pytest.mark.parametrize(("term", "code"), [("hermann", "h655"), ("cliff", "c410"), ("stephanie", "s315"), ("", ""), ("a", "a"), ("ab", "a100"), ("a12", "a000"), ("pfister", "p123"), ("ashcraft", "a226")])
def test_soundex(spark, term, code):
    assert value(spark, X.soundex, term) == code


@pytest.mark.parametrize(("a", "b", "dist"), [("hello", "hello", 0), ("he", "hello", 3), ("hello", "world", 4), ("carrot", "riot", 3), ("foo", "bar", 3), ("été", "ete", 2), ("", "ab", 2)])
def test_edit_distance(spark, a, b, dist):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(X.edit_distance(F.col("a"), F.col("b")), X.edit_distance(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (dist, dist)


def test_field_text(spark):
    kind = "name string, location struct<zip_code:string,city:string,state:string>, bios array<string>, extra map<string,array<string>>, n int, odd struct<n:int,s:string>"
    rows = [("Jane A. Smith", ("94123", "San Francisco", "CA"), ["Jane serves.", None, "She composes."], {"b": ["2"], "a": ["1", " x "]}, 7, (1, "s")), (None,) * 6]
    docs = spark.createDataFrame(rows, kind)
    fields = ["name", "location", "bios", "extra", "n", "odd", "missing"]
    first, second = docs.select(*(X.field_text(docs, f).alias(f) for f in fields)).collect()
    assert list(first) == ["Jane A. Smith", "San Francisco CA 94123", "Jane serves. She composes.", "1  x  2", "", "s", ""]
    assert list(second) == [""] * 7


def test_json_field_text(spark):
    docs = ['{"bio": {"title": "Jane", "text": ["The", {"z": "end", "a": "great"}, 5, null, true]}}', '{"bio": ""}', "[1]", "broken{", None, '{"other": "x"}']
    rows = spark.createDataFrame([(d,) for d in docs], "doc string").select(X.json_field_text(F.col("doc"), "bio")).collect()
    assert [r[0] for r in rows] == ["The great end Jane", "", "", "", "", ""]


def test_latin_words_equal_those_of_any_script(spark):
    """All letters of Latin-1 and marks beside letters, digits and joiners, and mixtures of them."""
    letters = [chr(c) for c in (*range(256), *range(0x2010, 0x2028), 0x20AC)]
    texts = [a + c + b for c in letters for a, b in (("", ""), ("a", "b"), ("1", "2"), ("_", "x"), ("A", ""), ("", "1"))]
    rng = random.Random(4)
    texts += ["".join(rng.choice("aB é.'’:·_1,;²\xad½ªß-ÀÿZz’“…—7") for _ in range(40)) for _ in range(1000)]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    known = F.regexp_extract_all(t, F.lit(X.JVM_WORD), F.lit(0))
    same = t.rlike(X._J_LATIN) & X.words(t).eqNullSafe(known) & X.terms(t).eqNullSafe(F.transform(known, F.lower)) & X.gaps(t).eqNullSafe(F.split(t, X.JVM_WORD, -1))
    assert rows.where(~same).isEmpty() and not value(spark, lambda c: c.rlike(X._J_LATIN), "ΑΣ. Β")
    assert value(spark, X.terms, "ΑΣ^Β İx") == ["ας", "β", "i̇x"]
