import unicodedata

from pyspark.sql import functions as F

from auditloom.llm import lookalikes as L

SCHEMA = "paper_id long, raw_text string, analysis_text string, at int, text string, look string"


def same(spark, *texts):
    """Which texts come out equal, as a list of class numbers."""
    rows = [(n, t, t, 0, "clash", "clash") for n, t in enumerate(texts)]
    got = {r["paper_id"]: r["text"] for r in L.consistent_texts(spark.createDataFrame(rows, SCHEMA), "paper_id", ["raw_text", "analysis_text"]).where("field_name = 'raw_text'").collect()}
    seen: dict = {}
    return [seen.setdefault(got[n], len(seen)) for n in range(len(texts))]


def test_widths_accents_spaces_and_invisible_characters():
    assert L.one_width("Ｆｕｌｌ\u3000ｗｉｄｔｈ") == "Full width"
    assert L.one_width("cafe\u0301 Å K ﬁne") == "café Å K fine"
    assert L.one_width("a\u200bb\u00adc\u2060d\ufeff e\u00a0f\u2009g") == "abcd e f g"
    assert L.one_width("10² 10① 10³") == "10² 10① 10³"
    assert L.one_width("ｶﾞ") == "ガ" and L.one_width("ำ") == L.one_width("\u0e4dา")
    assert L.one_width("") == ""


def test_scripts_and_forms():
    assert L.document_script("Модель x") == "cyrillic" and L.document_script("the модель of trial kept first") == "latin" and L.document_script("表1") == "latin"
    assert L.forms("trіаls", "latin")[0] == "trials"
    assert L.forms("модeль", "latin")[0] == "модель"
    assert L.suspects("plain text", "latin") == [] and L.suspects("a trіal", "latin") == ["trіal"]


def test_mixed_tokens_follow_their_own_letters(spark):
    assert same(spark, "the trials ended", "the trіаls ended", "thе trials ended", "the trial ended", "THE trials ended") == [0, 0, 0, 1, 2]
    assert same(spark, "Модель снижает", "Mодель снижaет", "Модель снижает!") == [0, 0, 1]


def test_whole_words_of_twins_go_by_text_and_vocabulary(spark):
    assert same(spark, "we see a cope here", "we ѕее а соре here", "мы see а cope тут") == [0, 0, 1]
    assert same(spark, "run rа1с2e done", "run ra1c2е done") == [0, 0]


def test_what_the_eye_tells_apart(spark):
    assert same(spark, "10 cells", "10² cells", "102 cells", "é", "e", "10① cells") == [0, 1, 2, 3, 4, 5]


def test_pairs_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b", None, 0, "", ""), (2, "a\u00a0b", "", 0, "", ""), (2, "a\u00a0b", "", 0, "", ""), (3, "a b", "x", 0, "", ""), (None, None, None, 0, "", "")]
    looks = L.same_look(spark.createDataFrame(rows, SCHEMA), "paper_id", ["raw_text", "analysis_text"])
    got = {(r["field_name"], r["paper_id"]) for r in looks.collect()}
    assert got == {("raw_text", 1), ("raw_text", 2), ("raw_text", 3), ("analysis_text", 2), ("analysis_text", 3)}
    assert looks.where("field_name = 'raw_text'").select("look").distinct().count() == 1
    assert L.same_look(spark.createDataFrame([], SCHEMA), "paper_id", ["raw_text", "analysis_text"]).count() == 0


def test_long_text(spark):
    text = "ｗｉｄｅ trіal " * 20_000
    row = L.consistent_texts(spark.createDataFrame([(1, text, text, 0, "", "")], SCHEMA), "paper_id", ["raw_text", "analysis_text"]).first()
    assert row["text"] == "wide trial " * 20_000 and unicodedata.is_normalized("NFC", row["text"])
    assert isinstance(F.lit(1), object)


def test_pairs_of_looks_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [("f", n, f"s{rng.randrange(6)}", f"l{rng.randrange(3)}") for n in range(60)]
    looks = spark.createDataFrame(rows, "field_name string, paper_id long, stored string, look string")
    want = {(f, a, b) for f, a, s, look in rows for _, b, s2, look2 in rows if a < b and look == look2 and s != s2}
    got = [tuple(r) for r in L.look_pairs(looks, "paper_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {(r["paper_id"], r["texts"], r["stored_texts"]) for r in L.look_classes(looks).collect()}
    assert classes == {(n, sum(x[3] == look for x in rows), len({x[2] for x in rows if x[3] == look})) for _, n, _, look in rows}
