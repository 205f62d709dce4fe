import pytest

from auditloom.llm import queries
from auditloom.llm import sentences as S

CASES = {
    "abbreviations": ("Dr. Ada and Mr. Bo saw Fig. 3, cf. [1]. They ran e.g. No. 5 at 3 a.m. on it, etc. We stop.", ["Dr. Ada and Mr. Bo saw Fig. 3, cf. [1].", "They ran e.g. No. 5 at 3 a.m. on it, etc.", "We stop."]),
    "initials and decimals": ("K. Lund got 3.5 at https://a.b/c.html today. U.S. spelling is kept.", ["K. Lund got 3.5 at https://a.b/c.html today.", "U.S. spelling is kept."]),
    "quotation goes on": ('The note reads "No gain. Stop it." and ends. "All is real." Next one?', ['The note reads "No gain. Stop it." and ends.', '"All is real."', "Next one?"]),
    "german": ("Der 4. Versuch, z. B. mit 3 Läufen, d. h. kurz, endet „Nein. Stopp.“ neben dem Lauf. Es gab 4. Mehr nicht!", ["Der 4. Versuch, z. B. mit 3 Läufen, d. h. kurz, endet „Nein. Stopp.“ neben dem Lauf.", "Es gab 4.", "Mehr nicht!"]),
    "french": ("Quel écart : 3 contre 4 ! Le registre note « Aucun gain. À rejeter. » pour lui. Fin.", ["Quel écart : 3 contre 4 !", "Le registre note « Aucun gain. À rejeter. » pour lui.", "Fin."]),
    "russian": ("Мы меняли всё и т. д. Модель снижает, т. е. на 2 пункта. См. рис. 5.", ["Мы меняли всё и т. д.", "Модель снижает, т. е. на 2 пункта.", "См. рис. 5."]),
    "chinese": ("“够了吗？”他问道。崩溃了……但保留！为什么？", ["“够了吗？”他问道。", "崩溃了……但保留！", "为什么？"]),
    "japanese": ("主張（[a]を参照。）は未確認。「改善なし。破棄する。」と書かれた。", ["主張（[a]を参照。）は未確認。", "「改善なし。破棄する。」と書かれた。"]),
    "hindi": ("डॉ. राम आए। “क्या यह है?” उसने पूछा। हाँ!", ["डॉ. राम आए।", "“क्या यह है?” उसने पूछा।", "हाँ!"]),
    "arabic": ("هل تكفي؟ كتب «لا. يرفض.» هنا. انتهى.", ["هل تكفي؟", "كتب «لا. يرفض.» هنا.", "انتهى."]),
    "thai": ("เราตัด Jor-93 ออกจากการ ตารางที่ 7 แสดงค่า", ["เราตัด Jor-93 ออกจากการ", "ตารางที่ 7 แสดงค่า"]),
    "blocks": ("# Head. No.\n\nOne\nline. Two\n- [x] item one. item\n2. Second item\n| a. | b. |\n```\ncode. Code.\n```\nlast", ["One\nline.", "Two", "item one. item", "Second item", "last"]),
    "metric begins": ("It ended at 3. val_bpb fell to 2.1... top1 rose.", ["It ended at 3.", "val_bpb fell to 2.1...", "top1 rose."]),
    "looks": ("Ｄｒ. Ada saw F\u200big. 3. Dг. Bo left.", ["Ｄｒ. Ada saw F\u200big. 3.", "Dг.", "Bo left."]),
    "unclosed": ('He said "wait. Then he left. (So. It was', ['He said "wait.', "Then he left.", "(So.", "It was"]),
    "space": ("  \n\u00a0 One. \u2009 Two.\u00a0\n", ["One.", "Two."]),
    "private use": ("A \ue010 b. C \ue000 d.", ["A \ue010 b.", "C \ue000 d."]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, t, 7, "clash") for n, (t, _) in CASES.items()] + [("null", None, 7, ""), ("empty", "", 7, ""), ("blocks", CASES["blocks"][0], 7, "")]
    out: dict = {}
    for r in S.sentences(spark.createDataFrame(rows, "k string, text string, row int, sentence string"), "k", "text").collect():
        out.setdefault(r["k"], []).append((r["sent_start"], r["sent_end"], r["sentence"]))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_cases(found, name):
    text, want = CASES[name]
    assert [text[a:b] for a, b, _ in sorted(found[name])] == want


def test_restored_text_is_the_original(found):
    for name, rows in found.items():
        if name != "private use":
            assert all(CASES[name][0][a:b].replace("\n", " ") == s.replace("\n", " ") for a, b, s in rows)


def test_nulls_and_empty(spark, found):
    assert "null" not in found and "empty" not in found
    assert S.sentences(spark.createDataFrame([], "k string, text string"), "k", "text").count() == 0


def test_all_papers_have_sentences(spark, tmp_path):
    rows = [(1, "text/markdown", "One. Two."), (2, "application/pdf", "Three. Four."), (3, None, "Five.")]
    spark.createDataFrame(rows, "paper_id long, media_type string, analysis_text string").write.parquet(str(tmp_path / "prepared_papers.parquet"))
    assert sorted((r["paper_id"], r["sentence"]) for r in queries.p3_sentences(spark, str(tmp_path)).collect()) == [(1, "One."), (1, "Two."), (2, "Four."), (2, "Three."), (3, "Five.")]
    assert {r["paper_id"] for r in queries.p3_found(spark, str(tmp_path)).collect()} == {1}


def test_long(spark):
    text = ("A line of words that goes on\n" * 3 + "and ends. ") * 20_000
    assert S.sentences(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text").count() == 20_000


def test_marks_in_addresses_and_decimals(spark):
    texts = {
        "siehe http://a.de/?中文 hier. Und dann.": ["siehe http://a.de/?中文 hier.", "Und dann."],
        "见http://a.cn/?页=中文x 一句。下一句。": ["见http://a.cn/?页=中文x 一句。", "下一句。"],
        "见http://a.cn/x。下一句。": ["见http://a.cn/x。", "下一句。"],
        "Go to www.a.org/b!c?d. Then stop at 3.5.": ["Go to www.a.org/b!c?d.", "Then stop at 3.5."],
        "It is 0.5. Next.": ["It is 0.5.", "Next."],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "paper_id int, analysis_text string")
    got: dict = {}
    for r in S.sentences(rows, "paper_id", "analysis_text").orderBy("paper_id", "sent_start").collect():
        got.setdefault(r["paper_id"], []).append(r["sentence"])
    assert [got[n] for n in range(len(texts))] == list(texts.values())
