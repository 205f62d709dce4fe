import random

import pytest

from auditloom.llm import scanned as S

WORDS = "trial panel accuracy reviewer decoder steps after points needs second training graine confirmation ledger budget public candidate derive noisy empty batch digits spelling future sensor width lower claims matches table twice every".split()
CLEAN = " ".join(WORDS)


def noisy_corpus(seed=3):
    """Clean texts, and a scanned record with known noise."""
    rng = random.Random(seed)
    clean = [" ".join(rng.choice(WORDS) for _ in range(200)) + " a warm-up and a held-out set." for _ in range(40)]
    pages, truth = [], []
    line_no = 0

    def put(text, *kinds):
        nonlocal line_no
        for part in text.split("\n"):
            line_no += 1
            pages.append(part)
        truth.extend((line_no, k) for k in kinds)

    for page in range(1, 5):
        put(" ".join(rng.choice(WORDS) for _ in range(8)))
        put("every p@nel " + rng.choice(["needs", "claims"]) + " a poirits of steps", "misread") if page < 3 else put("the seconcl trlal matches", "misread")
        put("the public recon-" if page == 9 else "the public candi-", "hyphen")
        put("date of the table with a warm-")
        put("up of points in a con¬" if page % 2 else "up of points in a confir\u00ad", "hyphen")
        put("")
        put("Short rep0rt Lumen-7" if page == 2 else "Short report Lumen-7", "running")
        put("")
        put(f"- {page} -" if page % 2 else f"Page {page} of 4", "folio")
        put("")
        put("firmation of steps." if page % 2 else "mation of steps.")
        put("")
        put("(3)")
        put("")
    return clean, "\n".join(pages), set(truth)


@pytest.fixture(scope="module")
def repair(spark):
    clean, text, truth = noisy_corpus()
    scanned = spark.createDataFrame([("markdown", 1, text, "x"), ("markdown", 1, text, "x"), ("markdown", 2, None, "x"), ("markdown", 3, "", "x")], "field_name string, record_id long, text string, kind string")
    return S.Repair(scanned, spark.createDataFrame([(c,) for c in clean] + [(None,)], "text string")), truth


def test_findings(repair):
    own, truth = repair
    got = {(r["line_no"], r["kind"]) for r in own.findings().collect()}
    known = {t for t in truth if t[1] != "misread"}
    assert {g for g in got if g[1] != "misread"} == known
    assert {t for t in truth if t[1] == "misread"} <= got


def test_paragraphs(repair):
    rows = [r["paragraph"] for r in repair[0].paragraphs().orderBy("paragraph_no").collect()]
    text = " ".join(rows)
    assert "public candidate of" in text and "a warm-up of points in a confirmation of steps." in text
    assert "report" not in text and "panel" in text and "p@nel" not in text and "Page" not in text


def test_held_out_accuracy():
    """Words that the model hasn't seen corrupted in the same way."""
    lexicon = [(w, 50 + n, 0) for n, w in enumerate(WORDS)] + [("warm-up", 9, 0)]
    counts = {w: (a, b) for w, a, b in lexicon}
    weights = S.trained(lexicon, seed=1)
    rng = random.Random(99)
    right = total = 0
    for _ in range(400):
        word = rng.choice(WORDS)
        noise = S._corrupted(word, rng) if rng.random() < 0.7 else (word, {})
        if noise is None or (noise[1] and noise[0] in counts):
            continue
        support: dict = {}
        for used, meant in S.corrections(noise[0]):
            for a in used:
                support[a] = max(support.get(a, 0), counts.get(meant, (0, 0))[0])
        fixed, _ = S.edit(weights, noise[0], *counts.get(noise[0], (0, 0)), support)
        right += fixed == word
        total += 1
    assert right / total > 0.95


def test_folios_and_shapes():
    for line in ("1", "- 7 -", "[149]", "3 / 3", "Page 1 of 6", "vi", "P@ge 2 of 9"):
        assert S.furniture(["x", "", line, ""], set()).get(2) == "folio", line
    for line in ("(3)", "3.", "1. item", "mixed", "- item"):
        assert 2 not in S.furniture(["x", "", line, ""], set()), line
    assert S.shape("2  Rerun rep0rt Zan-69") == S.shape("Short report Lum-1  17")


def test_empty(spark):
    none = spark.createDataFrame([], "field_name string, record_id long, text string")
    own = S.Repair(none, spark.createDataFrame([], "text string"))
    assert own.findings().count() == 0 and own.paragraphs().count() == 0


def test_lines_at_the_edge_of_a_page():
    title = "Proceedings of the Workshop on Gates"
    page = lambda n: [title, f"the text goes on here in line {n}", "and goes on in another line"] + [f"line {k} of it" for k in range(6)] + ["last words", "", str(n), ""]
    lines = sum((page(n) for n in range(1, 4)), [])
    common = {S.shape(title)}
    found = S.furniture(lines, common)
    assert {k for k, kind in found.items() if kind == "running"} == {k for k, line in enumerate(lines) if line == title}
    inside = page(1)[:5] + [title] + page(1)[5:]
    assert 5 not in S.furniture(inside, common)  # the same words in the middle of a page are text
    fed = ["first page", "words", title + " of the long name and the further long name that goes on and on for more than a hundred and twenty characters", "\fnext page", "words"]
    assert S.furniture(fed, {S.shape(fed[2])})[2] == "running"


def test_identifiers_of_any_kind():
    assert all(map(S.is_identifier, ["r12ca6", "rabcd1", "0a043987231f", "A4", "v2", "x86", "run7"])) and not any(map(S.is_identifier, ["rep0rt", "c00kies", "5eed", "word", "tra1ning"]))


def test_results_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    clean = spark.createDataFrame([("the models learn gates and the gates learn models of institution and mainline " * 4,)], "text string")
    text = "the models learn insti\ntution and main\nline of gates and the\ngates learn models of main-\nline and a" + "verylongword" * 12 + "\nends here"
    pages = spark.createDataFrame([("markdown", 1, text)], "field_name string, record_id long, text string")
    wide = {tuple(r) for r in S.Repair(pages, clean).findings().collect()}
    monkeypatch.setattr(S, "SKIP", 1)
    monkeypatch.setattr(S, "BITS", 1 << 13)
    assert {tuple(r) for r in S.Repair(pages, clean).findings().collect()} == wide and ("markdown", 1, 1, "hyphen") in wide
