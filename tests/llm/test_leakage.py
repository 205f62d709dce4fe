import pytest

from auditloom.llm import leakage as L

ITEMS = [
    (1, "Given a budget of 427 hours on Lumen-16G and a target of 1.66, decide whether Velgar-26 or Pexpole-47 should be rerun by the committee on Corpa45?"),
    (2, "Given a budget of 99 hours on Norda-2 and a target of 3.25, decide whether Torl-1 or Hulm-2 should be rerun by the committee on Geo3?"),
    (3, "Explain to a new editor why the note attached to r6c4db by Hulgar neither proves nor refutes the bound of 0.8?"),
    (4, "too short to leak"), (5, None), (6, ""), (7, "Explain to a new editor why the note attached to r6c4db by Hulgar neither proves nor refutes the bound of 0.8?"),
    (8, "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi"),
]
P1 = ITEMS[0][1]
DOCS = {
    1: "before. " + P1 + " after", 2: "x " + " ".join(P1.split()[3:18]).upper().replace(" ", " -- ") + " y", 3: " ".join(P1.split()[:8]), 4: None, 5: "",
    6: "Given a budget of 555 hours on Kestal-7 and a target of 9.5, decide whether Ibb-3 or Ost-4 should be rerun by the committee on Lexi7?",
    7: ITEMS[2][1].replace(" ", "\n"), 8: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", 9: "to a new editor why the note attached to r6c4db by",
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(k, t, "clash") for k, t in DOCS.items()] + [(1, DOCS[1], ""), (None, P1, "")]
    return spark.createDataFrame(docs, "doc_id long, text string, template string"), L.Items(spark.createDataFrame([(i, p, "s") for i, p in ITEMS], "item_id long, passage string, suite string"))


def brute():
    out = set()
    for d, text in DOCS.items():
        w = L.words(text or "")
        windows = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for item, passage in ITEMS:
            q = L.words(passage or "")
            if any(tuple(q[i : i + 13]) in windows for i in range(len(q) - 12)):
                out.add((d, item))
    return out


def test_leaks_against_brute_force(tables):
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(*tables).collect()} == brute()


def test_beyond_the_broadcast(tables, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_WINDOWS", 0)
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(*tables).collect()} == brute()


def test_asked_again(tables):
    rows = {r["doc_id"]: r for r in L.asked_again(*tables).collect()}
    assert set(rows) == {6} and rows[6]["item_id"] == 1 and rows[6]["changed"] >= 6


def test_asked_again_of_every_item_with_the_template(spark):
    asked = "Given a budget of {} hours on Lumen-16G and a target of {}, decide whether Velgar-26 or {} should be rerun by the committee on Corpa45?"
    items = L.Items(spark.createDataFrame([(4, asked.format(427, 1.66, "Pexpole-47")), (2, asked.format(99, 3.25, "Hulm-28")), (9, asked.format(99, 3.25, "Hulm-28")), (7, None)], "item_id long, passage string"))
    docs = spark.createDataFrame([(1, "so: " + asked.format(555, 9.5, "Ost-41")), (2, asked.format(427, 1.66, "Pexpole-47"))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["words"], r["changed"]) for r in L.asked_again(docs, items).collect()}
    assert got == {(1, n, 30, 5) for n in (2, 4, 9)}


def test_empty(spark, tables):
    none = L.Items(spark.createDataFrame([], "item_id long, passage string"))
    assert L.leaks(tables[0], none).count() == 0
    assert L.leaks(spark.createDataFrame([], "doc_id long, text string"), tables[1]).count() == 0
