"""Evaluation texts in the corpus, by template windows.

Words are maximal runs of letters and digits in lower case. The fixed words of the
evaluation passages make a vocabulary; in passages and documents alike, every other
word becomes a typed placeholder: a number, a number with a unit, a run of letters and
digits, or a name. Windows of placeholders and fixed words are hash-joined: the few of
the passages with all of the corpus. What meets is then told apart by its slots: with
the same words in all of them the passage leaked as it is, with other words that
replace each other consistently the question was asked again with other parameters.

The windows of the passages are sent to the executors where there are at most
BROADCAST_WINDOWS of them; beyond that the windows of the corpus are shuffled to meet
them. Defined results: null and empty texts and passages match nothing; a passage
shorter than a window can't leak; items with the same passage leak together; rows
delivered twice count once; empty tables give an empty result; further columns are
ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import small_batches

WINDOW = 13
BROADCAST_WINDOWS = 500_000
#: A window of the passages with fewer fixed words is looked up by its very words instead.
FIXED = 4
_WORD = re.compile(r"[^\W_]+")
_UNITS = frozenset("s ms min h gb mb kb k m km cm mm um µm hz khz mhz ghz kg g mg percent pct".split())
NUMBER, UNIT, MIXED, NAME = 1, 2, 3, 4
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def kind(word: str) -> int:
    """The placeholder of a word that is not fixed."""
    if word.isdigit():
        return NUMBER
    if word in _UNITS:
        return UNIT
    return MIXED if any(map(str.isdigit, word)) else NAME


def fixed_words(passages: list[str]) -> dict[str, int]:
    """The words that passages share or write small, numbered: their templates' own words.

    A word with a digit, and one that passages write with a capital inside a sentence, fills a slot."""
    small: Counter = Counter()
    large: Counter = Counter()
    for text in passages:
        for n, m in enumerate(_WORD.finditer(text)):
            word = m[0]
            before = text[: m.start()].rstrip()[-1:]
            inside = n > 0 and before not in ".!?…:;"
            (large if word[:1].isupper() and inside else small)[word.lower()] += 1
    fixed = sorted(w for w in small if not any(map(str.isdigit, w)) and small[w] >= large[w] and w not in _UNITS)
    return {w: 16 + n for n, w in enumerate(fixed)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def coded(found: list[str], fixed: dict[str, int]) -> np.ndarray:
    get = fixed.get
    return np.array([get(w) or kind(w) for w in found], dtype=np.uint64)


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the template of every window."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    mixed = _mixed(codes + np.uint64(1))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        out = out * _B + mixed[k : k + n]
    return _mixed(out).view(np.int64)


class Items:
    """The evaluation items: their windows, by template and by words. items: (item_id, passage)."""

    def __init__(self, items: DataFrame) -> None:
        self.spark = items.sparkSession
        rows = [(r["item_id"], r["passage"]) for r in items.select("item_id", "passage").distinct().collect() if r["passage"] and r["item_id"] is not None]
        self.fixed = fixed_words([p for _, p in rows])
        every = dict.fromkeys(w for _, p in rows for w in words(p))
        self.every = {w: (1 << 40) + n for n, w in enumerate(every)}
        self.windows: list[tuple] = []
        self.bare = False  # whether a window has too few fixed words to go by its template
        for item, passage in rows:
            found = words(passage)
            codes = coded(found, self.fixed)
            whole = tuple(codes.tolist())
            exact = window_hashes(coded(found, self.every)).tolist()
            for at, template in enumerate(window_hashes(codes).tolist()):
                told = int((codes[at : at + WINDOW] >= 16).sum()) >= FIXED
                self.bare |= not told
                self.windows.append((template if told else exact[at], item, at, " ".join(found[at : at + WINDOW]), whole, told))

    def frame(self) -> DataFrame:
        """(template, item_id, item_at, window)"""
        return self.spark.createDataFrame([w[:4] for w in self.windows], "template long, item_id long, item_at int, window string")

    def classes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The items by their whole template, told by the first item that has it.

        (template, class_id, item_at, exact): its template windows, with the words of all items; (class_id, item_at, item_id, i): the words of every
        item of a class; (template, item_id, item_at): the windows that go by their words."""
        first: dict[tuple, int] = {}
        exact: dict[int, set[str]] = {}
        each: dict[tuple, set[tuple]] = {}
        for template, item, at, window, whole, told in self.windows:
            first[whole] = min(first.get(whole, item), item)
            each.setdefault((whole, item), set()).update(enumerate(window.split(" "), at))
            if told:
                exact.setdefault(template, set()).add(window)
        shared = {(t, first[whole], at) for t, _, at, _, whole, told in self.windows if told}
        frame = self.spark.createDataFrame
        return (
            frame([(*x, sorted(exact[x[0]])) for x in shared], "template long, class_id long, item_at int, exact array<string>"),
            frame([(first[whole], at, item, word) for (whole, item), places in each.items() for at, word in places], "class_id long, item_at int, item_id long, i string"),
            frame([w[:3] for w in self.windows if not w[5]], "template long, item_id long, item_at int"),
        )


def _matches(fixed: dict[str, int], every: dict[str, int] | None, known: np.ndarray | None):
    """Windows of documents by template; only those in known, if it is given."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, at, prints, texts = [], [], [], []
            for key, text in zip(batch["doc_id"], batch["text"]):
                if not text or key is None:
                    continue
                found = words(text)
                if len(found) < WINDOW:
                    continue
                for names in (fixed, every):
                    if names is None:
                        continue
                    hashes = window_hashes(coded(found, names))
                    if known is None:
                        hits = np.arange(len(hashes))
                    else:
                        places = np.searchsorted(known, hashes)
                        places[places == len(known)] = 0
                        hits = np.flatnonzero(known[places] == hashes)
                    keys += [key] * len(hits)
                    at += hits.tolist()
                    prints += hashes[hits].tolist()
                    texts += [" ".join(found[i : i + WINDOW]) for i in hits]
            yield pd.DataFrame({"doc_id": pd.Series(keys, dtype="int64"), "doc_at": pd.Series(at, dtype="int32"), "template": pd.Series(prints, dtype="int64"), "doc_window": pd.Series(texts, dtype="object")})

    return work


def template_hits(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, doc_at, template, doc_window): windows of documents with the template of a passage."""
    small_batches(documents.sparkSession)
    few = len(items.windows) <= BROADCAST_WINDOWS
    known = np.unique(np.array([w[0] for w in items.windows], dtype=np.int64)) if few else None
    if few and not len(known):
        known = np.zeros(1, dtype=np.int64)
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return found.mapInPandas(_matches(items.fixed, items.every if items.bare else None, known), "doc_id long, doc_at int, template long, doc_window string")


def _bounded(items: Items, side: DataFrame) -> DataFrame:
    return F.broadcast(side) if len(items.windows) <= BROADCAST_WINDOWS else side


def leaks(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id): documents with a window whose slots hold the very words of the passage."""
    met = template_hits(documents, items).join(_bounded(items, items.frame()), "template")
    return met.where("doc_window = window").select("doc_id", "item_id").distinct()


def asked_again(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, words, changed): questions that no item asks, with other words in some slots of an item, consistently.

    Windows of one alignment count together; every item whose template is met is told, also where several have the same."""
    hits = template_hits(documents, items)
    shared, spoken, bare = (_bounded(items, side) for side in items.classes())
    shift = (F.col("doc_at") - F.col("item_at")).alias("shift")
    rows = hits.join(shared, "template").select("doc_id", "class_id", shift, "item_at", "doc_window", F.array_contains("exact", F.col("doc_window")).alias("leaked"))
    alike = ["doc_id", "class_id", "shift"]
    new = rows.join(rows.where("leaked").select(*alike).distinct(), alike, "left_anti")
    filled_in = new.select(*alike, "item_at", F.posexplode(F.split("doc_window", " ")).alias("k", "d")).select(*alike, (F.col("item_at") + F.col("k")).alias("item_at"), "d").distinct()
    key = ["doc_id", "item_id", "shift"]
    slots = filled_in.join(spoken, ["class_id", "item_at"])
    if items.bare:
        slots = slots.join(hits.join(bare, "template").select("doc_id", "item_id", shift).distinct(), key, "left_anti")
    filled = slots.groupBy(*key, "i").agg(F.count_distinct("d").alias("fillings"), F.count("*").alias("n"), F.max((F.col("d") != F.col("i")).cast("int")).alias("changed"))
    judged = filled.groupBy(*key).agg(F.sum("n").cast("int").alias("words"), F.sum("changed").cast("int").alias("changed"), F.max("fillings").alias("fillings"))
    return judged.where("fillings = 1 AND changed > 0").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("changed").alias("changed"))
