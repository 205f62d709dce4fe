"""Noise in text from scanned pages: furniture, broken words, misread characters.

An averaged perceptron edits characters: at each place of a word it keeps, replaces,
deletes or inserts, at each line break it keeps or joins. It is trained here on words
of born-digital text, corrupted with the usual confusions of character recognition,
and sees the neighbouring characters and how often the word and its corrections occur
in the whole corpus. Words are edited once per type, by joins with the counts of all
words, and line breaks once per type of (left part, mark, right part).

Furniture is found by place and wording. Pages end at form feeds and at lines with a page
number (folio). Lines that stand alone between blank lines, and the EDGE outermost lines of
a page even where they touch the text, are running lines if they lack a closing mark and
their wording recurs in the record (lines that stand alone) or, with names and numbers
taken out, in many records at such places.

Training sample: the LEXICON most frequent words and TRAINING examples at most, with a
fixed seed. The SKIP most frequent correct words and a filter of BITS bits over all words
are broadcast to save work; both are bounded by these parameters and decide nothing: a line
break without a mark is kept where both parts are trusted words and the whole is none,
which counts decide in a shuffled join wherever the two can't rule it out.

Defined results: null and empty texts have no noise; a record delivered twice counts
once; an empty table gives an empty result; further columns are ignored; texts of any
length are read whole; ties between corrections go to the more frequent word, then to
the first in alphabetical order.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log2
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.frames import batch as as_batch
from auditloom.llm.lookalikes import one_width
from auditloom.session import checkpoint_dir, small_batches

LEXICON, TRAINING, SKIP = 20_000, 8_000, 50_000
#: Bits of the filter over the words of the corpus, in rows of ROW bits; lines at either edge of a page.
BITS, ROW, EDGE = 1 << 23, 1 << 13, 2
#: A word of letters that clean text holds so often is right.
TRUSTED = 3
#: A wording must recur in this share of the records to be furniture where it stands once in its own.
SHARE = 0.01
#: Observed characters and what they stand for, fixed values of character recognition.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("@", "a"), ("f", "t"), ("c", "e"), ("b", "h"), ("l", "i"), ("i", "l"), ("h", "li"), ("ri", "n"), ("rn", "m"),
    ("ii", "u"), ("cl", "d"), ("vv", "w"), ("|", "l"), ("8", "B"), ("6", "b"), ("9", "g"), ("0", "O"), ("5", "S"), ("I", "l"), ("e", "c"), ("t", "f"), ("h", "b"), ("m", "rn"), ("n", "ri"), ("d", "cl"),
)
_TOKEN = re.compile(r"[\w@]+(?:\|(?=[a-z])[\w@]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_PLAIN = re.compile(r"[\d@]+")
#: A name of letters and digits: digits that stand for no letter, half of it digits, or hexadecimal digits behind a letter.
_MIXED = re.compile(r"(?=\w*\d)(?=\w*[^\W\d_])\w+")
_HEX = re.compile(r"[^\W\d_]?[0-9a-f]{5,}")
_AT = re.compile(r"^[^\W\d_]+@[^\W\d_]+$|^@[^\W\d_]{2,}$|^[^\W\d_]{2,}@$")
_MARKS = "-‐\u00ad¬"
_LEFT = re.compile(rf"([\w@]+)([{_MARKS}]?)\s*$")
_RIGHT = re.compile(r"\s*([\w@]+)")
_CLOSED = re.compile(r"[.!?。！？…:;,।][\"”’»'“」)\]]*$")
_FOLIO = re.compile(
    r"(?i)[\[\-–—\s~*.]*(?:(?:[p\W][a@][gq][ec]|p|pp|s|seite|página|page|стр|第)\.?\s*)?\d{1,5}(?:\s*(?:/|of|0f|von|de|sur|из)\s*\d{1,5})?[\]\-–—\s~*页頁]*"
    r"|[\[\-\s]*(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})[\]\-\s]*"
)
_NUMBERED = re.compile(r"^\s*\d{1,5}\s{2,}|\s{2,}\d{1,5}\s*$")
_SKIPPED = ("#", "|", "```")


def is_identifier(token: str) -> bool:
    """Whether a token of letters and digits is a name and no misread word."""
    digits = sum(map(str.isdigit, token))
    return digits > 0 and (any(d in token for d in "2347") or 2 * digits >= len(token) or bool(_HEX.fullmatch(token)))


def words_of(line: str) -> list[str]:
    """Words of a line that may be misread; numbers, identifiers and names with underscores are none."""
    return [w for w in _TOKEN.findall(line) if "_" not in w and not _PLAIN.fullmatch(w) and not is_identifier(w)]


# furniture


def shape(line: str) -> str:
    """The wording of a line without numbers and names, in a spelling that misreadings don't change."""
    text = _NUMBERED.sub("", line.strip())
    text = re.sub(r"\b\w+\b", lambda m: "R" if _MIXED.fullmatch(m[0]) and is_identifier(m[0]) else m[0], text)
    text = re.sub(r"\b[^\W\d_][\w@]*-\d+\b", "N", text)
    text = re.sub(r"\b\d+\b", "#", text)
    text = re.sub(r"\b[A-ZÀ-Þ][a-zß-ſ@0-9]+\b", "N", text)
    return spelled(text)


def spelled(text: str) -> str:
    out = text.lower().translate(str.maketrans("1l|!0@5fcvw", "iiiioasteuu"))
    for a, b in (("m", "rn"), ("n", "ri"), ("d", "ei"), ("uu", "u"), ("u", "ii"), ("h", "ii"), ("b", "ii")):
        out = out.replace(a, b)
    return out


def _no_furniture(text: str) -> bool:
    """Headings, tables, fences, numbers of equations and list items."""
    return text.startswith(_SKIPPED) or bool(re.fullmatch(r"\(\d+(?:\.\d+)?[a-z]?\)", text)) or bool(re.match(r"[-*+]\s|\d+\.\s", text)) and not _FOLIO.fullmatch(text)


def _is_folio(text: str) -> bool:
    return bool(_FOLIO.fullmatch(text)) and not text.endswith(".")


def standing_alone(lines: list[str]) -> list[int]:
    """Lines between blank lines that may be furniture."""
    last = len(lines) - 1
    blank = [not line.strip() for line in lines]
    return [k for k, line in enumerate(lines) if not blank[k] and (k == 0 or blank[k - 1]) and (k == last or blank[k + 1]) and not _no_furniture(line.strip())]


def page_edges(lines: list[str], alone: list[int]) -> list[int]:
    """The first and last EDGE lines of each page that touch the text and may be furniture. A page ends at a form feed or at a
    folio that stands alone; a record without either is one page, whose edges tell nothing."""
    folios = {k for k in alone if _is_folio(lines[k].strip())}
    filled = [k for k, line in enumerate(lines) if line.strip()]
    cuts = [n for n, k in enumerate(filled) if k in folios or "\f" in lines[k]]
    if not cuts:
        return []
    near = {filled[m] for n in cuts for m in range(max(0, n - EDGE), min(len(filled), n + EDGE + 1))}
    near |= set(filled[:EDGE]) | set(filled[-EDGE:])
    return sorted(k for k in near - set(alone) if not _no_furniture(lines[k].strip()))


def furniture(lines: list[str], common: set[str]) -> dict[int, str]:
    """folio or running, by line."""
    kinds: dict[int, str] = {}
    keys: dict[int, str] = {}
    alone = standing_alone(lines)
    for k in alone:
        text = lines[k].strip()
        if _is_folio(text):
            kinds[k] = "folio"
        elif not _CLOSED.search(text) and len(set(text.lower().split())) > 0.25 * len(text.split()):
            keys[k] = spelled(re.sub(r"\s+", " ", _NUMBERED.sub("", text)))
    times = Counter(keys.values())
    for k, key in keys.items():
        if times[key] > 1 and not re.fullmatch(r"[\W_]*[\w ]+[\W_]+|[\W_]+[\w .]+[\W_]*", lines[k].strip()) or shape(lines[k]) in common:
            kinds[k] = "running"
    for k in page_edges(lines, alone):
        if not _CLOSED.search(lines[k].strip()) and shape(lines[k]) in common:
            kinds[k] = "running"
    return kinds


def body_lines(lines: list[str], kinds: dict[int, str]) -> tuple[list[int], dict[int, int]]:
    """Body lines, and for each the body line that it may run on to: the next one, or the first beyond furniture."""
    body = [k for k, line in enumerate(lines) if k not in kinds and line.strip()]
    follows = {}
    for a, b in zip(body, body[1:]):
        if (b == a + 1 or any(k in kinds for k in range(a + 1, b))) and not lines[a].lstrip().startswith(_SKIPPED) and not lines[b].lstrip().startswith(_SKIPPED):
            follows[a] = b
    return body, follows


# counts over the whole corpus


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within a batch: words of clean text, words inside the lines of scanned text, shapes of lines standing alone by record."""
    for batch in batches:
        clean: Counter = Counter()
        inner: Counter = Counter()
        shapes: Counter = Counter()
        records = 0
        for scanned, text in zip(batch["scanned"], batch["text"]):
            if not text:
                continue
            if not scanned:
                text = one_width(text)
                clean.update(words_of(text))
                clean.update(_COMPOUND.findall(text))
                continue
            records += 1
            lines = text.split("\n")
            for line in lines:
                inner.update(words_of(line)[1:-1])
                if "-" in line:
                    inner.update(_COMPOUND.findall(line))
            alone = standing_alone(lines)
            shapes.update({shape(lines[k]) for k in alone if not _CLOSED.search(lines[k].strip())})
        rows = [("w", w, n, 0) for w, n in clean.items()] + [("w", w, 0, n) for w, n in inner.items()] + [("s", s, n, 0) for s, n in shapes.items()] + [("r", "", records, 0)]
        yield as_batch(rows, ["what", "key", "a", "b"])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(what, key, a, b) over all texts, written to the shared folder."""
    checkpoint_dir(texts.sparkSession)
    return texts.mapInPandas(_counts, "what string, key string, a long, b long").groupBy("what", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).checkpoint()


# the perceptron


class Perceptron:
    """An averaged perceptron over sparse features; a label's score is the sum of its features' weights."""

    def __init__(self) -> None:
        self.weights: dict[tuple, float] = defaultdict(float)
        self._sums: dict[tuple, float] = defaultdict(float)
        self._seen: dict[tuple, int] = defaultdict(int)
        self._at = 0

    def best(self, options: dict[str, list[tuple]]) -> str:
        weights = self.weights
        return max(options, key=lambda o: (sum(weights.get(f, 0.0) for f in options[o]), o == "keep"))

    def learn(self, options: dict[str, list[tuple]], truth: str) -> None:
        self._at += 1
        guess = self.best(options)
        if guess != truth and truth in options:
            for label, by in ((truth, 1.0), (guess, -1.0)):
                for f in options[label]:
                    self._sums[f] += (self._at - self._seen[f]) * self.weights[f]
                    self._seen[f] = self._at
                    self.weights[f] += by

    def averaged(self) -> dict[tuple, float]:
        return {f: (self._sums[f] + (self._at - self._seen[f]) * w) / max(1, self._at) for f, w in self.weights.items()}


def sites(word: str) -> list[tuple[int, str, str]]:
    """Places where characters may stand for others: (position, observed, meant)."""
    return [(i, seen, meant) for seen, meant in CONFUSIONS for i in range(len(word)) if word.startswith(seen, i)]


def corrections(word: str) -> list[tuple[tuple[int, ...], str]]:
    """What one or two edits make of a word, with the numbers of the sites used."""
    places = sites(word)
    out = [((a,), word[:i] + meant + word[i + len(seen) :]) for a, (i, seen, meant) in enumerate(places)]
    for a, (i, seen, meant) in enumerate(places):
        for b, (j, seen2, meant2) in enumerate(places):
            if i + len(seen) <= j:
                out.append(((a, b), word[:i] + meant + word[i + len(seen) : j] + meant2 + word[j + len(seen2) :]))
    return out


def _bucket(n: float) -> int:
    return int(max(-6, min(12, log2(n + 0.5))))


def _options(word: str, clean: int, inner: int, places: list, support: dict[int, int]) -> dict[int, dict[str, list[tuple]]]:
    """For each position with sites: the features of each operation there."""
    own, mixed = _bucket(clean), bool(re.search(r"[^\W\d_][\d@|]|[\d@|][^\W\d_]", word))
    padded = f"^{word}$"
    by: dict[int, dict[str, list[tuple]]] = {}
    for a, (i, seen, meant) in enumerate(places):
        here = by.setdefault(i, {"keep": [("keep", own), ("keep", "mixed", mixed), ("keep", padded[i : i + 3])]})
        operation = "replace" if len(seen) == len(meant) else "delete" if len(seen) > len(meant) else "insert"
        gain = _bucket((support.get(a, 0) + 0.0) / (clean * 50 + inner + 1.0)) if support.get(a, 0) else "none"
        here[f"{operation} {seen} {meant}"] = [
            ("edit", gain), ("edit", own), ("edit", gain, own > 1), (operation, gain), ("edit", seen, meant), ("edit", "mixed", mixed),
            ("edit", padded[i : i + 3], meant), ("edit", "long", min(len(word), 8)),
        ]
    return by


def edit(weights: dict[tuple, float], word: str, clean: int, inner: int, support: dict[int, int]) -> tuple[str, list[int]]:
    """The word as the perceptron reads it, and the positions that it edits."""
    model = Perceptron()
    model.weights = weights
    places = sites(word)
    by = _options(word, clean, inner, places, support)
    out, at, i = [], [], 0
    while i < len(word):
        label = model.best(by[i]) if i in by else "keep"
        if label == "keep":
            out.append(word[i])
            i += 1
        else:
            _, seen, meant = label.split(" ")
            out.append(meant)
            at.append(i)
            i += len(seen)
    if not at and _AT.search(word):  # no word holds such a sign, known or not
        return word.replace("@", "a"), [m.start() for m in re.finditer("@", word)]
    return "".join(out), at


def _corrupted(word: str, rng: random.Random) -> tuple[str, dict[int, str]] | None:
    """The word with one or two misreadings, and the operations that undo them."""
    spots = [(i, seen, meant) for seen, meant in CONFUSIONS for i in range(len(word)) if word.startswith(meant, i)]
    rng.shuffle(spots)
    chosen: list = []
    for spot in spots[:3]:
        if len(chosen) < (2 if rng.random() < 0.2 else 1) and all(spot[0] + len(spot[2]) <= c[0] or c[0] + len(c[2]) <= spot[0] for c in chosen):
            chosen.append(spot)
    if not chosen:
        return None
    out, at, undo = [], 0, {}
    for i, seen, meant in sorted(chosen):
        out.append(word[at:i])
        operation = "replace" if len(seen) == len(meant) else "delete" if len(seen) > len(meant) else "insert"
        undo[sum(map(len, out))] = f"{operation} {seen} {meant}"
        out.append(seen)
        at = i + len(meant)
    return "".join(out) + word[at:], undo


def _join_options(left: str, mark: str, right: str, joined: int, compound: int, a: int, b: int) -> dict[str, list[tuple]]:
    """Features of joining over a line break or keeping it; a and b: how often the parts occur as words."""
    kind = {"": "none", "-": "hyphen"}.get(mark, "soft")
    facts = [
        (kind, "joined", _bucket(joined)), (kind, "compound", _bucket(compound)), (kind, "left", a > 0, "right", b > 0), (kind, "lower", right[:1].islower()), (kind, "digits", not (left + right).isalpha()),
        (kind, joined > 0, compound > 0), (kind, joined > 0, a > 0, b > 0), (kind, _bucket((joined + 0.0) / (min(a, b) + 1.0)), joined > 0), (kind,), (kind, left[:1].isupper(), right[:1].islower()),
    ]
    return {"keep": [("keep", *f) for f in facts], "join": [("join", *f) for f in facts]}


def trained(lexicon: list[tuple[str, int, int]], seed: int = 7) -> dict[tuple, float]:
    """Weights learned from words of clean text, corrupted and broken over lines."""
    rng = random.Random(seed)
    counts = {w: (a, b) for w, a, b in lexicon}
    known = sorted((w for w, a, _ in lexicon if a >= TRUSTED and len(w) > 1 and w.isalpha()), key=lambda w: (-counts[w][0], w))
    compounds = sorted(w for w, a, _ in lexicon if a >= TRUSTED and "-" in w)
    model = Perceptron()
    if not known:
        return {}
    examples = [known[int(len(known) * rng.random() ** 2)] for _ in range(TRAINING)]
    for word in examples * 2:
        noise = _corrupted(word, rng) if rng.random() < 0.5 else None
        seen, undo = noise or (word, {})
        clean, inner = counts.get(seen, (0, 0))
        if undo and clean >= TRUSTED:
            continue
        places = sites(seen)
        support: dict[int, int] = {}
        for used, meant in corrections(seen):
            n = counts.get(meant, (0, 0))[0]
            for a in used:
                support[a] = max(support.get(a, 0), n)
        for i, options in _options(seen, clean, inner, places, support).items():
            model.learn(options, undo.get(i, "keep"))
    for word in examples:
        other = known[int(len(known) * rng.random() ** 2)]
        if len(word) >= 4 and rng.random() < 0.6:
            cut = rng.randint(2, len(word) - 2)
            left, right, mark, truth = word[:cut], word[cut:], rng.choice(["", "-", "¬", "‐"]), "join"
        else:
            left, right, mark, truth = word, other, "", "keep"
            odd = rng.random()  # run ids, rare names and misread words stand at line ends, too
            strange = f"r{rng.randrange(16**5):05x}" if odd < 0.1 else (_corrupted(other, rng) or (other,))[0] if odd < 0.3 else other
            left, right = (strange, word) if rng.random() < 0.5 else (word, strange)
            if compounds and rng.random() < 0.3:
                left, _, right = rng.choice(compounds).partition("-")
                mark = "-"
        get = lambda w: sum(counts.get(w, (0, 0)))
        model.learn(_join_options(left, mark, right, get(left + right), get(f"{left}-{right}"), get(left), get(right)), truth)
    return model.averaged()


# words and line breaks by type


def _correction_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(word, clean, inner, list(used), meant) for word, clean, inner in zip(batch["word"], batch["clean"], batch["inner"]) for used, meant in corrections(word)]
        yield as_batch(rows, ["word", "clean", "inner", "used", "meant"])


def misread_words(words: DataFrame, counts: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    """(word, fixed, places): the words that the perceptron edits. words: (word), distinct.

    A word of letters that clean text holds TRUSTED times is taken as it is."""
    known = counts.where("what = 'w'").select(F.col("key").alias("word"), F.col("a").alias("clean"), F.col("b").alias("inner"))
    own = words.join(known, "word", "left").select("word", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("inner", F.lit(0)).alias("inner"))
    own = own.where(~((F.col("clean") >= TRUSTED) & F.col("word").rlike("^\\p{L}+$")))
    # two edits take at most two characters away, so a word that is longer by more than that than all that are trusted has no correction
    longest = known.where(f"clean >= {TRUSTED}").agg(F.max(F.length("word"))).first()[0] or 0
    odd = own.where((F.length("word") > longest + 2) & F.contains("word", F.lit("@"))).select("*", F.array().cast("array<int>").alias("used"), F.lit(0).cast("long").alias("n"))
    tried = own.where(F.length("word") <= longest + 2).mapInPandas(_correction_rows, "word string, clean long, inner long, used array<int>, meant string")
    met = tried.join(known.where(f"clean >= {TRUSTED}").select(F.col("word").alias("meant"), F.col("clean").alias("n")), "meant", "left")
    met = met.where("n IS NOT NULL OR contains(word, '@')").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.select(*odd.columns).unionByName(odd)
    gathered = met.groupBy("word", "clean", "inner").agg(F.collect_list(F.struct("used", "n")).alias("found"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, clean, inner, found in zip(batch["word"], batch["clean"], batch["inner"], batch["found"]):
                support: dict[int, int] = {}
                for x in found:
                    for a in x["used"]:
                        support[a] = max(support.get(a, 0), x["n"])
                fixed, places = edit(weights, word, clean, inner, support)
                if places:
                    rows.append((word, fixed, places))
            yield as_batch(rows, ["word", "fixed", "places"])

    return gathered.mapInPandas(fix, "word string, fixed string, places array<int>")


def joined_breaks(breaks: DataFrame, counts: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    """(left, mark, right): the line breaks that the perceptron joins. breaks: the same columns, distinct."""
    known = counts.where("what = 'w'").select(F.col("key").alias("k"), (F.col("a") + F.col("b")).alias("n"), "a")
    asked = F.array(*[F.struct(F.lit(name).alias("as"), key.alias("k")) for name, key in (("joined", F.concat("left", "right")), ("compound", F.concat_ws("-", "left", "right")), ("a", F.col("left")), ("b", F.col("right")))])
    met = breaks.select("left", "mark", "right", F.inline(asked)).join(known, "k", "left")
    one = lambda name, column: F.coalesce(F.max(F.when(F.col("as") == name, F.col(column))), F.lit(0))
    out = met.groupBy("left", "mark", "right").agg(*[one(name, "n").alias(name) for name in ("joined", "compound", "a", "b")], one("joined", "a").alias("clean_joined"), one("a", "a").alias("clean_a"), one("b", "a").alias("clean_b"), F.first(F.concat("left", "right")).alias("whole"))
    trusted = lambda word, n: F.col(word).rlike("^\\p{L}+$") & (F.col(n) >= TRUSTED)
    out = out.where(~((F.col("mark") == "") & trusted("left", "clean_a") & trusted("right", "clean_b") & ~trusted("whole", "clean_joined")))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Perceptron()
        model.weights = weights
        for batch in batches:
            columns = [batch[c] for c in ("left", "mark", "right", "joined", "compound", "a", "b")]
            yield as_batch([row[:3] for row in zip(*columns) if model.best(_join_options(*row)) == "join"], ["left", "mark", "right"])

    return out.mapInPandas(decide, "left string, mark string, right string")


# records


def word_filter(counts: DataFrame) -> bytes:
    """One bit of BITS for each word of the corpus; at most BITS / ROW rows reach the driver. What it lacks is no word; what it has may be one."""
    bit = F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(BITS))
    rows = counts.where("what = 'w'").select(F.floor(bit / ROW).cast("int").alias("row"), (bit % ROW).cast("int").alias("bit")).groupBy("row").agg(F.collect_set("bit").alias("bits"))
    out = bytearray(BITS // 8)
    for r in rows.toLocalIterator():
        for b in r["bits"]:
            at = r["row"] * ROW + b
            out[at >> 3] |= 1 << (at & 7)
    return bytes(out)


def _notes(common: set[str], skip: set[str], known: bytes):
    """Furniture, words to look up and line breaks to decide, by line."""

    def maybe(word: str) -> bool:
        at = crc32(word.encode("utf-8", "replace")) % BITS
        return bool(known[at >> 3] >> (at & 7) & 1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, key, text in zip(batch["field_name"], batch["record_id"], batch["text"]):
                if not text:
                    continue
                lines = text.split("\n")
                kinds = furniture(lines, common)
                rows += [(field, key, k + 1, kind, None, None, None, None) for k, kind in kinds.items()]
                body, follows = body_lines(lines, kinds)
                ends: dict[int, tuple] = {}
                for k, after in follows.items():
                    left, right = _LEFT.search(lines[k]), _RIGHT.match(lines[after])
                    if not left or not right:
                        continue
                    a, mark, b = left[1], left[2], right[1]
                    if "_" in a + b or a.isdigit() or b.isdigit():
                        continue
                    if mark or a not in skip or b not in skip or maybe(a + b):
                        ends[k] = (a, mark, b, after)
                        rows.append((field, key, k + 1, "break", a, mark, b, after + 1))
                starts = {after: k for k, (_, _, _, after) in ends.items()}
                for k in body:
                    found = words_of(lines[k])
                    for n, word in enumerate(found):
                        if word in skip:
                            continue
                        at = k + 1 if k in ends and n == len(found) - 1 and word == ends[k][0] else starts[k] + 1 if k in starts and n == 0 and word == ends[starts[k]][2] else None
                        rows.append((field, key, k + 1, "word", word, None, None, at))
            yield as_batch(list(dict.fromkeys(rows)), ["field_name", "record_id", "line_no", "what", "left", "mark", "right", "other"])

    return work


_NOTE = "field_name string, record_id long, line_no int, what string, left string, mark string, right string, other int"


class Repair:
    """What is wrong with the lines of scanned records, judged by counts over all texts.

    scanned: (field_name, record_id, text); clean: (text) of born-digital texts."""

    def __init__(self, scanned: DataFrame, clean: DataFrame) -> None:
        small_batches(scanned.sparkSession)
        self.scanned = scanned
        both = scanned.select(F.lit(True).alias("scanned"), "text").unionByName(clean.select(F.lit(False).alias("scanned"), "text"))
        self.counts = counts = corpus_counts(both)
        words = counts.where("what = 'w'")
        first = [F.desc("a"), F.desc("b"), F.asc("key")]
        lexicon = [(r["key"], r["a"], r["b"]) for r in words.orderBy(*first).limit(LEXICON).collect()]
        self.weights = trained(lexicon)
        records = counts.where("what = 'r'").agg(F.sum("a")).first()[0] or 0
        # at most the standing lines of a record over SHARE are common
        common = {r["key"] for r in counts.where(f"what = 's' AND a >= {max(3, SHARE * records)}").select("key").collect()}
        trusted = words.where(F.col("key").rlike("^\\p{L}+$") & (F.col("a") >= TRUSTED)).orderBy(*first).limit(SKIP)
        skip = {r["key"] for r in trusted.select("key").collect()}
        self.common = common
        notes = scanned.mapInPandas(_notes(common, skip, word_filter(counts)), _NOTE).distinct()
        checkpoint_dir(scanned.sparkSession)
        self.notes = notes.checkpoint()
        at = ["field_name", "record_id"]
        breaks = self.notes.where("what = 'break'")
        decided = joined_breaks(breaks.select("left", "mark", "right").distinct(), counts, self.weights)
        self.joined = breaks.join(decided, ["left", "mark", "right"])
        whole = F.concat("left", "right").alias("word")
        loose = self.notes.where("what = 'word'").select(*at, "line_no", F.col("left").alias("word"), F.col("other").alias("break_line"))
        free = loose.where("break_line IS NULL").drop("break_line").unionByName(
            loose.where("break_line IS NOT NULL").join(self.joined.select(*at, F.col("line_no").alias("break_line")), [*at, "break_line"], "left_anti").drop("break_line")
        )
        fixes = misread_words(free.select("word").unionByName(self.joined.select(whole)).distinct(), counts, self.weights)
        self.misread = free.join(fixes, "word")
        broken = self.joined.select(*at, "line_no", "other", F.length("left").alias("cut"), whole).join(fixes, "word")
        self.misread_broken = broken

    def findings(self) -> DataFrame:
        """(field_name, record_id, line_no, kind), once each."""
        at = ["field_name", "record_id"]
        kinds = self.notes.where("what IN ('folio', 'running')").select(*at, "line_no", F.col("what").alias("kind"))
        hyphens = self.joined.select(*at, "line_no", F.lit("hyphen").alias("kind"))
        whole = self.misread.select(*at, "line_no", F.lit("misread").alias("kind"))
        before = self.misread_broken.where(F.exists("places", lambda p: p < F.col("cut"))).select(*at, "line_no", F.lit("misread").alias("kind"))
        after = self.misread_broken.where(F.exists("places", lambda p: p >= F.col("cut"))).select(*at, F.col("other").alias("line_no"), F.lit("misread").alias("kind"))
        return kinds.unionByName(hyphens).unionByName(whole).unionByName(before).unionByName(after).distinct()

    def paragraphs(self) -> DataFrame:
        """(field_name, record_id, paragraph_no, paragraph): continuous text without furniture, breaks and misreadings."""
        at = ["field_name", "record_id"]
        edits = (
            self.joined.select(*at, F.struct("line_no", F.lit("join").alias("what"), F.lit("").alias("word"), F.lit("").alias("fixed")).alias("e"))
            .unionByName(self.misread.select(*at, F.struct("line_no", F.lit("fix").alias("what"), "word", "fixed").alias("e")))
            .unionByName(self.misread_broken.select(*at, F.struct("line_no", F.lit("whole").alias("what"), "word", "fixed").alias("e")))
            .groupBy(*at)
            .agg(F.collect_set("e").alias("edits"))
        )
        common = self.common

        def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for field, key, text, found in zip(batch["field_name"], batch["record_id"], batch["text"], batch["edits"]):
                    for n, paragraph in enumerate(continuous(text or "", common, [] if found is None else list(found)), 1):
                        rows.append((field, key, n, paragraph))
                yield as_batch(rows, ["field_name", "record_id", "paragraph_no", "paragraph"])

        return self.scanned.join(edits, at, "left").mapInPandas(assemble, "field_name string, record_id long, paragraph_no int, paragraph string").dropDuplicates([*at, "paragraph_no"])


def continuous(text: str, common: set[str], edits: list) -> list[str]:
    """The paragraphs of one record after its edits."""
    lines = text.split("\n")
    kinds = furniture(lines, common)
    body, follows = body_lines(lines, kinds)
    joins = {e["line_no"] - 1 for e in edits if e["what"] == "join"}
    fixes: dict[int, dict[str, str]] = defaultdict(dict)
    wholes: dict[int, dict[str, str]] = defaultdict(dict)
    for e in edits:
        if e["what"] != "join":
            (fixes if e["what"] == "fix" else wholes)[e["line_no"] - 1][e["word"]] = e["fixed"]
    out: list[str] = []
    open_to = None
    for k in body:
        known = fixes.get(k)
        line = _TOKEN.sub(lambda m: known.get(m[0], m[0]), lines[k]) if known else lines[k]
        runs_on = open_to == k and out and not re.match(r"\s*(?:[-*+]|\d+\.)\s", line)
        if runs_on and joined:
            out[-1] = re.sub(rf"[{_MARKS}]?\s*$", "", out[-1]) + line.lstrip()
            if whole:
                for word, fixed in whole.items():
                    out[-1] = out[-1].replace(word, fixed)
        elif runs_on and not (_CLOSED.search(out[-1]) and follows.get(last) != last + 1):
            glue = "" if re.search(r"[^\W\d_]-\s*$", out[-1]) and line.lstrip()[:1].islower() else " "  # a compound keeps its hyphen
            out[-1] = f"{out[-1].rstrip()}{glue}{line.lstrip()}"
        else:
            out.append(line.strip())
        open_to, joined, whole, last = follows.get(k), k in joins, wholes.get(k), k
    return out
