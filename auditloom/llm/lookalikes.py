"""One consistent form for texts that look the same but differ in their characters.

First every text is brought to one width, one composition of accents, one kind of
space, without invisible characters and ligatures; raised and circled digits stay.
Then tokens whose letters come from several alphabets are repaired: the letters that
exist in one alphabet only tell the token's script (the document's script where the
token has none), and look-alikes of other alphabets are replaced when the result is
in the vocabulary, which counts the tokens of one alphabet over the whole corpus. If
it is not, a form of another alphabet that is in the vocabulary is taken; if none is
(run ids stand in one paper only), the form in the token's script. Each step depends
only on what is seen, so visually identical texts come out equal.

Defined results: null texts stay null, empty texts stay empty; a key that is delivered
twice counts once; an empty table gives an empty result; further columns are ignored;
texts of any length are read whole; ties between forms go to the token's script, then
to the alphabets in the order of SCRIPTS.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.frames import batch
from auditloom.session import kept, small_batches

SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
#: Letters that look the same, fixed values: latin, and its twins in the other alphabets.
TWINS = {
    "cyrillic": ("aceopxysijhdqwlABCEHIJKMOPSTXYQWV", "асеорхуѕіјһԁԛԝӏАВСЕНІЈКМОРЅТХҮԚԜѴ"),
    "greek": ("ovpABEHIKMNOPTXYZ", "ονρΑΒΕΗΙΚΜΝΟΡΤΧΥΖ"),
    "armenian": ("ohnuO", "օհոսՕ"),
}
_IGNORED = "\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff"
_KEPT = {0x17F, 0xE33, 0xEB3, *range(0x3131, 0x318F)}
_TOKEN = re.compile("[0-9A-Za-z_À-ÖØ-öø-ɏ\u0300-֏Ḁ-ỿ]+")
_OTHER = re.compile("[Ͱ-֏]")

TO_LATIN = {twin: latin for latins, twins in TWINS.values() for latin, twin in zip(latins, twins)}
FROM_LATIN = {"latin": {}} | {script: dict(zip(latins, twins)) for script, (latins, twins) in TWINS.items()}
_AMBIGUOUS_LATIN = {x for latins, _ in TWINS.values() for x in latins}


@lru_cache(1)
def _widths() -> tuple[re.Pattern, dict[str, str]]:
    """Characters that only differ in width, position or joining from plain ones, found by their decomposition."""
    plain = {}
    for point in range(0xA0, sys.maxunicode + 1):
        char = chr(point)
        tag = unicodedata.decomposition(char).partition(" ")[0]
        kind = unicodedata.category(char)
        if kind == "Zs" and point != 0x1680:
            plain[char] = " "
        elif point in _KEPT or not tag.startswith("<"):
            continue
        elif tag in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>") or tag == "<compat>" and kind in ("Lu", "Ll", "Lt", "Lo", "Nl"):
            plain[char] = unicodedata.normalize("NFKC", char)
    runs, points = [], sorted(map(ord, plain))
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + _IGNORED + "]+"), plain


def one_width(text: str) -> str:
    """The text without what can't be seen; everything but look-alike letters."""
    if text.isascii():
        return text
    special, plain = _widths()
    text = special.sub(lambda m: "".join(plain.get(c, "") for c in m[0]), text)
    return unicodedata.normalize("NFC", text).replace("\u0e4dา", "ำ")


@lru_cache(100_000)
def _letter(char: str) -> str:
    """The script that a letter proves; "?" for one with twins, "" for what is no letter of these alphabets."""
    if char in TO_LATIN or char in _AMBIGUOUS_LATIN:
        return "?"
    if not char.isalpha():
        return ""
    point = ord(char)
    if point < 0x370 or 0x1E00 <= point < 0x1F00:
        return "latin"
    return "greek" if point < 0x400 else "cyrillic" if point < 0x530 else "armenian" if point < 0x590 else ""


def _script(char: str) -> str:
    if char in TO_LATIN:
        return next(s for s, (_, twins) in TWINS.items() if char in twins)
    return "latin" if char in _AMBIGUOUS_LATIN else _letter(char)


def _most(counts: Counter) -> str:
    return max(SCRIPTS, key=lambda s: (counts[s], -SCRIPTS.index(s)))


def document_script(text: str) -> str:
    """The alphabet of most letters that have no twin; latin where there is none."""
    counts: Counter = Counter()
    for char, n in Counter(unicodedata.normalize("NFD", text)).items():
        if kind := _letter(char):
            counts[kind] += n
    return _most(counts)


@lru_cache(200_000)
def _suspect(token: str, script: str) -> bool:
    letters = [c for c in unicodedata.normalize("NFD", token) if _letter(c)]
    used = {_script(c) for c in letters}
    return len(used) > 1 or (used != {script} and bool(used) and all(_letter(c) == "?" for c in letters))


def suspects(text: str, script: str) -> list[str]:
    """Distinct tokens that may be written with letters of the wrong alphabet."""
    return [t for t in dict.fromkeys(_TOKEN.findall(text)) if _suspect(t, script)] if _OTHER.search(text) else []


def forms(token: str, script: str) -> list[str]:
    """The token in each alphabet, that of the token's own script first."""
    letters = unicodedata.normalize("NFD", token)
    proven = Counter(k for c in letters if (k := _letter(c)) not in ("", "?"))
    first = _most(proven) if proven else script
    out = []
    for target in dict.fromkeys((first, *SCRIPTS)):
        base = "".join(TO_LATIN.get(c, c) for c in letters)
        out.append(unicodedata.normalize("NFC", "".join(FROM_LATIN[target].get(c, c) for c in base)))
    return list(dict.fromkeys(out))


def repaired(text: str, tokens: list[str], results: list[str]) -> str:
    known = dict(zip(tokens, results))
    return _TOKEN.sub(lambda m: known.get(m[0], m[0]), text) if known else text


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("script", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def _first_step(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((None, None, []))
            continue
        plain = one_width(text)
        script = document_script(plain) if _OTHER.search(plain) else "latin"
        rows.append((plain, script, suspects(plain, script)))
    return batch(rows, ["text", "script", "tokens"])


def _token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within a batch of the tokens that need no repair."""
    for part in batches:
        counts: Counter = Counter()
        for text in part["text"].dropna():
            counts.update(_TOKEN.findall(one_width(text)))
        kept = {t: n for t, n in counts.items() if t.isascii() or len({_script(c) for c in unicodedata.normalize("NFD", t) if _letter(c)}) <= 1}
        yield batch(list(kept.items()), ["form", "n"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(tokens: pd.Series, scripts: pd.Series) -> pd.Series:
    return pd.Series([forms(t, s) for t, s in zip(tokens, scripts)], dtype=object)


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series, tokens: pd.Series, results: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else repaired(x, [] if a is None else list(a), [] if b is None else list(b)) for x, a, b in zip(texts, tokens, results)], dtype=object)


def chosen_forms(found: DataFrame, vocabulary: DataFrame, known_only: bool = False) -> DataFrame:
    """(token, script, result) of the tokens that are replaced. found: (token, script); vocabulary: (form, n).

    known_only: a token of which no form is in the vocabulary stays as it is."""
    options = found.select("token", "script").distinct().select("token", "script", F.posexplode(_forms("token", "script")).alias("rank", "form"))
    seen = F.coalesce("n", F.lit(0))
    best = options.join(vocabulary, "form", "left").groupBy("token", "script").agg(F.max_by("form", F.struct((F.col("rank") == 0) & (seen > 0), seen, -F.col("rank"))).alias("result"), F.max(seen).alias("seen"))
    return best.where(F.col("token") != F.col("result")).where((F.col("seen") > 0) | F.lit(not known_only)).drop("seen")


def _gathered(found: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    return found.join(chosen, ["token", "script"]).groupBy(*key).agg(F.collect_list(F.struct("token", "result")).alias("r")).select(*key, F.col("r.token").alias("tokens"), F.col("r.result").alias("results"))


def token_repairs(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, tokens, results): the replacements of each text, by the vocabulary of all texts."""
    stepped = texts.select(*key, _first_step("text").alias("s")).where(F.size("s.tokens") > 0)
    found = stepped.select(*key, F.col("s.script").alias("script"), F.explode("s.tokens").alias("token"))
    vocabulary = texts.select("text").mapInPandas(_token_counts, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    return _gathered(found, chosen_forms(found, vocabulary), key)


def _apply(texts: DataFrame, key: list[str], how, name: str) -> DataFrame:
    """Texts without any suspect token are done where they stand; the others meet their replacements."""
    small_batches(texts.sparkSession)
    stepped = texts.select(*key, "text", _first_step("text").alias("s"))
    none = F.lit(None).cast("array<string>")
    clean = stepped.where(F.col("s").isNull() | (F.coalesce(F.size("s.tokens"), F.lit(0)) == 0)).select(*key, "text", how(F.col("s.text"), none, none).alias(name))
    dirty = stepped.where(F.size("s.tokens") > 0).select(*key, "text", F.col("s.text").alias("plain"))
    fixed = dirty.join(token_repairs(texts, key), key, "left").select(*key, "text", how(F.col("plain"), F.col("tokens"), F.col("results")).alias(name))
    return clean.unionByName(fixed)


def _once(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, at, text): a row for each text column; two equal ones are a single row with at -1."""
    equal = F.col(columns[0]).eqNullSafe(F.col(columns[-1])) if len(columns) == 2 else F.lit(False)
    one = F.array(F.struct(F.lit(-1).alias("at"), F.col(columns[0]).alias("text")))
    return frame.select(F.col(key), F.inline(F.when(equal, one).otherwise(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("text")) for i, c in enumerate(columns)]))))


def _each(frame: DataFrame, columns: list[str]) -> DataFrame:
    every = F.array(*[F.lit(i) for i in range(len(columns))])
    return frame.withColumn("at", F.explode(F.when(F.col("at") < 0, every).otherwise(F.array("at"))))


def consistent_texts(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, text): every text column in its consistent form, once per key and field."""
    forms_ = _apply(_once(frame, key, columns), [key, "at"], _repaired, "form").dropDuplicates([key, "at"])
    return _each(forms_, columns).select(key, _name(columns).alias("field_name"), F.col("form").alias("text"))


def _name(columns: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1)


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text, with its look where no token needs repair, and the vocabulary of the batch."""
    for part in batches:
        names = list(part.columns)
        rows, counts = [], Counter()
        for key, at, text in zip(*(part[c] for c in names)):
            plain = one_width(text)
            script = document_script(plain) if _OTHER.search(plain) else "latin"
            tokens = suspects(plain, script)
            counts.update(_TOKEN.findall(plain))
            rows.append((key, at, _digest(text), None if tokens else _digest(plain), script, tokens, None, None))
        kept_ = (t for t in counts if t.isascii() or len({_script(c) for c in unicodedata.normalize("NFD", t) if _letter(c)}) <= 1)
        rows += [(None, None, None, None, None, None, t, counts[t]) for t in kept_]
        yield batch(rows, [*names[:2], "stored", "look", "script", "tokens", "form", "n"])


@F.pandas_udf(T.StringType())
def _look(texts: pd.Series, tokens: pd.Series, results: pd.Series) -> pd.Series:
    return pd.Series([_digest(repaired(one_width(x), [] if a is None else list(a), [] if b is None else list(b))) for x, a, b in zip(texts, tokens, results)], dtype=object)


def same_look(frame: DataFrame, key: str, columns: list[str], known_only: bool = False) -> DataFrame:
    """(field_name, key, stored, look): digests of each text as stored and as seen, once per key and field.

    All texts are read once for their digests, suspect tokens and words; those with suspect tokens once more for their look."""
    small_batches(frame.sparkSession)
    texts = _once(frame, key, columns).where(F.col("text").isNotNull() & F.col(key).isNotNull())
    types = T.StructType([frame.schema[key], T.StructField("at", T.IntegerType())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types) + ", stored string, look string, script string, tokens array<string>, form string, n long"
    first = kept(texts.select(key, "at", "text").mapInPandas(_first_rows, schema), "looks")
    rows = first.where("form IS NULL")
    dirty = rows.where("look IS NULL").dropDuplicates([key, "at"])
    found = dirty.select(key, "at", "script", F.explode("tokens").alias("token"))
    vocabulary = first.where("form IS NOT NULL").groupBy("form").agg(F.sum("n").alias("n"))
    repairs = dirty.select(key, "at", "stored").join(_gathered(found, chosen_forms(found, vocabulary, known_only), [key, "at"]), [key, "at"], "left")
    fixed = texts.select(key, "at", "text").join(repairs, [key, "at"]).select(key, "at", "stored", _look("text", "tokens", "results").alias("look"))
    looks = rows.where("look IS NOT NULL").select(key, "at", "stored", "look").unionByName(fixed)
    return kept(_each(looks, columns).dropDuplicates([key, "at"]).select(_name(columns).alias("field_name"), key, "stored", "look"), "looks")


def look_classes(looks: DataFrame) -> DataFrame:
    """The rows of same_look with texts and stored_texts: how many keys, and how many stored texts, have that look. Counted by stored text first."""
    by_text = looks.groupBy("field_name", "look", "stored").agg(F.count("*").alias("n"))
    counted = by_text.groupBy("field_name", "look").agg(F.sum("n").alias("texts"), F.count("*").alias("stored_texts"))
    return looks.join(counted, ["field_name", "look"])


#: A look is met in so many parts.
SALTS = 16


def look_pairs(looks: DataFrame, key: str) -> DataFrame:
    """(field_name, key_a, key_b): pairs of keys, the smaller first, with one look and different stored texts.

    Looks with a single stored text are left out before any rows meet. Then the stored texts of a look are paired, each
    once, and only after that their keys join in, so byte-equal texts never meet each other; one side of a look is
    dealt to SALTS parts, to each of which the pairs of stored texts are copied."""
    at = ["field_name", "look"]
    stored = looks.select(*at, "stored").distinct()
    several = stored.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1").select(*at)
    stored = stored.join(several, at, "left_semi")
    a, b = stored.withColumnRenamed("stored", "stored_a"), stored.withColumnRenamed("stored", "stored_b")
    ways = a.join(b, at).where("stored_a != stored_b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = looks.select(*at, F.col("stored").alias("stored_a"), F.col(key).alias(f"{key}_a"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    right = looks.select(*at, F.col("stored").alias("stored_b"), F.col(key).alias(f"{key}_b"))
    met = left.join(ways, [*at, "stored_a", "salt"]).join(right, [*at, "stored_b"])
    return met.where(F.col(f"{key}_a") < F.col(f"{key}_b")).select("field_name", f"{key}_a", f"{key}_b")
