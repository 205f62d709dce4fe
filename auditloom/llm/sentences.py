"""Sentence units with positions, in any script, as SQL expressions.

Every step keeps the length of the text, so positions survive it. Fenced code is
blanked and the line breaks that part blocks are marked; marks of decimals, URLs,
initials, ordinals and abbreviations, and marks inside quotations and brackets that a
sentence goes on after, are masked with private-use placeholders; the white space (in
Chinese and Japanese the place) after the terminators of each script is cut, in Thai
the space between two Thai letters; at last the placeholders are put back. Offsets are
a running sum of piece lengths. Abbreviations are matched as they look: full-width and
look-alike letters and invisible characters between them count.

Defined results: null or empty texts have no sentences; an empty table gives an empty
result; a paper delivered twice counts once; private-use characters of the input count
as ordinary characters; unclosed fences run to the end; an unclosed quotation masks
nothing; texts of any length are cut whole. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.lookalikes import TWINS

CUT, GAP = "\ue000", "\ue002"
Z = "[\u00ad\u200b-\u200d\u2060\ufeff]*+"
Z1 = "[\u00ad\u200b-\u200d\u2060\ufeff]?"
_WS = "\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + CUT + GAP
S = f"[{_WS}]"
_SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + CUT + GAP
_MARKS = ".!?\u2026\u3002\uff01\uff1f\uff0e\u061f\u0964\u0965\u06d4"
_MASKS = "".join(chr(0xE010 + i) for i in range(len(_MARKS)))
_CLOSERS = "\"'\u201c\u201d\u2019\u00bb\u203a)\\]\uff09\u300d\u300f\u3011\u300b"
_CLOSE = f"(?:[{_CLOSERS}\u00ad\u200b-\u200d\u2060\ufeff]|{S}?[\u00bb\u203a](?!{S}?[\\p{{L}}\\p{{N}}]))"

#: Abbreviations that a sentence goes on after, whatever follows; fixed values.
TITLES = "Dr Mr Mrs Ms Prof Rev Hon St Hrn Hr Fr Frl Dipl Ing M MM Mgr Me Sr Sra Srta Dra Ud Uds \u0433 \u043f\u0440\u043e\u0444 \u0430\u043a\u0430\u0434 \u0438\u043c \u0921\u0949 \u0915\u0941 \u0926".split()
LINKS = "cf vs e.g i.e a.k.a approx resp incl excl esp viz ca vgl bzw bzgl evtl ggf inkl exkl lt z.B d.h u.a o.g s.o p.ex p.ej env aprox \u0441\u043c \u0442.\u0435 \u0440\u0438\u0441 \u0442\u0430\u0431\u043b \u0441\u0442\u0440 \u043e\u043a \u0433\u043b".split()
#: Those that stand before a number; elsewhere they may end a sentence.
COUNTED = "No Nos Nr Nrn n\u00fam p pp p\u00e1g p\u00e1gs S Bd vol Vol Fig Figs fig figs Tab Tabs tab Tbl Eq Eqs App Abb Sec Sect Ch Chap chap Kap ref refs Ref Refs art Art cap v ver c \u0441".split()
#: Names that begin a sentence in lower case.
METRICS = "accuracy loss wer lr perplexity top1 top5 val_bpb f1_macro exact_match recall_at_5".split()
#: German words before an ordinal.
ARTICLES = "Der Die Das Dem Den Des Am Im Beim Vom Zum Zur Ab Bis Jeder Jede Jedes der die das dem den des am im beim vom zum zur ab bis jeder jede jedes ein eine einem einen einer".split()


def _looks() -> dict[str, str]:
    same: dict[str, set[str]] = {}
    for latins, twins in TWINS.values():
        for a, b in zip(latins, twins):
            same.setdefault(a, {a}).add(b)
    out = {}
    for group in same.values():
        for c in group:
            out[c] = "".join(sorted(group))
    return out


_LOOKS = _looks()


def _seen(char: str) -> str:
    """A class for the character in any width and as any look-alike; a full stop may be followed by a space."""
    if char == ".":
        return f"[.\uff0e]{S}?"
    wide = chr(ord(char) + 0xFEE0) if "!" <= char <= "~" else ""
    return "[" + "".join(dict.fromkeys(_LOOKS.get(char, char) + wide)) + "]"


def _any(words: list[str]) -> str:
    """A pattern for any of the words as they look, by common beginnings, so that few branches are tried."""
    trie: dict = {}
    for word in words:
        at = trie
        for char in word:
            at = at.setdefault(_seen(char), {})
        at[""] = {}

    def build(node: dict) -> str:
        branches = [k if set(v) == {""} else f"{k}{Z1}{build(v)}" if "" not in v else f"{k}(?:{Z1}{build({x: y for x, y in v.items() if x})})?" for k, v in node.items()]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return build(trie)


_EDGE = f"(?<![\\p{{L}}\\p{{N}}\\p{{M}}.\uff0e])"
_METRIC = f"{_any(METRICS)}(?![\\p{{L}}\\p{{N}}_])"
_STOP = "[.\uff0e]"
_MASK_STOP = _MASKS[0]
_LIST = f"[ \\t]*(?:[-*+]|\\p{{Nd}}{{1,9}}\\.)[ \\t\u00a0\u2000-\u200a\u202f\u205f]"
_MARKER = f"^{S}*(?:[-*+]|\\p{{Nd}}{{1,9}}\\.){S}+(?:\\[[ xX?]\\](?:{S}+|$))?"

_REGION = "|".join(
    (
        "\u201c[^\u201c\u201d]*+\u201d", "\u201e[^\u201c\u201d\u201e]*+[\u201c\u201d]", "\u00ab[^\u00ab\u00bb]*+\u00bb", "\u2039[^\u2039\u203a]*+\u203a", "\u300c[^\u300c\u300d]*+\u300d",
        "\u300e[^\u300e\u300f]*+\u300f", "\"[^\"]*+\"", "\u2018[^\u2018\u2019]*+\u2019", "\\([^()]*+\\)", "\uff08[^\uff08\uff09]*+\uff09",
        "(?<![\\p{L}\\p{N}])'(?=\\S)[^']*+(?:(?<=\\p{L})'(?=\\p{L})[^']*+){0,40}'(?![\\p{L}\\p{N}])",
    )
)
_OPENERS = "\u201c\u201e\u00ab\u2039\u300c\u300e\"\u2018(\uff08'"
_GOES_ON = f"(?:{Z}[\\p{{L}}\\p{{N}}]|{Z}{S}*+{Z}(?:(?!{_METRIC})\\p{{Ll}}|\\p{{Lo}}|[,;:\u3001\uff0c\uff1b\uff1a\u060c\u2013\u2014-]))"
_TOKENS = f"(?:{_REGION}){_GOES_ON}?|[^{_OPENERS}]+|[{_OPENERS}]"
_TAIL = f"[{_MARKS}{_MASKS}]+{S}?[{_CLOSERS}\u00ad\u200b-\u200d\u2060\ufeff]+(?:{S}*+\\p{{Lo}})?$"


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def _mask(text: Column) -> Column:
    return F.translate(text, _MARKS, _MASKS)


def without_code(text: Column) -> Column:
    """The text with fenced code blanked, character by character."""
    fence = "(?m)^```[\\s\\S]*?(?:^```[^\\n]*$|\\z)|^~~~[\\s\\S]*?(?:^~~~[^\\n]*$|\\z)|[^`~]+|[`~]"
    blank = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(fence), F.lit(0)), lambda p: F.when(p.rlike("^(```|~~~)"), F.regexp_replace(p, "[^\\n]", " ")).otherwise(p)), "")
    return F.when(text.contains("```") | text.contains("~~~"), blank).otherwise(text)


def blocks_of(text: Column) -> Column:
    """Blocks, each with the mark that ends it: heading and table lines, list items, paragraphs."""
    plain = F.regexp_replace(text, F.lit("[\ue000-\ue01f]"), F.lit("\ufffd"))
    cut = _replace(without_code(plain), f"\\n(?=[ \\t\\r]*(?:\\n|\\z)|[#|]|{_LIST})", CUT)
    return F.split(cut, f"(?<={CUT})", -1)


def _quotations(block: Column) -> Column:
    """Marks inside quotations and brackets masked; where the sentence ends with the closing one, the last mark stays."""

    def one(token: Column) -> Column:
        tail = F.regexp_extract(token, _TAIL, 0)
        ends = token.rlike(f"[{_CLOSERS}]$") | (token.rlike("\\p{Lo}$") & ~F.regexp_replace(token, ".$", "").rlike("\\p{Lo}"))
        kept = F.concat(_mask(F.left(token, F.length(token) - F.length(tail))), tail)
        return F.when(token.rlike(f"^[{_OPENERS}]") & (F.length(token) > 1), F.when(ends, kept).otherwise(_mask(token))).otherwise(token)

    tokens = F.regexp_extract_all(block, F.lit(_TOKENS), F.lit(0))
    return F.when(block.rlike(f"[{_OPENERS}]"), F.array_join(F.transform(tokens, one), "")).otherwise(block)


#: An address ends before white space, marks of East Asian scripts and closing signs, and holds no mark at its end.
_URL = "(?:https?://|www\\.)[^\\s\u3000-\u303f\uff00-\uffef\u201c\u201d\u2018\u2019\u00ab\u00bb<>\"]*[^\\s\u3000-\u303f\uff00-\uffef\u201c\u201d\u2018\u2019\u00ab\u00bb<>\".,;:!?)\\]}'\u0964\u06d4\u061f\u2026]"
_DECIMAL = "(?<=\\p{Nd})[.\uff0e](?=\\p{Nd})"


def _addresses_and_decimals(block: Column) -> Column:
    """Every mark inside an address or a number masked."""
    pieces = F.regexp_extract_all(block, F.lit(f"{_URL}|(?:(?!{_URL})[\\s\\S])+"), F.lit(0))
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^(?:https?://|www\\.)"), _mask(p)).otherwise(p)), "")
    return _replace(F.when(block.contains("://") | block.contains("www."), whole).otherwise(block), _DECIMAL, _MASK_STOP)


def masked(block: Column) -> Column:
    """The block with every mark that ends no sentence masked; each pattern starts at the full stops before a space."""
    here = f"{_STOP}(?={Z}{S})"
    capital, digit = f"(?={Z}{S}++{Z}\\p{{Lu}})", f"(?={Z}{S}*+{Z}\\p{{Nd}})"
    words = "|".join(
        (
            f"(?<={_EDGE}{_any(TITLES + LINKS)}{Z1}{_STOP})",
            f"(?<={_EDGE}{_any(COUNTED)}{Z1}{_STOP}){digit}",
            f"(?<={_EDGE}\\p{{Lu}}{Z1}{_STOP}){capital}",
            f"(?<={_EDGE}{_any(ARTICLES)}{Z1}{S}{Z1}\\p{{Nd}}{{1,3}}{Z1}{_STOP}){capital}",
            f"(?<={_EDGE}\\p{{L}}{Z1}{_STOP})(?={S}\\p{{L}}{Z1}{_STOP})",
        )
    )
    return _quotations(_replace(_addresses_and_decimals(block), f"{here}(?:{words})", _MASK_STOP))


def pieces_of(block: Column) -> Column:
    """Pieces of a block whose marks are masked; together they are the block."""
    ends = f"(?:[{_MARKS}]{_CLOSE}{{0,6}})"
    goes_on = f"(?!{Z}{S}*+{Z}(?:(?!{_METRIC})\\p{{Ll}}|[{_CLOSERS.replace(chr(34), '').replace(chr(39), '').replace(chr(0x201C), '')}]))"
    out = _replace(block, f"({ends}){S}{goes_on}", f"$1{GAP}")
    thai = "\u0e01-\u0e45\u0e47-\u0e5b"
    out = F.when(out.rlike(f"[{thai}]"), _replace(out, f"(?<=[{thai}]){S}(?={Z}{S}*+{Z}[{thai}])", GAP)).otherwise(out)
    east = "[\u3002\uff01\uff1f]"
    shut = "[\u201d\u2019\u300d\u300f\uff09\u3011\u300b\"')]"
    return F.split(out, f"(?<={GAP})|(?<={east}{shut}{{0,3}})(?!{shut}|{east}|{S}|$)|(?<=[!?]{shut}{{0,2}})(?=[\\p{{IsHan}}\\p{{IsHiragana}}\\p{{IsKatakana}}])", -1)


def restored(text: Column) -> Column:
    return F.translate(text, _MASKS + CUT + GAP, _MARKS + "\n ")


def sentences(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_start, sent_end, sentence): every sentence once per key."""
    rows = frame.select(F.col(key).alias("k"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("k", "row", F.posexplode(blocks_of(F.col("text"))).alias("b", "block"))
    marker = F.when(F.col("block").rlike("^[#|]"), F.regexp_extract("block", f"^[^\\n{CUT}]*[\\n{CUT}]?", 0)).otherwise(F.regexp_extract("block", _MARKER, 0))
    rows = rows.select("k", "row", "b", marker.alias("marker"), F.col("block"))
    body = masked(F.substring("block", F.length("marker") + 1, F.length("block")))
    rows = rows.select("k", "row", "b", F.posexplode(F.concat(F.array("marker"), pieces_of(body))).alias("i", "piece"))
    space = F.lit(_SPACES)
    bare = F.trim("piece", space)
    rows = rows.select("k", "row", "b", "i", F.length("piece").alias("n"), (F.length("piece") - F.length(F.ltrim("piece", space))).alias("lead"), F.length(bare).alias("m"), restored(bare).alias("sentence"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("row").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("start", (before + F.col("lead")).cast("int")).where("i > 0 AND m > 0")
    return placed.select(F.col("k").alias(key), F.col("start").alias("sent_start"), (F.col("start") + F.col("m")).cast("int").alias("sent_end"), "sentence").dropDuplicates([key, "sent_start", "sent_end"])
