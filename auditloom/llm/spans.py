"""Long exact spans shared between records, by anchors that the text itself decides on.

At every place the text is fingerprinted over half the span length; the least of the
fingerprints of half a span length of places in a row is an anchor. The characters of
such a stretch, less than a span, decide on it alone, whatever stands around them. So
any shared span holds a shared anchor in its first half, on every executor without any
exchange, and one place in about sixty is an anchor.

Fingerprints of anchors that stand in two records are shared anchors. Around them whole
windows of the span length are compared: all of them at the ends of a row of shared
anchors, those that start at an anchor in its inside, and in a third step all between
two anchors of which one isn't settled. The windows found shared are the spans.

Hot fingerprints are salted by record and aggregated before they meet, so no group is
gathered in one place. Defined results: null and short texts share nothing; equal texts
of different records share all; what is repeated in one record only isn't shared; a
record delivered twice counts once; rows without a key are ignored; an empty table
gives an empty result; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import checkpoint_dir, small_batches

SALTS = 8
#: Characters worked on at once; a longer text is a piece of its own.
PIECE = 1 << 19
#: Up to so many keys of records, a list of them is broadcast; a longer one is joined by shuffle.
BROADCAST_KEYS = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Prints:
    """Fingerprints of any stretch of a text."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(_Prints, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self._powers[: n - 1], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * self._inverses[at]).view(np.int64)

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self._inverses[:n]).view(np.int64)


def _sliding(pick: np.ufunc, values: np.ndarray, width: int, fill: int) -> np.ndarray:
    """What pick takes of each width values in a row, from each value on; fill stands beyond the end."""
    n = len(values)
    rows = np.full((-(-n // width) + 1, width), fill, dtype=values.dtype)
    rows.reshape(-1)[:n] = values
    ahead = pick.accumulate(rows, axis=1).reshape(-1)
    rest = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(rest[:n], ahead[width - 1 : width - 1 + n])


def anchors(codes: np.ndarray, ends: np.ndarray, longest: int, prints: _Prints | None = None) -> np.ndarray:
    """Where the fingerprint of the next longest characters is the least of longest places in a row. So any
    2 * longest - 1 characters decide by themselves on an anchor in their first half, and anchors are at most longest
    apart. codes: texts one after another; ends: the last place of each."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    n = len(codes)
    if n < longest:
        return np.zeros(0, dtype=np.int64)
    rest = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    values = np.full(n, high)
    values[: n - longest + 1] = (prints or _Prints(codes)).every(longest)
    values[rest < longest - 1] = high
    least = _sliding(np.minimum, values, longest, high)
    least[rest < 2 * longest - 2] = low
    # a place is an anchor if one of the rows that it stands in has its fingerprint as the least
    return np.flatnonzero(values == _sliding(np.maximum, np.concatenate((np.full(longest - 1, low), least)), longest, low)[:n])


def _pieces(keys: list, texts: list, least: int) -> Iterator[tuple[list, list]]:
    some: list = []
    size = 0
    for key, text in zip(keys, texts):
        if text is None or key is None or len(text) < least or key != key:
            continue
        some.append((key, text))
        size += len(text)
        if size >= PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _anchor_rows(length: int):
    half = length // 2

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in _pieces(batch["key"].tolist(), batch["text"].tolist(), length):
                arrays = [_codes(t) for _, t in some]
                sizes = np.array([len(a) for a in arrays])
                codes = np.concatenate(arrays)
                ends = np.cumsum(sizes)
                prints = _Prints(codes)
                at = anchors(codes, ends - 1, half, prints)
                which = np.searchsorted(ends, at, side="right")
                yield pd.DataFrame({"print": prints.of(at, half), "key": np.array([k for k, _ in some], dtype=np.int64)[which], "place": (at - (ends - sizes)[which]).astype(np.int32)})

    return work


def in_two(rows: DataFrame) -> DataFrame:
    """The rows (print, key, place) whose print another key has, too."""
    # the filter that a join would add to its side only is set before the exchange, so that both sides share one
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).where("print IS NOT NULL AND salt IS NOT NULL").repartition("print", "salt")
    ends = salted.groupBy("print", "salt").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("place").alias("place")).where("place >= 0")
    both = ends.groupBy("print").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    spread = both.select("print", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # the many rows are not sorted: each partition keeps the few shared prints in a table
    return salted.join(spread.hint("shuffle_hash"), ["print", "salt"]).select("print", "key", "place")


def _spread(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows with what prints tells of their print; prints (print, ...), distinct."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["print", "salt"]).drop("salt")


def _window_rows(length: int):
    """The windows that start from low to high places after each anchor."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, jobs in zip(batch["key"], batch["text"], batch["jobs"]):
                codes = _codes(text)
                at, low, high = (np.array([j[c] for j in jobs], dtype=np.int64) for c in ("place", "low", "high"))
                n = high - low + 1
                windows = np.unique(np.repeat(at + low - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                windows = windows[(windows >= 0) & (windows + length <= len(codes))]
                yield pd.DataFrame({"print": _Prints(codes).of(windows, length), "key": np.full(len(windows), key), "place": windows.astype(np.int32)})

    return work


_ROWS = "print long, key long, place int"


def _compared(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(key, place): the windows that two texts have, of those in the ranges (key, place, low, high)."""
    jobs = ranges.groupBy("key").agg(F.collect_list(F.struct("place", "low", "high")).alias("jobs"))
    keys = ranges.select("key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    return in_two(texts.join(jobs, "key").mapInPandas(_window_rows(length), _ROWS)).select("key", "place").distinct()


def shared_windows(frame: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """(key, place): places in each text whose next length characters another text has, enough of them to cover every shared span.

    All windows before an anchor are compared, in all texts that share it, when in one of
    them it is the first or the last of its row. In the third step that is done for anchors
    near a pair of which a window isn't shared, and near the first of a row; but not where
    a compared anchor follows so soon that it has seen all windows, in the same set of texts
    all along."""
    texts = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= length))
    checkpoint_dir(frame.sparkSession)
    small_batches(frame.sparkSession)
    half = length // 2
    found = in_two(texts.mapInPandas(_anchor_rows(length), _ROWS)).distinct().checkpoint()
    order = Window.partitionBy("key").orderBy("place")
    before, after = F.col("place") - F.lag("place").over(order), F.lead("place").over(order) - F.col("place")
    left, right = before.isNull() | (before > half), after.isNull() | (after > half)
    edges = found.withColumn("edge", left | right)
    groups = edges.groupBy("print").agg(F.bool_or("edge").alias("edge"), F.struct(F.bit_xor(F.xxhash64("key")).alias("x"), F.count("*").alias("n")).alias("texts"))
    marked = _spread(found, groups).checkpoint()
    # any shared window that starts before an anchor and not before the last one starts up to half a span length before it
    span = lambda low, high: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
    spans = F.when(F.col("edge"), span(-half, 0)).otherwise(span(0, 0))
    shared = _compared(texts, marked.select("key", "place", spans.alias("span")).select("key", "place", "span.*"), length).checkpoint()
    rows = marked.join(shared.withColumn("sure", F.lit(True)), ["key", "place"], "left").withColumn("sure", F.col("sure").isNotNull())
    # all anchors that tell of a window between two of a row are in that row, or the first of the next
    rows = rows.withColumn("starts", left).withColumn("after", after).withColumn("row", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("key", "row").orderBy("place")
    rest, ahead = order.rowsBetween(1, Window.unboundedFollowing), order.rangeBetween(0, 2 * half)
    begun = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*", F.coalesce(F.lead("sure").over(order), F.lit(False)).alias("sure_b"),
        F.min(F.when(F.col("edge"), F.col("place"))).over(rest).alias("full"),
        (F.min("texts").over(ahead) == F.max("texts").over(ahead)).alias("alike"), F.last(F.when(F.col("starts"), F.struct("place", "texts")), True).over(begun).alias("first"),
    )
    seen = F.col("alike") & F.coalesce(F.col("full") <= F.col("place") + half, F.lit(False))
    open_ = F.coalesce((F.col("after") <= half) & ~(F.col("sure") & F.col("sure_b")) & ~seen, F.lit(False))
    other = F.coalesce((F.col("place") - F.col("first.place") <= half) & (F.col("texts") != F.col("first.texts")), F.lit(False))
    rows = rows.withColumn("open", open_).withColumn("other", other)
    reach = order.rangeBetween(-2 * half, 0)
    low = F.least(F.min(F.when(F.col("open"), F.col("place"))).over(reach), F.when(F.col("other"), F.col("first.place") - half))
    high = F.greatest(F.max(F.when(F.col("open"), F.col("place") + F.col("after"))).over(reach), F.when(F.col("other"), F.col("first.place")))
    late = rows.select("print", "place", low.alias("low"), high.alias("high")).where("low IS NOT NULL AND high IS NOT NULL")
    late = late.select("print", F.greatest(F.col("low") - F.col("place"), F.lit(-half)).alias("low"), F.least(F.col("high") - F.col("place"), F.lit(0)).alias("high")).where("low <= high")
    late = late.groupBy("print").agg(F.min("low").alias("low"), F.max("high").alias("high")).checkpoint()
    if late.isEmpty():
        return shared
    return shared.unionByName(_compared(texts, _spread(found, late).select("key", "place", "low", "high"), length)).distinct()


def shared_amounts(frame: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """(key, shared_chars): how many characters of each text stand in shared spans, each counted once."""
    after = F.lead("place").over(Window.partitionBy("key").orderBy("place"))
    covered = F.least(F.lit(length), F.coalesce(after - F.col("place"), F.lit(length)))
    windows = shared_windows(frame, key, text, length).select("key", covered.alias("n"))
    return windows.groupBy("key").agg(F.sum("n").cast("long").alias("shared_chars")).withColumnRenamed("key", key)
