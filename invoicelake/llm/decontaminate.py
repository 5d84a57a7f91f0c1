"""Benchmark decontamination: windows of templates, in which numbers, names and units are typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invoicelake.llm.common import hash_spans, mix, shingles_of, slices, small_batches, stored, text_bytes
from invoicelake.llm.components import beside

#: Template words of a window, and how many of them must not be placeholders.
WINDOW, LITERALS = 8, 4
#: Consecutive windows that tell a leak (13 words), or the share of an item's windows, in percent.
RUN, SHARE = 6, 50
#: Items of fewer words are reported, but `without_leaks` keeps documents that hold only those.
LEAST_WORDS = 8
#: Bits of the map in which tasks look up windows, at every size of the benchmark: 8 MB.
MAP_BITS = 26
# Words that are units after a number.
UNITS = (
    "%", "cm", "mm", "km", "m", "ft", "in", "inches", "feet", "meters", "metres", "miles", "kg", "g", "mg", "lb", "lbs",
    "pounds", "grams", "tons", "l", "ml", "liters", "litres", "gallons", "cups", "seconds", "minutes", "hours", "days",
    "weeks", "months", "years", "dollars", "cents", "euros", "usd", "eur", "percent", "degrees", "mph", "kmh", "mb", "gb",
    "horas", "minutos", "metros", "heures", "mètres", "stunden", "minuten", "meter", "euro",
)
_WORD, _NUMBER, _NAME, _UNIT = range(4)
KINDS = ("word", "number", "name", "unit")
_DIGIT, _ALPHA, _UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([0, *map(len, raw)])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])


@dataclass
class Templates:
    """Template words of texts in a row: kind, hash, first and end byte; first word of each text; windows of each text."""

    raw: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    values: np.ndarray
    windows: np.ndarray
    have: np.ndarray
    usable: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and place in the text of each window."""
        text = np.repeat(np.arange(len(self.have)), self.have)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(self.have) - self.have, self.have)

    def searched(self, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, place, hash of the windows of `width` words, and whether it is that of the template; for both.

        Every window has a hash of its words with their own values, in lower case. Where LITERALS words or more are
        plain, or the whole text has fewer than WINDOW words, it has one of its template, too.
        """
        windows, have = (self.windows, self.have) if width == WINDOW else shingles_of(self.words, self.bounds, width)
        own = mix(shingles_of(self.values, self.bounds, width)[0] ^ mix(np.uint64([width])))
        text = np.repeat(np.arange(len(have)), have)
        place = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have)
        if width == WINDOW:
            plain, full, whole = self.usable, np.ones(len(text), bool), windows
        else:
            literal = np.concatenate(([0], np.cumsum(self.kind == _WORD)))
            at = self.bounds[text] + place
            plain = literal[np.minimum(at + width, len(self.kind))] - literal[at] >= LITERALS
            full, whole = np.diff(self.bounds)[text] >= width, mix(windows ^ np.uint64(width))
        for keep, value, is_template in ((full, own, False), (full & plain, whole, True)):
            yield text[keep], place[keep], value[keep], np.full(int(keep.sum()), is_template)

    def slots(self, text: int, place: int, width: int) -> list[dict]:
        """Placeholders of a window and what stands there."""
        a = self.bounds[text] + place
        b = min(a + width, self.bounds[text + 1])
        return [
            {"kind": KINDS[self.kind[k]], "at": int(k - a), "value": self.raw[self.first[k] : self.end[k]].tobytes().decode("utf-8", "replace")}
            for k in range(a, b)
            if self.kind[k] != _WORD
        ]


def templates(texts: pa.Array, opening_name: bool = False) -> Templates:
    """Numbers (digits with points or commas between them) and words of letters; other characters part them.

    A word with a capital first letter that doesn't start a sentence or line is a name, a unit word after a number a
    unit. With `opening_name` a text's first word counts as within a sentence. All else is compared in lower case. Windows with fewer than LITERALS plain words are not usable, unless the
    text is that short.
    """
    raw, starts = text_bytes(texts)
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    digit, alpha = _DIGIT[raw], _ALPHA[raw] | (raw == ord("%"))
    joint = np.zeros(n, bool)
    joint[1:-1] = ((raw[1:-1] == ord(".")) | (raw[1:-1] == ord(","))) & digit[:-2] & digit[2:] & ~edge[1 : n - 1] & ~edge[2:n]
    group = np.where(digit | joint, 1, np.where(alpha, 2, 0))
    change = np.ones(n + 1, bool)
    change[1:n] = (group[1:] != group[:-1]) | edge[1:n]
    cut = np.flatnonzero(change)
    first, end = cut[:-1], cut[1:]
    solid = group[first] > 0 if n else np.zeros(0, bool)
    first, end = first[solid], end[solid]
    follows = np.zeros(n, bool)  # bytes of C3 80 to C3 9E, the capital letters of Latin-1
    follows[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    lower = raw + np.where(_UPPER[raw] | follows, np.uint8(32), np.uint8(0)).astype(np.uint8)
    hashes = hash_spans(lower, first, end)
    kind = np.full(len(first), _WORD)
    numbers = group[first] == 1 if n else np.zeros(0, bool)
    kind[numbers] = _NUMBER
    capital = _UPPER[raw[first]] | np.append(follows, False)[first + 1]
    stops = np.concatenate(([0], np.cumsum(np.isin(raw, np.frombuffer(b".!?\n:", np.uint8)))))
    bounds = np.searchsorted(first, starts)
    inside = np.zeros(len(first), bool)
    inside[1:] = stops[first[1:]] == stops[end[:-1]]
    opening = bounds[:-1][np.diff(bounds) > 0]
    inside[opening] = opening_name
    kind[capital & inside & (kind == _WORD)] = _NAME
    units = np.sort(_hash_words(list(UNITS)))
    at = np.minimum(np.searchsorted(units, hashes), len(units) - 1)
    unit = np.zeros(len(first), bool)
    unit[1:] = (units[at[1:]] == hashes[1:]) & numbers[:-1]
    unit[opening] = False
    kind[unit] = _UNIT
    words = np.where(kind == _WORD, hashes, kind.astype(np.uint64))
    windows, have = shingles_of(words, bounds, WINDOW)
    literal = np.concatenate(([0], np.cumsum(kind == _WORD)))
    text = np.repeat(np.arange(len(have)), have)
    place = bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have)
    stop = np.minimum(place + WINDOW, bounds[text + 1])
    usable = (literal[stop] - literal[place] >= LITERALS) | (np.diff(bounds)[text] < WINDOW)
    return Templates(raw, kind, first, end, bounds, words, hashes, windows, have, usable)


_SLOTS = "array<struct<kind:string,at:int,value:string>>"
_SLOTS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("value", pa.string())]))


def _windows(
    rows: DataFrame, key: str, wanted: np.ndarray | None, opening_name: bool = False, widths: list[int] | None = None
) -> DataFrame:
    """Windows of (key, text): key, place, hash, slots, template; only those that the map `wanted` may hold, if given.

    Windows have WINDOW words and `widths`; without `widths`, a text of fewer than WINDOW words also has that of its length.
    `template` is false for windows of own values, which have no slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = templates(part.column(1), opening_name)
                counts = np.diff(made.bounds)
                short = widths if widths is not None else np.unique(counts[(counts > 0) & (counts < WINDOW)]).tolist()
                for width in (WINDOW, *short):
                    for text, place, window, plain in made.searched(width):
                        keep = np.ones(len(window), bool) if widths is not None or width == WINDOW else counts[text] == width
                        if wanted is not None:
                            for bit in _bits(window):
                                keep = keep & (wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                        text, place, window, plain = (x[keep] for x in (text, place, window, plain))
                        slots = [made.slots(t, p, width) if q else [] for t, p, q in zip(text.tolist(), place.tolist(), plain.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(text)), pa.array(place), pa.array(window.view(np.int64)), pa.array(slots, _SLOTS_ARROW), pa.array(plain)],
                            names=[key, "place", "window", "slots", "template"],
                        )

    return rows.mapInArrow(run, f"{key} bigint, place bigint, window bigint, slots {_SLOTS}, template boolean")


def _bits(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a window in the map."""
    most = np.uint64((1 << MAP_BITS) - 1)
    return window & most, window >> np.uint64(MAP_BITS) & most


def _window_map(own: DataFrame) -> np.ndarray:
    """The map of a table's windows, of a fixed size; put together by Spark, one row for 64 bits at most."""
    most = (1 << MAP_BITS) - 1
    bits = F.array(F.col("window").bitwiseAND(most), F.shiftright("window", MAP_BITS).bitwiseAND(most))
    rows = own.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    found = rows.toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def _lengths(items: DataFrame) -> DataFrame:
    """Rows (item_id, words): template words of each item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counts = np.diff(templates(part.column(1)).bounds)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.array(counts[some].astype(np.int64))], names=["item_id", "words"]
                )

    return items.mapInArrow(run, "item_id bigint, words bigint")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names or units: one row per pair.

    Columns: doc_id, item_id, words (of the item), windows (of it), matched (distinct windows of it found), exact (found
    with the item's own values). `docs` has (doc_id, text), `benchmark` (item_id, text); null texts and items without
    words match nothing, rows with a null id are left out, repeated rows count once.

    On one alignment, windows that match one after the other are a run. Runs of windows with the item's own values, in
    any case, count as they are. Runs of templates count if their slots are consistent: in the run each value of the
    item is replaced by one value, and no two by the same. A pair is a leak if a run has RUN windows, or the runs of an
    alignment hold SHARE percent of the item's windows. Windows with fewer than LITERALS plain words have no template.
    Items of fewer than WINDOW words are searched as a whole at their length, so a one-word item is found wherever its
    word stands; `words` tells them.

    Windows are looked up in a map of the benchmark's, of one size for every benchmark, and what it lets through is
    joined by hash. Groups are by document and item, so no common item makes a large group.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # an item's first word may stand within a sentence of a document
    own = _windows(items, "item_id", None).union(_windows(items, "item_id", None, opening_name=True)).distinct()
    own = stored(own.withColumnsRenamed({"place": "item_place", "slots": "item_slots"}), "benchmark-windows")
    sizes = stored(_lengths(items).groupBy("item_id").agg(F.max("words").alias("words")), "benchmark-lengths")
    totals = own.groupBy("item_id").agg(
        F.countDistinct("item_place").alias("windows"), F.countDistinct(F.when(F.col("template"), F.col("item_place"))).alias("templates")
    ).join(sizes, "item_id")
    widths = sorted(r["words"] for r in sizes.where(F.col("words") < WINDOW).select("words").distinct().collect())  # at most 7
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    met = stored(
        beside(_windows(rows, "doc_id", _window_map(own), widths=widths), own, ["window", "template"], "inner")
        .withColumn("shift", F.col("place") - F.col("item_place"))
        .select("doc_id", "item_id", "template", "shift", "item_place", "slots", "item_slots"),
        "met-windows",
    )
    pair, line = ["doc_id", "item_id"], ["doc_id", "item_id", "template", "shift"]
    # a run of consecutive places has a constant difference of place and rank; a line has at most the item's windows
    rank = F.dense_rank().over(Window.partitionBy(*line).orderBy("item_place"))
    placed = met.withColumn("run", F.col("item_place") - rank)
    swaps = (
        placed.select(*line, "run", F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
        .select(*line, "run", F.concat_ws(":", "s.item_slots.kind", "s.item_slots.value").alias("was"), F.concat_ws(":", "s.slots.kind", "s.slots.value").alias("now"))
        .distinct()
    )
    one_to_one = swaps.groupBy(*line, "run").agg(
        F.count("*").alias("n"), F.countDistinct("was").alias("from"), F.countDistinct("now").alias("to"),
        F.bool_and(F.col("was") == F.col("now")).alias("same"),
    )
    runs = (
        placed.groupBy(*line, "run").agg(F.countDistinct("item_place").alias("size"))
        .join(one_to_one, [*line, "run"], "left")
        .where("n IS NULL OR (n = `from` AND n = `to`)")
    )
    lines = runs.groupBy(*line).agg(
        F.max("size").alias("longest"), F.sum("size").alias("matched"), F.bool_and(F.coalesce("same", F.lit(True))).alias("same")
    )
    found = lines.join(totals, "item_id").where(
        (F.col("longest") >= RUN) | (100 * F.col("matched") >= SHARE * F.col("windows"))
        | (F.col("template") & (100 * F.col("matched") >= SHARE * F.col("templates")))
    )
    return found.groupBy(*pair).agg(
        F.max("words").alias("words"), F.max("windows").alias("windows"), F.max("matched").alias("matched"),
        F.bool_or(~F.col("template") | F.col("same")).alias("exact"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` without the documents that hold a benchmark item of `least_words` words or more; rows without an id stay."""
    held = leaks(docs, benchmark).where(F.col("words") >= least_words)
    found = stored(held.select("doc_id").distinct(), "leaks")
    return beside(docs, found, "doc_id", "left_anti").select(*docs.columns)
