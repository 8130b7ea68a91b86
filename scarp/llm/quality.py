"""Quality rules with adaptive thresholds per language and source.

Each document is measured (word length, symbols per word, repeated lines, repeated 3-word windows; in thousandths, as
integers). A sketch of a group counts its documents per bin of a measure, where a bin keeps the leading ``SIGNIFICANT``
bits of the value: the number of bins is bounded, quantiles are exact to one part in 128, and sketches merge by adding
counts, so a language's sketch is the sum of its sources' and the corpus's the sum of all. A document is held against the
fences of its (language, source); where those have under ``MIN_DOCS`` documents, against its language's, else the corpus's.
A fence lies ``REACH`` quartile distances beyond the quartile, the distance being at least the measure's ``LEAST``.

Fixed base rules come first: under 50 words, or over half of the words in repeated 3-word windows, fail. Sketches are of
all documents that have a word. Null text has no words and fails; null language or source is a group of its own; repeated
rows count as rows; an empty table gives an empty result.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp.llm.texts import apart, lean, raw_texts, stored, words

MIN_WORDS, MAX_REPEAT = 50, 50
SIGNIFICANT, MIN_DOCS, REACH = 8, 100, 5
#: Least quartile distance of each measure, in thousandths, and whether low values are fenced too.
LEAST = {"word_length": (150, True), "symbols": (20, False), "dup_lines": (80, False), "repeats": (80, False)}
_SYMBOLS = [bytes([c]) for c in b"[#*$%&|<>]"[1:-1]]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(raw: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a text."""
    w = words(raw)
    letters = b"".join(w)
    chars = len(letters.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    threes = list(zip(w, w[1:], w[2:]))
    repeated = 0
    if len(set(threes)) < len(threes):
        seen, end = Counter(threes), 0
        for i, t in enumerate(threes):
            if seen[t] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(w), chars, sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, _hash, counts.., base_failed) per row; _hash tells apart texts under one doc_id."""
    names = ["doc_id", "lang", "source", "_hash", *_BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*map(measure, raw_texts(b.column(4))))) or [()] * len(_BASE)
            yield pa.record_batch([*(b.column(i) for i in range(4)), *(pa.array(c, pa.int64()) for c in got)], names)

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), _hash(text).alias("_hash"), text.alias("text"))
    kinds = "doc_id long, lang string, source string, _hash long, " + ", ".join(f"{n} long" for n in _BASE)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return slim.mapInArrow(lean(run), kinds).withColumn("base_failed", failed)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _values() -> dict[str, Column]:
    per = lambda a, b: F.expr(f"1000 * {a} div {b}")
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def _bin(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, name, bin, n): the sketch of each measure in each group."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), _bin(v).alias("bin")) for n, v in _values().items()]))
    return (measured.where("n_words > 0").select("lang", "source", each.alias("m"))
            .groupBy("lang", "source", "m.name", "m.bin").agg(F.count(F.lit(1)).alias("n")))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Fences of each measure by the merged sketches of ``keys``; one row per group."""
    merged = sketch.groupBy(*keys, "name", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "name")
    run = merged.select("*", F.sum("n").over(w.orderBy("bin")).alias("run"), F.sum("n").over(w).alias("all"))
    at = lambda q: F.min(F.when(4 * F.col("run") >= q * F.col("all"), F.col("bin")))
    q = run.groupBy(*keys, "name").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("docs"))
    least, both = (F.coalesce(*[F.when(F.col("name") == n, F.lit(v[i])) for n, v in LEAST.items()]) for i in range(2))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    sides = q.select(*keys, "name", "docs", F.when(both, F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    pick = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    return sides.groupBy(*keys).agg(F.max("docs").alias("docs"), *[
        F.struct(pick(n, "low").alias("low"), pick(n, "high").alias("high")).alias(n) for n in LEAST])


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, word_length, symbols, ..): the fences that hold for each group that occurs."""
    sketch = stored(sketches(measured), "quality-sketch")
    own, lang = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"])
    every = _fences(sketch.withColumn("all_of", F.lit(0)), ["all_of"])
    by_lang = lang.select(F.col("lang").alias("_l"), F.struct(*LEAST).alias("_lang"), F.col("docs").alias("_n"))
    level = (F.when(F.col("docs") >= MIN_DOCS, F.struct(*LEAST)).when(F.col("_n") >= MIN_DOCS, F.col("_lang"))
             .otherwise(every.select(F.struct(*LEAST)).scalar()))
    return own.join(by_lang, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", "source", level.alias("fence"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the text's hash."""
    measured = stored(measures(docs), "quality-measures")
    limits = thresholds(measured).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "fence")
    values, ok = _values(), F.lit(True)
    for n in LEAST:
        fence = F.col("fence")[n]
        ok &= (values[n] <= fence["high"]) & F.coalesce(values[n] >= fence["low"], F.lit(True))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(ok, F.lit(False)))
    return (measured.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("doc_id", *_BASE, "base_failed", kept.alias("kept"), "_hash"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    good = verdicts(docs).where("kept").select(doc.alias("_doc"), "_hash").distinct()
    rows, names = apart(docs, ("doc_id", "text"))
    keyed = rows.withColumns({"_doc": doc, "_hash": _hash(F.col("text").cast("string"))})
    return keyed.join(good, ["_doc", "_hash"], "left_semi").select(*names).toDF(*docs.columns)
