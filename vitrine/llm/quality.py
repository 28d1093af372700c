"""Quality rules with adaptive thresholds.

Each document is measured (words, symbols, repeated lines, repeated windows of
words).  Fixed base rules reject what is never useful.  All other thresholds
come from the data: for every language and source, mergeable quantile sketches
(histograms over a fixed, bounded scale of integer steps, so that sketches add up
in any order and reruns agree) of each measure and of the length that it is a
share of.

* Word length: a fence ``REACH`` times the spread of the quartiles beyond them,
  and at least a fifth of the median.
* Symbols, repeated lines, repeated windows: most documents have none, so the
  quartiles say little about how far a good one may go.  What they do say is how
  much could hide in them: a share that a document of median length may have
  without showing it is up to ``UNSEEN`` over that length.  The limit is
  ``RATIO`` times the upper quartile or that share, whichever is more.  And it
  must stand in a gap: if more than one in ``GAP`` documents lie in the half
  octave below it, the limit would cut through a bulk that merely tails off, and
  the measure rejects nothing.  That is asked of the source, and of its language
  too, unless the source is large enough to show that it is unlike it: by the
  language's share it would have ``UNSEEN`` such documents or more.

A source's limits are averaged with its language's, and these with the corpus's,
weighted by its documents against ``PRIOR_DOCS``, so a source with few documents
is judged like its language and no number of documents switches a rule on.  None
of the constants was fitted to labels.  The limits are joined back and the
documents filtered.

Everything is DataFrame functions.  The documents are measured in one pass
without a shuffle and staged without their texts; sketches are pre-aggregated
before they are shuffled and hold at most ``STEPS`` rows per group and measure.

Edge cases: null and empty texts have no word and fail the base rules; null
languages and sources are groups of their own; repeated rows are judged alike;
an empty table gives an empty result; very long texts are measured whole; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WINDOW = 8
STEPS = 10_000
_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")
#: The measures that are shares, and the column that each is a share of.
SHARES = {"symbols": "word_chars", "dup_lines": "n_lines", "repeats": "n_words"}
PERCENTILES = (25, 50, 75)
REACH, LEAST_REACH = 8, 5
#: With no occurrence in n places, a share of up to some UNSEEN / n isn't unlikely (the rule of three).
UNSEEN, RATIO, GAP = 3, 8, 500
PRIOR_DOCS = 10
#: Steps of a length's sketch and bins of a share's for each doubling.
LENGTH_STEPS, BINS = 100, 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first included."""

    def of_hashes(hw: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(WINDOW)])
        return let(F.transform(F.sequence(F.lit(0), F.size(hw) - WINDOW), window), of_windows)

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        at = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    plain = F.coalesce(F.col(text), F.lit(""))
    flat = plain
    for c in _SPACES:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    words = F.when(F.trim("flat") == "", F.array().cast("array<string>")).otherwise(F.split(F.trim("flat"), " +"))
    # a line with a word keeps something when white space is taken from its ends
    lines = F.filter(F.split("plain", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "lang", "source", plain.alias("plain"), flat.alias("flat"))
    return df.select(
        "doc_id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("plain", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "lang", "source", "w.*", "word_chars", "n_symbols", "l.*")


def steps(rows: DataFrame) -> DataFrame:
    """Add the measures as integers from 0 to STEPS."""
    share = lambda a, b: F.least(F.lit(STEPS), F.coalesce(F.expr(f"({a} * {STEPS}) div nullif({b}, 0)"), F.lit(0))).cast("int")
    return rows.withColumns(
        {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": F.least(F.lit(STEPS), F.coalesce(F.expr("(word_chars * 200) div nullif(n_words, 0)"), F.lit(0))).cast("int")}
    )


def sketch(rows: DataFrame) -> DataFrame:
    """The mergeable sketches: lang, source, measure, step, n; a share's length has one of its own, in steps of its logarithm."""
    of = {m: F.col(m) for m in (*SHARES, "word_length")}
    of |= {f"{m}_of": F.floor(F.log2(F.greatest(F.col(c), F.lit(1))) * LENGTH_STEPS).cast("int") for m, c in SHARES.items()}
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("step")) for m, c in of.items()]))
    return rows.select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.measure", "e.step").agg(F.count("*").alias("n"))


def percentiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Percentiles of each group's merged sketch: by..., measure, docs, p25, p50, p75."""
    whole = Window.partitionBy(*by, "measure")
    merged = sketches.groupBy(*by, "measure", "step").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("upto", F.sum("n").over(whole.orderBy("step"))).withColumn("docs", F.sum("n").over(whole))
    reached = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * p, F.col("step"))).alias(f"p{p}")
    return merged.groupBy(*by, "measure").agg(F.max("docs").alias("docs"), *map(reached, PERCENTILES))


def limits_of(sketches: DataFrame, by: list[str], name: str) -> DataFrame:
    """by... and, as a struct called name, docs, word_length_low and _high and the logarithm of each share's high limit."""
    of = lambda m, p: F.max(F.when(F.col("measure") == m, F.col(p)))
    far = F.greatest(REACH * (of("word_length", "p75") - of("word_length", "p25")), of("word_length", "p50") / LEAST_REACH)
    found = {"docs": of("word_length", "docs").cast("double"), "word_length_low": of("word_length", "p25") - far, "word_length_high": of("word_length", "p75") + far}
    for m in SHARES:
        unseen = F.lit(float(UNSEEN * STEPS)) / F.pow(F.lit(2.0), of(f"{m}_of", "p50") / LENGTH_STEPS)
        found[m] = F.log2(RATIO * F.greatest(of(m, "p75"), unseen))
    return percentiles(sketches, by).groupBy(*by).agg(F.struct(*[c.alias(n) for n, c in found.items()]).alias(name))


def crowding(sketches: DataFrame, by: list[str], name: str) -> DataFrame:
    """by..., measure, bin, and as name the documents of the group in the half octave below the bin; bins without any aren't listed."""
    shares = sketches.where(F.col("measure").isin(*SHARES) & (F.col("step") > 0))
    own = F.floor(F.log2("step") * BINS).cast("int")
    bins = shares.groupBy(*by, "measure", own.alias("own")).agg(F.sum("n").alias("n"))
    spread = bins.select(*by, "measure", F.explode(F.sequence(F.col("own") + 1, F.col("own") + BINS // 2)).alias("bin"), "n")
    return spread.groupBy(*by, "measure", "bin").agg(F.sum("n").alias(name))


def fences(sketches: DataFrame) -> DataFrame:
    """lang, source, word_length_low and _high, and each share's high limit (null where it doesn't stand in a gap)."""
    own, corpus = limits_of(sketches, ["lang", "source"], "own"), limits_of(sketches, [], "corpus")
    wide = limits_of(sketches, ["lang"], "wide").withColumnRenamed("lang", "w_lang")
    # one row for the corpus
    rows = own.join(wide, F.col("lang").eqNullSafe(F.col("w_lang"))).crossJoin(F.broadcast(corpus))
    names = ("word_length_low", "word_length_high", *SHARES)
    averaged = lambda a, n, b: (a * n + b * PRIOR_DOCS) / (n + PRIOR_DOCS)
    limits = rows.select(
        "lang", "source", F.col("own.docs").alias("docs"), F.col("wide.docs").alias("all_docs"), *[averaged(F.col(f"own.{m}"), F.col("own.docs"), averaged(F.col(f"wide.{m}"), F.col("wide.docs"), F.col(f"corpus.{m}"))).alias(m) for m in names]
    )
    shares = limits.select("lang", "source", "docs", "all_docs", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("log")) for m in SHARES])).alias("x")).select("lang", "source", "docs", "all_docs", "x.*")
    shares = shares.withColumn("bin", F.floor(F.col("log") * BINS).cast("int"))
    for by, name in ((["lang", "source"], "near"), (["lang"], "all_near")):
        found = crowding(sketches, by, name).withColumnsRenamed({c: f"c_{c}" for c in (*by, "measure", "bin")})
        at = (F.col("measure") == F.col("c_measure")) & (F.col("bin") == F.col("c_bin"))
        for c in by:
            at = at & F.col(c).eqNullSafe(F.col(f"c_{c}"))
        shares = shares.join(found, at, "left").drop(*[f"c_{c}" for c in (*by, "measure", "bin")])
    near, all_near = F.coalesce("near", F.lit(0)), F.coalesce("all_near", F.lit(0))
    told_apart = F.col("docs") * all_near >= UNSEEN * F.col("all_docs")
    stands = (near * GAP <= F.col("docs")) & ((all_near * GAP <= F.col("all_docs")) | told_apart)
    pick = lambda m: F.max(F.when((F.col("measure") == m) & stands, F.pow(F.lit(2.0), F.col("log")))).alias(f"{m}_high")
    high = shares.groupBy("lang", "source").agg(*map(pick, SHARES)).withColumnsRenamed({"lang": "h_lang", "source": "h_source"})
    same = F.col("lang").eqNullSafe(F.col("h_lang")) & F.col("source").eqNullSafe(F.col("h_source"))
    return limits.select("lang", "source", "word_length_low", "word_length_high").join(high, same).drop("h_lang", "h_source")


def judge_quality(docs: DataFrame, least_words: int = 20, most_repeated: int = 30, text: str = "text") -> DataFrame:
    """The counts, base_failed, and kept: neither a base rule nor a fence of the document's group rejects it."""
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    rows = staged(steps(measure(docs, text)).withColumn("base_failed", base), "quality")
    limits = fences(sketch(rows.where(~F.col("base_failed")))).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    beyond = (F.col("word_length") < F.col("word_length_low")) | (F.col("word_length") > F.col("word_length_high"))
    for m in SHARES:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))).alias("kept"))
