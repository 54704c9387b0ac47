"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every signal of a document is computed in its own row, from its whole text.  The
cut-offs come from labelled documents: for each stratum (language), signal and
candidate cut-off, the rejected among the labelled-good are counted over all
labels, and the cut-off is admitted only if the exact binomial test rejects "the
false rejection rate exceeds ALPHA / number of signals" at level DELTA / number of
tests (Bonferroni over strata, signals and cut-offs).  So, with probability
1 - DELTA at least, no stratum loses more than ALPHA of its good documents to the
admitted rules together.  Of the admitted cut-offs of a signal, the one that rejects
most of the bad documents, less PRICE times the share of good ones, is used.

Defined cases: a null text has no words; a stratum without enough labels gets no
cut-off, so that only the base rules reject there; a null language is a stratum of
its own, apart from an empty one; several labels of a document count as one, good if any says so; null
labels are ignored; rows that repeat a doc_id are each judged, but are one trial of a stratum, rejected if
any is; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, table

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
ALPHA, DELTA = 0.05, 0.05
#: Of the admitted cut-offs that with the largest (share of bad rejected - PRICE * share of good rejected) is used, if that is above 0.
PRICE = 20
#: Signal -> candidate cut-offs, lenient to strict; a document is rejected above the cut-off.
CUTS = {
    "symbols_per_word": (1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_line_share": (0.7, 0.5, 0.3, 0.2, 0.1),
    "repeat_share": (0.25, 0.2, 0.15, 0.1, 0.05),
    "mean_word": (15.0, 12.0, 10.0, 9.0, 8.0),
    "bangs_per_word": (0.5, 0.3, 0.2, 0.1, 0.05),
}

def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def positions(s: Column) -> Column:
        return F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["p"]))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    found = let(F.array_sort(pairs), positions)
    return F.aggregate(F.array_sort(F.filter(found, lambda p: p.isNotNull())), zero, step)["n"]


def signals(docs: DataFrame, into: str = "_tm_q") -> DataFrame:
    """docs with a struct column of the counts and signals of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumn("_tm_w", F.array_remove(F.split(text, WHITE), ""))
    w = F.col("_tm_w")
    n = F.size(w)
    windows = F.transform(F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    repeat = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    symbols = F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", ""))
    bangs = F.length(F.regexp_replace(text, r"[^!]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    made = words.withColumn("_tm_c", F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup.alias("lines"), repeat.cast("long").alias("n_repeat_words"), bangs.alias("bangs"))).drop("_tm_w")
    c = F.col("_tm_c")
    per_word = lambda x: F.when(c["n_words"] > 0, x / c["n_words"]).otherwise(0.0)
    return made.withColumn(into, F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["lines"]["dup"].cast("long").alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        ((c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])).alias("base_failed"),
        per_word(c["n_symbols"]).alias("symbols_per_word"), F.when(c["lines"]["n"] > 0, c["lines"]["dup"] / c["lines"]["n"]).otherwise(0.0).alias("dup_line_share"),
        per_word(c["n_repeat_words"]).alias("repeat_share"), per_word(c["word_chars"]).alias("mean_word"), per_word(c["bangs"]).alias("bangs_per_word"),
    )).drop("_tm_c")


#: log(n!) less Stirling's formula, for n below 16.
ROUND_OFF = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def _log_pmf(k: Column, n: Column, rate: float) -> Column:
    """log P(X = k) for X binomial(n, rate) and 0 < k < n, by Loader's saddle point form, which loses no digits for large n."""

    def off(x):
        series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (x * x)) / (x * x)) / (x * x)) / x
        return F.when(x < 16, F.get(F.array(*[F.lit(v) for v in ROUND_OFF]), x.cast("int"))).otherwise(series)

    def apart(x, mean):
        return x * F.log1p((x - mean) / mean) - (x - mean)

    a, b, c = k.cast("double"), (n - k).cast("double"), n.cast("double")
    return off(c) - off(a) - off(b) - apart(a, c * rate) - apart(b, c * (1 - rate)) + 0.5 * F.log(c / (2 * math.pi * a * b))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), exact at every size; 1 where k / n >= rate.

    Terms fall from k downwards; those more than 12 standard deviations below k are less than 1e-30 of the sum.
    """
    n_terms = F.least(k, F.ceil(12 * F.sqrt(n * rate)) + 64)
    terms = F.when(n_terms > 0, F.sequence(k, k - n_terms + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    step = lambda acc, i: let(acc["t"] * i / (n - i + 1) * ((1 - rate) / rate), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s")))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    top = F.when(k == 0, n * math.log1p(-rate)).otherwise(_log_pmf(k, n, rate))
    return F.when((n == 0) | (k >= n * rate), 1.0).otherwise(F.exp(top) * total)


def thresholds(measured: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(stratum, one cut-off or null for each signal) from measured (doc_id, stratum, signals) and labels (doc_id, quality)."""
    voted = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    # One trial for each labelled document of a stratum.
    seen = measured.join(voted, "doc_id").groupBy("stratum", "doc_id").agg(F.first("good").alias("good"), *[F.max(c).alias(c) for c in CUTS])
    counts = [F.sum(F.col("good")).alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad")]
    cells = [(s, cut) for s, cuts in CUTS.items() for cut in cuts]
    for i, (s, cut) in enumerate(cells):
        counts += [F.count_if((F.col(s) > cut) & (F.col("good") == 1)).alias(f"g{i}"), F.count_if((F.col(s) > cut) & (F.col("good") == 0)).alias(f"b{i}")]
    by = scratch.save(seen.groupBy("stratum").agg(*counts))
    tests = by.count() * len(cells)
    cell = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(cut).alias("cut"), F.col(f"g{i}").alias("g"), F.col(f"b{i}").alias("b")) for i, (s, cut) in enumerate(cells)])
    rows = by.select("stratum", F.col("n_good").cast("long"), F.col("n_bad").cast("long"), F.explode(cell).alias("c")).select("stratum", "n_good", "n_bad", "c.*")
    p = binomial_tail(F.col("g"), F.col("n_good"), ALPHA / len(CUTS))
    gain = F.col("b") * F.col("n_good") - PRICE * F.col("g") * F.col("n_bad")
    good = rows.where(p <= DELTA / max(1, tests)).withColumn("gain", gain).where("gain > 0")
    return by.select("stratum").join(good.groupBy("stratum").agg(*[F.max_by(F.when(F.col("signal") == s, F.col("cut")), F.when(F.col("signal") == s, F.struct("gain", "cut"))).alias(f"cut_{s}") for s in CUTS]), "stratum", "left").withColumnRenamed("stratum", "of_stratum")


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def verdict(q: str) -> Column:
    """Kept: by the base rules and by the cut-offs of the document's stratum."""
    broken = F.lit(False)
    for s in CUTS:
        broken = broken | F.coalesce(F.col(f"{q}.{s}") > F.col(f"cut_{s}"), F.lit(False))
    return ~F.col(f"{q}.base_failed") & ~broken


def op5(spark, sf_dir):
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    measured = scratch.save(signals(docs).select("doc_id", _stratum().alias("stratum"), "_tm_q"))
    cuts = scratch.save(thresholds(measured.select("doc_id", "stratum", "_tm_q.*"), table(spark, sf_dir, "labels"), scratch))
    judged = measured.join(cuts, F.col("stratum") == F.col("of_stratum"), "left")
    return judged.select("doc_id", "_tm_q.n_words", "_tm_q.word_chars", "_tm_q.n_symbols", "_tm_q.n_dup_lines", "_tm_q.n_repeat_words", "_tm_q.base_failed", verdict("_tm_q").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    Documents are written beside their signals and filtered when read again: a filter on
    signals still to be computed would be pushed into their computation and repeat it.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_tm_doc")
    measured = scratch.save(signals(docs.select(F.col("doc_id").cast("long"), "text", _stratum().alias("stratum"), own)).drop("text"))
    cuts = scratch.save(thresholds(measured.select("doc_id", "stratum", "_tm_q.*"), labels, scratch))
    judged = measured.join(cuts, F.col("stratum") == F.col("of_stratum"), "left")
    return judged.where(verdict("_tm_q")).select("_tm_doc.*")


_SPLIT = "'[\\x20\\x09-\\x0D]+'"
_SIGNALS = {
    "symbols_per_word": "case when n_words > 0 then n_symbols / n_words else 0 end", "dup_line_share": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end",
    "repeat_share": "case when n_words > 0 then n_repeat_words / n_words else 0 end", "mean_word": "case when n_words > 0 then word_chars / n_words else 0 end",
    "bangs_per_word": "case when n_words > 0 then bangs / n_words else 0 end",
}
_RATE = ALPHA / len(CUTS)
#: Every cell's tail is summed over all its terms.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce('=' || lang, '') as stratum from documents),
w as (select *, list_filter(string_split_regex(text, {_SPLIT}), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
places as (select r, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from w),
windows as (select r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as v from places),
twice as (select r, i from (select *, count(*) over (partition by r, v) as k from windows) where k > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
base as (select w.r, doc_id, stratum, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) as n_symbols,
  length(text) - length(replace(text, '!', '')) as bangs, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join covered using (r)),
measured as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed, {", ".join(f"{e} as {s}" for s, e in _SIGNALS.items())} from base),
voted as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by 1),
trial as (select stratum, doc_id, any_value(good) as good, {", ".join(f"max({s}) as {s}" for s in CUTS)} from measured join voted using (doc_id) group by 1, 2),
cuts(signal, cut) as (values {", ".join(f"('{s}', {c}::double)" for s, cs in CUTS.items() for c in cs)}),
long as (unpivot trial on {", ".join(CUTS)} into name signal value v),
cell as (select stratum, signal, cut, count(*) filter (good = 1) as n_good, count(*) filter (good = 0) as n_bad, count(*) filter (good = 1 and v > cut) as g, count(*) filter (good = 0 and v > cut) as b
  from long join cuts using (signal) group by 1, 2, 3),
tail as (select *, case when n_good = 0 or g >= n_good * {_RATE!r} then 1 else list_sum(list_transform(range(0, g + 1), lambda i: exp(case when i = 0 or i = n_good then 0 else lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) end
  + i * ln({_RATE!r}) + (n_good - i) * ln({1 - _RATE!r})))) end as p, b * n_good - {PRICE} * g * n_bad as gain, count(*) over () as tests from cell),
chosen as (select stratum, signal, arg_max(cut, (gain, cut)) as cut from tail where p <= {DELTA} / tests and gain > 0 group by 1, 2),
broken as (select distinct r from (unpivot measured on {", ".join(CUTS)} into name signal value v) join chosen using (stratum, signal) where v > cut)
select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from broken) as kept from measured
"""
