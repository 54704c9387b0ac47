"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

The words of each item give seeds, hashes of SEED consecutive words.  A whole text
is scanned once; where its seeds meet an item's, the longest matches that do not
overlap are marked again and again, found by Karp-Rabin hashes of the largest
length at which any unmarked match is left.  The marked share of the item's words
is its coverage, whatever the order of the marked passages in the text; from
COVERAGE on, the document holds the item.

The benchmark goes to the executors in blocks of bounded size, one pass over the
documents for each block, so that its size needs no bound.

Defined cases: null or empty texts hold nothing; an item of fewer than SEED words
is never held (it would be found everywhere); items with equal texts are each
reported; null item_ids are reported as null; rows that repeat a doc_id are each
judged; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .textscan import BASE, INVERSE, U64, grams, mix, pieces, powers, scan

SEED, COVERAGE = 5, 0.5
#: Characters of benchmark text sent to the executors at a time.
BLOCK_CHARS = 32 << 20


class Items:
    """Items of one block: their words' hashes, and their seeds sorted by hash."""

    def __init__(self, ids: list, texts: list):
        self.ids, words = ids, scan(pa.array(texts, pa.string()))
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        place = np.arange(len(words.hash)) - words.first[:-1][words.row]
        fits = place + SEED <= np.diff(words.first)[words.row]
        seeds, item = grams(words, SEED)[fits], words.row[fits]
        order = np.argsort(seeds, kind="stable")
        self.seed, self.item, self.place = seeds[order], item[order], place[fits][order]


def _windows(words: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of n free words, and their Karp-Rabin hashes."""
    ends = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(ends[n:] == ends[:-n]) if len(words) >= n else np.zeros(0, dtype=np.int64)
    if not len(at):
        return at, np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(words * powers(BASE, len(words)))])
        return at, mix((sums[at + n] - sums[at]) * powers(INVERSE, len(words))[at])


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> tuple[int, int]:
    """(tiles, words of the item that they cover), longest matches first."""
    free, open_ = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)

    def matches(n):
        ia, ih = _windows(item, free, n)
        ta, th = _windows(text, open_, n)
        hit = np.isin(th, ih)
        return ia, ih, ta[hit], th[hit]

    most, tiles, covered = min(len(item), len(text)), 0, 0
    while most >= least:
        low, high = 0, most  # the largest length with a match: matches of n words hold matches of n - 1
        if len(matches(least)[2]) == 0:
            break
        low = least
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(matches(mid)[2]) else (low, mid - 1)
        ia, ih, ta, th = matches(low)
        where: dict[int, list[int]] = {}
        for a, h in zip(ia.tolist(), ih.tolist(), strict=True):
            where.setdefault(h, []).append(a)
        for t, h in zip(ta.tolist(), th.tolist(), strict=True):
            if not open_[t : t + low].all():
                continue
            left = where.get(h, [])
            while left and not free[left[0] : left[0] + low].all():
                left.pop(0)
            if left and (item[left[0] : left[0] + low] == text[t : t + low]).all():
                a = left.pop(0)
                free[a : a + low], open_[t : t + low] = False, False
                tiles, covered = tiles + 1, covered + low
        most = low - 1
    return tiles, covered


def held(words, items: Items, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(row, item, tiles, covered words) for every item that a text of the batch holds."""
    if not len(words.hash) or not len(items.seed):
        return []
    place = np.arange(len(words.hash)) - words.first[:-1][words.row]
    fits = place + SEED <= np.diff(words.first)[words.row]
    seeds = grams(words, SEED)
    at = np.minimum(np.searchsorted(items.seed, seeds), len(items.seed) - 1)
    hits = np.flatnonzero(fits & (items.seed[at] == seeds))
    out = []
    for row in np.unique(words.row[hits]):
        own = hits[np.searchsorted(words.row[hits], row) : np.searchsorted(words.row[hits], row, side="right")]
        low, high = np.searchsorted(items.seed, seeds[own]), np.searchsorted(items.seed, seeds[own], side="right")
        pairs = np.unique(np.concatenate([np.arange(a, b) for a, b in np.unique(np.stack([low, high]), axis=1).T]))
        near = np.zeros(int(own[-1] - own[0]) + SEED + 1, dtype=bool)
        for k in range(SEED):
            near[own - own[0] + k] = True
        # Only words of a seed can be in a tile; a gap keeps the stretches apart.
        stretch = np.where(near, words.hash[own[0] : own[0] + len(near)] if own[0] + len(near) <= len(words.hash) else np.append(words.hash[own[0] :], np.zeros(own[0] + len(near) - len(words.hash), dtype=U64)), U64(0))
        keep = near | np.append(True, near[:-1])
        text = stretch[keep]
        for item in np.unique(items.item[pairs]):
            whole = items.words[item]
            most = np.zeros(len(whole) + SEED, dtype=bool)
            for k in range(SEED):
                most[items.place[pairs[items.item[pairs] == item]] + k] = True
            if most[: len(whole)].sum() < coverage * len(whole):
                continue
            tiles, covered = tile(whole, text)
            if covered >= coverage * len(whole):
                out.append((int(row), int(item), tiles, covered))
    return out


def blocks(benchmark: DataFrame):
    """The benchmark as broadcast blocks of at most about BLOCK_CHARS characters."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / BLOCK_CHARS)
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        got = block.collect()
        yield spark.sparkContext.broadcast(Items([r.item_id for r in got], [r.text for r in got]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles, coverage) for every document and item that it holds."""
    schema = "doc_id long, item_id long, item_words long, covered long, tiles long, coverage double"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in blocks(benchmark):

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                for piece in pieces(batch):
                    ids = piece.column("doc_id").to_pylist()
                    found = [(ids[r], items.ids[i], len(items.words[i]), c, t, c / len(items.words[i])) for r, i, t, c in held(scan(piece.column("text")), items)]
                    if found:
                        kinds = [pa.int64()] * 5 + [pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "item_words", "covered", "tiles", "coverage"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    for sent in blocks(benchmark):

        def run(batches, sent=sent):
            for batch in batches:
                for piece in pieces(batch):
                    keep = np.ones(piece.num_rows, dtype=bool)
                    keep[[f[0] for f in held(scan(piece.column("text")), sent.value)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
