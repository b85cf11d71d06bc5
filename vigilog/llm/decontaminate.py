"""Benchmark decontamination: a BM25 index of test items, queried by every passage of every text.

Items are the indexed side. Each term's postings are in item order and cut into blocks that know their
largest weight. A passage first gets an upper bound for each block of items at once, the sum of its
distinct terms' block maxima; passages that no block can save are done. For the others,
block-max WAND walks the postings and scores just the items that can reach their threshold. What it
retrieves is verified by the word shingles of the item's question and answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import ship_code, table

#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 64, 32
K1, B = 1.2, 0.75
#: A passage retrieves an item at this share of the score the item gives itself. An item longer than
#: a passage can show is measured by the part that fits.
THRESHOLD, FITS = 0.6, 48
SHINGLE = 5
#: Shares of the question's and of the answer's shingles in the text; or of the question's alone.
QUESTION, ANSWER, QUESTION_ALONE = 0.6, 0.5, 0.8
#: Shorter items prove nothing and are not looked for.
LEAST_WORDS = 8
#: Items of a broadcast index, whatever the size of the benchmark: more go into further indexes.
SHARD_ITEMS, SHARD_WORDS = 20_000, 500_000
BLOCKS = 64
#: Passages that are bounded together.
ROUND = 256
HITS = "passages bigint, hits array<struct<item_id:bigint,passage:bigint,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", text.lower()) if text else []


def shingles(words: list[str]) -> set:
    k = min(SHINGLE, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words up to the last sentence, and of the last sentence; of a lone one, its last third."""
    sentences = [s for s in re.split(r"(?<=[.?!:])\s+", text) if words_of(s)]
    if len(sentences) > 1:
        answer = words_of(sentences[-1])
        whole = words_of(text)
        return whole[:len(whole) - len(answer)], answer
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


class Index:
    """Postings with block maxima over the items of one shard.

    Items stand in order of length, so that the thresholds in a block are alike.
    """

    def __init__(self, items: list[tuple[int, str]]):
        items = sorted(items, key=lambda x: (len(words_of(x[1])), x))
        self.items = [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        sizes = np.array([len(w) for w in split], np.float64)
        n, mean = len(items), sizes.mean()
        counts: dict[str, dict[int, int]] = {}
        for place, words in enumerate(split):
            for w in words:
                row = counts.setdefault(w, {})
                row[place] = row.get(place, 0) + 1
        # Term 0 stands for all words that no item has.
        self.terms = {w: t for t, w in enumerate(counts, 1)}
        self.block = -(-n // BLOCKS)
        self.bounds = np.zeros((len(counts) + 1, -(-n // self.block)), np.float32)
        self.postings: list[tuple[list[int], list[float]]] = [([], [])]
        own = np.zeros(n)
        for w, row in counts.items():
            idf = math.log(1 + (n - len(row) + 0.5) / (len(row) + 0.5))
            places = sorted(row)
            weights = [idf * row[p] * (K1 + 1) / (row[p] + K1 * (1 - B + B * sizes[p] / mean)) for p in places]
            self.postings.append((places, weights))
            for p, x in zip(places, weights, strict=True):
                own[p] += x
                self.bounds[self.terms[w], p // self.block] = max(self.bounds[self.terms[w], p // self.block], x)
        self.least = own * np.minimum(1, FITS / sizes) * THRESHOLD
        pad = np.full(self.bounds.shape[1] * self.block - n, np.inf)
        self.block_least = np.concatenate([self.least, pad]).reshape(-1, self.block).min(axis=1)
        self.top = self.bounds.max(axis=1)
        self.parts = []
        for _, t in items:
            q, a = question_and_answer(t)
            self.parts.append((shingles(q), shingles(a)))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(place, score) of all items that the distinct terms score at their thresholds or above."""
        # A cursor: [item, term, place in the postings].
        cursors = sorted([self.postings[t][0][0], t, 0] for t in terms)
        found, least = [], float(self.least.min())
        while cursors:
            total, pivot = 0.0, None
            for k, (_, t, _) in enumerate(cursors):
                total += float(self.top[t])
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if float(sum(self.bounds[c[1], block] for c in cursors[:pivot + 1])) * (1 + 1e-6) >= self.block_least[block]:
                if cursors[0][0] == item:
                    score = sum(self.postings[t][1][at] for _, t, at in cursors[:pivot + 1])
                    if score >= self.least[item]:
                        found.append((item, score))
                    aim = item + 1
                else:
                    aim = item
            else:
                # No item of this block before the next cursor's can reach its threshold.
                aim = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    aim = min(aim, cursors[pivot + 1][0])
                aim = max(aim, item + 1)
            moved = []
            for item_at, t, at in cursors:
                if item_at < aim:
                    places = self.postings[t][0]
                    while at < len(places) and places[at] < aim:
                        at += 1
                    if at == len(places):
                        continue
                    item_at = places[at]
                moved.append([item_at, t, at])
            cursors = sorted(moved)
        return found

    def search(self, text: str | None) -> tuple[int, list[tuple]]:
        """(passages, [(item_id, first passage, best score, question share, answer share)]) of a text."""
        words = words_of(text)
        n = len(words)
        if not n:
            return 0, []
        terms = np.fromiter(map(self.terms.get, words, repeat(0)), np.int64, n)
        starts = np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)
        hopeful = []
        # A round of passages at a time, so that memory does not follow the length of the text.
        for a in range(0, len(starts), ROUND):
            at = starts[a:a + ROUND, None] + np.arange(PASSAGE)
            here = np.where(at < n, terms[np.minimum(at, n - 1)], 0)
            here.sort(axis=1)
            here[:, 1:][here[:, 1:] == here[:, :-1]] = 0  # each term once; term 0 weighs nothing
            bound = self.bounds[here].sum(axis=1)
            hopeful += (a + np.flatnonzero((bound * (1 + 1e-5) >= self.block_least).any(axis=1))).tolist()
        found: dict[int, tuple[int, float]] = {}
        for p in hopeful:
            here = np.unique(terms[starts[p]:starts[p] + PASSAGE])
            for item, score in self.retrieve([t for t in here.tolist() if t]):
                first, best = found.get(item, (p, 0.0))
                found[item] = (first, max(best, score))
        if not found:
            return len(starts), []
        have = {}
        for k in range(1, SHINGLE + 1):
            wanted = {s for i in found for part in self.parts[i] for s in part if len(s) == k}
            if wanted:
                have[k] = wanted.intersection(zip(*(words[j:] for j in range(k)), strict=False))
        share = lambda part: sum(s in have[len(s)] for s in part) / len(part) if part else 1.0
        return len(starts), [(self.items[i], p, score, share(self.parts[i][0]), share(self.parts[i][1])) for i, (p, score) in sorted(found.items())]


def shards(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, text) in bounded lists, streamed to the driver a partition at a time."""
    part, words = [], 0
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").distinct()
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(text))
        if size < LEAST_WORDS:
            continue
        if part and (len(part) == SHARD_ITEMS or words + size > SHARD_WORDS):
            yield part
            part, words = [], 0
        part.append((item_id, text))
        words += size
    if part:
        yield part


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with passages (their number), hits and leaked; all other columns are kept.

    ``hits`` has an entry for each retrieved item: item_id, first passage, best score, and the shares of
    the question's and the answer's shingles in the text. ``leaked`` is true if one of them has enough.

    A text that is NULL or without words has no passages and no hits. Items without id or text, or
    with fewer than ``LEAST_WORDS`` words, are not looked for; equal items count once. Rows that repeat
    give equal rows; empty tables give no rows or no hits. Texts are read whole. Columns named passages,
    hits or leaked are replaced.
    """
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.drop("passages", "hits", "leaked")
    told = []
    for part in shards(items):
        index = spark.sparkContext.broadcast(Index(part))
        told.append(_told(index)(F.col("text")))
    if not told:
        none = _told(None)(F.col("text"))
        told = [none]
    out = docs
    for i, column in enumerate(told):
        out = out.withColumn(f"_told{i}", column)
    hits = F.concat(*[F.col(f"_told{i}.hits") for i in range(len(told))])
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_told0.passages").alias("passages"), hits.alias("hits"))
    leaked = F.exists("hits", lambda h: ((h["question"] >= QUESTION) & (h["answer"] >= ANSWER)) | (h["question"] >= QUESTION_ALONE))
    return out.withColumn("leaked", leaked)


def _told(index):
    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("item_id", "passage", "score", "question", "answer")
        for texts in batches:
            rows = [index.value.search(t) if index else (passages(t), []) for t in texts]
            yield pd.DataFrame({"passages": [n for n, _ in rows], "hits": [[dict(zip(names, h, strict=True)) for h in hits] for _, hits in rows]})

    return find


def passages(text: str | None) -> int:
    n = len(words_of(text))
    return len(range(0, max(1, n - PASSAGE + STRIDE), STRIDE)) if n else 0


def query(spark, folder: str) -> DataFrame:
    """One row per document: doc_id, passages, retrieved, leaked, and the ids of the leaked items."""
    out = search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    good = F.filter("hits", lambda h: ((h["question"] >= QUESTION) & (h["answer"] >= ANSWER)) | (h["question"] >= QUESTION_ALONE))
    return out.select("doc_id", "passages", F.size("hits").cast("bigint").alias("retrieved"), "leaked",
                      F.transform(good, lambda h: h["item_id"]).alias("item_ids"))
