"""Evaluation texts leaking into training text.

The test items form a BM25 inverted index in blocks of items. Every training document is cut into passages
that overlap by one word less than the run asked for, so each run lies whole in a passage, and every passage is
a query. A word of no item ends a passage, as no run reaches over it. Impacts are divided by the item's own threshold, the least score that a passage holding any run of
that length of the item can have; so no leak scores below 1. As in block-max WAND a passage whose terms' upper
bounds sum to less than 1 is skipped, then every block whose block maxima do; only the rest are scored
exactly. Both bounds are worked out for a batch of passages at a time. Hits are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.words import words

RUN = 13
PASSAGE = 64
BLOCK = 16
K1, B = 1.2, 0.75
ITEMS_PER_INDEX, INDEXES_PER_PASS = 20_000, 5
WORDS_PER_STEP = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """Postings by (term, block): ``start`` bounds each term's blocks, ``ends`` each block's postings."""

    vocabulary: dict[str, int]
    items: np.ndarray
    best: np.ndarray  # term -> greatest impact
    start: np.ndarray  # term -> first (term, block)
    block: np.ndarray  # (term, block) -> block
    peak: np.ndarray  # (term, block) -> greatest impact
    ends: np.ndarray  # (term, block) -> first posting
    slot: np.ndarray  # posting -> item within its block
    impact: np.ndarray
    text: np.ndarray  # all items' terms, one after the other
    gram: np.ndarray  # sorted hashes of runs
    gram_item: np.ndarray
    gram_at: np.ndarray
    run: int


def _hashes(ids: np.ndarray, run: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - run + 1), np.uint64)
    for j in range(run):
        h = (h ^ (ids[j : len(ids) - run + 1 + j].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def build_index(items: list[tuple[int, list[str]]], run: int = RUN, block: int = BLOCK) -> Index:
    """Index of items (id, words); items shorter than ``run`` words can't leak a run and are left out."""
    items = sorted((i, w) for i, w in items if len(w) >= run)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64) for _, w in items]
    n, size = len(items), len(vocabulary)
    mean = sum(map(len, coded)) / max(1, n)
    terms, docs, tf = [], [], []
    for d, c in enumerate(coded):
        t, k = np.unique(c, return_counts=True)
        terms.append(t), docs.append(np.full(len(t), d)), tf.append(k)
    term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, docs, tf))
    df = np.bincount(term, minlength=size)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    length = np.array([len(c) for c in coded], float)
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
    floor = np.ones(n)
    for d, c in enumerate(coded):
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        own = dict(zip(term[mine].tolist(), impact[mine].tolist()))
        # the least sum over distinct terms of any run
        seen, least, total, counts = {}, np.inf, 0.0, {}
        for i, t in enumerate(c.tolist()):
            counts[t] = counts.get(t, 0) + 1
            total += own[t] if counts[t] == 1 else 0.0
            if i >= run:
                o = int(c[i - run])
                counts[o] -= 1
                total -= own[o] if counts[o] == 0 else 0.0
            if i >= run - 1:
                least = min(least, total)
        floor[d] = max(least * (1 - 1e-6), 1e-9)
    impact = impact / floor[doc]
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    cell = term * (n // block + 1) + doc // block
    first = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0] if len(cell) else np.zeros(0, np.int64)
    text = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(c) for c in coded])
    grams = _hashes(text, run)
    whole = np.nonzero(owner[: len(grams)] == owner[run - 1 : run - 1 + len(grams)])[0]
    order = whole[np.lexsort((owner[whole], grams[whole]))]
    return Index(
        vocabulary, np.array([i for i, _ in items], np.int64), np.maximum.reduceat(impact, np.searchsorted(term, np.arange(size))) if size else np.zeros(0),
        np.searchsorted(term[first], np.arange(size + 1)), doc[first] // block, np.maximum.reduceat(impact, first) if len(first) else np.zeros(0),
        np.append(first, len(cell)), doc % block, impact, text, grams[order], owner[order], order, run,
    )


def _spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (start, count) the number of the range and every member."""
    of = np.repeat(np.arange(len(start)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]


def search(ix: Index, docs: list[np.ndarray], passage: int = PASSAGE, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(document number, item number) of every verified leak in coded documents (-1: a word of no item)."""
    stats = {"passages": 0, "queried": 0, "blocks": 0, "scored": 0, "hits": 0}
    none = np.zeros(0, np.int64)
    if not len(ix.items) or not docs:
        return none, none, stats
    text, size_of = np.concatenate(docs), np.array([len(d) for d in docs])
    # a word of no item ends every run that an item could share: only the stretches between such words are cut up
    doc = np.repeat(np.arange(len(docs)), size_of)
    open_ = text >= 0
    start = np.nonzero(open_ & np.append(True, ~open_[:-1] | (doc[1:] != doc[:-1])))[0] if len(text) else none
    stop = np.nonzero(open_ & np.append(~open_[1:] | (doc[1:] != doc[:-1]), True))[0] + 1 if len(text) else none
    long = stop - start >= ix.run
    base, length = start[long], (stop - start)[long]
    if not len(base):
        return none, none, stats
    step = passage - ix.run + 1
    number = np.where(length >= ix.run, np.maximum(1, -(-(length - ix.run + 1) // step)), 0)
    of, k = _spans(np.zeros(len(base), np.int64), number)
    begin = base[of] + k * step
    end = np.minimum(begin + passage, base[of] + length[of])
    stats["passages"] = len(of)
    p, at = _spans(begin, end - begin)
    size = len(ix.vocabulary)
    pair = np.unique(p * size + text[at])
    p, t = pair // size, pair % size
    bound = np.bincount(p, ix.best[t], len(of))
    alive = bound >= 1
    stats["queried"] = int(alive.sum())
    chosen = alive[p]
    p, t = p[chosen], t[chosen]
    blocks = len(ix.items) // block + 1
    q, cell = _spans(ix.start[t], ix.start[t + 1] - ix.start[t])
    key = p[q] * blocks + ix.block[cell]
    names, inverse = np.unique(key, return_inverse=True)
    upper = np.bincount(inverse, ix.peak[cell])
    stats["blocks"] = len(names)
    live = upper >= 1
    stay = live[inverse]
    cell, inverse = cell[stay], (np.cumsum(live) - 1)[inverse[stay]]
    names = names[live]
    stats["scored"] = len(names)
    q, post = _spans(ix.ends[cell], ix.ends[cell + 1] - ix.ends[cell])
    score = np.bincount(inverse[q] * block + ix.slot[post], ix.impact[post], len(names) * block)
    hit = np.nonzero(score >= 1)[0]
    hp, hi = names[hit // block] // blocks, names[hit // block] % blocks * block + hit % block
    stats["hits"] = len(hit)
    # verification: a run of the passage that stands in the item, word by word
    grams = _hashes(text, ix.run)
    v, at = _spans(begin[hp], np.maximum(0, end[hp] - begin[hp] - ix.run + 1))
    low = np.searchsorted(ix.gram, grams[at], "left")
    many = np.searchsorted(ix.gram, grams[at], "right") - low
    w, g = _spans(low, many)
    same = ix.gram_item[g] == hi[v[w]]
    w, g = w[same], g[same]
    exact = np.ones(len(w), bool)
    for j in range(ix.run):
        exact &= text[at[w] + j] == ix.text[ix.gram_at[g] + j]
    found = np.unique(doc[base[of[hp[v[w[exact]]]]]] * len(ix.items) + hi[v[w[exact]]])
    return found // len(ix.items), found % len(ix.items), stats


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, passage: int = PASSAGE, per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """Rows (``doc_id``, ``item_id``), once each: document and item share ``run`` or more consecutive words.

    Whole texts are read, in one pass for ``INDEXES_PER_PASS`` indexes of at most ``per_index`` items each, so what is
    broadcast has a fixed bound and a larger test set only takes more passes. Null and empty texts leak nothing; repeated
    rows change nothing; items with equal text are all reported.
    """
    count = items.where(F.col(item_id).isNotNull()).count()
    parts = max(1, -(-count // per_index))
    found = None
    for k in range(0, parts, INDEXES_PER_PASS):
        held = []
        for n in range(k, min(parts, k + INDEXES_PER_PASS)):
            part = items.where(F.col(item_id).isNotNull() & (F.pmod(F.xxhash64(item_id), F.lit(parts)) == n)).select(item_id, item_text)
            held.append(documents.sparkSession.sparkContext.broadcast(build_index([(r[0], words(r[1])) for r in part.toLocalIterator()], run)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            def work(ids: list, texts: list[list[str]]) -> Iterator[pd.DataFrame]:
                for shared in held:
                    ix = shared.value
                    code = ix.vocabulary.get
                    d, i, _ = search(ix, [np.fromiter((code(w, -1) for w in t), np.int64, len(t)) for t in texts], passage)
                    yield pd.DataFrame({"doc_id": np.array(ids, np.int64)[d], "item_id": ix.items[i]})

            for b in batches:
                ids, texts, total = [], [], 0
                for i, x in zip(b["doc_id"], b["text"]):
                    ids.append(i)
                    texts.append(words(x))
                    total += len(texts[-1])
                    if total >= WORDS_PER_STEP:
                        yield from work(ids, texts)
                        ids, texts, total = [], [], 0
                if ids:
                    yield from work(ids, texts)

        rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(scan, "doc_id long, item_id long")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()
