"""Language of texts and of every stretch of a mixed text, by string-kernel classification.

The kernel of two stretches is the number of character n-grams (blended: all lengths of ``LENGTHS``) present in
both, divided by the geometric mean of how many each has. Kernel ridge regression of one language against the
rest runs on Nyström landmarks: ``LANDMARKS`` of the labelled sentences, spread evenly over the languages. As
the kernel is a scalar product of presence vectors, the landmark expansion of each class folds into one weight
per n-gram, and a batch of stretches is scored by one sparse matrix product with all classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.words import characters

LENGTHS = (1, 2, 3, 4)
LANDMARKS = 1500
RIDGE = 0.005
#: Documented bounds of what the classifier is fitted on: labelled sentences, and labelled documents (of at most
#: FIT_CHARS characters, those with the least hash of each of as many slots of hashes) for each language.
FIT_SENTENCES = 20_000
FIT_DOCUMENTS = 120
FIT_CHARS = 3_000
#: A stretch counts as another language than the text's own only if it leads by this much.
LEAD = 0.25
LEAST_WORDS = 5
NOTE_SHARE = 4
CHARS_PER_STEP = 400_000
_MUL = np.uint64(0x9E3779B97F4A7C15)

_FORMAT = characters(("Cf",))
_MARKS = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) in ("Mn", "Me")}
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOCK = re.compile(r"\[\s*\d[\d.:,\s]*[-–]\s*\d[\d.:,\s]*\]")
_BRACKETED = re.compile(r"\[[^\[\]\n]+\]|\([^()\n]+\)")
_ENDED = re.compile(r"[.!?…][\"»”’'*]*\s*$")
_TITLE = re.compile(r"(?:(?<=^)|(?<=[.!?…\n|»”\"]))(\s*)(?:“[^“”\n.!?,]+”|«[^«»\n.!?,]+»|\"[^\"\n.!?,]+\"|‘[^‘’\n.!?,]+’)\s*(?=[.!?…\n|]|$)")
_QUOTE = re.compile("[\"“«‘]")
_JOINT = re.compile(r"\s[–—/-]+\s|[:;,]\s")
_CUT = re.compile(r"(?<=[.!?…])[\"»”’')\]*]*\s+|\s*\n\s*|\s+\|\s+")


def letters(text: str) -> str:
    """Lower-case letters of a stretch; whatever else stands between them becomes one blank."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def bare(text: str) -> str:
    """``text`` without accents, for texts typed without them."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_MARKS).replace("ß", "ss"))


def _sentence_in(inner: str) -> bool:
    """Whether a full sentence stands in a bracket."""
    at = 0
    for cut in [*_CUT.finditer(inner), None]:
        part = inner[at : cut.start() if cut else len(inner)]
        if _ENDED.search(part) and len(letters(part).split()) >= LEAST_WORDS:
            return True
        at = cut.end() if cut else at
    return False


def _without_notes(text: str) -> str:
    """A bracket with a full sentence becomes a line of its own, a title or note one blank.

    Notes go with a text; where they outweigh it ``NOTE_SHARE`` times, they are the text and stay.
    """
    opened = _BRACKETED.sub(lambda m: f"\n{m.group()[1:-1]}\n" if _sentence_in(m.group()[1:-1]) else m.group(), text)
    bare_text = _BRACKETED.sub(" ", opened)
    return bare_text if (NOTE_SHARE + 1) * len(_LETTERS.findall(bare_text)) >= len(_LETTERS.findall(opened)) else opened


def stretches(text: str | None) -> list[tuple[int, str]]:
    """(offset in the cleaned text, stretch): sentences and lines, without time codes, titles and bracketed notes.

    A bracket that holds a full sentence is no note and gives stretches of its own. A text of nothing but titles
    keeps them.
    """
    if not text:
        return []
    clean = text
    if not text.isascii():
        # format marks aren't printable; few texts hold anything of that kind
        clean = text if text.replace("\n", " ").isprintable() else _FORMAT.sub("", text)
        clean = clean if unicodedata.is_normalized("NFKC", clean) else unicodedata.normalize("NFKC", clean)
    clean = _CLOCK.sub("\n", clean) if "[" in clean else clean
    clean = _without_notes(clean) if "[" in clean or "(" in clean else clean
    untitled = _TITLE.sub(" ", clean) if _QUOTE.search(clean) else clean
    clean = untitled if untitled is clean or _LETTERS.search(untitled) else clean
    out, at = [], 0
    for m in _CUT.finditer(clean):
        out.append((at, clean[at : m.start()]))
        at = m.end()
    out.append((at, clean[at:]))
    return [(i + j, part) for i, s in out if s.strip() for j, part in _joined(s)]


def _joined(sentence: str, least: int = 5) -> list[tuple[int, str]]:
    """Cut at a dash, slash, colon or semicolon with ``least`` words on both sides: two sentences may meet there."""
    marks = list(_JOINT.finditer(sentence))
    if not marks:
        return [(0, sentence)]
    ends = [0, *[m.end() for m in marks], len(sentence)]
    words = [len(_LETTERS.findall(sentence, a, z)) for a, z in zip(ends, ends[1:])]
    left = sum(words)
    out, at, held = [], 0, 0
    for m, n in zip(marks, words):
        held, left = held + n, left - n
        if held >= least and left >= least:
            out.append((at, sentence[at : m.start()]))
            at, held = m.end(), 0
    return [*out, (at, sentence[at:])]


def presence(texts: list[str], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of every distinct n-gram of every text, and how many each text has."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    keys = []
    for n in lengths:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ code[j : len(code) - n + 1 + j]) * _MUL
            h ^= h >> np.uint64(31)
        inside = of[: len(h)] == of[n - 1 :]
        keys.append((of[: len(h)][inside].astype(np.uint64) << np.uint64(40)) | (h[inside] >> np.uint64(24)))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    owner = (key >> np.uint64(40)).astype(np.int64)
    return owner, key & np.uint64((1 << 40) - 1), np.bincount(owner, minlength=len(texts))


#: Bits of an n-gram's hash that address the table in front of the sorted hashes.
ADDRESS = 18


def address(grams: np.ndarray) -> np.ndarray:
    """Row of the only n-gram at each address; -1 where there is none, -2 where several share it."""
    table = np.full(1 << ADDRESS, -1, np.int64)
    at, first, count = np.unique((grams >> np.uint64(40 - ADDRESS)).astype(np.int64), return_index=True, return_counts=True)
    table[at] = np.where(count == 1, first, -2)
    return table


def places(grams: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted n-gram in the sorted ``grams``, or ``len(grams)``: most are found by address alone."""
    at = table[(wanted >> np.uint64(40 - ADDRESS)).astype(np.int64)]
    shared = np.nonzero(at == -2)[0]
    at[shared] = np.minimum(np.searchsorted(grams, wanted[shared]), len(grams) - 1)
    at[at < 0] = 0
    at[grams[at] != wanted] = len(grams)
    return at


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray  # gram x language
    table: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)  # language x gram, and a last column of zeros for all other n-grams

    def __post_init__(self) -> None:
        self.table = address(self.grams)
        self.rows = np.ascontiguousarray(np.vstack([self.weights, np.zeros((1, len(self.languages)))]).T)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Class scores of stretches given as ``letters``; a stretch without letters scores 0."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts or not len(self.grams):
            return out
        owner, gram, count = presence(texts)
        if len(owner):
            first = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
            # the product of the sparse presence matrix, whose rows lie one after the other, with the weights
            at = places(self.grams, self.table, gram)
            for c, weights in enumerate(self.rows):
                out[owner[first], c] = np.add.reduceat(weights.take(at), first)
        return out / np.sqrt(np.maximum(count, 1))[:, None]


def fit(sentences: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (text, language); each sentence is also learnt without its accents.

    Repeated sentences weigh the root of their number; a quarter of the landmarks are the most repeated ones.
    """
    counts = Counter((letters(v), lang) for t, lang in sentences if t and lang for v in (t, bare(t)))
    rows = sorted(counts)
    texts, labels = [t for t, _ in rows], np.array([lang for _, lang in rows])
    weight = np.sqrt([counts[r] for r in rows])
    languages = sorted(set(labels.tolist()))
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    chosen = []
    for lang in languages:
        own = np.nonzero(labels == lang)[0]
        room = max(1, min(len(own), landmarks // len(languages)))
        often = own[np.argsort(-weight[own], kind="stable")][: room // 4]
        chosen += sorted({*often.tolist(), *own[np.unique(np.linspace(0, len(own) - 1, room - len(often)).astype(int))].tolist()})
    grams = np.unique(presence([texts[i] for i in chosen])[1])

    table = address(grams)

    def sparse(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, gram, count = presence(part)
        return owner, places(grams, table, gram), 1 / np.sqrt(np.maximum(count, 1))

    owner, at, scale = sparse([texts[i] for i in chosen])
    z = np.zeros((len(chosen), len(grams) + 1), np.float32)
    z[owner, at] = scale[owner]
    # the row of n-grams that no landmark has stays 0
    z[:, -1] = 0
    across = np.ascontiguousarray(z.T)
    z = z[:, :-1]
    y = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0 / max(1, len(languages) - 1))
    square, moment = np.zeros((len(z), len(z))), np.zeros((len(z), len(languages)))
    for i in range(0, len(texts), 128):
        owner, at, scale = sparse(texts[i : i + 128])
        bounds = np.searchsorted(owner, np.arange(len(scale) + 1))
        cross = np.stack([across[at[a:b]].sum(0) for a, b in zip(bounds, bounds[1:])]).astype(float) * scale[:, None]
        heavy = cross * weight[i : i + 128, None]
        square += heavy.T @ cross
        moment += heavy.T @ y[i : i + 128]
    inner = (z @ z.T).astype(float)
    alpha = np.linalg.solve(square + ridge * weight.sum() / len(languages) * inner + 1e-8 * np.eye(len(z)), moment)
    return Model(languages, grams, (z.T @ alpha.astype(np.float32)).astype(np.float64))


def fit_with_documents(sentences: list[tuple[str, str]], documents: list[tuple[str, str]]) -> Model:
    """Fit on clean sentences, then again with stretches of labelled documents, whose labels may be wrong.

    A document takes part if the first fit gives it the language of its label, with the stretches that the first
    fit doesn't clearly place elsewhere.
    """
    first = fit(sentences)
    more = list(sentences)
    for text, lang in documents:
        parts = [s for _, s in stretches(text)]
        coded = [letters(s) for s in parts]
        sizes = np.array([len(x.split()) for x in coded])
        if lang not in first.languages or not len(parts):
            continue
        scores, k = first.scores(coded), first.languages.index(lang)
        if (scores * sizes[:, None]).sum(0).argmax() == k:
            more += [(s, lang) for s, x, n in zip(parts, scores, sizes) if n >= LEAST_WORDS and x.max() - x[k] < 2 * LEAD]
    return fit(more)


def label_stretches(model: Model, scores: np.ndarray, owner: np.ndarray, sizes: np.ndarray, lead: float = LEAD, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Language number and confidence of every stretch.

    A text's own language has the greatest sum of scores weighted by words. A stretch takes another language
    only if it has ``least_words`` words and leads the text's own by ``lead``.
    """
    texts = int(owner.max()) + 1 if len(owner) else 0
    total = np.stack([np.bincount(owner, scores[:, c] * sizes, texts) for c in range(scores.shape[1])], axis=1)
    own = total.argmax(1)[owner]
    best = scores.argmax(1)
    rows = np.arange(len(scores))
    away = (scores[rows, best] - scores[rows, own] >= lead) & (sizes >= least_words)
    chosen = np.where(away, best, own)
    odds = np.exp(6 * (scores - scores.max(1, keepdims=True)))
    return chosen, odds[rows, chosen] / odds.sum(1)


STRETCH = "doc_id long, part int, at int, words int, lang string, confidence double"


def named_language(label: str | None, languages: list[str]) -> str | None:
    """The language that a label names by its first two letters, without case and outer blanks."""
    short = (label or "").strip().lower()[:2]
    return short if short in languages else None


def train(documents: DataFrame, text: str, label: str, reference: DataFrame, ref_text: str, ref_label: str) -> Model:
    """Fit on at most ``FIT_SENTENCES`` reference sentences and ``FIT_DOCUMENTS`` labelled documents per language."""
    rows = reference.where(f"{ref_text} is not null and {ref_label} is not null").orderBy(F.xxhash64(ref_text), ref_text).limit(FIT_SENTENCES)
    sentences = [(r[0], r[1]) for r in rows.select(ref_text, ref_label).toLocalIterator()]
    languages = sorted({lang for _, lang in sentences})
    short = F.substring(F.lower(F.trim(F.col(label))), 1, 2)
    usable = documents.select(short.alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(languages) & (F.length("text") <= FIT_CHARS))
    # one document for each language and slot of hashes: first its hash, by a small aggregation, then its text
    keyed = usable.withColumn("h", F.xxhash64("text"))
    least = keyed.groupBy("lang", F.pmod("h", F.lit(FIT_DOCUMENTS)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    few = keyed.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return fit_with_documents(sentences, [(r[0], r[1]) for r in few.orderBy("lang", "h").select("text", "lang").collect()])


def label_languages(documents: DataFrame, doc_id: str, text: str, model: Model, lead: float = LEAD, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (``doc_id``, ``part``, ``at``, ``words``, ``lang``, ``confidence``): every stretch of one language of every text.

    Neighbouring sentences of one language form a stretch; ``words`` is that of its longest sentence, ``at`` its
    offset in the text without time codes and titles. Whole texts are read. Null, empty and letterless texts
    give no rows. The model has a fixed size and is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value

        def work(owner: list[int], at: list[int], texts: list[str], ids: np.ndarray) -> pd.DataFrame:
            coded = [letters(t) for t in texts]
            sizes = np.array([len(t.split()) for t in coded])
            scores, of = m.scores(coded), np.array(owner)
            chosen, sure = label_stretches(m, scores, of, sizes, lead, least_words)
            keep = sizes > 0
            of, chosen, sure, sizes, at = of[keep], chosen[keep], sure[keep], sizes[keep], np.array(at)[keep]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (chosen[1:] != chosen[:-1])
            first = np.nonzero(new)[0]
            if not len(first):
                return pd.DataFrame(columns=["doc_id", "part", "at", "words", "lang", "confidence"])
            part = np.arange(len(first)) - np.maximum.accumulate(np.where(np.append(True, of[first][1:] != of[first][:-1]), np.arange(len(first)), 0))
            weight = np.add.reduceat(sizes, first)
            return pd.DataFrame({"doc_id": ids[of[first]], "part": part.astype("int32"), "at": at[first].astype("int32"), "words": np.maximum.reduceat(sizes, first).astype("int32"), "lang": np.array(m.languages, object)[chosen[first]], "confidence": np.add.reduceat(sure * sizes, first) / weight})

        for b in batches:
            ids = b["doc_id"].to_numpy()
            owner, at, texts, total = [], [], [], 0
            for k, t in enumerate(b["text"]):
                for i, s in stretches(t):
                    owner.append(k), at.append(i), texts.append(s)
                    total += len(s)
                if total >= CHARS_PER_STEP:
                    yield work(owner, at, texts, ids)
                    owner, at, texts, total = [], [], [], 0
            if texts:
                yield work(owner, at, texts, ids)

    return documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, STRETCH)


def wrong_labels(documents: DataFrame, doc_id: str, label: str, found: DataFrame, languages: list[str], least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (``doc_id``, ``lang``) of documents whose label is missing, names no language or one not in the text,
    or whose text has several: one for each language with a full sentence (``least_words`` words) there. A text
    without any counts as written in the language of its longest stretch."""
    short = F.substring(F.lower(F.trim(F.col(label))), 1, 2)
    named = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(short.isin(languages), short).alias("named"))
    full = found.groupBy("doc_id").agg(F.collect_set(F.when(F.col("words") >= least_words, F.col("lang"))).alias("langs"), F.max_by("lang", F.struct("words", -F.col("part"))).alias("longest"))
    full = full.select("doc_id", F.when(F.size("langs") > 0, F.col("langs")).otherwise(F.array("longest")).alias("langs"))
    met = named.join(full, "doc_id").where(F.col("named").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("named")))
    return met.select("doc_id", F.explode("langs").alias("lang")).distinct()
