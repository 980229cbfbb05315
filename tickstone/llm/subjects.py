"""Subject areas of documents: classifier chains over term, source and structure features.

Terms (words and pairs of neighbouring words) are turned into features by a mixture over sentences that is fitted to the labelled
documents: each sentence is about one subject or none, and a label only says that the subject is among its document's sentences.
Terms that all labels share (common phrases, figures of speech) thereby fall to "none". Each language has its own mixture; a
sentence's language is told from its words, as the given one may be wrong and texts quote others. A document's term features are
the shares of its sentences by subject.
A chain of logistic models, one a subject, takes these, the source and the document's structure, and the decisions of the links
before it, so it follows which subjects go together. Each link is calibrated on documents that it was not fitted on;
a beam search finds the most probable combination of labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import norm_source, strip
from tickstone.llm.spread import spread
from tickstone.llm.words import plain

# words, numbers and the ends of sentences of a plain text
_SCAN = re.compile(r"[^\W\d_]+|\d[\d.,]*|(?<=[.!?])\s+|(?<=[.!?][\"”’)\]])\s+|\n\s*\n|\n(?=\s*[-*•] )")
BREAK = "\n"
SCHEMA = "doc_id bigint, subject string, share double, probability double"


@dataclass(frozen=True)
class Training:
    """``most_documents``: labelled documents that are fitted on at most (the least by hash of ``doc_id``), and
    ``most_chars``: characters of their texts together at most, in the same order; the driver holds these texts.
    ``held_out``: share of them kept for calibration. ``rounds`` of the mixture's fit at most, fewer once the sentences move by no more
    than ``settled`` on average; ``smooth``: pseudo-counts of the common distribution in each subject's. ``ridge`` of the chain's links. ``beam``: combinations kept while decoding.
    ``least_of_language``: labelled documents from which on a language has its own mixture.
    """

    most_documents: int = 8000
    most_chars: int = 40_000_000
    held_out: float = 0.25
    rounds: int = 30
    settled: float = 0.04
    smooth: float = 30.0
    ridge: float = 0.3
    beam: int = 8
    least_of_language: int = 25


class Numbers(dict):
    """Numbers of words. The end of a sentence is -2, an unknown word -1, and all figures are the word ``#``."""

    def __missing__(self, word: str) -> int:
        first = word[0]
        return -2 if first.isspace() else self.get("#", -1) if first.isdigit() else -1


class Growing(Numbers):
    """Gives every new word the next number."""

    def __missing__(self, word: str) -> int:
        known = super().__missing__(word)
        if known == -2:
            return -2
        name = "#" if word[0].isdigit() else word
        return self.setdefault(name, len(self))


@dataclass
class Scanned:
    """The sentences of texts: ``word`` numbers and the ``row`` (sentence) of each, the ``doc`` of each sentence, documents ``n``.

    ``pair`` is true where a word follows the one before it in the same sentence.
    """

    word: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    doc: np.ndarray
    n: int

    def lengths(self) -> np.ndarray:
        """Sentences of each document."""
        return np.bincount(self.doc, minlength=self.n)


def scan(texts: Sequence[str | None], words: Numbers) -> Scanned:
    """Sentences without any word are left out; null texts have none."""
    found: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found += _SCAN.findall(plain(t))
        found.append(BREAK)
        ends[i] = len(found)
    ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
    at = np.flatnonzero(ids != -2)
    stop = np.cumsum(ids == -2)[at]
    new = np.ones(len(at), bool)
    new[1:] = stop[1:] != stop[:-1]
    doc = np.searchsorted(ends, at[new], side="right")
    return Scanned(ids[at], np.cumsum(new) - 1, ~new, doc, len(texts))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers, by sorting: for long arrays faster than ``np.unique``, which hashes."""
    x = np.sort(x)
    return x[_firsts(x)]


def _terms(s: Scanned, words: int, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each sentence's terms, once each: words from 0, known pairs from ``words`` on (all codes if ``pairs`` is None)."""
    b = np.flatnonzero(s.pair & (s.word >= 0) & (np.r_[-1, s.word[:-1]] >= 0))
    code = s.word[b - 1].astype(np.int64) * words + s.word[b]
    if pairs is not None:
        place = np.searchsorted(pairs, code)
        if len(pairs):
            good = pairs[np.minimum(place, len(pairs) - 1)] == code
            b, code = b[good], place[good]
        else:
            b, code = b[:0], place[:0]
    one = s.word >= 0
    row, term = np.r_[s.row[one], s.row[b]], np.r_[s.word[one].astype(np.int64), words + code]
    width = int(term.max(initial=0)) + 1
    both = _distinct(row * width + term)
    return both // width, both % width


def _sum_by(starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0) if len(starts) else np.zeros((0, *x.shape[1:]), x.dtype)


def _firsts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.zeros(0, int)


def _row_totals(row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``x`` (one line a term) over the terms of each row; ``row`` is sorted."""
    out = np.zeros((rows, x.shape[1]), np.float64)
    at = _firsts(row)
    out[row[at]] = _sum_by(at, x)
    return out


def _weigh(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithms weighed down, since terms overlap."""
    return total * (0.5 + 0.5 / np.maximum(n, 1))[:, None]


def _posterior(score: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    z = score + log_prior
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_terms(row: np.ndarray, term: np.ndarray, doc: np.ndarray, labels: np.ndarray, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """The terms, sorted, and the log distribution of each (terms by classes) in each subject and (last) in none.

    ``row`` and ``term`` are sentences (from 0, sorted) and their terms, ``doc`` the document of each sentence, ``labels`` (documents by
    subjects) what is said of the document.
    """
    kept = _distinct(term)
    col = np.searchsorted(kept, term)
    k, terms, rows = labels.shape[1], len(kept), len(doc)
    given = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
    some = labels.any(axis=1, keepdims=True)
    prior = np.hstack([np.where(some, 0.5 * given + 0.1 / k, 0.1 / k), np.where(some, 0.4, 0.9)])
    log_prior = np.log(prior)[doc]
    post = np.exp(log_prior)
    by_term = np.argsort(col, kind="stable")
    starts, by_term_row = _firsts(col[by_term]), row[by_term]
    common = np.bincount(col, minlength=terms) + 0.1
    common = common / max(common.sum(), 1e-9)
    n = np.bincount(row, minlength=rows)
    logs = np.zeros((terms, k + 1), np.float32)
    for _ in range(t.rounds):
        count = _sum_by(starts, post.astype(np.float32)[by_term_row]) + t.smooth * common[:, None]
        logs = np.log(count / np.maximum(count.sum(axis=0), 1e-9)).astype(np.float32)
        before, post = post, _posterior(_weigh(_row_totals(row, logs[col], rows), n), log_prior)
        if not len(post) or np.abs(post - before).max(axis=1).mean() <= t.settled:
            break
    return kept, logs


def fit_languages(s: Scanned, words: int, langs: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and the log distributions of words (words by languages), from documents whose language is given."""
    names = sorted({x for x in langs if x})
    lang = np.array([names.index(x) if x else -1 for x in langs], np.int64)
    own = _distinct(s.doc[s.row].astype(np.int64) * max(words, 1) + s.word)
    of, word = lang[own // max(words, 1)], own % max(words, 1)
    n = np.full((words, len(names)), 0.1)
    np.add.at(n, (word[of >= 0], of[of >= 0]), 1.0)
    return names, np.log(n / np.maximum(n.sum(axis=0), 1e-9)).astype(np.float32)


def languages(s: Scanned, row: np.ndarray, term: np.ndarray, model: tuple[list[str], np.ndarray]) -> np.ndarray:
    """The number of the likeliest language of each sentence by its words and, a little, those of its document; -1 where none is known."""
    names, logs = model
    if not names or not len(s.doc):
        return np.full(len(s.doc), -1)
    word = term < len(logs)
    score = _row_totals(row[word], logs[term[word]], len(s.doc))
    whole = np.stack([np.bincount(s.doc, weights=x, minlength=s.n) for x in score.T], axis=1)
    return (score + 0.01 * whole[s.doc]).argmax(axis=1)


def shares(s: Scanned, model: dict) -> np.ndarray:
    """Share of each document's sentences by subject, each sentence by its language's mixture. Without sentences there is none."""
    k, rows = len(model["names"]), len(s.doc)
    if not rows:
        return np.zeros((s.n, k))
    row, term = _terms(s, model["width"], model["pairs"])
    told = languages(s, row, term, model["languages"])
    langs = model["languages"][0]
    score = np.zeros((rows, k + 1))
    for i in np.unique(told):
        lang = langs[i] if i >= 0 and langs[i] in model["terms"] else ""
        place, logs = model["terms"][lang]
        mine = np.flatnonzero((told == i)[row])
        col = place[term[mine]]
        mine, col = mine[col >= 0], col[col >= 0]
        score += _weigh(_row_totals(row[mine], logs[col], rows), np.bincount(row[mine], minlength=rows))
    n = np.maximum(s.lengths(), 1)
    mix = np.tile(np.r_[np.full(k, 0.5 / k), 0.5], (s.n, 1))
    first = _firsts(s.doc)
    total = np.zeros((s.n, k + 1))
    for _ in range(3):
        total[s.doc[first]] = _sum_by(first, _posterior(score, np.log(mix)[s.doc]))
        mix = (total + 0.05) / (n + 0.05 * (k + 1))[:, None]
    return total[:, :k] / n[:, None]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pad = np.full(x.shape[1], ridge)
    pad[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pad * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(pad)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(share: np.ndarray, source: np.ndarray, structure: np.ndarray) -> np.ndarray:
    """Constant; shares, also cut at a third, as the step lies below; sources; structure."""
    return np.hstack([np.ones((len(share), 1)), share, np.minimum(share, 0.33) * 3, source, structure])


def _inputs(sources: list[str], rows: pd.DataFrame, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source and structure of documents: how many sentences, and whether there are paragraphs' marks, lists, lines, only ASCII."""
    source = (rows["source"].to_numpy(dtype=object)[:, None] == np.array(sources, object)[None, :]).astype(float).reshape(len(rows), len(sources))
    texts = [t or "" for t in rows["text"]]
    marks = [("<p>" in t, "- " in t[:2] or "\n- " in t, "\n" in t, t.isascii()) for t in texts]
    return source, np.hstack([np.minimum(lengths, 40)[:, None] / 10.0, np.array(marks, float).reshape(len(rows), 4)])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling, drawn towards no change so that few held-out documents cannot turn it."""
    a, b = 1.0, 0.0
    for _ in range(30 if len(z) else 0):
        p = 1 / (1 + np.exp(-(a * z + b)))
        q = p * (1 - p) + 1e-9
        g = np.array([np.sum((p - y) * z) + 5 * (a - 1), np.sum(p - y) + 5 * b])
        h = np.array([[np.sum(q * z * z) + 5, np.sum(q * z)], [np.sum(q * z), np.sum(q) + 5]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def fit(rows: pd.DataFrame, names: list[str], t: Training = Training()) -> dict:
    """The model, in plain values, from ``text, lang, source, labels`` (list of subjects) of labelled documents."""
    at = {n: i for i, n in enumerate(names)}
    y = np.zeros((len(rows), len(names)))
    for i, ls in enumerate(rows["labels"]):
        y[i, [at[s] for s in ls if s in at]] = 1
    words = Growing()
    s = scan(list(rows["text"]), words)
    held = np.arange(len(rows)) % max(2, round(1 / t.held_out)) == 0
    fitted = ~held if len(rows) > 1 else np.ones(len(rows), bool)
    model = {"names": names, "beam": t.beam, "words": Numbers(dict(words) | {" ": -2, BREAK: -2}), "width": len(words), "languages": fit_languages(s, len(words), list(rows["lang"]))}
    row, term = _terms(s, len(words), None)
    told = languages(s, row, term, model["languages"])
    use = fitted[s.doc] if len(s.doc) else np.zeros(0, bool)

    def mixture(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(mine) - 1
        take = mine[row] if len(row) else np.zeros(0, bool)
        return fit_terms(number[row[take]], term[take], s.doc[mine], y, t)

    got = {}
    langs = model["languages"][0]
    common = [(len(np.unique(s.doc[use & (told == i)])), langs[i] if i >= 0 else "", i) for i in np.unique(told)]
    for n, lang, i in common:
        if n >= t.least_of_language:
            got[lang] = mixture(use & (told == i))
    # for the languages without a mixture of their own; if there are none, it stands for sentences of unknown words only
    covered = got and len(got) == len(common)
    got[""] = got[max(common)[1]] if covered else mixture(use)
    # pairs are numbered by their place among those that any mixture knows
    model["pairs"] = np.unique(np.concatenate([kept[kept >= len(words)] for kept, _ in got.values()])) - len(words)
    model["terms"] = {}
    for lang, (kept, logs) in got.items():
        place = np.full(len(words) + len(model["pairs"]), -1, np.int32)
        paired = kept >= len(words)
        place[np.where(paired, len(words) + np.searchsorted(model["pairs"], kept - len(words)), kept)] = np.arange(len(kept))
        model["terms"][lang] = (place, logs)
    sources = sorted({x for x in rows["source"] if x})
    x = _features(shares(s, model), *_inputs(sources, rows, s.lengths()))
    order = [int(i) for i in np.argsort(-y.sum(axis=0), kind="stable")]
    links, scale = [], []
    for j, i in enumerate(order):
        xi = np.hstack([x, y[:, order[:j]]])
        w = _logistic(xi[fitted], y[fitted, i], t.ridge)
        links.append(w)
        scale.append(_platt(np.clip(xi @ w, -30, 30)[held], y[held, i]))
    return model | {"order": order, "sources": sources, "links": links, "scale": scale}


def decode(model: dict, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (documents by subjects) of the most probable combination, shares, and the combination's probability."""
    s = scan(list(rows["text"]), model["words"])
    share = shares(s, model)
    x = _features(share, *_inputs(model["sources"], rows, s.lengths()))
    n, k, width = len(rows), len(model["names"]), model["beam"]
    chosen = np.zeros((n, 1, k))
    logp = np.zeros((n, 1))
    for j, (w, (a, b)) in enumerate(zip(model["links"], model["scale"], strict=True)):
        z = (x @ w[: x.shape[1]])[:, None] + (chosen[:, :, :j] @ w[x.shape[1] :] if j else 0.0)
        z = a * np.clip(z, -30, 30) + b
        no, yes = logp - np.logaddexp(0, z), logp - np.logaddexp(0, -z)
        with_label = chosen.copy()
        with_label[:, :, j] = 1
        chosen, logp = np.concatenate([chosen, with_label], axis=1), np.concatenate([no, yes], axis=1)
        best = np.argsort(-logp, axis=1, kind="stable")[:, :width]
        logp = np.take_along_axis(logp, best, axis=1)
        chosen = np.take_along_axis(chosen, best[:, :, None], axis=1)
    out = np.zeros((n, k))
    out[:, model["order"]] = chosen[:, 0]
    out[s.lengths() == 0] = 0
    return out, share, np.exp(logp[:, 0])


def sent_model(spark: SparkSession, model: dict | None) -> Broadcast:
    """The model as plain values: an executor that has no copy of this package cannot read its classes."""
    return spark.sparkContext.broadcast(model and model | {"words": dict(model["words"])})


def received(model: dict | None) -> dict | None:
    return model and model | {"words": Numbers(model["words"])}


def labelled(documents: DataFrame, labels: DataFrame, t: Training = Training()) -> pd.DataFrame:
    """Texts, sources and label sets of labelled documents: of at most ``t.most_documents`` ids, by hash of the id.

    The ids are chosen among the labels alone. Which of them are within ``t.most_chars`` is told from their lengths, so only the chosen
    texts are moved.
    """
    given = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.lower(strip("subject")))).alias("labels"))
    sample = F.broadcast(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.most_documents))
    texts = documents.where("text is not null")
    sizes = texts.select("doc_id", F.char_length("text").alias("__n"), F.xxhash64("text").alias("__h")).join(sample.select("doc_id"), "doc_id")
    # a window in one task, over the lengths of at most most_documents ids
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "__h").rowsBetween(Window.unboundedPreceding, 0)
    within = sizes.withColumn("__all", F.sum("__n").over(upto)).where(F.col("__all") <= t.most_chars).select("doc_id", "__h").distinct()
    chosen = F.broadcast(given.join(F.broadcast(within), "doc_id"))
    named = texts.select("doc_id", "text", F.nullif(F.lower(strip("lang")), F.lit("")).alias("lang"), norm_source("source").alias("source"), F.xxhash64("text").alias("__h"))
    # put in order here: a global sort in Spark would read the texts once more to sample them
    got = named.join(chosen, ["doc_id", "__h"]).withColumn("__o", F.xxhash64("doc_id")).toPandas()
    return got.sort_values(["__o", "doc_id", "text"], ignore_index=True).drop(columns=["__h", "__o"])


def subject_names(subjects: DataFrame, most: int = 10_000) -> list[str]:
    """The keys of ``subjects``, trimmed and in lower case, sorted; more than ``most`` are refused."""
    rows = subjects.where("subject is not null").select(F.lower(strip("subject"))).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} subjects")
    return sorted(r[0] for r in rows if r[0])


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """``doc_id, subject, share, probability``: one row for each subject of a document; no row for one without.

    ``share`` is the share of its sentences about the subject, ``probability`` that of its whole combination of labels. Labels are
    compared trimmed and in lower case; labels that are no key of ``subjects`` (``none``) mark a document without
    subject. Null, blank and empty texts have no subject. Without labelled documents or subjects the result is empty.
    The classifier is fitted on a bounded sample of labelled documents (``Training.most_documents``); every document is
    then decoded, its text whole. Work: a join of the labels with their documents; no exchange for decoding.
    """
    names = subject_names(subjects)
    rows = labelled(documents, labels, t)
    spark = documents.sparkSession
    if not names or not len(rows):
        return spark.createDataFrame([], SCHEMA)
    sent = sent_model(spark, fit(rows, names, t))
    # ids travel as texts: pandas would turn a column with nulls into floats
    docs = spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", norm_source("source").alias("source")), "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = received(sent.value)
        for whole in batches:
            for a in range(0, len(whole), 1000):
                b = whole.iloc[a : a + 1000].reset_index(drop=True)
                label, share, p = decode(model, b)
                d, s = np.nonzero(label)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[d], "subject": np.array(model["names"], object)[s], "share": share[d, s], "probability": p[d]})

    return docs.mapInPandas(run, SCHEMA.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """``subject, source, documents, chars``: the corpus measured by subject and source; no subject is ``none``.

    A document with several subjects counts under each.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(norm_source("source"), F.lit("unknown")).alias("source"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))
    both = docs.join(found.select("doc_id", "subject").distinct(), "doc_id", "left")
    return both.groupBy(F.coalesce("subject", F.lit("none")).alias("subject"), "source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
