"""Problem 9: reading level of each document, by smoothed unigram models per level.

Terms are the words of the running English prose and, as words and constructions count together, the constructions
between them: pairs of neighbours of which one at least is a function word, the other standing for itself only if it
is one too. A level's model is a smoothed unigram model over these terms, learned from labelled documents; a document
gets the level with the highest posterior, the sum over its terms of the log probability, with the levels' shares as
prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.visible import prose_paragraphs

#: Words of running English prose that a document must have.
LEAST_WORDS = 60
#: Labelled documents that the models are learned from at most (those with the smallest hash of their id).
MOST_LABELLED = 20_000
#: A term must be in so many labelled documents; names of single pages teach nothing.
LEAST_DOCS = 3
#: Added to each count, in shares of the level's terms.
SMOOTHING = 0.5
LEVELS = (1, 2, 3, 4)

# fixed values: English function words
FUNCTION_WORDS = frozenset(
    "a about above after again all although an and any are as at be because been before being below between both but by can cannot could "
    "did do does down during each every few for from had has have he her here his how i if in insofar into is it its itself just like many may me more "
    "most much must my near no nor not of off often on once one only or other our out over own same several she should so some such than that the their them then there "
    "these they this those though through to together too under until up upon us usually very was we were what when where whereas whether which while who whom whose why will with "
    "within without would you your".split()
)
#: A paragraph counts as English if at least this share of its words are function words or words of the models.
ENGLISH_SHARE = 0.5


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, level, text in zip(pdf["doc_id"], pdf["level"], pdf["text"]):
            times: Counter = Counter()
            for words in prose_paragraphs(text) if text else ():
                times.update(words)
                shapes = [w if w in FUNCTION_WORDS else "" for w in words]
                times.update(f"{a}_{b}" for a, b in zip(shapes, shapes[1:]) if a or b)
            rows += [(doc, level, term, n) for term, n in times.items()]
        yield pd.DataFrame(rows, columns=["doc_id", "level", "term", "times"])


def labelled_levels(labels: DataFrame) -> DataFrame:
    """``doc_id, level``: the median of a document's distinct valid labels, one per rater; ties go to the lower level."""
    valid = labels.where(F.col("reading_level").between(LEVELS[0], LEVELS[-1]) & F.col("doc_id").isNotNull())
    one = valid.select(F.col("doc_id").cast("long").alias("doc_id"), "rater", "reading_level").distinct()
    return one.groupBy("doc_id").agg(F.expr("cast(percentile_disc(0.5) within group (order by reading_level) as int)").alias("level"))


def level_models(docs: DataFrame, levels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms, their log probabilities by level, and the levels' log shares, of ``levels(doc_id, level)``.

    What is learned from is at most ``most`` documents, so the terms are bounded by what these say; no term that is in
    ``LEAST_DOCS`` of them is left out.
    """
    sample = levels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    counts = texts.mapInPandas(_counted, "doc_id long, level int, term string, times long")
    per_level = [F.sum(F.when(F.col("level") == k, F.col("times")).otherwise(0)).alias(f"level_{k}") for k in LEVELS]
    kept = counts.groupBy("term").agg(F.count("*").alias("docs"), *per_level).where(F.col("docs") >= LEAST_DOCS)
    rows = kept.toPandas().sort_values("term", ignore_index=True)
    table = rows[[f"level_{k}" for k in LEVELS]].to_numpy(dtype=float) + SMOOTHING
    logs = np.log(table / np.maximum(table.sum(axis=0), 1))
    shares = {r["level"]: r["n"] for r in sample.groupBy("level").agg(F.count("*").alias("n")).collect()}
    prior = np.array([shares.get(k, 0) + 1.0 for k in LEVELS])
    return rows["term"].tolist(), logs, np.log(prior / prior.sum())


class _Models:
    """The models as arrays: rows of words, and a square table of constructions."""

    def __init__(self, terms: list[str], logs: np.ndarray, prior: np.ndarray):
        words = [t for t in terms if "_" not in t]
        every = [*words, *sorted(FUNCTION_WORDS - set(words))]
        self.code = {w: i + 1 for i, w in enumerate(every)}
        at = {t: i for i, t in enumerate(terms)}
        self.logs = np.zeros((len(every) + 1, len(LEVELS)))
        self.logs[1 : len(words) + 1] = logs[[at[w] for w in words]] if words else 0
        function = sorted(FUNCTION_WORDS)
        self.shape = np.zeros(len(every) + 1, dtype=np.int64)
        self.shape[[self.code[w] for w in function]] = np.arange(1, len(function) + 1)
        self.side = len(function) + 1
        self.pairs = np.zeros((self.side * self.side, len(LEVELS)))
        named = ["", *function]
        where = {w: i for i, w in enumerate(named)}
        for t, i in at.items():
            if "_" in t:
                a, _, b = t.partition("_")
                self.pairs[where[a] * self.side + where[b]] = logs[i]
        self.prior = prior


def _scorer(models: _Models, least: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = models.code.get
        for pdf in batches:
            docs = pdf["doc_id"].to_numpy()
            found = [(k, p) for k, text in enumerate(pdf["text"]) if text for p in prose_paragraphs(text)]
            if not found:
                continue
            codes = np.array([get(w, 0) for _, p in found for w in p], dtype=np.int64)
            sizes = np.array([len(p) for _, p in found])
            known = np.add.reduceat((codes > 0).astype(np.int64), np.cumsum(sizes) - sizes)
            english = known >= ENGLISH_SHARE * sizes
            owner = np.repeat(np.array([k for k, _ in found]), sizes)
            part = np.repeat(np.arange(len(found)), sizes)
            keep = np.repeat(english, sizes)
            codes, owner, part = codes[keep], owner[keep], part[keep]
            n = np.bincount(owner, minlength=len(docs))
            shape = models.shape[codes]
            pair = models.pairs[shape[:-1] * models.side + shape[1:]] * (part[:-1] == part[1:])[:, None]
            total = np.stack([np.bincount(owner, models.logs[codes, c], len(docs)) + np.bincount(owner[:-1], pair[:, c], len(docs)) for c in range(len(LEVELS))], axis=1)
            at = np.flatnonzero((n >= least) & (total.min(axis=1) < 0))
            total = total[at] + models.prior
            order = np.sort(total, axis=1)
            yield pd.DataFrame({"doc_id": docs[at], "reading_level": np.array(LEVELS)[total.argmax(axis=1)], "n_words": n[at], "margin": order[:, -1] - order[:, -2]})

    return score


def scored(docs: DataFrame, levels: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, reading_level, n_words, margin`` by models of ``levels(doc_id, level)``."""
    models = _Models(*level_models(docs, levels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInPandas(_scorer(models, least), "doc_id long, reading_level int, n_words long, margin double")


def held_out_levels(docs: DataFrame, labels: DataFrame, parts: int = 5, least: int = LEAST_WORDS) -> DataFrame:
    """``level, reading_level, n_docs``: labelled documents by the raters' level and that of models which were learned
    from the other parts of the labelled documents; every labelled document is held out once."""
    levels = labelled_levels(labels).withColumn("part", F.expr(f"pmod(xxhash64(doc_id, 'part'), {parts})"))
    found = None
    for part in range(parts):
        own = levels.where(F.col("part") == part).select("doc_id", "level")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        models = _Models(*level_models(docs, levels.where(F.col("part") != part).select("doc_id", "level")))
        rows = texts.join(own.select("doc_id"), "doc_id", "left_semi").where("text is not null")
        named = rows.mapInPandas(_scorer(models, least), "doc_id long, reading_level int, n_words long, margin double").join(own, "doc_id")
        found = named if found is None else found.unionByName(named)
    return found.groupBy("level", "reading_level").agg(F.count("*").alias("n_docs"))


def reading_levels(docs: DataFrame, labels: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, reading_level, n_words, margin`` of each document with at least ``least`` words of English prose.

    Null, empty and foreign texts have no row, nor have texts without any known term. Without labels there is
    nothing to learn from and no document gets a level.
    """
    return scored(docs, labelled_levels(labels), least)
