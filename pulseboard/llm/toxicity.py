"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguise: lower case, characters of other scripts that look like Latin letters, digits and
signs put for letters, invisible characters. Lexicon entries are words and word beginnings, learned from
labelled documents by their log odds; phrases that excuse an entry are matched by the same automaton.
The weight found, in proportion to the text's length, goes through a logistic curve fitted on the same
labelled documents.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, column, id_crc32, out_batch, pieces

# Characters that look like a Latin letter, and what stands for letters in disguise.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѐ": "e",
}
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SAME = {"l": "i"}  # 1 may stand for either, so they fold to one letter
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")


def fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): " " for c in string.punctuation + string.whitespace}
    for group in (LOOKALIKE, DISGUISE):
        table.update({ord(a): SAME.get(b, b) for a, b in group.items()})
    for k in range(26):  # full-width letters
        letter = chr(ord("a") + k)
        table[0xFF41 + k] = SAME.get(letter, letter)
    table.update({ord(a): b for a, b in SAME.items()})
    table.update({ord(c): None for c in INVISIBLE})
    table[ord("'")] = None
    return table


TABLE = fold_table()


def fold(text: str) -> str:
    """The text folded, words between single spaces' worth of separators, a space at both ends."""
    return f" {text.lower().translate(TABLE)} "


def entries_of(word: str, prefixes: Sequence[int]) -> list[str]:
    """Lexicon entries that a folded word supports: itself and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in prefixes if len(word) > k)]


class Matcher:
    """Aho-Corasick over lexicon entries (weight, is it a strong one) and exception phrases."""

    def __init__(self, lexicon: dict[str, tuple[float, bool]], exceptions: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, (w, strong) in lexicon.items():
            self.automaton.add_word(entry, (len(entry), (strong, w)))
        for phrase in exceptions:
            entry = " " + " ".join(fold(phrase).split()) + " "
            self.automaton.add_word(entry, (len(entry), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, float, int, int]:
        """(weight of the strong words found, of the weak ones, how many are strong, words of the text). A word
        counts once, by its strongest entry."""
        folded = fold(text)
        n = len(folded.split())
        found: dict[int, tuple[bool, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, w) in () if self.empty else self.automaton.iter(folded):
            start = end - size + 1
            if w is None:
                excused.append((start, end))
            elif start not in found or w > found[start]:
                found[start] = w
        for a, b in excused:
            for at in [x for x in found if a <= x < b]:
                del found[at]
        strong = [w for s, w in found.values() if s]
        return sum(strong), sum(w for s, w in found.values() if not s), len(strong), n


def features(strong: np.ndarray, weak: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text: strong and weak weight by length, and the number of hits, all damped, and a constant."""
    return np.stack([np.log1p(100 * strong / (words + 20)), np.log1p(100 * weak / (words + 20)), np.log1p(hits), np.ones(len(strong))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; the ridge also holds for one-sided labels."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)") \
        .where(id_crc32(F.col("doc_id")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.join(bounded_sample(known.select("doc_id"), sample), "doc_id")
    # at most `sample` rows of two numbers
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


def learn_lexicon(known: DataFrame, prefixes: Sequence[int] = (4, 5, 6, 7, 8), least: int = 4, size: int = 4000, weak: float = 1.5) -> dict[str, tuple[float, bool]]:
    """At most ``size`` entries that stand in at least ``least`` toxic documents, with (weight, strong).

    Strong: of the documents that hold the entry more are toxic than not, by two standard errors of the log
    odds; weight: the log odds less those errors. Weak: the odds are raised by ``weak`` and more, less two
    standard errors, against those of all documents; weight: by how much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                if counts[k]:
                    yield out_batch(entry=list(counts[k]), toxic=pa.array([k] * len(counts[k]), pa.int32()), n=pa.array(list(counts[k].values()), pa.int64()))
                counts[k].clear()

        for b in pieces(batches):
            for text, toxic in zip(column(b, "text"), column(b, "toxic"), strict=True):
                counts[toxic].update({e for w in set(fold(text or "").split()) if len(w) > 2 for e in entries_of(w, prefixes)})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from flush()
        yield from flush()

    n = known.mapInArrow(run, "entry string, toxic int, n bigint").groupBy("entry").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b"))
    total = known.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    prior = float(np.log((total["n"] - (total["a"] or 0) + 1) / ((total["a"] or 0) + 1)))
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)) - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = n.where(F.col("a") >= least).withColumn("odds", odds).where((F.col("odds") > 0) | (F.col("odds") + prior > weak)).orderBy(F.desc("odds"), "entry").limit(size)
    return {r["entry"]: (r["odds"], True) if r["odds"] > 0 else (r["odds"] + prior, False) for r in best.collect()}


def measured(docs: DataFrame, matcher_of: tuple[dict, Sequence[str]], *keep: str) -> DataFrame:
    """doc_id, the columns named, and strong, weak, hits, words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*matcher_of)
        for b in pieces(batches):
            strong, weak, hits, words = zip(*[m.measure(t or "") for t in column(b, "text")], strict=True) if b.num_rows else ((), (), (), ())
            cols = {c: b.column(b.schema.get_field_index(c)) for c in ("doc_id", *keep)}
            yield out_batch(**cols, strong=pa.array(strong, pa.float64()), weak=pa.array(weak, pa.float64()), hits=pa.array(hits, pa.int64()), words=pa.array(words, pa.int64()))

    kept = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in ("doc_id", *keep))
    return docs.mapInArrow(run, f"{kept}, strong double, weak double, hits bigint, words bigint")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, cut: float = 0.7, exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id's text mod 3 is 1), score (0 to 1),
    predicted (score >= ``cut``), hits (lexicon words found).

    Lexicon and curve are learned from at most ``sample`` labelled documents that are not held out (smallest
    hash first); labels other than 0 and 1 and null ids are passed over. With no label of one kind the
    score is that of a curve held near one half by its ridge, or 0 without any label. Null text counts as
    empty and gets the curve's value at no hits. Repeated rows give repeated results."""
    known = labelled_sample(docs, labels, sample)
    lexicon = learn_lexicon(known)
    parts = ("strong", "weak", "hits", "words")
    seen = measured(known, (lexicon, exceptions), "toxic").select("toxic", *parts).toPandas()  # at most `sample` rows of numbers
    w = fit_logistic(features(*(seen[c].to_numpy(float) for c in parts)), seen["toxic"].to_numpy(float)) if len(seen) else np.array([0.0, 0.0, 0.0, -30.0])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = lambda c: F.log1p(100 * F.col(c) / (F.col("words") + 20))
    z = float(w[0]) * share("strong") + float(w[1]) * share("weak") + float(w[2]) * F.log1p(F.col("hits").cast("double")) + float(w[3])
    score = 1 / (1 + F.exp(-z))
    return measured(texts, (lexicon, exceptions)).select(
        "doc_id", (id_crc32(F.col("doc_id")) % 3 == 1).alias("held_out"), score.alias("score"), F.when(score >= cut, 1).otherwise(0).alias("predicted"), "hits")
