"""Language identification as a mixture: which languages a text holds, and how much of each.

A language is a distribution over hashed character n-grams (two or three characters of the lower-cased letters of
words and their edges). For a text, expectation-maximisation finds the proportions that make its n-grams likeliest. The
set of languages is chosen by penalised likelihood: languages are ordered by their share in the fit with all of
them, the first k are fitted for growing k, and a further language must raise the log-likelihood by more than its
penalty, which grows with the logarithm of the text's length.

Counts are summed over all labelled texts: each partition folds its texts to one count for each language and bucket,
so what reaches the driver is bounded by languages times buckets.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text when nothing can
be learned; null languages and null ids are not learned from; repeated rows count as often as they occur; extra
columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import parts, table_of

BUCKET_BITS = 14
PENALTY = 12.0
ROUNDS = 15
COUNTS = "lang string, bucket int, n long"
MIXTURES = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"
_LETTERS = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W\d_]+")


def ngrams(text: str | None) -> np.ndarray | None:
    """The bucket of each n-gram of a text; None if it has no letter."""
    # Signs such as fractions and Roman numerals pass the pattern, but are no letters.
    if not text or not any(m.group().isalpha() for m in _LETTERS.finditer(text)):
        return None
    c = np.frombuffer((" " + _GAPS.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    grams = np.concatenate([two, three])
    grams ^= grams >> np.uint32(16)
    grams *= np.uint32(0x27D4EB2F)
    grams >>= np.uint32(32 - BUCKET_BITS)
    return grams


@dataclass
class Languages:
    """Names and, for each bucket, each language's probability."""

    names: list[str]
    table: np.ndarray  # buckets x languages

    def mixture(self, grams: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The languages of a text and their proportions, largest first."""
        counts = np.bincount(grams, minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(float), self.table[at]
        total = n.sum()

        def fit(which: list[int], start: np.ndarray) -> tuple[np.ndarray, float]:
            if len(which) == 1:
                return np.ones(1), float(n @ np.log(p[:, which[0]]))
            q, share = p if len(which) == k else p[:, which], start
            for _ in range(ROUNDS):
                new = share * ((n / (q @ share)) @ q) / total
                done = np.abs(new - share).max() < 1e-3
                share = new
                if done:
                    break
            return share, float(n @ np.log(q @ share))

        k = len(self.names)
        share = np.full(k, 1 / k)
        for _ in range(ROUNDS):
            new = share * ((n / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        order = np.argsort(-share, kind="stable").tolist()
        chosen = order[:1]
        best = fit(chosen, np.ones(1))
        cost = PENALTY * np.log(total)
        for m in range(2, k + 1):
            start = share[order[:m]]
            more = fit(order[:m], start / start.sum())
            if more[1] - best[1] <= cost:
                break
            best, chosen = more, order[:m]
        by = np.argsort(-best[0], kind="stable")
        return [chosen[i] for i in by], best[0][by]


def learn(labelled: DataFrame, smoothing: float = 0.5) -> Languages:
    """Learn from rows ``text, lang``: all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in parts(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                grams = ngrams(text)
                if grams is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                    sums[lang] += np.bincount(grams, minlength=1 << BUCKET_BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield table_of(COUNTS, ([lang] * len(at), at, total[at]))

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = sums.toArrow()  # languages times buckets at most
    names = sorted(counts.column("lang").unique().to_pylist())
    table = np.full((1 << BUCKET_BITS, len(names)), smoothing)
    for k, name in enumerate(names):
        part = counts.filter(pc.equal(counts.column("lang"), name))
        table[part.column("bucket").to_numpy(), k] += part.column("n").to_numpy()
    return Languages(names, table / table.sum(0) if names else table)


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's share) and the mixture as parallel arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for text in b.column("text").to_pylist():
                grams = ngrams(text) if model.names else None
                if grams is None:
                    rows.append(("und", 0.0, [], []))
                else:
                    which, share = model.mixture(grams)
                    rows.append((model.names[which[0]], float(min(1.0, share[0])), [model.names[i] for i in which], share.tolist()))
            yield table_of(MIXTURES, (b.column("doc_id"), *zip(*rows, strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MIXTURES)


def held_out(doc_id: Column) -> Column:
    """The fold whose languages are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
