"""Language ID as multilingual mixture inference.

Every language has a model of letter trigrams. A document is a mixture: each of its trigrams comes
from language l with proportion p_l. Expectation-maximisation finds the proportions of greatest
likelihood; the set of languages grows by the one that gains most, as long as the gain in log
likelihood pays the penalty for one more proportion (half of the logarithm of the trigram count, times
``penalty``). The language predicted is the one with the largest proportion.

Counting trigrams, learning and predicting run in Spark tasks. Every language of the learning rows has a model; the
models are one table of languages x hashed trigrams: 65,536 of them, fewer for more than 128 languages, so that it has
8,388,608 cells at most up to 2,048 languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UNIT, small, unit_hash, written

BINS = 1 << 16
#: Cells of the models' table, and hashed trigrams that a language has at least.
CELLS, FEWEST = 1 << 23, 1 << 12
#: Documents of each language that fit the models, at most.
FIT_DOCS = 500
PENALTY, TOLERANCE = 4.0, 1e-4
UND = "und"


@cache
def _letters() -> np.ndarray:
    """True for the code points that are letters, of all planes."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def bins_for(languages: int) -> int:
    """Hashed trigrams, a power of two."""
    return max(FEWEST, min(BINS, CELLS >> (max(1, languages) - 1).bit_length()))


def trigrams(text: str) -> np.ndarray | None:
    """Hashed trigrams of the text's lower-cased words, each word between two spaces; None if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.concatenate(([32], np.where(letter, c, 32), [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one space between words
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram in each) from doc_id, text, lang.

    Rows of the held-out fold and rows without doc_id, text or lang teach nothing. Every other value of lang is learned. Of
    each language the ``fit_docs`` rows that come first by a hash of their id are counted, whole.
    """
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    # Hashes below a language's bound leave it about four times as many rows as it needs, so few are ranked.
    place = unit_hash(F.col("doc_id").cast("string"))
    bounds = written(known.groupBy("lang").agg((F.lit(4.0 * fit_docs * UNIT) / F.count("*")).alias("bound")), "langid-languages")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    few = known.select("doc_id", "lang", place.alias("place")).join(small(bounds), "lang").filter("place < bound")
    ids = few.withColumn("n", order).filter(F.col("n") <= fit_docs).select("doc_id").distinct()
    ids = written(ids, "langid-sample")  # at most languages x fit_docs rows
    bins = bins_for(bounds.count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if (h := trigrams(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.bincount(h % bins, minlength=bins)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": n[at]})

    counts = known.join(small(ids), "doc_id", "left_semi").select("lang", "text").mapInPandas(count, "lang string, bin int, n long")
    got = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # languages x bins rows at most
    names = sorted(set(got["lang"]))
    table = np.full((len(names), bins), 0.1, np.float32)
    table[np.searchsorted(names, got["lang"].to_numpy(str)) if names else [], got["bin"]] += got["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


def held_out():
    """True for the fifth of the documents that is not learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mixture(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns of p (probabilities of each trigram) for counts n, and their log likelihood."""
    w, before = start, -np.inf
    while True:  # the likelihood grows with each step and is bounded
        mixed = p @ w
        now = float(n @ np.log(mixed))
        if now - before < TOLERANCE:
            return w, now
        w, before = w * ((n / mixed) @ p) / n.sum(), now


def infer(h: np.ndarray, logs: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of all languages in a document of those trigrams."""
    bins, n = np.unique(h % logs.shape[1], return_counts=True)
    l = logs[:, bins]
    total = n.sum()
    p = np.exp(l - l.max(axis=0)).T.astype(np.float64)  # scaled for each trigram, which moves no proportion
    n = n.astype(np.float64)
    chosen = [int(np.argmax(l @ n))]
    w, best = np.ones(1), float(n @ np.log(p[:, chosen[0]]))
    cost = penalty * 0.5 * np.log(max(2, total))
    while len(chosen) < p.shape[1]:
        # A language m adds nothing if sum n p_m / mix <= total: the likelihood is concave in the proportions.
        gain = (n / (p[:, chosen] @ w)) @ p
        gain[chosen] = 0
        rest = [m for m in np.argsort(-gain, kind="stable") if gain[m] > total]
        tried = [(*mixture(p[:, [*chosen, m]], n, np.append(w * 0.9, 0.1)), int(m)) for m in rest]
        more, now, m = max(tried, key=lambda x: x[1], default=(None, -np.inf, -1))
        if now - best <= cost:
            break
        chosen, w, best = [*chosen, m], more, now
    out = np.zeros(p.shape[1])
    out[chosen] = w / w.sum()
    return out


PREDICTED = "held_out boolean, lang_pred string, score double, languages string"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, languages (name:proportion, largest first).

    score is the proportion of lang_pred. Null text, text without letters, and any text if no language
    was learned are "und" with score 0 and no languages; ties go to the first name. Whole texts are read. If `whole`, all
    columns of docs come along as a struct named row instead of doc_id, so their names can't clash.
    """
    names, held = model[0], docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value[1]
        for batch in batches:
            lang, score, mix = [], [], []
            texts = batch.column("row").field("text") if whole else batch.column("text")
            for text in texts.to_pylist():
                h = trigrams(text) if text and names else None
                if h is None:
                    lang.append(UND), score.append(0.0), mix.append("")
                    continue
                w = infer(h, logs)
                order = np.argsort(-w, kind="stable")
                lang.append(names[order[0]])
                score.append(float(min(1.0, w[order[0]])))
                mix.append(",".join(f"{names[k]}:{w[k]:.3f}" for k in order if w[k] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], names=[batch.schema.names[0], "held_out", "lang_pred", "score", "languages"])

    if whole:
        ready = docs.select(F.struct(*docs.columns).alias("row"), held_out().alias("held_out"))
    else:
        ready = docs.select("doc_id", held_out().alias("held_out"), "text")
    first = ready.schema.fields[0]
    return ready.mapInArrow(run, f"{first.name} {first.dataType.simpleString()}, {PREDICTED}")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, learn(docs))
