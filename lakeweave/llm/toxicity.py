"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, written
from lakeweave.llm.learn import held_out, labelled_sample
from lakeweave.llm.words import Words, slices, split_words

BITS = 18
MASK = (1 << BITS) - 1
#: Lengths of words' beginnings that are looked at.
STEMS = (4, 5, 6, 7, 8)
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’¿¡…"
ENDS = (".", "!", "?", "…")
#: Words without an end mark, as in tables, make sentences of at most so many.
LONGEST = 40
#: Words get weights that are in so many texts at least and make label 1 likelier by so much, as a logarithm.
LEAST_TEXTS, START = 3, 1.0
#: The sum that a sentence starts from, and the most that a text scores which says nothing telling.
BIAS, MOST_BASE = -9.0, 0.4
#: Training weighs label 1 as if so many texts had it at least: a toxic text left in costs more than a clean one lost.
LEAST_SHARE = 0.3
#: Words of the sample that go to the driver at most; texts beyond that, by id, are left out of the fit.
MOST_WORDS = 20_000_000


def _slots(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, each length as a mark of longer words only; -1 where it isn't longer. What a language derives from one stem is told by that, however rare each form is."""
    word = word.strip(STRIP).lower()
    return [xxhash.xxh3_64_intdigest(word) & MASK, *(xxhash.xxh3_64_intdigest(word[:k] + "+") & MASK if len(word) > k else -1 for k in STEMS)]


def features(w: Words) -> np.ndarray:
    """``_slots`` of each distinct word, a row each."""
    return np.array([_slots(x) for x in w.distinct], np.int64).reshape(-1, 1 + len(STEMS))


def sentence_features(slots: np.ndarray, codes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """sentence << BITS | slot of all words, each once in a sentence, in order; slots of -1 are none."""
    every = slots[codes]
    keys = (number[:, None] << BITS | every)[every >= 0]
    return np.unique(keys)


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of the sentence that each word is in, counted through all texts, and each sentence's text. A sentence ends with a word that ends in a full stop or the like, after ``LONGEST`` words, or with its text."""
    if not len(w.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.array([x.rstrip("\"'»”)]*#$%&|").endswith(ENDS) for x in w.distinct], bool)[w.codes]
    last[w.ends[w.ends > 0] - 1] = True
    begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(last)) - np.repeat(begins, np.diff(np.append(begins, len(last))))
    last |= place % LONGEST == LONGEST - 1
    number = np.cumsum(last) - last
    text = np.repeat(np.arange(len(w.ends)), np.diff(w.ends, prepend=0))
    return number, text[last]


def _clean(z: np.ndarray, bias: float) -> np.ndarray:
    """Logarithm of how much likelier a plain sentence is left than one of sum ``z``."""
    return np.logaddexp(0, bias) - np.logaddexp(0, np.clip(z, -30, 30))


@dataclass
class NoisyOr:
    """Weights of hashed words and a text's base score; a text's score is 1 - (1 - base) prod(1 - sentence).

    A sentence's score is what its words, each once, add to the logistic of the bias: it is 0
    without a telling word, so that plain sentences, however many, don't move a text's score.
    From the logarithm of the product goes what as many sentences of clean texts have by the way,
    ``rate`` each, but the strongest sentence always counts in full: no padding hides it.
    """

    weight: np.ndarray
    bias: float
    base: float = 0.0
    rate: float = 0.0

    def sentence_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score and text of each sentence, and the sentence of each word."""
        number, text = sentences(w)
        slots = features(w)
        slots[self.weight[slots] == 0] = -1  # weight[-1] is a slot's too, and stays -1
        tells = (slots >= 0).any(axis=1)[w.codes]
        once = sentence_features(slots, w.codes[tells], number[tells])
        total = np.bincount(once >> BITS, self.weight[once & MASK], len(text)) if len(text) else np.zeros(0)
        return -np.expm1(_clean(self.bias + total, self.bias)), text, number

    def scores(self, w: Words) -> np.ndarray:
        p, text, _ = self.sentence_scores(w)
        return self.combined(p, text, len(w.ends))

    def combined(self, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from those of their sentences."""
        h = -np.log1p(-np.minimum(p, 1 - 1e-12))
        total, most = np.bincount(text, h, n), np.zeros(n)
        np.maximum.at(most, text, h)
        return 1 - (1 - self.base) * np.exp(-np.maximum(most, total - self.rate * np.bincount(text, minlength=n)))


def said(w: Words, number: np.ndarray, sentence: int) -> str:
    """The words of a sentence, joined by spaces."""
    a, b = np.searchsorted(number, [sentence, sentence + 1])
    return " ".join(w.distinct[c] for c in w.codes[a:b])


def train(words: np.ndarray, sentence: np.ndarray, text: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, share: float | None = None, rounds: int = 150, rate: float = 0.05, ridge: float = 3e-3, least_texts: int = LEAST_TEXTS, start: float = START) -> NoisyOr:
    """Fit on words (hashed), each one's sentence, each sentence's text, and the texts' labels and numbers of sentences ``n``, by Adam on the log loss.

    With ``share``, texts are weighted as if label 1 had that share of them. The base score is
    the share of label 1 in texts without any of the words, at most ``MOST_BASE``; without labels
    of both kinds all scores are 0.

    Words of fewer than ``least_texts`` texts get no weight: they would only learn single labels by heart.
    """
    model = NoisyOr(np.zeros(1 << BITS), BIAS)
    if not len(y) or y.min() == y.max():
        return model
    share = y.mean() if share is None else share
    balance = np.where(y > 0.5, share / y.mean(), (1 - share) / (1 - y.mean()))
    bare = np.bincount(text[sentence], minlength=len(y)) == 0
    model.base = float(min(MOST_BASE, ((balance * y)[bare].sum() + share) / (balance[bare].sum() + 1)))
    if not len(words):
        return model
    pairs = np.unique(words.astype(np.int64) * (len(y) + 1) + text[sentence])
    has = pairs // (len(y) + 1)
    times, bad = (np.bincount(has, v, 1 << BITS) for v in (None, y[pairs % (len(y) + 1)]))
    del pairs, has
    common = times[words] >= least_texts
    sentence = sentence[common]
    once = np.unique(sentence.astype(np.int64) << BITS | words[common])
    sentence = once >> BITS
    slots, at = np.unique((once & MASK).astype(np.int32), return_inverse=True)
    del once, common
    # each word starts at how much likelier it makes label 1 by itself: words of copied texts then explain no others away
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((times - bad + 0.5) / (len(y) - y.sum() + 1))
    theta = np.append(1.5 * np.clip(odds[slots] - start, 0, None), model.bias)
    held = ridge / times[slots]  # rare words are held back the more
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(sentence, theta[at], len(text)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = (1 - model.base) * np.exp(np.bincount(text, _clean(z, model.bias), len(y)))
        doc = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for label 0; p (doc - 1) / doc for label 1
        slope = p * (balance * (1 - y / doc))[text] / len(y)
        grad = np.append(np.bincount(at, slope[sentence], len(slots)), 0) + np.append(held * theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])  # no word speaks for a sentence: padding an insult must not hide it
    model.weight[slots], model.bias = theta[:-1], float(theta[-1])
    if n is not None:
        left = _clean(model.bias + np.bincount(sentence, theta[at], len(text)), model.bias)
        model.rate = float(-left[y[text] < 0.5].sum() / max(1, n[y < 0.5].sum()))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, most: int = 8_000) -> NoisyOr:
    """A model fitted on at most ``most`` labelled documents, one a doc_id, with at most ``MOST_WORDS`` words.

    Spark counts which words and beginnings of words speak for label 1; only the places of these
    reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=2 << 20):
            w = split_words(batch.column("text"))
            number, text = sentences(w)
            n = np.bincount(text, minlength=len(w.ends))
            once = sentence_features(features(w), w.codes, number)
            sentence = once >> BITS
            ends = np.cumsum(np.bincount(text[sentence], minlength=len(w.ends)))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            local = sentence - (np.cumsum(n) - n)[text[sentence]]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(n.astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (once & MASK, local))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "n", "words", "sentence"])

    sample = labelled_sample(docs, labels, label, modulus, remainder, most)
    sample = written(sample.mapInArrow(run, "doc_id long, label double, n int, words array<int>, sentence array<int>"), "sample")
    size = sample.select("doc_id", F.size("words").alias("size")).toArrow().sort_by("doc_id")
    over = np.cumsum(size.column("size").to_numpy().astype(np.int64)) > MOST_WORDS
    if over.any():  # from this id on
        sample = sample.where(F.col("doc_id") < int(size.column("doc_id")[int(over.argmax())].as_py()))
    known = sample.select("doc_id", "label", "n").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("n", "ascending")])
    y, n = known.column("label").to_numpy(), known.column("n").to_numpy()
    by_word = sample.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.sum("label").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (y.sum() + 1)) - F.log((F.col("times") - F.col("bad") + 0.5) / (len(y) - y.sum() + 1))
    tells = by_word.where((F.col("times") >= LEAST_TEXTS) & (odds > START)).select("word")  # at most 2**BITS numbers
    at = sample.select("doc_id", F.explode(F.arrays_zip("words", "sentence")).alias("at")).select("doc_id", F.col("at.words").alias("word"), F.col("at.sentence").alias("sentence"))
    got = at.join(F.broadcast(tells), "word").toArrow().sort_by([("doc_id", "ascending"), ("sentence", "ascending"), ("word", "ascending")])
    share = labels.where(F.col(label).isNotNull() & ~held_out("doc_id", modulus, remainder)).agg(F.avg(label)).first()[0]
    ids = known.column("doc_id").to_numpy()
    owner = np.searchsorted(ids, got.column("doc_id").to_numpy())  # rows of one id count as its first
    place = got.column("sentence").to_numpy().astype(np.int64)
    key, sentence = np.unique(owner.astype(np.int64) << 32 | place, return_inverse=True)
    text = key >> 32
    return train(got.column("word").to_numpy(), sentence, text, y, n, max(share or 0.0, LEAST_SHARE))


def score_toxicity(docs: DataFrame, model: NoisyOr, modulus: int = 5, remainder: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, and of texts that reach the threshold the sentence that scores highest: worst_sentence (its number from 0), worst_score, worst_words (null for all others).

    Null, empty and blank texts have no sentences and score as any text that says nothing telling.
    Without labels of both kinds all texts score 0. Repeated rows give repeated results, also
    under null ids; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=2 << 20):
            w = split_words(batch.column("text"))
            p, text, number = model.sentence_scores(w)
            score = model.combined(p, text, len(w.ends))
            place: list[int | None] = [None] * len(score)
            worst: list[float | None] = [None] * len(score)
            words: list[str | None] = [None] * len(score)
            first = np.searchsorted(text, np.arange(len(score) + 1))
            for i in np.flatnonzero((score >= threshold) & (np.diff(first) > 0)).tolist():
                place[i] = int(p[first[i] : first[i + 1]].argmax())
                worst[i], words[i] = float(p[first[i] + place[i]]), said(w, number, first[i] + place[i])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(place, pa.int32()), pa.array(worst, pa.float64()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_score", "worst_words"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(id_col, modulus, remainder).alias("held_out"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_sentence int, worst_score double, worst_words string")


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sentence that reaches the threshold: doc_id, sentence (from 0), score, its words joined by spaces.

    Null, empty and blank texts have none. Repeated rows give repeated results; an empty table
    gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=2 << 20):
            w = split_words(batch.column("text"))
            p, text, number = model.sentence_scores(w)
            bad = np.flatnonzero(p >= threshold)
            first = np.searchsorted(text, text[bad])
            words = [said(w, number, s) for s in bad.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text[bad])), pa.array((bad - first).astype(np.int32)), pa.array(p[bad]), pa.array(words, pa.string())], ["doc_id", "sentence", "score", "words"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentence int, score double, words string")


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text reaches the threshold; all columns, whatever their names, stay as they are.

    Each row is judged by its text alone, so that null and repeated ids play no part. Null, empty
    and blank texts stay; an empty table gives no rows.
    """

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        for t in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(t, pa.string(), from_pandas=True)], ["text"])
            yield pd.Series(np.concatenate([np.zeros(0), *(model.scores(split_words(b.column("text"))) for b in slices([batch], most_bytes=2 << 20))]))

    from collections.abc import Iterator as It

    import pandas as pd

    run.__annotations__ = {"texts": It[pd.Series], "return": It[pd.Series]}
    return docs.where(F.pandas_udf(run, "double")(column(text_col)) < threshold)
