"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A word's vector is the mean of the embeddings of itself and of its character n-grams, all hashed into one
table; a text's vector is the mean of its words'. Each subject has its own logistic output, so a text may have
none, one or several.

Training is data-parallel: in each round every partition sums the gradients of its rows at the current
parameters, the sums are added up in one task (their size is fixed by the table, not by the data), and the driver
makes one Adam step. The first stage learns from whole documents and their hand labels, weighted by the annotators'
agreement; the second from the sentences of the same documents, of which a sentence counts for a subject if
its document does and the first stage agrees. At most ``MAX_LABELLED`` labelled documents are used, those with
the smallest hash of their id.

The outputs are independent: a sentence is about each subject whose output says yes, and a document about each
subject that at least a quarter of its sentences are about. Every document is scored, by blocks of texts: words
become numbers and a sentence's outputs the mean of its words' outputs.

A sentence is a piece of a text, up to the end of a line or a blank after a mark, that has at least
``LEAST_WORDS`` words and ends with a mark.

Defined results: null, blank and odd texts have no sentences and no subjects; labels are compared without
letter case and outer blanks, unknown ones are ignored, null means none; repeated labels count once; no
labels at all give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import Scan, scan, sentence_words
from corpuscle.session import cut

BITS, DIM, GRAMS, MAX_LABELLED, ROUNDS, RATE = 15, 16, (3, 5), 8000, (30, 15), 0.08
TABLE = 1 << BITS
SHARE = 0.25
LEAST_WORDS = 4
#: Labelled documents a training task has at least; words whose features a worker keeps.
TASK, KEPT = 250, 300_000


def features(word: str) -> np.ndarray:
    """Rows of the table for a word: its own, and those of its character n-grams."""
    w = f"<{word}>"
    parts = [w] + [w[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(w) - n + 1) if n < len(w)]
    return np.array([xxhash.xxh32_intdigest(p) & (TABLE - 1) for p in parts], "i4")


class Lexicon:
    """Numbers for words, and something kept of each; emptied when it grows beyond what a worker should hold."""

    def __init__(self, keep):
        self.keep, self.number, self.kept = keep, {}, []

    def numbers(self, s: Scan) -> np.ndarray:
        """The number of each word of the block."""
        u, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
        if len(self.kept) + len(u) > KEPT:
            self.number, self.kept = {}, []
        out = np.empty(len(u), "i8")
        for k, (h, at) in enumerate(zip(u.tolist(), first.tolist())):
            n = self.number.get(h)
            if n is None:
                n = self.number[h] = len(self.kept)
                self.kept.append(self.keep(s.word(at)))
            out[k] = n
        return out[inverse]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where each key begins in it."""
    o = np.argsort(key, kind="stable").astype("i4")
    return o, np.flatnonzero(np.diff(key[o], prepend=-1)).astype("i4")


def examples(numbers: np.ndarray, lexicon: Lexicon, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, groups: int, y: np.ndarray) -> pd.DataFrame:
    """One row with a block of examples: each is a group of sentences, the mean of its words' vectors, which are means of table rows.

    ``rows`` of the block's distinct words and their ``sizes``; ``word`` and ``share`` of each example and word, and how
    many of them an example has (``of``); ``y``; and the orders by table row and by word in which gradients are summed.
    """
    n = hi - lo
    word = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
    used, inverse = np.unique(numbers[word], return_inverse=True)
    f = [lexicon.kept[k] for k in used]
    key, times = np.unique(np.repeat(group, n) * max(1, len(used)) + inverse, return_counts=True)
    g, w = key // max(1, len(used)), (key % max(1, len(used))).astype("i4")
    words = np.bincount(g, times, groups)
    rows = np.concatenate(f).astype("i4") if f else np.empty(0, "i4")
    by_row, row_at = _grouped(rows)
    by_word, word_at = _grouped(w)
    parts = {"rows": rows, "sizes": np.array([len(x) for x in f], "i4"), "word": w, "share": (times / words[g]).astype("f4"), "of": np.bincount(g, minlength=groups).astype("i4"), "y": y.astype("f4"), "by_row": by_row, "row_at": row_at, "by_word": by_word, "word_at": word_at}
    return pd.DataFrame({k: [v.tobytes()] for k, v in parts.items()})


ROW = ", ".join(f"{c} binary" for c in "rows sizes word share of y by_row row_at by_word word_at".split())


SUMS = "g binary, n long, loss double"


class Model(NamedTuple):
    subjects: tuple[str, ...]
    e: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def outputs(self) -> np.ndarray:
        """What each row of the table adds to each subject's output."""
        return (self.e @ self.w).astype("f4")


def _gradient(parameters):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, w, b = parameters.value
        de, dw, db, n, loss = np.zeros_like(e), np.zeros_like(w), np.zeros_like(b), 0, 0.0
        for x in batches:
            for r in x.to_dict("records"):
                r = {k: np.frombuffer(v, "f4" if k in ("share", "y") else "i4") for k, v in r.items()}
                of = r["of"]
                some = of > 0
                if not some.any():
                    continue
                y, of, size = r["y"].reshape(len(some), -1)[some], of[some], r["sizes"][:, None]
                u = np.add.reduceat(e[r["rows"]], np.r_[0, np.cumsum(r["sizes"])[:-1]]) / size
                share = r["share"][:, None]
                h = np.add.reduceat(u[r["word"]] * share, np.r_[0, np.cumsum(of)[:-1]])
                p = 1 / (1 + np.exp(-(h @ w + b)))
                g = (p - y).astype("f4")
                dw += h.T @ g
                db += g.sum(0)
                dh = np.repeat((g @ w.T).astype("f4"), of, axis=0) * share
                du = np.add.reduceat(dh[r["by_word"]], r["word_at"]) / size
                du = np.repeat(du, r["sizes"], axis=0)[r["by_row"]]
                de[r["rows"][r["by_row"]][r["row_at"]]] += np.add.reduceat(du, r["row_at"])
                n += len(of)
                loss -= float((y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum())
        if n:
            yield pd.DataFrame({"g": [np.r_[de.ravel(), dw.ravel(), db].astype("f4").tobytes()], "n": [n], "loss": [loss]})

    return run


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    g, n, loss = 0.0, 0, 0.0
    for x in batches:
        for r in x.itertuples():
            g, n, loss = g + np.frombuffer(r.g, "f4"), n + r.n, loss + r.loss
    if n:
        yield pd.DataFrame({"g": [g.astype("f4").tobytes()], "n": [n], "loss": [loss]})


def _descend(rows: DataFrame, model: Model, rounds: int) -> Model:
    """Synchronous rounds of Adam over rows that hold a block of examples each."""
    e, w, b = model.e.copy(), model.w.copy(), model.b.copy()
    m = v = 0.0
    for t in range(1, rounds + 1):
        sent = rows.sparkSession.sparkContext.broadcast((e, w, b))
        got = rows.mapInPandas(_gradient(sent), SUMS).repartition(1).mapInPandas(_sum, SUMS).collect()
        sent.destroy()
        if not got:
            return model
        g = np.frombuffer(got[0].g, "f4") / got[0].n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        k = e.size
        e -= step[:k].reshape(e.shape).astype("f4")
        w -= step[k : k + w.size].reshape(w.shape).astype("f4")
        b -= step[k + w.size :].astype("f4")
    return Model(model.subjects, e, w, b)


def targets(labels: DataFrame, id_col: str, subject: str, annotator: str, subjects: tuple[str, ...]) -> DataFrame:
    """``(id, y)``: for each labelled document the share of its annotators that named each subject."""
    l = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(annotator), F.lit("")).alias("who"), F.lower(F.trim(F.col(subject))).alias("s")).distinct()
    l = l.where(F.col("s").isNull() | F.col("s").isin(*subjects))
    return l.groupBy("id").agg(F.count_distinct("who").cast("double").alias("n"), *[F.count_distinct(F.when(F.col("s") == s, F.col("who"))).alias(f"c{k}") for k, s in enumerate(subjects)]).select(
        "id", F.array(*[(F.col(f"c{k}") / F.col("n")).cast("float") for k in range(len(subjects))]).alias("y"))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon(features)
    for b in batches:
        y = np.stack(b.y.to_numpy()) if len(b) else None
        for s in scan(b.text.tolist(), digits=False):
            row, lo, hi = sentence_words(s, LEAST_WORDS)
            yield examples(lexicon.numbers(s), lexicon, lo, hi, row, s.count, y[s.first : s.first + s.count])


def _outputs(s: Scan, lexicon: Lexicon, model: Model, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What each subject's output gives for each sentence."""
    if not len(lo):
        return np.empty((0, len(model.subjects)), "f4")
    numbers = lexicon.numbers(s)
    table = np.stack(lexicon.kept)[numbers]
    sums = np.add.reduceat(np.concatenate([table, np.zeros((1, table.shape[1]), "f4")]), np.stack([lo, hi], axis=1).ravel())[::2]
    return sums / (hi - lo)[:, None] + model.b


def _sentence_bags(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = model.outputs()
        lexicon, scorer = Lexicon(features), Lexicon(lambda w: out[features(w)].mean(axis=0))
        for b in batches:
            y = np.stack(b.y.to_numpy()) if len(b) else None
            for s in scan(b.text.tolist(), digits=False):
                row, lo, hi = sentence_words(s, LEAST_WORDS)
                said = _outputs(s, scorer, model, lo, hi) > 0
                yield examples(lexicon.numbers(s), lexicon, lo, hi, np.arange(len(lo)), len(lo), said & (y[s.first + row] >= 0.5))

    return run


def train(docs: DataFrame, id_col: str, text: str, labels: DataFrame, label_id: str, subject: str, annotator: str, subjects: tuple[str, ...], rounds: tuple[int, int] = ROUNDS) -> Model:
    y = targets(labels, label_id, subject, annotator, subjects).orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    tasks = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, MAX_LABELLED // TASK))
    labelled = cut(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(y, "id").select("id", "text", "y").repartition(tasks, "id"))
    rng = np.random.default_rng(11)
    k = len(subjects)
    start = Model(subjects, rng.normal(0, 0.1, (TABLE, DIM)).astype("f4"), rng.normal(0, 0.3, (DIM, k)).astype("f4"), np.full(k, -2.0, "f4"))
    first = _descend(cut(labelled.mapInPandas(_bags, ROW)), start, rounds[0])
    return _descend(cut(labelled.mapInPandas(_sentence_bags(first), ROW)), first, rounds[1])


def _score(model: Model, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = model.outputs()
        lexicon = Lexicon(lambda w: out[features(w)].mean(axis=0))
        for b in batches:
            ids = b.id.to_numpy()
            for s in scan(b.text.tolist(), digits=False):
                row, lo, hi = sentence_words(s, LEAST_WORDS)
                said = _outputs(s, lexicon, model, lo, hi) > 0
                n = np.bincount(row, minlength=s.count)
                hits = np.stack([np.bincount(row, said[:, k], s.count) for k in range(len(model.subjects))], axis=1) if len(model.subjects) else np.zeros((s.count, 0))
                i, k = np.nonzero((hits > 0) & (hits >= share * n[:, None]))
                yield pd.DataFrame({"id": ids[s.first + i], "subject": np.array(model.subjects, object)[k], "share": hits[i, k] / n[i], "sentences": n[i]})

    return run


def subjects_of(docs: DataFrame, id_col: str, text: str, model: Model, share: float = SHARE) -> DataFrame:
    """``(id, subject, share, sentences)`` of each document and each subject that enough of its sentences are about."""
    d = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(_score(model, share), "id long, subject string, share double, sentences int").withColumnRenamed("id", id_col)


def subject_names(areas: DataFrame, column: str = "subject") -> tuple[str, ...]:
    """The subject areas in use; a stated list, so read to the driver."""
    return tuple(sorted({r[0] for r in areas.where(F.col(column).isNotNull()).select(column).distinct().toLocalIterator()}))


def composition(found: DataFrame) -> DataFrame:
    """``(subject, documents)``: the corpus's composition."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
