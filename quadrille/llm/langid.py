"""Operator 10: language identification, words first, then shorter and shorter character n-grams.

Known words score by their per-language log frequency.  A word never seen in
training scores by its longest known order of character n-grams (4 down to 1).
Every distinct word is scored once; a text is a sum of rows of one score table.

The classifier is fitted on a bounded sample of labelled rows: those whose
crc32(id as text) mod 5 is not 0, about ``PER_LANGUAGE`` rows a language and, by
equal shares, ``TRAIN_DOCS`` in all but at least one a language, smallest hash first,
the first ``TRAIN_CHARS`` characters of each.  Every language with a labelled row can be
predicted; every row is predicted from its whole text.

Defined results: null texts and texts without a letter (Unicode categories L) are
``und`` with score 0; so is everything if no labelled row exists; ties go to the
smaller language name; repeated rows are predicted each; a null id is not held
out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE, TRAIN_DOCS, TRAIN_CHARS = 600, 6000, 20_000
#: Languages (a row of three columns each) that are broadcast; more are joined.
BROADCAST = 50_000
ORDERS = (4, 3, 2, 1)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores are kept between pieces of text.
_CACHE = 200_000


def _words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    words = _LETTERS.findall(text.lower())
    # the pattern also takes number signs such as fractions and Roman numerals
    if not "".join(words).isalpha():
        words = [part for word in words for part in (word if word.isalpha() else "".join(c if c.isalpha() else " " for c in word)).split()]
    return words


def _grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class _Places(dict):
    """Row of each word in the score table; words asked for first are listed in ``new``."""

    def __init__(self, place: dict[str, int]):
        super().__init__(place)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Model:
    """Log frequencies by language for words and for each n-gram order."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in texts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        for lang, text in texts:
            for word, n in Counter(_words(text)).items():
                words[word][at[lang]] += n
        grams = {n: defaultdict(lambda: np.zeros(len(self.langs))) for n in ORDERS}
        for word, counts in words.items():
            for n in ORDERS:
                for g in _grams(word, n):
                    grams[n][g] += counts
        # a word seen once says no more than its n-grams
        self.place, self.words = self._logs({w: c for w, c in words.items() if c.sum() > 1})
        # n-grams of each order have their own length, so one table holds all
        tables = [self._logs(grams[n]) for n in ORDERS]
        self.gram: dict[str, int] = {}
        for place, _ in tables:
            self.gram.update(zip(place, range(len(self.gram), len(self.gram) + len(place))))
        self.grams = np.concatenate([rows for _, rows in tables])
        self._open: tuple[_Places, np.ndarray] | None = None

    def _logs(self, counts: dict) -> tuple[dict, np.ndarray]:
        m = np.array(list(counts.values())).reshape(len(counts), len(self.langs))
        logs = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * max(1, len(m))))
        return dict(zip(counts, range(len(counts)))), logs.astype(np.float32)

    def __getstate__(self):
        return {**self.__dict__, "_open": None}

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: the mean of the known n-grams of the longest order that has any."""
        get, found, count = self.gram.get, [], []
        for word in words:
            marked = f"^{word}$"
            for n in ORDERS:
                w = marked if n > 1 else word
                known = [at for at in [get(w[i : i + n]) for i in range(len(w) - n + 1)] if at is not None]
                if known:
                    break
            found += known
            count.append(len(known))
        count = np.array(count)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        some = count > 0
        if some.any():
            out[some] = np.add.reduceat(self.grams[found].astype(np.float64), (np.cumsum(count) - count)[some]) / count[some][:, None]
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its language (-1: und) and the score."""
        lang, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        places, table = self._open or (_Places(self.place), self.words)
        size, found = [], []
        for text in texts:
            words = _words(text) if text else []
            found.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            size.append(len(words))
        if places.new:
            table = np.concatenate((table, self.backoff(places.new)))
            places.new = []
        # a full table starts again from the trained words
        self._open = (places, table) if len(table) < len(self.words) + _CACHE else None
        size = np.array(size)
        some = np.flatnonzero(size)
        if len(some):
            # pieces of a long text are summed apart, so that memory stays bounded
            total = np.array([sum(table[x[a : a + 65536]].sum(axis=0, dtype=np.float64) for a in range(0, len(x), 65536)) for x in (found[i] for i in some)])
            best = total.argmax(axis=1)
            lang[some] = best
            score[some] = 1 / np.exp(total - total[np.arange(len(some)), best][:, None]).sum(axis=1)
        return lang, score

    def names(self, lang: np.ndarray) -> list[str]:
        known = [*self.langs, "und"]
        return [known[i] for i in lang.tolist()]

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.predict_all([text])
        return self.names(lang)[0], float(score[0])


def _held(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, docs: int = TRAIN_DOCS) -> Model:
    src = common.only(df, id=id_col, text=F.col(f"`{text_col}`").cast("string"), lang=F.col(f"`{lang_col}`").cast("string"))
    some = src.filter(~_held("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.shiftrightunsigned(F.xxhash64("id", F.substring("text", 1, 200)), 1)
    some = some.select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"), h.alias("h"))
    # counts combine before the shuffle; the smallest hash of each language is always taken, and a hash threshold
    # leaves about as many rows as are wanted, so no language is ever ranked whole
    sizes = common.cut(some.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    known = sizes.count()
    share = min(per_language, max(1, docs // max(1, known)))
    # texts are not dealt out by language: one may have most rows
    taken = some.join(F.broadcast(sizes) if known <= BROADCAST else sizes, "lang").filter((F.col("h") / F.lit(2.0**63) * F.col("n") <= share) | (F.col("h") == F.col("least")))
    rows = taken.select("lang", "text", "h").distinct().collect()
    return Model([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"]))])


def _predicted(batches, model: Model):
    for b in common.slices(batches, 2):
        lang, score = model.predict_all(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.names(lang), pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row."""
    model = train(df, id_col, text_col, lang_col) if model is None else model
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), _held(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(partial(_predicted, model=model), "id long, held_out boolean, lang_pred string, score double")


def _kept(batches, model: Model, at: int, to: int):
    for b in common.slices(batches, at):
        texts = b.column(at).to_pylist()
        if model.langs:
            lang, _ = model.predict_all(texts)
            b = b.set_column(to, b.schema.field(to), pa.array(model.names(lang), b.schema.field(to).type))
            yield b.filter(pa.array(lang >= 0))
        else:
            yield b.filter(pa.array([bool(t and _words(t)) for t in texts]))


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows with a letter, ``lang`` set to the language found; without a labelled row to learn from it stays as it is."""
    model = train(df, id_col, text_col, lang_col) if model is None else model
    return df.mapInArrow(partial(_kept, model=model, at=df.columns.index(text_col), to=df.columns.index(lang_col)), df.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
