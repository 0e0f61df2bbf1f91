"""Language ID by word-first backoff: words by their log frequency in a language, unseen ones by character n-grams."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Letters of any script; other numbers (a half, a circled two, a Roman numeral sign) are none.
WORD = regex.compile(r"\p{L}+")
#: Longest word prefix and suffix marks included, from the longest n-gram down.
NGRAMS = (5, 4, 3, 2, 1)
#: Words whose scores a worker keeps.
CACHED_WORDS = 200_000
UNKNOWN = "und"


@dataclass
class Model:
    """Per language: log frequencies of known words, and of n-grams by length, as rows of arrays over languages."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        """Scores of a word: its own row if known, else the mean over its n-grams of the longest length of which
        any is known; a word of which no letter is known says nothing."""
        row = self.words.get(word)
        if row is not None:
            score = self.table[row]
        else:
            marked, score = f"^{word}$", np.zeros(len(self.langs))
            for n in NGRAMS:
                rows = [r for i in range(len(marked) - n + 1) if (r := self.grams.get(marked[i : i + n])) is not None]
                if rows:
                    score = self.table[rows].mean(axis=0)
                    break
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[word] = score
        return score

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the likelihood; ``und`` and 0 if no letter is there or nothing was learned."""
        if not text or not self.langs or not WORD.search(text):
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        get = self.known.get
        rows = [get(w) for w in counts]
        rows = [self.word(w) if r is None else r for w, r in zip(counts, rows, strict=True)]
        total = self.prior.copy()
        if rows:
            total = total + np.fromiter(counts.values(), float, len(counts)) @ np.array(rows)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def log_table(counts: dict[str, Counter], langs: list[str], smooth: float) -> tuple[list[str], np.ndarray]:
    """Items and their smoothed log frequencies, each less its mean over languages (which changes no comparison)."""
    items = sorted({x for lang in langs for x in counts[lang]})
    out = np.empty((len(items), len(langs)))
    for j, lang in enumerate(langs):
        total = sum(counts[lang].values()) + smooth * (len(items) + 1)
        out[:, j] = [math.log((counts[lang].get(x, 0) + smooth) / total) for x in items]
    return items, out - out.mean(axis=1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower case. A text without a letter has none."""
    return WORD.findall((text or "").lower())


def counted_words(sample: DataFrame) -> DataFrame:
    """(lang, word, n) for each language of a sample (lang, text): one pass, counts are added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[lang].update(words_of(text))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    per_task = sample.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, word string, n long")
    return per_task.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, docs_per_lang: int = 1500, smooth: float = 0.5) -> Model:
    """Learn from ``text`` and non-null ``lang`` of a bounded sample.

    About ``docs_per_lang`` documents of each language are taken, by a hash of the text; all their words are counted on
    the executors, and the counts come to the driver: what the sample holds is the only bound of the model. n-grams are
    counted from the words, weighted by their counts.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_lang / sizes[lang])).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(2**53)
    words: dict[str, Counter] = defaultdict(Counter)
    for r in counted_words(rows.filter(draw < share)).collect():
        words[r["lang"]][r["word"]] = r["n"]
    grams: dict[str, Counter] = defaultdict(Counter)
    for lang in langs:
        for w, n in words[lang].items():
            marked = f"^{w}$"
            for k in NGRAMS:
                for i in range(len(marked) - k + 1):
                    grams[lang][marked[i : i + k]] += n
    # A word seen once is worth less than its n-grams: it is left to them.
    words = {lang: Counter({w: n for w, n in words[lang].items() if n > 1}) for lang in langs}
    items, table = log_table(words, langs, smooth)
    parts, more = [table], {}
    for k in NGRAMS:
        own = {lang: Counter({g: n for g, n in grams[lang].items() if len(g) == k}) for lang in langs}
        names, rows_k = log_table(own, langs, smooth)
        base = sum(len(p) for p in parts)
        more |= {g: base + i for i, g in enumerate(names)}
        parts.append(rows_k)
    total = sum(sizes.values())
    prior = np.log([sizes[lang] / total for lang in langs])
    return Model(langs, prior, {w: i for i, w in enumerate(items)}, more, np.concatenate(parts))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; a text that is null or has no letter gets ``und`` and 0.

    Only the text is read, so rows that are alike get the same prediction. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text"), batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out.

    held_out: the crc32 of the doc_id as text leaves 2 when divided by 4; a null doc_id is held out too. With nothing to
    learn from, all is ``und``. Other columns may have any names.
    """
    out = F.coalesce(held_out(), F.lit(True))
    model = fit(docs.filter(~out).select("text", "lang"), **limits)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
