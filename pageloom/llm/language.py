"""Languages of a text as a mixture: proportions by expectation-maximisation over the words' n-gram likelihoods.

Every language is a distribution over hashed byte trigrams of lower-cased text, counted over all labelled training
rows. A word's likelihood under a language is the product over the trigrams that end in it or right behind it. For each text,
expectation-maximisation finds the proportions of the languages among its words. Sets of the largest 1, 2, ...
languages are compared by penalised likelihood: a language more has to gain more than the penalty, and a text's set
grows until the first that does not. Apart from that, a text is in no learned language if trigrams drawn evenly from all
buckets explain it better than every language does, by more than chance allows for its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
MOST_LANGUAGES = 1000
# Spread of a trigram's log-likelihood, and how many standard errors below even odds a text must be to count as noise.
SPREAD, ERRORS = 3.0, 3.0


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each byte, from the third on."""
    wide = raw.astype(np.uint32)
    packed = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    return (packed * np.uint32(2654435761)) >> np.uint32(16)


def bytes_of(texts: list[str]) -> np.ndarray:
    """Lower-cased texts as bytes: two spaces before every text, white space as spaces."""
    joined = "\0".join(t.lower() for t in texts).encode()
    raw = np.frombuffer(b"  " + joined.translate(SPACES).replace(b"\0", b"\0  "), dtype=np.uint8)
    return raw


SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def trigram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a language; one row per task, language and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text.replace("\0", " "))
            for lang, texts in by_lang.items():
                found = np.bincount(trigram_buckets(bytes_of(texts)), minlength=BUCKETS)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Log-probabilities of trigrams by language, and the proportions of the languages in texts."""

    def __init__(self, languages: list[str], counts: np.ndarray, rounds: int = 8, penalty: float = 4.0):
        self.languages, self.rounds, self.penalty = languages, rounds, penalty
        smooth = counts + 0.5
        self.log_p = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def word_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of every word under every language, its trigrams, and each text's first word; all texts have words.

        Words with digits count no trigrams: numbers, addresses and keys tell nothing against a language.
        """
        raw = bytes_of([t.replace("\0", " ") + " " for t in texts])
        inside = (raw != 32) & (raw != 0)
        start = np.flatnonzero(inside[2:] & ~inside[1:-1])
        each = self.log_p[trigram_buckets(raw)]
        counted = inside[2:] | inside[1:-1]
        each[~counted] = 0  # beyond the break behind a word; else a text's last word would reach into the next text
        per_word = np.add.reduceat(each, start, axis=0)
        digits = np.add.reduceat(((raw[2:] >= 48) & (raw[2:] <= 57)).astype(np.int64), start)
        trigrams = np.where(digits > 0, 0, np.add.reduceat(counted.astype(np.int64), start))
        first = np.searchsorted(start + 2, np.concatenate([[0], np.flatnonzero(raw == 0)]))
        return per_word, trigrams, first

    def propose(self, texts: list[str]) -> list[tuple[list[str], list[float]]]:
        """Languages and proportions of each text, largest proportion first, ties by language; texts with letters."""
        return [(langs, shares) for langs, shares, _ in self.judge(texts)]

    def judge(self, texts: list[str]) -> list[tuple[list[str], list[float], bool]]:
        """As `propose`, and whether the text is in the learned languages at all: its words without digits, each under the language that
        explains it best, are no less likely than under even odds for all buckets, but for `ERRORS` standard errors."""
        if not texts or not self.languages:
            return [([], [], False)] * len(texts)
        like, trigrams, first = self.word_likelihoods(texts)
        n_words = np.diff(np.append(first, len(like)))
        highest = like.max(axis=1, keepdims=True)
        n_trigrams = np.add.reduceat(trigrams, first)
        gain = np.add.reduceat(np.where(trigrams > 0, highest[:, 0], 0.0), first) + n_trigrams * np.log(BUCKETS)
        natural = gain >= -ERRORS * SPREAD * np.sqrt(n_trigrams)
        weight = np.exp(like - highest)  # a word's likelihood by language, the best one 1
        share = np.full((len(texts), len(self.languages)), 1 / len(self.languages), dtype=np.float32)
        for _ in range(self.rounds):
            part = weight * np.repeat(share, n_words, axis=0)
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, first, axis=0) / n_words[:, None]
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.full(len(texts), -np.inf)
        chosen = np.ones(len(texts), dtype=int)
        growing = np.ones(len(texts), dtype=bool)  # a text stops at the first language that gains too little
        for k in range(1, len(self.languages) + 1):
            some = np.zeros_like(share)
            np.put_along_axis(some, order[:, :k], np.take_along_axis(share, order[:, :k], axis=1), axis=1)
            some /= some.sum(axis=1, keepdims=True)
            total = np.log(np.maximum((weight * np.repeat(some, n_words, axis=0)).sum(axis=1), 1e-30))
            value = np.add.reduceat(total, first) - self.penalty * (k - 1) * np.log(n_words + 1)
            growing &= value > best + 1e-6
            best, chosen = np.where(growing, value, best), np.where(growing, k, chosen)
            if not growing.any():
                break
        out = []
        for row, k, ranked, real in zip(share, chosen, order, natural, strict=True):
            top = ranked[:k]
            proportions = row[top].astype(float) / float(row[top].sum())
            out.append(([self.languages[i] for i in top], [min(1.0, float(p)) for p in proportions], bool(real)))
        return out


def learn(docs: DataFrame, trained: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """The model from all rows with text and language for which `trained` holds.

    The driver gets the sums by language and bucket: at most 65,536 numbers a language, and 1,000 languages.
    """
    counts = trigram_counts(docs if trained is None else docs.where(trained), text_col, lang_col).cache()
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS))
    found = counts.toArrow()
    at = {lang: i for i, lang in enumerate(languages)}
    rows = np.array([at[x] for x in found.column("lang").to_pylist()], dtype=int)
    table[rows, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    counts.unpersist()
    return Mixture(languages, table)


def predictions(model: Mixture, texts: list[str | None]) -> Iterator[tuple[list[str], list[float], bool]]:
    """Languages, proportions and whether the text is in any of them; nothing and false for texts without letters."""
    have = [letters(t) for t in texts]
    found = iter(model.judge([t for t, h in zip(texts, have, strict=True) if h]))
    return (next(found) if h else ([], [], False) for h in have)


def identify(docs: DataFrame, model: Mixture, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with langs and proportions (arrays), lang_pred, score and is_language.

    `lang_pred` is the language of the largest proportion, `score` that proportion among the languages selected;
    `is_language` is false for noise, which gets the nearest language all the same. A text that is null or has no letter,
    or a model without languages, gives `und`, 0, false and empty arrays. A kept column of a result's name gives way to
    the result. Rows are independent; an empty table gives an empty one.
    """
    keep = [c for c in keep if c not in NAMES]
    text = "_text"
    while text in keep:
        text += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text):
            found = list(predictions(model, batch.column(text).to_pylist()))
            langs, shares, real = [list(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in keep], pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                pa.array([x[0] if x else UNKNOWN for x in langs], pa.string()), pa.array([x[0] if x else 0.0 for x in shares], pa.float64()),
                pa.array(real, pa.bool_())], [*keep, *NAMES])

    source = docs.select(*quoted(keep), F.col(text_col).cast("string").alias(text))
    kinds = "".join(f"{name} {f.dataType.simpleString()}, " for name, f in zip(quoted(keep), source.schema, strict=False))
    return source.mapInArrow(run, f"{kinds}langs array<string>, proportions array<double>, lang_pred string, score double, is_language boolean")


NAMES = ["langs", "proportions", "lang_pred", "score", "is_language"]


def with_a_language(docs: DataFrame, model: Mixture, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are in the learned languages and of which one has at least this proportion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text_col):
            found = predictions(model, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([real and p[0] >= least for _, p, real in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
