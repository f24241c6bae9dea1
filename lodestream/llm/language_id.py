"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import doc_column, materialise, small_batches, tidily
from .tokens import batched_texts

#: Labelled rows that the model is fitted on at most, per language: distinct texts, those with the smallest hashes.
FIT_ROWS = 600
#: Hash table of character n-grams; the model's size is SLOTS x languages, whatever the corpus.
SLOTS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Natural-log cost of a change of language between two words, and the most that one word may say.
SWITCH, MOST = 12.0, 6.0
REMEMBERED = 100_000
#: Characters labelled at once.
MOST_CHARS = 500_000
#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of each run of letters; numerals such as a half or a raised two are none."""
    return [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text) if m[0].isalpha() or any(map(str.isalpha, m[0]))]


def plain_words(text: str) -> list[str]:
    found = WORD.findall(text)
    return [w.lower() for w in found if w.isalpha() or any(map(str.isalpha, w))]


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((s for s, ranges in SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), "other")


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, valid, first): per size and byte position of the words in <>, the slot of the n-gram that begins there."""
    coded = [b"<" + w.encode() + b">" for w in words]
    size = np.array([len(c) for c in coded])
    text = np.concatenate([np.frombuffer(b"".join(coded), np.uint8), np.zeros(max(GRAMS), np.uint8)]).astype(np.uint32)
    n = int(size.sum())
    left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes to the word's end
    slots, valid = [], []
    for g in GRAMS:
        h = np.full(n, g, np.uint32)
        for j in range(g):
            h = (h ^ text[j:j + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        slots.append((h ^ (h >> np.uint32(12))) & np.uint32(SLOTS - 1))
        valid.append(left >= g)
    return np.stack(slots), np.stack(valid), np.cumsum(size) - size


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages, self.weights, self.scripts = languages, weights, scripts
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)

    def learn_words(self, words: set[str]) -> None:
        """Gives each new word its row of ``scores``."""
        new = sorted(words.difference(self.known))
        if not new:
            return
        slots, valid, first = gram_slots(new)
        per_place = (self.weights[slots] * valid[:, :, None]).sum(0)
        s = np.add.reduceat(per_place, first, axis=0) / len(GRAMS)
        s = np.clip(s - s.max(1, keepdims=True), -MOST, 0)
        if self.scripts:
            for i, w in enumerate(new):
                if (allowed := self.scripts.get(script_of(w))) is not None:
                    s[i] = np.where(allowed, s[i], -MOST)
        at = len(self.known)
        self.scores = np.concatenate([self.scores[:at], s.astype(np.float32)])
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def forget(self, most: int = REMEMBERED) -> None:
        if len(self.known) > most:
            self.known, self.scores = {}, self.scores[:0]

    def path(self, words: list[str]) -> np.ndarray:
        """The language of each word along the best path.

        The best single language is the best path if no stretch of words would gain more
        than one change costs by another language: then no change can pay.
        """
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        s = self.scores[ids].astype(np.float64)
        best = int(s.sum(0).argmax())
        gain = np.cumsum(s - s[:, best:best + 1], 0)
        low = np.minimum.accumulate(np.minimum(np.concatenate([np.zeros((1, s.shape[1])), gain[:-1]]), 0), 0)
        if (gain - low).max(initial=0) <= SWITCH:
            return np.full(len(words), best)
        n, k = s.shape
        back = np.empty((n, k), np.int16)
        value = s[0].tolist()
        rows = s.tolist()
        for t in range(1, n):
            top = max(range(k), key=value.__getitem__)
            floor = value[top] - SWITCH
            row, b = rows[t], back[t]
            for j in range(k):
                stay = value[j]
                b[j] = j if stay >= floor else top
                row[j] += stay if stay >= floor else floor
            value = row
        out = np.empty(n, np.int64)
        j = max(range(k), key=value.__getitem__)
        for t in range(n - 1, -1, -1):
            out[t] = j
            j = back[t][j]
        return out

    def label(self, texts: list[str | None], spans: bool) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text: the language with most letters, their share of its letters, and runs of one language."""
        self.forget()
        words = [plain_words(t) if t else [] for t in texts]
        self.learn_words(set().union(*words))
        out = []
        for text, found in zip(texts, words, strict=True):
            if not found:
                out.append(("und", 0.0, []))
                continue
            path = self.path(found)
            letters = np.bincount(path, weights=np.fromiter(map(len, found), np.int64, len(found)), minlength=len(self.languages))
            best = int(letters.argmax())
            runs = []
            if spans:
                ends = [w[:2] for w in words_of(text)]
                cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                runs = [(ends[a][0], ends[b - 1][1], self.languages[path[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out.append((self.languages[best], float(letters[best] / letters.sum()), runs))
        return out


def held_out(docs: DataFrame):
    """Rows never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_column(docs, "doc_id", "string")) % 4 == 2, F.lit(True))


def fit(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Naive Bayes over hashed character n-grams, from at most ``fit_rows`` distinct labelled texts of each language."""
    small_batches(spark)
    rows = docs.where(~held_out(docs)).select(doc_column(docs, "lang", "string").alias("lang"), doc_column(docs, "text", "string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Copies count once: the sample is of distinct texts, whatever the number of rows.
    distinct = materialise(rows.select("lang", "h").distinct(), "labelled-texts")
    counts = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        return None
    # About half as many again as are needed, by hash; where too few come out, a larger share. The limit then holds exactly.
    part = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    shares = {lang: min(1.0, 1.5 * fit_rows / n) for lang, n in counts.items()}
    while True:
        share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        some = distinct.where(part < F.element_at(share, F.col("lang")))
        got = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [lang for lang, n in counts.items() if got.get(lang, 0) < min(fit_rows, n)]
        if not short:
            break
        shares |= {lang: min(1.0, 4 * shares[lang]) for lang in short}
    # Some 900 rows a language are left here, ordered in one pass for all languages.
    nth = F.row_number().over(W.partitionBy("lang").orderBy(part, "h"))
    chosen = materialise(some.withColumn("nth", nth).where(F.col("nth") <= fit_rows).select("lang", "h"), "fit-texts")
    taken = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))

    def grams(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = Counter(plain_words(text))
                if not words:
                    continue
                scripts: Counter[str] = Counter()
                for w, n in words.items():
                    scripts[script_of(w)] += n
                slots, valid, first = gram_slots(list(words))
                times = np.repeat(np.array(list(words.values())), np.diff([*first, slots.shape[1]]))
                sums = np.bincount(slots[valid], weights=np.broadcast_to(times, slots.shape)[valid], minlength=SLOTS)
                where = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (len(where) + len(scripts))),
                    pa.array([*where.astype(str).tolist(), *scripts]),
                    pa.array([*sums[where].astype(np.int64).tolist(), *scripts.values()], pa.int64())], ["lang", "feature", "n"])

    table = taken.repartition(max(8, len(counts)), F.xxhash64("text")).mapInArrow(grams, "lang string, feature string, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts)
    at = {lang: i for i, lang in enumerate(languages)}
    weights, scripts = np.zeros((SLOTS, len(languages)), np.float64), {}
    for lang, feature, n in table.itertuples(index=False):
        if feature.isdigit():
            weights[int(feature), at[lang]] = n
        else:
            scripts.setdefault(feature, np.zeros(len(languages)))[at[lang]] = n
    weights = np.log((weights + 0.5) / (weights + 0.5).sum(0))
    # A script is a language's if a hundredth of its words are written in it.
    total = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
    allowed = {s: v / total >= 0.01 for s, v in scripts.items()}
    return Model(languages, weights.astype(np.float32), {s: v for s, v in allowed.items() if v.any() and not v.all()})


def identify(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS, spans: bool = True) -> DataFrame:
    """The language of every whole text, one row per row of ``docs``.

    ``und`` with score 0 stands for a null text, one without a letter, and every text
    where no row is labelled; ties go to the language first in order. Repeated rows are
    judged each; an empty table gives an empty result; extra columns are ignored.
    Returns doc_id, held_out, lang_pred, score, and spans (start, end, lang) if asked for.
    """
    model = fit(spark, docs, fit_rows)
    held = spark.sparkContext.broadcast(model)
    kinds = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def labelled(batches):
        m = held.value
        for batch, texts in batched_texts(batches, MOST_CHARS):
            if m is None:
                found = [("und", 0.0, [])] * len(texts)
            else:
                found = m.label(texts, spans)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in f[2]] for f in found], span))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "spans"][:len(columns)])
        if m is not None:
            m.forget(0)

    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), held_out(docs).alias("held_out"), doc_column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(tidily(labelled), kinds)


def keep_known(spark: SparkSession, docs: DataFrame, least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with the columns they came with.

    Without any labelled row nothing is known of languages, and texts with a letter stay.
    """
    if "text" not in docs.columns:
        return docs.where(F.lit(False))
    held = spark.sparkContext.broadcast(fit(spark, docs, fit_rows))

    def known(batches):
        m = held.value
        for batch, texts in batched_texts(batches, MOST_CHARS):
            if m is None:
                keep = [bool(t and plain_words(t)) for t in texts]
            else:
                keep = [lang != "und" and score >= least for lang, score, _ in m.label(texts, False)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        if m is not None:
            m.forget(0)

    return docs.mapInArrow(tidily(known), docs.schema)
