"""Language identification by bit-sliced Bloom filters of byte n-grams.

One table of ``slots`` rows holds a Bloom filter per language side by side: row r keeps bit l if
language l set it.  An n-gram reads ``probes`` rows and ANDs them, which names every language
that may contain it at once.  Per text the popcounts of each language's bit are corrected for
the share of foreign n-grams its filter lets through, and the largest decides.

A language's filter holds the n-grams whose rate in its training text is at least ``keep`` times
their highest rate in any language, so words that strayed from another language do not enter.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts too short
for an n-gram, or without a known one, get the language of most training texts with score 0;
ties go to the smallest name; training rows without language, id or text are passed over;
without training rows every text is ``und``; repeated rows are scored each; extra columns stay.
"""

from __future__ import annotations

import dataclasses
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from gradeloom.llm.frames import LOWER, U, WORD_BYTES, Texts, map_pieces, mix

GRAM = 4
#: Training bound: texts per language, the first by hash of the id; up to 1000 Spark applies the rank limit before the shuffle.
TRAIN_TEXTS = 1000
#: n-grams kept per language, most frequent first; bounds the filters and the model sent to the workers.
TRAIN_GRAMS = 40_000
UNKNOWN = "und"


@dataclasses.dataclass
class Filters:
    """Row masks as 64-bit words (one word per 64 languages), and what is needed to read them."""

    languages: list[str]
    default: str
    slots_log2: int
    probes: int
    rows: np.ndarray
    false_rate: np.ndarray
    true_rate: np.ndarray

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """Masks of the languages containing each n-gram: (n-grams, words of 64 languages)."""
        out = None
        h = mix(grams + U(1))
        for _ in range(self.probes):
            got = self.rows[(h >> U(64 - self.slots_log2)).astype(np.int64)]
            out = got if out is None else out & got
            h = mix(h + U(0x9E3779B97F4A7C15))
        return out


def grams_of(texts: Texts, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every byte n-gram inside lower-cased words with a space on either side.

    Digits and signs count as spaces; n-grams with two spaces in a row are left out.
    """
    letters = WORD_BYTES.copy()
    letters[0x30:0x3A] = False
    data = np.where(letters[texts.data], LOWER[texts.data], 32).astype(np.uint8)
    upper = np.zeros(len(data), bool)  # capitals of the Latin-1 block: U+00C0 to U+00DE
    if len(data) > 1:
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[upper] += 32
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    gram = np.zeros(n, U)
    blank = data == 32
    gap = np.zeros(n, bool)
    for j in range(size):
        gram = (gram << U(8)) | data[j:n + j]
        if j:
            gap |= blank[j - 1:n + j - 1] & blank[j:n + j]
    crosses = np.zeros(n, bool)
    for cut in texts.offsets[1:-1]:
        crosses[max(0, cut - size + 1):cut] = True
    at = np.flatnonzero(~gap & ~crosses)
    text = np.searchsorted(texts.offsets[1:], at, "right")
    return text, gram[at]


def gram_counts(train: DataFrame, size: int = GRAM) -> DataFrame:
    """(lang, gram, n): texts of the language that hold the n-gram; ``n-gram -1`` counts its texts."""
    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = Texts(piece.column("text")), piece.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        text, gram = grams_of(texts, size)
        seen = np.unique(np.stack([text.astype(np.int64), gram.astype(np.int64)]), axis=1)
        pairs, n = np.unique(np.stack([code[seen[0]], seen[1]]), axis=1, return_counts=True)
        per, many = np.unique(code, return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in [*pairs[0], *per]], pa.string()), pa.array(np.concatenate([pairs[1], np.full(len(per), -1)]), pa.int64()),
            pa.array(np.concatenate([n, many]), pa.int64())], ["lang", "gram", "n"])
    return map_pieces(train.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = GRAM, train_texts: int = TRAIN_TEXTS,
        train_grams: int = TRAIN_GRAMS, keep: float = 0.5, probes: int = 3) -> Filters:
    """Filters of the languages in ``docs``, from at most ``train_texts`` texts of each, chosen by hash of the id.

    The rank filter is pushed below the shuffle, so a language that holds most rows ships few of them.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("draw"),
                       F.col(doc_id).cast("string").alias("id")).where("text is not null and lang is not null and id is not null")
    ids = rows.select("lang", "draw", "id").withColumn(
        "at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("at") <= train_texts)
    last = {r.lang: r.draw for r in ids.groupBy("lang").agg(F.max("draw").alias("draw")).collect()}
    if not last:
        return Filters([], UNKNOWN, 10, probes, np.zeros((1 << 10, 1), U), np.zeros(0), np.zeros(0))
    bound = F.coalesce(*[F.when(F.col("lang") == name, F.lit(draw)) for name, draw in last.items()])
    counts = gram_counts(rows.where(F.col("draw") <= bound), size)
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(
        (F.col("gram") >= 0).cast("int"), F.col("n").desc(), "gram"))).where(F.col("at") <= train_grams)
    rate: dict[str, dict[int, float]] = defaultdict(dict)
    for r in top.select("lang", "gram", "n").collect():  # bounded by languages x train_grams
        rate[r.lang][r.gram] = r.n
    names = sorted(rate)
    texts = {x: rate[x].pop(-1) for x in names}
    best: dict[int, float] = defaultdict(float)
    for x in names:
        for g, n in rate[x].items():
            best[g] = max(best[g], n / texts[x])
    chosen = [np.array([g for g, n in rate[x].items() if n / texts[x] >= keep * best[g]], np.int64).astype(U) for x in names]
    log2 = max(14, int(8 * max(map(len, chosen))).bit_length())
    model = Filters(names, max(names, key=lambda x: (texts[x], [-ord(c) for c in x])), log2, probes,
                    np.zeros((1 << log2, -(-len(names) // 64)), U), np.zeros(len(names)), np.zeros(len(names)))
    for i, grams in enumerate(chosen):
        h = mix(grams + U(1))
        for _ in range(probes):
            np.bitwise_or.at(model.rows[:, i // 64], (h >> U(64 - log2)).astype(np.int64), U(1) << U(i % 64))
            h = mix(h + U(0x9E3779B97F4A7C15))
    for i in range(len(names)):
        fill = ((model.rows[:, i // 64] >> U(i % 64)) & U(1)).mean()
        model.false_rate[i] = fill ** probes
    return model


def popcounts(model: Filters, texts: Texts, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams per text, texts x languages counts corrected for false positives)."""
    text, gram = grams_of(texts, size)
    total = np.bincount(text, minlength=texts.size).astype(float)
    counts = np.zeros((texts.size, len(model.languages)))
    masks = model.probe(gram)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for low in range(0, len(model.languages), 8):  # eight languages to a byte of the mask
        part = ((masks[:, low // 64] >> U(low % 64)) & U(255)).astype(np.int64)
        by_byte = np.bincount(text * 256 + part, minlength=texts.size * 256).reshape(texts.size, 256)
        width = min(8, len(model.languages) - low)
        counts[:, low:low + width] = by_byte @ bits[:, :width]
    right = (counts - total[:, None] * model.false_rate) / (1 - model.false_rate)
    return total, np.maximum(right, 0)


def identify(docs: DataFrame, model: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the winner's corrected count over the sum of the two largest."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = handle.value, Texts(piece.column(text))
        names, score = np.full(texts.size, UNKNOWN, object), np.zeros(texts.size)
        if m.languages:
            _, right = popcounts(m, texts)
            best = right.argmax(axis=1)
            top = right[np.arange(texts.size), best]
            rest = right.copy()
            rest[np.arange(texts.size), best] = 0
            score = np.where(top > 0, top / np.maximum(top + rest.max(axis=1), 1e-9), 0.0)
            letter = np.zeros(texts.size, bool)
            plain = ((LOWER[texts.data] >= 97) & (LOWER[texts.data] <= 122)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(plain)])
            letter[:] = sums[texts.offsets[1:]] > sums[texts.offsets[:-1]]
            for i in np.flatnonzero(~letter & (np.diff(texts.offsets) > 0)):
                letter[i] = any(c.isalpha() for c in texts.raw(i).decode("utf-8", "replace"))
            names = np.where(letter, np.where(top > 0, np.array(m.languages, object)[best], m.default), UNKNOWN)
            score = np.where(letter, score, 0.0)
        return pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                          [*piece.schema.names, "lang_pred", "score"])
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return map_pieces(docs, run, schema, text)
