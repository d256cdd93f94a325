"""Language ID with language-bitmask n-gram filters: bit-sliced Bloom filters, popcounts by language, false positives out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import BLANK, materialize, mix, slices, small, text_buffer, with_columns_of, worker_memory

#: Bytes of an n-gram.
GRAM = 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[BLANK] = 32
_FOLD[48:58] = 48  # digits are alike
_OPEN = _FOLD.copy()  # the same with ASCII punctuation as blanks
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _OPEN[_a:_b] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before and behind each, so that words at the edges and short texts have n-grams like others."""
    n = len(off) - 1
    out = np.full(len(buf) + 2 * n, 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = buf
    return out, off + 2 * np.arange(n + 1)


def gram_count(text: str) -> Column:
    """How many n-grams a text column's texts have."""
    return F.greatest(F.octet_length(text) + F.lit(2 - GRAM + 1), F.lit(0))


def _grams(buf: np.ndarray) -> np.ndarray:
    """The GRAM folded bytes that start at each place, as one number."""
    x = _FOLD[buf].astype(np.uint64)
    m = max(len(x) - GRAM + 1, 0)
    out = x[:m].copy()
    for j in range(1, GRAM):
        out = (out << np.uint64(8)) | x[j : j + m]
    return out


def _owners(off: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each text and one past its last gram, among m grams of all."""
    return np.minimum(off[:-1], m), np.minimum(np.maximum(off[1:] - GRAM + 1, off[:-1]), m)


@dataclass
class LanguageFilters:
    """One bit for each language at each place of the filter: a look-up gives all languages that hold an n-gram.

    bits: (words of 64 languages, places); an n-gram is held where all of its `probes` places have a language's bit."""

    languages: list[str]
    log2_places: int = 17
    probes: int = 2
    bits: np.ndarray = field(default=None)
    usual: int = 0  # the language of most labelled texts, for texts that tell nothing

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams + np.uint64(0x51ED270B))
        for k in range(self.probes):
            yield ((h >> np.uint64(20 * k)) & np.uint64((1 << self.log2_places) - 1)).astype(np.int64)

    def add(self, grams: np.ndarray, language: int) -> None:
        if self.bits is None:
            self.bits = np.zeros((max(1, -(-len(self.languages) // 64)), 1 << self.log2_places), np.uint64)
        for at in self.places(grams):
            self.bits[language // 64, at] |= np.uint64(1) << np.uint64(language % 64)

    def false_positive_rates(self) -> np.ndarray:
        fill = [np.mean((self.bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.languages))]
        return np.array(fill) ** self.probes

    def counts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) n-grams of each text that a language holds, false positives taken out, and all n-grams."""
        grams = _grams(buf)
        lo, hi = _owners(off, len(grams))
        total, rate = (hi - lo).astype(np.float64), self.false_positive_rates()
        places = list(self.places(grams))
        out = np.zeros((len(off) - 1, len(self.languages)))
        for w, row in enumerate(self.bits):
            held = row[places[0]]
            for at in places[1:]:
                held &= row[at]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                sums = np.zeros(len(grams) + 1, np.int32)
                np.cumsum((held >> np.uint64(i % 64)).astype(np.uint8) & np.uint8(1), dtype=np.int32, out=sums[1:])
                out[:, i] = np.maximum(sums[hi] - sums[lo] - total * rate[i], 0) / (1 - rate[i])
        return out, total


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = 2000, grams: int = 20_000, share: float = 0.02, noise: float = 0.35) -> LanguageFilters | None:
    """Filters from rows of docs with a language: about `sample` rows for each language (all if it has fewer), chosen by a hash of
    the key. A language's filter gets the n-grams that at least `share` of its sampled texts contain, at most `grams`, unless
    another language's texts contain them more than 1/noise times as often. A column of very many values costs filters of so many bits, no wider plan. None if there is nothing to learn from.

    The driver receives at most `grams` n-grams for each language, whatever the input's size."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(key)).alias("h"))
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    sizes = {r["lang"]: r["texts"] for r in counts.collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    known = known.join(small(counts), "lang").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("texts")))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("languages")
        for batch in batches:
            for piece in slices(batch):
                buf, off = _padded(*text_buffer(piece.column(1)))
                g = _grams(buf)
                lo, hi = _owners(off, len(g))
                doc = np.repeat(np.arange(len(off) - 1), hi - lo)
                at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(doc))
                code, names = piece.column(0).dictionary_encode().indices.to_numpy(), piece.column(0).dictionary_encode().dictionary
                each = np.unique((doc.astype(np.uint64) << np.uint64(32)) | g[at])
                pair, n = np.unique((code[(each >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (each & np.uint64(0xFFFFFFFF)), return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array((pair >> np.uint64(32)).astype(np.int64))), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = known.select("lang", "text").mapInArrow(held, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.join(small(counts), "lang").withColumn("rate", F.col("n") / F.least("texts", F.lit(sample)).cast("double")).where(F.col("rate") >= share)
    ranked = counted.withColumn("place", F.expr("row_number() over (partition by lang order by rate desc, gram)")).where(F.col("place") <= grams)
    found = ranked.select("lang", "gram", "rate").toPandas()
    found["most"] = found.groupby("gram")["rate"].transform("max")
    found = found[found["rate"] >= noise * found["most"]]
    out = LanguageFilters(languages, usual=languages.index(max(languages, key=sizes.get)))
    for i, name in enumerate(languages):
        out.add(found.loc[found["lang"] == name, "gram"].to_numpy().astype(np.uint64), i)
    return out


def identify(docs: DataFrame, filters: LanguageFilters | None, text: str = "text") -> DataFrame:
    """All rows of docs with lang_pred and lang_score (0 to 1).

    The language that holds the most of the n-grams of the whole text, with a blank on both sides, wins, the first by name
    among equals; a text none of whose n-grams a language holds is looked at once more with its punctuation as blanks, and if that
    tells nothing either, gets the language of most labelled texts with score 0. A score is the winner's
    part of the sum over languages, weighted by the part of the n-grams that it holds. Null texts and texts without a letter are
    `und` with score 0, and so is every text if there are no filters. Rows are judged each for itself, so null keys, repeated rows and an empty table
    need nothing of their own; long texts are read whole. Existing columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size follows from log2_places and the number of languages

    def judge(col: pa.Array) -> list[pa.Array]:
        worker_memory("languages")
        model = shared.value
        buf, off = text_buffer(col)
        letters = np.r_[0, np.cumsum(_LETTER[buf])]
        known = letters[off[1:]] > letters[off[:-1]]
        wide = np.r_[0, np.cumsum(buf >= 128)]
        for i in np.flatnonzero(~known & (wide[off[1:]] > wide[off[:-1]])):
            known[i] = any(c.isalpha() for c in col[int(i)].as_py())
        if model is None:
            known[:] = False
            best, score = np.zeros(len(known), int), np.zeros(len(known))
        else:
            counts, total = model.counts(*_padded(buf, off))
            silent = np.flatnonzero(known & (counts.max(axis=1) == 0))
            if len(silent):  # words that punctuation hides
                again, ends = text_buffer(col.take(pa.array(silent)))
                counts[silent], total[silent] = model.counts(*_padded(_OPEN[again], ends))
            best = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), model.usual)
            top, sums = counts[np.arange(len(best)), best], counts.sum(axis=1)
            part = np.divide(top, sums, out=np.zeros_like(top), where=sums > 0)
            score = np.clip(part * np.sqrt(np.divide(top, total, out=np.zeros_like(top), where=total > 0)), 0, 1)
        names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]

    return with_columns_of(docs, text, {"lang_pred": StringType(), "lang_score": DoubleType()}, judge)
