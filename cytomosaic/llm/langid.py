"""Language identification by prediction by partial matching (PPM) over bytes.

Each language is a variable-order byte context tree, read from labelled documents and then frozen. A byte that was seen after
the current context costs ``-log2(count / (total + distinct))`` bits; otherwise the escape costs
``-log2(distinct / (total + distinct))`` bits and the context loses its oldest byte, down to the uniform code of 8 bits. With
frozen statistics the cost of a byte depends on its ``ORDER`` preceding bytes only, so a text's exact code length is a sum of
looked-up costs. The shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared, sliced, slices

ORDER = 4
#: Bound of the training sample: about so many labelled documents per language, chosen by hash of doc_id.
TRAIN_DOCS = 1000
UNKNOWN = "und"
GRAM = ORDER + 1
_LETTER = re.compile(rb"[A-Za-z]")
# A-Z become a-z, all other ASCII characters but letters one blank; bytes of longer characters stay
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id belongs to neither fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Folded pieces of at most ``size`` bytes, each led by the ``ORDER`` bytes before it (blanks at the start)."""
    lead = b" " * ORDER
    for at in range(0, len(text), size):
        part = text[at:at + size].translate(_FOLD)
        yield lead + part
        lead = (lead + part)[-ORDER:]


def gram_codes(folded: np.ndarray) -> np.ndarray:
    """Code of the ``GRAM`` bytes that end at each position from ``ORDER`` on."""
    code = np.zeros(len(folded) - ORDER, np.int64)
    for i in range(GRAM):
        code = (code << 8) | folded[i:len(folded) - ORDER + i]
    return code


def count_grams(batches, size: int = 1 << 20):
    """(lang, gram, n) of each batch: the map side of the training counts."""
    for batch in slices(batches):
        found: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in pieces(text.encode(), size):
                found.setdefault(lang, []).append(gram_codes(np.frombuffer(piece, np.uint8)))
        for lang, codes in found.items():
            gram, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Contexts:
    """The frozen trees of all languages as sorted arrays, one pair per order.

    ``symbols[k]`` holds the cost in bits of every (context of k bytes, byte) that some language saw, NaN where a language
    did not; ``escapes[k]`` the cost of leaving a context of k bytes, 0 where a language never met that context.
    """

    def __init__(self, langs: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs, self.symbols, self.escapes = langs, [], []
        for k in range(ORDER + 1):
            code = gram & ((1 << (8 * (k + 1))) - 1)
            key, at = np.unique(code, return_inverse=True)
            seen = np.zeros((len(key), len(langs)))
            np.add.at(seen, (at, which), n)
            ctx, up = np.unique(key >> 8, return_inverse=True)
            total, distinct = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, up, seen)
            np.add.at(distinct, up, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(seen > 0, np.log2((total + distinct)[up] / seen), np.nan)
                leave = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            self.symbols.append((key, cost.astype(np.float32)))
            self.escapes.append((ctx, leave.astype(np.float32)))

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its context, one column per language."""
        bits = np.zeros((len(gram), len(self.langs)), np.float32)
        open_ = np.ones(bits.shape, bool)
        for k in range(ORDER, -1, -1):
            code = gram & ((1 << (8 * (k + 1))) - 1)
            here = _find(self.symbols[k], code, np.nan)
            hit = open_ & ~np.isnan(here)
            bits[hit] += here[hit]
            open_ &= ~hit
            leave = _find(self.escapes[k], code >> 8, 0.0)
            bits[open_] += leave[open_]
        bits[open_] += 8
        return bits

    def code_lengths(self, texts: list[bytes], size: int) -> np.ndarray:
        """Exact code length in bits of every whole text under every language."""
        total = np.zeros((len(texts), len(self.langs)))
        buffer, owner, held = [], [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text, size):
                buffer.append(piece)
                owner.append(i)
                held += len(piece)
                if held >= size:
                    self._add(total, buffer, owner)
                    buffer, owner, held = [], [], 0
        if buffer:
            self._add(total, buffer, owner)
        return total

    def _add(self, total: np.ndarray, buffer: list[bytes], owner: list[int]) -> None:
        codes = gram_codes(np.frombuffer(b"".join(buffer), np.uint8))
        gram, at = np.unique(codes, return_inverse=True)
        sums = np.zeros((len(codes) + 1, len(self.langs)))
        np.cumsum(self.costs(gram)[at], axis=0, dtype=np.float64, out=sums[1:])
        ends = np.cumsum([len(b) for b in buffer])
        starts = ends - [len(b) for b in buffer]
        # position p of the joined pieces has its gram at p - ORDER, so a piece's own bytes start at its start
        np.add.at(total, owner, sums[ends - ORDER] - sums[starts])


def _find(tree, code: np.ndarray, missing: float) -> np.ndarray:
    key, value = tree
    at = np.minimum(np.searchsorted(key, code), len(key) - 1)
    return np.where((key[at] == code)[:, None], value[at], np.float32(missing))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Contexts | None:
    """Context trees of all languages of ``docs`` (columns text and lang; rows with nulls teach nothing).

    Reads at most about ``train_docs`` whole documents per language: all of them, or those with the smallest hashes of
    doc_id. Returns None without labelled rows. The trees are bounded by that sample and built on the driver.
    """
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_lang:
        return None
    share = F.create_map(*[x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(1.0, train_docs / n)))])[F.col("lang")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"))  # rows without doc_id are chosen by their text
    place = F.pmod(F.xxhash64(name), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.filter(place < share).select("lang", "text")
    grams = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not grams.num_rows:
        return None
    langs = sorted(set(grams["lang"].unique().to_pylist()))
    which = grams["lang"].combine_chunks().dictionary_encode()
    place_of = np.array([langs.index(x) for x in which.dictionary.to_pylist()])
    return Contexts(langs, place_of[which.indices.to_numpy()], grams["gram"].to_numpy(), grams["n"].to_numpy().astype(float))


NAMES = ("lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, model: Contexts | None, names: tuple = NAMES) -> DataFrame:
    """``docs`` with the predicted language, its score and the bits per byte of its code, under ``names``; only the text is read.

    The score is the winner's share of the probability that the languages' codes give the text (0 to 1). A text that is null or
    has no letter is ``und`` with score 0 and null bits, as is every text when nothing was learned. Columns of ``docs`` with these
    names are replaced.
    """
    if model is None:
        return docs.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double")))))
    frozen = shared(docs.sparkSession, model)  # bounded by the training sample
    size = max(1 << 16, (1 << 21) // len(model.langs))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def predict(text):
        trees = frozen()
        texts = [t.encode() if t is not None else b"" for t in text]
        usable = [i for i, t in enumerate(texts) if has_letter(t)]
        bits = trees.code_lengths([texts[i] for i in usable], size)
        out = [{"lang_pred": UNKNOWN, "score": 0.0, "bits_per_byte": None}] * len(texts)
        if usable:
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            for i, b, s, n in zip(usable, best.tolist(), share.tolist(), least.tolist()):
                out[i] = {"lang_pred": trees.langs[b], "score": min(1.0, s), "bits_per_byte": n / len(texts[i])}
        return pa.array(out, kind)

    name = fresh(docs, "_ppm")
    scored = F.arrow_udf(sliced(predict), "struct<lang_pred: string, score: double, bits_per_byte: double>")
    rows = docs.withColumn(name, scored(F.col("text").cast("string")))
    return rows.withColumns({to: F.col(name)[c] for to, c in zip(names, NAMES)}).drop(name)


def in_known_language(docs: DataFrame, model: Contexts | None, max_bits_per_byte: float = 8.0) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages.

    Texts without a letter go, and texts whose shortest code needs ``max_bits_per_byte`` or more: the uniform code needs 8, so no
    language explains them.
    """
    names = tuple(fresh(docs, f"_{c}") for c in NAMES)
    return identify(docs, model, names).filter((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) < max_bits_per_byte)).drop(*names)
