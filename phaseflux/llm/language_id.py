"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 1- to 3-grams of its lower-cased letters, with word ends. Each falls into a hashed
bucket that has an embedding; their mean goes through a linear softmax. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. As the mean and the softmax's scores
are linear, a prediction adds up one row of scores for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .byte_bpe import classes
from .scratch import bounded

#: Buckets, embedding width, labelled texts for each language (about), passes over them, step, rate of rejected right answers.
BUCKETS, WIDTH, SAMPLE, EPOCHS, STEP, REJECT = 1 << 15, 16, 600, 6, 2.0, 0.01
UNDEFINED = "und"
_TURN = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def subwords(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' subwords, each text's first one (plus the end), and whether a text has a letter."""
    low = [(x or "").lower() for x in texts]
    at = np.concatenate([[0], np.cumsum([len(x) + 2 for x in low])]).astype(np.int64)
    points = np.frombuffer("".join([*(f" {x} " for x in low)]).encode("utf-32-le"), np.uint32)
    letter = classes().take(points) == 1
    letters = np.concatenate([[0], np.cumsum(letter)])
    chars = np.where(letter, points, 32).astype(np.uint32) + np.uint32(1)
    one = chars * _TURN[0]
    two = one[:-1] + np.roll(chars, -1)[:-1] * _TURN[1]
    three = two[:-1] + chars[2:] * _TURN[2]
    inside = letter[:-1] | letter[1:]
    found, place = [], []
    for k, (code, keep) in enumerate(((one, letter), (two, inside), (three, letter[1:-1]))):
        index = np.flatnonzero(keep)
        code = code[index] + np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        found.append((code % np.uint32(buckets)).astype(np.int32))
        place.append(index)
    row = [np.searchsorted(x, at) for x in place]
    count = sum(np.diff(r) for r in row)
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(ends[-1], np.int32)
    shift = ends[:-1].copy()
    for code, r in zip(found, row, strict=True):
        n = np.diff(r)
        out[np.repeat(shift - r[:-1], n) + np.arange(r[-1])] = code[: r[-1]]
        shift += n
    return out, ends, letters[at[1:]] > letters[at[:-1]]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    scale: float
    least: float  # the top probability from which an answer is confident

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, ends, letters = subwords(texts, len(self.scores))
        out, top = [UNDEFINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, top
        for i, (a, b, has) in enumerate(zip(ends[:-1], ends[1:], letters, strict=True)):
            if has:
                logits = (self.scores.take(found[a:b], 0).sum(0, dtype=np.float64) / (b - a) + self.bias) * self.scale
                p = np.exp(logits - logits.max())
                k = int(p.argmax())
                out[i], top[i] = self.languages[k], p[k] / p.sum()
        return out, top


def _counting(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.chunks(batch["text"]):
                found, ends, letters = subwords(batch["text"].slice(a, b - a).to_pylist(), buckets)
                keys, sums = [], []
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    key, count = np.unique(found[x:y], return_counts=True)
                    keys.append(key.tolist())
                    sums.append((count / max(y - x, 1)).tolist())
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(a, b - a), batch["turn"].slice(a, b - a), pa.array(keys, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.float32()))], ["lang", "turn", "keys", "shares"]).filter(pa.array(letters))

    return run


def sampled(docs: DataFrame, per_language: int = SAMPLE, buckets: int = BUCKETS, lang_col: str = "lang") -> list:
    """Subword shares of about so many labelled texts of each language, the ones with the least id hashes.

    No language is left out, however rare. The rows' number is bounded by that of the languages and `per_language`;
    a row has `buckets` shares at most.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), "text", F.xxhash64("doc_id", F.lit(5)).alias("turn"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return []
    # a language's rows with a hash in its lowest part: about per_language of them
    part = {r["lang"]: min(1.0, per_language / r["count"]) for r in sizes}
    limit = F.create_map(*(F.lit(x) for lang, p in part.items() for x in (lang, int((p * 2 - 1) * (2**63 - 1024)))))
    rows = known.where(F.col("turn") <= limit[F.col("lang")]).mapInArrow(_counting(buckets), "lang string, turn long, keys array<int>, shares array<float>")
    return sorted(rows.collect(), key=lambda r: (r["turn"], r["lang"]))


def train(rows: list, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, step: float = STEP, seed: int = 3) -> Model:
    """Embeddings and softmax by SGD; every fifth row is set aside to calibrate scale and rejection."""
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    data = [(np.array(r["keys"], np.int64), np.array(r["shares"], np.float32), languages.index(r["lang"])) for r in rows]
    aside = [x for i, x in enumerate(data) if i % 5 == 4] or data
    data = [x for i, x in enumerate(data) if i % 5 != 4] or data
    embed = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    out = np.zeros((width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = step * (1 - epoch / epochs)
        for i in rng.permutation(len(data)):
            keys, shares, lang = data[i]
            hidden = shares @ embed[keys]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[lang] -= 1
            back = out @ p
            out -= rate * 0.5 * np.outer(hidden, p)
            bias -= rate * 0.01 * p
            embed[keys] -= rate * 20 * shares[:, None] * back
    scores = embed @ out
    logits = np.array([s @ scores[k] + bias for k, s, _ in aside], np.float64)
    truth = np.array([y for _, _, y in aside])
    best = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: _loss(logits * t, truth))
    p = _soft(logits * best)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    return Model(languages, scores, bias.astype(np.float64), best, float(right[int(REJECT * len(right))]) if len(right) else 1.0)


def _soft(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(np.maximum(_soft(logits)[np.arange(len(truth)), truth], 1e-12)).mean())


def _predicting(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.chunks(batch["text"]):
                langs, top = model.predict(batch["text"].slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(langs, pa.string()), pa.array(top), pa.array([t >= model.least and x != UNDEFINED for x, t in zip(langs, top, strict=True)]),
                ], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, per_language: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, confident), one row per input row; other columns are not read.

    Rows whose crc32 of the id as text leaves `held` when divided by `folds` are held out; the model learns from
    others that have a text and a language, a bounded sample of about `per_language` each, whose sum grows with the
    number of languages on the driver. lang_pred is a learned language, `und` with score 0 for texts that are null or have no letter; score is the calibrated probability;
    `confident` is false where that falls below what all but a hundredth of right answers reach. A null id is
    not held out, and not learnt from. Without any labelled text all are `und`. No rows: no rows.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    model = train(sampled(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()), per_language))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predicting(model), "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")
