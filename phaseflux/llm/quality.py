"""Text quality from weak labels.

Heuristic labellers look at overlapping signs of junk and vote bad, good or not at all. How many texts have each
pattern of votes is counted over the whole corpus; expectation-maximisation on these counts estimates how
often each labeller votes which way on good and on bad texts, and so the chance that a text with a pattern is good.
These chances label a bounded sample of texts, on which a hashed linear scorer of word shapes and repeats is
trained; its score, averaged with the chance by the text's own votes, decides for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import bounded, fresh

#: Buckets of the scorer, texts that it is trained on (about), steps, the score below which a text is rejected.
BUCKETS, SAMPLE, STEPS, LEAST = 2048, 4000, 400, 0.5
#: Words of a window within which repeated words are counted; windows cover the whole text.
WINDOW = 1000
#: Bounds of a labeller's bad votes: on good texts at most, on bad texts at least. Without them two kinds of junk
#: with different signs may end as the two sides.
FALSE, HIT = 0.002, 0.05
_SIGNS = np.zeros(256, np.uint8)  # 0 other, 1 lower or beyond ASCII, 2 upper, 3 digit, 4 space, 5 plain punctuation, 6 end of sentence
_SIGNS[0x61:0x7B] = 1
_SIGNS[0x80:] = 1
_SIGNS[0x41:0x5B] = 2
_SIGNS[0x30:0x3A] = 3
_SIGNS[[0x20, 9, 10, 11, 12, 13]] = 4
_SIGNS[list(b",;:'\"()-")] = 5
_SIGNS[list(b".?!")] = 6
#: Labellers: name, measure, bad beyond (below, above), good within (from, to), least measure of words.
LABELLERS = (
    ("shouting", "upper", None, 0.30, 0.0, 0.15, 8),
    ("symbols", "symbols", None, 0.05, 0.0, 0.02, 8),
    ("echoes", "echoes", None, 0.25, 0.0, 0.06, 8),
    ("lists", "bars", None, 0.10, 0.0, 0.02, 0),
    ("variety", "variety", 0.30, None, 0.45, 1.0, 20),
    ("sentences", "closed", 0.01, 0.45, 0.03, 0.30, 30),
    ("exclaiming", "bangs", None, 0.20, 0.0, 0.05, 8),
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


class Measured:
    """Counts over the words and bytes of some texts, an array entry for each text."""

    def __init__(self, texts: list[bytes | None]):
        data, at = words.joined(texts)
        signs = _SIGNS[data]
        n = len(texts)
        space = signs == 4
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(starts, at)
        self.row = np.repeat(np.arange(n), np.diff(self.first))
        hashes = words.digest(data, starts, ends)
        self.words = np.diff(self.first)
        of = lambda flags: np.bincount(self.row[flags], minlength=n)
        chars = np.repeat(np.arange(n), np.diff(at))
        count = lambda flags: np.bincount(chars[flags[: len(chars)]], minlength=n)
        echo = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (self.row[1:] == self.row[:-1])]) if len(hashes) else np.zeros(0, bool)
        # repeats count within a window only: over a whole text their share would rise with its length
        window = np.cumsum((np.arange(len(hashes)) - self.first[self.row]) % WINDOW == 0)
        order = np.lexsort((hashes, window))
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (window[order[1:]] == window[order[:-1]])
        last, before = data[np.maximum(ends - 1, 0)], data[np.maximum(ends - 2, starts)]
        ascii_ = (data < 0x80) & ((signs == 1) | (signs == 2))
        self.of = {
            "upper": _share(count(signs == 2), count(ascii_)),
            "symbols": _share(count(signs == 0), np.diff(at)),
            "echoes": _share(of(echo), self.words),
            "bars": _share(of((ends - starts == 1) & (last == 0x7C)), self.words),
            "variety": _share(of(~again), self.words),
            "closed": _share(of(_SIGNS[last] == 6), self.words),
            "bangs": _share(of((last == 0x21) & (before == 0x21)), self.words),
        }
        # a word's shape: sign of its first character, its last two characters' signs (symbols as they are), repeats
        sharp = np.where(signs == 0, data.astype(np.int64) + 16, signs)
        code = (signs[starts].astype(np.int64) * 272 + sharp[np.maximum(ends - 1, 0)]) * 272 + sharp[np.maximum(ends - 2, starts)]
        code = ((code * 2 + echo) * 2 + again) * 4 + np.minimum((ends - starts) // 4, 3)
        self.code = words.mix(code.astype(np.uint64))

    def votes(self) -> np.ndarray:
        """A digit for each labeller: 0 none, 1 bad, 2 good; texts as rows."""
        out = np.zeros((len(self.words), len(LABELLERS)), np.int64)
        for k, (_, of, below, above, low, high, least) in enumerate(LABELLERS):
            x = self.of[of]
            out[(x >= low) & (x <= high), k] = 2
            if below is not None:
                out[x < below, k] = 1
            if above is not None:
                out[x > above, k] = 1
            out[self.words < max(least, 1), k] = 0
        return out

    def features(self, buckets: int) -> np.ndarray:
        """Square roots of the shares of words in each bucket."""
        flat = self.row * buckets + (self.code % np.uint64(buckets)).astype(np.int64)
        counts = np.bincount(flat, minlength=len(self.words) * buckets).reshape(-1, buckets)
        return np.sqrt(_share(counts, self.words[:, None]))


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for a, b in words.chunks(texts):
            code = Measured(texts.slice(a, b - a).to_pylist()).votes() @ weights
            yield pa.RecordBatch.from_arrays([batch["turn"].slice(a, b - a), pa.array(code.astype(np.int32))], ["turn", "pattern"])


def _sampling(buckets: int):
    weights = 3 ** np.arange(len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts, 1 << 20):
                seen = Measured(texts.slice(a, b - a).to_pylist())
                dense = seen.features(buckets)
                rows = [np.flatnonzero(x) for x in dense]
                yield pa.RecordBatch.from_arrays([
                    batch["turn"].slice(a, b - a), pa.array((seen.votes() @ weights).astype(np.int32)),
                    pa.array([x.tolist() for x in rows], pa.list_(pa.int32())), pa.array([dense[i, x].tolist() for i, x in enumerate(rows)], pa.list_(pa.float32())),
                ], ["turn", "pattern", "keys", "values"])

    return run


def _digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def posterior(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Chance that a text of each vote pattern is good, by expectation-maximisation on the patterns' counts.

    It starts from: a bad vote makes a bad text more likely than not. Votes count as independent given the truth.
    FALSE and HIT are priors that cut the estimates: a labeller votes against FALSE of the good texts at most, and against
    HIT of the bad ones at least, as each was made to be right where it speaks.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts), np.int64)
    number = np.array([counts[int(x)] for x in patterns], np.float64)
    digits = _digits(patterns)
    good = np.where((digits == 1).any(1), 0.1, 0.9)
    for _ in range(rounds):
        prior = ((good * number).sum() + 1) / (number.sum() + 2)
        logs = np.zeros((2, len(patterns)))
        for side, weight in enumerate(((1 - good) * number, good * number)):
            for k in range(len(LABELLERS)):
                # an abstention tells nothing
                sums = np.array([weight[digits[:, k] == v].sum() for v in (1, 2)]) + np.array([0.5, 0.5])
                bad = sums[0] / sums.sum()
                bad = min(bad, FALSE) if side else max(bad, HIT)
                chance = np.log([bad, 1 - bad])
                logs[side] += np.where(digits[:, k] == 1, chance[0], np.where(digits[:, k] == 2, chance[1], 0))
        odds = np.clip(logs[1] - logs[0] + np.log(prior) - np.log(1 - prior), -40, 40)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def train(rows: list, chances: dict[int, float], buckets: int = BUCKETS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of good texts, by gradient steps on the posterior labels."""
    x = np.zeros((len(rows), buckets), np.float32)
    for i, r in enumerate(rows):
        x[i, r["keys"]] = r["values"]
    y = np.array([chances[r["pattern"]] for r in rows], np.float64)
    # both sides weigh the same, however rare one is
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight /= max(weight.sum(), 1e-9)
    w, bias, speed = np.zeros(buckets), 0.0, np.zeros(buckets)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -40, 40)))
        back = weight * (p - y)
        speed = 0.9 * speed - (x.T @ back.astype(np.float32) + 1e-5 * w) * 4.0
        w = w + speed
        bias -= 2.0 * float(back.sum())
    return w, bias


Fitted = tuple[np.ndarray, float, dict[int, float]]


def _judged(seen: Measured, fitted: Fitted, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes, posterior, score and decision of some texts: kept if the mean of both chances reaches `least`."""
    w, bias, chances = fitted
    votes, some = seen.votes(), seen.words > 0
    score = np.where(some, 1 / (1 + np.exp(-np.clip(seen.features(len(w)) @ w + bias, -40, 40))), 0.0)
    chance = np.where(some, [chances.get(int(x), 0.5) for x in votes @ 3 ** np.arange(len(LABELLERS))], 0.0)
    return votes, chance, score, (score + chance) / 2 >= least


def _scoring(fitted: Fitted, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts, 1 << 20):
                votes, chance, score, kept = _judged(Measured(texts.slice(a, b - a).to_pylist()), fitted, least)
                shown = pa.array(["".join("-01"[v] for v in r) for r in votes.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), shown, pa.array(chance), pa.array(score), pa.array(kept)], ["doc_id", "votes", "posterior", "score", "kept"])

    return run


_OUT = "doc_id long, votes string, posterior double, score double, kept boolean"


def fit(rows: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Fitted:
    """Scorer and posteriors from rows with a `turn` (a hash) and a `text`.

    The patterns are counted over all rows; the scorer is trained on those with the lowest turns, about `sample`.
    """
    counts = {r["pattern"]: r["count"] for r in rows.mapInArrow(_voting, "turn long, pattern int").groupBy("pattern").count().collect()}  # 3 ** labellers rows at most
    chances, total = posterior(counts), sum(counts.values())
    if not total:
        return np.zeros(buckets), 0.0, {}
    limit = int((min(1.0, sample / total) * 2 - 1) * (2**63 - 1024))
    chosen = rows.where(F.col("turn") <= limit).mapInArrow(_sampling(buckets), "turn long, pattern int, keys array<int>, values array<float>").collect()
    return *train(sorted(chosen, key=lambda r: (r["turn"], r["pattern"])), chances, buckets), chances


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, F.lit(9)).alias("turn"), F.col(text_col).cast("string").alias("text"))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """(doc_id, votes, posterior, score, kept), one row per input row; other columns are not read.

    votes has a character for each labeller (0 bad, 1 good, - none); posterior is the chance of a good text by the
    votes, score by the linear scorer, and texts whose mean of both is below `least` are not kept. Null, empty and
    blank texts get no votes and 0 for both. Null ids and repeated rows are judged like others. No rows: no rows.
    """
    rows = _read(docs, id_col, text_col)
    fitted = fit(rows.select("turn", "text"), sample)
    return rows.select("doc_id", "text").mapInArrow(_scoring(fitted, least), _OUT)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The input's rows and columns without the texts that the scorer rejects; nothing is shuffled."""
    fitted = fit(_read(docs, id_col, text_col).select("turn", "text"), sample)
    names, text = docs.columns, fresh("text__", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text].cast(pa.binary())
            kept = []
            for a, b in words.chunks(texts, 1 << 20):
                kept.append(_judged(Measured(texts.slice(a, b - a).to_pylist()), fitted, least)[3])
            yield batch.select(names).filter(pa.array(np.concatenate([*kept, np.zeros(0, bool)])))

    return bounded(docs).withColumn(text, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
