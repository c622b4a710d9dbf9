"""Toxicity: a subword bag with a linear softmax.

A word's subwords are its character n-grams, with its ends marked, and its whole form, each hashed to a row of
one embedding table; a text is the mean of its words' mean vectors, and a linear softmax over that vector
gives the score. Embeddings and softmax are trained together in numpy, so a misspelt or unseen form is scored
by the n-grams that it shares with known ones. Many texts are hashed at once, as arrays of characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, table

#: Rows of the table, lengths of n-grams, characters of a word that count as one, and characters hashed at once.
BUCKETS, NGRAMS, STRETCH, CHUNK = 1 << 18, (3, 4, 5, 6), 64, 1 << 19
#: The bounds of training: rows of label 1 (three times as many of label 0, whose texts vary more), bytes of
#: their texts for each label; vector length, rounds, texts of a step, rates, and the standard errors at which
#: a row's evidence is at a quarter.
SAMPLE, SAMPLE_BYTES, DIM, ROUNDS, BATCH, RATE_E, RATE_W, SURE = 1200, 16 << 20, 4, 8, 480, 2.0, 0.3, 10.0
THRESHOLD = 0.7
_PUNCTUATION = ".,;:!?\"'()[]{}<>*#&%$-_/\\|"
#: By character, up to the last white one: 0, or 1 for white space, 2 for punctuation.
_KIND = np.array([1 if chr(i).isspace() else 2 if chr(i) in _PUNCTUATION else 0 for i in range(0x3002)], np.uint8)


def _odd_numbers(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_BY_PLACE, _LAST = _odd_numbers(max(NGRAMS) + 2), np.uint32(0x9E3779B1)


def _row(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _LAST
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def pieces(text: str) -> list[str]:
    """A text in pieces of up to CHUNK characters, cut at white space; where a word is longer, pieces share as
    many characters as keep each n-gram whole in one of them."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        piece = text[at : at + CHUNK]
        head = piece.rsplit(None, 1)[0] if not piece[-1].isspace() else piece
        if 0 < len(head) < len(piece) or head is piece:
            out.append(head)
            at += len(head)
        else:
            out.append(piece)
            at += CHUNK - max(NGRAMS) + 1
    return [*out, text[at:]]


class Grams:
    """The subwords of pieces of lower-cased text.

    ``starts``: where units begin, a unit being a word, or each STRETCH characters of a longer one; ``owner``:
    the number of a unit's piece; ``each()``: for whole forms and each length of n-gram, their places (within
    their unit's stretch of places) and rows. Words are runs without white space, their outer punctuation
    stripped; punctuation alone is no word. An n-gram that spans two units belongs to the first.
    """

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join([*(" " + t for t in texts), " "]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(codes, len(_KIND) - 1)]
        place = np.arange(len(codes), dtype=np.int32)
        core, white = kind == 0, kind == 1
        inside = _last(place, core) > _last(place, white)
        inside &= _next(place, core) < _next(place, white)
        kept = inside & ~white
        self.size = len(codes)
        self.symbols = np.append(np.where(kept, codes, np.uint32(0)), np.zeros(max(NGRAMS), np.uint32))
        self.ahead = _next(place, ~kept) - place  # characters of the word from here on
        begins = np.flatnonzero(~kept[:-1] & kept[1:]).astype(np.int32)
        into = place - _last(place, ~kept) - 1
        self.words, self.into = begins, into
        self.starts = np.sort(np.append(begins, np.flatnonzero(kept & (into > 0) & (into % STRETCH == 0)).astype(np.int32)))
        sizes = np.array([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(np.cumsum(sizes), self.starts, side="right")

    def each(self):
        s = self.symbols + np.uint32(1)
        if len(self.words):
            h = (s[: self.size] + self.into.astype(np.uint32) * _BY_PLACE[-1]) * _BY_PLACE[-2]
            h = np.where(self.symbols[: self.size] > 0, (h ^ (h >> np.uint32(13))) * _LAST, np.uint32(0))
            yield self.words, _row(np.add.reduceat(h, self.words, dtype=np.uint32))
        ahead = np.append(self.ahead[1:], 0)
        at = np.flatnonzero(ahead > 0).astype(np.int32)
        h, done = np.zeros(len(at), np.uint32), 0
        for n in NGRAMS:
            long = ahead[at] >= n - 2
            if not long.all():
                at, h = at[long], h[long]
            for j in range(done, n):
                h = h + s[at + j] * _BY_PLACE[j]
            done = n
            yield at, _row(h)


def _last(place: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The last of these places up to each; -1 for none."""
    return np.maximum.accumulate(np.where(where, place, np.int32(-1)))


def _next(place: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The next of these places from each on; one past the end for none."""
    return np.minimum.accumulate(np.where(where, place, np.int32(len(place)))[::-1])[::-1]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's rows and its share of each: the mean over units of the mean over their subwords."""
    share, units = np.zeros(BUCKETS), 0
    for piece in pieces((text or "").lower()):
        g = Grams([piece])
        if not len(g.starts):
            continue
        found = [(np.searchsorted(g.starts, at, side="right") - 1, rows) for at, rows in g.each()]
        unit, rows = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        count = np.bincount(unit)
        share += np.bincount(rows, 1 / count[unit], minlength=BUCKETS)
        units += np.count_nonzero(count)
    rows = np.flatnonzero(share).astype(np.int32)
    return rows, (share[rows] / max(units, 1)).astype(np.float32)


class Model:
    def __init__(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.vectors, self.softmax, self.bias = vectors, softmax, bias

    def margins(self) -> tuple[np.ndarray, float]:
        """What each row adds to the log odds of label 1, and their base."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def evidence(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each row: how surely and how far the share of the texts that hold it differs between the
    labels, by standard errors and by lift. It is small, yet above 0, where the difference may be chance."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    seen = np.zeros((2, BUCKETS))
    for (rows, _), c in zip(bags, y, strict=True):
        seen[c, rows] += 1
    share, both = seen / n[:, None], seen.sum(0) / n.sum()
    z = (share[1] - share[0]) ** 2 / (both * (1 - both) * (1 / n).sum() + 1e-12)
    lift = np.abs(np.log2((share[1] + 1 / n[1]) / (share[0] + 1 / n[0])))
    return (z / (z + SURE**2)) ** 2 * np.minimum(lift, 1) ** 2


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Gradient descent with momentum, in steps of BATCH texts, on the mean cross entropy, each class weighing the
    same.

    Each row that the texts hold gets a vector; those of other rows stay zero, so unknown subwords count for
    nothing. Columns are divided by their root mean square, so rare rows learn as fast as common ones, and
    each learns at the rate of its evidence, so thousands of rows of chance don't outweigh the few that tell.
    Without rows of both classes the model gives the one class's label, or 0 without any.
    """
    random = np.random.default_rng(seed)
    w, bias = random.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), w, np.array([0.0, 6.0 if 1 in labels else -6.0]))
    square = np.zeros(BUCKETS)
    for rows, share in bags:
        square[rows] += np.square(share, dtype=np.float64)
    rate = evidence(bags, y)
    scale = (rate / np.sqrt(square / len(y) + 1e-12) / np.sqrt(np.square(rate).sum() + 1e-12)).astype(np.float32)
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    weight = np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum()).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    # The texts of each step in one piece; each bag is given up when it is there.
    bags, steps = list(bags), []
    order = random.permutation(len(y))
    for a in range(0, len(order), BATCH):
        batch = order[a : a + BATCH]
        sizes = np.array([len(bags[i][0]) for i in batch])
        rows, share = (np.concatenate([bags[i][k] for i in batch]) for k in (0, 1))
        steps.append((batch, sizes, rows, share))
        for i in batch:
            bags[i] = None
    moved, moved_w, moved_bias = np.zeros_like(vectors), np.zeros_like(w), np.zeros_like(bias)
    for _ in range(ROUNDS):
        for batch, sizes, rows, share in steps:
            text, amount = np.repeat(np.arange(len(batch), dtype=np.int32), sizes), share * scale[rows]
            hidden = np.stack([np.bincount(text, amount * vectors[rows, d], minlength=len(batch)) for d in range(DIM)], axis=1)
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[batch]) * weight[batch, None] / len(batch)
            back = error @ w.T
            for m, g in ((moved_w, hidden.T @ error), (moved_bias, error.sum(0))):
                m *= 0.9
                m -= RATE_W * g
            moved *= 0.9
            for d in range(DIM):
                moved[:, d] -= RATE_E * np.bincount(rows, amount * back[text, d], minlength=BUCKETS)
            vectors += moved
            w += moved_w
            bias += moved_bias
    return Model(vectors * scale[:, None], w, bias)


class Scorer:
    def __init__(self, margins: np.ndarray, base: float):
        self.margins, self.base = margins, base

    def scores(self, texts: list[str | None]) -> list[float]:
        total, units = np.zeros(len(texts)), np.zeros(len(texts))
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in pieces((text or "").lower()):
                if size + len(piece) > CHUNK and held:
                    self._add(held, owner, total, units)
                    held, owner, size = [], [], 0
                held.append(piece)
                owner.append(i)
                size += len(piece)
        if held:
            self._add(held, owner, total, units)
        odds = np.clip(self.base + total / np.maximum(units, 1), -30, 30)
        return (1 / (1 + np.exp(-odds))).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def _add(self, held: list[str], owner: list[int], total: np.ndarray, units: np.ndarray) -> None:
        g = Grams(held)
        if not len(g.starts):
            return
        amount, count = np.zeros(g.size), np.zeros(g.size, np.int32)
        for at, rows in g.each():
            amount[at] += self.margins[rows]
            count[at] += 1
        amount, count = np.add.reduceat(amount, g.starts), np.add.reduceat(count, g.starts)
        some = count > 0  # the last character of a word begins no n-gram: a stretch of it alone is no unit
        mean, whose = amount[some] / count[some], np.array(owner)[g.owner[some]]
        total += np.bincount(whose, mean, minlength=len(total))
        units += np.bincount(whose, minlength=len(units))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` rows of label 1 and 3 * sample of label 0, whole texts, those of the least
    hashes of id and text that hold ``sample_bytes`` for each label together at most.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. Rows whose crc32(doc_id as text) mod 3 is 1 are
    never read, nor rows with a null id or a label other than 0 and 1; an id with both labels counts for both.
    The sample alone reaches the driver, so its bytes are bounded whatever the table and its texts.
    """
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id")).distinct()
    few = [usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((0, 3 * sample), (1, sample))]
    # At most 4 * sample ids: safe to send to all executors.
    rows = docs.select("doc_id", "text").join(F.broadcast(few[0].union(few[1])), "doc_id").withColumn("_h", F.xxhash64("doc_id", "text"))
    # An id may repeat in docs: the bounds hold for rows, too. What is ranked is at most the rows of 4 * sample ids.
    best = [rows.filter(F.col("toxic") == c).orderBy("_h", "doc_id").limit(n) for c, n in ((0, 3 * sample), (1, sample))]
    upto = Window.partitionBy("toxic").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = best[0].union(best[1]).withColumn("_b", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)).filter(F.col("_b") <= sample_bytes)
    got = sorted((int(r["doc_id"]), int(r["toxic"]), r["text"] or "") for r in chosen.select("doc_id", "toxic", "text").toLocalIterator())
    return train([bag(t) for _, _, t in got], [c for _, c, _ in got])


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """``keep`` with a score (0 to 1) by the name ``into``, whose column in ``keep`` it replaces. Null, empty and
    wordless texts get the score of the model's base. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model.margins())  # BUCKETS numbers: fixed size

    def make():
        scorer = Scorer(*shared.value)
        return lambda texts: (scorer.scores(texts),)

    return map_texts(docs, [c for c in keep if c != into], text, f"`{into}` double", make)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
