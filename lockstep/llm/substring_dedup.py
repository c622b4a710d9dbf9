"""Substring dedup: content-defined chunks by a gear hash find where texts agree; repeats are cut to the word.

A text's words are cut into chunks at the words where a gear hash of the last few is least among its
neighbours. So boundaries follow from the words around them alone, an insertion shifts none but those beside
it, and two texts that share min_words words in a row share a whole chunk there. Chunks are deduplicated over
all texts by a digest of the chunk and a few words behind it, so short common phrases don't meet. Only near chunks that occur twice are grams of GRAM words compared: one that stands
in a document of a smaller id, or earlier in the same one, is a repeat. Grams that repeat at each word of
min_words words and more in a row are cut out, from the first of these words to the last; shorter runs are
common phrases and stay. Copies of a whole text are found by its hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_texts, quoted, table, written

#: Bytes of a word past which it is divided, and of a part of it at most; parts are 2 ** BITS bytes on average.
UNSPACED, LONGEST, BITS = 64, 1024, 3
#: Words that the gear hash reads, that a digest reads behind a chunk, of a gram, and of a run that is cut.
READ, LOOK, GRAM, MIN_WORDS = 4, 8, 16, 30


def gear_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


GEAR = gear_table()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the words of a text's UTF-8 bytes, each with the white space after it (the first with that
    before it, too), the last being its length. Words of more than UNSPACED bytes, as in scripts without
    spaces, are divided at characters where a gear hash of the 16 bytes before has its top bits zero: the
    parts stand for words and follow from the bytes around them alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if space[0]:
        begins = begins[1:]
    ends = np.append(begins, n)
    wide = np.add.reduceat(~space, np.append(0, begins), dtype=np.int64) > UNSPACED
    if wide.any():
        at = _marks(raw)
        at = at[~space[at]]
        ends = np.unique(np.append(ends, at[wide[np.searchsorted(ends, at, "right")]]))
    if np.diff(ends, prepend=0).max() > LONGEST:
        ends = _split_long(raw, ends)
    return ends


def _marks(raw: np.ndarray) -> np.ndarray:
    """Characters' begins, from the second on, at or next after the marks of the gear hash."""
    h = (GEAR >> np.uint64(20)).astype(np.uint16)[raw]
    # h[i] = sum of GEAR[byte i-j] << j over 16 bytes, by doubling.
    for span in (1, 2, 4, 8):
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint16(span))
    marks = np.flatnonzero(h >> np.uint16(16 - BITS) == 0) + 1
    begins = np.flatnonzero(raw & 0xC0 != 0x80)
    begins = begins[begins > 0]
    at = np.searchsorted(begins, marks)
    return np.unique(begins[at[at < len(begins)]])


def _split_long(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, start = [], 0
    for end in ends.tolist():
        while end - start > LONGEST:
            start += LONGEST
            while start < end and raw[start] & 0xC0 == 0x80:
                start += 1
            if start < end:
                out.append(start)
        out.append(end)
        start = end
    return np.array(out, np.int64)


def digests(data: bytes, ends: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the words, without white space around them, and of the k words from each on."""
    held = data.split()
    if len(held) != len(ends):
        held = [data[a:b].strip() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held))
    n = max(len(words) - k + 1, 0)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return words, (grams ^ (grams >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def chunks(words: np.ndarray, window: int, look: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, first words and ends (one past the last word that the digest reads) of a text's chunks, from the
    digests of its words; none for an empty text.

    The gear hash of a place adds up the table's entries for the words before it, shifted by their distance, so
    that READ words fill it. A chunk begins where the hash is the least of all in some window of places."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gear = GEAR[(words >> np.uint64(56)).astype(np.int64)]
    h = gear.copy()
    for j in range(1, READ):
        h[j:] += gear[:-j] << np.uint64(64 // READ * j)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    begins = np.zeros(1, np.int64)
    if n >= READ + window:
        # The hash up to a word decides on the place behind it.
        seen = np.lib.stride_tricks.sliding_window_view(h[READ - 1 : n - 1], window)
        begins = np.unique(np.append(seen.argmin(1) + np.arange(len(seen)) + READ, 0))
    ends = np.append(begins[1:], n)
    digest = np.add.reduceat(_placed(words, np.arange(n) - np.repeat(begins, ends - begins)), begins)
    for j in range(look):
        at = ends + j
        some = at < n
        digest[some] += _placed(words[at[some]], (at - begins)[some])
    return (digest ^ (digest >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15), begins, np.minimum(ends + look, n)


def _placed(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (words + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digests(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    data = _bytes(text)
    return digests(data, boundaries(data), k)


def measures(min_words: int) -> tuple[int, int]:
    """Places of a window and words that a digest reads behind a chunk, such that min_words words hold READ - 1 of
    them, two windows and what is read behind."""
    if min_words < READ + 1:
        raise ValueError(f"min_words is {READ + 1} at least")
    look = min(LOOK, (min_words - READ + 1) // 3)
    return (min_words - READ + 1 - look) // 2, look


def text_chunks(docs: DataFrame, keep: list[str], window: int, look: int, text: str = "text") -> DataFrame:
    """``keep`` with n_words and a text's chunks in order: digests, and spans as first word << 32 | end."""

    def make():
        def run(texts):
            words = [_digests(t, 1)[0] for t in texts]
            made = [chunks(w, window, look) for w in words]
            return [len(w) for w in words], [d.view(np.int64) for d, _, _ in made], [a << 32 | b for _, a, b in made]

        return run

    return map_texts(docs, keep, text, "n_words long, digests array<long>, spans array<long>", make)


def near(held: list[tuple[int, int]], window: int, k: int) -> list[tuple[int, int]]:
    """Stretches (first gram, one past the last) of all grams that a run around one of these chunks (first word,
    end) may hold: it begins READ - 1 words and a window before a chunk at most, and ends a
    window behind one."""
    out: list[list[int]] = []
    for first, past in sorted(held):
        a, b = max(first - window - READ + 1, 0), max(past + window - k + 1, 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def grams_near(text: str | None, stretches: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams in the stretches, and their places << 1, odd where one stands at an earlier place, too."""
    grams = _digests(text, k)[1]
    at = np.concatenate([np.arange(a, min(b, len(grams))) for a, b in stretches]).astype(np.int32)
    grams = grams[at]
    again = np.ones(len(grams), bool)
    again[np.unique(grams, return_index=True)[1]] = False
    return grams.view(np.int64), at << 1 | again


def runs(hits: list[tuple[int, int]], k: int, min_words: int) -> list[tuple[int, int, list[int]]]:
    """Runs (first word, one past the last, ids of first occurrences) of min_words words and more, from
    the repeated grams (place, id of the first occurrence)."""
    out, held = [], []
    for at, first in [*sorted(hits), (-1, 0)]:
        if held and at != held[-1][0] + 1:
            a, b, ids = held[0][0], held[-1][0] + k, {f for _, f in held}
            if b - a >= min_words:
                if out and a <= out[-1][1]:  # grams over the place where two passages meet are no repeats
                    a, _, more = out.pop()
                    ids |= set(more)
                out.append((a, b, sorted(ids)))
            held = []
        held.append((at, first))
    return out


#: Bytes of what may be sent to all executors.
SENT = 16 << 20


def _met(docs: DataFrame, found: DataFrame, items: Column, how: str) -> DataFrame:
    """``docs`` with what was found in each; ``found`` is sent to all executors where it is small: each row is
    counted with 48 bytes, each of its ``items`` with 24."""
    size = found.agg(F.sum(items * 24 + 48)).first()[0] or 0
    on = (docs["_id"] == found["_id"]) & docs["_hash"].eqNullSafe(found["_hash"])
    return docs.join(F.broadcast(found) if size <= SENT else found, on, how).drop(found["_id"], found["_hash"])


RUNS = "array<struct<a:int,b:int,ids:array<bigint>>>"


def repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _hash and _runs of the documents with repeats, from ``docs`` with _id, _hash and a text."""
    k, (window, look) = min(GRAM, min_words), measures(min_words)
    held = written(text_chunks(docs, ["_id", "_hash"], window, look, text), "chunks")
    # Copies of a whole text are one document from here on: of the least id. The others are cut as a whole.
    wholes = held.filter(F.col("n_words") >= min_words).groupBy("_hash").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
    wholes = written(wholes.select(F.col("_hash").alias("_h"), "_first"), "wholes")
    few = wholes.count() * 32 <= SENT
    others = F.broadcast(wholes) if few else wholes
    copy = (F.col("_hash") == F.col("_h")) & (F.col("_id") > F.col("_first"))
    copies = held.select("_id", "_hash", "n_words").join(others, copy).select(
        "_id", "_hash", F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b"), F.array("_first").alias("ids"))).cast(RUNS).alias("_runs")
    ).distinct()
    own = held.filter(F.col("n_words") >= min_words).join(others, copy, "left_anti")
    shared = own.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("_n")).filter("_n > 1").select("digest")
    spread = own.select("_id", "_hash", F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("spans").alias("span"))).alias("_c")).select("_id", "_hash", "_c.*")
    # A document's places are as many as its words at most.
    places = spread.join(shared, "digest").groupBy("_id", "_hash").agg(F.collect_set("span").alias("_held"))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def stretches_of(held: pd.Series) -> pd.Series:
        return pd.Series([[{"a": x, "b": y} for x, y in near([(v >> 32, v & 0xFFFFFFFF) for v in p.tolist()], window, k)] for p in held], dtype=object)

    stretches = written(places.select("_id", "_hash", stretches_of("_held").alias("_near")), "stretches")

    def compare():
        def run(texts, found):
            made = [grams_near(t, [(x["a"], x["b"]) for x in f], k) for t, f in zip(texts, found, strict=True)]
            return list(zip(*made, strict=True))

        return run

    asked = _met(docs, stretches, F.size("_near"), "inner")
    rows = written(map_texts(asked, ["_id", "_hash"], text, "grams array<long>, _at array<int>", compare, 1 << 20, ("_near",)), "grams")
    each = rows.select("_id", "_hash", F.explode(F.arrays_zip("grams", "_at")).alias("_g")).select("_id", "_hash", "_g.*")
    first = rows.select("_id", F.explode("grams").alias("grams")).groupBy("grams").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    hits = each.join(first.select("grams", "_first"), "grams").filter("_first < _id or _at % 2 = 1")
    # A document's repeats are as many as its words at most.
    marked = hits.groupBy("_id", "_hash").agg(F.collect_set(F.struct(F.shiftright("_at", 1).alias("_at"), "_first")).alias("_hits")).filter(F.size("_hits") >= min_words - k + 1)

    @F.pandas_udf(RUNS)
    def runs_of(places: pd.Series, firsts: pd.Series) -> pd.Series:
        found = (runs(list(zip(p.tolist(), f.tolist(), strict=True)), k, min_words) for p, f in zip(places, firsts, strict=True))
        return pd.Series([[{"a": a, "b": b, "ids": ids} for a, b, ids in x] for x in found], dtype=object)

    marked = marked.select("_id", "_hash", runs_of("_hits._at", "_hits._first").alias("_runs")).filter(F.size("_runs") > 0)
    return written(marked.unionByName(copies), "runs")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, into: tuple[str, str, str] = ("removed_spans", "removed_bytes", "first_ids")) -> DataFrame:
    """``docs`` with text cut, and three new columns: the byte ranges cut from the old text, their bytes, and the ids
    of the documents that hold the first occurrences of what was cut.

    First means in the least id, and there first in the text. Of documents that equal each other the one of
    least id stays whole and the others lose all (their text is empty then). Rows that share an id count as
    one document: between them nothing is a repeat, within each it is. Null ids come last and count as one
    document. Null texts stay null, with nothing removed. Texts of fewer than min_words words stay. Columns of
    ``docs`` by the new names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*into)
    last = F.lit((1 << 63) - 1)
    row = free_name(docs, "_row")
    ids = F.coalesce(quoted(id_col).cast("long"), last)
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias(row), quoted(text).alias("_value"), ids.alias("_id"), F.xxhash64(quoted(text)).alias("_hash"))
    marked = repeats(keyed.select("_id", "_hash", "_value"), "_value", min_words)
    met = _met(keyed, marked, F.size("_runs") + F.size(F.flatten("_runs.ids")), "left")

    def cut():
        return lambda texts, found: ([_cut_one(t, f) for t, f in zip(texts, found, strict=True)],)

    # Only documents with a run to cut pass through Python.
    made = "_cut struct<text:string,spans:array<struct<start:long,end:long>>,bytes:long,ids:array<long>>"
    some = F.col("_runs").isNotNull() & F.col("_value").isNotNull()
    done = map_texts(met.filter(some), [row], "_value", made, cut, also=("_runs",))
    cells = [F.col(row)[c].alias(c) for c in docs.columns]
    cut_rows = done.select(
        *[F.col("_cut.text").alias(text) if c == text else x for c, x in zip(docs.columns, cells, strict=True)], F.col("_cut.spans").alias(into[0]),
        F.col("_cut.bytes").alias(into[1]), F.transform("_cut.ids", lambda x: F.when(x != last, x)).alias(into[2]),
    )
    none = F.array()
    whole = met.filter(~some).select(
        *cells, none.cast("array<struct<start:long,end:long>>").alias(into[0]), F.lit(0).cast("long").alias(into[1]), none.cast("array<long>").alias(into[2])
    )
    return whole.unionByName(cut_rows)


def _cut_one(text: str, found: list[dict]) -> dict:
    data = _bytes(text)
    ends = [0, *boundaries(data).tolist()]
    kept, at, spans, ids = [], 0, [], set()
    for x in found:
        a, b = ends[x["a"]], ends[x["b"]]
        kept.append(data[at:a])
        spans.append({"start": a, "end": b})
        ids.update(int(i) for i in x["ids"])
        at = b
    kept.append(data[at:])
    return {"text": b"".join(kept).decode("utf-8", "replace"), "spans": spans, "bytes": sum(x["end"] - x["start"] for x in spans), "ids": sorted(ids)}


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs)


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL: dict[str, str] = {}
