"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit reads hashed character n-grams (1 to 3 letters).
A text goes to the language whose codeword has the least weighted logistic loss under the bit scores; bits that were
harder to learn weigh less. A small lead over the second-best codeword marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, mix, slices, table, with_fields

#: Hashed n-gram features.
DIM = 4096
#: Labelled documents that training takes at most (in expectation), shared evenly by the languages.
TRAIN_DOCS = 1600
#: What a language gets at least, so that training takes more in all where there are very many languages.
LEAST_DOCS = 40
#: Texts that are turned into features at a time.
ROWS = 256


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x32000)])


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM square-root n-gram shares, letters of each text)."""
    n = len(offsets) - 1
    data = buf.tobytes()
    texts = [data[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    long = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    alpha = _letters()[np.minimum(cp, 0x31FFF)]
    doc = np.repeat(np.arange(n, dtype=np.int64), long)
    letters = np.bincount(doc[alpha], minlength=n)
    c = np.where(alpha, cp, 32).astype(np.uint64)
    count = np.zeros(n * DIM, np.float32)
    h = np.zeros(len(c), np.uint64)
    for k in range(3):
        m = len(c) - k
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(31) + c[k:] + np.uint64(k + 1))
        ok = doc[:m] == doc[k:]
        ok &= alpha[:m] | alpha[k:]
        if k == 2:
            ok &= alpha[1 : m + 1]
        count += np.bincount(doc[:m][ok] * DIM + (h[ok] % np.uint64(DIM)).astype(np.int64), minlength=n * DIM).astype(np.float32)
    x = count.reshape(n, DIM)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)), letters


def _sliced(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, buf, off in slices(column):
        for a in range(0, len(off) - 1, ROWS):
            o = off[a : a + ROWS + 1]
            yield features(buf[o[0] : o[-1]], o - o[0])


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: every split of the languages for up to 6, else random columns with the best row distance."""
    if k == 1:  # one language: one bit, the same whatever is read
        return np.ones((1, 1))
    if k <= 6:
        cols = [c for c in product((-1, 1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.float64).T.reshape(k, -1)
    rng, bits = np.random.default_rng(3), 8 * int(np.ceil(np.log2(k)))
    draws = [np.where(rng.random((k, bits)) < 0.5, -1.0, 1.0) for _ in range(40)]
    return max(draws, key=lambda c: (bits - (c @ c.T))[~np.eye(k, dtype=bool)].min())


def fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 120) -> dict:
    """Logistic regression per bit (Adam, full batch); languages weigh the same whatever their number of rows."""
    code = codewords(k)
    goal = code[y]
    share = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y][:, None]
    share = (share / share.sum()).astype(np.float32)
    w, m, v = (np.zeros((x.shape[1] + 1, code.shape[1]), np.float32) for _ in range(3))
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    for t in range(1, rounds + 1):
        f = x @ w
        g = x.T @ (-goal * share / (1 + np.exp(np.clip(goal * f, -30, 30)))).astype(np.float32) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    right = ((x @ w) * goal > 0).mean(0) if len(x) else np.ones(code.shape[1])
    weight = np.maximum(right - 0.5, 0.01)
    return {"w": w, "code": code, "weight": weight / weight.mean() if len(weight) else weight}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its probability, the lead over the second) by loss-weighted decoding."""
    f = x @ model["w"][:-1] + model["w"][-1]
    code, weight = model["code"], model["weight"]
    loss = np.stack([(np.logaddexp(0, -f * c) * weight).mean(1) for c in code], 1)
    # a codeword's mean loss per bit, spread over the languages
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, 1)
    return loss.argmin(1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0.0)


def train(docs: DataFrame, use: Column, train_docs: int = TRAIN_DOCS) -> tuple[list[str], dict | None]:
    """Languages and model, learnt from text and lang of the rows of docs where `use` holds and lang is not null.

    The sample is bounded, in expectation, by train_docs, or LEAST_DOCS a language where that is more (drawn by a hash of
    doc_id and text). Every language that has a row is learnt.
    """
    known = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = known.groupBy("lang").count().orderBy("lang").collect()
    if not count:
        return [], None
    per = max(train_docs / len(count), LEAST_DOCS)
    rate = F.create_map(*[F.lit(x) for r in count for x in (r["lang"], min(1.0, per / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < rate[F.col("lang")]).select("lang", "text")

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for x, letters in _sliced(b.column(1)):
                keep = np.flatnonzero(letters)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + keep)), pa.array([x[i].astype(np.float16).tobytes() for i in keep], pa.binary())], ["lang", "x"])
                at += len(letters)

    got = sorted((r["lang"], bytes(r["x"])) for r in map_arrow(sample, rows, "lang string, x binary").collect())
    langs = sorted({g[0] for g in got})
    if not langs:
        return [], None
    x = np.frombuffer(b"".join(g[1] for g in got), np.float16).reshape(len(got), DIM).astype(np.float32)
    return langs, fit(x, np.array([langs.index(g[0]) for g in got]), len(langs))


def identify(docs: DataFrame, use: Column, keep: tuple[str, ...] = ("doc_id",), lead: float = 0.2, text_in: str | None = None) -> DataFrame:
    """One row per row of docs: the columns `keep`, lang_pred, score (0 to 1) and ambiguous.

    `use` marks the rows to learn from; docs needs doc_id, text and lang. Whole texts are read, of any length. A null or
    empty text or one without letters gets `und` with score 0 and is ambiguous; so does every text if no row can be
    learnt from. With one known language every other text gets it, score 1. Equal texts get equal results; ties go to
    the language that sorts first. text_in names a struct column of `keep` that holds the text, which then isn't sent
    twice. Clashing and further columns are not looked at. Empty table: no rows.
    """
    langs, model = train(docs, use)
    n = len(keep)
    at = keep.index(text_in) if text_in else None

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            best, score, gap, some = [], [], [], []
            for x, letters in _sliced(b.column(n) if at is None else b.column(at).field("text")):
                i, p, g = decode(model, x) if langs else (np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x)))
                best.append(i)
                score.append(p)
                gap.append(g)
                some.append((letters > 0) & bool(langs))
            if not best:
                continue
            some = np.concatenate(some)
            names = np.array([*langs, "und"], object)[np.where(some, np.concatenate(best), len(langs))]
            p, g = np.where(some, np.concatenate(score), 0.0), np.where(some, np.concatenate(gap), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(names, pa.string()), pa.array(p), pa.array(g < lead)], [*b.schema.names[:n], "lang_pred", "score", "ambiguous"])

    return map_arrow(docs.select(*keep, F.col("text").alias("text__")) if at is None else docs.select(*keep), predict, with_fields(docs, keep, "lang_pred string, score double, ambiguous boolean"))


def fold(k: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return identify(docs, fold(3) != 1).select("doc_id", held, "lang_pred", "score", "ambiguous")
