"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as two sums of trainable vectors: one for the word itself (hashed), one for its characters (hashed
n-grams of 3 to 5 bytes, the word's edges included). Texts are cut into overlapping windows of WINDOW words, STRIDE
apart, that cover every word. In each window the network reads the words in both directions, attention weighs the
states, and a logistic unit scores the weighted sum. A document's score is a logistic function of its highest and its
third-highest window: one word stands in two windows, so the third shows whether there is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, mix, slices, span_hashes, table, with_fields, words_of

WINDOW, STRIDE = 24, 12
#: Rows of the hashed tables of word and character vectors; their width; units of the network per direction.
WORD_ROWS, CHAR_ROWS, WIDTH, UNITS = 1 << 15, 1 << 15, 8, 6
#: Labelled documents that training takes at most of either label (in expectation), each of whole text.
TRAIN_PER_LABEL = 1000
#: Distinct words whose character vectors are summed at a time.
CHUNK = 32_768


# ---------------------------------------------------------------- inputs


def _trim(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the ASCII punctuation around them; one of punctuation alone keeps its first byte."""
    plain = np.ones(256, bool)
    plain[[i for i in range(33, 127) if not chr(i).isalnum()]] = False
    good = np.flatnonzero(plain[buf])
    if not len(good):
        return start, np.minimum(start + 1, end)
    a, b = np.searchsorted(good, start), np.searchsorted(good, end)
    some = b > a
    lo = np.where(some, good[np.minimum(a, len(good) - 1)], start)
    hi = np.where(some, good[np.maximum(b - 1, 0)] + 1, start + 1)
    return lo, hi


def words(buf: np.ndarray, offsets: np.ndarray):
    """(row of each word among the distinct ones, first word of each text, hashes of the distinct words, and as a pair of
    arrays their character table rows and how many of these each has)."""
    start, end, first = words_of(buf, offsets)
    start, end = _trim(buf, start, end)
    h = span_hashes(buf, start, end)
    _, at, code = np.unique(h, return_index=True, return_inverse=True)
    start, end, h = start[at], end[at], h[at]
    size = end - start
    # the bytes of the distinct words with a mark at both edges, then all n-grams of that
    total = size + 2
    base = np.concatenate(([0], np.cumsum(total)))
    owner = np.repeat(np.arange(len(size)), total)
    inside = np.arange(base[-1]) - base[owner]
    src = start[owner] + inside - 1
    edge = (inside == 0) | (inside == total[owner] - 1)
    low = buf[np.clip(src, 0, max(len(buf) - 1, 0))].astype(np.uint64) if len(buf) else np.zeros(0, np.uint64)
    low = np.where((low >= 65) & (low <= 90), low + np.uint64(32), low)
    ch = np.where(edge, np.uint64(1), low)
    rows, who = [], []
    x = np.zeros(len(ch), np.uint64)
    for n in range(1, 6):
        m = len(ch) - n + 1
        if m <= 0:
            break
        x = mix(x[:m] * np.uint64(257) + ch[n - 1 :] + np.uint64(n))
        if n >= 3:
            ok = owner[:m] == owner[n - 1 :]
            rows.append((x[ok] % np.uint64(CHAR_ROWS)).astype(np.int32))
            who.append(owner[:m][ok].astype(np.int32))
    rows, who = (np.concatenate(rows), np.concatenate(who)) if rows else (np.zeros(0, np.int32),) * 2
    return code, first, h, (rows[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(h)))


def window_index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) per window and each window's text: every word is in one or two; a text without words has one empty."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = first[of] + k * STRIDE
    return np.stack([start, np.minimum(WINDOW, first[of + 1] - start)], 1), of


# ---------------------------------------------------------------- the network


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"word": f(WORD_ROWS, WIDTH, scale=0.05), "char": f(CHAR_ROWS, WIDTH, scale=0.05), "att": f(2 * UNITS), "out": f(2 * UNITS), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(2 * WIDTH, 3 * UNITS), f"u{d}": f(UNITS, 3 * UNITS), f"b{d}": np.zeros(3 * UNITS, np.float32)}
    return p


def vectors(p: dict, h: np.ndarray, chars: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The input of each distinct word: its word vector beside the scaled sum of its character vectors."""
    out = np.zeros((max(len(h), 1), 2 * WIDTH), np.float32)
    for a in range(0, len(h), CHUNK):
        part = slice(a, a + CHUNK)
        out[part][: len(h[part]), :WIDTH] = p["word"][(h[part] % np.uint64(WORD_ROWS)).astype(np.int64)]
        n = count[part]
        at = np.cumsum(n) - n
        rows = chars[np.repeat(start[part] - at, n) + np.arange(n.sum())]
        if len(rows):
            some = n > 0
            out[part][: len(n)][some, WIDTH:] = np.add.reduceat(p["char"][rows], at[some], axis=0) / np.sqrt(n[some])[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, x: np.ndarray, idx: np.ndarray, n: np.ndarray, keep: bool = False):
    """Window scores (before the logistic) for inputs x[idx] of windows of n words; idx is padded with anything."""
    b, t = idx.shape
    live = np.arange(t)[None, :] < n[:, None]
    states, trace = [], []
    for d in "fb":
        table_ = x @ p[f"w{d}"] + p[f"b{d}"]
        h, hs, tr = np.zeros((b, UNITS), np.float32), np.zeros((t, b, UNITS), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = table_[idx[:, i]]
            hu = h @ p[f"u{d}"]
            zr = _sigmoid(g[:, : 2 * UNITS] + hu[:, : 2 * UNITS])
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            c = np.tanh(g[:, 2 * UNITS :] + r * hu[:, 2 * UNITS :])
            new = h + z * (c - h)
            new = np.where(live[:, i, None], new, h)
            if keep:
                tr.append((i, h, z, r, c, hu[:, 2 * UNITS :]))
            h = hs[i] = new
        states.append(hs)
        trace.append(tr)
    hs = np.concatenate(states, 2)
    e = np.where(live.T, np.tanh(hs) @ p["att"] * 4, -1e9)
    a = np.exp(e - e.max(0, keepdims=True))
    a *= live.T
    a /= np.maximum(a.sum(0, keepdims=True), 1e-9)
    pooled = np.einsum("tb,tbu->bu", a, hs)
    s = pooled @ p["out"] * 4 + p["bias"]
    return (s, (live, hs, a, pooled, trace)) if keep else s


def backward(p: dict, x: np.ndarray, idx: np.ndarray, kept, ds: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of x for ds, the gradient of the window scores."""
    live, hs, a, pooled, trace = kept
    g = {"bias": ds.sum(keepdims=True), "out": 4 * pooled.T @ ds}
    dp = 4 * ds[:, None] * p["out"]
    da = np.einsum("bu,tbu->tb", dp, hs)
    de = a * (da - (a * da).sum(0, keepdims=True))
    th = np.tanh(hs)
    g["att"] = 4 * np.einsum("tb,tbu->u", de, th)
    dhs = a[:, :, None] * dp + 4 * de[:, :, None] * p["att"] * (1 - th * th)
    dx = np.zeros_like(x)
    for d, part, tr in (("f", slice(0, UNITS), trace[0]), ("b", slice(UNITS, 2 * UNITS), trace[1])):
        dh = np.zeros((idx.shape[0], UNITS), np.float32)
        du, table_ = np.zeros_like(p[f"u{d}"]), np.zeros((len(x), 3 * UNITS), np.float32)
        for i, h, z, r, c, hu in reversed(tr):
            dh = dh + dhs[i][:, part]
            m = live[:, i, None]
            dn = dh * m
            dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
            dr = dc * hu * r * (1 - r)
            pre = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ pre
            dh = dh * ~m + dn * (1 - z) + pre @ p[f"u{d}"].T
            np.add.at(table_, idx[:, i], np.concatenate([dz, dr, dc], 1))
        g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = du, x.T @ table_, table_.sum(0)
        dx += table_ @ p[f"w{d}"].T
    return g, dx


def gather(code: np.ndarray, windows: np.ndarray) -> np.ndarray:
    at = windows[:, :1] + np.minimum(np.arange(WINDOW)[None, :], np.maximum(windows[:, 1:] - 1, 0))
    return code[np.minimum(at, max(len(code) - 1, 0))] if len(code) else np.zeros_like(at)


def score_texts(p: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's highest and third-highest window scores (its lowest if it has fewer)."""
    code, first, h, (chars, count) = words(buf, offsets)
    x = vectors(p, h, chars, np.cumsum(count) - count, count)
    win, of = window_index(first)
    s = np.empty(len(win), np.float32)
    for a in range(0, len(win), 2048):
        w = win[a : a + 2048]
        s[a : a + 2048] = forward(p, x, gather(code, w), w[:, 1])
    return best_windows(s, of, len(offsets) - 1)


def best_windows(s: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((-s, of))
    begin = np.searchsorted(of, np.arange(texts))
    last = np.append(begin[1:], len(of)) - 1
    return np.stack([s[order[begin]], s[order[np.minimum(begin + 2, last)]]], 1).astype(np.float64)


def chance(p: dict, best: np.ndarray) -> np.ndarray:
    """Document scores from best_windows."""
    return 1 / (1 + np.exp(-np.clip(best @ p["platt"][:2] + p["platt"][2], -30, 30)))


def _corpus(texts: list[bytes]):
    """(distinct word of each word, first word of each text, hashes, and chars, start, count: word w's character rows are
    chars[start[w]:start[w] + count[w]]) of all texts, taken a slice at a time."""
    import pyarrow as pa

    codes, firsts, hashes, chars, counts, words_, seen = [], [np.zeros(1, np.int64)], [], [], [], 0, 0
    for _, buf, off in slices(pa.array(texts, pa.large_binary()).view(pa.large_string())):
        code, first, h, (rows, count) = words(buf, off)
        codes.append(code + seen)
        firsts.append(first[1:] + words_)
        hashes.append(h)
        chars.append(rows)
        counts.append(count)
        words_, seen = words_ + len(code), seen + len(h)
    h, count = np.concatenate(hashes), np.concatenate(counts)
    start = np.cumsum(count) - count
    h, at, same = np.unique(h, return_index=True, return_inverse=True)
    return same[np.concatenate(codes)], np.concatenate(firsts), h, np.concatenate(chars), start[at], count[at]


def fit(texts: list[bytes], y: np.ndarray, toxic_share: float | None = None, rounds: int = 14, seed: int = 5) -> dict[str, np.ndarray]:
    """Training on whole documents by their highest windows (of a toxic one those must be high, of others all low).

    Word and character vectors start from how much more often they occur in toxic documents. toxic_share is the share of
    toxic documents where the model is to be used (that of the sample if not given).
    """
    rng = np.random.default_rng(seed)
    p = init(rng)
    if not len(texts) or len(set(y.tolist())) < 2:
        p["out"][:] = 0
        p["bias"][:] = 4.0 if len(y) and y[0] == 1 else -4.0
        p["platt"] = np.array([1.0, 0.0, 0.0])
        return p
    # a fifth of the documents is kept for the scaling of scores, if it holds enough of either label
    last = np.arange(len(y)) % 5 == 4
    held = (texts, y)
    if min((y[last] == 1).sum(), (y[last] == 0).sum()) >= 100:
        held, y = ([t for t, k in zip(texts, last) if k], y[last]), y[~last]
        texts = [t for t, k in zip(texts, last) if not k]
    code, first, h, chars, start, count = _corpus(texts)
    win, of = window_index(first)
    # document frequencies by label start the first column of either table
    wr = (h % np.uint64(WORD_ROWS)).astype(np.int64)
    freq = {"word": np.zeros((2, WORD_ROWS)), "char": np.zeros((2, CHAR_ROWS))}
    for i, t in enumerate(y.tolist()):
        w = np.unique(code[first[i] : first[i + 1]])
        freq["word"][t, np.unique(wr[w])] += 1
        n = count[w]
        freq["char"][t, np.unique(chars[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    for name, f in freq.items():
        ratio = np.log((f[1] + 0.3) / (y.sum() + 1)) - np.log((f[0] + 0.3) / (len(y) - y.sum() + 1))
        p[name][:, 0] += np.where(f.sum(0) >= 3, 0.5 * ratio, 0).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(v) for k, v in p.items()}
    begin = np.searchsorted(of, np.arange(len(texts)))

    def scores() -> np.ndarray:
        x = vectors(p, h, chars, start, count)
        return np.concatenate([forward(p, x, gather(code, win[a : a + 2048]), win[a : a + 2048, 1]) for a in range(0, len(win), 2048)])

    step = 0
    for turn in range(rounds):
        s = scores()
        # the two highest windows of each document stand for it in this round
        order = np.lexsort((-s, of))
        top = order[begin]
        second = order[np.minimum(begin + 1, np.append(begin[1:], len(of)) - 1)]
        pick = np.concatenate([top, second[y == 0]])
        label = np.concatenate([y, np.zeros((y == 0).sum(), y.dtype)])
        shuffled = rng.permutation(len(pick))
        for a in range(0, len(pick), 128):
            b = shuffled[a : a + 128]
            w = win[pick[b]]
            idx = gather(code, w)
            used, local = np.unique(idx, return_inverse=True)
            local = local.reshape(idx.shape)
            n = count[used]
            own = np.repeat(np.arange(len(used)), n)
            rows_c = chars[np.repeat(start[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            x = vectors(p, h[used], chars, start[used], n)
            s, kept = forward(p, x, local, w[:, 1], keep=True)
            weight = np.where(label[b] == 1, 0.5 / max((label == 1).mean(), 1e-6), 0.5 / max((label == 0).mean(), 1e-6))
            ds = ((_sigmoid(s) - label[b]) * weight / len(b)).astype(np.float32)
            g, dx = backward(p, x, local, kept, ds)
            for name, rows, grad in (("word", wr[used], dx[:, :WIDTH]), ("char", rows_c, (dx[:, WIDTH:] / np.sqrt(np.maximum(n, 1))[:, None])[own])):
                at, inv = np.unique(rows, return_inverse=True)
                sums = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(sums, inv, grad)
                v[name][at] += sums * sums
                p[name][at] -= 0.03 * sums / (np.sqrt(v[name][at]) + 1e-6)
            step += 1
            for k, gk in g.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    calibrate(p, held[0], held[1], y.mean() if toxic_share is None else toxic_share)
    return p


def calibrate(p: dict, texts: list[bytes], y: np.ndarray, share: float) -> None:
    """Platt scaling on the best windows of documents, weighted to the labels' true shares."""
    import pyarrow as pa

    x = np.concatenate([score_texts(p, buf, off) for _, buf, off in slices(pa.array(texts, pa.large_binary()).view(pa.large_string()))])
    mean, dev = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([(x - mean) / dev, np.ones((len(x), 1))])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(2000):
        w -= 0.5 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) / len(y) + 1e-4 * w)
    p["platt"] = np.append(w[:2] / dev, w[2] - (w[:2] * mean / dev).sum())


# ---------------------------------------------------------------- Spark


def train(docs: DataFrame, labels: DataFrame, use: Column, per_label: int = TRAIN_PER_LABEL) -> dict[str, np.ndarray]:
    """A model from labels (doc_id, toxic) and the texts of docs, of label rows where `use` holds."""
    known = labels.where(use & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    count = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, per_label / max(count.get(1, 0), 1))).otherwise(min(1.0, per_label / max(count.get(0, 0), 1)))
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # at most about 2 * per_label rows, so the broadcast is bounded
    chosen = known.where(draw < rate)
    got = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return fit([r["text"].encode() for r in got], np.array([r["toxic"] for r in got], np.int64), count.get(1, 0) / max(sum(count.values()), 1))


def scored(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and `score` (0 to 1, higher: likelier toxic) of each whole text.

    All overlapping windows of a text of any length are scored. Null and empty texts have one empty window, which gets
    the score of the bias. Equal texts get equal scores. Further and clashing columns are not looked at. Empty table:
    no rows.
    """
    n = len(keep)
    slim = {k: v.astype(np.float16) if k in ("word", "char") else v for k, v in model.items()}

    def run(batches) -> Iterator:
        import pyarrow as pa

        p = {k: v if k == "platt" else v.astype(np.float32) for k, v in slim.items()}
        for b in batches:
            if b.num_rows:
                s = chance(p, np.concatenate([score_texts(p, buf, off) for _, buf, off in slices(b.column(n))]))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(s)], [*b.schema.names[:n], "score"])

    return map_arrow(docs.select(*keep, F.col("text").alias("text__")), run, with_fields(docs, keep, "score double"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fold

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, fold(4) != 2)
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
