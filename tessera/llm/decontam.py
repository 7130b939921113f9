"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, capitalised words and units of measure are typed placeholders, all else is the
lower-cased word without surrounding punctuation. Windows of five template tokens of documents and benchmark items are
hash-joined; a window with fewer than three literal tokens is joined by its values instead of its placeholders, so only
as a copy. The values in the placeholders (slots) of an item must map to one value each in the document; windows that
break this mapping don't count. An item is found in a document if consistent windows cover 80 % of its tokens, with the
same values (a copy) or with others (the question re-parameterised).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, mix, slices, small, span_hashes, table, words_of

#: Up to this many benchmark windows go to the executors, which then send on only windows that can join; results don't
#: depend on it.
FILTER_WINDOWS = 1_000_000
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec ms min h hr hrs day days week weeks month months year years second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp km/h mph hz khz mhz ghz kb mb gb tb kwh w kw mw v a pa kpa bar k".split()

_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333))
#: Sets hashes of values apart from hashes of placeholders.
_RAW_WINDOW = np.uint64(0x5DEECE66D)
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(w.encode()) for w in words])))
    return span_hashes(buf, at[:-1], at[1:])


def templates(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template token hash, value hash in a slot or 0, first token of each text) of all texts at once."""
    start, end, first = words_of(buf, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    bare = np.concatenate(([0], np.cumsum(~_PUNCT[buf])))
    keep = bare[end] > bare[start]  # tokens of punctuation alone are no tokens
    first = np.concatenate(([0], np.cumsum(keep)))[first]
    start, end = start[keep], end[keep]
    while len(start) and (cut_ := _PUNCT[buf[start]]).any():
        start = start + cut_
    while len(start) and (cut_ := _PUNCT[buf[end - 1]]).any():
        end = end - cut_
    low = span_hashes(buf, start, end)
    raw = span_hashes(buf, start, end, fold=False)
    digits, lower, letters = (np.concatenate(([0], np.cumsum(m[buf]))) for m in (_DIGIT, _LOWER, ~_DIGIT & ~_PUNCT))
    span = lambda c: c[end] - c[start]
    number = (span(digits) > 0) & (span(letters) == 0)
    # upper-case letters are A-Z and, in UTF-8, C3 80 to C3 9E; a word all in capitals is a plain word
    head, second = buf[start], buf[np.minimum(start + 1, len(buf) - 1)]
    upper = _UPPER[head] | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = upper & ((span(lower) > 0) | (end - start <= 2)) & ~number
    unit = np.isin(low, _UNIT_HASHES) & ~number
    tok = np.where(number, _NUM, np.where(name, _NAME, np.where(unit, _UNIT, low)))
    return tok, np.where(number | name | unit, np.where(name, raw, low), np.uint64(0)), first


_UNIT_HASHES = np.sort(_hash_words(UNITS))


def windows(tok: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, enough literal tokens) of each window of `size` tokens; without enough, the hash is one of the slots' values."""
    n = len(tok) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, plain = np.full(n, size, np.uint64), np.zeros(n, int)
    for j in range(size):
        h = mix(h + tok[j : n + j])
        plain += slot[j : n + j] == 0
    enough = plain >= min(3, size)
    at = np.flatnonzero(~enough)
    raw = np.full(len(at), size, np.uint64) ^ _RAW_WINDOW
    for j in range(size):
        value = slot[at + j]
        raw = mix(raw + np.where(value == 0, tok[at + j], value))
    h[at] = raw
    return h, enough


def _emit(size: int, lengths: list[int], known: np.ndarray | None, ids: list[str], whole: bool = False):
    """Windows as rows: the id columns, w (hash), pos (token index), n (tokens), slots (value hashes, 0 for literals).

    whole: windows shorter than `size` are those of texts of as many tokens only.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for row0, buf, off in slices(b.column(len(ids))):
                tok, slot, first = templates(buf, off)
                of = np.repeat(np.arange(len(off) - 1), np.diff(first))
                count = np.diff(first)
                for w in lengths:
                    h, _ = windows(tok, slot, w)
                    if not len(h):
                        continue
                    inside = of[: len(h)] == of[w - 1 :]
                    ok = inside.copy()
                    if w != size and whole:
                        ok &= count[of[: len(h)]] == w
                    if known is not None:
                        ok &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    vals = np.stack([slot[at + j] for j in range(w)], 1)
                    cols[0].append(row0 + of[at])
                    cols[1].append(h[at].view(np.int64))
                    cols[2].append(at - first[of[at]])
                    cols[3].append(count[of[at]])
                    cols[4] += [v.tobytes() for v in vals]
            if cols[0]:
                take = pa.array(np.concatenate(cols[0]))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(ids))], *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:4]], pa.array(cols[4], pa.binary())], [*ids, "w", "pos", "n", "slots"])

    return run


def _coverage(n: int, hits: list[dict]) -> tuple[float, int, int]:
    """The share of an item's n tokens under consistent windows, its slot values, and how many of these changed."""
    shared = [(h["pos"], np.frombuffer(h["item_slots"], np.uint64).tolist(), np.frombuffer(h["slots"], np.uint64).tolist()) for h in hits]
    votes: dict[int, dict[int, int]] = {}
    for _, mine, theirs in shared:
        for x, y in zip(mine, theirs):
            if x:
                v = votes.setdefault(x, {})
                v[y] = v.get(y, 0) + 1
    chosen = {x: max(v, key=lambda y: (v[y], y == x, y)) for x, v in votes.items()}
    covered: set[int] = set()
    for p, mine, theirs in shared:
        if all(not x or chosen[x] == y for x, y in zip(mine, theirs)):
            covered.update(range(p, p + len(mine)))
    return len(covered) / n, len(chosen), sum(x != y for x, y in chosen.items())


def _decide(least: float):
    """Of documents and items that share windows those where consistent ones cover enough."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [_coverage(n, hits) for n, hits in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            ok = pa.array([m[0] >= least for m in made], pa.bool_())
            more = [pa.array([m[i] for m in made], t).filter(ok) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(i).filter(ok) for i in range(3)], *more], ["doc_id", "key", "item_id", "coverage", "slots", "changed"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item found in it: doc_id, key (hash of the text), item_id, coverage (0 to 1),
    slots (distinct slot values of the item), changed (how many of them have another value in the document).

    docs needs doc_id and text, benchmark item_id and text; further and clashing columns are not looked at. Windows have
    `size` template tokens; those with fewer than three literal ones are joined by their values, so that a dense stretch is
    found as a copy, not with other values. An item of fewer tokens is one window, of fewer than three tokens none (such
    an item can't be found). Null and empty texts hold nothing. Repeated rows of a document or item
    count once; equal texts under several ids are each reported. A null doc_id or item_id is an id like another.
    Whole texts of any length are searched. Empty tables: no rows.
    """
    if docs.schema["doc_id"].dataType.simpleString() == "void" or benchmark.schema["item_id"].dataType.simpleString() == "void":
        docs, benchmark = docs.withColumn("doc_id", F.col("doc_id").cast("long")), benchmark.withColumn("item_id", F.col("item_id").cast("long"))
    d_type, i_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.col("text"))
    shape = "w long, pos long, n long, slots binary"
    item_w = cut(map_arrow(items, _emit(size, list(range(3, size + 1)), None, ["item_id"], whole=True), f"item_id {i_type}, {shape}").dropDuplicates())
    n, known = item_w.count(), None
    if n <= FILTER_WINDOWS:
        known = np.sort(np.array([r[0] for r in item_w.select("w").distinct().collect()], np.int64).view(np.uint64))
    lengths = sorted({size, *[r[0] for r in item_w.where(F.col("n") < size).select("n").distinct().collect()]})
    text = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    if known is not None and not len(known):
        text, known = text.limit(0), None
    doc_w = map_arrow(text, _emit(size, lengths, known, ["doc_id", "key"]), f"doc_id {d_type}, key long, {shape}")
    doc_w = doc_w.select("doc_id", "key", "w", "slots").dropDuplicates()
    pairs = doc_w.join(small(item_w.select("item_id", "w", "pos", "n", F.col("slots").alias("item_slots"))), "w").drop("w")
    met = pairs.groupBy("doc_id", "key", "item_id").agg(F.max("n").alias("n"), F.collect_list(F.struct("pos", "slots", "item_slots")).alias("hits"))
    # a window covers `size` tokens at most: what is too few for the least coverage never reaches Python
    met = met.where(F.size("hits") * size >= least * F.col("n"))
    return map_arrow(met, _decide(least), f"doc_id {d_type}, key long, item_id {i_type}, coverage double, slots long, changed long")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "slots", "changed")
