"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

1. Every line (trimmed, lower-cased) gets a bottom-k signature: the least KEPT hashes of its character shingles. Lines
   of many words take the shingles that start a word, short ones (and lines with few blanks) all; lines in between are
   signed both ways, so two near lines always have a kind of signature in common.
2. Bands are runs of three neighbouring hashes of the sorted signature. Two sets share a band wherever three neighbours
   of their union's order belong to both, so bands need no fixed bins and are never empty. Long signatures keep a
   fourth of the runs, chosen by content, middle ones half; of up to RING hashes all runs are kept, the order taken as a
   ring, where sets of similarity 0.8 share one by counting.
3. A band that several lines share is a bucket. Each of its lines is paired with the least one; the pairs are verified
   by exact Jaccard similarity of the whole shingle sets (shingles at every position) and joined by union-find.
4. Any two lines of a bucket that these links leave in different parts are compared too. In a bucket of up to WHOLE
   lines every two blocks of lines meet in a row, by size and by bitmaps of their sets: where these differ in more bits
   than sets that are alike may have shingles apart, the pair is done with. A larger bucket, which grows with the table
   if it stands for a few common shingles, is parted by bands of a second signature, of other hashes of all shingles; of
   what it is parted into, up to WHOLE lines meet in the same way. Where more stay together (lines that have much in
   common, if less than 0.8), lines meet by rare shingles:
   if the shingles are put in one order, rare ones first, two sets that are alike share one among the first of both,
   at a place that leaves enough for the rest (prefix and position filter, exact). Shingles that the same lines hold
   are one. Lines next to each other by size are linked before, so fewer parts are left to meet.
   Of the pairs the likeliest of each line are verified first, by whole sets, then those still in different parts.
5. Distributed union-find over all links; of each component the first line (by doc_id, then position) stays.

Lines are written to the shared folder once, with their bands, and each step reads the columns that it needs. What
joins them is broadcast if a count shows at most ROWS_SENT rows, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, free_name, remove, small, table, written

SHINGLE, KEPT, RING, BLOCK, WHOLE = 8, 48, 24, 256, 64
#: Lines with at least STARTS shingles at word starts are signed by these, lines with fewer than EVERY by all shingles.
STARTS, EVERY = 14, 24
#: Longs of a line's bitmap (a power of two, 64 at most), pairs of a line that are tested before the others, and lines of a
#: shingle that a line is paired with beforehand.
WORDS, NEAREST, NEXT = 32, 8, 6
ROWS_SENT = 1_000_000
WHITE = " \t\r\n\x0b\x0c"


def _trimmed(line: Column) -> Column:
    edge = F.lit(False)
    for w in WHITE:  # trimming by a set of characters walks over the whole line; few lines need it
        edge = edge | F.startswith(line, F.lit(w)) | F.endswith(line, F.lit(w))
    return F.when(edge, F.btrim(line, F.lit(WHITE))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, ord, pos, lid, norm): the lines that are not blank, trimmed and lower-cased; doc is a hash of doc_id and text,
    lid of the line."""
    d = docs.where("text <> ''").select(F.xxhash64("doc_id", "text").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    full = d.select("doc", "ord", "pos", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    return full.select("doc", "ord", "pos", F.lower("line").alias("norm")).withColumn("lid", F.xxhash64("norm"))


def _bind(value: Column, f) -> Column:
    """f(value), with the value computed once (as the only element of an array) however often f uses it. Spark interprets
    what f and value do: sorts and set operations on arrays are several times faster in a column of their own."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _set(norm: Column) -> Column:
    """Distinct shingle hashes of a line; one shorter than a shingle is its own only shingle."""
    wide = 4 * SHINGLE  # with four bytes a character no shingle is searched for

    def every(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(b) - (wide - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(wide))))

    return F.array_distinct(F.when(F.length(norm) < SHINGLE, F.array(F.xxhash64(norm))).otherwise(_bind(F.encode(norm, "UTF-32"), every)))


def _bands(hashes: Column, mask: int = 3) -> Column:
    """Keys of the runs of three of a set's least hashes, which are given in order; of over KEPT hashes those runs whose
    first one has no bit of the mask."""

    def of(z: Column) -> Column:
        at = lambda j: F.get(z["w"], j)

        def run(x: Column, i: Column) -> Column:
            ring = F.when(z["ring"], F.xxhash64(x, at((i + 1) % z["n"]), at((i + 2) % z["n"])))
            return ring.when((x.bitwiseAND(z["thin"]) == 0) & (i + 2 < z["n"]), F.xxhash64(x, at(i + 1), at(i + 2)))

        return F.filter(F.transform(z["w"], run), lambda k: k.isNotNull())

    def shape(h: Column) -> Column:
        n = F.size(h)
        thin = F.when(n <= KEPT, 1).otherwise(mask).cast("long")
        return F.struct(F.slice(h, 1, KEPT).alias("w"), F.least(n, F.lit(KEPT)).alias("n"), thin.alias("thin"), (n <= RING).alias("ring"))

    return _bind(_bind(hashes, shape), of)


def signatures(docs: DataFrame) -> DataFrame:
    """The lines of docs: doc, ord, pos, lid, norm and keys, the line's bands."""
    starts = F.regexp_extract_all("norm", F.lit(rf"(?s)(?=(.{{1,{SHINGLE}}}))[^ \t]*[ \t]*"), F.lit(1))
    out = _lines(docs).withColumn("starts", F.sort_array(F.array_distinct(F.transform(starts, lambda x: F.xxhash64(x)))))
    out = out.withColumn("every", F.when(F.size("starts") < EVERY, F.sort_array(_set(F.col("norm")))))
    none = F.array().cast("array<long>")
    many, few = F.size("starts") >= STARTS, F.col("every").isNotNull()
    keys = F.concat(F.when(many, _bands(F.col("starts"))).otherwise(none), F.when(few, _bands(F.col("every"))).otherwise(none))
    return out.withColumn("keys", keys).drop("starts", "every")


def _may(x: Column, y: Column, percent: int) -> Column:
    """Whether the sizes of two shingle sets let them be alike."""
    return 100 * F.least(F.size(x), F.size(y)) >= percent * F.greatest(F.size(x), F.size(y))


def _alike(df: DataFrame, x: Column, y: Column, percent: int) -> DataFrame:
    """The rows of df (a, b, more) whose shingle sets x and y are alike, as (a, b); sizes decide first.

    The test stands in a generator: as a filter it would be pushed down to where the sets are made, once for each use.
    """
    near = _may(x, y, percent) & ((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y)))
    return df.select("a", "b", F.explode_outer(F.when(near, F.array(F.lit(1)))).alias("near")).where("near = 1").select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines (lid, norm) are alike."""
    side = lambda c: texts.select(F.col("lid").alias(c), F.col("norm").alias(f"norm_{c}"))
    tested = pairs.join(side("b"), "b").join(side("a"), "a").repartition("a", "b")
    sets = tested.select("a", "b", _set(F.col("norm_a")).alias("x"), _set(F.col("norm_b")).alias("y"))
    return cut(_alike(sets, F.col("x"), F.col("y"), percent))


def _sketched(texts: DataFrame) -> DataFrame:
    """(lid, size, w0, w1, ...) of lines (lid, norm): how many shingles a line's set has, and a bitmap of WORDS longs of them."""
    h, one = F.col("h"), F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.shiftrightunsigned("h", 16).bitwiseAND(F.lit(63)).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(h.bitwiseAND(F.lit(WORDS - 1)) == i, bit)), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)]
    return texts.select("lid", F.explode(_set(F.col("norm"))).alias("h")).groupBy("lid").agg(F.count("*").alias("size"), *words)


def _differ(x: Column, y: Column, words: int = WORDS) -> Column:
    """Bits in which the bitmaps of two lines differ: never more than the shingles that only one of their sets has."""
    out = F.lit(0)
    for i in range(words):  # plain fields: read from an array, they make a method of over 8,000 bytes, which Java doesn't compile
        out = out + F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"]))
    return out


def _candidates(meet: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, off) of lines (lid, part, size, bitmap) of two blocks of a cluster (a, b), or of one (b null), that are of
    different parts and can be alike by their sizes and bitmaps; off tells how far apart they seem by a quarter of the
    bits (all would make too long a method)."""
    each = meet.select(F.col("b").isNull().alias("own"), F.coalesce("b", "a").alias("b"), F.explode("a").alias("x")).select("own", "x", F.explode("b").alias("y"))
    x, y = F.col("x"), F.col("y")
    both = x["size"] + y["size"]
    each = each.where((~F.col("own") | (x["lid"] < y["lid"])) & (x["part"] != y["part"]) & (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])))
    each = each.where((100 + percent) * _differ(x, y) <= (100 - percent) * both)
    return each.select(F.least(x["lid"], y["lid"]).alias("a"), F.greatest(x["lid"], y["lid"]).alias("b"), (_differ(x, y, WORDS // 4) / both).alias("off"))


def _prefixes(lines: DataFrame, percent: int) -> DataFrame:
    """(atom, lid, part, size, before, w): the first atoms of lines (lid, comp, part, norm), to a (1 - percent/100)th of the set.

    Shingles that the same lines of a cluster hold are one atom of weight w. A line's shingles are in order: those of its
    part alone first, which no other part can share, then atoms from rare to frequent; before is how many stand before it.
    """
    shingles = lines.select("lid", "comp", "part", F.explode(_set(F.col("norm"))).alias("h")).select("lid", "part", F.xxhash64("comp", "h").alias("h"))
    held, each = Window.partitionBy("h"), Window.partitionBy("lid")
    shingles = shingles.select("lid", F.count("*").over(held).alias("n"), F.bit_xor(F.xxhash64("lid")).over(held).alias("who"), (F.min("part").over(held) < F.max("part").over(held)).alias("shared"))
    atoms = shingles.groupBy("lid", "shared", F.when(F.col("shared"), F.col("n")).alias("n"), F.when(F.col("shared"), F.xxhash64("n", "who")).alias("atom")).agg(F.count("*").alias("w"))
    order = each.orderBy("shared", "n", "atom").rowsBetween(Window.unboundedPreceding, -1)
    atoms = atoms.select("atom", "lid", "shared", "w", F.sum("w").over(each).alias("size"), F.coalesce(F.sum("w").over(order), F.lit(0)).alias("before"))
    first = F.col("shared") & (100 * (F.col("size") - F.col("before")) >= percent * F.col("size"))
    return atoms.where(first).drop("shared").join(lines.select("lid", "part"), "lid").select("atom", "lid", "part", "size", "before", "w")


def _enough(x: Column, y: Column, left_x: Column, left_y: Column, percent: int) -> Column:
    """Whether lines of x and y shingles, with these left from the first common one on, can still be alike."""
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * F.least(left_x, left_y) >= percent * (x + y))


def _neighbours(first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, off) of lines of different parts that are among the NEXT nearest by size of the lines of an atom."""
    by = Window.partitionBy("atom").orderBy("size", "lid")
    line = F.struct("lid", "part", "size", "before")
    near = first.select("*", F.array(*(F.lag(line, i).over(by) for i in range(1, NEXT + 1))).alias("others")).select("*", F.explode("others").alias("o"))
    near = near.where((F.col("part") != F.col("o.part")) & _enough(F.col("size"), F.col("o.size"), F.col("size") - F.col("before"), F.col("o.size") - F.col("o.before"), percent))
    return near.groupBy(F.least("lid", "o.lid").alias("a"), F.greatest("lid", "o.lid").alias("b")).agg((-F.sum(F.col("w") / (F.col("size") + F.col("o.size")))).alias("off"))


def _sharing(first: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, off) of lines of different parts that can be alike by an atom of both beginnings.

    The first atom that two lines share has all their common shingles from there on. So the smaller line has it among its
    first (100 - percent)/(100 + percent)th, the larger one where the sizes of the smaller, by classes, leave it enough.
    """
    step, n = 1.06, F.col("size")
    kind = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(step))).cast("int")
    fewest = F.ceil(percent * n / 100)
    low = first.where((100 + percent) * (n - F.col("before")) >= 2 * percent * n).select("atom", kind(n).alias("kind"), "w", *(F.col(c).alias(f"{c}_") for c in ("lid", "part", "size", "before")))
    high = first.select("atom", F.explode(F.sequence(kind(fewest), kind(n))).alias("kind"), "lid", "part", "size", "before")
    least = F.greatest(fewest, F.floor(F.pow(F.lit(step), F.col("kind")) * (1 - 1e-9)))
    high = high.where((100 + percent) * (n - F.col("before")) >= percent * (n + least))
    smaller = (F.col("size_") < n) | ((F.col("size_") == n) & (F.col("lid_") < F.col("lid")))
    met = low.join(high, ["atom", "kind"]).where(smaller & (F.col("part") != F.col("part_")) & _enough(n, F.col("size_"), n - F.col("before"), F.col("size_") - F.col("before_"), percent))
    return met.groupBy(F.least("lid", "lid_").alias("a"), F.greatest("lid", "lid_").alias("b")).agg((-F.sum(F.col("w") / (n + F.col("size_")))).alias("off"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, off), for each line the one of least off in each of NEAREST groups of the others."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("lid"), F.col("b").alias("other")), F.struct(F.col("b").alias("lid"), F.col("a").alias("other")))).alias("e"), "off", "a", "b")
    group = F.pmod(F.xxhash64("e.other"), F.lit(NEAREST))
    return ends.groupBy("e.lid", group.alias("group")).agg(F.min(F.struct("off", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _between(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (a, b, off): the likeliest are tested first, then all whose lines these leave apart."""
    sure = _verified(cut(_likeliest(pairs)), texts, percent)
    part = cut(components(sure))
    side = lambda c: part.select(F.col("node").alias(c), F.col("comp").alias(f"part_{c}"))
    rest = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    return sure.union(_verified(cut(rest.where(apart).select("a", "b").distinct()), texts, percent))


def _open(members: DataFrame, cluster: DataFrame, part: DataFrame) -> DataFrame:
    """(key, lid, comp, part, n): the lines of the buckets that hold several parts (a line without one is its own), with
    the bucket's number of lines. Of two lines the one pair has been tested."""
    of = cluster.join(part, "lid", "left").withColumn("part", F.coalesce("part", "lid"))
    several = [F.count("*").alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1")]
    size = of.groupBy("comp").agg(*several).where("n > 2 and p0 < p1")
    held = members.join(cut(of.join(size.select("comp"), "comp")), "lid")
    return held.join(held.groupBy("key").agg(*several).where("n > 2 and p0 < p1").select("key", "n"), "key").select("key", "lid", "comp", "part", "n")


def _blocks(lines: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, off) among the lines (key, lid, part, n) of a bucket, every two blocks of which meet in a row."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sketch = cut(_sketched(texts.join(lines.select("lid").distinct(), "lid")))
    at = lines.join(sketch, "lid").groupBy("key", blocks.alias("blocks"), F.pmod(F.xxhash64("lid"), blocks).cast("int").alias("block"))
    packed = cut(at.agg(F.collect_list(F.struct("lid", "part", "size", *(f"w{i}" for i in range(WORDS)))).alias("lines")))
    meet = packed.select("key", F.col("block").alias("lo"), F.col("lines").alias("a"), F.explode_outer(F.sequence("block", F.col("blocks") - 1)).alias("hi"))
    other = packed.select("key", F.col("block").alias("hi"), F.col("lines").alias("b"))
    alone = meet.where("lo = hi").withColumn("b", F.lit(None).cast(packed.schema["lines"].dataType)).select("key", "lo", "hi", "a", "b")
    meet = alone.union(meet.where("lo < hi").join(other, ["key", "hi"]).select("key", "lo", "hi", "a", "b"))
    return _candidates(meet.repartition("key", "lo", "hi"), percent).groupBy("a", "b").agg(F.min("off").alias("off"))


def _parted(many: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, lid, part, n) of the lines (key, lid, part) of large buckets, parted by a second signature; those alone or with
    lines of their part only are left out."""
    second = F.sort_array(F.transform(_set(F.col("norm")), lambda x: F.xxhash64(x, F.lit(1))))
    again = texts.join(many.select("lid").distinct(), "lid").select("lid", second.alias("second")).select("lid", F.explode(_bands(F.col("second"), 1)).alias("band"))
    again, out = cut(again.distinct()), None
    for half in ("band < 0", "band >= 0"):
        rows = many.join(again.where(half), "lid").select(F.xxhash64("key", "band").alias("key"), "lid", "part")
        size = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("key", "n"))
        found = cut(rows.join(small(size, ROWS_SENT), "key").select("key", "lid", "part", "n"))
        out = out.union(found) if out else found
    return out


def _once(held: DataFrame) -> DataFrame:
    """The rows of held (key, lid, part, n) without buckets of the same lines as another."""
    same = held.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("lid")).alias("x"), F.sum(F.shiftright("lid", 16)).alias("s"))
    return held.join(same.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _apart(members: DataFrame, cluster: DataFrame, part: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between lines of different parts (lid, part; a line without one is its own) of a bucket."""
    held = cut(_once(cut(_open(members, cluster, part).select("key", "lid", "part", "n"))))
    own = cut(texts.join(held.select("lid").distinct(), "lid"))
    few, many = held.where(f"n <= {WHOLE}"), held.where(f"n > {WHOLE}")
    if not many.limit(1).count():
        return _between(cut(_blocks(few, own, percent)), own, percent)
    parted = _parted(many, own)
    large = cut(own.join(parted.where(f"n > {WHOLE}").select("lid", "part").distinct(), "lid").withColumn("comp", F.lit(0)))
    few = few.union(_once(parted.where(f"n <= {WHOLE}")))
    # lines of `large` all meet by rare shingles: buckets of these alone need not be looked at again
    few = few.join(few.join(large, "lid", "left_anti").select("key").distinct(), "key", "left_semi")
    pairs = cut(_blocks(cut(few), own, percent))
    if not large.limit(1).count():
        return _between(pairs, own, percent)
    first = cut(_prefixes(large, percent))
    sure = _verified(cut(_likeliest(_neighbours(first, percent))), own, percent)
    joined = cut(components(sure.union(large.select(F.col("part").alias("a"), F.col("lid").alias("b")))))
    first = first.drop("part").join(joined.withColumnRenamed("node", "lid"), "lid", "left").withColumn("part", F.coalesce("comp", "lid"))
    return sure.union(_between(cut(pairs.union(_sharing(cut(first), percent)).groupBy("a", "b").agg(F.min("off").alias("off"))), own, percent))


def line_components(docs: DataFrame, percent: int = 80, lines: DataFrame | None = None) -> DataFrame:
    """(node, comp) of the distinct lines (ids) of docs that have a near line: exact Jaccard of character shingles >=
    percent/100. lines: signatures(docs), where they are at hand."""
    lines = cut(signatures(docs)) if lines is None else lines
    members = None
    for half in ("key < 0", "key >= 0"):  # one after the other, their shuffle files take half the disk
        spread = lines.select("lid", F.explode("keys").alias("key")).where(half)
        lead = cut(spread.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi")).where("lo < hi").select("key", "lo"))
        found = cut(spread.join(small(lead, ROWS_SENT), "key").distinct())
        members = members.union(found) if members else found
    pairs = cut(members.where("lid <> lo").select(F.col("lo").alias("a"), F.col("lid").alias("b")).distinct())
    cluster = cut(components(pairs).select(F.col("node").alias("lid"), "comp"))
    texts = lines.select("lid", "norm").join(small(cluster.select("lid"), ROWS_SENT), "lid")
    texts = cut(texts.groupBy("lid").agg(F.first("norm").alias("norm")))
    sure = _verified(pairs, texts, percent)
    part = components(sure).select(F.col("node").alias("lid"), F.col("comp").alias("part"))
    return components(sure.union(_apart(members.select("key", "lid"), cluster, part, texts, percent)))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, more) with a last struct column `lines`: text (what is left), n_lines, n_dropped.

    Of every component of near or equal lines over all documents the first occurrence stays (smallest doc_id, nulls
    last, then position in the text); all others go. Lines are parted by \\n and compared trimmed and lower-cased; blank
    lines stay and are not counted as dropped. A line shorter than a shingle is its own only shingle. A null text stays
    null and has no lines; an empty one has one blank line. Rows that agree in doc_id and text are one document and get
    the same result. Lines and texts of any length are compared whole. All columns stay as they are; the struct's name
    gets underscores on a clash. Empty table: no rows. Lines are told apart by 64-bit hashes.
    """
    lines, path = written(signatures(docs), compression="zstd")
    comp = cut(line_components(docs, percent, lines).withColumnRenamed("node", "lid"))
    occ = lines.select("doc", "ord", "pos", "lid").join(small(comp, ROWS_SENT), "lid", "left").select("doc", "ord", "pos", F.coalesce("comp", "lid").alias("comp"))
    # lines that occur once are done with; of the others the first occurrence stays
    many = cut(occ.groupBy("comp").agg(F.count("*").alias("c"), F.min("ord").alias("first")).where("c > 1").select("comp", "first"))
    occ = cut(occ.join(small(many, ROWS_SENT), "comp"))
    first = occ.where("ord = first").groupBy("comp").agg(F.min(F.struct("doc", "pos")).alias("at"))
    drop = occ.join(first, "comp").where(~((F.col("ord") == F.col("first")) & (F.col("doc") == F.col("at.doc")) & (F.col("pos") == F.col("at.pos"))))
    drop = cut(drop.groupBy("doc").agg(F.collect_set("pos").alias("gone")))
    remove(docs.sparkSession, path)
    light = drop.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= 10 * ROWS_SENT
    r = free_name(docs, "row")
    row = docs.select(F.struct("*").alias(r), F.when(F.col("text") != "", F.xxhash64("doc_id", "text")).alias("doc")).join(small(drop, ROWS_SENT) if light else drop, "doc", "left")
    whole = F.col(f"{r}.text")
    n = F.coalesce(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    left = _bind(F.split(whole, "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.col("gone").isNull(), whole).otherwise(left)
    made = F.struct(text.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    # the result before the star: an expanded column would take the place of one of the same name here
    name = free_name(docs, "lines")
    return row.select(r, made.alias(name)).select(f"{r}.*", name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.text")
