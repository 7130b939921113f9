"""Registry of the named queries over the driver's tables and of their SQL equivalents.

Every query runs an operator of this package over whole tables; the views that stand for symbols, edges, lines and
usage are in adapter.py. Limits are only those that belong to an operator (top-k reports).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, vec
from tessera.operators import graph, outline, quality, search, security
from tessera.plans import adapter
from tessera.plans.adapter import SYMBOLS_SQL, edges_sql, table
from tessera.streaming import usage as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "dead_symbols"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL equivalent if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


E35 = edges_sql(35)

# ---------------------------------------------------------------- graph


@query(E35)
def call_edges(spark, d):
    return adapter.call_edges(spark, d)


@query(f"""
WITH e AS ({E35}), s AS ({SYMBOLS_SQL}), refs AS (SELECT DISTINCT a.id AS src, a.file, b.name FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst),
c AS (SELECT refs.src, s.id, s.file = refs.file AS here, count(*) OVER (PARTITION BY refs.src, refs.name) AS n, sum(CASE WHEN s.file = refs.file THEN 1 ELSE 0 END) OVER (PARTITION BY refs.src, refs.name) AS n_here FROM refs JOIN s USING (name))
SELECT DISTINCT src, id AS dst FROM c WHERE ((n_here = 1 AND here) OR (n_here <> 1 AND n = 1)) AND src <> id
""")
def name_resolution(spark, d):
    s = adapter.symbols(spark, d)
    e = adapter.call_edges(spark, d)
    refs = e.join(s.select(F.col("id").alias("src"), "repo", "file"), "src").join(s.select(F.col("id").alias("dst"), "name"), "dst")
    return graph.resolve(refs, s).select("src", "dst")


@query(f"""
SELECT id, name, file, line FROM ({SYMBOLS_SQL}) s WHERE NOT EXISTS (SELECT 1 FROM ({E35}) e WHERE e.dst = s.id) ORDER BY id LIMIT 100
""")
def dead_symbols(spark, d):
    return quality.dead_code(adapter.symbols(spark, d), adapter.call_edges(spark, d)).select("id", "name", "file", "line")


@query(f"""
WITH e AS ({E35}), b AS (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e)
SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM b GROUP BY node
""")
def fan_in_out(spark, d):
    return graph.degrees(adapter.call_edges(spark, d))


def _bfs_sql(a: str, b: str, depth: int) -> str:
    return f"""
WITH RECURSIVE e AS ({E35}), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT e.{b}, r.depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE r.depth < {depth})
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0 ORDER BY depth, node LIMIT 500
"""


@query(_bfs_sql("dst", "src", 3))
def callers_depth3(spark, d):
    return graph.callers(adapter.call_edges(spark, d), 0, 3)


@query(_bfs_sql("src", "dst", 3))
def callees_depth3(spark, d):
    return graph.callees(adapter.call_edges(spark, d), 0, 3)


INHERIT = "SELECT p_partkey AS src, min(p_partkey) OVER (PARTITION BY p_name, p_type) AS dst FROM part"


@query(f"""
WITH RECURSIVE t AS (SELECT 0 AS pri, 'calls' AS rel, src, dst FROM ({E35}) UNION ALL SELECT 1, 'inherits', src, dst FROM ({INHERIT}) WHERE src <> dst),
r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT t.src, r.depth + 1 FROM r JOIN t ON t.dst = r.node WHERE r.depth < 3),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
b AS (SELECT x.node, x.depth, t.pri, t.rel, row_number() OVER (PARTITION BY x.node ORDER BY t.pri) AS n FROM m x JOIN t ON t.src = x.node JOIN m y ON y.node = t.dst AND y.depth = x.depth - 1 WHERE x.depth > 0)
SELECT node, CAST(depth AS INTEGER) AS depth, rel FROM b WHERE n = 1 ORDER BY depth, node LIMIT 500
""")
def impact_closure(spark, d):
    s = adapter.symbols(spark, d)
    first = s.groupBy("name", "language").agg(F.min("id").alias("dst"))
    inherits = s.join(first, ["name", "language"]).where("id <> dst").select(F.lit("inherits").alias("rel"), F.col("id").alias("src"), "dst")
    calls = adapter.call_edges(spark, d).select(F.lit("calls").alias("rel"), "src", "dst")
    return graph.impact(calls.unionByName(inherits), 0, 3)


@query(f"""
WITH RECURSIVE e AS ({E35}), r AS (SELECT [CAST(0 AS BIGINT)] AS path, CAST(0 AS BIGINT) AS last, 0 AS hops UNION ALL
  SELECT list_append(path, e.dst), e.dst, hops + 1 FROM r JOIN e ON e.src = r.last WHERE hops < 10 AND NOT list_contains(path, e.dst) AND last <> 1)
SELECT array_to_string(path, '>') AS path, CAST(hops AS INTEGER) AS hops FROM r WHERE last = 1 ORDER BY r.hops, r.path LIMIT 5
""")
def call_chains(spark, d):
    p = graph.paths(adapter.call_edges(spark, d), 0, 1)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E35}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
g AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS comp FROM r a JOIN r b ON a.dst = b.src AND a.src = b.dst WHERE a.src <> a.dst GROUP BY a.src)
SELECT comp, count(*) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM g GROUP BY comp
""")
def call_cycles(spark, d):
    c = graph.cycles(adapter.call_edges(spark, d))
    return c.select("comp", F.size("members").cast("long").alias("size"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def _pagerank_ctes(rounds: int) -> str:
    out = f"e AS ({E35}), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT p_partkey AS node, 1.0::DOUBLE AS rank FROM part)"
    for i in range(rounds):
        out += f", l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM o)), f{i} AS (SELECT e.dst AS node, sum(r.rank / o.n) AS got FROM e JOIN o USING (src) JOIN r{i} r ON r.node = e.src GROUP BY e.dst), r{i + 1} AS (SELECT r.node, 0.15 + 0.85 * (coalesce(f.got, 0) + l.lost / (SELECT count(*) FROM part)) AS rank FROM r{i} r LEFT JOIN f{i} f USING (node) CROSS JOIN l{i} l)"
    return out


@query(f"WITH {_pagerank_ctes(10)} SELECT node, round(rank, 4) AS rank FROM r10")
def pagerank_10(spark, d):
    s = adapter.symbols(spark, d)
    return graph.pagerank(s.select(F.col("id").alias("node")), adapter.call_edges(spark, d), rounds=10, tolerance=None).select("node", F.round("rank", 4).alias("rank"))


@query(f"""
WITH RECURSIVE {_pagerank_ctes(3)}, fi AS (SELECT dst AS id, count(*) AS fan_in FROM e GROUP BY dst), fo AS (SELECT src AS id, count(*) AS fan_out FROM e GROUP BY src),
t AS (SELECT p_partkey AS id, p_name AS name, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM part LEFT JOIN fi ON fi.id = p_partkey LEFT JOIN fo ON fo.id = p_partkey ORDER BY 3 DESC, 1 LIMIT 200),
c AS (SELECT id AS root, id AS node, 0 AS depth FROM t UNION SELECT c.root, e.src, c.depth + 1 FROM c JOIN e ON e.dst = c.node WHERE c.depth < 3),
i AS (SELECT root AS id, count(DISTINCT node) - 1 AS impact_size FROM c GROUP BY root)
SELECT t.id, t.name, t.fan_in, t.fan_out, i.impact_size, round(r.rank, 4) AS rank FROM t JOIN i USING (id) JOIN r3 r ON r.node = t.id ORDER BY round(r.rank, 4) DESC, t.fan_in DESC, t.id LIMIT 20
""")
def key_symbols(spark, d):
    """The reduced form, with ranks after three rounds, which SQL can follow; key_symbols_settled has the operator's defaults."""
    out = quality.key_symbols(adapter.symbols(spark, d), adapter.call_edges(spark, d), rounds=3)
    return out.select("id", "name", "fan_in", "fan_out", "impact_size", "rank")


@query()
def key_symbols_settled(spark, d):
    """Ranks until they move by less than the tolerance: when that is, SQL can't tell (tests compare with plain loops)."""
    out = quality.key_symbols(adapter.symbols(spark, d), adapter.call_edges(spark, d))
    return out.select("id", "name", "fan_in", "fan_out", "impact_size", "rank")


@query(f"""
WITH e AS ({E35}), fi AS (SELECT dst AS id, count(*) AS fan_in FROM e GROUP BY dst), s AS (SELECT s.*, coalesce(fan_in, 0) AS fan_in FROM ({SYMBOLS_SQL}) s LEFT JOIN fi USING (id)),
b AS (SELECT min(cognitive) a0, max(cognitive) a1, min(cyclomatic) b0, max(cyclomatic) b1, min(fan_in) c0, max(fan_in) c1, min(max_nesting) d0, max(max_nesting) d1 FROM s)
SELECT id, file, CAST(round(CAST(0.4::DOUBLE * ((cognitive - a0) / (a1 - a0)::DOUBLE) + 0.3::DOUBLE * ((cyclomatic - b0) / (b1 - b0)::DOUBLE) + 0.2::DOUBLE * ((fan_in - c0) / (c1 - c0)::DOUBLE) + 0.1::DOUBLE * ((max_nesting - d0) / (d1 - d0)::DOUBLE) AS DECIMAL(18, 14)), 3) AS DOUBLE) AS risk_score
FROM s, b ORDER BY 3 DESC, 1 LIMIT 20
""")
def risk_hotspots(spark, d):
    return quality.hotspots(adapter.symbols(spark, d), adapter.call_edges(spark, d)).select("id", "file", "risk_score")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E35}), s AS (SELECT p_partkey AS id FROM part WHERE p_size = 1), k AS (SELECT p_partkey AS id FROM part WHERE p_size = 50),
r AS (SELECT id AS root, id AS node, 0 AS depth FROM s UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 10)
SELECT root AS source, node AS sink, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN k ON k.id = r.node GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20
""")
def taint_pairs(spark, d):
    s = adapter.symbols(spark, d)
    return security.taint_pairs(adapter.call_edges(spark, d), s.where("line = 1").select("id", "ord"), s.where("line = 50").select("id"), 10)


# ---------------------------------------------------------------- outlines

PATHS = "SELECT DISTINCT regexp_replace(p, '[?#].*$', '') AS file, regexp_extract(p, '^[^/]+/([a-z]{2})/', 1) AS language FROM (SELECT regexp_replace(url, '^https?://', '') AS p FROM pages)"


@query(f"""
WITH f AS ({PATHS})
SELECT 'directory' AS section, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '(root)' END AS key, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'kind', 'function', count(*) FROM part GROUP BY ALL
""")
def repo_outline(spark, d):
    return outline.repo_outline(adapter.page_paths(spark, d), adapter.symbols(spark, d))


@query(f"""
WITH f AS (SELECT file, min(language) AS language FROM ({PATHS}) GROUP BY file), p AS (SELECT file, string_split(file, '/') AS s FROM f),
u AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(generate_series(1, len(s) - 1)) AS i FROM p))
SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '[^/]*$') AS name, CAST(len(string_split(path, '/')) AS INTEGER) AS depth, 'dir' AS type FROM u
UNION ALL SELECT file, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END, regexp_extract(file, '[^/]*$'), CAST(len(string_split(file, '/')) AS INTEGER), 'file' FROM f
""")
def file_tree(spark, d):
    files = adapter.page_paths(spark, d).groupBy("repo", "file").agg(F.min("language").alias("language"))
    return outline.file_tree(files, adapter.symbols(spark, d)).select("path", "parent", "name", "depth", "type")


@query("""
SELECT a.conv_id, a.turn, count(b.turn) AS siblings, coalesce(min(b.turn), -1) AS first_sibling FROM conversations a LEFT JOIN conversations b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.role IS NOT DISTINCT FROM b.role AND a.turn <> b.turn GROUP BY a.conv_id, a.turn
""")
def siblings_context(spark, d):
    rows = outline.sibling_counts(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn")
    return rows.groupBy("conv_id", "turn").agg(F.sum("siblings").alias("siblings"), F.coalesce(F.min("first_sibling"), F.lit(-1)).alias("first_sibling"))


@query(f"""
WITH s AS (SELECT *, language AS parent FROM ({SYMBOLS_SQL})), e AS ({E35}), t AS (SELECT * FROM s WHERE id = 7)
SELECT 'symbol' AS role, id, name, file, line FROM t
UNION ALL SELECT 'sibling', s.id, s.name, s.file, s.line FROM s JOIN t ON s.file = t.file AND s.parent = t.parent AND s.id <> t.id
UNION ALL SELECT 'caller', s.id, s.name, s.file, s.line FROM s WHERE id IN (SELECT src FROM e WHERE dst = 7 ORDER BY src LIMIT 20)
UNION ALL SELECT 'callee', s.id, s.name, s.file, s.line FROM s WHERE id IN (SELECT dst FROM e WHERE src = 7 ORDER BY dst LIMIT 20)
""")
def symbol_context(spark, d):
    s = adapter.symbols(spark, d).withColumn("parent", F.col("language"))
    out = outline.context(s.withColumn("parent", F.hash("parent").cast("long") - (1 << 40)), 7, adapter.call_edges(spark, d).withColumn("rel", F.lit("calls")))
    return out.select("role", "id", "name", "file", "line")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0),
up AS (SELECT CAST(40 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM up JOIN e ON e.src = up.node),
down AS (SELECT CAST(40 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM down JOIN e ON e.dst = down.node)
SELECT 'ancestor' AS direction, node, depth FROM up WHERE depth > 0 UNION ALL SELECT 'descendant', node, depth FROM down WHERE depth > 0
""")
def type_tree(spark, d):
    """A type's ancestors and descendants where part n inherits from part n / 3."""
    s = adapter.symbols(spark, d)
    e = s.where("id > 0").select(F.lit("inherits").alias("rel"), F.col("id").alias("src"), F.floor(F.col("id") / 3).cast("long").alias("dst"))
    return outline.type_hierarchy(e, s.withColumn("name", F.col("id").cast("string")), 40).select("direction", F.col("node").cast("long").alias("node"), "depth")


IMPORTS = "SELECT DISTINCT p_brand AS file, 'Brand#' || p_size AS module FROM part"


def _imports(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("module")).distinct()


@query(f"SELECT file, min(module) AS module FROM ({IMPORTS}) WHERE module = 'Brand#12' AND file <> 'Brand#12' GROUP BY file")
def importers(spark, d):
    return outline.importers_of(_imports(spark, d), "Brand#12")


@query(f"SELECT module, CASE WHEN module IN (SELECT p_brand FROM part) THEN module ELSE '' END AS candidates FROM ({IMPORTS}) WHERE file = 'Brand#12'")
def imports_with_candidates(spark, d):
    i = _imports(spark, d)
    return outline.imports_of(i, i.select("file").distinct(), "Brand#12").select("module", F.array_join("candidates", ",").alias("candidates"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS source, true AS content_verified FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
def symbol_sources(spark, d):
    """Each document as one symbol that spans its file: read by byte range and held against its hash."""
    c = adapter.documents(spark, d).where("content is not null and file is not null").select(F.coalesce("repo", F.lit("-")).alias("repo"), "file", F.col("content").cast("binary").alias("content"))
    s = c.select("repo", "file", F.col("file").alias("id"), F.lit(0).cast("long").alias("byte_offset"), F.octet_length("content").cast("long").alias("byte_length"), F.sha2("content", 256).alias("content_hash"), F.lit(1).alias("line"), F.lit(1).alias("end_line"))
    return outline.with_source(s, c, 0, True).select("id", "source", "content_verified")


# ---------------------------------------------------------------- search

LINES = "SELECT source AS repo, CAST(doc_id AS VARCHAR) AS file, doc_id AS ord, generate_subscripts(s, 1) AS line, unnest(s) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS s FROM documents)"


@query(f"SELECT file, line, text FROM ({LINES}) WHERE contains(lower(text), 'license') ORDER BY ord, line LIMIT 20")
def text_search(spark, d):
    rows = search.lines(adapter.documents(spark, d), redacted=False)
    return search.text_search(rows, "LICENSE").select("file", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT repo, file, line FROM ({LINES}) WHERE contains(lower(text), 'license') AND repo IN ('src3', 'src1') ORDER BY CASE repo WHEN 'src3' THEN 0 ELSE 1 END, ord, line LIMIT 20")
def cross_source_search(spark, d):
    rows = search.lines(adapter.documents(spark, d), redacted=False)
    return search.text_search(rows, "license", ["src3", "src1"]).select("repo", "file", F.col("line").cast("long").alias("line"))


@query(f"SELECT file, line, regexp_replace(text, '{text.SECRET.replace(chr(39), chr(39) * 2)}', '<REDACTED>', 'g') AS text FROM ({LINES}) WHERE text <> regexp_replace(text, '{text.SECRET.replace(chr(39), chr(39) * 2)}', '<REDACTED>', 'g')")
def redacted_lines(spark, d):
    held = adapter.documents(spark, d).where(F.col("content").rlike(text.SECRET))  # few documents have any
    rows = search.lines(held, redacted=False).withColumn("clean", text.redact_secrets("text"))
    return rows.where("clean <> text").select("file", F.col("line").cast("long").alias("line"), F.col("clean").alias("text"))


@query(f"""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS file, l_linenumber * 7 AS line FROM lineitem JOIN part ON p_partkey = l_partkey), s AS ({SYMBOLS_SQL}),
g AS (SELECT DISTINCT file, line FROM h),
b AS (SELECT g.file, g.line, s.id, s.name, row_number() OVER (PARTITION BY g.file, g.line ORDER BY s.end_line - s.line, s.id) AS n FROM g LEFT JOIN s ON s.file = g.file AND g.line BETWEEN s.line AND s.end_line AND s.line > 0)
SELECT file, CAST(line AS INTEGER) AS line, id AS symbol_id, name AS symbol_name FROM b WHERE n = 1
""")
def references_enclosing(spark, d):
    s = adapter.symbols(spark, d)
    hits = table(spark, d, "lineitem").join(s.select(F.col("id").alias("l_partkey"), "repo", "file"), "l_partkey").select("repo", "file", (F.col("l_linenumber") * 7).alias("line")).distinct()
    return search.enclosing(hits, s, ["repo", "file", "line"]).select("file", "line", F.col("symbol.id").alias("symbol_id"), F.col("symbol.name").alias("symbol_name"))


@query(f"""
WITH h AS (SELECT p_brand AS file, CAST(l_linenumber * 5 AS INTEGER) AS a, CAST(l_linenumber * 5 + 3 AS INTEGER) AS b, min(l_orderkey) AS o FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY ALL), s AS ({SYMBOLS_SQL}),
m AS (SELECT s.id, s.name, s.file, min((h.o, s.id)) AS place FROM s JOIN h ON h.file = s.file AND h.a <= s.end_line AND h.b >= s.line GROUP BY ALL)
SELECT id, name, file FROM m ORDER BY place LIMIT 100
""")
def change_overlap(spark, d):
    s = adapter.symbols(spark, d)
    h = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(s.select(F.col("id").alias("l_partkey"), "repo", "file"), "l_partkey")
    h = h.groupBy("repo", "file", (F.col("l_linenumber") * 5).alias("start")).agg(F.min("l_orderkey").alias("hunk_ord")).withColumn("end", F.col("start") + 3)
    return search.changed_symbols(s, h).select("id", "name", "file")


def _stem_sql(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) >= {len(s) + 3} THEN {x}[1:length({x}) - {len(s)}] || '{n}'" for s, n in text.STEM_RULES)
    return f"(CASE WHEN length({x}) <= 3 THEN {x} {cases} ELSE {x} END)"


def _keyword_sql(q: str) -> str:
    ws = list(dict.fromkeys(q.lower().split()))
    stems = "[" + ", ".join(f"'{text.stem_word(w)}'" for w in dict.fromkeys(ws)) + "]"
    have = lambda c, w, n: f"(CASE WHEN contains(lower({c}), '{w}') THEN {n} ELSE 0 END)"
    shared = lambda c, split: f"len(list_intersect(list_distinct({stems}), list_distinct(list_transform(list_filter(regexp_split_to_array(lower({c}), '{split}'), lambda w: w <> ''), lambda w: {_stem_sql('w')}))))"
    parts = [f"(CASE WHEN lower(name) = '{q}' THEN 20 WHEN contains(lower(name), '{q}') THEN 10 ELSE 0 END)", have("signature", q, 8), have("summary", q, 5)]
    parts += [have("name", w, 5) for w in ws] + [have("signature", w, 2) for w in ws] + [have("summary", w, 1) for w in ws]
    return " + ".join([*parts, shared("name", r"[_\-\s]+") + " * 4", shared("signature", r"[_\-\s]+"), shared("summary", r"\s+") + " * 2"])


@query(f"SELECT id, name, CAST(score AS INTEGER) AS score FROM (SELECT id, name, {_keyword_sql('small rings')} AS score FROM (SELECT p_partkey AS id, p_name AS name, p_type AS signature, p_brand AS summary FROM part)) WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def keyword_search(spark, d):
    return search.keyword_search(adapter.symbols(spark, d), "small rings", k=50).select("id", "name", F.col("score").cast("int").alias("score"))


_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT v.vec_id AS id, round({_COS}, 4) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE {_COS} > 0.1 ORDER BY {_COS} DESC, v.vec_id LIMIT 10")
def semantic_search(spark, d):
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").first()["embedding"]
    rows = v.select(F.col("vec_id").alias("id"), vec.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("s"))
    return rows.where("s > 0.1").orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 4).alias("similarity"))


@query(f"SELECT v.vec_id AS id, round(least(v.label * 5 / 40.0, 1.0) * 0.3 + {_COS} * 0.7, 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE NOT ({_COS} < 0.1 AND v.label <= 0) ORDER BY least(v.label * 5 / 40.0, 1.0) * 0.3 + {_COS} * 0.7 DESC, v.vec_id LIMIT 10")
def hybrid_search(spark, d):
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").first()["embedding"]
    rows = v.select(F.col("vec_id").alias("id"), "label", vec.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("s")).where("not (s < 0.1 and label <= 0)")
    return rows.withColumn("h", vec.hybrid(F.col("label") * 5, F.col("s"), 0.7)).orderBy(F.desc("h"), "id").limit(10).select("id", F.round("h", 4).alias("score"))


# ---------------------------------------------------------------- quality, supply chain, usage

LICENSE = "(Apache License, Version 2.0|MIT License|GNU General Public License|CC BY-NC 4.0)"


@query(f"""
SELECT license, CASE WHEN license IN ('Apache License, Version 2.0', 'MIT License') THEN 'permissive' ELSE 'unknown' END AS classification, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{LICENSE}', 1)) AS license FROM documents) GROUP BY ALL
""")
def license_classes(spark, d):
    x = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(LICENSE), F.lit(1))).alias("license"))
    return x.groupBy("license", text.classify_license("license").alias("classification")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT o_orderkey AS id, sha256(CAST(o_custkey AS VARCHAR)) AS h FROM orders WHERE o_orderstatus <> 'P'),
h AS (SELECT o_orderkey AS id, sha256(CAST(CASE WHEN o_orderstatus = 'O' THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR)) AS h FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.h = h.h THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN h ON b.id = h.id
""")
def compare_snapshots(spark, d):
    o = table(spark, d, "orders")
    row = lambda df, key: df.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("order").alias("kind"), F.lit("orders").alias("file"), F.col("o_orderstatus").alias("signature"), F.sha2(key.cast("string"), 256).alias("content_hash"), F.col("o_orderkey").alias("ord"))
    changed = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return quality.compare(row(o.where("o_orderstatus <> 'P'"), F.col("o_custkey")), row(o.where("o_orderpriority <> '5-LOW'"), changed)).select("id", "status")


@query(f"""
WITH s AS ({SYMBOLS_SQL}), disk AS (SELECT DISTINCT 'Brand#' || (c_nationkey + 1) AS file, 'x' AS c FROM customer), f AS (SELECT DISTINCT file FROM s),
a AS (SELECT 'orphaned_symbol' AS type FROM s WHERE file NOT IN (SELECT file FROM disk)
UNION ALL SELECT 'orphaned_content' FROM disk WHERE file NOT IN (SELECT file FROM f)
UNION ALL SELECT 'duplicate_symbol' FROM (SELECT file, name FROM s GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'call_graph_broken_ref' FROM s WHERE name NOT IN (SELECT CAST(id AS VARCHAR) FROM s)
UNION ALL SELECT 'file_hash_mismatch' FROM f)
SELECT type, count(*) AS n FROM a GROUP BY type
""")
def lint_index(spark, d):
    s = adapter.symbols(spark, d).withColumn("id", F.col("id").cast("string")).withColumn("calls", F.array("name"))
    files = s.select("file").distinct().withColumn("sha256", F.sha2(F.lit(b"y"), 256))
    disk = table(spark, d, "customer").select(F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("file")).distinct().withColumn("content", F.lit(b"x"))
    return quality.lint(s, files, disk).groupBy("type").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT p_brand AS file, 'Brand#' || p_size AS module FROM part), f AS (SELECT DISTINCT p_brand AS file FROM part)
SELECT module, count(DISTINCT i.file) AS import_count, string_agg(DISTINCT i.file, ',' ORDER BY i.file) AS imported_by, module IN (SELECT file FROM f) AS internal FROM i GROUP BY module
""")
def dependencies_split(spark, d):
    p = table(spark, d, "part")
    i = p.select(F.lit("parts").alias("repo"), F.col("p_brand").alias("file"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("module"))
    return quality.dependencies(i, i.select("repo", "file").distinct()).withColumn("imported_by", F.array_join("imported_by", ","))


RULES = [("R1", "high", ["track", "script"], []), ("R2", "low", ["nav"], ["footer"]), ("R3", "critical", ["iframe", "eval"], []), ("R4", "medium", ["article"], ["idiot", "article"])]


@query(f"""
WITH t AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(html), '[^a-z]+'), lambda w: w <> '')) AS w FROM pages),
r(rule_id, severity, calls_any, imports_any) AS (VALUES {", ".join(f"('{i}', '{s}', {c}, {m or '[]::VARCHAR[]'})" for i, s, c, m in RULES)})
SELECT page_id, rule_id, severity FROM t, r WHERE list_has_any(w, calls_any) AND (len(imports_any) = 0 OR list_has_any(w, imports_any))
""")
def rule_scan(spark, d):
    p = table(spark, d, "pages")
    w = F.array_distinct(F.filter(F.split(F.lower("html"), "[^a-z]+"), lambda x: x != ""))
    s = p.select(F.lit("web").alias("repo"), F.col("page_id").alias("id"), w.alias("calls"), w.alias("imports"), F.lit("html").alias("language"))
    rules = spark.createDataFrame([(i, sev, "high", [], c, m) for i, sev, c, m in RULES], "rule_id string, severity string, confidence string, languages array<string>, calls_any array<string>, imports_any array<string>")
    return security.match_rules(s, rules).select(F.col("id").alias("page_id"), "rule_id", "severity")


@query("SELECT event_type AS tool_name, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 1) AS avg_ms FROM events GROUP BY 1")
def usage_stats(spark, d):
    return quality.usage_stats(adapter.usage(spark, d))


@query("SELECT event_type AS tool_name, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def usage_window(spark, d):
    return streaming.usage_windows(adapter.usage(spark, d), "1 day").select("tool_name", F.col("start").cast("timestamp_ntz").alias("day"), "calls", "errors")


@query()
def rate_limited_calls(spark, d):
    """Which events the limiter lets through; a denied call frees the next ones, which SQL windows can't say."""
    calls = table(spark, d, "events").select(F.col("event_type").alias("tool_name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("call_id"))
    return streaming.limited(calls).select("tool_name", "call_id", "allowed")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS first_call, max(ts) AS last_call, count(*) AS calls FROM s GROUP BY user_id, s
""")
def sessionised_usage(spark, d):
    u = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return u.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.min("ts").alias("first_call"), F.max("ts").alias("last_call"), F.count("*").alias("calls")).drop("w")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_limit_window(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS in_window")


@query("SELECT p_partkey AS id, 'pkg:' || CASE WHEN p_size > 25 THEN 'npm' ELSE 'pypi' END || '/' || CASE WHEN p_size > 25 THEN replace('@' || p_name, '@', '%40') ELSE '@' || p_name END || '@' || p_size AS purl FROM part")
def sbom_purl(spark, d):
    p = table(spark, d, "part").withColumn("eco", F.when(F.col("p_size") > 25, "npm").otherwise("pypi"))
    return p.select(F.col("p_partkey").alias("id"), text.purl("eco", F.concat(F.lit("@"), F.col("p_name")), F.col("p_size").cast("string")).alias("purl"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""
WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS file, sha256(string_agg(o_orderstatus, '' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
b AS (SELECT CAST(o_custkey AS VARCHAR) AS file, sha256(string_agg(o_orderstatus, '' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'new' WHEN b.file IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.h <> b.h
""")
def detect_changes(spark, d):
    o = table(spark, d, "orders")
    sums = lambda x: x.groupBy(F.col("o_custkey").cast("string").alias("file")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda r: r["o_orderstatus"]), ""), 256).alias("sha256"))
    return quality.detect_changes(sums(o.where("o_orderpriority <> '1-URGENT'")), sums(o.where("o_orderstatus <> 'P'")))


@query("""
SELECT p_partkey AS id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ',') AS words FROM (SELECT p_partkey, list_sort(list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type), '[_\\-\\s]+'))) AS w FROM part)
""")
def identifier_words(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sort_array(text.split_identifier(F.lower(F.concat_ws(" ", "p_name", "p_type")))).alias("w"))
    return p.select("id", F.size("w").alias("n_words"), F.array_join("w", ",").alias("words"))


@query("SELECT event_id, CAST(floor((value + 5) / 10) * 10 AS INTEGER) AS ms FROM events")
def usage_rounding(spark, d):
    return table(spark, d, "events").select("event_id", text.rounded_ms("value").alias("ms"))


@query(f"""
WITH f AS ({PATHS}) SELECT file, regexp_matches(lower(regexp_extract(file, '[^/]*$')), '^(secret.*|token.*|shadow|passwd)$') AS secret FROM f
""")
def secret_paths(spark, d):
    return adapter.page_paths(spark, d).select("file", text.is_secret_file("file").alias("secret"))
