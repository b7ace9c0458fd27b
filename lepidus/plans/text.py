"""Plans over texts and word graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lepidus.functions import strings
from lepidus.operators import graphs, text
from lepidus.plans import Tables, query

NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
#: Benchmark items, as words: expert text (item_id) against the next item's
TOK = f"tok AS (SELECT item_id, CASE WHEN {NORM} = '' THEN [] ELSE string_split({NORM}, ' ') END AS w FROM benchmark)"
PAIR = f"{TOK}, pair AS (SELECT a.item_id, a.w AS r, list_concat(a.w[1:12], b.w) AS c FROM tok a JOIN tok b ON b.item_id = a.item_id + 1)"
ADJ, NOUN = "(?:ed|ly|ish|ous|ive|al)$", "(?:ion|ness|ing|er|ment)$"
TAG = f"{TOK}, tag AS (SELECT item_id, list_filter(w, lambda x: regexp_matches(x, '{ADJ}')) AS adj, list_filter(w, lambda x: regexp_matches(x, '{NOUN}')) AS noun FROM tok)"
COO = f"{TAG}, coo AS (SELECT src, dst, count(*) AS w FROM (SELECT item_id, src, unnest(noun) AS dst FROM (SELECT item_id, unnest(adj) AS src, noun FROM tag)) GROUP BY ALL)"


def _tok(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", strings.tokens(F.col("text")).alias("w"))


def _pair(t: Tables) -> DataFrame:
    b = _tok(t).select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return _tok(t).join(b, "item_id").select("item_id", F.col("w").alias("r"), F.concat(F.slice("w", 1, 12), "v").alias("c"))


def _coo(t: Tables, where: str = "true") -> DataFrame:
    return text.cooccurrence(text.tagged(t.benchmark.where(where), "item_id", "text"))


def _sub(where: str) -> str:
    return COO.replace("FROM benchmark)", f"FROM benchmark WHERE {where})")


@query("x01_clean_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_\\-.]', '_', 'g') AS file, regexp_replace(url, '[^A-Za-z0-9_\\-]', '', 'g') AS strict, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS species FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *[strings.clean_name(F.col("url"), r).alias(r) for r in ("file", "strict", "species")])


@query("x02_canonical_keys", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '[^A-Za-z0-9_]', '', 'g')) AS key FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", strings.canonical(F.col("url")).alias("key"))


@query("x03_stems", "SELECT page_id, CASE WHEN contains(s, '.jpg') THEN split_part(s, '.jpg', 1) ELSE split_part(s, '.', 1) END AS stem FROM (SELECT page_id, regexp_replace(substr(url, 8), '(?:_qa|\\.html)$', '') AS s FROM pages)")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", strings.stem(F.expr("substring(url, 8)"), ("_qa", r"\.html")).alias("stem"))


@query("x04_category_of_name", "SELECT p_partkey, min_by(c.c, c.k) AS category FROM part JOIN (VALUES (1, 'ring'), (2, 'widget'), (3, 'small')) c(k, c) ON contains(p_name, c.c) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    listed = F.broadcast(t.spark.createDataFrame([(1, "ring"), (2, "widget"), (3, "small")], "k int, c string"))
    return t.part.join(listed, F.contains(F.col("p_name"), F.col("c"))).groupBy("p_partkey").agg(F.min_by("c", "k").alias("category"))


@query("x05_normalised_category", "SELECT p_partkey, coalesce(a.k, b.k, 'Unknown') AS category FROM part LEFT JOIN (VALUES ('ECONOMY'), ('promo')) a(k) ON a.k = p_type LEFT JOIN (VALUES ('ECONOMY'), ('promo')) b(k) ON lower(b.k) = lower(p_type)")
def _(t: Tables) -> DataFrame:
    names = lambda c: F.broadcast(t.spark.createDataFrame([("ECONOMY",), ("promo",)], f"{c} string"))
    p = t.part.join(names("a"), F.col("a") == F.col("p_type"), "left").join(names("b"), F.lower("b") == F.lower("p_type"), "left")
    return p.select("p_partkey", F.coalesce("a", "b", F.lit("Unknown")).alias("category"))


@query("x06_scale_text", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN TRY_CAST(l_quantity::INT || '.' || l_linenumber AS DOUBLE) END AS number, CASE l_returnflag WHEN 'A' THEN 'mm' WHEN 'R' THEN 'µm' END AS unit FROM lineitem")
def _(t: Tables) -> DataFrame:
    from lepidus.operators.measure import scale_text

    label = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "A", " mm").when(F.col("l_returnflag") == "R", "µm").otherwise(" px"))
    number, unit = scale_text(label)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", number.alias("number"), unit.alias("unit"))


@query("x07_normalised_text", f"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def _(t: Tables) -> DataFrame:
    n = strings.normalised(F.col("text"))
    return t.documents.select("doc_id", F.length(n).cast("long").alias("n_chars"), F.md5(n).alias("digest"))


SECTIONS = "'Description (short)' || chr(10) || text || chr(10) || chr(10) || 'Diagnosis: ' || chr(10) || item_id || ' ' || text || chr(10) || ' ' || chr(10) || 'End'"


def _sections() -> Column:
    return F.concat(F.lit("Description (short)\n"), "text", F.lit("\n\nDiagnosis: \n"), "item_id", F.lit(" "), "text", F.lit("\n \nEnd"))


@query("x08_sections", "SELECT item_id, trim(item_id || ' ' || split_part(text, chr(10) || chr(10), 1)) AS diagnosis, '' AS absent FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", strings.section(_sections(), "Diagnosis").alias("diagnosis"), strings.section(_sections(), "Material").alias("absent"))


@query("x10_key_features", "SELECT item_id, CASE WHEN contains(d, '. ') THEN split_part(d, '. ', 1) || '.' ELSE d END AS feature FROM (SELECT item_id, trim(item_id || ' ' || split_part(text, chr(10) || chr(10), 1)) AS d FROM benchmark)")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", strings.key_features(_sections()).alias("feature"))


@query("x10_feature_lines", "SELECT p_partkey, [p_type, p_brand] AS features FROM part")
def _(t: Tables) -> DataFrame:
    line = strings.feature_line(F.concat(F.lit("sp"), "p_partkey"), F.array("p_type", "p_brand"))
    return t.part.select("p_partkey", strings.parsed_features(F.concat(F.lit("Key:\n"), line))[F.concat(F.lit("sp"), "p_partkey")].alias("features"))


@query(
    "x09_state_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
 m AS (SELECT doc_id, pos, CASE WHEN trim(line) = '' THEN '' ELSE nullif(regexp_extract(line, '^(?:The|Of|And) '), '') END AS mark FROM l),
 s AS (SELECT doc_id, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS marker FROM m) SELECT doc_id, marker, count(*) AS n FROM s WHERE marker IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return text.state_lines(t.documents, "doc_id", "text", r"^(?:The|Of|And) ").where("marker is not null").groupBy("doc_id", "marker").agg(F.count("*").alias("n"))


@query("x10_first_sentence", "SELECT doc_id, split_part(text, '. ', 1) AS s FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.first_sentence(F.col("text")).alias("s"))


@query("x11_replaced_keys", "SELECT item_id, 'Intro' || chr(10) || 'Species Description for a: x' || chr(10) || chr(10) || 'Dichotomous Key: new' || chr(10) AS text FROM benchmark")
def _(t: Tables) -> DataFrame:
    old = F.concat(F.lit("Intro\nDichotomous Key: "), "text", F.lit("\nSpecies Description for a: x\nDichotomous Key: "), "text")
    return t.benchmark.select("item_id", strings.with_key(strings.without_keys(old), F.lit(" Dichotomous Key: new ")).alias("text"))


@query("x12_json_blocks", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    cut = F.concat(F.lit("answer: ```json\n"), F.col("props"), F.lit("\n``` end"))
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so "), F.regexp_replace("props", r"\}$", ""))).otherwise(cut)
    return t.events.select("event_id", F.get_json_object(strings.json_block(broken), "$.k").cast("long").alias("k"))


@query("x13_unescaped", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS VARCHAR) AS v FROM events")
def _(t: Tables) -> DataFrame:
    escaped = F.concat(F.lit('{\\"q_key\\": {\\"v\\": \\"'), F.get_json_object("props", "$.k"), F.lit('\\"}}\\n'))
    parsed = F.from_json(strings.unescaped(escaped), "map<string, map<string, string>>")
    return t.events.select("event_id", parsed["q_key"]["v"].alias("v"))


@query("x15_wrapped")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", strings.wrapped(F.col("text")).alias("lines"))


@query("x16_estimated_tokens", "SELECT doc_id, length(text) // 4 AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.estimated_tokens(F.col("text")).alias("n"))


for _n in (1, 2):
    _g = "r" if _n == 1 else "list_transform(range(1, len(r)), lambda k: r[k] || ' ' || r[k + 1])"

    @query(
        f"x18_rouge_{_n}",
        f"""WITH {PAIR}, a AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest({_g}) AS g FROM pair) GROUP BY ALL), b AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest({_g.replace("r[", "c[").replace("len(r)", "len(c)") if _n > 1 else "c"}) AS g FROM pair) GROUP BY ALL),
 s AS (SELECT item_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS h, coalesce(sum(a.n), 0) AS r, coalesce(sum(b.n), 0) AS c FROM a FULL JOIN b USING (item_id, g) GROUP BY 1)
 SELECT item_id, round(coalesce(h / nullif(c, 0), 0), 6) AS precision, round(coalesce(h / nullif(r, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(r + c, 0), 0), 6) AS f1 FROM s""",
    )
    def _(t: Tables, n: int = _n) -> DataFrame:
        return text.rouge_n(_pair(t), "item_id", "r", "c", n).select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("x18_rouge_l")
def _(t: Tables) -> DataFrame:
    return text.rouge_l(_pair(t), "item_id", "r", "c")


@query("x18_rouge_1_stemmed")
def _(t: Tables) -> DataFrame:
    p = text.stemmed(text.stemmed(_pair(t), "r", "rs"), "c", "cs")
    return text.rouge_n(p, "item_id", "rs", "cs")


@query("x19_tagged", f"WITH {TAG} SELECT item_id, adj AS adjectives, noun AS nouns FROM tag")
def _(t: Tables) -> DataFrame:
    return text.tagged(t.benchmark, "item_id", "text")


@query("x24_lists", "SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: trim(x)) AS parts, [p_size::DOUBLE, p_retailprice] AS numbers FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.listed(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("parts"), strings.floats(F.concat("p_size", F.lit(", ,"), "p_retailprice")).alias("numbers"))


@query("x25_block_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Sp ' || doc_id ELSE 'unknown_species' END AS species FROM documents")
def _(t: Tables) -> DataFrame:
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SPECIES Description for *Sp "), "doc_id", F.lit("*:\n"))).otherwise(F.lit("no header\n"))
    return t.documents.select("doc_id", strings.block_species(F.concat(header, "text")).alias("species"))


@query("a08_word_counts", f"WITH d AS (SELECT unnest(string_split({NORM}, ' ')) AS word FROM documents WHERE {NORM} <> '') SELECT word, count(*) AS n FROM d GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return text.word_counts(t.documents.select(strings.tokens(F.col("text")).alias("w")), "w")


@query("t02_top_words", f"WITH d AS (SELECT unnest(string_split({NORM}, ' ')) AS word FROM documents WHERE {NORM} <> '') SELECT word, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def _(t: Tables) -> DataFrame:
    return text.word_counts(t.documents.select(strings.tokens(F.col("text")).alias("w")), "w").orderBy(F.desc("n"), "word").limit(20)


@query("a09_cooccurrence", f"WITH {COO} FROM coo")
def _(t: Tables) -> DataFrame:
    return _coo(t)


@query("a10_node_weights", f"WITH {COO} SELECT node, sum(w)::BIGINT AS weight FROM (SELECT src AS node, w FROM coo UNION ALL SELECT dst, w FROM coo) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return graphs.node_weights(_coo(t))


@query(
    "a17_graph_metrics",
    f"""WITH {COO}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM coo), ends AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e), deg AS (SELECT node, count(*) AS d FROM ends GROUP BY 1),
 s AS (SELECT a, b FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b), loc AS (SELECT x.a AS node, count(*) AS t FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN e ON e.a = x.b AND e.b = y.b GROUP BY 1), k AS (SELECT a AS node, count(*) AS k FROM s GROUP BY 1)
 SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, round(2 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1))::DOUBLE, 6) AS density, round(avg(d), 6) AS degree, round(avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1))::DOUBLE ELSE 0 END), 6) AS clustering FROM deg LEFT JOIN loc USING (node) LEFT JOIN k USING (node)""",
)
def _(t: Tables) -> DataFrame:
    return graphs.metrics(_coo(t)).select("nodes", "edges", *[F.round(c, 6).alias(c) for c in ("density", "degree", "clustering")])


HALVES = f"{_sub('item_id % 2 = 0').replace('coo AS', 'ca AS').replace('tok', 'tok1').replace('tag', 'tag1')}, {_sub('item_id % 3 = 0').replace('coo AS', 'cb AS')}"


@query("u03_edge_sets", f"WITH {HALVES} SELECT 'both' AS part, src, dst FROM (SELECT src, dst FROM ca INTERSECT SELECT src, dst FROM cb) UNION ALL SELECT 'first', src, dst FROM (SELECT src, dst FROM ca EXCEPT SELECT src, dst FROM cb) UNION ALL SELECT 'second', src, dst FROM (SELECT src, dst FROM cb EXCEPT SELECT src, dst FROM ca)")
def _(t: Tables) -> DataFrame:
    a, b = (_coo(t, w).select("src", "dst") for w in ("item_id % 2 = 0", "item_id % 3 = 0"))
    part = lambda name, df: df.select(F.lit(name).alias("part"), "src", "dst")
    return part("both", a.intersect(b)).unionByName(part("first", a.subtract(b))).unionByName(part("second", b.subtract(a)))


@query("u04_overlap_regions", f"WITH {HALVES}, a AS (SELECT DISTINCT src FROM ca), b AS (SELECT DISTINCT src FROM cb) SELECT count(*) FILTER (b.src IS NULL) AS only_first, count(*) FILTER (a.src IS NOT NULL AND b.src IS NOT NULL) AS \"both\", count(*) FILTER (a.src IS NULL) AS only_second FROM a FULL JOIN b ON a.src = b.src")
def _(t: Tables) -> DataFrame:
    return graphs.regions(_coo(t, "item_id % 2 = 0"), _coo(t, "item_id % 3 = 0"), "src")


@query("u05_jaccard", f"WITH {HALVES}, a AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM ca), b AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM cb) SELECT round(count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard FROM a FULL JOIN b ON a.s = b.s AND a.d = b.d")
def _(t: Tables) -> DataFrame:
    a, b = graphs.undirected(_coo(t, "item_id % 2 = 0")), graphs.undirected(_coo(t, "item_id % 3 = 0"))
    return graphs.jaccard(a, b, ["src", "dst"]).select(F.round("jaccard", 6).alias("jaccard"))


@query("u06_unique_edges", f"WITH {HALVES} SELECT src, dst, w FROM ca WHERE (src, dst) NOT IN (SELECT (src, dst) FROM cb)")
def _(t: Tables) -> DataFrame:
    return graphs.unique_edges(_coo(t, "item_id % 2 = 0"), _coo(t, "item_id % 3 = 0")).select("src", "dst", "w")


@query("u07_shared_names", "SELECT doc_id AS id FROM documents INTERSECT SELECT item_id FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id")).intersect(t.benchmark.select("item_id"))


@query("j05_text_pairs", "SELECT doc_id, length(d.text) AS n1, length(b.text) AS n2 FROM documents d JOIN benchmark b ON doc_id % 40 = item_id")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.length("text").cast("long").alias("n1"))
    return d.join(t.benchmark.select("item_id", F.length("text").cast("long").alias("n2")), "item_id").select("doc_id", "n1", "n2")


@query(
    "j19_aligned_counts",
    f"WITH {TOK}, n AS (SELECT item_id % 4 AS m, unnest(w) AS word FROM tok) SELECT word, count(*) FILTER (m = 0) AS c0, count(*) FILTER (m = 1) AS c1, count(*) FILTER (m = 2) AS c2, count(*) FILTER (m = 3) AS c3 FROM n GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    n = text.word_counts(_tok(t).withColumn("m", F.concat(F.lit("c"), F.col("item_id") % 4)), "w", ("m",))
    return n.groupBy("word").pivot("m", ["c0", "c1", "c2", "c3"]).agg(F.sum("n")).na.fill(0)


@query("w10_batches", """WITH RECURSIVE i AS (SELECT lang, doc_id, length(text) // 4 AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
 f AS (SELECT lang, doc_id, k, 0 AS batch, s AS held FROM i WHERE k = 1 UNION ALL SELECT i.lang, i.doc_id, i.k, CASE WHEN f.held > 0 AND f.held + i.s + 50 > 8000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held > 0 AND f.held + i.s + 50 > 8000 THEN i.s ELSE f.held + i.s END FROM f JOIN i ON i.lang = f.lang AND i.k = f.k + 1) SELECT lang, doc_id, batch FROM f""")
def _(t: Tables) -> DataFrame:
    items = t.documents.select("lang", "doc_id", strings.estimated_tokens(F.col("text")).alias("size"))
    return text.batches(items, "lang", "doc_id", "size", 8000, 50)


@query("w11_windows", f"WITH {TOK} SELECT item_id, k AS pos, w[k * 8 + 1 : k * 8 + 16] AS words FROM tok JOIN range(1000) r(k) ON k * 8 < len(w)")
def _(t: Tables) -> DataFrame:
    return _tok(t).select("item_id", F.posexplode(strings.windows(F.col("w"), 16, 8)).alias("pos", "words"))


@query("w14_duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@query("w15_versioned_names", "SELECT p_partkey, 'part' || p_size || '_V' || CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey + 1 END || '.json' AS name FROM part")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.lit("part"), "p_size", F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_V"), "p_partkey")), F.lit(".json"))
    return t.part.select("p_partkey", strings.versioned(name).alias("name"))


@query("s10_text_blocks", "SELECT doc_id, count(*) AS n, max(length(b)) AS longest FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS b FROM documents) WHERE length(b) > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    b = text.blocks(t.documents, "doc_id", "text", r"\n")
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("block")).cast("long").alias("longest"))


@query("a22_failures", "SELECT lang, count(*) FILTER (NOT regexp_matches(text, '^[A-Z][a-z]')) AS failed, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count_if(~F.col("text").rlike("^[A-Z][a-z]")).alias("failed"), F.count("*").alias("n"))
