"""Registered queries over the driver's tables, and the same in SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.sentences import ABBREVIATIONS
from quern.functions.stem import stem_table
from quern.operators import answer, chunk, embed, fuse, metrics, search, store
from quern.sources.tables import kept, sized

DIM = 512
#: Queries whose SQL has no stems take terms as they are written.
PLAIN = T.PLAIN


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores when its scan has fewer partitions than they are; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _docs(s, d):
    return spread(_read(s, d, "documents"))


def _questions(s, d):
    return _read(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def fold_text(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


def tokenize_count(s, d):
    return _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def analyze_terms(s, d):
    terms = T.analyzed(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms"))


def snippets(s, d):
    return _docs(s, d).select("doc_id", T.snippet(F.col("text"), 80).alias("snippet"), F.length(T.collapse_whitespace(F.col("text"))).cast("long").alias("n_collapsed"))


def word_spans(s, d):
    spans = T.word_spans(_docs(s, d)).where("n > 0")
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("begin").alias("starts"), F.sum("stop").alias("stops"))


def _spans(chunks):
    return chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.md5("text").alias("digest"))


def chunk_fixed(s, d):
    return _spans(chunk.chunk(_docs(s, d), "fixed"))


def chunk_token(s, d):
    return _spans(chunk.chunk(_docs(s, d), "token"))


def chunk_sentence(s, d):
    return _spans(chunk.chunk(_docs(s, d), "sentence"))


def chunk_structural(s, d):
    return _spans(chunk.chunk(_docs(s, d), "structural"))


def _by_strategy(s, d, name, of, texts):
    """(doc_id, strategy, name) of the pieces that each strategy makes, in one pass over the texts."""
    docs = _docs(s, d).select("doc_id", "text", F.length("text").alias("chars"))
    for k in chunk.DEFAULTS:
        docs = chunk.pieces(docs, k, f"__{k}", texts)
    each = (F.struct(F.lit(k).alias("strategy"), of(F.col(f"__{k}")).alias(name)) for k in chunk.DEFAULTS)
    return docs.select("doc_id", F.inline(F.array(*each)))


def chunk_coverage(s, d):
    return _by_strategy(s, d, "covered", lambda pieces: chunk.tiles(pieces, F.col("chars")), False)


def chunk_reconstruct(s, d):
    return _by_strategy(s, d, "digest", lambda pieces: F.md5(chunk.joined(pieces)), True)


def _postings(s, d, analyzer=PLAIN):
    return search.postings(_docs(s, d), "doc_id", F.col("text"), analyzer)


def postings(s, d):
    return _postings(s, d).where("term <> ''").select("term", "doc_id", "tf", F.col("len").cast("long").alias("n_terms"))


def postings_stemmed(s, d):
    return _postings(s, d, T.Analyzer()).where("term <> ''").select("term", "doc_id", "tf", F.col("len").cast("long").alias("n_terms"))


def corpus_stats(s, d):
    lengths = _docs(s, d).select(F.lit("").alias("term"), F.size(T.analyzed(F.col("text"))).alias("len"))
    return search.corpus_stats(lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


def doc_frequency(s, d):
    posts = kept(_postings(s, d), "postings")
    return search.doc_frequency(posts, search.corpus_stats(posts)).select("term", "df", F.round("idf", 6).alias("idf"))


def stem_terms(s, d):
    return stem_table(_docs(s, d).select(F.explode(T.tokens(F.col("text"))).alias("term")))


def _scores(ranked, key="doc_id"):
    return ranked.select("qid", key, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk(s, d):
    return _scores(search.bm25(_questions(s, d), _docs(s, d), "doc_id", 10, analyzer=PLAIN))


def bm25_stemmed(s, d):
    return _scores(search.bm25(_questions(s, d), _docs(s, d), "doc_id", 10))


def bm25_filtered(s, d):
    return _scores(search.bm25(_questions(s, d), _docs(s, d), "doc_id", 10, filters=search.matches({"lang": "en", "source": ["src0", "src1", "src2"]}), analyzer=PLAIN))


def bm25_chunks(s, d):
    chunks = chunk.chunk(_docs(s, d), "fixed")
    return _scores(search.bm25(_questions(s, d), chunks, "chunk_id", 10, analyzer=PLAIN), "chunk_id")


def _vectors(s, d):
    rows = _read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), rows


def dense_cosine_topk(s, d):
    q, rows = _vectors(s, d)
    return _scores(search.dense_topk(q, rows, "vec_id", 10), "vec_id")


def dense_l2_topk(s, d):
    q, rows = _vectors(s, d)
    return _scores(search.dense_topk(q, rows, "vec_id", 10, "l2"), "vec_id")


def dense_filtered(s, d):
    q, rows = _vectors(s, d)
    return _scores(search.dense_topk(q, rows.where(search.matches({"label": [1, 2, 3]})), "vec_id", 10), "vec_id")


def ann_topk(s, d):
    q, rows = _vectors(s, d)
    return _scores(search.ann_topk(q, rows, "vec_id", 10), "vec_id")


def hash_embed(s, d):
    found = embed.hash_embed(_docs(s, d), "doc_id", "text", DIM, stemming=False)
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("x", 6).alias("x"))


def _lists(s, d):
    questions, docs = _questions(s, d), _docs(s, d)
    lexical = search.bm25(questions, docs, "doc_id", 30, analyzer=PLAIN).withColumn("source", F.lit("lexical"))
    q = embed.hash_vectors(questions, "qid", "question", DIM, stemming=False)
    rows = embed.hash_vectors(docs, "doc_id", "text", DIM, stemming=False)
    near = search.dense_topk(q, rows, "doc_id", 30).withColumn("source", F.lit("dense"))
    return kept(lexical.unionByName(near.select(*lexical.columns)), "lists")


def fuse_rrf(s, d):
    return _scores(fuse.fuse(_lists(s, d), "doc_id", 6))


def fuse_weighted(s, d):
    return _scores(fuse.fuse(_lists(s, d), "doc_id", 6, "weighted"))


def hybrid_explained(s, d):
    fused = fuse.fuse(_lists(s, d), "doc_id", 6)
    return fused.select("qid", F.col("rank").cast("long").alias("rank"), fuse.explained(fused, "doc_id").alias("explained"))


def rerank_heuristic(s, d):
    questions, docs = _questions(s, d), _docs(s, d)
    top = search.bm25(questions, docs, "doc_id", 20, analyzer=PLAIN).select("qid", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    return _scores(fuse.rerank(top, questions, "doc_id", 6, analyzer=PLAIN))


def _gold(s, d):
    """Where a benchmark passage first stands verbatim in a document."""
    passages = _read(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return kept(metrics.verbatim(passages, _docs(s, d)), "gold")


def gold_spans(s, d):
    return _gold(s, d)


def gold_relevant(s, d):
    gold = _gold(s, d)
    return metrics.relevant(chunk.chunk(_docs(s, d).join(sized(gold.select("doc_id").distinct()), "doc_id", "left_semi"), "fixed"), gold)


def retrieval_metrics(s, d):
    found = search.bm25(_questions(s, d), _docs(s, d), "doc_id", 6, analyzer=PLAIN)
    gold = _gold(s, d).select("qid", "doc_id").distinct()
    return metrics.at_k(found, gold, "doc_id", 5).select("qid", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")))


def _packs(s, d):
    docs = _docs(s, d)
    top = kept(search.bm25(_questions(s, d), chunk.chunk(docs, "fixed"), "chunk_id", 6, analyzer=PLAIN), "top")
    ids = sized(top.select("chunk_id").distinct())
    # only the documents of these chunks are cut again; a chunk's id is its document's, "::" and a number
    found = sized(top.select(F.regexp_replace("chunk_id", "::[0-9]+$", "").alias("id")).distinct())
    chunks = chunk.chunk(docs.join(found, F.col("doc_id").cast("string") == F.col("id"), "left_semi"), "fixed")
    cut = kept(chunks.select("chunk_id", "text", "heading").join(ids, "chunk_id", "left_semi"), "cut")
    return kept(answer.packed(top.join(sized(cut), "chunk_id")), "packs")


def context_pack(s, d):
    return _packs(s, d).select("qid", F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"), F.md5("block").alias("block"))


def _answers(s, d):
    packs, questions = _packs(s, d), _questions(s, d)
    return packs, kept(answer.enforced(answer.extractive(packs, questions, analyzer=PLAIN), packs, questions, "chunk_id"), "answers")


def extractive_answer(s, d):
    return _answers(s, d)[1].select("qid", "text", F.size("citations").cast("long").alias("n_citations"), "refused", "reason")


def refusal_sweep(s, d):
    return answer.refusals(_packs(s, d), _questions(s, d), [0.0, 0.2, 0.34, 0.5, 0.67], PLAIN).select("min_support", F.round("refused", 6).alias("refused"))


def faithfulness(s, d):
    """Of every extractive answer to its cited chunks, and of the question's terms in the answer."""
    packs, said = _answers(s, d)
    cited = said.select("qid", F.explode("citations.chunk_id").alias("chunk_id")).join(packs.select("qid", "chunk_id", "text"), ["qid", "chunk_id"])
    cited = cited.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(T.analyzed(F.col("text"))))).alias("cited"))
    rows = said.select("qid", "text", "refused").join(cited, "qid", "left").join(_questions(s, d), "qid")
    own, none = T.analyzed(metrics.without_markers(F.col("text"))), F.expr("cast(array() as array<string>)")
    faithful = metrics.faithfulness(F.col("refused"), own, F.coalesce("cited", none))
    return rows.select("qid", F.round(faithful, 6).alias("faithful"), F.round(metrics.term_recall(T.analyzed(F.col("question")), own), 6).alias("term_recall"))


def latency_percentiles(s, d):
    return metrics.percentiles(_read(s, d, "events"), "value").select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def _table(s, d):
    return chunk.chunk(_docs(s, d), "fixed").select("chunk_id", "doc_id", "text")


def _changed(s, d):
    """Every document anew: its text after a mark, those in French emptied."""
    return _docs(s, d).select("doc_id", F.when(F.col("lang") == "fr", F.lit(" ")).otherwise(F.concat(F.lit("new "), "text")).alias("text"))


def store_upsert(s, d):
    return store.upsert(_table(s, d), chunk.chunk(_changed(s, d), "fixed").select("chunk_id", "doc_id", "text")).select("chunk_id", "doc_id", F.md5("text").alias("digest"))


def store_delete(s, d):
    return store.delete_documents(_table(s, d), _docs(s, d).where("lang = 'fr'")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def reindex_replace(s, d):
    docs = _changed(s, d)
    fresh = chunk.chunk(docs, "fixed").select("chunk_id", "doc_id", "text")
    return store.reindexed(_table(s, d), docs, fresh, _read(s, d, "documents")).select("chunk_id", "doc_id", F.md5("text").alias("digest"))


def dedupe_ids(s, d):
    turns = _read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    return store.last_of_each(turns).select("doc_id", "seq", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_filtered, bm25_chunks, fold_text, tokenize_count, analyze_terms, snippets, word_spans, chunk_fixed, chunk_token, chunk_sentence, chunk_structural, chunk_coverage, chunk_reconstruct,
        postings, postings_stemmed, corpus_stats, doc_frequency, stem_terms, bm25_stemmed, dense_cosine_topk, dense_l2_topk, dense_filtered, ann_topk, hash_embed, fuse_rrf, fuse_weighted, hybrid_explained, rerank_heuristic, gold_spans,
        gold_relevant, retrieval_metrics, context_pack, extractive_answer, refusal_sweep, faithfulness, latency_percentiles, store_upsert, store_delete, reindex_replace, dedupe_ids,
    )
}

# --- the same in SQL ---------------------------------------------------------------------

_TOKEN = T.TOKEN.replace("'", "''")
_FOLD = "replace(lower(text), 'ё', 'е')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(replace(lower({column}), 'ё', 'е'), '{_TOKEN}')"


def _terms(column: str) -> str:
    return f"list_filter({_tokens(column)}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


_COLLAPSE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FIXED = """fixed AS (
  SELECT doc_id, i AS ordinal, i * 680 AS start_at, CASE WHEN i = n - 1 THEN chars ELSE least(i * 680 + 800, chars) END AS end_at, text AS whole FROM (
    SELECT doc_id, text, chars, CASE WHEN raw > 1 AND chars - (raw - 1) * 680 < 120 THEN raw - 1 ELSE raw END AS n, unnest(range(CASE WHEN raw > 1 AND chars - (raw - 1) * 680 < 120 THEN raw - 1 ELSE raw END)) AS i FROM (
      SELECT doc_id, text, length(text) AS chars, CASE WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 800) / 680.0)::BIGINT + 1 END AS raw FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''))),
chunks AS (SELECT doc_id, ordinal, start_at, end_at, doc_id || '::' || CASE WHEN ordinal < 10000 THEN lpad(ordinal::VARCHAR, 4, '0') ELSE ordinal::VARCHAR END AS chunk_id, substr(whole, start_at + 1, end_at - start_at) AS text FROM fixed)"""
_WORDS = f"""pieces AS (SELECT doc_id, length(text) AS chars, regexp_split_to_array({_FOLD}, '{_TOKEN}') AS gaps, {_tokens('text')} AS toks FROM documents),
steps AS (SELECT doc_id, chars, len(toks) AS n, unnest(range(len(toks))) AS i, unnest(list_transform(toks, lambda t, k: length(gaps[k]))) AS gap, unnest(list_transform(toks, lambda t: length(t))) AS size FROM pieces),
word AS (SELECT doc_id, chars, n, i, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop, size FROM steps)"""


def _bm25(rows: str, key: str, k: int, where: str = "TRUE") -> str:
    return f"""stats AS (SELECT count(*) AS n, avg(len({_terms('text')})) AS avgdl FROM {rows}),
post AS (SELECT {key}, len, term, count(*) AS tf FROM (SELECT {key}, len(t) AS len, unnest(t) AS term FROM (SELECT {key}, {_terms('text')} AS t FROM {rows})) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id AS qid, unnest({_terms('text')}) AS term FROM benchmark),
scored AS (SELECT qid, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM post JOIN df USING (term) JOIN asked USING (term), stats GROUP BY qid, {key}),
lexical AS (SELECT qid, {key}, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {key}) AS rank FROM scored WHERE {key} IN (SELECT {key} FROM {rows} WHERE {where}) QUALIFY rank <= {k})"""


def _top(score: str, where: str = "TRUE") -> str:
    return f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings WHERE {where}),
s AS (SELECT qid, vec_id, {score} AS score FROM q, r)
SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def _embedded(name: str, key: str, rows: str) -> str:
    return f"""{name}_f AS (SELECT {key}, unnest(list_concat(list_transform(t, lambda x: 'w:' || x), flatten(list_transform(list_filter(t, lambda x: length(x) > 3), lambda x: list_transform(range(1, length(x) + 1), lambda i: 'c:' || substr('^' || x || '$', i, 3)))))) AS f FROM (SELECT {key}, {_tokens('text')} AS t FROM {rows})),
{name}_s AS (SELECT {key}, ('0x' || substr(h, 1, 7))::BIGINT % {DIM} AS idx, sum((CASE WHEN ('0x' || substr(h, 8, 1))::INT >= 8 THEN 1.0 ELSE -1.0 END)::DOUBLE * (1 + ln(tf))) AS x FROM (SELECT {key}, f, md5('20260214:' || f) AS h, count(*) AS tf FROM {name}_f GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT {key}, idx, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_s)"""


_LISTS = f"""{_bm25('documents', 'doc_id', 30)},
{_embedded('qv', 'item_id', 'benchmark')},
{_embedded('dv', 'doc_id', 'documents')},
near AS (SELECT item_id AS qid, doc_id, sum(qv.x * dv.x) AS score FROM qv JOIN dv USING (idx) GROUP BY ALL),
dense AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM near QUALIFY rank <= 30),
lists AS (SELECT 'lexical' AS source, * FROM lexical UNION ALL SELECT 'dense', * FROM dense)"""
_GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id, strpos(d.text, b.text) - 1 AS gold_start, strpos(d.text, b.text) - 1 + length(b.text) AS gold_end FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_FUSED = "SELECT qid, doc_id, round(sum(part) / 1e12, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(part) / 1e12, 9) DESC, doc_id) AS rank FROM p GROUP BY qid, doc_id QUALIFY rank <= 6"
_CHANGED = "changed AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN ' ' ELSE 'new ' || text END AS text FROM documents)"
_FIXED_ANEW = _FIXED.replace("FROM documents", "FROM changed").replace("fixed AS", "anew AS").replace("chunks AS", "fresh AS").replace("FROM fixed", "FROM anew")
_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_AFTER = "[.!?…\"»)'']"


def _sentences(rows: str, key: str) -> str:
    """sent(key, i, s, start, stop, n): sentences of rows(key, text); what ends one gets a mark, abbreviations' periods another."""
    safe = rf"regexp_replace(text, '(^|[^\p{{L}}.])({_SHORT})\.', '\1\2' || chr(2), 'gi')"
    ends = rf"regexp_replace({safe}, '(\.{_AFTER}*[ \t]+|\.{_AFTER}+|[!?…]{_AFTER}*[ \t]*)([^\p{{Ll}}\n \t.!?…\"»)''])', '\1' || chr(1) || '\2', 'g')"
    dots = rf"regexp_replace({ends}, '(\.)([^\p{{Ll}}\n \t.!?…\"»)''0-9' || chr(1) || '])', '\1' || chr(1) || '\2', 'g')"
    gaps = rf"regexp_replace({dots}, '(\n[ \t]*\n[ \t\n]*)([^ \t\n])', '\1' || chr(1) || '\2', 'g')"
    return f"""split AS (SELECT {key}, list_transform(string_split({gaps}, chr(1)), lambda x: replace(x, chr(2), '.')) AS l FROM {rows}),
flat AS (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i, len(l) AS n FROM split),
sent AS (SELECT *, sum(length(s)) OVER (PARTITION BY {key} ORDER BY i) - length(s) AS start, sum(length(s)) OVER (PARTITION BY {key} ORDER BY i) AS stop FROM flat)"""


_SOLID = f"solid AS (SELECT doc_id, text, length(text) AS chars FROM documents WHERE {_COLLAPSE} <> '')"
_OUT = "SELECT doc_id, ordinal::BIGINT AS ordinal, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, md5(substr(text, start_at::BIGINT + 1, (end_at - start_at)::BIGINT)) AS digest FROM spans JOIN solid USING (doc_id)"
_SENTENCE_CHUNKS = f"""WITH RECURSIVE {_SOLID}, {_sentences('solid', 'doc_id')}, known AS MATERIALIZED (SELECT * FROM sent),
reach AS MATERIALIZED (SELECT a.doc_id, a.i, a.n, a.start, max(b.i) AS last, max(b.stop) AS stop FROM known a JOIN known b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.i <= a.i + 800 AND (b.stop - a.start <= 800 OR b.i = a.i) GROUP BY ALL),
walk AS (SELECT doc_id, 1::BIGINT AS i, 0::BIGINT AS reached FROM solid
    UNION ALL SELECT w.doc_id, CASE WHEN r.last > w.reached THEN greatest(r.last, w.i + 1) ELSE w.reached + 1 END, greatest(r.last, w.reached) FROM walk w JOIN reach r ON r.doc_id = w.doc_id AND r.i = w.i WHERE w.reached < r.n AND r.last < r.n),
windows AS (SELECT w.doc_id, r.start, r.stop, row_number() OVER d AS k, count(*) OVER (PARTITION BY w.doc_id) AS total, lead(r.stop) OVER d AS next_stop, lead(r.stop - r.start) OVER d AS next_size
    FROM walk w JOIN reach r ON r.doc_id = w.doc_id AND r.i = w.i WHERE r.last > w.reached WINDOW d AS (PARTITION BY w.doc_id ORDER BY r.i)),
spans AS (SELECT doc_id, k - 1 AS ordinal, start AS start_at, CASE WHEN k = total - 1 AND next_size < 120 THEN next_stop ELSE stop END AS end_at FROM windows WHERE NOT (k = total AND total > 1 AND stop - start < 120))
{_OUT}"""
#: For texts without headings and blank lines, as all of ``documents`` are: one section, cut by sentences, then hard.
_STRUCTURAL_CHUNKS = f"""WITH RECURSIVE {_SOLID}, {_sentences('solid', 'doc_id')},
edges AS MATERIALIZED (SELECT doc_id, stop AS e FROM sent UNION SELECT doc_id, 0 FROM solid),
hop AS MATERIALIZED (SELECT a.doc_id, a.e, coalesce(max(b.e) FILTER (b.e <= a.e + 900), min(b.e)) AS onward FROM edges a JOIN edges b ON b.doc_id = a.doc_id AND b.e > a.e GROUP BY ALL),
walk AS (SELECT doc_id, 0::HUGEINT AS e, chars FROM solid UNION ALL SELECT w.doc_id, h.onward, chars FROM walk w JOIN hop h ON h.doc_id = w.doc_id AND h.e = w.e WHERE chars - w.e > 900 AND h.onward < chars),
parts AS (SELECT doc_id, e AS a, lead(e, 1, chars::HUGEINT) OVER (PARTITION BY doc_id ORDER BY e) AS b FROM walk),
cut AS (SELECT doc_id, a, b, unnest(range(greatest(1, ceil((b - a) / 900.0)::BIGINT))) AS j FROM parts),
spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, j) - 1 AS ordinal, a + j * 900 AS start_at, least(a + (j + 1) * 900, b) AS end_at FROM cut)
{_OUT}"""
_PACKS = f"""{_FIXED}, {_bm25('chunks', 'chunk_id', 6)}, b AS (SELECT qid, chunk_id, rank, text, '[' || rank || '] ' || substr({_COLLAPSE}, 1, 1500) AS block FROM lexical JOIN chunks USING (chunk_id)),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM b), packs AS MATERIALIZED (SELECT *, qid || ':' || rank AS k FROM u WHERE used <= 6000 OR rank = 1)"""
_SUPPORT = f"""{_PACKS}, {_sentences('packs', 'k')},
clean AS (SELECT k, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS text FROM sent),
question AS (SELECT qid, list(term) AS q FROM asked GROUP BY qid),
support AS MATERIALIZED (SELECT p.qid, p.rank, p.chunk_id, c.i, c.text AS sentence, len(list_intersect(q, {_terms('c.text')})) / len(q) AS overlap FROM clean c JOIN packs p USING (k) JOIN question USING (qid) WHERE length(c.text) >= 20)"""
_ANSWERED = f"""{_SUPPORT}, best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, i) AS n FROM support WHERE overlap > 0 QUALIFY n <= 3),
answered AS MATERIALIZED (SELECT qid, trim(regexp_replace(string_agg(sentence || ' [' || rank || ']', ' ' ORDER BY n), '[ \\t]+', ' ', 'g')) AS text, list_distinct(list(rank)) AS marks FROM best GROUP BY qid)"""
_CLOSE = f"""{_bm25('documents', 'doc_id', 20)}, question AS (SELECT qid, count(*) AS nq FROM asked GROUP BY qid),
found AS MATERIALIZED (SELECT qid, l.doc_id, {_terms('text')} AS t FROM lexical l JOIN documents USING (doc_id)),
flat AS (SELECT qid, doc_id, len(t) AS size, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM found),
hit AS MATERIALIZED (SELECT f.* FROM flat f JOIN asked USING (qid, term)),
per AS (SELECT qid, doc_id, max(size) AS size, count(*) AS hits, count(DISTINCT term) AS matched FROM hit GROUP BY qid, doc_id),
seen AS (SELECT h.qid, h.doc_id, h.pos, max(CASE WHEN h.term = m.term THEN h.pos END) OVER (PARTITION BY h.qid, h.doc_id, m.term ORDER BY h.pos) AS last FROM hit h JOIN (SELECT DISTINCT qid, doc_id, term FROM hit) m ON m.qid = h.qid AND m.doc_id = h.doc_id),
width AS (SELECT qid, doc_id, min(w) AS width FROM (SELECT qid, doc_id, pos - min(last) + 1 AS w FROM seen GROUP BY qid, doc_id, pos HAVING count(last) = count(*)) GROUP BY qid, doc_id),
graded AS (SELECT qid, doc_id, 0.6::DOUBLE * matched / nq + 0.25::DOUBLE * matched / width + 0.15::DOUBLE * least(1.0, 10.0 * hits / size) AS score FROM per JOIN width USING (qid, doc_id) JOIN question USING (qid))"""
_STRATEGIES = "(VALUES ('fixed'), ('sentence'), ('structural'), ('token')) k(strategy)"

ORACLES = {
    "fold_text": f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents",
    "tokenize_count": f"SELECT doc_id, len({_tokens('text')})::BIGINT AS n_tokens FROM documents",
    "analyze_terms": f"SELECT doc_id, len(t)::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS terms FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)",
    "snippets": f"SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 79)) || '…' END AS snippet, length(c)::BIGINT AS n_collapsed FROM (SELECT doc_id, {_COLLAPSE} AS c FROM documents)",
    "word_spans": f"WITH {_WORDS} SELECT doc_id, count(*) AS n_spans, sum(stop - size)::BIGINT AS starts, sum(stop)::BIGINT AS stops FROM word GROUP BY doc_id",
    "chunk_fixed": f"WITH {_FIXED} SELECT doc_id, ordinal, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, md5(text) AS digest FROM chunks",
    "chunk_token": f"""WITH {_WORDS}, placed AS (SELECT *, CASE WHEN n <= 180 THEN 1 ELSE ceil((n - 180) / 150.0)::BIGINT + 1 END AS total FROM word),
spread AS (SELECT *, unnest(range(greatest(0, ceil((i - 179) / 150.0)::BIGINT), least(i // 150, total - 1) + 1)) AS ordinal FROM placed),
span AS (SELECT doc_id, ordinal, total, chars, min(stop - size) AS b, max(stop) AS e FROM spread GROUP BY ALL)
SELECT s.doc_id, ordinal, start_at, end_at, md5(substr(text, start_at + 1, end_at - start_at)) AS digest FROM (SELECT doc_id, ordinal, (CASE WHEN ordinal = 0 THEN 0 ELSE b END)::BIGINT AS start_at, (CASE WHEN ordinal = total - 1 THEN chars ELSE e END)::BIGINT AS end_at FROM span) s JOIN documents d USING (doc_id)""",
    "chunk_coverage": f"SELECT doc_id, strategy, TRUE AS covered FROM documents, {_STRATEGIES} WHERE {_COLLAPSE} <> ''",
    "chunk_reconstruct": f"SELECT doc_id, strategy, md5(text) AS digest FROM documents, {_STRATEGIES} WHERE {_COLLAPSE} <> ''",
    "postings": f"SELECT term, doc_id, count(*) AS tf, n_terms FROM (SELECT doc_id, len(t)::BIGINT AS n_terms, unnest(t) AS term FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)) GROUP BY ALL",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_terms('text')})), 6) AS avgdl FROM documents",
    "doc_frequency": f"SELECT term, count(DISTINCT doc_id) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term",
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id', 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM lexical",
    "bm25_filtered": "WITH " + _bm25("documents", "doc_id", 10, "lang = 'en' AND source IN ('src0', 'src1', 'src2')") + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM lexical",
    "bm25_chunks": f"WITH {_FIXED}, {_bm25('chunks', 'chunk_id', 10)} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM lexical",
    "dense_cosine_topk": _top("list_cosine_similarity(a, b)"),
    "dense_l2_topk": _top("-list_distance(a, b)"),
    "dense_filtered": _top("list_cosine_similarity(a, b)", "label IN (1, 2, 3)"),
    "hash_embed": f"WITH {_embedded('dv', 'doc_id', 'documents')} SELECT doc_id, idx, round(x, 6) AS x FROM dv",
    "fuse_rrf": f"WITH {_LISTS}, p AS (SELECT qid, doc_id, round(0.5::DOUBLE / (60 + rank) * 1e12)::BIGINT AS part FROM lists) {_FUSED}",
    "fuse_weighted": f"WITH {_LISTS}, m AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM lists WINDOW w AS (PARTITION BY qid, source)), p AS (SELECT qid, doc_id, round(0.5::DOUBLE * CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END * 1e12)::BIGINT AS part FROM m) {_FUSED}",
    "gold_spans": f"WITH {_GOLD} SELECT qid, doc_id, gold_start::BIGINT AS gold_start, gold_end::BIGINT AS gold_end FROM gold",
    "gold_relevant": f"WITH {_FIXED}, {_GOLD} SELECT DISTINCT qid, chunk_id FROM chunks JOIN gold USING (doc_id) WHERE start_at < gold_end AND gold_start < end_at",
    "retrieval_metrics": f"""WITH {_bm25('documents', 'doc_id', 6)}, {_GOLD}, wanted AS (SELECT qid, count(DISTINCT doc_id) AS n FROM gold GROUP BY qid),
hit AS (SELECT l.qid, l.rank, g.doc_id IS NOT NULL AS hit FROM lexical l LEFT JOIN gold g ON l.qid = g.qid AND l.doc_id = g.doc_id),
per AS (SELECT qid, count(*) FILTER (hit AND rank <= 5) AS found, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0) AS gain FROM hit GROUP BY qid)
SELECT qid, round(CASE WHEN n > 0 THEN found / n ELSE 0 END, 6) AS recall, round(coalesce(found, 0) / 5, 6) AS precision, round(coalesce(1 / first, 0), 6) AS rr,
round(CASE WHEN n > 0 THEN coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM per FULL JOIN wanted USING (qid)""",
    "chunk_sentence": _SENTENCE_CHUNKS,
    "chunk_structural": _STRUCTURAL_CHUNKS,
    "hybrid_explained": f"""WITH {_LISTS}, p AS (SELECT qid, doc_id, source || '#' || rank AS mark, round(0.5::DOUBLE / (60 + rank) * 1e12)::BIGINT AS part FROM lists),
f AS (SELECT qid, doc_id, sum(part) / 1e12 AS score, string_agg(mark, ' ' ORDER BY mark) AS marks, row_number() OVER (PARTITION BY qid ORDER BY round(sum(part) / 1e12, 9) DESC, doc_id) AS rank FROM p GROUP BY qid, doc_id QUALIFY rank <= 6)
SELECT qid, rank, doc_id || ' rrf=' || printf('%.5f', score) || ' ' || marks AS explained FROM f""",
    "rerank_heuristic": f"WITH {_CLOSE} SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM graded QUALIFY rank <= 6",
    "context_pack": f"WITH {_PACKS} SELECT qid, rank, used::BIGINT AS used, md5(block) AS block FROM packs",
    "extractive_answer": f"""WITH {_ANSWERED} SELECT b.item_id AS qid, coalesce(a.text, '') AS text, coalesce(len(marks), 0)::BIGINT AS n_citations, a.qid IS NULL AS refused,
CASE WHEN a.qid IS NOT NULL THEN NULL WHEN b.item_id IN (SELECT qid FROM packs) THEN '{answer.UNRESOLVED}' ELSE '{answer.NO_CHUNKS}' END AS reason FROM benchmark b LEFT JOIN answered a ON a.qid = b.item_id""",
    "refusal_sweep": f"""WITH {_SUPPORT}, top AS (SELECT qid, max(overlap) AS best FROM support WHERE overlap > 0 GROUP BY qid)
SELECT m::DOUBLE AS min_support, round(avg(CASE WHEN best >= m::DOUBLE THEN 0.0 ELSE 1.0 END), 6) AS refused FROM benchmark b LEFT JOIN top ON qid = item_id, (VALUES (0.0), (0.2), (0.34), (0.5), (0.67)) t(m) GROUP BY m""",
    "faithfulness": f"""WITH {_ANSWERED}, cited AS (SELECT a.qid, list_distinct(flatten(list({_terms('p.text')}))) AS cited FROM answered a JOIN packs p ON p.qid = a.qid AND list_contains(a.marks, p.rank) GROUP BY a.qid),
t AS (SELECT b.item_id AS qid, a.qid IS NULL AS refused, list_distinct({_terms("regexp_replace(coalesce(a.text, ''), '\\[[0-9]{1,3}\\]', ' ', 'g')")}) AS said, coalesce(cited, []) AS cited, list_distinct({_terms('b.text')}) AS asked FROM benchmark b LEFT JOIN answered a ON a.qid = b.item_id LEFT JOIN cited c ON c.qid = b.item_id)
SELECT qid, round(CASE WHEN refused THEN 1.0 WHEN len(said) = 0 THEN 0.0 ELSE 1 - len(list_filter(said, lambda x: NOT list_contains(cited, x))) / len(said) END, 6) AS faithful, round(CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_intersect(asked, said)) / len(asked) END, 6) AS term_recall FROM t""",
    "latency_percentiles": "SELECT round(median(value), 6) AS p50, round(list_sort(list(value))[round_even(0.95 * (count(value) - 1), 0)::BIGINT + 1], 6) AS p95 FROM events WHERE value IS NOT NULL",
    "store_upsert": f"WITH {_CHANGED}, {_FIXED}, {_FIXED_ANEW} SELECT chunk_id, doc_id, md5(text) AS digest FROM fresh UNION ALL SELECT chunk_id, doc_id, md5(text) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh)",
    "store_delete": f"WITH {_FIXED} SELECT doc_id, count(*) AS n_chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY doc_id",
    "reindex_replace": f"WITH {_CHANGED}, {_FIXED_ANEW} SELECT chunk_id, doc_id, md5(text) AS digest FROM fresh",
    "dedupe_ids": "SELECT conv_id AS doc_id, turn AS seq, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
}
