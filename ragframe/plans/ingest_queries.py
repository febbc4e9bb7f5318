"""Scans, ingestion, corpus cleaning and retrieval: each query beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import tables, text as X
from ..operators import agent, book, etl, ingest, retrieve
from ..sources.shared import saved, shared_dir
from . import inputs as I

W = r"[^ \t\n\x0B\f\r]+"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _sql_rewrites(column: str) -> str:
    out = column
    for pattern, replacement in X.REWRITES:
        quoted = replacement.replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '(?m){pattern.replace(chr(92) + 'n', chr(92) + 'n')}', '{quoted}', 'g')"
    return out


def filter_mime(spark, d):
    return ingest.file_status(I.files(spark, d)).select("doc_id", "file_name", "mime", "status")


MIME_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest.MIME.items())
FILTER_MIME = f"""WITH {I.FILES}, typed AS (SELECT doc_id, file_name, CASE lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) {MIME_CASES} END AS mime FROM files)
SELECT *, CASE WHEN mime IS NULL THEN 'unknown' WHEN mime LIKE '%markdown%' THEN 'kept' ELSE 'unsupported' END AS status FROM typed"""


def read_md(spark, d):
    return I.table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


READ_MD = f"SELECT doc_id, len(regexp_extract_all(text, '{W}'))::BIGINT AS n_words FROM documents"


def open_store(spark, d):
    return I.models(spark, d).select("doc_id", X.store_path(F.col("source"), F.col("model")).alias("path"))


OPEN_STORE = f"WITH {I.MODELS} SELECT doc_id, source || '_' || replace(model, ':', '_') || '.db' AS path FROM models"


def skip_existing(spark, d):
    return ingest.skip_existing(I.md_files(spark, d), I.known_files(spark, d)).select("doc_id", "store", "file_hash")


MD = "md AS (SELECT doc_id, source AS store, 'doc_' || doc_id || '.md' AS file_name, sha256('doc_' || doc_id || '.md') AS file_hash, text FROM documents)"
SKIP_EXISTING = f"WITH {MD} SELECT doc_id, store, file_hash FROM md WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = md.doc_id)"


def known_existing(spark, d):
    return I.md_files(spark, d).join(I.known_files(spark, d).distinct(), ["store", "file_hash"], "left_semi").select("doc_id", "store")


KNOWN = f"WITH {MD} SELECT doc_id, store FROM md WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = md.doc_id)"


def name_hash(spark, d):
    return I.md_files(spark, d).select("doc_id", "file_name", "file_hash")


NAME_HASH = f"WITH {MD} SELECT doc_id, file_name, file_hash FROM md"


def _toc(spark, d):
    n, i = F.col("line_no"), F.col("doc_id").cast("string")
    ending = F.when(n % 3 == 0, "").when(n % 3 == 1, ".md").otherwise(".ipynb")
    entry = F.concat(F.lit("  - file: part/p"), i, F.lit("_"), n.cast("string"), ending, F.lit(" "))
    return I.lines(spark, d).select("doc_id", "line_no", F.when(n % 2 == 0, entry).otherwise(F.col("line")).alias("line"))


def scan_toc(spark, d):
    return etl.scan_toc(_toc(spark, d)).select("doc_id", "line_no", "path")


SCAN_TOC = f"""WITH {I.LINES}, toc AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN '  - file: part/p' || doc_id || '_' || line_no || (CASE line_no % 3 WHEN 0 THEN '' WHEN 1 THEN '.md' ELSE '.ipynb' END) || ' ' ELSE line END AS line FROM lines),
paths AS (SELECT doc_id, line_no, {TRIM.format("split_part(line, 'file:', 2)")} AS path FROM toc WHERE contains(line, 'file:'))
SELECT doc_id, line_no, CASE WHEN regexp_matches(path, '\\.[^/.]+$') THEN path ELSE path || '.md' END AS path FROM paths WHERE NOT contains(path, 'ipynb')"""


def default_suffix(spark, d):
    paths = I.files(spark, d).select("doc_id", F.regexp_replace("file_name", "txt$", "ipynb").alias("path"))
    return etl.default_suffix(paths)


DEFAULT_SUFFIX = f"""WITH {I.FILES}, p AS (SELECT doc_id, regexp_replace(file_name, 'txt$', 'ipynb') AS path FROM files)
SELECT doc_id, CASE WHEN regexp_matches(path, '\\.[^/.]+$') THEN path ELSE path || '.md' END AS path FROM p WHERE NOT contains(path, 'ipynb')"""


def scan_lines(spark, d):
    return I.lines(spark, d)


SCAN_LINES = f"WITH {I.LINES} SELECT doc_id, line_no::INT AS line_no, line FROM lines"


def _included(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("book/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


INCLUDED = "included AS (SELECT 'book/f' || doc_id || '.txt' AS path, text AS content FROM documents)"


def include_files(spark, d):
    marked = I.marked_lines(spark, d).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return etl.include_files(marked, _included(spark, d)).where("included").select("file_ord", "line_no", "line")


INCLUDE_FILES = f"""WITH {I.MARKED}, {INCLUDED},
inc AS (SELECT file_ord, line_no, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || {TRIM.format("split_part(line, '{literalinclude}', 2)")} AS place FROM marked WHERE contains(line, '{{literalinclude}}'))
SELECT file_ord, line_no::INT AS line_no, '```' || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '```' || chr(10) AS line FROM inc LEFT JOIN included ON place = included.path"""


def drop_prefix_lines(spark, d):
    return etl.drop_prefix_lines(I.marked_lines(spark, d)).select("file_ord", "line_no", "line")


DROPPED = " OR ".join(f"starts_with(line, '{p}')" for p in X.DROPPED_PREFIXES)
DROP_PREFIX = f"WITH {I.MARKED} SELECT file_ord, line_no::INT AS line_no, line FROM marked WHERE NOT ({DROPPED})"


def capture_anchors(spark, d):
    return etl.capture_anchors(etl.drop_prefix_lines(I.marked_lines(spark, d)))[1]


ANCHOR = "(starts_with({0}, '(') AND ends_with(" + TRIM.format("{0}") + ", ')='))"
REFS = f"""kept AS (SELECT * FROM marked WHERE NOT ({DROPPED})),
anchors AS (SELECT *, lead(line) OVER (PARTITION BY file_ord ORDER BY line_no) AS after FROM kept),
refs AS (
  SELECT ref, max_by(title, o) AS title FROM (
    SELECT '<' || regexp_extract(line, '^\\((.*)\\)=', 1) || '>' AS ref, '(see section: ' || {TRIM.format("replace(after, '#', '')")} || ')' AS title, file_ord * 1000000 + line_no AS o
    FROM anchors WHERE {ANCHOR.format("line")} AND after IS NOT NULL AND NOT {ANCHOR.format("after")}) GROUP BY ref)"""
CAPTURE_ANCHORS = f"WITH {I.MARKED}, {REFS} SELECT ref, title FROM refs"


def include_state(spark, d):
    return etl.include_state(I.marked_lines(spark, d)).select("file_ord", "line_no", "line", "closes")


INCLUDE_STATE = f"""WITH {I.MARKED}, kinds AS (SELECT *, CASE WHEN contains(line, '{{literalinclude}}') THEN 'include' WHEN contains(line, '```') THEN 'fence' END AS kind FROM marked),
st AS (SELECT *, coalesce(kind = 'fence' AND last_value(kind IGNORE NULLS) OVER (PARTITION BY file_ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'include', false) AS closes FROM kinds)
SELECT file_ord, line_no::INT AS line_no, CASE WHEN closes THEN '' ELSE line END AS line, closes FROM st"""


def split_by_path(spark, d):
    return etl.split_by_path(I.marked_lines(spark, d)).groupBy("kind", "path").agg(F.count("*").alias("n_lines"))


SPLIT_BY_PATH = f"WITH {I.MARKED} SELECT CASE WHEN contains(path, 'Schemas/') THEN 'schema' ELSE 'main' END AS kind, path, count(*) AS n_lines FROM marked GROUP BY ALL"


def concat_ordered(spark, d):
    return etl.concat_ordered(I.marked_lines(spark, d), ("file_ord",), ("line_no",))


CONCAT = "texts AS (SELECT file_ord, string_agg(line, chr(10) ORDER BY line_no) AS text FROM marked GROUP BY file_ord)"
CONCAT_ORDERED = f"WITH {I.MARKED}, {CONCAT} SELECT * FROM texts"


def regex_rewrites(spark, d):
    return concat_ordered(spark, d).select("file_ord", X.regex_rewrites(F.col("text")).alias("text"))


REWRITTEN = f"rewritten AS (SELECT file_ord, {_sql_rewrites('text')} AS text FROM texts)"
REGEX_REWRITES = f"WITH {I.MARKED}, {CONCAT}, {REWRITTEN} SELECT * FROM rewritten"


def resolve_refs(spark, d):
    _, refs = etl.capture_anchors(etl.drop_prefix_lines(I.marked_lines(spark, d)))
    return etl.resolve_refs(regex_rewrites(spark, d), refs, "file_ord")


RESOLVE_REFS = f"""WITH {I.MARKED}, {REFS}, {CONCAT}, {REWRITTEN},
names AS (SELECT file_ord, unnest(list_distinct(regexp_extract_all(text, '<[^<>\\s]+>'))) AS ref FROM rewritten),
pairs AS (SELECT file_ord, list(ref || chr(1) || title ORDER BY ref) AS ps FROM names JOIN refs USING (ref) GROUP BY file_ord)
SELECT r.file_ord, CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend(text, ps), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) END AS text
FROM rewritten r LEFT JOIN pairs p ON r.file_ord = p.file_ord"""


def single_markdown(spark, d):
    """The whole cleaning, page by page."""
    return etl.single_markdown(I.marked_lines(spark, d), _included(spark, d))


SINGLE = f"""WITH {I.MARKED}, {INCLUDED}, {REFS},
plain AS (SELECT file_ord, path, line_no, line, CASE WHEN contains(line, '{{literalinclude}}') THEN 'include' WHEN contains(line, '```') THEN 'fence' END AS state FROM kept WHERE NOT {ANCHOR.format("line")}),
closed AS (SELECT *, coalesce(state = 'fence' AND last_value(state IGNORE NULLS) OVER (PARTITION BY file_ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'include', false) AS closes FROM plain),
filled AS (
  SELECT file_ord, c.path, line_no, CASE WHEN closes THEN '' WHEN state = 'include' THEN '```' || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '```' || chr(10) ELSE line END AS line
  FROM closed c LEFT JOIN included i ON state = 'include' AND regexp_extract(c.path, '^(.*)/[^/]*$', 1) || '/' || {TRIM.format("split_part(line, '{literalinclude}', 2)")} = i.path),
texts AS (SELECT file_ord, path, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text FROM filled GROUP BY file_ord, path),
rewritten AS (SELECT file_ord, path, t[1:length(t) - 1] AS text FROM (SELECT file_ord, path, {_sql_rewrites('text')} AS t FROM texts)),
names AS (SELECT file_ord, unnest(list_distinct(regexp_extract_all(text, '<[^<>\\s]+>'))) AS ref FROM rewritten),
pairs AS (SELECT file_ord, list(ref || chr(1) || title ORDER BY ref) AS ps FROM names JOIN refs USING (ref) GROUP BY file_ord)
SELECT CASE WHEN contains(path, 'Schemas/') THEN 'schema' ELSE 'main' END AS kind, r.file_ord, path,
  CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend(text, ps), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) END AS text
FROM rewritten r LEFT JOIN pairs p ON r.file_ord = p.file_ord"""


def pages_updated(spark, d):
    """The pages cleaned once, then kept up to date with edits of one in a hundred."""
    lines, files, pages = I.marked_lines(spark, d), _included(spark, d), book.Book(spark, f"{shared_dir(spark)}/book-{uuid.uuid4().hex}")
    pages.update(lines, files)
    edited = F.col("file_ord") % 100 == 2
    now = lines.withColumn("line", F.when(edited & (F.col("line_no") % 17 == 9), F.concat("line", F.lit(" edited"))).otherwise(F.col("line")))
    pages.update(now, files, lines.where(edited).select("file_ord").distinct())
    return pages.pages()


_EDITED = I.MARKED.replace("marked AS (", "first_marked AS (") + ", marked AS (SELECT file_ord, path, line_no, CASE WHEN file_ord % 100 = 2 AND line_no % 17 = 9 THEN line || ' edited' ELSE line END AS line FROM first_marked)"
UPDATED = SINGLE.replace(I.MARKED, _EDITED)


def split_headers(spark, d):
    lines = I.marked_lines(spark, d).select("file_ord", "line_no", "line")
    return ingest.split_headers(lines, "file_ord").select("file_ord", F.col("section").cast("long").alias("section"), "h1", "h2", "h3", "h4", "text")


_UP = "OVER (PARTITION BY file_ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LEVELS = ", ".join(f"last_value(CASE WHEN level = {n} THEN line_no END IGNORE NULLS) {_UP} AS o{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) {_UP} AS t{n}, last_value(CASE WHEN level < {n} THEN line_no END IGNORE NULLS) {_UP} AS a{n}" for n in range(1, 5))
_HEADS = ", ".join(f"CASE WHEN a{n} IS NULL OR o{n} > a{n} THEN t{n} END AS h{n}" for n in range(1, 5))
SPLIT_HEADERS = f"""WITH {I.MARKED},
fences AS (SELECT *, starts_with(line, '```') AS fence, coalesce(sum(starts_with(line, '```')::INT) OVER (PARTITION BY file_ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM marked),
levels AS (SELECT *, CASE WHEN NOT fence AND NOT inside THEN nullif(length(regexp_extract(line, '^(#{{1,4}}) ', 1)), 0) END AS level FROM fences),
titles AS (SELECT *, trim(substr(line, level + 2)) AS title FROM levels),
carried AS (SELECT *, count(level) {_UP} AS section, {_LEVELS} FROM titles),
headed AS (SELECT file_ord, line_no, line, section, {_HEADS} FROM carried)
SELECT file_ord, section, h1, h2, h3, h4, string_agg(line, chr(10) ORDER BY line_no) AS text FROM headed GROUP BY file_ord, section, h1, h2, h3, h4"""


def chunk_text(spark, d):
    return ingest.chunk_fixed(I.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_ix", "chunk")


CHUNKS = "chunked AS (SELECT doc_id, source, i::INT AS chunk_ix, substr(text, i * 540 + 1, 600) AS chunk FROM (SELECT *, unnest(range(0, floor(greatest(0, length(text) - 61) / 540.0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0))"
CHUNK_TEXT = f"WITH {CHUNKS} SELECT doc_id, chunk_ix, chunk FROM chunked"


def split_headers_fenced(spark, d):
    """Headings outside fences that open and close."""
    pages = concat_ordered(spark, d)
    return ingest.split_headers_fenced(pages, "file_ord").withColumn("section", F.col("section").cast("long"))


_FENCE = "'^ {0,3}(`{3,}|~{3,})'"
FENCED = f"""WITH RECURSIVE {I.MARKED},
marks AS (SELECT file_ord, line_no, regexp_extract(line, {_FENCE}, 1) AS fence, length(trim(regexp_replace(line, {_FENCE}, ''), chr(32) || chr(9) || chr(13))) = 0 AS bare, row_number() OVER (PARTITION BY file_ord ORDER BY line_no) AS nth FROM marked WHERE regexp_matches(line, {_FENCE})),
walk AS (SELECT file_ord, line_no, nth, fence AS open FROM marks WHERE nth = 1
  UNION ALL SELECT m.file_ord, m.line_no, m.nth, CASE WHEN w.open = '' THEN m.fence WHEN m.fence[1] = w.open[1] AND length(m.fence) >= length(w.open) AND m.bare THEN '' ELSE w.open END FROM walk w JOIN marks m ON m.file_ord = w.file_ord AND m.nth = w.nth + 1),
inside AS (SELECT l.*, coalesce(last_value(open IGNORE NULLS) OVER (PARTITION BY l.file_ord ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') <> '' AS inside FROM marked l LEFT JOIN walk w ON w.file_ord = l.file_ord AND w.line_no = l.line_no),
levels AS (SELECT *, CASE WHEN NOT inside THEN nullif(length(regexp_extract(line, '^(#{{1,4}}) ', 1)), 0) END AS level FROM inside),
titles AS (SELECT *, {TRIM.format('substr(line, level + 1)')} AS title FROM levels),
carried AS (SELECT *, count(level) {_UP} AS section, {_LEVELS} FROM titles),
headed AS (SELECT file_ord, line_no, line, section, {_HEADS} FROM carried)
SELECT file_ord, section, h1, h2, h3, h4, string_agg(line, chr(10) ORDER BY line_no) AS text FROM headed GROUP BY file_ord, section, h1, h2, h3, h4"""


def sections_table(spark, d):
    """The same by the table function, from a SQL text."""
    tables.register(spark)
    I.marked_lines(spark, d).select("file_ord", "line_no", "line").createOrReplaceTempView("ragframe_lines")
    return spark.sql("SELECT * FROM sections(TABLE(ragframe_lines), 'file_ord')")


def chunk_boundary(spark, d):
    return ingest.chunk_boundary(I.table(spark, d, "documents"), "doc_id")


def _cut(sep: str) -> str:
    """Where the last separator in the window from lo ends; null without one."""
    w, n = "substr(text, lo + 1, hard - lo)", len(sep)
    s = f"'{sep}'" if sep == " " else " || ".join(["chr(10)"] * n)
    return f"CASE WHEN hard > lo AND contains({w}, {s}) THEN lo + length({w}) - instr(reverse({w}), {s}) + 1 END"


_SIZE, _OVER = DEFAULT.chunk_size, DEFAULT.chunk_overlap
_ENDED = f"CASE WHEN hard < length(text) THEN coalesce({_cut(chr(10) * 2)}, {_cut(chr(10))}, {_cut(' ')}, hard) ELSE hard END"
_PIECE = f"SELECT doc_id, text, i, since, {_ENDED} AS stop FROM (SELECT *, least(length(text), since + {_SIZE}) AS hard, since + {_OVER} + 1 AS lo FROM {{}})"
BOUNDARY = f"""WITH RECURSIVE pieces AS (
  {_PIECE.format("(SELECT doc_id, text, 0 AS i, 0::BIGINT AS since FROM documents WHERE length(text) > 0)")}
  UNION ALL
  {_PIECE.format("(SELECT doc_id, text, i + 1 AS i, CASE WHEN contains(back, ' ') THEN early + instr(back, ' ') ELSE stop END AS since FROM (SELECT doc_id, text, i, stop, early, substr(text, early + 1, stop - early) AS back FROM (SELECT *, greatest(since + 1, stop - " + str(_OVER) + ") AS early FROM pieces WHERE stop < length(text))))")})
SELECT doc_id, i::INT AS chunk_ix, substr(text, since + 1, stop - since) AS chunk FROM pieces"""


def boundary_table(spark, d):
    """The same by the table function, from a SQL text."""
    tables.register(spark)
    I.table(spark, d, "documents").createOrReplaceTempView("ragframe_documents")
    return spark.sql(f"SELECT doc_id, c.chunk_ix, c.chunk FROM ragframe_documents, LATERAL boundary_chunks(text, {_SIZE}, {_OVER}) c")


def tool_functions(spark, d):
    """Tools called from a SQL text."""
    tables.register(spark)
    I.table(spark, d, "pages").createOrReplaceTempView("ragframe_pages")
    return spark.sql("SELECT page_id, echo_tool(url) AS echoed, model_template_tool(concat('My Model ', page_id)) AS made FROM ragframe_pages")


TOOL_FUNCTIONS = """SELECT page_id, 'I got ' || url AS echoed, 'document = Document(id="MyModel' || page_id || '")' || chr(10) || 'network = document.add(Network(id="MyModel' || page_id || '_network"))' || chr(10) AS made FROM pages"""


def attach_metadata(spark, d):
    c = ingest.chunk_fixed(I.table(spark, d, "documents").select("doc_id", "source", "text"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return ingest.attach_metadata(c, name, F.concat(F.lit("sources/"), F.col("source"), F.lit("/"), name)).select("doc_id", "chunk_ix", "file_hash", "file_name", "file_path")


ATTACH = f"WITH {CHUNKS}, named AS (SELECT *, 'doc_' || doc_id || '.md' AS file_name FROM chunked) SELECT doc_id, chunk_ix, sha256(file_name) AS file_hash, file_name, 'sources/' || source || '/' || file_name AS file_path FROM named"
TOKENS = "list_filter(string_split_regex(lower({}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def embed(spark, d):
    """Token counts by bucket of the hashing embedder."""
    t = I.table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", X.bucket(F.col("t"), DEFAULT.dim).alias("bucket")).agg(F.count("*").alias("n"))


BUCKETS = f"buckets AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {DEFAULT.dim})::INT AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY ALL)"
EMBED = f"WITH {BUCKETS} SELECT * FROM buckets"


def embed_vectors(spark, d):
    e = ingest.embed(I.table(spark, d, "documents").select("doc_id", "text")).where(F.col("embedding").isNotNull())
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("x > 0").select("doc_id", "bucket", F.round("x", 6).alias("x"))


EMBED_VECTORS = f"WITH {BUCKETS} SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM buckets"


def normalize_model_name(spark, d):
    return I.models(spark, d).select("doc_id", X.normalize_model_name(F.col("model")).alias("name"))


_HOSTED = "string_split(replace(replace(replace(model, 'huggingface:', ''), ':cheapest', ''), ':fastest', ''), '/')"
NORMALIZE = f"WITH {I.MODELS} SELECT doc_id, CASE WHEN starts_with(lower(model), 'huggingface:') THEN array_to_string({_HOSTED}[2:], '') WHEN starts_with(lower(model), 'ollama:') THEN replace(model, 'ollama:', '') ELSE model END AS name FROM models"


# retrieval


def vector_topk(spark, d):
    return retrieve.vector_topk(*I.vectors(spark, d))


TOPK = f"""scored AS (SELECT q.vec_id AS qid, e.label AS store, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % {I.EVERY} = 0),
topk AS (SELECT *, row_number() OVER (PARTITION BY qid, store ORDER BY score DESC, chunk_id)::INT AS rank FROM scored WHERE score >= {DEFAULT.threshold} QUALIFY rank <= {DEFAULT.k})"""
VECTOR_TOPK = f"WITH {TOPK} SELECT * FROM topk"


def union_stores(spark, d):
    questions, chunks = I.vectors(spark, d)
    hits = [retrieve.vector_topk(questions, chunks.where(F.col("store") % 2 == i)) for i in (0, 1)]
    return retrieve.union_stores(hits).select("qid", "store", "chunk_id", "score")


UNION = f"WITH {TOPK} SELECT qid, store, chunk_id, score FROM topk WHERE store % 2 = 0 UNION ALL SELECT qid, store, chunk_id, score FROM topk WHERE store % 2 = 1"


def rerank_topn(spark, d):
    return retrieve.rerank_topn(vector_topk(spark, d))


RERANK = f"{TOPK}, best AS (SELECT qid, store, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, store, chunk_id)::INT AS rank FROM topk QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, store, chunk_id) <= {DEFAULT.max_references})"
RERANK_TOPN = f"WITH {RERANK} SELECT * FROM best"


def rank_number(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return agent.rank_number(docs, "source", F.desc("n_chars"), F.col("doc_id"))


RANK_NUMBER = "SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents"


def _reference_log(spark, d):
    m = I.messages(spark, d).where("role = 'user'")
    return m.select("conv_id", F.col("turn").alias("seq"), F.split_part("text", F.lit(" "), F.lit(1)).alias("retrieval_query"), F.col("text").alias("hits"))


def upsert_reference(spark, d):
    return retrieve.upsert_reference(_reference_log(spark, d))


UPSERT = "SELECT conv_id, split_part(text, ' ', 1) AS retrieval_query, min(turn) AS first_seq, max_by(text, turn) AS hits FROM conversations WHERE role = 'user' GROUP BY ALL"


def adapt_k(spark, d):
    k = F.col("k")
    return I.grades(spark, d).select("l_orderkey", "l_linenumber", retrieve.adapted_k(k).cast("int").alias("k"), retrieve.can_adapt(k).alias("more"))


ADAPT = f"WITH {I.GRADES} SELECT l_orderkey, l_linenumber, least(k + 1, {DEFAULT.k_max})::INT AS k, k + 1 <= {DEFAULT.k_max} AS more FROM grades"


def header_fields(spark, d):
    return split_headers(spark, d).select("file_ord", "section", retrieve.header_fields("h1", "h2", "h3", "h4").alias("fields"))


_FIELDS = "concat_ws(' | ', " + ", ".join(f"'Header {n}: ' || h{n}" for n in range(1, 5)) + ")"
HEADER_FIELDS = f"SELECT file_ord, section, {_FIELDS} AS fields FROM ({SPLIT_HEADERS})"


def serialize_context(spark, d):
    """Each question's hits over the documents of the same ids, with braces in the text."""
    best = rerank_topn(spark, d)
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("{"), "text", F.lit("}")).alias("text"), F.concat(F.lit("Header 1: "), F.col("source")).alias("fields"))
    hits = best.join(docs, "chunk_id").select("qid", (F.col("rank") % 2).alias("query_seq"), F.concat(F.lit("query "), F.col("rank") % 2).alias("retrieval_query"), "rank", "fields", "text")
    return retrieve.serialize_context(hits, "qid")


SERIALIZE = f"""WITH {RERANK},
hits AS (SELECT qid, rank % 2 AS query_seq, rank, '{{' || text || '}}' AS text, 'Header 1: ' || source AS fields, count(*) OVER (PARTITION BY qid, rank % 2) AS n FROM best JOIN documents ON doc_id = chunk_id),
parts AS (SELECT qid, query_seq, '## query ' || query_seq || chr(10) || string_agg(chr(10) || chr(10) || '### Document ' || rank || '/' || n || ': ' || fields || chr(10) || chr(10) || ':' || text, '' ORDER BY rank) AS part FROM hits GROUP BY qid, query_seq)
SELECT qid, replace(replace(string_agg(part, '' ORDER BY query_seq), '{{', '{{{{'), '}}', '}}}}') AS context FROM parts GROUP BY qid"""


def answer_from_context(spark, d):
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = I.vectors(spark, d)[1].drop("embedding").join(docs, "chunk_id")
    return agent.answer_from_context(rerank_topn(spark, d), chunks)


ANSWER = f"WITH {RERANK} SELECT qid, text AS answer FROM best JOIN documents ON doc_id = chunk_id WHERE rank = 1"


def text_retrieval(spark, d):
    """Text in, hits out: questions and chunks by the hashing embedder."""
    chunks = saved(ingest.embed(I.chunks(spark, d)).select("store", "chunk_id", "embedding"), "chunks")
    asked = I.questions(spark, d).select("qid", X.hashed_vector(F.col("query"), DEFAULT.dim).alias("embedding"))
    return retrieve.rerank_topn(retrieve.vector_topk(asked, chunks, reach=(DEFAULT.k, DEFAULT.max_references)))


_BUCKET = "(('0x' || substr(md5(t), 1, 8))::BIGINT % " + f"{DEFAULT.dim})::INT"
TEXT_RETRIEVAL = f"""WITH {I.QUESTIONS_SQL}, {CHUNKS},
c AS (SELECT source AS store, doc_id * 1000000 + chunk_ix AS chunk_id, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT source, doc_id, chunk_ix, unnest({TOKENS.format('chunk')}) AS t FROM chunked) GROUP BY ALL),
q AS (SELECT qid, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT qid, unnest({TOKENS.format('query')}) AS t FROM questions) GROUP BY ALL),
cn AS (SELECT store, chunk_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM q GROUP BY ALL),
dots AS (SELECT qid, store, chunk_id, sum(q.n * c.n) AS dot FROM q JOIN c USING (bucket) GROUP BY ALL),
scored AS (SELECT qid, store, chunk_id, round(dot / (qn.norm * cn.norm), 6) AS score FROM dots JOIN qn USING (qid) JOIN cn USING (store, chunk_id)),
topk AS (SELECT * FROM scored WHERE score >= {DEFAULT.threshold} QUALIFY row_number() OVER (PARTITION BY qid, store ORDER BY score DESC, chunk_id) <= {DEFAULT.k})
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, store, chunk_id)::INT AS rank FROM topk QUALIFY rank <= {DEFAULT.max_references}"""


def retrieval_quality(spark, d):
    """Derived, not of the reference: recall at 5 and reciprocal rank of hits that share the question's label."""
    e = I.table(spark, d, "embeddings")
    q, c = I.vectors(spark, d)
    hits = retrieve.vector_topk(q, c.withColumn("store", F.lit(0)), 6, -1.0).where("qid <> chunk_id")
    ranked = agent.rank_number(hits.drop("rank"), "qid", F.desc("score"), F.col("chunk_id")).where("rank <= 5")
    lab = e.select(F.col("vec_id").alias("chunk_id"), "label")
    own = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("own"))
    x = ranked.join(lab, "chunk_id").join(F.broadcast(own.where(F.col("qid") % I.EVERY == 0)), "qid")
    return x.groupBy("qid").agg(F.count_if(F.col("label") == F.col("own")).alias("n_same"), F.coalesce(F.round(1.0 / F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))), 6), F.lit(0.0)).alias("reciprocal_rank"))


QUALITY = f"""WITH s AS (SELECT q.vec_id AS qid, q.label AS own, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {I.EVERY} = 0 QUALIFY rank <= 5)
SELECT qid, count(*) FILTER (WHERE label = own) AS n_same, coalesce(round(1.0 / min(rank) FILTER (WHERE label = own), 6), 0.0) AS reciprocal_rank FROM s GROUP BY qid"""

QUERIES = {
    "filter_mime": (filter_mime, FILTER_MIME), "read_md": (read_md, READ_MD), "open_store": (open_store, OPEN_STORE), "skip_existing": (skip_existing, SKIP_EXISTING), "known_existing": (known_existing, KNOWN), "name_hash": (name_hash, NAME_HASH),
    "scan_toc": (scan_toc, SCAN_TOC), "default_suffix": (default_suffix, DEFAULT_SUFFIX), "scan_lines": (scan_lines, SCAN_LINES), "include_files": (include_files, INCLUDE_FILES), "drop_prefix_lines": (drop_prefix_lines, DROP_PREFIX),
    "capture_anchors": (capture_anchors, CAPTURE_ANCHORS), "include_state": (include_state, INCLUDE_STATE), "split_by_path": (split_by_path, SPLIT_BY_PATH), "concat_ordered": (concat_ordered, CONCAT_ORDERED), "regex_rewrites": (regex_rewrites, REGEX_REWRITES),
    "resolve_refs": (resolve_refs, RESOLVE_REFS), "single_markdown": (single_markdown, SINGLE), "pages_updated": (pages_updated, UPDATED), "split_headers": (split_headers, SPLIT_HEADERS), "chunk_text": (chunk_text, CHUNK_TEXT), "attach_metadata": (attach_metadata, ATTACH), "split_headers_fenced": (split_headers_fenced, FENCED), "chunk_boundary": (chunk_boundary, BOUNDARY), "sections_table": (sections_table, FENCED), "boundary_table": (boundary_table, BOUNDARY), "tool_functions": (tool_functions, TOOL_FUNCTIONS), "embed": (embed, EMBED),
    "embed_vectors": (embed_vectors, EMBED_VECTORS), "normalize_model_name": (normalize_model_name, NORMALIZE), "vector_topk": (vector_topk, VECTOR_TOPK), "union_stores": (union_stores, UNION), "rerank_topn": (rerank_topn, RERANK_TOPN), "rank_number": (rank_number, RANK_NUMBER),
    "upsert_reference": (upsert_reference, UPSERT), "adapt_k": (adapt_k, ADAPT), "header_fields": (header_fields, HEADER_FIELDS), "serialize_context": (serialize_context, SERIALIZE), "answer_from_context": (answer_from_context, ANSWER), "text_retrieval": (text_retrieval, TEXT_RETRIEVAL),
    "retrieval_quality": (retrieval_quality, QUALITY),
}
