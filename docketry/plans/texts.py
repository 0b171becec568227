"""Queries that run text operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketry.operators import textops as T
from docketry.operators.documents import blocks_of_lines, blocks_of_pages, chunk_documents, heading_trails, merge_runs, word_lines
from docketry.operators.maintenance import once
from docketry.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
L = "WITH l AS (SELECT DISTINCT ON (id) id, question, answer FROM chat_logs) "
_MARKDOWN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[([^\]\d][^\]]*)\]\((https?://[^)\s]+)\)', '\1 (\2)', 'g'),
 '\*\*(\S|\S[^*]*?\S)\*\*', '\1', 'g'), '__(\S|\S[^_]*?\S)__', '\1', 'g'), '`+([^`\n]+)`+', '\1', 'g'), '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+', '', 'g'), '(?m)^([ \t]*)[*+][ \t]+', '\1- ', 'g'), '(^|[^\w*])\*([^\s*]|[^\s*][^*\n]*?[^\s*])\*($|[^\w*])', '\1\2\3', 'g'), '(?m)^([ \t]*\d+[.)])[ \t]{{2,}}', '\1 ', 'g')"""
_NAMED = "^(?:" + "|".join(T.WEEKDAYS_AND_MONTHS) + ")$"
#: The pieces between dashes, each with what stands to its left and right in the whole text.
_DASHES = r"""p AS (SELECT id, text, regexp_split_to_array(text, '[—–]') AS p FROM {0}),
 e AS (SELECT id, text, p, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
 s AS (SELECT id, text, len(p) AS n, i, piece, array_to_string(p[1:i], '—') AS l, array_to_string(p[i + 1:], '—') AS r, p[i + 1] AS following FROM e),
 b AS (SELECT id, text, n, i, piece, CASE WHEN i = n THEN '' WHEN (regexp_matches(regexp_extract(l, '((?:[^\s\p{{Z}}]+[\s\p{{Z}}]+)?[^\s\p{{Z}}]+)[\s\p{{Z}}]*$', 1), '\d') AND regexp_matches(regexp_extract(r, '^[\s\p{{Z}}]*([^\s\p{{Z}}]+(?:[\s\p{{Z}}]+[^\s\p{{Z}}]+)?)', 1), '\d'))
   OR (regexp_matches(lower(regexp_replace(regexp_extract(l, '([^\s\p{{Z}}]+)[\s\p{{Z}}]*$', 1), '[^\w]+', '', 'g')), '{1}') AND regexp_matches(lower(regexp_replace(regexp_extract(r, '^[\s\p{{Z}}]*([^\s\p{{Z}}]+)', 1), '[^\w]+', '', 'g')), '{1}'))
   THEN CASE WHEN regexp_matches(piece, '[\s\p{{Z}}]$') OR regexp_matches(following, '^[\s\p{{Z}}]') THEN ' to ' ELSE '-' END ELSE ', ' END AS dash FROM s),
 x AS (SELECT id, CASE WHEN max(n) < 2 THEN max(text) ELSE string_agg(CASE WHEN i = 1 THEN regexp_replace(piece, '[\s\p{{Z}}]+$', '') WHEN i = n THEN regexp_replace(piece, '^[\s\p{{Z}}]+', '') ELSE regexp_replace(piece, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') END || dash, '' ORDER BY i) END AS text FROM b GROUP BY id)"""
#: Marks as a model leaves them, added to stored answers so that every operator has something to do.
TAIL = " <think>no</think> See [1, 3-5], [2] and [the sheet](https://a.example/x) ."


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def logs(spark: SparkSession, d: str):
    return once(table(spark, d, "chat_logs").select("id", "question", "answer"), "id")


def answers(spark: SparkSession, d: str):
    return logs(spark, d).where("answer IS NOT NULL").select("id", F.concat("answer", F.lit(TAIL)).alias("answer"))


@query()
def t01_masked_questions(spark, d):
    q = logs(spark, d).where("question IS NOT NULL").withColumn("details", T.personal_details(F.col("question")))
    return q.select("id", T.mask(F.col("question"), F.col("details")).alias("masked"), F.size("details").alias("details"))


@query()
def t02_masked_answers(spark, d):
    """Answers rid of what the question gave away, and of nothing else."""
    q = logs(spark, d).where("question IS NOT NULL AND answer IS NOT NULL")
    return q.select("id", T.mask(F.col("answer"), T.personal_details(F.col("question"))).alias("masked"))


@query(L + f"SELECT id, trim(regexp_replace(answer || '{TAIL}', '<think>.*?</think>', '', 'gs')) AS text FROM l WHERE answer IS NOT NULL")
def t12_strip_thinking(spark, d):
    return answers(spark, d).select("id", T.strip_thinking(F.col("answer")).alias("text"))


_MARKED = "'## Note' || chr(10) || '* **Fee** and `code`' || chr(10) || '1)  step *one*' || chr(10) || answer || '" + TAIL + "'"


@query(L + f"SELECT id, {_MARKDOWN.format(_MARKED)} AS text FROM l WHERE answer IS NOT NULL")
def t13_strip_markdown(spark, d):
    return answers(spark, d).select("id", T.strip_markdown(F.concat(F.lit("## Note\n* **Fee** and `code`\n1)  step *one*\n"), "answer")).alias("text"))


@query(L + f", a AS (SELECT id, 'Open Monday – Friday, 10–15 days — always. ' || answer || '{TAIL}' AS text FROM l WHERE answer IS NOT NULL), " + _DASHES.format("a", _NAMED) + " SELECT id, text FROM x")
def t14_rewrite_dashes(spark, d):
    return answers(spark, d).select("id", T.rewrite_dashes(F.concat(F.lit("Open Monday – Friday, 10–15 days — always. "), "answer")).alias("text"))


def cited(spark: SparkSession, d: str):
    """Answers with grouped and single marks whose numbers follow from the row's id."""
    l, k = logs(spark, d).where("answer IS NOT NULL"), F.col("id")
    marks = F.concat(F.lit(" See ["), (k % 4).cast("string"), F.lit(", "), (k % 7).cast("string"), F.lit("-"), (k % 7 + k % 30).cast("string"), F.lit("] and ["), (k % 5).cast("string"), F.lit("] ["), (k % 3).cast("string"), F.lit("]"))
    return l.select("id", F.concat("answer", marks).alias("answer"))


_CITED = "CASE WHEN b - a = 0 THEN '[' || a || '][' || a || ']' WHEN b - a BETWEEN 1 AND 20 THEN '[' || array_to_string(range(a, b + 1), '][') || ']' ELSE '[' || a || '][' || b || ']' END"


@query(L + f", k AS (SELECT id, answer, id % 4 AS one, id % 7 AS a, id % 7 + id % 30 AS b FROM l WHERE answer IS NOT NULL) SELECT id, answer || ' See [' || one || ']' || {_CITED} || ' and [' || id % 5 || '] [' || id % 3 || ']' AS text FROM k")
def t15_expand_citations(spark, d):
    return cited(spark, d).select("id", T.expand_citations(F.col("answer")).alias("text"))


@query(L + r"""SELECT id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS cited FROM (SELECT id, regexp_extract_all(answer || ' See [' || id % 4 || ', ' || id % 7 || '-' || (id % 7 + id % 30) || '] and [' || id % 5 || '] [' || id % 3 || ']', '\[(\d+)\]', 1) AS m FROM l WHERE answer IS NOT NULL)""")
def t16_cited(spark, d):
    return cited(spark, d).select("id", F.array_join(T.cited_indices(F.col("answer")).cast("array<string>"), ",").alias("cited"))


@query(L + r"SELECT id, regexp_replace(regexp_replace(answer || ' See [1], [2] now .', '\s*\[\d+\](?:\s*,?\s*\[\d+\])*', '', 'g'), '[ \t]+([.,;:!?])', '\1', 'g') AS text FROM l WHERE answer IS NOT NULL")
def t17_strip_citations(spark, d):
    return logs(spark, d).where("answer IS NOT NULL").select("id", T.strip_citations(F.concat("answer", F.lit(" See [1], [2] now ."))).alias("text"))


@query(L + r"SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(question, '^\s+|\s+$', '', 'g')), '[?.! ]+$', ''), '\s+', ' ', 'g') AS norm FROM l")
def t26_normal_questions(spark, d):
    return logs(spark, d).select("id", T.normal_question(F.col("question")).alias("norm"))


@query(L + r"SELECT id, regexp_replace(regexp_replace(question, '(?i)\s*\[dot\]\s*', '.', 'g'), '(?i)\s*\[at\]\s*', '@', 'g') AS text FROM l")
def t27_deobfuscated(spark, d):
    return logs(spark, d).select("id", T.deobfuscate_emails(F.col("question")).alias("text"))


@query(L + f", m AS (SELECT id, regexp_replace('Open 9 – 12, see __all__ (https://b.example/y) [3]' || chr(10) || answer || '{TAIL}', '\\s*\\[\\d+\\]', '', 'g') AS t FROM l WHERE answer IS NOT NULL), a AS (SELECT id, regexp_replace(regexp_replace({_MARKDOWN.format('t')}, '(?i)\\bhttps?://\\S+', '', 'g'), '\\(\\s*\\)', '', 'g') AS text FROM m), " + _DASHES.format("a", _NAMED) + r" SELECT id, trim(regexp_replace(regexp_replace(text, '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) AS text FROM x")
def t29_for_speech(spark, d):
    return answers(spark, d).select("id", T.strip_for_speech(F.concat(F.lit("Open 9 – 12, see __all__ (https://b.example/y) [3]\n"), "answer")).alias("text"))


@query(L + r""", p AS (SELECT id, string_split(regexp_replace(trim(answer), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM l WHERE answer IS NOT NULL),
 e AS (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM p),
 n AS (SELECT id, s, i, sum(len(list_filter(regexp_split_to_array(trim(s), '[\s\p{Z}]+'), lambda w: w <> ''))) OVER (PARTITION BY id ORDER BY i) AS upto FROM e)
 SELECT id, trim(string_agg(s, ' ' ORDER BY i)) AS text FROM n WHERE i = 1 OR upto <= 20 GROUP BY id""")
def t30_first_sentences(spark, d):
    return logs(spark, d).where("answer IS NOT NULL").select("id", T.first_sentences(F.col("answer"), 20).alias("text"))


@query(r"WITH c AS (SELECT DISTINCT ON (id) id, chunk_text FROM chunks), e AS (SELECT id, unnest(string_split(chunk_text, chr(10))) AS line, generate_subscripts(string_split(chunk_text, chr(10)), 1) - 1 AS line_no FROM c) SELECT id, line_no::INT AS line_no, nullif(regexp_extract(line, '^([•●■\-*]|\d+[.)]|\([a-zA-Z0-9]+\)|[a-zA-Z][.)])\s+(.+)$', 1), '') AS marker FROM e")
def t34_list_markers(spark, d):
    """The list marker of every line."""
    c = once(table(spark, d, "chunks").select("id", "chunk_text"), "id").select("id", F.posexplode(F.split("chunk_text", "\n")).alias("line_no", "line"))
    return c.select("id", "line_no", T.list_marker(F.col("line"))[0].alias("marker"))


@query(r"SELECT id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1), ''), 'index') AS file_name FROM sources")
def t35_file_names(spark, d):
    return table(spark, d, "sources").select("id", T.file_name(F.col("url")).alias("file_name"))


@query("SELECT id, epoch_us(date_trunc('second', created_at)) AS at FROM sources")
def t36_http_dates(spark, d):
    stamp = F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss")
    return table(spark, d, "sources").select("id", F.unix_micros(T.http_date(F.concat(stamp, F.lit(" GMT")))).alias("at"))


@query(L + "SELECT id, CASE WHEN length(question) > 80 THEN left(question, 80) || '...' ELSE question END AS subject FROM l")
def t37_subjects(spark, d):
    return logs(spark, d).select("id", T.subject(F.col("question")).alias("subject"))


@query(L + r"SELECT id, len(regexp_extract_all(answer, '(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)? (?:crowns|dollars))')) AS money, len(regexp_extract_all(answer, '(?i)\d+(?:\s*(?:-|to)\s*\d+)? (?:working |business )?(?:day|week|month|year|hour|minute)s?')) AS spans FROM l WHERE answer IS NOT NULL")
def t38_amounts(spark, d):
    return logs(spark, d).where("answer IS NOT NULL").select("id", F.size(T.money_values(F.col("answer"))).cast("long").alias("money"), F.size(T.duration_values(F.col("answer"))).cast("long").alias("spans"))


@query(r"""WITH u AS (SELECT id, url, regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS part, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '') AS host FROM sources),
 l AS (SELECT *, trim(regexp_replace(regexp_replace(url_decode(part), '(?i)\.(?:html?|php|aspx?|pdf)$', ''), '[-_]+', ' ', 'g')) AS label FROM u)
 SELECT id, CASE WHEN label <> '' THEN label WHEN host <> '' THEN host ELSE url END AS label FROM l""")
def t41_source_labels(spark, d):
    return table(spark, d, "sources").select("id", T.source_label(F.col("url")).alias("label"))


@query(r"WITH c AS (SELECT DISTINCT ON (id) id, chunk_text FROM chunks), l AS (SELECT id, unnest(string_split(chunk_text, chr(10))) AS line FROM c) SELECT count(*) AS lines, count(*) FILTER (len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '')) < 4 AND NOT regexp_matches(line, '[\d.:;$]')) AS labels FROM l")
def d02_loose_labels(spark, d):
    c = once(table(spark, d, "chunks").select("id", "chunk_text"), "id").select(F.explode(F.split("chunk_text", "\n")).alias("line"))
    return c.agg(F.count("*").alias("lines"), F.count_if(T.looks_like_label(F.col("line"))).alias("labels"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE length(text) > 3600),
 f AS (SELECT doc_id, length(text) AS chars, flatten(list_transform(s, lambda x: CASE WHEN length(x) <= 1800 THEN [x] ELSE list_filter(regexp_split_to_array(x, '[\s\p{Z}]+'), lambda w: w <> '') END)) AS p FROM t),
 e AS (SELECT doc_id, chars, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM f),
 r AS (SELECT doc_id, chars, i, trim(' ' || part) AS now, 0 AS done, 0 AS longest FROM e WHERE i = 1 UNION ALL
  SELECT r.doc_id, r.chars, e.i, CASE WHEN r.now <> '' AND length(r.now) + 1 + length(part) > 1800 THEN part ELSE trim(r.now || ' ' || part) END,
   r.done + CASE WHEN r.now <> '' AND length(r.now) + 1 + length(part) > 1800 THEN 1 ELSE 0 END, CASE WHEN r.now <> '' AND length(r.now) + 1 + length(part) > 1800 THEN greatest(r.longest, length(r.now)) ELSE r.longest END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
 SELECT doc_id, chars::INT AS chars, (done + CASE WHEN now = '' THEN 0 ELSE 1 END)::INT AS pieces, greatest(longest, length(now))::INT AS longest FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1""")
def d08_oversized(spark, d):
    """Long documents cut into pieces of at most 1,800 characters."""
    long = table(spark, d, "documents").where("length(text) > 3600").select("doc_id", "text", T.split_oversized(F.col("text")).alias("p"))
    return long.select("doc_id", F.length("text").alias("chars"), F.size("p").alias("pieces"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query()
def d09_chunks(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", blocks_of_lines(F.col("text")).alias("blocks"))
    return chunk_documents(docs, "doc_id").select("doc_id", "chunk_index", "text", F.array_join("heading_trail", " > ").alias("trail"), F.size("block_types").alias("blocks"))


@query(r"""WITH p AS (SELECT DISTINCT ON (raw_content_path) raw_content_path, page_text FROM raw_pages WHERE page_text IS NOT NULL),
 e AS (SELECT raw_content_path, trim(regexp_replace(unnest(string_split(page_text, chr(10))), '[\s\p{Z}]+', ' ', 'g')) AS line, generate_subscripts(string_split(page_text, chr(10)), 1) - 1 AS i FROM p),
 k AS (SELECT raw_content_path, i, line, i % 6 AS k FROM e WHERE line <> ''),
 b AS (SELECT raw_content_path, i, 0 AS j, CASE k WHEN 0 THEN 'heading' WHEN 2 THEN 'list_item' WHEN 3 THEN 'table_row' ELSE 'paragraph' END AS type, CASE k WHEN 0 THEN 2 ELSE 0 END AS level, CASE k WHEN 2 THEN '•' END AS ordinal, CASE k WHEN 3 THEN line || ' | b' WHEN 4 THEN 'Term: ' || line ELSE line END AS text FROM k
  UNION ALL SELECT raw_content_path, i, 1, 'list_item', 0, '1.', 'inner' FROM k WHERE k = 2)
 SELECT raw_content_path, (row_number() OVER (PARTITION BY raw_content_path ORDER BY i, j) - 1)::INT AS pos, type, level, ordinal, text FROM b""")
def d01_blocks(spark, d):
    """Blocks of pages set in HTML: the stored lines by turns as headings, paragraphs, lists with inner lists, table rows and definitions, between chrome that goes."""
    escaped = F.replace(F.replace(F.col("page_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    forms = [("<h2>", "</h2>"), ("<p>", "</p>"), ("<ul><li>", "<ol><li>inner</li></ol></li></ul>"), ("<table><tr><td>", "</td><th></th><td>b</td></tr></table>"), ("<dl><dt>Term</dt><dd>", "</dd></dl>"), ("<div><p><b>", "</b></p></div>")]
    at = lambda i, side: F.get(F.array(*[F.lit(x[side]) for x in forms]), i % 6)
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda x, i: F.when(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != "", F.concat(at(i, 0), x, at(i, 1))).otherwise("")), "")
    html = F.concat(F.lit("<html><head><style>p {}</style></head><body><nav>menu</nav><!-- note -->"), body, F.lit("<footer>end of it all.</footer><button>Go</button></body></html>"))
    pages = once(table(spark, d, "raw_pages").where("page_text IS NOT NULL"), "raw_content_path").select("raw_content_path", html.alias("html"))
    blocks = blocks_of_pages(pages, "raw_content_path", "html").select("raw_content_path", F.posexplode("blocks").alias("pos", "b"))
    return blocks.select("raw_content_path", "pos", "b.type", "b.level", "b.ordinal", "b.text")


@query(r"""WITH t AS (SELECT DISTINCT ON (doc_id) doc_id AS doc, text FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS b FROM t),
 e AS (SELECT doc, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS pos FROM s),
 m AS (SELECT *, regexp_matches(line, '^\s*([•●■☐*\-]|\d+[.)])\s+') AS listed FROM e),
 k AS (SELECT doc, pos, trim(line) AS text, NOT listed AND NOT contains(line, '|') AND length(trim(line)) <= 60 AND NOT regexp_matches(trim(line), '[.!?:;,|।]') AND NOT regexp_matches(trim(line), '\d') AS head FROM m),
 h AS (SELECT *, count(*) FILTER (head) OVER w AS section, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w AS trail FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos))
 SELECT doc, pos::INT AS pos, section::INT AS section, coalesce(trail, '') AS trail FROM h WHERE NOT head""")
def n02_heading_trails(spark, d):
    """Heading trails of every document with a text, whatever its length."""
    e = once(table(spark, d, "documents"), "doc_id").where("text IS NOT NULL")
    b = e.select(F.col("doc_id").alias("doc"), F.posexplode(blocks_of_lines(F.col("text"))).alias("pos", "b")).select("doc", "pos", "b.type", "b.level", "b.text")
    return heading_trails(b)


@query("""WITH c AS (SELECT DISTINCT ON (extract_id) extract_id AS doc, text FROM extracted_chunks WHERE text IS NOT NULL),
 l AS (SELECT doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM c),
 m AS (SELECT *, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'paragraph' END AS type FROM l),
 h AS (SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER (PARTITION BY doc ORDER BY pos) = 'paragraph' THEN 0 ELSE 1 END AS head FROM m),
 r AS (SELECT *, sum(head) OVER (PARTITION BY doc ORDER BY pos) AS run FROM h)
 SELECT doc, run::BIGINT AS run, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS text FROM r GROUP BY doc, run""")
def n05_paragraph_runs(spark, d):
    c = once(table(spark, d, "extracted_chunks"), "extract_id").where("text IS NOT NULL").select(F.col("extract_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.trim("text") == "", "blank").otherwise("paragraph")
    return merge_runs(c.select("doc", "pos", kind.alias("type"), "text", F.lit(1).alias("page"), F.lit("native").alias("source")))


@query("""WITH c AS (SELECT DISTINCT ON (extract_id) extract_id AS page, text FROM extracted_chunks WHERE text IS NOT NULL),
 l AS (SELECT page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM c),
 w AS (SELECT page, line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS x0 FROM l)
 SELECT page, (row_number() OVER (PARTITION BY page ORDER BY line) - 1)::INT AS line, string_agg(word, ' ' ORDER BY x0) AS text, 10.0::DOUBLE AS size FROM w WHERE word <> '' GROUP BY page, w.line""")
def n06_word_lines(spark, d):
    """Words of the scanned chunks set on a page grid, grouped to lines again."""
    c = once(table(spark, d, "extracted_chunks"), "extract_id").where("text IS NOT NULL").select(F.col("extract_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    w = c.select("page", "line", F.posexplode(F.split("text", " ")).alias("x0", "text")).where("text <> ''")
    return word_lines(w.select("page", "text", (F.col("line") * 12 + F.col("x0") % 3).alias("top"), "x0", F.lit(10.0).alias("size")))
