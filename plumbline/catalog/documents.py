"""Document queries: text cleaning, chunks, vectors, search, contexts and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.functions import text as tx
from plumbline.operators import chunking, corpus, retrieval
from plumbline.plans import documents as plan

# Decomposed forms of the accented letters in the test texts: letter, base, mark.
LETTERS = (("é", "e", 769), ("ó", "o", 769), ("í", "i", 769), ("è", "e", 768), ("ê", "e", 770), ("ñ", "n", 771), ("ç", "c", 807),
           ("ü", "u", 776), ("ä", "a", 776), ("ö", "o", 776), ("É", "E", 769), ("Ó", "O", 769), ("Í", "I", 769), ("È", "E", 768),
           ("Ê", "E", 770), ("Ñ", "N", 771), ("Ç", "C", 807), ("Ü", "U", 776), ("Ä", "A", 776), ("Ö", "O", 776))


def decomposed_sql(column: str) -> str:
    for letter, base, mark in LETTERS:
        column = f"replace({column}, '{letter}', '{base}' || chr({mark}))"
    return column


def clean_sql(column: str) -> str:
    e = f"regexp_replace({decomposed_sql(column)}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    e = f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    e = f"list_transform(string_split({e}, chr(10)), lambda l: regexp_replace(l, '\\s+$', ''))"
    e = f"list_filter({e}, lambda l: l = '' or length(regexp_replace(l, '^\\s+', '')) > 3)"
    e = f"regexp_replace(array_to_string({e}, chr(10)), '[ \\t]{{2,}}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({e}, '^\\s+', ''), '\\s+$', '')"


@query(f"select doc_id, {clean_sql('text')} as text from documents")
def clean_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


MARKDOWN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '#{1,6}\s*', '', 'g'),
  '\*{1,2}([^*]+)\*{1,2}', '\1', 'g'), '`{1,3}[^`]*`{1,3}', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"""


@query("select page_id, " + MARKDOWN_SQL.replace("{c}", "html") + " as text from pages")
def markdown_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.markdown_text(F.col("html")).alias("text"))


@query()
def html_to_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("p"))
    return pages.select("page_id", "p.title", "p.text")


# ---------------------------------------------------------------- chunks

def chunk_sql(source: str, size: int, overlap: int, extra: str = "", tail: bool = True) -> str:
    step = max(1, size - overlap)
    tails = f"""union all select d.*, unnest(range(greatest(last * {step} + 1, n - {overlap}), n)) as s from d"""
    return f"""with b as ({source}), d as (select *, least(greatest(0, ceil((n - {size}) / {step}::double)::bigint), (n - 1) // {step}) as last
  from (select *, length(text) as n from b) where n > 0),
starts as (select d.*, unnest(range(0, last + 1)) * {step} as s from d {tails if tail else ''})
select doc_id{extra}, row_number() over (partition by doc_id order by s) - 1 as chunk_index, s as char_start, least(s + {size}, n) as char_end,
  md5(substr(text, s + 1, {size})) as chunk_text, greatest(1, least({size}, n - s) // 4) as token_estimate from starts"""


def hashed(chunks):
    return chunks.withColumn("chunk_text", F.md5("chunk_text"))


@query(chunk_sql("select doc_id, text from documents", 512, 64))
def fixed_chunks(spark, d):
    return hashed(chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text")))


@query(chunk_sql("select doc_id, text from documents", 512, 64, tail=False))
def fixed_chunks_trimmed(spark, d):
    return hashed(chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), trim_tail=True))


@query(chunk_sql("select doc_id, text from documents", 2048, 256))
def token_chunks(spark, d):
    return hashed(chunking.token_chunks(table(spark, d, "documents").select("doc_id", "text")))


def grouped_sql(units: str, size: int = 512) -> str:
    """Greedy grouping with the last unit carried over, one unit per step of the recursion."""
    return f"""with recursive units as ({units}), sized as (select doc_id, list_transform(u, lambda x: length(x)) as lens from units),
walk(doc_id, lens, i, first, start, pos, joined, ef, es, est) as (
  select doc_id, lens, 1, 1, 0::bigint, 0::bigint, -1::bigint, null::int, null::int, null::bigint from sized where len(lens) > 0
  union all
  select doc_id, lens, i + 1, case when i <= len(lens) and ovf then i - 1 else first end,
    case when i <= len(lens) and (ovf or i = first) then pos else start end, pos + coalesce(lens[i], 0) + 1,
    case when ovf then lens[i] + lens[i - 1] + 1 else joined + 1 + lens[i] end,
    case when i > len(lens) or ovf then first end, case when i > len(lens) or ovf then i end, case when i > len(lens) or ovf then start end
  from (select *, coalesce(i > first and joined + 1 + lens[i] > {size}, false) as ovf from walk where i <= len(lens) + 1))
select doc_id, row_number() over (partition by doc_id order by es) - 1 as chunk_index, est as char_start, est + length(t) as char_end, t as chunk_text,
  greatest(1, length(t) // 4) as token_estimate
from (select w.doc_id, es, est, array_to_string(u[ef:es - 1], ' ') as t from walk w join units using (doc_id) where ef is not null)"""


@query(grouped_sql("select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as u from documents where length(text) > 0"))
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(table(spark, d, "documents").select("doc_id", "text"))


SPACED_SQL = "regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10) || chr(10), 'g')"


@query(grouped_sql(f"""select doc_id, list_filter(list_transform(string_split_regex({SPACED_SQL}, '\\n{{2,}}'),
  lambda p: regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '')), lambda p: p <> '') as u from documents"""))
def paragraph_chunks(spark, d):
    """Texts are first set with a blank line after every sentence."""
    spaced = F.regexp_replace("text", r"([.!?])\s+", "$1\n\n")
    return chunking.paragraph_chunks(table(spark, d, "documents").select("doc_id", spaced.alias("text")))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents").select("doc_id", "text"))


@query("select doc_id, greatest(1, length(text) // 4) as tokens, length(text) as chars from documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"))


# ---------------------------------------------------------------- corpus

@query(f"""select * from ({chunk_sql("select doc_id, text from documents where lang <> 'en'", 1000, 0, tail=False)})
union all select * from ({chunk_sql("select doc_id, text from documents where lang = 'en'", 500, 0, tail=False)})""")
def replace_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    english = docs.where("lang = 'en'")
    old = chunking.fixed_chunks(docs.drop("lang"), size=1000, overlap=0)
    new = chunking.fixed_chunks(english.drop("lang"), size=500, overlap=0)
    return hashed(corpus.replace_chunks(old, new, english))


@query(f"""with c as (select {clean_sql("case when lang = 'es' then '' else text end")} as t from documents)
select count(*) as discovered, count(*) filter (where length(t) > 0) as indexed, count(*) filter (where length(t) = 0) as failed from c""")
def ingest_report(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("text")).alias("text"))
    return plan.index_documents(docs).report


@query("""select source, count(*) as documents, sum(greatest(1, ceil(length(text) / 1000.0)))::bigint as chunks, count(*) as documents_with_chunks
from documents where length(text) > 0 group by source""")
def corpus_totals(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    chunks = chunking.fixed_chunks(docs.select("doc_id", "text"), size=1000, overlap=0)
    return corpus.corpus_totals(docs, chunks, "source")


@query("""with c as (select source, case when length(text) > 0 then greatest(1, ceil(length(text) / 1000.0)) end::bigint as n from documents)
select source, count(*) as documents, coalesce(sum(n), 0)::bigint as chunks, count(n) as documents_with_chunks, coalesce(sum(n), 0)::bigint as vectors, true as is_indexed from c group by 1""")
def knowledge_base_totals(spark, d):
    """Documents, chunks and vectors per source, documents without text included."""
    docs = table(spark, d, "documents")
    chunks = chunking.fixed_chunks(docs.select("doc_id", "text"), size=1000, overlap=0)
    return corpus.corpus_totals(docs, chunks, "source", vectors=retrieval.embed_text(chunks, "chunk_text"))


@query()
def indexed_chunks(spark, d):
    return plan.index_documents(table(spark, d, "documents").select("doc_id", "text")).chunks


# ---------------------------------------------------------------- vectors and search

PARTS = """parts as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
centers as (select label as query_id, list(x order by i) as v from (select label, i, avg(x) as x from parts group by 1, 2) group by 1)"""
FOUND = PARTS + """, scored as (select query_id, vec_id as id,
    round(list_inner_product(embedding::double[], v) / sqrt(list_inner_product(v, v)), 9) as score from embeddings, centers),
found as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= {k})"""
TEXTS = """texts as (select doc_id as id, text, '/data/' || lang || '\\' || source || '.txt' as source, nullif(doc_id % 3, 0)::int as page from documents)"""


def centers(spark, d):
    """One query per label: the mean vector of its rows, normalised."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    vector = F.transform("p", lambda s: s["x"])
    return vectors.select(F.col("label").cast("long").alias("query_id"), retrieval.unit_vector(vector).alias("vector"))


def nearest(spark, d, k):
    corpus_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.top_k(corpus_, centers(spark, d), k)


def texts(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", F.concat(F.lit("/data/"), "lang", F.lit("\\"), "source", F.lit(".txt")).alias("source"),
        F.nullif(F.col("doc_id") % 3, F.lit(0)).cast("int").alias("page"))


@query("""select vec_id, label, round(list_inner_product(embedding::double[], embedding::double[]) * 4 / (4 * list_inner_product(embedding::double[], embedding::double[])), 6) as squared_norm,
  round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as first_value from embeddings""")
def normalize_vectors(spark, d):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = table(spark, d, "embeddings").select("vec_id", "label", retrieval.unit_vector(doubled).alias("u"))
    norm = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return unit.select("vec_id", "label", F.round(norm, 6).alias("squared_norm"), F.round(F.element_at("u", 1), 6).alias("first_value"))


@query(f"with {FOUND.format(k=5)} select query_id::bigint as query_id, id, round(score, 6) as score, rank from found")
def top_k(spark, d):
    return nearest(spark, d, 5).withColumn("score", F.round("score", 6))


@query(f"""with {FOUND.format(k=20)}, {TEXTS} select query_id::bigint as query_id, id, round(score, 4) as score, rank, md5(text) as text, source, page
from found join texts using (id)""")
def search_results(spark, d):
    return retrieval.search_results(nearest(spark, d, 20), texts(spark, d)).withColumn("text", F.md5("text"))


STRIPPED = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"


@query(f"""with {FOUND.format(k=20)}, {TEXTS}, joined as (select query_id, id, round(score, 4) as score, {STRIPPED} as t, source from found join texts using (id)),
uniq as (select * from (select *, row_number() over (partition by query_id, t order by score desc, id) as c from joined where t <> '') where c = 1),
fit as (select * from (select *, sum(length(t)) over (partition by query_id order by score desc, id) as upto from uniq) where upto <= 4000)
select q.query_id::bigint as query_id, coalesce(string_agg('[Source: ' || source || ']' || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by upto), '') as context
from (select distinct query_id from joined) q left join fit using (query_id) group by 1""")
def search_context(spark, d):
    return retrieval.build_context(retrieval.search_results(nearest(spark, d, 20), texts(spark, d)))


CITED = f"""cited as (select * from (select query_id, id, round(score, 4) as score, source, page, substr({STRIPPED}, 1, 500) as excerpt,
  row_number() over (partition by query_id order by round(score, 4) desc, id) as place from found join texts using (id)) where place <= 5)"""


@query(f"""with {FOUND.format(k=20)}, {TEXTS}, {CITED} select query_id::bigint as query_id, place, id as chunk_id,
  string_split(replace(source, '\\', '/'), '/')[-1] as source_document, page as page_number, excerpt, score as similarity_score,
  case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end as confidence from cited""")
def citations(spark, d):
    return retrieval.citations(retrieval.search_results(nearest(spark, d, 20), texts(spark, d)))


@query(f"""with {FOUND.format(k=20)}, {TEXTS}, {CITED}, s as (select query_id, place, '[Source ' || place || ': ' || string_split(replace(source, '\\', '/'), '/')[-1]
  || case when page is not null then ', Page ' || page else '' end || ']' || chr(10) || excerpt as section from cited),
fit as (select * from (select *, sum(length(section)) over (partition by query_id order by place) as upto from s) where upto <= 2000)
select query_id::bigint as query_id, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as context from fit group by 1""")
def cited_context(spark, d):
    cited = retrieval.citations(retrieval.search_results(nearest(spark, d, 20), texts(spark, d)))
    return retrieval.cited_context(cited, 2000)


@query(f"""with {FOUND.format(k=5)} select query_id::bigint as query_id, 5::bigint as top_k, count(*) as results_count,
  string_agg(id::varchar, ',' order by rank) as result_ids from found group by 1""")
def retrieval_log(spark, d):
    log = retrieval.retrieval_log(nearest(spark, d, 5), 5)
    return log.withColumn("result_ids", F.array_join(F.transform("result_ids", lambda x: x.cast("string")), ","))


@query("select doc_id, 1.0::double as norm from documents where regexp_matches(text, '[A-Za-z0-9_]')")
def embed_documents(spark, d):
    vectors = retrieval.embed_text(table(spark, d, "documents").where(F.col("text").rlike("[A-Za-z0-9_]")).select("doc_id", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return vectors.select("doc_id", F.round(norm, 4).alias("norm"))


@query()
def text_search(spark, d):
    """Nearest documents of every benchmark text, by hashed word vectors."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = retrieval.embed_text(docs, output="vector").drop("text")
    return retrieval.top_k(vectors, retrieval.embed_text(asked, output="vector"), 5)
