"""Reader and upload queries. Files are written from the tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import corpus
from plumbline.session import work_path
from plumbline.sources import artifacts, documents, files


@query("""select c_custkey, c_name, c_nationkey::bigint as c_nationkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal,
  nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer""")
def read_csv(spark, d):
    path = work_path(spark, "customer") + ".csv"
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("NA")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.concat(F.col("c_mktsegment"), F.lit("  ")))
    text = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", balance.alias("c_acctbal"), segment.alias("c_mktsegment"))
    text.write.csv(path, header=True, sep=";", ignoreTrailingWhiteSpace=False)
    return files.read_table(spark, path)


@query("""select o_orderkey * 1000000007 + 1234567890000000000 as long_id, (o_orderkey::hugeint * 1000000007000000000 + 12345678901234567890123)::varchar as wide_id,
  o_orderpriority || chr(10) || 'second "line"' as note from orders""")
def read_csv_wide_ids(spark, d):
    """Ids of 19 and more digits keep every digit, and quoted fields their line breaks; records
    with surplus fields go, whether the surplus is empty or not."""
    path = work_path(spark, "orders") + ".csv"
    rows = table(spark, d, "orders").select(
        (F.col("o_orderkey") * 1000000007 + 1234567890000000000).cast("string").alias("long_id"),
        (F.col("o_orderkey").cast("decimal(38,0)") * F.lit(1000000007000000000).cast("decimal(19,0)") + F.lit("12345678901234567890123").cast("decimal(23,0)")).cast("string").alias("wide_id"),
        F.concat(F.lit('"'), "o_orderpriority", F.lit('\nsecond ""line""'), F.lit('"')).alias("note"),
    )
    lines = rows.select(F.concat_ws(",", "long_id", "wide_id", "note").alias("value"))
    surplus = rows.select(F.concat_ws(",", "long_id", "wide_id", F.lit("x"), F.lit(""), F.lit("more")).alias("value"))
    lines.unionByName(surplus).write.text(path)
    found = files.read_csv(spark, path, ["long_id", "wide_id", "note"], ",")
    return found.withColumn("wide_id", F.col("wide_id").cast("string"))


@query("""select p_partkey, p_name, p_size from part""")
def read_json_columns(spark, d):
    """One object of columns per file, each an object of values by row label."""
    path = work_path(spark, "part") + ".json"
    cells = [F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.col(c)))).alias(c) for c in ("p_partkey", "p_name", "p_size")]
    whole = table(spark, d, "part").agg(*cells).select(F.to_json(F.struct("*")).alias("value"))
    whole.coalesce(1).write.text(path)
    return files.read_table(spark, path).select(F.col("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("select o_orderkey as order_key, o_totalprice as price, o_orderpriority as level from orders")
def read_csv_headerless(spark, d):
    path = work_path(spark, "orders") + ".data"
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.csv(path, sep="|")
    return files.read_table(spark, path, names=["order_key", "price", "level"])


@query("select p_partkey, p_name, p_retailprice from part")
def read_json(spark, d):
    path = work_path(spark, "part") + ".json"
    table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.json(path)
    return files.read_table(spark, path)


@query("select * exclude (l_shipdate) from lineitem")
def read_parquet(spark, d):
    return files.read_table(spark, f"{d}/lineitem.parquet").drop("l_shipdate")


def document_folder(spark, d):
    """One text file per document, in a folder per source below the shared folder."""
    folder = work_path(spark, "corpus")
    documents.write_documents(table(spark, d, "documents").where(F.length("text") > 0), folder, "source")
    return folder


@query("""select '.txt' as file_type, count(*) as files, sum(octet_length(encode(text)) + 1)::bigint as bytes from documents where length(text) > 0""")
def discover_documents(spark, d):
    return documents.discovery_report(documents.discover(spark, document_folder(spark, d)))


@query("""select '.txt' as file_type, sha256(text || chr(10)) as checksum, octet_length(encode(text)) + 1 as file_size_bytes, count(*) as copies
from documents where length(text) > 0 group by all""")
def load_documents(spark, d):
    """Whole texts come back from files; a document is recognised by the hash of its text."""
    loaded = documents.load_documents(spark, document_folder(spark, d), [".txt"])
    return loaded.groupBy("file_type", F.sha2("text", 256).alias("checksum"), "file_size_bytes").agg(F.count("*").alias("copies"))


# ---------------------------------------------------------------- uploads

UPLOADS = """uploads as (select doc_id, source as project, sha256(text) as checksum, lang from documents)"""


def uploads(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("project"), corpus.checksum(F.col("text")).alias("checksum"), "lang")


@query(f"""with {UPLOADS}, known as (select distinct project, checksum from uploads where lang = 'fr'),
r as (select *, row_number() over (partition by project, checksum order by doc_id) as k from uploads where lang <> 'fr')
select doc_id, project, checksum, lang from r where k = 1 and (project, checksum) not in (select (project, checksum) from known)""")
def new_uploads(spark, d):
    every = uploads(spark, d)
    return corpus.new_uploads(every.where("lang <> 'fr'"), every.where("lang = 'fr'"), ["project", "checksum"], "doc_id")


@query(f"""with {UPLOADS} select doc_id, checksum, first_id from (select *, min(doc_id) over (partition by checksum) as first_id from uploads) where doc_id > first_id""")
def repeated_uploads(spark, d):
    return corpus.repeated_uploads(uploads(spark, d).select("doc_id", "checksum"), ["checksum"], "doc_id")


@query("""with f as (select doc_id, source || case lang when 'en' then '.CSV' when 'de' then '.exe' else '.json' end as name, n_chars * 100000 as size, lang from documents)
select doc_id, lang <> 'de' and size <= 500 * 1048576 as admitted,
  case when lang = 'de' then 'unsupported format' when size > 500 * 1048576 then 'file too large' end as reason from f""")
def upload_admission(spark, d):
    ending = F.when(F.col("lang") == "en", ".CSV").when(F.col("lang") == "de", ".exe").otherwise(".json")
    df = table(spark, d, "documents").select("doc_id", F.concat("source", ending).alias("name"), (F.col("n_chars") * 100000).alias("size"))
    return corpus.admission(df, "name", "size").select("doc_id", "admitted", "reason")


@query("select 'lineitem' as dataset_id, 'run-1' as run_id, 3::bigint as rows union all select 'lineitem', 'run-2', 3")
def saved_fits(spark, d):
    from plumbline.operators import scale

    path = work_path(spark, "fits")
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    for run, strategy in (("run-1", "standard"), ("run-2", "robust")):
        params = scale.fit_scaler(df, strategy).params(spark)
        artifacts.save_params(params, path, "lineitem", run, "2024-01-01")
    return artifacts.list_runs(spark, path, "lineitem").select("dataset_id", "run_id", "rows")
