"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, decontaminate, language_id, line_dedup, ngram_join, packing, periodic, secret_scan, storage, token_store, toxicity, url_filter, warc
from . import pipeline as corpus

#: The rules that the op10 query judges by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similar_groups(docs, n=4, similarity=(85, 100))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(storage.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, storage.read_table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = storage.read_table(spark, sf_dir, "pages")
    folder = storage.scratch(spark, "warc")
    rows = warc.read(spark, warc.write(pages, folder))
    return storage.kept_alone(rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), folder)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, storage.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "rejected")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest is trained on made findings with labels; its verdict on every candidate of the documents decides."""
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan(secret_scan.candidates(docs), secret_scan.trained(spark))
    return out.select("doc_id", "start", "stop", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = storage.scratch(spark, "tokens")
    store = token_store.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_store.read(spark, store, token_store.keys_of(docs))
    return storage.kept_alone(token_store.with_crc(rows).select("doc_id", "start", "n_tokens", "ids_crc32"), folder)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = storage.scratch(spark, "packing")
    placed, _ = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), folder=folder)
    return storage.kept_alone(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), folder)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "lines_removed")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = storage.read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_pages(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from three quarters of the documents' ids; the rest is held out."""
    import public_tokenizers

    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.train(docs.where(F.coalesce(rest != 2, F.lit(True))), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(storage.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.find(docs))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.whole_vectors(storage.read_table(spark, sf_dir, "embeddings"), dims=64, scale=256)
    first = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return centroids.cluster(vectors, vectors.orderBy(F.asc_nulls_last(first), "vector").limit(40), rounds=5, dims=64)


OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from w
), n as (select doc_id, len(s) as n from s), e as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as (select a, b from l union all select b, a from l),
r(x, y) as (select doc_id, doc_id from n union select r.x, u.b from r join u on u.a = r.y)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.y) as component_id from n join r on r.x = n.doc_id group by 1, 2
"""

OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), m as (select d, max(page_id) as r from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when r is null or r = page_id then 'response' else 'revisit' end as record_type,
  case when r <> page_id then r end as refers_to
from p left join m using (d)
"""

OP9_SQL = r"""
with l as (
  select doc_id, coalesce(source, chr(0)) as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), b as (
  select trim(line, ' ') as k, min({'d': doc_id, 'a': pos}) as f from l where regexp_matches(line, '[\p{L}\p{N}]') group by 1 having count(distinct site) >= 5
), g as (
  select doc_id, list(pos) as gone from l join b on trim(l.line, ' ') = b.k where not ({'d': doc_id, 'a': pos} = f) group by 1
)
select doc_id,
  case when gone is null then text else coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i : not list_contains(gone, i)), chr(10)), '') end as text,
  cast(coalesce(len(gone), 0) as integer) as lines_removed
from documents left join g using (doc_id)
"""

OP10_SQL = """
with r(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (
  select page_id, row_number() over () as i,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), m as (
  select i, h || p as rule, v, row_number() over (partition by i order by length(h || p) desc, length(h) desc) as k
  from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join (select * from m where k = 1) using (i)
"""


def _op13_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """One pair of table expressions for each round; the last assigns once more."""
    out = f"""with kept as (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x : cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x : x is not null and isfinite(x))) = {dims}
), x as materialized (select i, unnest(v) as x, generate_subscripts(v, 1) as j from kept),
s as (select v, row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as k from kept qualify k < {k}),
c0 as materialized (select k, unnest(v) as c, generate_subscripts(v, 1) as j from s)"""
    for r in range(rounds + 1):
        out += f""",
d{r} as materialized (
  select i, k, d from (select i, k, cast(sum((x - c) * (x - c)) as bigint) as d from x join c{r} using (j) group by i, k)
  qualify row_number() over (partition by i order by d, k) = 1)"""
        if r < rounds:
            out += f""",
m{r} as materialized (select k, j, cast(sum(x) as bigint) as t, count(*) as n from x join d{r} using (i) group by k, j),
c{r + 1} as materialized (
  select k, j, case when n is null then c else (t - ((t % n) + n) % n) // n end as c from c{r} left join m{r} using (k, j))"""
    return out + f""",
h as (select k, sha256(string_agg(cast(c as varchar), ',' order by j)) as centroid_sha256 from c{rounds} group by k)
select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256
from d{rounds} join kept using (i) join h using (k)"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_join, op2_nearest, op3_decontaminate, op4_warc, op5_toxicity, op6_secret_scan, op7_token_store, op8_packing, op9_line_dedup, op10_url_filter, op11_language_id, op12_periodic_runs, op13_centroids, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op4_warc": OP4_SQL, "op9_line_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op13_centroids": _op13_sql()}
