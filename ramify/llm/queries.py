"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm import decontaminate, langid, lm, packing, phrases, quality, ranking, secrets, simhash, suffixes, topk, urlfilter, warc
from ramify.llm.filter_sql import filter_sql
from ramify.llm.secret_sql import secret_sql
from ramify.session import RunFolder, ship_package
from ramify.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(parts: int) -> Column:
    """crc32 of doc_id as text leaves 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


@query(
    "op1_topk",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
)
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    vectors = topk.scaled(read_table(spark, folder, "embeddings"), "vec_id", "embedding")
    return topk.PivotIndex(vectors).search(vectors.where(F.col("id") % 20 == 0), 20)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document when repeated strings of 50 bytes are removed."""
    found = suffixes.remove_repeats(read_table(spark, folder, "documents"), [F.col("doc_id")])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "seeds", "matched", "compared")


@query(
    "op4_warc",
    """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to FROM w
""",
)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to a WARC in a ZIP archive and read back."""
    archives = RunFolder(spark).cut(warc.write(read_table(spark, folder, "pages")), "archives")
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    prints = simhash.with_fingerprints(docs, "text", words=3).select(F.col("doc_id").alias("id"), F.col("__fp").alias("fp"))
    prints = RunFolder(spark).cut(prints, "prints")
    found = simhash.near_duplicates(prints, simhash.complete_grid(3), 3)
    hexed = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return prints.join(found, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4,096 tokens."""
    docs = read_table(spark, folder, "documents")
    pieces = packing.tokenized(docs, tokenizer_path(), [F.col("doc_id")]).drop("ids")
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_langid")
def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read_table(spark, folder, "documents")
    profiles = langid.learn(docs.where(~held_out(4)))
    return langid.predict(docs, profiles, [F.col("doc_id"), held_out(4).alias("held_out")])


@query("op8_hmm")
def op8_hmm(spark: SparkSession, folder: str) -> DataFrame:
    """Log likelihood of every document, learned from six sevenths of them."""
    docs = read_table(spark, folder, "documents")
    model = lm.LanguageModel(docs, ~held_out(7), [F.col("doc_id"), held_out(7).alias("held_out")])
    return model.score()


@query("op9_secrets", secret_sql())
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.scan(read_table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.sha2(secrets.listed("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secrets.listed("secret_spans").alias("spans"))


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of every document, and whether the sample takes it."""
    sampler = quality.Sampler(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return sampler.scores.select("doc_id", F.col("__mean").alias("weight"), F.col("__key").alias("sample_key"), sampler.taken().alias("keep"))


@query("op11_lexical_search", ranking.PLAIN_SQL)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = ranking.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("op12_urlfilter", filter_sql())
def op12_urlfilter(spark: SparkSession, folder: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    judged = urlfilter.judge(read_table(spark, folder, "pages").select("page_id", "url"), "url", urlfilter.rule_table(spark, urlfilter.production_rules()))
    return judged.select("page_id", *[F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "pattern", "verdict")])


@query("op13_collocations", phrases.PLAIN_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.mine(read_table(spark, folder, "documents"))
