"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontamination, language_id, lm_scoring, near_dedup, packing, pii, quality, substring_dedup, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The key of the registered queries; production passes its own.
PII_KEY = "demonstration key"


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"), tokenizer_path())


def op3_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents", "doc_id", "text"), near_dedup.Threshold(words=3, percent=85))


OP3 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY 1) r ON r.id = d.doc_id"""


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_columns(table(spark, d, "documents"), PII_KEY).select("doc_id", "text", "n_pii")


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contained(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))


def _shingle_sql(name: str, key: str, source: str, k: int) -> str:
    grams = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    return rf"""{name} AS (SELECT DISTINCT {key}, sh FROM (SELECT {key}, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: {grams}) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
FROM (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {source})))"""


OP8 = f"""WITH {_shingle_sql("d", "doc_id", "documents", 5)}, {_shingle_sql("b", "item_id", "benchmark", 5)}, n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM (SELECT d.doc_id, b.item_id, count(*) AS c FROM d JOIN b ON d.sh = b.sh GROUP BY 1, 2) JOIN n USING (item_id) WHERE 100 * c >= 80 * n"""


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "labels", "doc_id", "quality", "toxic"))


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
m AS (SELECT x, min(page_id) AS first FROM h GROUP BY 1)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM h JOIN m USING (x)"""


def op6_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.score(table(spark, d, "documents", "doc_id", "text"))


def op9_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10, 1024)


OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""


def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, d, "documents", "doc_id", "text"))


OP10 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), l AS (SELECT doc_id, x, length(x) // 2 AS n FROM h),
g AS (SELECT doc_id, i, substr(x, 1 + 2 * i::INT, 100) AS s FROM l, LATERAL (SELECT unnest(range(0, greatest(n - 49, 0))) AS i)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)), f AS (SELECT doc_id, i FROM g JOIN m USING (s) WHERE low < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i > 50 + lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY 1)
SELECT l.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(x, 1 + 2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END)::INT, 2 * ((CASE WHEN k = len(starts) THEN n ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END))::INT)), '') END)) AS kept_sha256
FROM l LEFT JOIN c ON c.doc_id = l.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality": op4_quality,
        "op5_warc": op5_warc,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_pii": op7_pii,
        "op8_decontamination": op8_decontamination,
        "op9_topk": op9_topk,
        "op10_substring_dedup": op10_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3, "op5_warc": OP5, "op8_decontamination": OP8, "op9_topk": OP9, "op10_substring_dedup": OP10}
