"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from memloom.llm import align, ann, audit, bpe, html_extract, license_scan, mixing, mtree, quality, simhash, toxicity, url_filter, warc
from memloom.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_digest_column(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, quality.score_of(docs, table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").root
    warc.write(table(spark, sf_dir, "pages"), f"{folder}/raw")
    warc.deduplicate(spark, f"{folder}/raw", f"{folder}/archive", least=0)
    return warc.resolve(warc.read(spark, f"{folder}/archive")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_ann": op3_ann,
    "op4_html_extract": op4_html_extract,
    "op5_toxicity": op5_toxicity,
    "op6_topk": op6_topk,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_alignment": op11_alignment,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

_CANON_LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical_sql(x: str) -> str:
    out = f"replace({_CANON_LOWER.format(x=x)}, chr(10), chr(10) || chr(10))"
    out = f"regexp_replace({out}, '{license_scan.BODY}', 'copyright_\\1', 'g')"
    out = f"regexp_replace({out}, '{license_scan.COPYRIGHT_LINE}', ' \\3', 'g')"
    for a, b in license_scan.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{license_scan.PUNCTUATION}', ' ', 'g'))"


def _listed_sql(rows: list[tuple[str, str]]) -> str:
    quoted = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in rows)
    return f"SELECT sha256({_canonical_sql('body')}) AS digest, min(license) AS license FROM (VALUES {quoted}) t(license, body) GROUP BY 1"


ORACLE = {
    "op6_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    n AS (SELECT *, row_number() OVER () AS r FROM v)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score,
      row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id, c.r) AS rank FROM n q JOIN n c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "op10_license_scan": f"""WITH known AS ({_listed_sql(license_scan.LICENSES)} UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{n}')" for n, d in license_scan.DIGESTS)})), notice AS ({_listed_sql(license_scan.NOTICES)}),
    d AS (SELECT *, row_number() OVER () AS r, sha256({_canonical_sql("text")}) AS digest FROM documents),
    n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) l
      JOIN notice ON sha256({_canonical_sql("line")}) = notice.digest WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY 1)
    SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices FROM d LEFT JOIN known ON d.digest = known.digest LEFT JOIN n USING (r)""",
    "op12_warc": """WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), 'string_agg', '') AS digest FROM p),
    g AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, r) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, r) AS first FROM d)
    SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM g""",
    "op13_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    first AS (SELECT text, min(doc_id) AS first FROM t GROUP BY 1),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
      FROM t JOIN first USING (text) LEFT JOIN l USING (doc_id)),
    x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS i, list_transform(string_split(filter_order[1:step - 1], ''), lambda c: ascii(c) - 64) AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
    c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
    m AS (SELECT part, filter_order, step, i, n, good, toxic, fails[i] AS hit, len(list_filter(earlier, lambda j: j > 0 AND fails[j])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS alone FROM c, s),
    r AS (SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (hit AND alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley FROM r""",
}
