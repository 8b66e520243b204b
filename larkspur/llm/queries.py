"""The queries op1 to op10 over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, langid, mixing, mtree, ngram_join, pieces, pii, quality, url_filter, warc

#: The rules of op3: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The targets of op10: stated language weights (None: documents without one), sources to the power
#: 0.5 and topics to the power 0.8 of their tokens, half of all tokens. Languages that a corpus does
#: not have leave their weight to the others.
MIX_TARGETS = mixing.MixTargets(weights={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, None: 0.05}}, temper={"source": 0.5, "topic": 0.8}, keep_share=0.5, strict=False)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """The remainder of a document's id; that of a null id is n, which is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(n))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by the index. Null html is empty; ties of a
    payload's smallest id are all responses; no pages, no rows."""
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, a digest of its ids and whether they decode to its text. A null
    or empty text has no pieces; repeated ids keep their rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, check_col="round_trip")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict, of the rule or else of its class of
    redirects and canonical links. Null urls: empty parts, allow."""
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(pages.select("page_id", "url"), URL_RULES, url_filter.link_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows whose fold is not 1 (a null id is in no fold and
    not held out). Null texts and texts without a letter are und, with score 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _fold(3) == 1)
    found = langid.identify(docs.select("doc_id", "text", "held_out"), docs.where("not held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every vector whose id is divisible by 50. Null vectors and
    ids, and vectors with null, NaN or infinite components take no part; ties go to smaller ids."""
    vectors = mtree.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labelled rows whose fold is not 0 (a null id is in no fold and
    not held out). Null and empty texts have the model's bias as score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(5) == 0)
    model = quality.train_on(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of three-word shingles and its class at a similarity of 0.9. Null texts and
    texts without words: 0 shingles, a class of their own."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base's spans, all spans. Null texts have none."""
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts (the largest). Null texts are empty."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, weight, probability and draw, under MIX_TARGETS."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_TARGETS, columns=["doc_id", "source", "lang"], prefix="mix_")
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_pieces, op3_url_filter, op4_language, op5_top_k, op6_quality, op7_ngram_join, op8_pii, op9_exact_dedup, op10_mixing)}


def _base32(hex_digits: str) -> str:
    """SQL: upper-case base32 of 40 hex digits; 5 of them make 4 characters."""
    chars = []
    for i in range(8):
        group = f"CAST('0x' || substr({hex_digits}, {5 * i + 1}, 5) AS BIGINT)"
        chars += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({group} // {32 ** k}) % 32), 1)" for k in (3, 2, 1, 0)]
    return " || ".join(chars)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h"""


def _rule_sql(what: str) -> str:
    cases = ""
    for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
        got = f"'{host + path}'" if what == "rule" else f"'{verdict}'"
        cases += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {got}"
    return f"CASE{cases} ELSE {'NULL' if what == 'rule' else chr(39) + 'allow' + chr(39)} END"


#: The pages hold no canonical link or refresh, so an unruled url's class is the url alone: allow.
#: Classes are tested on fixtures.
_OP3 = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS verdict FROM p"""

_OP5 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.m = e.x),
m AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.d = w.doc_id"""

_OP9 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON t.t = g.t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op3_url_filter": _OP3, "op5_top_k": _OP5, "op7_ngram_join": _OP7, "op9_exact_dedup": _OP9}
