"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, decontam, divergence, lm, prefix_trie, secrets, simhash, substring_dedup, suffix_dedup, topk, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, URL_RULES))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    line = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    base = F.filter("findings", lambda f: f["kind"] != "model")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", line), ",").alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.toxic_ids(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return judged.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def word_vocabulary() -> str:
    """Where the public word BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), word_vocabulary())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    field = lambda name: F.element_at(F.filter("fields", lambda f: f["name"] == name), 1)["value"]
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest",
        field("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        field("WARC-Source-Block-Digest").alias("source_block_digest"),
        F.length("block").cast("long").alias("block_length"),
        F.col("block").cast("string").alias("block"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored, model = lm.score(_table(spark, sf_dir, "documents"), F.coalesce(fold != 1, F.lit(True)))
    return scored.select(
        "doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op4_topk": r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op8_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w)-9, 1)+1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_url_filter": r"""
WITH rules(rh, rp, act) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'),
     ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url,''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, host, path, rh || rp AS rule, act,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS rn
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM m WHERE rn = 1""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS in_lang FROM t GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, in_lang, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
      FROM g JOIN tot USING (lang, source) JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (in_lang + 5)) // (sum(in_lang) OVER (PARTITION BY lang) + 5 * v) AS q FROM kept JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z
       ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
te AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM te),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 50""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
a AS (SELECT k.conv_id, pos, role, text, 0 AS part FROM k JOIN t ON t.conv_id = base AND pos < h
      UNION ALL SELECT k.conv_id, pos, role, text, 1 FROM k JOIN t ON t.conv_id = k.conv_id AND pos >= h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM a),
s AS (SELECT conv_id, 0 AS d, '' AS s, 0 AS bytes FROM k UNION ALL
      SELECT conv_id, d, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d), strlen(text) FROM r),
m AS (SELECT conv_id, d, bytes, min(conv_id) OVER (PARTITION BY d, s) AS rep FROM s),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY 1),
n AS (SELECT d, rep, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY ALL),
np AS (SELECT n.*, m.rep AS parent FROM n LEFT JOIN m ON m.conv_id = n.rep AND m.d = n.d - 1),
ch AS (SELECT d - 1 AS d, parent AS rep, count(*) AS n_children FROM np WHERE parent IS NOT NULL GROUP BY ALL),
nc AS (SELECT np.*, coalesce(n_children, 0) AS n_children FROM np LEFT JOIN ch USING (d, rep)),
su AS (SELECT m.d, m.rep, sum(CAST(nc.n_children = 0 AS INT)) AS n_leaves, sum((nc.n_convs - 1) * nc.bytes) AS saved FROM nc JOIN m ON m.conv_id = nc.rep AND m.d <= nc.d GROUP BY ALL),
en AS (SELECT d, rep, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l JOIN m USING (conv_id, d) GROUP BY ALL)
SELECT rep AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nc JOIN su USING (d, rep) LEFT JOIN en USING (d, rep)""",
}
