"""The opN_ queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path
from . import context_mixing, contextual_pii, decontaminate, lattice_sampling, line_dedup, ngram_join, pivot_clustering, quality, sentence_spans, suffix_dedup, token_alignment, token_files, url_filter

#: Fixed rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Names whose domains are on the block list; the listed domains themselves come from the pages.
LISTED_NAMES = ["spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track"]
BYTE_BPE, END_ID = "byte_bpe_50k.json", 2
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice_sampling.sample_segmentations(docs, tokenizer_path(PIECES), F.col("doc_id"), keep=["doc_id"], digest=True)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs, k=3, percent=90).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.drop_repeated_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), grow=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = decontaminate.mark_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filter.split_url(F.col("url"))
    domain = F.regexp_extract(host, rf"((?:{'|'.join(LISTED_NAMES)})\..*)$", 1)
    listed = pages.select(domain.alias("key")).filter("key != ''").distinct()
    return url_filter.filter_urls(pages, "url", URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_frequent_lines(docs, "source", "text").select("doc_id", "n_lines", "n_dropped", "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), END_ID, out, added=True)
    return token_files.token_digest(token_files.read_token_files(spark, out))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


def op11_pivot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clustering.cluster_digest(*pivot_clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [contextual_pii.span_count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(contextual_pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(contextual_pii.spans_text(F.col("base")), 256).alias("base_sha256"), contextual_pii.spans_text(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_lattice_sampling": op1_lattice_sampling,
    "op2_ngram_join": op2_ngram_join,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_context_mixing": op10_context_mixing,
    "op11_pivot_clustering": op11_pivot_clustering,
    "op12_token_alignment": op12_token_alignment,
    "op13_contextual_pii": op13_contextual_pii,
}

_RULES_SQL = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
)

CLUSTERS, CLUSTER_ROUNDS = 8, 10
_ASSIGN_SQL = """a{r} AS MATERIALIZED (
  SELECT v.rid, any_value(v.vec_id) AS vec_id, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) AS best
  FROM kept v CROSS JOIN c{r} c GROUP BY v.rid
)"""
_MOVE_SQL = """m{r} AS MATERIALIZED (
  SELECT c, list(q ORDER BY i) AS x FROM (
    SELECT a.best.c AS c, s.i AS i, ((sum(v.x[s.i]) - ((sum(v.x[s.i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q
    FROM a{r} a JOIN kept v ON a.rid = v.rid CROSS JOIN (SELECT unnest(range(1, 65)) AS i) s GROUP BY ALL
  ) GROUP BY c
), c{next} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c)"""


def _clusters_sql() -> str:
    """The rounds one after another, every distance taken, no pivots."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM kept
  ORDER BY c LIMIT {CLUSTERS}
)""",
    ]
    for r in range(CLUSTER_ROUNDS):
        parts += [_ASSIGN_SQL.format(r=r), _MOVE_SQL.format(r=r, next=r + 1)]
    parts.append(_ASSIGN_SQL.format(r=CLUSTER_ROUNDS))
    last = f"SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{CLUSTER_ROUNDS} a JOIN c{CLUSTER_ROUNDS} c ON a.best.c = c.c"
    return "WITH " + ", ".join(parts) + "\n" + last


ORACLE_SQL = {
    "op11_pivot_clustering": _clusters_sql(),
    "op5_url_filter": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (SELECT *, CASE {_RULES_SQL.replace('{}', '')} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in URL_RULES)}
            WHEN regexp_matches(host, '(^|\\.)[^.]*({'|'.join(LISTED_NAMES)})\\.') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT DISTINCT d.rowid AS r, source, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
frequent AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
  GROUP BY l.source, l.line, t.pages HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.MAX_RATIO} * t.pages
), lists AS (SELECT source, list(line) AS lines FROM frequent GROUP BY source)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(text, chr(10))), 0) - coalesce(len([x FOR x IN string_split(text, chr(10)) IF NOT coalesce(list_contains(f.lines, x), false)]), 0))::BIGINT AS n_dropped,
       array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT coalesce(list_contains(f.lines, x), false)], chr(10)) AS text
FROM documents d LEFT JOIN lists f ON d.source IS NOT DISTINCT FROM f.source""",
}
