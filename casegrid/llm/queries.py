"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm import (centroids, decontaminate, exact_dedup, html_text, licenses, ngram_join, packing, permutation_index, quality,
                          spelling, token_files, toxicity, url_filter)
from casegrid.llm.common import crc_mod, fresh_folder, table

# The rules of op4 (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Folds whose labels are never learned from: (modulus, remainder).
TOXIC_FOLD, QUALITY_FOLD = (5, 0), (4, 2)
TOXIC_FROM, QUALITY_FROM = 0.5, 0.7
# Clusters, rounds, components, their scale and the seed of the starts (op13).
CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
TOKEN_VOCAB, PACK_VOCAB = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocab_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token folder of ``documents`` and read it back."""
    path = fresh_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocab_path(TOKEN_VOCAB))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


def pieces(docs: DataFrame, kept_words: int | None = None) -> DataFrame:
    packed = packing.pack(docs, vocab_path(PACK_VOCAB), kept_words=kept_words)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def url_rules(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True)]) for r in URL_RULES])
    return spark.range(1).select(F.inline(rows))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_rules(spark))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def _held_out(fold: tuple[int, int]) -> Column:
    return F.coalesce(crc_mod("doc_id", fold[0]) == fold[1], F.lit(False))


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the column toxicity_score__."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learnable(*TOXIC_FOLD))
    return toxicity.score(docs, model, "toxicity_score__")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("toxicity_score__")
    return toxicity_scores(spark, docs, sf_dir).select("doc_id", _held_out(TOXIC_FOLD).alias("held_out"), score.alias("score"),
                                                       (score >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the column quality_score__."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learnable(*QUALITY_FOLD))
    return quality.score(docs, model, "quality_score__")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("quality_score__")
    return quality_scores(spark, docs, sf_dir).select("doc_id", _held_out(QUALITY_FOLD).alias("held_out"), score.alias("score"),
                                                      (score >= QUALITY_FROM).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_packing, op3_html_text, op4_url_filter, op5_licenses, op6_ngram_join,
                                   op7_decontaminate, op8_toxicity, op9_permutation_index, op10_quality, op11_exact_dedup,
                                   op12_spelling_variants, op13_centroids, pipeline)}


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{h}{p}', '{v}')" for v, h, p in URL_RULES)
    return rf"""
WITH rules(rh, rp, rule, rv) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT row_number() OVER () AS r, page_id,
              translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
         FROM hp, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.rv, 'allow') AS verdict FROM hp LEFT JOIN best USING (r)"""


def _license_sql() -> str:
    grams = lambda t: "[" + ", ".join(f"'{g}'" for g in licenses.bigrams_of(t)) + "]"
    rows = ", ".join(f"({i}, '{n}', {grams(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH t(no, name, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d),
w AS (SELECT r, line_no, string_split(trim(regexp_replace(
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM l),
g AS (SELECT r, line_no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a
      FROM w WHERE len(ws) > 1),
s AS (SELECT r, line_no, no, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t),
f AS (SELECT * FROM s WHERE dice >= {licenses.THRESHOLD}),
top AS (SELECT r, name, dice, line_no, row_number() OVER (PARTITION BY r ORDER BY dice DESC, no, line_no) AS k FROM f),
n AS (SELECT r, count(DISTINCT line_no) AS n FROM f GROUP BY r)
SELECT doc_id, name AS license, coalesce(dice, 0.0::DOUBLE) AS dice, line_no::INT AS line_no, coalesce(n, 0)::INT AS n_lines
FROM d LEFT JOIN (SELECT * FROM top WHERE k = 1) USING (r) LEFT JOIN n USING (r)"""


def _decontamination_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, {words} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(ws[k:k + 12], ' ') AS phrase, least(len(ws), 13) AS n
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS phrase
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT r, dw.k, dw.n, phrase FROM dw WHERE EXISTS (SELECT 1 FROM iw WHERE iw.phrase = dw.phrase AND iw.n = dw.n)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit JOIN iw USING (phrase, n) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)"""


def _dedup_sql() -> str:
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size,
             arg_max(r, coalesce(doc_id, -9223372036854775808)) AS kept_row FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, r = kept_row AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


def _centroid_sql() -> str:
    """Rounds written out one after the other."""
    k, dims = CLUSTERS, DIMENSIONS

    def nearest(i: int) -> str:
        d = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"a{i} AS MATERIALIZED (SELECT r, min({d}::HUGEINT * {k} + c) AS m FROM x, c{i} AS c GROUP BY r)"

    parts = [f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM x)
QUALIFY c < {k})"""]
    for i in range(ROUNDS):
        parts += [nearest(i), f"""s{i} AS (SELECT c, k, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
FROM (SELECT m % {k} AS c, unnest(v) AS e, generate_subscripts(v, 1) AS k FROM a{i} JOIN x USING (r)) GROUP BY c, k),
u{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.v, o.v) AS v FROM c{i} o LEFT JOIN u{i} u ON o.c = u.c)"""]
    parts += [nearest(ROUNDS), f"l AS (SELECT r, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance FROM a{ROUNDS})"]
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM l JOIN x USING (r) JOIN c{ROUNDS} c ON c.c = l.cluster"""


ORACLES = {"op4_url_filter": _url_sql(), "op5_licenses": _license_sql(), "op7_decontaminate": _decontamination_sql(),
           "op11_exact_dedup": _dedup_sql(), "op13_centroids": _centroid_sql()}
