"""Registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm import bpe, bytebpe, centroids, chat, codes, decontaminate, exact, lattice, minhash, packing, revisit, toxicity, urlrules

#: Names of the vocabulary files in the public_tokenizers folder.
BYTE_BPE, BYTE_RANKS, MULTI_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
END_OF_TEXT = 50256
NEAR_PERCENT = 85

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CONTROL = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(table(spark, sf_dir, "documents"), exact.fresh_index(spark))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) WINDOW g AS (PARTITION BY sha)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), NEAR_PERCENT)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), with_ids=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), rules(spark))


OP6_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) AS t(rh, rp, verdict))
SELECT page_id, host, path,
  arg_max(rh || rp, length(rh || rp)) AS rule,
  coalesce(arg_max(verdict, length(rh || rp)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""


def chat_log(conversations: DataFrame) -> DataFrame:
    """Conversations as a log of events. A user's or system's message starts as a draft and is edited; an
    assistant's streams a draft, is regenerated and streams its text in two parts."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("bigint").alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda at, kind, text: F.struct(F.lit(at).alias("step"), F.lit(kind).alias("event"), text.alias("text"))
    draft = F.upper(F.substring("text", F.lit(1), half))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", draft), event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", F.substring("text", F.lit(1), half)), event(4, "delta", F.substring("text", half + 1, F.length("text"))))
    typed = F.array(event(0, "message", draft), event(1, "edit", F.col("text")))
    events = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)))
    return events.select("conv_id", (F.col("message") * 8 + F.col("e.step")).alias("seq"), "e.event", "message", "role", "e.text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.render(chat.fold(chat_log(rows)))
    turns = chat.read_turns(F.col("formatted"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def _escaped_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({column}, '\', '\e'), '<(\||/?s>|</?SYS>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g')"


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.START) + 1 + len(chat.END)} + length(replace({_escaped_sql("role")}, chr(10), '\\n')) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def archive_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each one's response, an earlier check, and two later ones whose validators
    agree, are stale (every tenth page) or missing (another tenth)."""
    at = F.col("page_id") * 10
    tag, day = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), F.floor(F.col("page_id") / 100).cast("string"))
    record = lambda number, kind, date, headers, digest: F.struct((at + number).alias("record_id"), F.lit(kind).alias("kind"), date.alias("date"), headers.alias("headers"), digest.alias("payload_digest"))
    none = F.lit(None).cast("string")
    full = F.create_map(F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (at + 5).cast("string"))
    stale = F.pmod("page_id", F.lit(10)) == 3
    check = F.create_map(F.lit("etag"), F.when(stale, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("date"), (at + 7).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("none"))
    bare = F.create_map(F.lit("date"), (at + 9).cast("string"), F.lit("expires"), F.lit("never"))
    records = F.array(record(0, "revisit", at + 1, bare, none), record(1, "response", at + 5, full, F.sha2("html", 256)), record(2, "revisit", at + 7, check, none), record(3, "revisit", at + 9, bare, none))
    return pages.select("url", F.explode(records).alias("r")).select("url", "r.*")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(archive_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "url_key", "ref_id", "outcome", told.alias("headers"), "payload_digest")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, page_id * 10 AS t0, '"' || md5(html) || '"' AS tag, 'day ' || (page_id // 100) AS day, sha256(html) AS digest, (page_id % 10 + 10) % 10 = 3 AS stale,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1), '^[^/?@]*@', '') AS rest FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)?$', ''), '^www\d*\.', '') AS host,
    regexp_extract(rest, '^[^/?]*([\s\S]*)$', 1) AS tail FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS url_key FROM k),
full_ AS (SELECT t0 + 1 AS record_id, url_key, t0 + 5 AS date, tag, day, digest FROM c),
rev AS (
  SELECT t0 AS record_id, url_key, t0 + 1 AS date, NULL AS etag, t0 + 9 AS told, 'bare' AS form FROM c
  UNION ALL SELECT t0 + 2, url_key, t0 + 7, CASE WHEN stale THEN '"old"' ELSE tag END, t0 + 7, 'check' FROM c
  UNION ALL SELECT t0 + 3, url_key, t0 + 9, NULL, t0 + 9, 'bare' FROM c),
j AS (
  SELECT rev.*, f.record_id AS ref_id, f.tag, f.day, f.digest FROM rev
  ASOF LEFT JOIN full_ f ON rev.url_key = f.url_key AND rev.date > f.date),
o AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'unmatched' WHEN etag IS NULL THEN 'unchecked' WHEN etag <> tag THEN 'mismatch' ELSE 'resolved' END AS outcome,
  CASE WHEN form = 'check' THEN CASE WHEN etag = '"old"' THEN etag ELSE 'W/' || etag END END AS told_tag FROM j)
SELECT record_id, url_key, ref_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN
    CASE WHEN form = 'check' THEN 'cache-control: max-age=60' || chr(10) ELSE '' END || 'content-type: text/html' || chr(10) || 'date: ' || told || chr(10) || 'etag: ' || coalesce(told_tag, tag)
    || CASE WHEN form = 'bare' THEN chr(10) || 'expires: never' ELSE '' END || chr(10) || 'last-modified: ' || day
  WHEN form = 'check' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: none' || chr(10) || 'date: ' || told || chr(10) || 'etag: ' || told_tag
  ELSE 'date: ' || told || chr(10) || 'expires: never' END AS headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN digest END AS payload_digest
FROM o
"""


def op9_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = packing.tiktoken_encoder(vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)
    return packing.pack(table(spark, sf_dir, "documents"), encoder, END_OF_TEXT)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary(MULTI_RANKS)
    done = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Centroids, rounds, scale and components of the clustering; parts, entries, rounds and scale of the codes.
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SCALE, DIMS, CLUSTER_SEED = 40, 5, 256, 64, "2:"
PARTS, ENTRIES, CODE_ROUNDS, CODE_SCALE = 8, 16, 6, 4096


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SCALE, DIMS, CLUSTER_SEED)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), PARTS, ENTRIES, CODE_ROUNDS, CODE_SCALE)


def _usable_sql(scale: int, dims: int) -> str:
    """Kept vectors (r, vec_id, label, q): q are the components as integers."""
    most = 1 << 27  # for 64 components
    return f"""k AS (SELECT *, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
  [greatest(-{most}, least({most}, floor({scale} * x::DOUBLE)))::BIGINT for x in embedding] AS q FROM k WHERE n = {dims}),
x AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS i FROM v)"""


#: The floor of s / n.
_FLOOR = "((s - ((s % n) + n) % n) // n)::BIGINT"


def _op12_sql() -> str:
    steps = [_usable_sql(CLUSTER_SCALE, DIMS), f"""f AS (SELECT q, row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}' || vec_id), q) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(q) AS y, generate_subscripts(q, 1) - 1 AS i FROM f WHERE c < {CLUSTERS})"""]
    for t in range(CLUSTER_ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{t} USING (i) GROUP BY r, c) GROUP BY r)""")
        if t < CLUSTER_ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE {_FLOOR} END AS y FROM c{t} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY c, i) USING (c, i))""")
    t = CLUSTER_ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{t} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS sha FROM c{t} GROUP BY c) USING (c)"""


def _op13_sql() -> str:
    size = f"(SELECT n FROM k WHERE n > 0 AND n % {PARTS} = 0 ORDER BY vec_id NULLS LAST, n LIMIT 1)"
    steps = [_usable_sql(CODE_SCALE, size), f"""z AS MATERIALIZED (SELECT r, x, i // w AS p, i % w AS i FROM x, (SELECT {size} // {PARTS} AS w)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v),
c0 AS MATERIALIZED (SELECT e, p, i, x AS y FROM f JOIN z USING (r) WHERE e < {ENTRIES})"""]
    for t in range(CODE_ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM z JOIN c{t} USING (p, i) GROUP BY r, p, e) GROUP BY r, p)""")
        if t < CODE_ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT e, p, i, CASE WHEN n IS NULL THEN y ELSE {_FLOOR} END AS y FROM c{t} LEFT JOIN (SELECT e, p, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN z USING (r, p) GROUP BY e, p, i) USING (e, p, i))""")
    t = CODE_ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d) AS error FROM a{t} GROUP BY r) JOIN v USING (r),
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS sha FROM c{t})"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_toxicity, op3_minhash_groups, op4_bpe, op5_decontaminate, op6_url_rules, op7_chat_format, op8_revisits, op9_lattice_score, op10_packing, op11_byte_bpe, op12_centroids, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_url_rules": OP6_SQL, "op7_chat_format": OP7_SQL, "op8_revisits": OP8_SQL, "op12_centroids": _op12_sql(), "op13_vector_codes": _op13_sql()}
