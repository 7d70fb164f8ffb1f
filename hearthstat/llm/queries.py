"""The operators of this subpackage bound to the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.llm import ann, chat, divergence, mixing, neardup, nndescent, periodic, pieces, secrets, suffix, tokenfile, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLIT = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ASSIGN_SQL = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
              r"""[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")

SECRETS_SQL = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
rules(place, kind, pattern, part, least) AS (
  VALUES (0, 'assign', '{ASSIGN_SQL}', 2, 6), (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
hits AS (
  SELECT doc_id, body, place, kind, part, least, pattern,
         CASE place WHEN 0 THEN regexp_extract_all(body, '{ASSIGN_SQL}') WHEN 1 THEN regexp_extract_all(body, 'AKIA[A-Z0-9]+')
                    ELSE list_filter(regexp_extract_all(body, '[0-9a-f]+'), lambda m: length(m) >= 24) END AS found
  FROM texts, rules),
walk AS (
  SELECT doc_id, place, 0 AS i, body AS rest, 0::BIGINT AS start, 0::BIGINT AS stop, '' AS m, found
  FROM hits WHERE len(found) > 0
  UNION ALL
  SELECT doc_id, place, i + 1, substr(rest, instr(rest, found[i + 1]) + length(found[i + 1])),
         stop + instr(rest, found[i + 1]) - 1, stop + instr(rest, found[i + 1]) - 1 + length(found[i + 1]), found[i + 1], found
  FROM walk WHERE i < len(found)),
spans AS (
  SELECT doc_id, w.place, kind, start, stop FROM walk w JOIN rules r ON r.place = w.place
  WHERE i > 0 AND CASE w.place WHEN 0 THEN length(regexp_extract(m, '{ASSIGN_SQL}', 2)) >= 6 ELSE length(m) >= least END),
joined AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN joined j ON j.doc_id = t.doc_id"""


@query("op2_secret_scan", SECRETS_SQL)
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.findings(docs, secrets.update(docs))
    hits = F.coalesce("secrets", F.array().cast("array<struct<start:long,place:int,stop:long,kind:string>>"))
    said = F.array_join(F.transform(hits, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(hits, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secrets.RULES], F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


ARCHIVE_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts ON d = payload_digest"""


@query("op4_warc_archive", ARCHIVE_SQL)
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    pages = warc.archive(table(spark, folder, "pages"))
    return pages.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        "record_type", "refers_to")


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPLIT}'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(3 * source_size) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS gone
  FROM weighed
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT max((total - caps)::DOUBLE / (all_weight - gone)::DOUBLE) AS level FROM levels),
goals AS (
  SELECT source, source_size, least(level * weight, (3 * source_size)::DOUBLE) AS target,
         ('0x' || substr(md5('7:' || coalesce('=' || source, '')), 1, 4))::INTEGER::DOUBLE / 65536 AS u
  FROM weighed, chosen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS r FROM sized),
steps AS (
  SELECT doc_id, size, source_size, target, r, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e
  FROM ranked JOIN goals ON ranked.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken
FROM (SELECT *, least(floor(u + (r + 1) * e) - floor(u + r * e), 3)::BIGINT AS copies FROM steps)"""


@query("op7_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
sides AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'),
marked AS (
  SELECT conv_id, perspective, turn, speaker, said, coalesce((speaker = perspective)::INT, 0) AS mask,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user:' || replace(speaker, '<|', '< |') || '|>' || chr(10) END AS marker
  FROM said LEFT JOIN sides ON conv_id IS NOT DISTINCT FROM c),
segments AS (SELECT *, marker || said || '<|end|>' || chr(10) AS segment FROM marked),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, said
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM segments)
SELECT conv_id, perspective, turn, speaker, mask, segment, start, start + length(segment) AS stop, start + length(marker) AS body_start
FROM placed"""


@query("op8_perspective_rotation", CHAT_SQL)
def perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def _vocabulary(name: str) -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path(name))


@query("op3_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    read = tokenfile.round_trip(docs, _vocabulary("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_sentencepiece")
def sentencepiece_ids(spark: SparkSession, folder: str) -> DataFrame:
    model = _vocabulary("piece_bpe_32k.model")
    both = pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"), model)
    said = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


NEAR_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPLIT}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * both_have >= 85 * (p.n_shingles + q.n_shingles - both_have)),
reach AS (SELECT doc_id, doc_id AS to_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
least_id AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, n_shingles, component_id, s.doc_id = component_id AS kept FROM sizes s JOIN least_id l ON l.doc_id = s.doc_id"""


@query("op1_minhash_neardup", NEAR_SQL)
def minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query("op6_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


VALID_SQL = """
raw AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM raw WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM good)"""

VECTORS_SQL = f"""
WITH RECURSIVE {VALID_SQL.strip()},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id, vec_id AS to_id FROM raw UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
least_id AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id),
many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, l.vec_id = component_id AS kept
FROM least_id l LEFT JOIN many ON a = l.vec_id"""


@query("op5_embedding_neardup", VECTORS_SQL)
def embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, folder, "embeddings"))


NEAREST_SQL = f"""
WITH {VALID_SQL.strip()},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.n * c.n) AS score
  FROM normed q JOIN normed c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op9_nearest_neighbours", NEAREST_SQL)
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPLIT), F.lit(0))
    planted = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    planted = planted.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.col("g")
    planted = planted.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), (F.ceil((n - F.col("a")) / F.col("p"))).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a"))), " ")
    texts = planted.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(texts).select("row.doc_id", "runs", "collapsed")
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("b"), said.alias("said"), "collapsed")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                       F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2("said", 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
vocab AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS every FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(size, 0)::HUGEINT AS size, coalesce(v, 0)::HUGEINT AS v, every
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocab USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM found GROUP BY ALL) s USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (size + 2 * v) AS p,
         1 + 1000000000::HUGEINT * (total + 2) // (every + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM results)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op11_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
