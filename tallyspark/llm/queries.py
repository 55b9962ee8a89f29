"""Registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hits AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id < keeper, false) AS gone
  FROM keyed LEFT JOIN hits USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@register("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k
        FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bwin),
dwin AS (
  SELECT doc_id, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k
        FROM dw, sizes WHERE len(w) >= m)),
occ AS (SELECT doc_id, k, dwin.m, item_id FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.m = bwin.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
                      F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = _held_out(3, 1)
    model = train(docs.filter(~held), "text", "lang", "doc_id")
    return (identify(docs, model).withColumn("held_out", held)
            .select("doc_id", "held_out", "lang_pred", "score"))


def tokenizer_path() -> str:
    """The place of the byte-level vocabulary, the queries' parameter."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(list_slice(w, k, k + 49), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN low USING (s) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT words.doc_id, count(*) AS n, count(gone.p) AS n_removed,
         string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT e.vec_id, coalesce(any_value(n), 0) AS n_links, min(reach.b) AS component_id, e.vec_id = min(reach.b) AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON c.a = e.vec_id
GROUP BY e.vec_id
"""


@register("op6_embedding_dedup", OP6_SQL)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.expr("vec_id = component_id"))


def _held_out(n: int, left: int):
    return F.coalesce(doc_bucket("doc_id", n) == left, F.lit(False))


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = _held_out(4, 2)
    weights = train(docs, table(spark, sf_dir, "labels").filter(~held), "quality")
    return (score(docs, weights).withColumn("held_out", held)
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = _held_out(4, 2)
    grammar = train(docs, table(spark, sf_dir, "labels").filter(~held))
    return (score(docs, grammar).withColumn("held_out", held)
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))


@register("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs))


def _crc32_sql(text: str) -> str:
    """DuckDB's unsigned crc32 of a text expression, byte by byte."""
    step = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda crc, byte: {step}), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, count(*) AS c,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
marked AS (SELECT run, c, {_crc32_sql("id || ':' || run")} AS h FROM runs WHERE length(run) >= 5),
worn AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
         ELSE run END AS word, c FROM marked),
voc AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM worn WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS k
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN voc v ON l.k = v.word
  UNION SELECT v.word, l.word, l.n FROM less l JOIN voc v ON l.k = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
named AS (SELECT word, n_near, m, (SELECT min(other) FROM near WHERE near.word = best.word AND near.m = best.m) AS other
          FROM best),
judged AS (
  SELECT voc.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form,
         CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM voc LEFT JOIN named USING (word)),
walk(word, tip) AS (
  SELECT word, word FROM judged
  UNION ALL SELECT walk.word, form FROM walk JOIN judged ON walk.tip = judged.word WHERE form IS NOT NULL)
SELECT judged.word, judged.form, walk.tip AS root, judged.n, judged.n_near, judged.form_n
FROM judged JOIN walk USING (word) JOIN judged e ON e.word = walk.tip WHERE e.form IS NULL
"""


@register("op13_spelling", OP13_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants, word_counts
    return variants(word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS lead, {_crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
mixed AS (
  SELECT ids.c, 0 AS own, k, r, x FROM ids JOIN turns ON turns.c = lead AND k <= h
  UNION ALL SELECT ids.c, 1, k, r, x FROM ids JOIN turns ON turns.c = ids.c AND k > h),
pth AS (
  SELECT c, row_number() OVER w AS d, list({{'r': r, 'x': x}}) OVER w AS p, length(x) AS n
  FROM mixed WINDOW w AS (PARTITION BY c ORDER BY own, k)
  UNION ALL SELECT c, 0, []::STRUCT(r VARCHAR, x VARCHAR)[], 0 FROM ids),
nodes AS (SELECT d, p, min(c) AS c, count(*) AS n_convs, min(n) AS n FROM pth GROUP BY d, p),
lines AS (SELECT nodes.d, nodes.p, nodes.n_convs, n, up, list_slice(p, 1, up) AS q
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) nodes),
kids AS (SELECT q, count(*) AS n_children FROM lines WHERE up = d - 1 GROUP BY q),
sums AS (SELECT l.q, CAST(sum((l.n_convs - 1) * l.n) AS BIGINT) AS saved, count(*) FILTER (WHERE kids.q IS NULL) AS n_leaves
         FROM lines l LEFT JOIN kids ON kids.q = l.p GROUP BY l.q),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e
         FROM (SELECT *, max(d) OVER (PARTITION BY c) AS m FROM pth) WHERE d = m GROUP BY p)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON nodes.d > 0 AND up.p = list_slice(nodes.p, 1, nodes.d - 1)
LEFT JOIN kids ON kids.q = nodes.p LEFT JOIN ends ON ends.p = nodes.p JOIN sums ON sums.q = nodes.p
"""


@register("op12_conversation_trie", OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import ends_digest, prefix_trie
    nodes, ends = prefix_trie(table(spark, sf_dir, "conversations"), family=100)
    return (nodes.join(ends_digest(ends), ["conv_id", "depth"], "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))


@register("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses
    out = scan_licenses(table(spark, sf_dir, "documents")).withColumn("base", F.filter("detections", lambda d: d["base"]))

    def labels(column):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.col(f"{column}.label"))))

    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                      F.array_min("base.first_word").alias("first_word"), F.array_max("base.first_word").alias("last_word"),
                      labels("base").alias("base_labels"), labels("detections").alias("labels"), "score")
