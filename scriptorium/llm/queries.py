"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, common, digests, hamming, jaccard, langid, mixing, packing, pii, quality, suffixes, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), common.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    out = chat.conversations(chat.linear(turns.unionByName(more)))
    seen = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("lost", chat.masked(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_replace(text, '(\\*)(</?s>|<</?SYS>>|\[/?INST\]|\[ROLE |\[/ROLE\])', '\1\1\\\2', 'g'))
        + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + len(url_encode(role)) END + 3 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 50, among all others."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.signs(F.col("embedding")).alias("code"))
    return hamming.search(codes, codes.where("id % 50 = 0"))


OP10_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id AS neighbor_id,
             len(list_filter(range(1, 65), lambda i: coalesce(a[i] > 0, false) <> coalesce(embedding[i] > 0, false)))::INT AS hamming
      FROM q JOIN embeddings ON vec_id <> query_id)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hamming, neighbor_id))::INT AS rank FROM d
QUALIFY rank <= 10
"""


def remainder(n: int) -> F.col:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those with crc32(doc_id) mod 3 other than 1."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(3) != 1).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and perplexity bands for all documents."""
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 85% similarity of 4-word shingles."""
    return jaccard.similar(table(spark, sf_dir, "documents")).drop("links")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = pii.detect(table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.PATTERNS)]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 400 bytes that occur elsewhere; n_passages: runs of 50 words or
    more, of strings of 250 bytes that occur elsewhere."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), also=250, words=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT doc_id, coalesce(first(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of ids with crc32(doc_id) mod 4 other than 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.learn(docs, labels.where(remainder(4) != 2))
    out = toxicity.score(docs.select("doc_id", "text"), scorer)
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150% of their words with weights 5, 2, 1."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, cap::DOUBLE / weight AS fill FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * 3 / 2.0::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(
        (SELECT level FROM l WHERE level <= fill ORDER BY fill, source ASC NULLS LAST LIMIT 1), (SELECT max(fill) FROM l))) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""

def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts, and how near they are."""
    return digests.beside_next(table(spark, sf_dir, "documents"))


def _bytes(text: str) -> str:
    """SQL: the list of a text's bytes, and four zeros."""
    return f"list_concat(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), [0, 0, 0, 0])"


_TRIPLETS = "list_concat({})".format(", ".join(
    f"list_transform(range(1, len(b) - 3), lambda x: ((b[x] * {digests.FACTORS[0]} + b[x + {i}] * {digests.FACTORS[1]} + b[x + {j}] * {digests.FACTORS[2]} + {k * digests.STEP % 2**32}) % 4294967296) // 16777216)"
    for k, (i, j) in enumerate(digests.PLACES)
))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, ''))::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS docs FROM documents),
e AS (SELECT a.*, left(a.text, a.n - a.n // 4) || left(b.text, a.n // 4) AS edited FROM d a JOIN d b ON b.i = a.i % a.docs + 1),
v AS (SELECT i, 0 AS v, {_bytes('text')} AS b FROM e UNION ALL SELECT i, 1, {_bytes('edited')} FROM e),
t AS (SELECT i, v, unnest({_TRIPLETS}) AS bucket FROM v WHERE len(b) > 4),
c AS (SELECT i, v, bucket, count(*) AS c FROM t GROUP BY ALL),
a AS (SELECT i, v, bucket, coalesce(c, 0) AS c FROM v CROSS JOIN (SELECT unnest(range(256)) AS bucket) LEFT JOIN c USING (i, v, bucket)),
l AS (SELECT i, v, list(c ORDER BY bucket) AS cs, list(c ORDER BY c) AS up FROM a GROUP BY i, v),
q AS (SELECT i, v, list_transform(cs, lambda x: (x > up[64])::INT + (x > up[128])::INT + (x > up[192])::INT) AS q,
        len(b) - 4 AS bytes FROM l JOIN v USING (i, v)),
f AS (SELECT i, v, q, CASE WHEN bytes = 0 THEN 0 ELSE 8 * len(bin(bytes)) + (bytes * 16 // (1 << len(bin(bytes)))) % 8 END AS size FROM q),
g AS (SELECT i, v, q, size, printf('%04x', size) || array_to_string(list_transform(range(1, 129), lambda x: substr('0123456789abcdef', 4 * q[2 * x - 1] + q[2 * x] + 1, 1)), '') AS shown FROM f)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, o.shown AS fingerprint, x.shown AS edited_fingerprint,
       1 - least({digests.LIMIT}, list_sum(list_transform(range(1, 257), lambda k: abs(o.q[k] - x.q[k]))) + abs(o.size - x.size)) / {digests.LIMIT}.0 AS near_edited,
       1 - least({digests.LIMIT}, list_sum(list_transform(range(1, 257), lambda k: abs(o.q[k] - y.q[k]))) + abs(o.size - y.size)) / {digests.LIMIT}.0 AS near_next
FROM e JOIN g o ON o.i = e.i AND o.v = 0 JOIN g x ON x.i = e.i AND x.v = 1 JOIN g y ON y.i = e.i % e.docs + 1 AND y.v = 0
"""

def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter lost, grouped by spelling."""
    counts = variants.word_counts(table(spark, sf_dir, "documents"), variants.one_letter_lost)
    return variants.variants(common.stored(counts.where("n >= 3"), "words"))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE len(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM u CROSS JOIN crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
l AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1))::INT AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM l a JOIN l b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM l JOIN w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM l JOIN w ON l.rest = w.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
t(word, last) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.last AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f g ON g.word = t.last WHERE g.form IS NULL
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of all documents under a byte-level vocabulary and one of pieces."""
    return alignment.align(table(spark, sf_dir, "documents"), common.tokenizer_path(), common.tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_pii": op6_pii,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_top_k_search": op10_top_k_search,
    "op11_fingerprints": op11_fingerprints,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_mixing": OP8_SQL, "op10_top_k_search": OP10_SQL, "op11_fingerprints": OP11_SQL, "op12_spelling_variants": OP12_SQL}
