"""Registered corpus queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_store")
def token_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    return token_store.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path())


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op2_language")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    documents = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = langid.fit(documents, ~held_out)
    return langid.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query("op5_personal_data")
def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.fit(documents))


_ITEM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t
       FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM i)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS t
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s
             FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
hits AS (SELECT doc_id, s, m, item_id FROM dw JOIN iw USING (m, t)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontaminate", _DECONTAMINATE_SQL)
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as dc

    judged = dc.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return judged.select(
        "doc_id",
        "n_words",
        dc.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        dc.contaminated().alias("contaminated"),
    )


@query("op9_jaccard_join")
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    documents = table(spark, sf_dir, "documents")
    held_out = remainder(5) == 0
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(documents, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_mix_sources")
def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(documents, mixing.tempered_weights(documents))
    return mixed.select("doc_id", "source", "mix_slot", "mix_block", "mix_place")


SHARD_LIMIT = 1 << 20
_SHARD_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
sums AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS bytes
         FROM d, (SELECT CAST(unnest(generate_series(0, 40)) AS INTEGER) AS depth) GROUP BY ALL),
own AS (SELECT doc_id, min(depth) AS depth
        FROM d, (SELECT CAST(unnest(generate_series(0, 40)) AS INTEGER) AS depth) AS s JOIN sums USING (depth)
        WHERE sums.prefix = d.h >> (60 - depth) AND sums.bytes <= {SHARD_LIMIT} GROUP BY doc_id)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page,
       bytes, bytes > {SHARD_LIMIT} AS oversized
FROM d JOIN own USING (doc_id)
"""


@query("op4_shard", _SHARD_SQL)
def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_LIMIT).drop("text")


_HAMMING_SQL = """
WITH c AS (SELECT vec_id, list_sum(list_transform(generate_series(1, len(embedding)),
                  lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS code
           FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.vec_id AS query_id, o.vec_id AS neighbour_id,
             CAST(bit_count(xor(CAST(q.code AS HUGEINT), CAST(o.code AS HUGEINT))) AS INTEGER) AS distance
      FROM c AS q JOIN c AS o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 10
"""


@query("op10_hamming_search", _HAMMING_SQL)
def hamming_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamming

    return hamming.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_passages")
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.repeated_passages(table(spark, sf_dir, "documents"))


_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), "
    "lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)
_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, g, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS pos
      FROM (SELECT *, md5(length(r) || ':' || r || x) AS g FROM t)),
ids AS (SELECT c, c - c % 20 AS b, h FROM (SELECT c, {_CRC32.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t))),
rebuilt AS (SELECT ids.c, 0 AS part, pos, g, w FROM ids JOIN o ON o.c = ids.b WHERE pos <= h
            UNION ALL SELECT ids.c, 1, pos, g, w FROM ids JOIN o ON o.c = ids.c WHERE pos > h),
steps AS (SELECT c, w, row_number() OVER s AS d, array_to_string(list(g) OVER s, '') AS k FROM rebuilt WINDOW s AS (PARTITION BY c ORDER BY part, pos)),
p AS (SELECT c, d, k, w FROM steps UNION ALL SELECT c, 0, '', 0 FROM ids),
ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e
         FROM (SELECT c, max(d) AS d, max_by(k, d) AS k FROM p GROUP BY c) GROUP BY d, k),
n AS (SELECT d, k, min(c) AS m, count(*) AS n, any_value(w) AS w FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, left(k, CAST(32 * (d - 1) AS INTEGER)) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
sums AS (SELECT a.d, a.k, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
         FROM n LEFT JOIN kids USING (d, k) JOIN p AS a ON a.c = n.m AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.m AS conv_id, n.d AS depth, up.m AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k)
LEFT JOIN n AS up ON up.d = n.d - 1 AND up.k = left(n.k, CAST(32 * (n.d - 1) AS INTEGER))
"""


def rebuilt_turns(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns and conversations of op12's contract: c takes the first h turns of c - c % 20 in place of its own."""
    from ..plans.ordering import join_keys
    from ..plans.sizing import measured

    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    known = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), head.alias("h"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    known = known.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")
    )
    known = measured(known)
    own = join_keys(turns, known, ["conv_id"]).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_words")
    # a base has at most 39 conversations and gives each three turns
    first = turns.filter("pos <= 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    heads = first.join(known, "base").filter("pos <= h").select("conv_id", "pos", "digest", "n_words")
    return own.unionByName(heads), known


@query("op12_prefix_trie", _TRIE_SQL)
def prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie

    rows, conversations = rebuilt_turns(spark, trie.turns(table(spark, sf_dir, "conversations")))
    return trie.trie(rows, conversations)


@query("op11_alignment")
def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align

    documents = table(spark, sf_dir, "documents")
    return align.measured_documents(documents, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))[0]


@query("op13_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    documents = table(spark, sf_dir, "documents")
    held_out = remainder(5) == 0
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(documents, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
