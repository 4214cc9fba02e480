"""Registered queries of the corpus operators, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadycast.llm import alignment, chat, collocations, common, langid, mixing, near_dup, orcfiles, packing, phrases, quality, rules, suffixes, toxicity

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, role = 'assistant' AS loss,
    4 + 2 + 8 + length(role) + length(role) - length(replace(replace(role, '\', ''), ':', ''))
    + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + CASE WHEN contains(text, '###')
        THEN len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###')) ELSE 0 END AS size
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@query("op10_chat_formatting", CHAT_SQL)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from its formatted text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    records = chat.canonical_turns(chat.turn_rows(rows.unionByName(planted)))
    out = chat.format_turns(records)
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence of at most 2048 tokens."""
    return packing.pack(common.documents(spark, sf_dir))


@query("op4_phrase_fingerprint")
def op4_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its edited text, and likeness to that and to the next one."""
    return phrases.neighbours(common.documents(spark, sf_dir))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with remainder 2 teach nothing."""
    docs = common.documents(spark, sf_dir)
    out = langid.identify(docs, common.crc_mod(F.col("doc_id"), 4), learn=(0, 1), calibrate=(3,))
    return out.withColumn("held_out", F.col("fold") == 2).drop("fold")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the perplexity bands for every document."""
    return rules.judge(common.documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may teach: the remainder of the id's checksum by 5 is not 0."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows.where(common.crc_mod(F.col("doc_id"), 5) != 0)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumns(
        {
            "held_out": common.crc_mod(F.col("doc_id"), 5) == 0,
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from positives and unlabelled text."""
    docs = common.documents(spark, sf_dir)
    return _judged(quality.score(docs, quality.learn(docs, labels(spark, sf_dir))), 0.3)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and its offending sentences."""
    docs = common.documents(spark, sf_dir)
    return _judged(toxicity.score(docs, toxicity.learn(docs, labels(spark, sf_dir))), 0.5)


@query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 0.8 between sets of four-word shingles."""
    return near_dup.group(common.documents(spark, sf_dir), size=4)


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings of 100 bytes are removed."""
    return suffixes.remove(common.documents(spark, sf_dir))


MIX_WEIGHTS = {"domain": {"domain0": 2, "domain1": 3}, "lang": {"en": 3, "de": 2, "fr": 2, "es": 1}}
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN regexp_extract(coalesce(source, ''), '(\d+)$', 1) = '' THEN '(none)'
      ELSE 'domain' || CAST(CAST(right(source, 1) AS INT) % 2 AS VARCHAR) END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(tokens) AS supply, 2 * sum(tokens) AS holds FROM d GROUP BY ALL
), d0 AS (
  SELECT domain, CAST(sum(holds) AS BIGINT) AS holds, CASE domain WHEN 'domain0' THEN 2.0 WHEN 'domain1' THEN 3.0 ELSE 1.0 END::DOUBLE AS w,
    (SELECT floor(sum(supply) * 9 / 10)::BIGINT FROM leaf) AS given FROM leaf GROUP BY domain
), d1 AS (
  SELECT *, coalesce(sum(holds) OVER (ORDER BY holds / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(w) OVER (ORDER BY holds / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM d0
), d2 AS (SELECT *, holds * wl <= w * (given - taken) AS isfull FROM d1
), d3 AS (
  SELECT domain, CAST(CASE WHEN isfull THEN holds ELSE greatest(floor((given - coalesce(sum(holds) FILTER (WHERE isfull) OVER (), 0)) * w
    / sum(w) OVER (PARTITION BY isfull)), 0) END AS BIGINT) AS budget FROM d2
), l0 AS (
  SELECT domain, lang, CAST(sum(holds) AS BIGINT) AS holds, any_value(budget) AS given,
    CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM leaf JOIN d3 USING (domain) GROUP BY domain, lang
), l1 AS (
  SELECT *, coalesce(sum(holds) OVER (PARTITION BY domain ORDER BY holds / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(w) OVER (PARTITION BY domain ORDER BY holds / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM l0
), l2 AS (SELECT *, holds * wl <= w * (given - taken) AS isfull FROM l1
), l3 AS (
  SELECT domain, lang, CAST(CASE WHEN isfull THEN holds ELSE greatest(floor((given - coalesce(sum(holds) FILTER (WHERE isfull) OVER (PARTITION BY domain), 0)) * w
    / sum(w) OVER (PARTITION BY domain, isfull)), 0) END AS BIGINT) AS budget FROM l2
), s0 AS (
  SELECT domain, lang, source, supply, CAST(holds AS BIGINT) AS holds, budget AS given, 1.0::DOUBLE AS w FROM leaf JOIN l3 USING (domain, lang)
), s1 AS (
  SELECT *, coalesce(sum(holds) OVER (PARTITION BY domain, lang ORDER BY holds / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(w) OVER (PARTITION BY domain, lang ORDER BY holds / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s0
), s2 AS (SELECT *, holds * wl <= w * (given - taken) AS isfull FROM s1
), s3 AS (
  SELECT domain, lang, source, supply, CAST(CASE WHEN isfull THEN holds ELSE greatest(floor((given - coalesce(sum(holds) FILTER (WHERE isfull) OVER (PARTITION BY domain, lang), 0)) * w
    / sum(w) OVER (PARTITION BY domain, lang, isfull)), 0) END AS BIGINT) AS budget FROM s2
), s4 AS (
  SELECT *, CAST(CASE WHEN supply > 0 THEN floor(budget / supply) ELSE 1 END AS BIGINT) AS whole FROM s3
), t AS (
  SELECT d.*, whole, budget - whole * supply AS rest,
    md5('7:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ticket FROM d JOIN s4 USING (domain, lang, source)
), u AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ticket) AS upto FROM t
), c AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, substr(ticket, 1, 3)) AS n,
    max(upto) OVER (PARTITION BY domain, lang, source, substr(ticket, 1, 3)) AS class_end FROM u
)
SELECT doc_id, domain, lang, source, tokens,
  CAST(whole + CASE WHEN class_end <= rest OR (class_end - n < rest AND upto <= rest) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c
"""


@query("op3_mixing", MIX_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for a budget of nine tenths of all tokens, two epochs at most."""
    return mixing.mix(common.documents(spark, sf_dir), epochs=2, weights=MIX_WEIGHTS)


@query("op12_orc_token_files")
def op12_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, read back from the ORC files they were written to."""
    import public_tokenizers

    return orcfiles.write_and_read(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), grams AS (
  SELECT lang, len(w) AS m, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), counted AS (
  SELECT lang, 1 AS size, w[i] AS phrase, count(*) AS f FROM grams GROUP BY lang, phrase
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] AS phrase, count(*) FROM grams WHERE i < m GROUP BY lang, phrase HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase, count(*) FROM grams WHERE i + 1 < m GROUP BY lang, phrase HAVING count(*) >= 10
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1
), cuts AS (
  SELECT lang, size, phrase, a, w, k, array_to_string(w[1:k], ' ') AS front, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = front JOIN counted y ON y.lang = c.lang AND y.phrase = rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3
), longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words by how much more often they stand together than apart."""
    return collocations.mine(common.documents(spark, sf_dir))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over every document."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
