"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import decontaminate, hard_negatives, lexical_search, license_scan, line_dedup, main_text, mixing, personal_data, quality_rules, secret_scan, simhash, token_counts, token_shards
from tapewatch.llm.runtime import documents, prepare
from tapewatch.session import scratch_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        run.family = "llm"
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


_LEDGER_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) > 2)),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY 1),
m AS (
  SELECT parts.doc_id, len(words) AS n_words, length(bare) AS word_chars,
    length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(places.n, 0) AS n_repeat_words, length(regexp_replace(bare, '\P{Lu}+', '', 'g')) AS n_capitals
  FROM parts LEFT JOIN places ON parts.doc_id = places.doc_id),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 8 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 16 * (100 * n_capitals > 40 * word_chars)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT AS failure_bits FROM m)
"""


@query(
    "op10_quality_rules",
    _LEDGER_SQL
    + """SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failure_bits,
  failure_bits % 4 <> 0 AS base_failed, failure_bits = 0 AS kept FROM b""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(documents(spark, sf_dir))
    measured = [F.col(f"ledger.measured.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    bits = F.col("ledger.bits")
    return ledger.select(
        "doc_id",
        *measured,
        bits.alias("failure_bits"),
        (~quality_rules.verdict(bits, "base")).alias("base_failed"),
        quality_rules.verdict(bits).alias("kept"),
    )


#: Tokens that a training context holds.
CONTEXT = 1024


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(documents(spark, sf_dir))
    return counted.select(
        "doc_id",
        F.col("tokens.n_bytes").alias("n_bytes"),
        F.col("tokens.n_tokens").alias("n_tokens"),
        (F.col("tokens.n_tokens") > CONTEXT).alias("over_limit"),
        token_counts.longest_prefix(F.col("tokens.steps"), F.lit(CONTEXT)).alias("chars_within_limit"),
    )


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a store and give, per document, what its files hold."""
    store = token_shards.write_tokens(docs, scratch_path(spark, "tokens"))
    places = token_shards.locate(store, token_shards.keys_of(spark, store))
    checked = token_shards.read_ids(spark, store, places, lambda ids: (crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")
    return checked.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op2_token_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, documents(spark, sf_dir))


def span_digest(spans: Column, base_kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds, the hash over base spans, and all spans as text."""
    joined = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in base_kinds]
    base = F.filter(spans, lambda s: s["kind"].isin(*base_kinds))
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *span_digest(F.col("personal"), personal_data.BASE_KINDS))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *span_digest(F.col("spans"), secret_scan.BASE_KINDS))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(documents(spark, sf_dir), size=3).select("doc_id", "fingerprint")
    found = simhash.near_duplicates(staged(prints), "doc_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def _mixing_sql() -> str:
    """The rounds of the fitting, one table expression each."""
    steps = []
    now = "r0"
    for k in range(mixing.ROUNDS):
        for d in mixing.POWERS:
            new = f"r{k + 1}_{d}"
            steps.append(
                f"{new} AS (SELECT c.* REPLACE (c.factor * CASE WHEN s.now > 0 THEN coalesce(t.share, 0) * (SELECT sum(n_tokens) FROM cells) / s.now ELSE 1 END AS factor) "
                f"FROM {now} c JOIN (SELECT {d}, sum(n_tokens * factor) AS now FROM {now} GROUP BY 1) s ON c.{d} = s.{d} LEFT JOIN target_{d} t ON c.{d} = t.{d})"
            )
            now = new
    targets = [
        f"target_{d} AS (SELECT {d}, pow(n, {power}) / (sum(pow(n, {power})) OVER ()) AS share FROM (SELECT {d}, sum(n_tokens) AS n FROM cells GROUP BY 1) WHERE n > 0)"
        for d, power in mixing.POWERS.items()
    ]
    return f"""
WITH counted AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS body,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens::BIGINT AS n_tokens, CASE WHEN 10 * (length(body) - length(replace(body, '|', ''))) > n_tokens THEN 'table'
    WHEN n_tokens < 128 THEN 'short' WHEN n_tokens < 1024 THEN 'medium' ELSE 'long' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n_tokens FROM d GROUP BY 1, 2, 3),
r0 AS (SELECT *, 1.0::DOUBLE AS factor FROM cells),
{", ".join(targets)},
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)},
p AS (SELECT *, least(factor / (SELECT max(factor) FROM {now} WHERE n_tokens > 0), 1.0) AS probability FROM {now})
SELECT d.doc_id, d.n_tokens, round(p.probability, 6) AS probability,
  ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT / pow(16, 13) < p.probability AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""


@query("op8_mixing", _mixing_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(mixing.described(documents(spark, sf_dir)))
    return found.select("doc_id", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = line_dedup.summary(line_dedup.repeated_lines(docs))
    every = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    joined = every.join(found, every["doc_id"].eqNullSafe(found["key"]) & (every["digest"] == found["digest"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(
        every["doc_id"],
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"),
    )


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(documents(spark, sf_dir))
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"]))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )


@query(
    "op11_lexical_search",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2),
found AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY 1, 2, 3, 4),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM found GROUP BY 1), corpus),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS part FROM found JOIN weight USING (term), corpus),
scores AS (SELECT item_id, r, doc_id, sum(times * part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 20""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir)).select("item_id", "rank", "doc_id", "score")


@query("op12_main_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op13_hard_negatives",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_inner_product(a.q, o.q)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM scored WHERE same) WHERE k <= 5),
negatives AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0, label=label)
