"""One registered query per operator, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import align, collocate, exactdedup, langid, linededup, lm, minhash, mixing, nearvec, packing, quality, rollup, warc
from quillspark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for the words of a text.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], chr(10)) AS k FROM starts),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
repeats AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(p.n, 0)::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(p.n_lines, 0)::BIGINT AS n_lines,
      length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
      length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
      length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
      len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same_as_last
      FROM d LEFT JOIN covered c USING (r) LEFT JOIN repeats p USING (r)),
b AS (SELECT *, """ + " + ".join(
    f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values())
) + """ AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed::BIGINT AS failed FROM b
"""


@query("op2_quality_ledger", QUALITY_SQL)
def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, failure bits, and verdicts of the base and the full policy."""
    base, full = quality.POLICIES["base-1"], quality.POLICIES["full-1"]
    return quality.ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(base)).alias("base_failed"), quality.passes(full).alias("kept"), "failed",
    )


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
           FROM documents),
blocks AS (SELECT source, substr(key, 1, {mixing.BLOCK_DIGITS}) AS block, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM blocks GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM s0),
s2 AS (SELECT *, [3, 1, 2][source_no % 3 + 1]::DOUBLE AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
goals AS (SELECT source, source_no, source_size, least(cap, weight * max(CASE WHEN cap / weight >= level THEN level END) OVER ()) AS target FROM s3),
rounds AS (SELECT b.source, b.block, g.source_no, b.words, round(g.target)::BIGINT AS goal, r.round,
           md5('{mixing.SEED}:' || r.round || ':' || g.source_no || ':' || b.block) AS place
           FROM blocks b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source CROSS JOIN (VALUES (0), (1)) r(round) WHERE b.words > 0),
draws AS (SELECT source, block, least(words, goal - (sum(words) OVER (PARTITION BY source_no ORDER BY round, place, block) - words)) AS part FROM rounds),
run AS (SELECT *, sum(size) OVER (PARTITION BY source, substr(key, 1, {mixing.BLOCK_DIGITS}) ORDER BY key, doc_id) - size AS start FROM d),
got AS (SELECT r.doc_id, sum(greatest(0, least(r.size, w.part - r.start))) AS taken FROM run r
        JOIN draws w ON r.source IS NOT DISTINCT FROM w.source AND substr(r.key, 1, {mixing.BLOCK_DIGITS}) = w.block AND w.part > 0 GROUP BY r.doc_id)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN got t USING (doc_id)
"""


@query("op9_mixing", MIXING_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("draws")).alias("taken"))


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries encode with."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in the packed sequences."""
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_bag_minhash")
def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and whether it is the one to keep."""
    return minhash.classes(table(spark, sf_dir, "documents"))


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id))::BIGINT AS component_id,
       e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = e.vec_id
LEFT JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY node) c ON c.node = e.vec_id
"""


@query("op7_near_vectors", VECTORS_SQL)
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links, its component and whether it stands for it."""
    return nearvec.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its lines that hold a word and the numbers of those that repeat an earlier one."""
    docs = table(spark, sf_dir, "documents")
    found = linededup.repeated_lines(docs)
    ids = docs.select("doc_id", F.xxhash64("text").alias("row"))
    return ids.join(found, ["doc_id", "row"], "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.concat_ws(",", F.col("removed").cast("array<string>")), F.lit("")).alias("removed"),
    )


def fold(doc_id: str, parts: int):
    """Which of so many parts a document falls into, by the checksum of its id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the documents outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, doc_id=F.col("doc_id"), held_out=F.col("held_out"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM q
"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, found again through the capture index, and read back."""
    pages = table(spark, sf_dir, "pages")
    _, index = warc.archive(pages)
    key = warc.capture_key(F.col("url"), F.col("page_id"))
    found = warc.lookup(index, pages.select(key.alias("low"), key.alias("high")))
    return warc.digests(warc.read_records(found)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_gru_lm")
def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from the documents outside fold 1 of 5."""
    return lm.score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


#: The tokenizer versions of the rollup query: white-space words, and runs of letters and digits or single marks.
TOKENIZERS = {"words-1": mixing.WORD, "marks-1": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}
#: What the revised count of a low-quality text counts: words with a letter or digit.
REVISED = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"

ROLLUP_SQL = rf"""
WITH l AS (SELECT doc_id, bool_or(toxic = 1) AS toxic, bool_or(quality = 0) AS low FROM labels GROUP BY doc_id),
d AS (SELECT d.*, coalesce(l.toxic, false) AS toxic, coalesce(l.low, false) AS low FROM documents d LEFT JOIN l USING (doc_id)),
t AS (SELECT source, lang, 'words-1' AS version, CASE WHEN low THEN len(regexp_extract_all(coalesce(text, ''), '{REVISED}')) ELSE len({WORDS_SQL}) END AS tokens
      FROM d WHERE NOT toxic
      UNION ALL SELECT source, lang, 'marks-1', len(regexp_extract_all(coalesce(text, ''), '{TOKENIZERS["marks-1"]}')) FROM d WHERE NOT toxic)
SELECT source, lang, version, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM t GROUP BY ALL
"""


@query("op4_token_rollup", ROLLUP_SQL)
def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts under two tokenizers, deletes of toxic documents, revised counts of poor ones, and a repeated batch."""
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", count(REVISED).alias("revised"), *(count(pattern).alias(v) for v, pattern in TOKENIZERS.items())
    )
    counted, labels = materialize(counted, "rollup-counted"), table(spark, sf_dir, "labels")
    book = rollup.Rollup(spark)
    inserts = {v: rollup.insert_events(counted, F.col(f"`{v}`"), v) for v in TOKENIZERS}
    for version, events in inserts.items():
        book.apply(f"insert-{version}", events)
    gone = counted.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    poor = counted.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    deletes = [rollup.insert_events(gone, F.lit(0), v).withColumn("op", F.lit("delete")) for v in TOKENIZERS]
    book.apply("revise", rollup.insert_events(poor, F.col("revised"), "words-1").withColumn("op", F.lit("revise")))
    book.apply("delete", deletes[0].unionByName(deletes[1]))
    book.apply("insert-words-1", inserts["words-1"])  # sent twice, counted once
    return book.totals()


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS n FROM d)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


@query("op12_exact_dedup", EXACT_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equal texts; documents of even id checksum are the history, the others a new batch."""
    found = exactdedup.dedup(table(spark, sf_dir, "documents"), fold("doc_id", 2) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links under the two tokenizers, and how common its links are."""
    return align.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


PHRASES_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
sizes AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ')]) AS phrase FROM starts, (SELECT unnest(range(1, {collocate.LONGEST + 1})) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {collocate.MIN_COUNT}),
cuts AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, s.n, 1000::HUGEINT * c.a * s.n // (l.a::HUGEINT * r.a) AS score
           FROM cuts c JOIN sizes s ON s.lang = c.lang JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = array_to_string(c.w[1:c.k], ' ')
           JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f t ON t.lang = s.lang AND t.m > s.m AND 100 * t.a >= 100 * s.a
            AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
kept AS (SELECT b.* FROM lowest b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase WHERE b.nth = 1 AND c.phrase IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {collocate.TOP}
"""


@query("op11_collocations", PHRASES_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two to five words that occur together far more often than their parts would by chance."""
    return collocate.collocations(table(spark, sf_dir, "documents"))
