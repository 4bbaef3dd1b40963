"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash.  A source draws whole blocks in the order of a fresh
permutation per round until its target is met; the block, and in it the document, where the target falls is drawn
in part.  The number of blocks drawn per source is its quota.  A binary tree splits the quotas among the
output shards: at each node every block draw is dealt to the left or right half without replacement, so the left
child's quotas are one exact multivariate-hypergeometric sample of the node's and nothing is lost or drawn twice.
Each shard then takes the next blocks of each source's sequence, as many as its leaf says, and orders its
documents by a local hash.

Only DataFrame operations are used.  Documents meet in groups of (source, block), never per source, so a source
that holds a third of the rows is spread over all its blocks; what is handled per source are sums.  All choices
are functions of the seed and the ids: a rerun gives the same mix.

Nulls and odd rows: a null text has size 0 and is never drawn; a null source is a source of its own, the last
one; null ids are one id for the hash.  Repeated rows are drawn each on its own; rows alike in id and text may
change places.  An empty table, or one without words, gives targets of 0.  Columns of the input travel in one
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SHARDS = 16
SEED = "mix-1"
#: Hex digits of the block number: 4096 blocks a source.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def source_key(source: Column) -> Column:
    """The source as a string that is never null, so that windows and joins can share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
          payload: bool = False) -> DataFrame:
    """What the mix needs of each document; with ``payload`` also the document itself, as struct ``doc``."""
    key = _hash(seed, F.col(id_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"),
        key.alias("key"), F.substring(key, 1, BLOCK_DIGITS).alias("block"), F.xxhash64(text_col).alias("tie"),
        *([F.struct("*").alias("doc")] if payload else []),
    )


def blocks_of(rows: DataFrame) -> DataFrame:
    """Words of every block of every source."""
    return rows.groupBy("source", "block").agg(F.sum("size").alias("words"))


def targets(blocks: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target words per source.

    Sharing by weight, cutting at ``repeats`` times a source's size and sharing the excess again until none is above,
    ends at one level L with target = min(cap, weight * L).  With the sources in the order of cap / weight, L follows from
    running sums.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    table = table.select("*", (F.row_number().over(order) - 1).alias("source_no"), weight.cast("double").alias("weight"),
                         (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(left)
    table = table.withColumn("level", level)
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return table.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select(
        "source", "source_no", "source_size", "weight", "target"
    )


def block_draws(blocks: DataFrame, goals: DataFrame, seed: str = SEED, repeats: int = REPEATS) -> DataFrame:
    """Blocks drawn, in order of ``draw`` (0, 1, ...) within their source, with the words drawn of each."""
    known = blocks.where("words > 0").join(goals, blocks["source"].eqNullSafe(goals["source"]))
    known = known.select(blocks["source"], "block", "words", "source_no", "source_size", F.round("target").cast("long").alias("goal"))
    rounds = known.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("place", _hash(seed, F.col("round"), F.col("source_no"), F.col("block")))
    before = Window.partitionBy("source_no").orderBy("round", "place", "block")
    running = F.sum("words").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    rounds = rounds.withColumn("draw", (F.row_number().over(before) - 1).cast("long")).withColumn("start", running)
    part = F.least(F.col("words"), F.col("goal") - F.col("start"))
    return rounds.withColumn("words", part).where("words > 0").select("source", "source_no", "block", "round", "draw", "words")


#: One node's split: every draw goes left with chance (places left on the left) / (draws left).
_SPLIT = """
aggregate(quotas, named_struct('room', half, 'rest', size, 'out', cast(array() as array<bigint>)),
  (s, x) -> aggregate(if(x.q > 0, sequence(1L, x.q), cast(array() as array<bigint>)), named_struct('room', s.room, 'rest', s.rest, 'got', 0L),
      (d, i) -> if(pmod(xxhash64(seed, node, x.source_no, i), d.rest) < d.room,
                   named_struct('room', d.room - 1, 'rest', d.rest - 1, 'got', d.got + 1),
                   named_struct('room', d.room, 'rest', d.rest - 1, 'got', d.got)),
      d -> named_struct('room', d.room, 'rest', d.rest, 'out', concat(s.out, array(d.got)))),
  s -> s.out)
"""


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Split (source_no, q) among ``shards`` (a power of two) output shards: rows (shard, source_no, q)."""
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    whole = quotas.select(F.col("source_no").cast("long").alias("source_no"), F.col("q").cast("long").alias("q"))
    nodes = whole.agg(F.sort_array(F.collect_list(F.struct("source_no", "q"))).alias("quotas"), F.coalesce(F.sum("q"), F.lit(0)).alias("size"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "size", "quotas")
    for _ in range(depth):
        halves = nodes.withColumn("seed", F.lit(seed)).withColumn("half", F.expr("(size + 1) div 2"))
        halves = halves.withColumn("left", F.expr(_SPLIT))
        nodes = halves.select("node", "size", "half", "quotas", "left", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
            (F.col("node") * 2 + F.col("side")).alias("node"),
            F.when(F.col("side") == 0, F.col("half")).otherwise(F.col("size") - F.col("half")).alias("size"),
            F.expr("zip_with(quotas, left, (x, l) -> named_struct('source_no', x.source_no, 'q', if(side = 0, l, x.q - l)))").alias("quotas"),
        )
    return nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.inline("quotas"))


def place_draws(draws: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The draws with their output shard: each shard takes the next draws of every source, as its quota says."""
    quotas = draws.groupBy("source_no").agg(F.count("*").alias("q"))
    leaves = split_quotas(quotas, shards, seed)
    upto = F.sum("q").over(Window.partitionBy("source_no").orderBy("shard"))
    leaves = leaves.withColumn("upto", upto).select(F.col("source_no").alias("no"), "shard", (F.col("upto") - F.col("q")).alias("from"), "upto")
    inside = (F.col("source_no") == F.col("no")) & (F.col("draw") >= F.col("from")) & (F.col("draw") < F.col("upto"))
    return draws.join(leaves, inside).drop("no", "from", "upto")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, repeats: int = REPEATS, shards: int = SHARDS, seed: str = SEED, payload: bool = False) -> DataFrame:
    """Every document with its source's size and target and the list ``draws`` of (round, shard, words) drawn from it.

    With ``payload`` the documents' own columns are kept in struct ``doc``.
    """
    narrow = materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    blocks = materialize(blocks_of(narrow), "mix-blocks")
    goals = materialize(targets(blocks, weights, share, repeats), "mix-targets")
    placed = place_draws(materialize(block_draws(blocks, goals, seed, repeats), "mix-draws"), shards, seed)
    per_block = placed.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("round", "shard", "words"))).alias("parts"))
    per_block = goals.withColumn("source_key", source_key(F.col("source"))).join(
        blocks.select(source_key(F.col("source")).alias("source_key"), "block"), "source_key"
    ).join(per_block, ["source_no", "block"], "left")
    rows = sized(docs, id_col, text_col, source_col, seed, payload=True) if payload else narrow
    before = Window.partitionBy("source_key", "block").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(before) - F.col("size"))
    rows = rows.join(per_block.select("source_key", "block", "source_size", "target", "parts"), ["source_key", "block"], "left")
    cut = "transform(coalesce(parts, cast(array() as array<struct<round:int,shard:int,words:bigint>>)), p -> " \
          "named_struct('round', p.round, 'shard', p.shard, 'words', greatest(0L, least(size, p.words - start))))"
    return rows.withColumn("draws", F.expr(f"filter({cut}, p -> p.words > 0)")).drop("start", "parts", "tie", "block", "source_key")


def mixed(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: one row per document drawn, all columns as they were, shard by shard in shuffled order.

    The document where a source's target falls is cut after the words drawn.
    """
    rows = mix(docs, text_col=text_col, payload=True, **options)
    rows = rows.select("doc", "size", "doc_id", F.explode("draws").alias("part"))
    place = _hash(options.get("seed", SEED), "place", F.col("part.round"), F.col("doc_id"))
    rows = rows.repartition(F.col("part.shard"), F.substring(place, 1, 2)).sortWithinPartitions("part.shard", place)
    pieces = F.regexp_extract_all(F.col(f"doc.{text_col}"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("part.words").cast("int")), "")
    words = F.when(F.col("part.words") < F.col("size"), head).otherwise(F.col(f"doc.{text_col}"))
    fields = [words.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    return rows.select(*fields)


def taken(draws: Column) -> Column:
    """Words drawn from a document, repeats counted."""
    return F.aggregate(draws, F.lit(0).cast(T.LongType()), lambda total, part: total + part["words"])
