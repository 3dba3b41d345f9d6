"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt into shards by a seeded hash, and each shard is
a line of documents in seeded order, cut into blocks of equal tokens.  All
blocks of the mix go to the sources by highest quotients (votes: the targets),
and a source's blocks to its shards in the same way (votes: their tokens).  A
shard then takes whole rounds of its blocks plus a seeded, evenly spaced choice
of them for the rest.  All of it is DataFrame code.

Highest quotients without a loop: with ``s`` seats, ``k`` parties and ``v``
votes in all, ``round(v_i / d)`` over all parties is at most ``s`` for
``d = v / (s - k/2)`` and at least ``s`` for ``d = v / (s + k/2)``.  Only the
quotients between these two divisors, ``k`` to ``2k`` rows, need ranking.

Skew: a source's shards hold about ``shard_tokens`` each however large the
source is; a window never spans more than one shard, or the list of a source's
shards.

Defined results: null or empty texts have size 0 and take 0; null sources are
one source, last in order; a corpus without words gives targets 0.  Rows that
repeat an id are separate documents; they, with ``row_col``, and null ids are
dealt to shards by a hash of the text beside the id.  A very long text counts by
its size like any other; only its number of words is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.llm._common import n_words, table, text_of
from trendlens.sources.writers import materialize

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK_TOKENS = 32
SHARD_TOKENS = 250_000
SEED = 17


def hash_int(*parts: Column) -> Column:
    """A seeded whole number below 2**32 that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights repeat over the
    sources in order, a target stops at ``max_repeat`` sizes and its excess goes
    to the others by weight.  In order of cap / weight, the capped sources come
    first, so running sums find the level at which the others stand."""
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sources.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    levels = capped.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - before) / rest)
    levels = levels.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(everything)
    return levels.withColumn("level", level["level"]).select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target")
    )


def _same(left: list[Column], right: list[str]) -> Column:
    conds = [a.eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def apportion(parties: DataFrame, within: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group ``within`` go to
    its parties by highest quotients votes / 1, votes / 3, ...; ties by key."""
    group = W.partitionBy(*within)
    bounded = parties.withColumn("all_votes", F.sum(votes).over(group)).withColumn(
        "half", F.sum((F.col(votes) > 0).cast("long")).over(group) / 2
    )
    some, s = F.col("all_votes") > 0, F.col(seats)

    def won(divisor: Column) -> Column:
        return F.floor(F.col(votes) / divisor + 0.5)

    low = F.when(some & (s > F.col("half")), won(F.col("all_votes") / (s - F.col("half")))).otherwise(0)
    high = F.when(some & (s > 0), won(F.col("all_votes") / (s + F.col("half")))).otherwise(-1)
    # one seat less and more, so that the rounding of a division does no harm
    bounded = bounded.withColumn("low", F.greatest(low - 1, F.lit(0)).cast("long")).withColumn("high", (high + 1).cast("long"))
    bounded = bounded.withColumn("sure", F.sum("low").over(group))
    ranked = (
        bounded.where("high > low")
        .select("*", F.explode(F.sequence("low", F.col("high") - 1)).alias("seat"))
        .withColumn("quotient", F.col(votes) / (2 * F.col("seat") + 1))
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("quotient"), *[F.col(c).asc_nulls_last() for c in key], "seat")))
        .where(F.col("rank") <= s - F.col("sure"))
    )
    extra = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count("*").alias("extra"))
    joined = bounded.join(extra, _same([F.col(c) for c in key], [f"_{c}" for c in key]), "left")
    return joined.withColumn("quota", F.col("low") + F.coalesce("extra", F.lit(0))).select(*parties.columns, "quota")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source, source_size, target,
    taken`` and ``rounds`` (whole repeats) with ``blocks`` (further blocks that
    touch the document).  With ``row_col``, a column that tells all rows apart,
    also that column as ``row``, and ``copies``: how often the whole document
    stands in the mix.  Along a shard's line the documents' shares (taken / size)
    add up, and one stands as often as the sum passes a whole number (from a
    seeded first place on), so a line's copies differ from its shares by less than one."""
    own = [] if row_col is None else ["row"]
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text_of(text_col)).alias("size"),
        F.xxhash64(text_of(text_col)).alias("content"),
        *[F.col(row_col).alias(c) for c in own],
    )
    sizes = materialize(sizes, "mix-sizes")  # ids and counts only: the texts are read once
    per_source = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    b = F.lit(block_tokens)
    seats = F.round(F.sum("source_size").over(W.partitionBy()) / b).cast("long")
    per_source = per_source.withColumn("seats", seats)
    per_source = apportion(per_source, [], ["source"], "target", "seats").drop("seats")
    per_source = per_source.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))
    per_source = materialize(per_source.withColumnRenamed("source", "s_source").withColumnRenamed("quota", "source_quota"), "mix-sources")

    lines = sizes.join(per_source, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    # null ids, and ids that may repeat, are dealt by the text too: not all to one shard
    alone = F.lit(not own) & F.col("doc_id").isNotNull()
    lines = lines.withColumn("at", hash_int(F.lit(seed), F.col("doc_id"), F.when(~alone, F.col("content")))).drop("content")
    lines = lines.withColumn("shard", F.col("at") % F.col("n_shards"))
    line = W.partitionBy("source", "shard").orderBy("at", F.col("doc_id").asc_nulls_last(), "size", *own)
    lines = lines.withColumn("start", F.coalesce(F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    shards = lines.groupBy("source", "shard").agg(F.sum("size").alias("length"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, ["source"], ["source", "shard"], "length", "source_quota")
    n = F.ceil(F.col("length") / b).cast("long")
    shards = shards.select(
        F.col("source").alias("h_source"),
        F.col("shard").alias("h_shard"),
        n.alias("n_blocks"),
        F.least(F.col("quota") * b, F.col("length") * max_repeat).alias("wanted"),
        F.col("length"),
        (hash_int(F.lit(seed), F.lit("phase"), F.col("source"), F.col("shard")) % F.greatest(n, F.lit(1))).alias("phase"),
    )
    placed = lines.join(shards, _same([F.col("source"), F.col("shard")], ["h_source", "h_shard"]), "left")
    placed = placed.withColumn("rounds", F.when(F.col("length") > 0, F.floor(F.col("wanted") / F.col("length"))).otherwise(0).cast("long"))
    placed = placed.withColumn("r", F.round((F.col("wanted") - F.col("rounds") * F.col("length")) / b).cast("long"))

    # of the first j blocks of a shard's line, so many belong to the choice
    def chosen(j: Column) -> Column:
        return F.when(F.col("n_blocks") > 0, F.floor((j * F.col("r") + F.col("phase")) / F.col("n_blocks"))).otherwise(0).cast("long")

    def tokens(x: Column) -> Column:
        j = F.floor(x / b).cast("long")
        return b * chosen(j) + (x % b) * (chosen(j + 1) - chosen(j))

    end = F.col("start") + F.col("size")
    placed = placed.withColumn("taken", (F.col("rounds") * F.col("size") + tokens(end) - tokens(F.col("start"))).cast("long"))
    more = []
    if own:
        share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
        before = F.coalesce(F.sum(share).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        first = hash_int(F.lit(seed), F.lit("draw"), F.col("source"), F.col("shard")) / F.lit(float(1 << 32))
        copies = F.floor(before + share + first) - F.floor(before + first)
        more = [*own, F.least(copies, F.ceil(share)).cast("int").alias("copies")]
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "taken",
        "rounds",
        F.when(F.col("size") > 0, chosen(F.ceil(end / b)) - chosen(F.floor(F.col("start") / b))).otherwise(0).cast("long").alias("blocks"),
        *more,
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by ranking every quotient one by one; whole numbers divide by //.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 8) AS BIGINT) AS seeded
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w,
         CAST(source_size * {MAX_REPEAT} AS DOUBLE) AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
g AS (SELECT *, (SELECT arg_min(level, cap / w) FROM f WHERE cap > w * level) AS stand FROM f),
t AS (
  SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * stand END AS target,
         CAST(round(sum(source_size) OVER () / {BLOCK_TOKENS}) AS BIGINT) AS seats,
         CAST(greatest(1, ceil(source_size / {SHARD_TOKENS})) AS BIGINT) AS n_shards FROM g),
q AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source IS NULL, source, k) AS rank
    FROM (SELECT *, unnest(range(0, CAST(target / {BLOCK_TOKENS} AS BIGINT) + (SELECT count(*) FROM t) + 2)) AS k FROM t WHERE target > 0))
  WHERE rank <= seats GROUP BY source),
l AS (
  SELECT d.*, source_size, target, coalesce(quota, 0) AS source_quota, seeded % n_shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY seeded, doc_id NULLS LAST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
h AS (SELECT source, shard, sum(size) AS length, first(source_quota) AS source_quota, first(source_size) AS source_size FROM l GROUP BY source, shard),
r AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY length / (2 * k + 1) DESC, shard, k) AS rank
    FROM (SELECT *, unnest(range(0, CAST(source_quota * length / source_size AS BIGINT) + 2 + (SELECT count(*) FROM h))) AS k FROM h WHERE length > 0))
  WHERE rank <= source_quota GROUP BY source, shard),
b AS (
  SELECT h.source, h.shard, h.length, CAST(ceil(h.length / {BLOCK_TOKENS}) AS BIGINT) AS n,
         least(coalesce(r.quota, 0) * {BLOCK_TOKENS}, h.length * {MAX_REPEAT}) AS wanted,
         CAST('0x' || substr(md5(concat_ws('|', {SEED}, 'phase', h.source, h.shard)), 1, 8) AS BIGINT) AS phase
  FROM h LEFT JOIN r ON h.source IS NOT DISTINCT FROM r.source AND h.shard = r.shard),
c AS (
  SELECT p.*, b.n, phase % greatest(n, 1) AS phase, CASE WHEN b.length > 0 THEN wanted // b.length ELSE 0 END AS rounds,
         CASE WHEN b.length > 0 THEN CAST(round((wanted - (wanted // b.length) * b.length) / {BLOCK_TOKENS}) AS BIGINT) ELSE 0 END AS r
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
e AS (SELECT *, start AS x0, start + size AS x1, start // {BLOCK_TOKENS} AS j0, (start + size) // {BLOCK_TOKENS} AS j1 FROM c)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE rounds * size
  + {BLOCK_TOKENS} * ((j1 * r + phase) // n) + (x1 % {BLOCK_TOKENS}) * (((j1 + 1) * r + phase) // n - (j1 * r + phase) // n)
  - {BLOCK_TOKENS} * ((j0 * r + phase) // n) - (x0 % {BLOCK_TOKENS}) * (((j0 + 1) * r + phase) // n - (j0 * r + phase) // n)
  END AS BIGINT) AS taken
FROM e
"""
