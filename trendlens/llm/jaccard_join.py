"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams (64-bit hashes).  Two sets
whose Jaccard similarity is at least ``percent`` / 100 differ in at most T
tokens, where T follows from the larger size.  Documents fall into bands of
size; a band's scheme deals tokens by hash into B = T + 1 + z blocks and
XOR-hashes each block's tokens into one word.  T differing tokens touch at most
T blocks, so linked documents agree in at least z + 1 of a scheme's words, and
the pigeonhole join on (band, block, word) misses no link.  A document is dealt
by its own band's scheme and, if a partner may be that large, by the next.

The z spare blocks allow a document to keep back its lightest blocks, all of
at most c tokens where no more than z are as light: among the z + 1 blocks on
which two linked documents agree, the heaviest is kept back by neither.  So
blocks of few, frequent tokens form no groups.

A second sketch of ``SKETCH_BITS`` parities (a token flips one bit) travels
with each document; its Hamming distance is a lower bound of the number of
differing tokens and drops most candidates.  Of sets too large for so few bits,
pairs that pass are compared by parities of ``WIDE_BITS`` bits a token, and only
then verified on the sets.

Groups of copies, without all pairs: documents of equal sets are one class,
settled by an aggregate.  Round 1 pairs every member of a word group with the
group's first member only, verifies, and finds the components.  Round 2 looks
at the members beside the first: where they still are of several components,
every member is compared with one that a hash picks in each group, anew in each
turn.  Near copies, which agree in many words of many groups, are joined by as
many comparisons as groups have members.  Where groups still are of several
components, those outside the most frequent one are paired with members of other
components.  Links inside a component change nothing, so the components are exact.

A word group with more than ``LARGE`` such members (templates: texts that share
blocks but stay under the threshold) is dealt anew by a second pigeonhole: of
the documents in such groups, two that are linked share one of their rarest
tokens, of which each has as many as it may miss and one more.  Rarity is a
count in ``RARITY_CELLS`` cells of hashes; any order is right, since both use
the same one, and a rare token's group is small.  What still is a large group
is compared in parts: its outside members are salted by their number.

Texts are never shuffled.  The scans that compute block words and sets leave out
the rows that have no part in them by a bitmap of fixed size; what a full bitmap
would let through is dropped by a join on the node.

Defined results: null or empty texts have an empty set and link with nothing;
texts of fewer than n words are one n-gram.  Rows that share an id are one
node.  A null id comes after all others.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.llm._common import id_and_text, table
from trendlens.llm.components import connected_components
from trendlens.sources.writers import in_few_tasks, materialize

U = np.uint64
SKETCH_LONGS = 32
SKETCH_BITS = 64 * SKETCH_LONGS
BAND_RATIO = 1.5
#: Bits for each token of the sketches that large sets have besides.
WIDE_BITS = 4
SPARE = 8  # one spare block for so many differing tokens
LAST_ID = np.iinfo(np.int64).max
#: Bits of a broadcast bitmap (8 MB), and bytes of Spark's bitmap buckets.
BITMAP_POWER = 26
PART_BYTES = 4096
SLICE_BYTES = 1 << 18
#: Members beside the first from which on a word group is dealt anew by rare tokens.
LARGE = 64
RARITY_CELLS = 1 << 18
#: Members of a group that are compared as one part, and parts at most.
PART_MEMBERS = 4096
MOST_PARTS = 256
#: Turns of stars before the members of several components are paired, at most,
#: the links that a turn must find for another, and the pairs for each member up
#: to which pairing takes no turn.
STAR_TURNS = 12
FEW_LINKS = 256
FEW_PAIRS = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rule:
    """Word n-grams of ``n`` words; linked at ``percent`` of similarity."""

    n: int
    percent: int

    def most_different(self, sizes: np.ndarray) -> np.ndarray:
        """T of two linked sets of at most this size each: D of union U is at
        most (1 - t) U, and U = (a + b + D) / 2."""
        return (100 - self.percent) * 2 * sizes // (100 + self.percent)

    def bands(self, largest: int) -> np.ndarray:
        """First sizes of the bands up to ``largest``; a linked partner is in
        the same or the next band."""
        starts = [1]
        while starts[-1] <= largest:
            step = int(starts[-1] * BAND_RATIO)
            starts.append(max(starts[-1] + 1, step, -(-starts[-1] * 100 // self.percent)))
        return np.array(starts, dtype=np.int64)


def token_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted, text after text, and the texts' bounds."""
    words = _seq.Words([t.translate(_LOWER) for t in texts])
    hashes, count = words.hashes(), np.diff(words.offsets)
    sums = _seq.prefix_sums(hashes)
    whole = np.flatnonzero((count > 0) & (count < n))
    inside = np.flatnonzero(words.text[: max(len(hashes) - n + 1, 0)] == words.text[n - 1 :]) if len(hashes) >= n else np.zeros(0, np.int64)
    start = np.concatenate([inside, words.offsets[whole]])
    end = np.concatenate([inside + n, words.offsets[whole] + count[whole]])
    token, text = _seq.range_hash(sums, start, end), words.text[start]
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (text[1:] != text[:-1])] if len(token) else np.zeros(0, bool)
    token, text = token[keep], text[keep]
    return token, np.searchsorted(text, np.arange(len(texts) + 1))


def block_words(token: np.ndarray, bounds: np.ndarray, band: np.ndarray, rule: Rule, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of the block words of every text in the scheme of the
    band given for it (negative: none)."""
    use = np.flatnonzero(band >= 0)
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(bounds)
    differ = rule.most_different(starts[band[use] + 1] - 1)
    spare = -(-differ // SPARE)
    n_blocks = differ + 1 + spare
    first_block = np.cumsum(n_blocks) - n_blocks
    count = size[use]
    owner = np.repeat(np.arange(len(use)), count)
    ends = np.cumsum(count)
    mine = token[np.repeat(bounds[use] - (ends - count), count) + np.arange(ends[-1])]
    block = ((mine >> U(32)) * n_blocks[owner].astype(np.uint64) >> U(32)).astype(np.int64) + first_block[owner]
    total = int(n_blocks.sum())
    word, weight = np.zeros(total, np.uint64), np.bincount(block, minlength=total)
    np.bitwise_xor.at(word, block, _seq.mix(mine))
    text = np.repeat(np.arange(len(use)), n_blocks)
    # the largest c of which at most ``spare`` blocks have c tokens or fewer
    light = np.full(len(use), -1)
    for c in range(int(weight.max(initial=0)) + 1):
        as_light = np.bincount(text[weight <= c], minlength=len(use))
        fits = as_light <= spare
        if not fits.any():
            break
        light[fits] = c
    kept = weight > light[text]
    place = (np.arange(total) - first_block[text]).astype(np.uint64)
    key = _seq.mix(word + _seq.mix(place * U(1 << 20) + band[use][text].astype(np.uint64)))
    return use[text[kept]], key[kept]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _features(texts: list[bytes], rule: Rule) -> list[pa.Array]:
    token, bounds = token_sets(texts, rule.n)
    size, n = np.diff(bounds), len(texts)
    text = np.repeat(np.arange(n), size)
    sums = _seq.prefix_sums(token)
    one, two = _seq.range_hash(sums, bounds[:-1], bounds[1:]), np.zeros(n, np.uint64)
    np.add.at(two, text, _seq.mix(token ^ U(0x5851F42D4C957F2D)))
    flips = np.bincount(text * SKETCH_BITS + (token & U(SKETCH_BITS - 1)).astype(np.int64), minlength=n * SKETCH_BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8)).view(np.int64)
    wide = [_wide_sketch(token[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [
        pa.array(size),
        pa.array(one.view(np.int64)),
        pa.array(two.view(np.int64)),
        _lists(sketch, np.arange(n + 1) * SKETCH_LONGS),
        _lists(np.concatenate([np.zeros(0, np.int64), *wide]), np.cumsum([0, *map(len, wide)])),
    ]


def _wide_sketch(token: np.ndarray) -> np.ndarray:
    """Parities of the tokens' low bits, a power of two of them; none where the
    short sketch has as many.  Half as long a sketch is this one's halves XORed."""
    bits = 1 << max(len(token) * WIDE_BITS - 1, 1).bit_length()
    if bits <= SKETCH_BITS:
        return np.zeros(0, np.int64)
    flips = np.bincount((token & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _fewest_different(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of tokens in which two sets differ."""
    short = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it would count the absolute value


def _keys(texts: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(text number, block key) of all texts, in their own and the next band."""
    token, bounds = token_sets(texts, rule.n)
    size = np.diff(bounds)
    starts = rule.bands(int(size.max(initial=1)) * 100 // rule.percent + 1)
    own = np.where(size > 0, np.searchsorted(starts, size, side="right") - 1, -1)
    following = np.where((size > 0) & (size * 100 // rule.percent >= starts[own + 1]), own + 1, -1)
    dealt = [block_words(token, bounds, band, rule, starts) for band in (own, following)]
    who, key = (np.concatenate([d[i] for d in dealt]) for i in (0, 1))
    return who, key


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """``node, n_shingles``, two hashes of the set and the sketches of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _seq.slices(batch["text"], SLICE_BYTES):
                nodes = batch["node"].slice(at, len(part))
                yield pa.RecordBatch.from_arrays([nodes, *_features(_seq.as_bytes(part), rule)], names=["node", "n_shingles", "h1", "h2", "sketch", "wide"])

    return docs.mapInArrow(_seq.released(run), "node long, n_shingles long, h1 long, h2 long, sketch array<long>, wide array<long>")


# --- rows of some nodes -----------------------------------------------------------


def _bits(nodes: np.ndarray) -> np.ndarray:
    return (_seq.mix(nodes.astype(np.int64).view(np.uint64)) >> U(64 - BITMAP_POWER)).astype(np.int64)


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for the hash of each node: 2 ** ``BITMAP_POWER`` bits, however many
    nodes there are.  A row whose bit is not set belongs to none of them; the
    others must still be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(batch["node"].to_numpy()) + 1)], names=["bit"])

    bit = F.col("bit")
    parts = nodes.select("node").mapInArrow(run, "bit long").groupBy(F.bitmap_bucket_number(bit).alias("part"))
    out = np.zeros(1 << (BITMAP_POWER - 3), np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        start = (r["part"] - 1) * PART_BYTES  # buckets and the bits in them are numbered from 1
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[start : start + len(piece)] |= piece
    return out


def _is_set(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    bit = _bits(nodes)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _some_rows(batch: pa.RecordBatch, bits: np.ndarray, wanted: bool) -> pa.RecordBatch:
    return batch.filter(pa.array(_is_set(bits, batch["node"].to_numpy()) == wanted))


def block_keys(docs: DataFrame, rule: Rule, bits: np.ndarray, wanted: bool) -> DataFrame:
    """``key, node`` of the rows whose bit is (not) set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _some_rows(batch, shared.value, wanted)
            for at, part in _seq.slices(batch["text"], SLICE_BYTES):
                who, key = _keys(_seq.as_bytes(part), rule)
                nodes = batch["node"].slice(at, len(part)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[who])], names=["key", "node"])

    return docs.mapInArrow(_seq.released(run), "key long, node long")


def sets(docs: DataFrame, rule: Rule, bits: np.ndarray) -> DataFrame:
    """``node, tokens`` of the rows whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _some_rows(batch, shared.value, True)
            for at, part in _seq.slices(batch["text"], SLICE_BYTES):
                nodes = batch["node"].slice(at, len(part))
                yield pa.RecordBatch.from_arrays([nodes, _lists(*token_sets(_seq.as_bytes(part), rule.n))], names=["node", "tokens"])

    return docs.mapInArrow(_seq.released(run), "node long, tokens array<long>")


def _cell(token: np.ndarray) -> np.ndarray:
    return (_seq.mix(token ^ U(0x2545F4914F6CDD1D)) % U(RARITY_CELLS)).astype(np.int64)


def rarity(docs: DataFrame, rule: Rule, bits: np.ndarray) -> np.ndarray:
    """For each cell of token hashes, how many sets of the rows whose bit is set
    hold its tokens; ``RARITY_CELLS`` rows reach the driver at most."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(RARITY_CELLS, np.int64)
        for batch in batches:
            for _, part in _seq.slices(_some_rows(batch, shared.value, True)["text"], SLICE_BYTES):
                np.add.at(count, _cell(token_sets(_seq.as_bytes(part), rule.n)[0]), 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["cell", "n"])

    counted = docs.mapInArrow(_seq.released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY_CELLS, np.int64)
    out[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return out


def _rarest(token: np.ndarray, bounds: np.ndarray, rule: Rule, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of each text's rarest tokens: linked texts share at
    least percent * size tokens of either size, so of size - that + 1 tokens one."""
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((token, count[_cell(token)], text))
    nth = np.arange(len(token)) - np.repeat(bounds[:-1], size)
    shared = -(size * rule.percent // -100)  # rounded up
    some = order[nth < (size - shared + 1)[text]]
    return text[some], token[some]


def rare_tokens(docs: DataFrame, rule: Rule, bits: np.ndarray) -> DataFrame:
    """``key, node``: the rarest tokens of the rows whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, rarity(docs, rule, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, count = shared.value
        for batch in batches:
            batch = _some_rows(batch, bits, True)
            for at, part in _seq.slices(batch["text"], SLICE_BYTES):
                who, token = _rarest(*token_sets(_seq.as_bytes(part), rule.n), rule, count)
                nodes = batch["node"].slice(at, len(part)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(nodes[who])], names=["key", "node"])

    return docs.mapInArrow(_seq.released(run), "key long, node long")


def _hamming(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH_LONGS)])


def _may_link(rule: Rule, n: str, m: str, a: str, b: str) -> Column:
    """Sizes and sketches allow a link: D (100 + p) <= (100 - p) (n + m)."""
    small, large = F.least(n, m), F.greatest(n, m)
    return (small * 100 >= large * rule.percent) & (_hamming(a, b) * (100 + rule.percent) <= (F.col(n) + F.col(m)) * (100 - rule.percent))


def _by_wide_sketch(pairs: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` without those whose wide sketches differ too much; a pair with
    a set that has none stays."""
    n_pairs = pairs.count()
    wide = found.where(F.size("wide") > 0)
    a, b = (wide.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch[c] for c in ("nu", "nv", "wu", "wv")), strict=True):
                near = not x.is_valid or not y.is_valid
                if not near:
                    differ = _fewest_different(*(z.values.to_numpy(zero_copy_only=False) for z in (x, y)))
                    near = differ * (100 + rule.percent) <= (n.as_py() + m.as_py()) * (100 - rule.percent)
                keep.append(near)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = in_few_tasks(in_few_tasks(pairs.join(a, "u", "left"), n_pairs).join(b, "v", "left"), n_pairs)
    return in_few_tasks(both.mapInArrow(_seq.released(run), "u long, v long").distinct(), n_pairs)


def verified(pairs: DataFrame, texts: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (u, v), which are written, whose sets are similar enough."""
    pairs = materialize(_by_wide_sketch(pairs, found, rule), "near-pairs")
    n_pairs = pairs.count()
    chosen = sets(texts, rule, bitmap(pairs.select(F.explode(F.array("u", "v")).alias("node"))))
    a, b = (chosen.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}")) for k in "uv")
    both = in_few_tasks(in_few_tasks(pairs.join(a, "u"), n_pairs).join(b, "v"), n_pairs)
    both = both.withColumn("common", F.size(F.array_intersect("tu", "tv")))
    similar = F.col("common") * 100 >= (F.size("tu") + F.size("tv") - F.col("common")) * rule.percent
    return both.where(similar).select("u", "v")


def _of_several_components(members: DataFrame, rows: int) -> DataFrame:
    """``key, node, component`` of the groups with members of several components,
    with the most frequent one, ``main``, and the number of members, ``n``.
    ``rows``: that of ``members``, about."""
    counted = in_few_tasks(members.groupBy("key", "component").agg(F.count("*").alias("c")), rows)
    main = counted.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("k")
    )
    main = in_few_tasks(main.where("k > 1").drop("k"), rows)
    return in_few_tasks(members.join(main, "key").select("key", "node", "component", "main", "n"), rows)


def _many_pairs(mixed: DataFrame) -> tuple[bool, int]:
    """Whether pairing the outside members takes many comparisons a member, and
    the number of members."""
    outside = F.sum(F.when(F.col("component") != F.col("main"), F.col("n")))
    row = mixed.agg(outside.alias("pairs"), F.count("*").alias("members")).first()
    return (row["pairs"] or 0) > FEW_PAIRS * row["members"], row["members"]


def _stars(mixed: DataFrame, rows: int, sketch: DataFrame, rule: Rule, turn: int) -> DataFrame:
    """(u, v) of a group's members and the one that a hash picks in it, of
    another component, whose sketches allow a link."""
    picked = F.min_by(F.struct(F.col("node").alias("v"), F.col("component").alias("cv")), F.xxhash64("key", "node", F.lit(turn)))
    hubs = in_few_tasks(mixed.groupBy("key").agg(picked.alias("hub")), rows)
    pairs = in_few_tasks(mixed.join(hubs, "key").where(F.col("component") != F.col("hub.cv")), rows)
    return _allowed(pairs.select(F.greatest("node", "hub.v").alias("u"), F.least("node", "hub.v").alias("v")), rows, sketch, rule)


def _allowed(pairs: DataFrame, rows: int, sketch: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (u, v), at most ``rows``, once each, whose sizes and
    sketches allow a link."""
    x, y = (
        sketch.select(F.col("node").alias(k), F.col("n_shingles").alias(n), *[F.col(f"s{i}").alias(f"{c}{i}") for i in range(SKETCH_LONGS)])
        for k, n, c in (("u", "n", "a"), ("v", "m", "b"))
    )
    both = in_few_tasks(in_few_tasks(pairs.distinct(), rows).join(x, "u"), rows).join(y, "v")
    return in_few_tasks(both.where(_may_link(rule, "n", "m", "a", "b")).select("u", "v"), rows)


def _crossing(mixed: DataFrame, sketch: DataFrame, rule: Rule) -> DataFrame:
    """(u, v) of different components of a group, u outside the main one, whose
    sketches allow a link.  The outside members of a large group are dealt over
    parts, each of which meets all others."""
    cells = [f"s{i}" for i in range(SKETCH_LONGS)]
    members = mixed.join(sketch, "node").withColumn("parts", F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / PART_MEMBERS)).cast("int"))
    outside = members.where("component != main").select(
        "key",
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        F.col("node").alias("u"),
        F.col("component").alias("cu"),
        F.col("n_shingles").alias("n"),
        *[F.col(c).alias(f"a{c[1:]}") for c in cells],
    )
    others = members.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("node").alias("v"),
        F.col("component").alias("cv"),
        (F.col("component") == F.col("main")).alias("in_main"),
        F.col("n_shingles").alias("m"),
        *[F.col(c).alias(f"b{c[1:]}") for c in cells],
    )
    different = (F.col("cu") != F.col("cv")) & (F.col("in_main") | (F.col("u") > F.col("v")))
    return outside.join(others, ["key", "part"]).where(different & _may_link(rule, "n", "m", "a", "b")).select("u", "v").distinct()


def _mixed(groups: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """The members of ``groups`` (key, node) of several components by ``links``."""
    parts = connected_components(links).select("node", "component")
    marked = in_few_tasks(groups.join(parts, "node", "left"), rows).withColumn("component", F.coalesce("component", "node"))
    return materialize(_of_several_components(marked, rows), "mixed")


def _by_stars(
    mixed: DataFrame, links: DataFrame, sketch: DataFrame, texts: DataFrame, found: DataFrame, rule: Rule
) -> tuple[DataFrame, DataFrame]:
    """The groups that stay of several components, and the links, after turns of
    stars, each a comparison for each member.  They end when a turn joins few
    members, so that few of those that are left have links to most of a group."""
    for turn in range(STAR_TURNS):
        many, rows = _many_pairs(mixed)
        if not many:
            break
        more = materialize(verified(materialize(_stars(mixed, rows, sketch, rule, turn), "stars"), texts, found, rule), "links")
        n_more = more.count()
        if not n_more:
            break
        links = links.unionByName(more)
        mixed = _mixed(mixed.select("key", "node"), rows, links)
        if n_more < FEW_LINKS:
            break
    return mixed, links


def near_duplicates(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("node"), "text")
    found = materialize(features(rows, rule), "sketches")  # no texts, no sets

    # equal sets: one class, spoken for by its smallest node
    full = found.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "h1", "h2").agg(F.min("node").alias("rep"))
    same_set = ["n_shingles", "h1", "h2"]
    members = materialize(full.join(classes, same_set).select("node", "rep", "n_shingles", "sketch"), "members")
    lead = members.where("node = rep")
    sketch = lead.select("node", "n_shingles", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_LONGS)]).distinct()
    spoken_for = members.where("node != rep").select("node").distinct().join(lead, "node", "left_anti")
    members = members.select("node", "rep")

    # word groups of two nodes or more; ordered, so that a group is never held
    bits = bitmap(spoken_for)
    dealt = block_keys(rows, rule, bits, False).unionByName(block_keys(rows, rule, bits, True).join(spoken_for, "node", "left_anti"))
    group = W.partitionBy("key").orderBy("node")
    grouped = dealt.select("key", "node", F.lag("node").over(group).alias("back"), F.lead("node").over(group).alias("on"))
    grouped = grouped.withColumn("first", F.first("node").over(group.rowsBetween(W.unboundedPreceding, 0)))
    grouped = materialize(grouped.where("back is not null or on is not null").select("key", "node", "first"), "groups")

    n_grouped = grouped.count()
    stars = _allowed(grouped.where("node > first").select(F.col("node").alias("u"), F.col("first").alias("v")), n_grouped, sketch, rule)
    links = materialize(verified(materialize(stars, "stars"), rows, found, rule), "links")

    # round 2: the members beside the first, where they are of several components
    mixed = _mixed(grouped.where("node != first").select("key", "node"), n_grouped, links)
    mixed, links = _by_stars(mixed, links, sketch, rows, found, rule)
    wide = materialize(mixed.where(F.col("n") > LARGE).select("node", "component").distinct(), "wide")
    if not wide.isEmpty():
        tokens = materialize(rare_tokens(rows, rule, bitmap(wide)).join(wide, "node"), "rare")
        mixed = materialize(mixed.where(F.col("n") <= LARGE).unionByName(_of_several_components(tokens, tokens.count())), "mixed")
    crossing = _crossing(mixed, sketch, rule)
    more = verified(materialize(crossing, "crossing"), rows, found, rule)

    joined = connected_components(links.unionByName(more).unionByName(members.select(F.col("node").alias("u"), F.col("rep").alias("v"))))
    out = found.select("node", "n_shingles").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(back("node").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Rule(n=3, percent=90))


#: All pairs that share an n-gram, then the closure of the links: for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
