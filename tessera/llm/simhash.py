"""SimHash near-dedup: pigeonhole blocks, join on blocks, verified Hamming distance.

`simhash_groups` links fingerprints a few bits apart, of which the blocks lose no pair. `likeness_groups` links texts
of a given similarity: the cosine of their shingle sets, which is what a SimHash estimates. At 0.8 (a Jaccard likeness of 2/3)
fingerprints differ in about 13 of 64 bits, for which blocks would be too short to tell documents apart, so its search takes
keys from bands of minimal shingle hashes beside the blocks; Hamming distance rules out what is unlike, and the cosine itself decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from .common import free_name, join_hot, shuffle_parts, split_blocks, written
from .graph import Forest, connected_components
from .runs import over_runs

#: Shingles whose bits are counted at a time; bounds memory for very long texts.
CHUNK = 1 << 16
#: Key runs up to this size are compared offset by offset, all runs of a frame at once; longer ones in tiles.
SHORT, TILE = 48, 256
#: Rows of shingle hashes that are permuted, or shared hashes that are counted, at a time.
STRIP = 1 << 12
#: Texts whose shingles are sent back at a time.
STEP = 64
#: Edges that share one copy of their leader's shingles.
SHARE = 512
#: Texts and shingle hashes of a block that is compared with another.
TILE_ROWS, TILE_HASHES = 512, 1 << 21


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Unsigned 64-bit hashes of the text's word shingles in order, repeats included, in arrays of bounded size.

    Only A-Z are lower-cased; words are runs of bytes other than space and \\x09-\\x0D.
    Fewer words than width: the whole sequence is the one shingle. No words or null: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(line, seed)], dtype="<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(line[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")


def majority_bits(parts: Iterator[np.ndarray]) -> int:
    """The 64-bit number whose bits are set in more than half of the hashes; 0 for none."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, each occurrence counted; no words or null: 0."""
    return majority_bits(shingle_hashes(text, width, seed))


def fingerprint_column(text, width: int, seed: int = 42):
    """Column of signed 64-bit fingerprints, never null."""

    @pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in s], dtype=np.uint64).view(np.int64))

    return fp(text)


def block_tables(blocks: int, distance: int) -> list[int]:
    """Bit masks, one for each way to choose blocks - distance of the blocks.

    Fingerprints at most `distance` apart differ in at most that many blocks, so they
    agree on all bits of one mask at least: the candidate search loses no pair.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(one, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of the fingerprint's bits under every mask."""
    return F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in block_tables(blocks, distance)])


def links(prints: DataFrame, keys: Column, limit: int, block_rows: int, ratio: float = 0.0) -> DataFrame:
    """prints(fp, fp2, node, and size where ratio is set): distinct texts or fingerprints -> (a, b, bits) links that span every linked group.

    Rows that share a key at the same place of `keys` are compared in blocks of bounded size: `limit` bits of
    fp and fp2 together may differ, and the smaller size must be at least ratio of the larger. Of the pairs that link, a block emits a
    spanning forest of those with the fewest bits.
    """
    keyed = prints.select("fp", "fp2", "node", *(["size"] if ratio else []), F.posexplode(keys).alias("_t", "_key"))
    dealt = split_blocks(keyed, ["_t", "_key"], "node", block_rows)
    by = ["_t", "_key", "_bi", "_bj"]
    dealt = dealt.repartition(shuffle_parts(prints.sparkSession), *by).sortWithinPartitions(*by)

    def kernel(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        size = np.diff(starts)
        if size.max() < 2:
            return None
        fp, fp2 = (pdf[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        side, own = pdf["_side"].to_numpy(), (pdf["_bi"] == pdf["_bj"]).to_numpy()
        node, forest, out = pdf["node"].to_numpy(), Forest(len(pdf)), []
        sizes = pdf["size"].to_numpy() if ratio else None

        def span(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            if not pairs:
                return
            i, j, bits = map(np.concatenate, zip(*pairs))
            for b in np.unique(bits):
                at = np.flatnonzero(bits == b)
                if len(k := at[forest.add(i[at], j[at])]):
                    out.append(np.stack([node[i[k]], node[j[k]], bits[k].astype(np.int64)], axis=1))

        def near(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            fit = (bits <= limit) & (own[i] | (side[i] != side[j]))
            if ratio:
                fit &= np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
            return i[fit], j[fit], bits[fit]

        run, pairs = np.repeat(np.arange(len(size)), size), []
        live = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
        for d in range(1, SHORT):
            live = live[live + d < len(run)]
            live = live[run[live] == run[live + d]]
            if not len(live):
                break
            bits = np.bitwise_count(fp[live] ^ fp[live + d]) + np.bitwise_count(fp2[live] ^ fp2[live + d])
            pairs.append(near(live, live + d, bits))
        span(pairs)
        for a, b in zip(starts[:-1][size > SHORT].tolist(), starts[1:][size > SHORT].tolist()):
            pairs = []
            for q in range(a, b, TILE):
                p = min(q + TILE, b)
                bits = np.bitwise_count(fp[q:p, None] ^ fp[None, q + 1 : b]) + np.bitwise_count(fp2[q:p, None] ^ fp2[None, q + 1 : b])
                i, j = np.nonzero(bits <= limit)
                up = i <= j
                i, j = i[up], j[up]
                pairs.append(near((i + q).astype(np.int32), (j + q + 1).astype(np.int32), bits[i, j]))
            span(pairs)
        if not out:
            return None
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "bits"])

    return dealt.mapInPandas(over_runs(by, kernel), "a long, b long, bits long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 3, blocks: int = 6, block_rows: int = 2048,
) -> DataFrame:
    """Near-duplicate groups -> one row for each row of docs: id, fingerprint (16 hex digits), component_id.

    Texts are linked when their fingerprints differ in at most `distance` bits; component_id is
    the smallest id reachable by links, the row's own included. Exact copies share a fingerprint,
    so only distinct fingerprints are searched. Null or wordless text: fingerprint zero, linked
    like any other. Null id: the row is returned with a null component_id and links nothing.
    Repeated ids: each row keeps its own fingerprint and group, and the ids' groups are joined.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint_column(F.col(text_col), width).alias("fp"))
    rows = written(rows, "prints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("fp2", F.lit(0).cast("long"))
    # A fingerprint that only rows without an id have is searched by none.
    distinct = written(distinct.where("node is not null"), "distinct")
    groups = connected_components(links(distinct, block_keys(F.col("fp"), distance, blocks), distance, block_rows))
    named = written(distinct.join(groups, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "groups")
    return join_hot(rows, named, ["fp"], "n").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second set of 64-bit hashes; a published finalizer with its fixed multipliers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; none for no words."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def signature(text: str | None, width: int, bands: int, rows: int) -> tuple[int, int, int, int, int, list[int]]:
    """(d1, d2, fp, fp2, size, keys), signed: digest of the normalised words, two SimHashes and the size of the shingle set, and
    `bands` keys, each of the minima of the shingle hashes under `rows` permutations."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(line), "<i8").tolist()
    u = distinct_hashes(text, width)
    if not len(u):
        return d1, d2, 0, 0, 0, []
    strips = lambda: (u[at : at + CHUNK] for at in range(0, len(u), CHUNK))
    fp, fp2 = majority_bits(strips()), majority_bits(map(_mixed, strips()))
    rng = np.random.default_rng(bands * 1000 + rows)
    a, b = rng.integers(1 << 63, size=(2, bands * rows, 1), dtype=np.uint64)
    a, low = 2 * a + np.uint64(1), np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(u), STRIP):
        low = np.minimum(low, (a * u[None, at : at + STRIP] + b).min(axis=1))
    keys = [_signed(xxhash.xxh64_intdigest(m.tobytes(), 7)) for m in low.reshape(bands, rows)]
    return d1, d2, _signed(fp), _signed(fp2), len(u), keys


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, key, d1, d2, fp, fp2, size, keys) of every row; key is a hash of the text as it is."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(t, width, bands, rows) for t in b.column(2).to_pylist()]
            cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *cols, pa.array([f[5] for f in found], pa.list_(pa.int64()))], names=["id", "key", "d1", "d2", "fp", "fp2", "size", "keys"]
            )

    text = F.col(text_col).cast("string")
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return rows_.mapInArrow(apply, "id long, key long, d1 long, d2 long, fp long, fp2 long, size long, keys array<long>")


def shingle_sets(edges: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, size, shingles) of the ends of edges(a, b); nodes(node, id, key) tell which row of docs to read.

    Only texts at the end of an edge are shingled, and only their hashes travel.
    """
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("key").alias("_k"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_k"), text.alias("text"))
    rows = wanted.join(rows, ["_id", "_k"]).select("node", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(at, STEP) for big in batches for at in range(0, big.num_rows, STEP)):
            sets = [distinct_hashes(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "shingles"])

    # A row that repeats an id and its text has the same node and shingles.
    return written(rows.mapInArrow(apply, "node long, size long, shingles array<long>").dropDuplicates(["node"]), "shingles")


def like_enough(edges: DataFrame, sets: DataFrame, similarity: float, share: int = SHARE) -> DataFrame:
    """The edges(a, b) whose shingle sets have at least the cosine similarity.

    The end with more edges leads: its set is copied once for every `share` of its edges, and the other end's goes there. So no task
    gets more than that of one leader, and an end that doesn't lead has at most as many edges as each of its leaders.
    """
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    degree = written(degree, "degrees")
    of = lambda x: degree.select(F.col("node").alias(x), F.col("n").alias("w"), F.col("n").alias("n" + x))
    both = join_hot(join_hot(edges.select("a", "b"), of("a"), ["a"], "w"), of("b"), ["b"], "w")
    first = F.col("na") >= F.col("nb")
    both = both.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("na", "nb").alias("n"))
    parts = lambda n: F.ceil(F.col(n) / share).cast("int")
    both = both.withColumn("part", F.pmod(F.xxhash64("node"), parts("n")).cast("int"))
    leads = sets.join(degree, "node").select(F.col("node").alias("lead"), F.col("shingles").alias("s"), F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("part"))
    rows = both.join(sets, "node").join(leads, ["lead", "part"])
    enough = F.size(F.array_intersect("shingles", "s")) >= F.lit(similarity) * F.sqrt(F.size("shingles").cast("double") * F.size("s")) - 1e-9
    return rows.where(enough).select("a", "b")


def _links_of_tile(sets: list[np.ndarray], group: np.ndarray, apart: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets alike that span what links the groups; apart[i, j] tells which pairs count."""
    size = np.array(list(map(len, sets)))
    column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row, often = np.repeat(np.arange(len(sets)), size), times[column] > 1
    row, column = row[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        a, b = np.searchsorted(column, [at, at + STRIP])
        strip = np.zeros((len(sets), STRIP), np.float32)
        strip[row[a:b], column[a:b] - at] = 1
        both += strip @ strip.T
    alike = both >= similarity * np.sqrt(np.outer(size, size).astype(float)) - 1e-9
    i, j = np.nonzero(np.triu(alike & apart, 1))
    names, index = np.unique(group, return_inverse=True)
    kept = Forest(len(names)).add(index[i], index[j])
    return i[kept], j[kept]


def links_between(edges: DataFrame, alike: DataFrame, sets: DataFrame, similarity: float, tile_rows: int = TILE_ROWS, tile_hashes: int = TILE_HASHES) -> DataFrame:
    """Links (a, b) that edges, a spanning forest of candidates, does not hold although two texts of one tree are alike.

    alike are the edges that proved to be links. A tree all of whose edges are links needs nothing more. In the others every pair of texts
    that links do not join yet is compared by the shingle sets themselves, in tiles: texts are dealt into blocks of at most about tile_rows texts
    and tile_hashes hashes, joined groups as large as a block into blocks of their own, and two blocks of one group do not meet.
    """
    tree, group = (connected_components(x).select("node", F.col("component").alias(n)) for x, n in ((edges, "tree"), (alike, "grp")))
    nodes = written(tree.join(group, "node", "left").join(sets.select("node", "size"), "node").select("node", "tree", F.coalesce("grp", "node").alias("grp"), "size"), "nodes")
    groups = nodes.groupBy("tree", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    large = (F.col("n") >= tile_rows) | (F.col("w") >= tile_hashes)
    groups = written(groups.withColumn("large", large).withColumn("pool", F.when(large, F.col("grp")).otherwise(F.lit(0))), "groups")
    pools = groups.groupBy("tree", "large", "pool").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("w") / tile_hashes)).cast("int")
    # A tree has one pool of small groups and as many others as it has blocks, so its pools are few.
    w = Window.partitionBy("tree")
    pools = pools.withColumn("parts", parts).select(
        "tree", "large", "pool", "k", "parts", F.sum("k").over(w).alias("all"), F.sum("parts").over(w).cast("int").alias("total"),
        (F.sum("parts").over(w.orderBy("large", "pool").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")).cast("int").alias("low"),
    )
    pools = written(pools.where(F.col("all") > 1).drop("all"), "pools")
    named = join_hot(groups, pools, ["tree", "large", "pool"], "k").where("total is not null")
    named = written(named.select("tree", "grp", "n", "large", "low", "parts", "total"), "named")
    dealt = join_hot(nodes, named, ["tree", "grp"], "n").where("total is not null")
    dealt = dealt.withColumn("side", F.col("low") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("total") - 1)
    own = lambda t: F.col("large") & (t >= F.col("low")) & (t < F.col("low") + F.col("parts"))
    dealt = dealt.select("node", "tree", "grp", "side", F.explode(F.filter(every, lambda t: ~own(t))).alias("other"))
    by = ["tree", "bi", "bj"]
    tiles = dealt.select("node", "tree", "grp", "side", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj")).join(sets, "node")
    tiles = tiles.repartition(shuffle_parts(sets.sparkSession), *by).sortWithinPartitions(*by)

    def kernel(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for p, q in zip(starts[:-1], starts[1:]):
            tile = pdf.iloc[p:q]
            group, side = tile["grp"].to_numpy(), tile["side"].to_numpy()
            apart = group[:, None] != group[None, :]
            if tile["bi"].iloc[0] != tile["bj"].iloc[0]:
                apart &= side[:, None] != side[None, :]
            if apart.any():
                node = tile["node"].to_numpy()
                i, j = _links_of_tile(tile["shingles"].tolist(), group, apart, similarity)
                out.append(np.stack([node[i], node[j]], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return tiles.mapInPandas(over_runs(by, kernel), "a long, b long")


def likeness_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 14, band_rows: int = 3,
    limit: int = 41, distance: int = 3, blocks: int = 5, block_rows: int = 1024, tile_rows: int = TILE_ROWS, tile_hashes: int = TILE_HASHES,
) -> DataFrame:
    """Groups of texts whose shingle sets have at least the cosine similarity -> one row per row of docs: id, key, component_id, leads.

    Candidates share a block key of their fingerprint (none within `distance` bits is lost) or one of `bands` keys of
    `band_rows` minimal hashes each: at a cosine of 0.8 (a Jaccard likeness of 2/3) a pair is found with a probability of
    1 - (1 - (2/3) ** 3) ** 14 = 0.993, at a likeness of 0.8 with 0.9999. Of two fingerprints of 64 bits each, `limit` bits may differ, which 0.999 of
    the pairs at 0.8 meet (26 are expected, with a deviation of 4.6), and sets whose sizes alone rule the similarity out are no candidates. A block of
    candidates gives on a spanning forest of its closest pairs. The cosine of the shingle sets itself decides on every edge, and where one
    fails, on all pairs of that tree which are not joined (links_between): no link is lost with an edge that fails. A group of n copies whose
    edges hold costs a few times n checks.

    key is a hash of the text. Texts with the same words are one text. component_id is the smallest id of the group; leads marks its rows that have this
    id and, if the id is repeated with different texts, the smallest key. Null or wordless texts are one text. Null ids have a null
    component_id, lead and link nothing. Other columns are ignored. An empty table gives an empty result.
    """
    rows = written(signatures(docs, id_col, text_col, width, bands, band_rows), "signatures")
    known = rows.where("id is not null")
    least = F.min(F.struct("id", "key"))
    distinct = known.groupBy("d1", "d2").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("fp", "fp2", "size", "keys")])
    distinct = written(distinct.select(F.col("d1").alias("node"), "d1", "d2", "least.*", "fp", "fp2", "size", "keys"), "distinct")
    searched = distinct.where(F.size("keys") > 0)
    found = links(searched, F.concat(block_keys(F.col("fp"), distance, blocks), F.col("keys")), limit, block_rows, similarity**2)
    edges = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    sets = shingle_sets(edges, distinct.select("node", "id", "key"), docs, id_col, text_col, width)
    alike = written(like_enough(edges, sets, similarity), "alike")
    more = written(links_between(edges, alike, sets, similarity, tile_rows, tile_hashes), "more")
    groups = connected_components(alike.unionByName(more))
    named = distinct.join(groups, "node", "left").select("d1", "d2", "id", "key", F.coalesce("component", "node").alias("component"))
    leads = written(named.groupBy("component").agg(F.min(F.struct("id", "key")).alias("lead"), F.count(F.lit(1)).alias("n")), "leads")
    named = written(join_hot(named, leads, ["component"], "n").select("d1", "d2", F.col("lead.id").alias("component_id"), F.col("lead.key").alias("lead_key")), "groups")
    out = known.select("id", "key", "d1", "d2").join(named, ["d1", "d2"]).select(
        "id", "key", "component_id", ((F.col("id") == F.col("component_id")) & (F.col("key") == F.col("lead_key"))).alias("leads")
    )
    alone = rows.where("id is null").select("id", "key", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("leads"))
    return out.unionByName(alone)


def keep_leads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that another leads in likeness_groups(); all columns as they were.

    A row goes by its id and text together, so that of an id with two texts only the copied one goes. Rows that repeat a leading id
    and text all stay, as do rows without an id. Nulls, empty tables and wordless texts: as for likeness_groups().
    """
    groups = likeness_groups(docs, id_col, text_col, **options)
    gone = written(groups.where("not leads").select(F.col("id").alias("_gone"), F.col("key").alias("_key")).distinct(), "gone")
    name, key = free_name(docs, "gone"), free_name(docs, "key")
    gone = gone.toDF(name, key)
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(name)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key)), "left_anti")
