"""SimHash near-duplicates: components of fingerprints that differ in few bits.

1. Every text's fingerprint is made from XXH64 hashes of its word shingles.
2. Equal fingerprints collapse to one row, so copies cost nothing further.
3. Distinct fingerprints meet in tables keyed by all but ``max_bits`` of the blocks that their bits are
   cut into: of two fingerprints at ``max_bits`` or fewer differing bits one such key is equal, so no
   link is lost. More fingerprints make more blocks and so longer keys, and buckets stay small.
4. Within a table's bucket a pivot distance table holds the Hamming distances to many
   reference fingerprints. By the triangle inequality a pair whose coordinates differ by
   more than ``max_bits`` anywhere can't link: such pairs are discarded coordinate by
   coordinate, and the survivors are verified by their differing bits. A bucket of more
   than ``BLOCK`` fingerprints is split into blocks whose pairs are separate groups.
   Each group returns a spanning forest of its links, never all pairs.
   Wider fingerprints (``bits`` 128, 256, ...) for lower similarities meet in two kinds of
   tables instead; what either finds is linked by the same exact test. ``MIN_TABLES`` tables are
   keyed by ``MINIMA`` smallest shingle hashes, each under its own permutation: texts of
   shingle-set Jaccard j meet with probability 1 - (1 - j ** MINIMA) ** MIN_TABLES (over
   1 - 1e-13 at 0.8, 0.9999 at 0.5). ``tables`` tables are keyed by ``KEY_BITS`` sampled bits,
   for texts alike only by repeated shingles: a pair whose share of differing bits is p meets
   with probability 1 - (1 - (1 - p) ** KEY_BITS) ** tables (for 246 tables 0.99 at p = 0.15,
   0.69 at 0.2).
5. Components: smallest-label propagation with pointer jumping, each round written to the
   shared folder, until nothing changes.

Defined cases: null, empty or white-space text has fingerprint 0 and links like any other;
fewer words than a shingle make one shingle of all; repeated rows each get a row; a null id
never becomes a component id unless all ids of the component are null; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, by_row, cut, mix, pieces, read_table, release, runs, utf8, version

#: Rows of one side of a group's comparison.
BLOCK = 1024
#: Reference fingerprints of the pivot distance table.
PIVOTS = 32
#: Sampled bits of a table's key, for wide fingerprints.
KEY_BITS = 24
#: Tables keyed by smallest shingle hashes, for wide fingerprints, and hashes of such a key.
MIN_TABLES, MINIMA = 32, 2
#: Shingles whose bits are expanded at once.
_SLICE = 1 << 17
#: Bytes of text whose shingles are held at once; a longer text is taken alone.
TEXT_BYTES = 1 << 20


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each row's shingles, repeats included, and each row's range."""
    data = LOWER[data]
    inside = ~SPACE[data]
    starts, ends, first = runs(inside, offsets)
    counts = np.diff(first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)  # words, each with a space after it
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[inside]
    begin = np.cumsum(lengths + 1) - lengths - 1
    rows = np.repeat(np.arange(len(counts)), shingles)
    head = first[rows] + np.arange(bounds[-1]) - bounds[rows]
    tail = np.minimum(head + words, first[rows + 1]) - 1
    text, h = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h(text[a:b], 42) for a, b in zip(begin[head].tolist(), (begin[tail] + lengths[tail]).tolist())), np.uint64, len(head)), bounds


def fold(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each row: a bit is 1 if set in over half of its hashes."""
    rows = len(bounds) - 1
    ones = np.zeros((rows, 64), np.int64)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    for i in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = of[i : i + _SLICE]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def minima_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MIN_TABLES keys of each row that has shingles, by its set of shingles alone."""
    at = bounds[:-1][np.diff(bounds) > 0]
    odd = np.random.default_rng(32).integers(0, 1 << 64, (MIN_TABLES, MINIMA), dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(at), MIN_TABLES), np.uint64)
    for t in range(MIN_TABLES if len(at) else 0):
        key = np.full(len(at), t, np.uint64)
        for factor in odd[t]:
            key = mix(key + np.minimum.reduceat(hashes * factor, at))
        out[:, t] = key
    return out


def word_columns(bits: int) -> list[str]:
    return [f"w{i}" for i in range(bits // 64)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 64, minima: bool = False, versions: bool = False) -> DataFrame:
    """(id, w0, w1, ...) of every whole text: 64 bits of its fingerprint a column. The first
    are those of the shingles' hashes, the others of further mixings of the same hashes.
    With ``minima`` also its keys by smallest shingle hashes, none for a text without words; with
    ``versions`` also the text's hash."""
    names = word_columns(bits)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = np.zeros((len(names), len(batch)), np.uint64)
            keys, n_keys = [np.zeros(0, np.uint64)], np.zeros(len(batch) + 1, np.int32)
            for row, part, ends in pieces(data, offsets, TEXT_BYTES):
                h, bounds = shingle_hashes(part, ends, words)
                if minima:
                    keys.append(minima_keys(h, bounds).ravel())
                    n_keys[row + 1 : row + len(ends)] = MIN_TABLES * (np.diff(bounds) > 0)
                for i in range(len(names)):
                    out[i, row : row + len(ends) - 1] = fold(h, bounds)
                    h = mix(h + np.uint64(2 * i + 1))
            columns = [batch.column(0), *(pa.array(x.view(np.int64)) for x in out)]
            if versions:
                columns.append(batch.column(2))
            if minima:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(n_keys, dtype=np.int32)), pa.array(np.concatenate(keys).view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["id", *names, *["version"] * versions, *["minima"] * minima])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), version(text_col).alias("version"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", version long" * versions + ", minima array<long>" * minima)


def pivots(words: int, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(64).integers(0, 1 << 64, (n, words), dtype=np.uint64)


def pair_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, words: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, smaller root) within runs of equal ``group``.

    Side 0 and side 1 rows of a group are compared; side 2 rows with all of their group.
    ``fp`` names a row, ``words`` (rows x words) are its bits.
    """
    table = np.stack([np.bitwise_count(words ^ p).sum(axis=1, dtype=np.int16) for p in pivots(words.shape[1])], axis=1)
    n = len(fp)
    root = np.arange(n)
    starts = np.flatnonzero(np.diff(group, axis=0, prepend=-1).any(axis=1)) if group.ndim > 1 else np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
    sizes = np.diff(np.append(starts, n))
    left_over = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the group's end

    def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(table.shape[1]):  # discard by the largest coordinate difference
            keep = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[keep], b[keep]
            if not len(a):
                break
        keep = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int16) <= max_bits
        return a[keep], b[keep]

    # rows that link to their group's first row are connected: pairs of them need no comparison,
    # so a large group of near copies costs little more than one pass
    lead = np.repeat(starts, sizes)
    a, b = linked(np.flatnonzero(lead != np.arange(n)), lead[lead != np.arange(n)])
    part = np.arange(n)
    part[a] = b
    links_a, links_b = ([a], [b]) if len(a) else ([], [])
    active, step = np.arange(n), 1
    while True:
        active = active[left_over[active] > step]
        if not len(active):
            break
        a, b = active, active + step
        new = (part[a] != part[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = linked(a[new], b[new])
        if len(a):
            links_a.append(a)
            links_b.append(b)
        step += 1
    if not links_a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(fp, kind="stable")
    name = np.empty(n, np.int64)
    name[order] = np.arange(n)  # labels in order of fingerprint, so that roots are smallest
    label = name.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    root = order[label]
    linked = root != np.arange(n)
    return fp[linked], fp[root[linked]]


def sampled_masks(words: int, tables: int) -> np.ndarray:
    """(tables x words) masks of each table's sampled bits; the choice is fixed."""
    rng, out = np.random.default_rng(18), np.zeros((tables, words), np.uint64)
    for t in range(tables):
        for bit in rng.choice(64 * words, KEY_BITS, replace=False).tolist():
            out[t, bit // 64] |= np.uint64(1 << (bit % 64))
    return out


def sampled_keys(words: np.ndarray, masks: np.ndarray):
    """Yield each table's keys of fingerprints (rows x words): hashes of table and sampled bits."""
    for t, mask in enumerate(masks):
        key = np.full(len(words), MIN_TABLES + t, np.uint64)
        for i in np.flatnonzero(mask):
            key = mix(key ^ (words[:, i] & mask[i])) + np.uint64(i + 1)
        yield key


def repeated(batches):
    """(key, fp, n) of the keys that n > 1 rows have, from rows (key, fp) sorted by key."""
    held = []

    def settled(batch):
        key = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        sizes = np.diff(np.append(starts, len(key)))
        n = np.repeat(sizes, sizes)
        part = batch.filter(pa.array(n > 1))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(n[n > 1], pa.int64())], ["key", "fp", "n"])

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        last = batch.column(0)[-1].as_py()
        if held[0].column(0)[0].as_py() == last:
            continue
        whole = joined()
        end = int(np.searchsorted(whole.column(0).to_numpy(), last))
        yield settled(whole.slice(0, end))
        held = [whole.slice(end)]
    if held:
        yield settled(joined())


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(n_fps: int, max_bits: int, per_bucket: int = 16) -> list[int]:
    """Masks of the tables' key bits. A key is all but ``max_bits`` of the blocks that 64 bits are cut
    into, so of two fingerprints at ``max_bits`` or fewer differing bits one key at least is equal. There
    are as few blocks (two more than ``max_bits`` or more) as leave about ``per_bucket`` fingerprints
    or fewer to a bucket."""
    n = max_bits + 2
    while n < 2 * max_bits and n_fps >> (64 * (n - max_bits) // n) > per_bucket:
        n += 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    block = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(n)]
    return [sum(block[i] for i in some) for some in combinations(range(n), n - max_bits)]


def links(fps: DataFrame, max_bits: int = 4, bits: int = 64, tables: int | None = None, minima: DataFrame | None = None) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (fp, w0, ...) at ``max_bits`` or fewer
    differing bits. Without ``tables`` every link is found, by two equal blocks; with them, those
    that meet in a table or share a key of ``minima``, distinct rows (fp, key)."""
    names = word_columns(bits)

    def sampled(batches):
        masks = sampled_masks(len(names), tables)
        for batch in batches:
            words = np.stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(len(names))], axis=1)
            for key in sampled_keys(words, masks):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    if tables is None:
        columns = [F.col("w0").bitwiseAND(F.lit(_signed(mask))) for mask in block_masks(fps.count(), max_bits)]
        # a key is the hash of table and bits: equal hashes of different ones only add comparisons
        keys = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), c) for t, c in enumerate(columns)])).alias("key"))
        counts = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        hot = keys.join(counts.hint("shuffle_hash"), "key").withColumn("w0", F.col("fp"))
    else:
        # many more keys, nearly all of one row: these move once
        keys = fps.select("fp", *names).mapInArrow(sampled, "key long, fp long")
        keys = keys if minima is None else keys.unionByName(minima)
        hot = keys.repartition("key").sortWithinPartitions("key").mapInArrow(repeated, "key long, fp long, n long")
        hot = hot.join(fps.select("fp", *names), "fp")
    # a bucket of s blocks is s * (s + 1) / 2 groups; a row goes to the s groups of its block
    hot = hot.withColumn("s", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("s")).cast("int"))
    dealt = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
        "key",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte").alias("side"),
        "fp",
        *names,
    )

    def run(batches):
        kept = None
        for batch in batches:
            kept = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            g = kept.column(0).to_numpy()
            if g[0] == g[-1]:
                continue
            end = int(np.flatnonzero(g != g[-1])[-1]) + 1
            yield from compare(kept.slice(0, end))
            kept = kept.slice(end)
        if kept is not None and len(kept):
            yield from compare(kept)

    def compare(batch):
        own = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        words = np.stack([batch.column(4 + i).to_numpy().view(np.uint64) for i in range(len(names))], axis=1)
        a, b = pair_links(own, batch.column(2).to_numpy(), batch.column(3).to_numpy(), words, max_bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition("g").sortWithinPartitions("g", "key", "fp").mapInArrow(run, "a long, b long").distinct()


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, that connect the same nodes and are fewer: every node keeps its smallest
    partner m, and each other partner b is joined to m, where most of them meet."""
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return least.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` (a, b). Nodes are of any
    type with an order. Labels only fall, so the rounds end when none does."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    for turn in range(2):
        was, edges = edges, cut(contract(edges), f"{what}-contracted")
        if turn:
            release(was)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select(ways.alias("e")).select("e.a", "e.b"), f"{what}-edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{what}-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = label.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("r", "root")).alias("r"))
        jump = label.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = cut(step.join(jump, "r", "left").select("node", "was", F.least("r", F.coalesce("rr", "r")).alias("root")), f"{what}-labels")
        changed = new.filter("was <> root").limit(1).count()
        release(label)
        label = new.select("node", "root")
        if not changed:
            release(both)
            return label


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 4, bits: int = 64, tables: int | None = None) -> DataFrame:
    """(id, version, w0, ..., node, root) of every row. A node is a distinct fingerprint, as a struct of
    the smallest (id, version) of its rows and itself; ids come before nulls, so a component's root
    holds its smallest id, and no join by component is needed. ``version`` is the text's hash."""
    names = word_columns(bits)
    named = F.col("w0") if bits == 64 else F.xxhash64(*names)
    fp = cut(fingerprints(docs, id_col, text_col, words, bits, tables is not None, True).withColumn("fp", named), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "version"))
    distinct = fp.groupBy("fp").agg(least.alias("x"), *[F.first(x).alias(x) for x in names])
    distinct = cut(distinct.select("fp", *names, F.struct("x.none", "x.id", "x.version", "fp").alias("node")), "distinct-fingerprints")
    # texts of one fingerprint may differ in shingles, so each brings its keys
    minima = None if tables is None else fp.select("fp", F.explode("minima").alias("key")).distinct()
    pairs = cut(links(distinct.drop("node"), max_bits, bits, tables, minima), "links")
    node = distinct.select("fp", "node")
    named_pairs = pairs.join(node.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    label = components(named_pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of = node.join(label, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root"))
    return fp.join(of, "fp").select("id", "version", *names, "node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 4, bits: int = 64, tables: int | None = None) -> DataFrame:
    """(id, w0, ..., component_id): component_id is the smallest id reachable over links."""
    found = labelled(docs, id_col, text_col, words, max_bits, bits, tables)
    return found.select(F.col("id").alias(id_col), *word_columns(bits), F.col("root.id").alias("component_id"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``found`` (its ``labelled`` rows): of its smallest id, and
    of that id's rows in it the one of the smallest text hash. Rows of other components stay, whatever
    their ids. Only rows that go, or are there more than once, are looked up."""
    kept = (F.col("node") == F.col("root")) & F.col("id").eqNullSafe(F.col("root.id")) & (F.col("version") == F.col("root.version"))
    rows = found.select("id", "version", kept.alias("kept")).groupBy("id", "version").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    odd = cut(rows.filter("NOT kept OR n > 1"), "not-kept")
    stay = by_row(docs, odd.select("id", "version"), "left_anti", id_col, text_col)
    # of equal ids with equal texts one row stays, the one whose columns' hash is least
    again = by_row(docs, odd.filter("kept").select("id", "version"), "left_semi", id_col, text_col)
    others = [x for x in docs.columns if x != id_col]
    least = again.groupBy(F.col(id_col).alias("_1"), version(text_col).alias("_2")).agg(F.min_by(F.struct(*others), F.xxhash64(*docs.columns)).alias("_3"))
    once = least.select(F.col("_1").alias(id_col), *[F.col("_3").getField(x).alias(x) for x in others]).select(*docs.columns)
    return stay.unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
