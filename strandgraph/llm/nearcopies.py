"""Near copies by the Jaccard similarity of five-word shingles: SimHash proposes first, MinHash what it cannot reach.

Fingerprints of the five-word shingles are searched as in ``simhash``: texts
within ``RADIUS`` bits are candidates.  Two texts of similarity 0.8 differ in
about ten of 64 bits, and no partition of 64 bits makes a search of that radius
selective, so this alone would lose most near copies.  Therefore texts that
agree in one of ``BANDS`` bands of ``ROWS`` minima of the same shingles are
candidates too.  Shingles decide: a pair is linked only if its whole sets have a
similarity of ``SIMILAR`` or more.  A pair of exactly that similarity shares no
band with probability ``(1 - 0.8 ** 4) ** 32``, 5e-8; more alike ones still
less.  In each bucket of the first ``EARLY`` bands every text is compared with
one; in the buckets of all bands those are that are not yet in its class; then
members of classes that still differ are compared within blocks of their bucket: by a byte of
each of their minima, of which ``AGREE`` must agree, and then by their whole
sets.  Each pair is compared in the first bucket that both are in, and blocks
give only links that join classes, so what is put out grows with the texts and
not with the pairs of a group.  Shingles are made again from the texts of candidates only; none are kept for others.

Defined results: words are those of ``simhash.fingerprint``; texts of fewer than
five words have one shingle, the text; null and empty texts are copies of each
other; rows with a null ``doc_id`` get the component of those they are linked
to (null if none has an id) and link no others; repeated rows give repeated
result rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import give_back, group_starts, whole_groups
from strandgraph.llm.simhash import BITS, keep_first, pair_blocks
from strandgraph.llm.simhash import links as bit_links
from strandgraph.operators.components import components
from strandgraph.storage import Scratch

#: Words of a shingle; the least similarity, as a fraction; bits that proposed fingerprints differ in at most; bands and the minima in each.
WIDTH, SIMILAR, RADIUS, BANDS, ROWS = 5, (4, 5), 3, 32, 4
#: Bands that are searched before any classes are known.
EARLY = 4
#: Of all minima, those that must agree before whole sets are compared within blocks: fewer do at similarity 0.8 with probability 2e-7.
AGREE = 78
#: Shingles in the sets of a block.
BLOCK_SHINGLES = 1_000_000
#: Candidate texts whose hashes are broadcast at most (16 bytes each); more are joined by sorting.
BROADCAST = 2_000_000
_ODD = np.random.default_rng(17).integers(0, 2**63, BANDS * ROWS, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(w, 42) for w in words], np.uint64)
    n = len(h) - WIDTH + 1
    out = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        out = out * _PRIME + h[k : k + n]
    return np.unique(_mix(out))


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key per band of the minima of a set of shingles; a byte of each minimum and four of each key."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(found), 1024):  # bounds memory for very long texts
        low = np.minimum(low, (_ODD[:, None] * found[None, i : i + 1024]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key * _PRIME + column)
    return key, _mix(low).astype(np.uint8).tobytes() + key.astype("<u4").tobytes()


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 65_536):
        total += np.unpackbits(found[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(found), bitorder="little").view(np.uint64)[0])


def _node(found: np.ndarray) -> int:
    """A hash of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def marks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, node, n, fp, keys, sketch)``; ``node`` is a hash of the set, ``n`` its size, ``fp`` its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fp = (np.zeros(b.num_rows, t) for t in (np.uint64, np.int32, np.uint64))
            keys, sketch = np.zeros((b.num_rows, BANDS), np.uint64), []
            for i, t in enumerate(b.column(1)):
                s = shingles(t.as_py())
                keys[i], held = bands(s)
                sketch.append(held)
                node[i], n[i], fp[i] = _node(s), len(s), fingerprint(s)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(BANDS))
            lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), lists, pa.array(sketch, pa.binary())], ["doc_id", "node", "n", "fp", "keys", "sketch"])
        give_back()

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n int, fp long, keys array<long>, sketch binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the texts of ``wanted(doc_id, node)``."""
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    src = _texts(docs).join(wanted, "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
                same = np.flatnonzero(node == part.column(0).to_numpy()).tolist()  # another text may have the same id
                ends = np.cumsum([0, *[len(sets[i]) for i in same]]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in same]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[same]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "shingles"])
        give_back()

    return src.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose shingles are similar enough; ``sets(node, shingles)``."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src")
    both = both.join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst")
    p, q = SIMILAR
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return both.filter(common * (p + q) >= (F.size("a") + F.size("b")).cast("long") * p).select("src", "dst")


def _pairs(rows: DataFrame) -> DataFrame:
    """Different pairs of ``rows(src, dst, m, n)`` whose sizes allow the similarity."""
    p, q = SIMILAR
    rows = rows.filter((F.col("src") != F.col("dst")) & (F.least("m", "n") * q >= F.greatest("m", "n") * p))
    return rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` that ``verified`` keeps, written; ``nodes(node, doc_id)`` names a text for each set."""
    pairs = scratch.write(pairs, compact=True)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = scratch.write(nodes.select("node", "doc_id").join(ends, "node"), compact=True)
    sets = scratch.write(shingle_sets(docs, wanted))
    out = scratch.write(verified(pairs, sets), compact=True)
    scratch.drop(pairs, wanted, sets)
    return out


def links(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes(node, doc_id, n, fp, keys, sketch)`` with distinct ``node`` -> pairs that span each group of linked nodes."""
    prints = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("c")).select("fp", F.col("c.node").alias("node"), F.col("c.n").alias("m"))
    prints = scratch.write(prints, compact=True)
    bits = bit_links(prints.select("node", "fp"), RADIUS, scratch)
    bits = bits.groupBy(F.greatest("src", "dst").alias("dst")).agg(F.min(F.least("src", "dst")).alias("src"))  # the bands find what this leaves out
    sizes = nodes.select("node", "n")
    bits = bits.join(sizes.select(F.col("node").alias("src"), F.col("n").alias("m")), "src").join(sizes.select(F.col("node").alias("dst"), "n"), "dst")
    alike = nodes.join(prints.select("fp", F.col("node").alias("src"), "m"), "fp").select("src", F.col("node").alias("dst"), "m", "n")
    keyed = scratch.write(nodes.select("node", "n", F.posexplode("keys").alias("band", "key")))
    first = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    first = scratch.write(first.select("key", F.col("c.node").alias("src"), F.col("c.n").alias("m")), compact=True)
    star = keyed.filter(F.col("band") < EARLY).join(first, "key").select("src", F.col("node").alias("dst"), "m", "n")
    near = _confirmed(_pairs(bits.select("src", "dst", "m", "n").unionByName(alike).unionByName(star)), nodes, docs, scratch)

    class_of = components(near, scratch)
    shared = keyed.join(first.select("key"), "key").select("key", "band", "node", "n")
    placed = scratch.write(_placed(shared, class_of), compact=True)
    head = first.join(class_of, first["src"] == class_of["node"], "left").select("key", "src", "m", F.coalesce("component", "src").alias("of"))
    star = placed.join(head, "key").filter("class <> of").select("src", F.col("node").alias("dst"), "m", "n")
    near = scratch.write(near.unionByName(_confirmed(_pairs(star), nodes, docs, scratch)), compact=True)

    shared = scratch.write(_placed(placed.select("key", "band", "node", "n"), components(near, scratch)), compact=True)
    mixed = shared.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key")
    rows = scratch.write(shared.join(mixed, "key").join(nodes.select("node", "sketch"), "node"), compact=True)
    close = scratch.write(_close(rows, scratch).distinct(), compact=True)
    wanted = scratch.write(nodes.select("node", "doc_id").join(close.select("node").distinct(), "node"), compact=True)
    rows = rows.join(close, ["key", "node"]).join(shingle_sets(docs, wanted), "node")
    return near.unionByName(_joined(scratch.write(rows), scratch))


def _blocks(batches: Iterator[pa.RecordBatch], order: list[str], rows: int) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray]]:
    """For each 64 rows of a block: the block, their first row and the pairs (rows of the 64, rows of the block) that are close in sketch and meet first here."""
    for table in whole_groups(batches, order, rows):
        group, band, lo, hi, own = (table.column(c).to_numpy() for c in ("class", "band", "lo", "hi", "own"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * (ROWS + 4))
        sketch, keys = sketch[:, : BANDS * ROWS], np.ascontiguousarray(sketch[:, BANDS * ROWS :]).view("<u4")
        starts = group_starts(table, order).tolist()
        for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True):
            for i in range(a, z, 64):
                j = min(i + 64, z)
                same = ((sketch[i:j, None] == sketch[None, a:z]).sum(axis=2) >= AGREE) & (group[i:j, None] < group[None, a:z])
                if lo[a] != hi[a]:  # the blocks meet themselves elsewhere
                    same &= own[i:j, None] != own[None, a:z]
                x, y = np.nonzero(same)
                first = (keys[x + i] == keys[y + a]).argmax(axis=1) == band[a]
                yield table.slice(a, z - a), i - a, x[first], y[first]


def _close(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(key, band, class, node, n, sketch)`` -> ``(key, node)`` of nodes close to one of another class in the same bucket, repeats included."""
    keyed = pair_blocks(rows, ["key"], "node", scratch)
    order = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, x, y in _blocks(batches, order, 20_000):
            some = np.union1d(x + at, y)
            if len(some):
                yield block.select(["key", "node"]).take(pa.array(some)).combine_chunks().to_batches()[0]

    return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "key long, node long")


def _joined(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(key, band, class, node, n, sketch, shingles)`` -> ``(src, dst)``: similar pairs that join the classes of each block."""
    keyed = pair_blocks(rows, ["key"], "node", scratch, "n", BLOCK_SHINGLES)
    order = ["key", "lo", "hi"]
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        src, dst = [], []
        for block, at, x, y in _blocks(batches, order, 2_000):
            if not at:
                root.clear()
                held = block.column("shingles").combine_chunks()
                ends, flat = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
                group, node = block.column("class").to_pylist(), block.column("node").to_pylist()
            for i, j in zip((x + at).tolist(), y.tolist(), strict=True):
                u, v = find(group[i]), find(group[j])
                if u != v:
                    a, b = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                    if min(len(a), len(b)) * q >= max(len(a), len(b)) * p and len(np.intersect1d(a, b, assume_unique=True)) * (p + q) >= (len(a) + len(b)) * p:
                        root[max(u, v)] = min(u, v)
                        src.append(node[i])
                        dst.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
        give_back()

    return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "src long, dst long")


def _placed(rows: DataFrame, class_of: DataFrame) -> DataFrame:
    """``rows(key, band, node, n)`` with the ``class`` of each node, itself if none was found."""
    return rows.join(class_of, "node", "left").select("key", "band", F.coalesce("component", "node").alias("class"), "node", "n")


def near_copies(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, component_id)`` for every row.

    ``component_id`` is the smallest ``doc_id`` reachable over links of texts
    with a similarity of ``SIMILAR`` or more.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(marks(docs))
    known = marked.filter("doc_id is not null")
    nodes = known.groupBy("node").agg(F.min(F.struct("doc_id", "n", "fp", "keys", "sketch")).alias("r"))
    nodes = scratch.write(nodes.select("node", "r.*"), compact=True)
    found = components(links(nodes, docs, scratch), scratch)
    classes = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class"))
    classes = scratch.write(classes, compact=True)
    least = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    classes = scratch.write(classes.join(least, "class").select("node", "component_id"), compact=True)
    scratch.keep_only(marked, classes)
    return marked.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one document of each group of near copies stays, as ``simhash.keep_first`` says."""
    return keep_first(docs, near_copies(docs))
