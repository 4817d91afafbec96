"""SimHash near-dedup: fingerprints, a segment-popcount grid join, and connected components.

Exact copies collapse first: only distinct fingerprints are compared. A fingerprint is embedded as the
bit counts of its 32 segments of two bits. Changing one bit changes one count by one, so the Manhattan
distance of two embeddings is a lower bound of their Hamming distance, and links are pairs in range d = 4.

The range join is done on grids of width one over some of the dimensions, so that no neighbouring cell
needs to be probed. Proof: let u and v be embeddings whose Manhattan distance is at most d, and cut the 32
dimensions into d + z groups. Counts are whole numbers, so u and v differ in at most d dimensions, which
lie in at most d groups; they are equal in all dimensions of at least z groups. For each choice
of z groups there is a grid over their dimensions, so one grid has u and v in the same cell. A pair of
one cell is compared by its Manhattan distance over all 32 dimensions, then by its Hamming distance,
so the join gives exactly the links. (One grid over all dimensions would need the 600,000 cells in
range around each point, and one over few coarse dimensions tells points apart too little.)

A cell gives a spanning forest of its links, never all pairs; links that lie in several cells are found
in each. z grows with the number of fingerprints, so cells stay small; the result is the same for every z.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import checkpointed, free_names, importable, map_texts, quoted, slices
from .components import component_roots

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Members of a cell that one task compares with each other; larger cells are split into blocks.
CELL_MEMBERS = 16_384
#: Fingerprints up to which z = 1 and z = 2 grids are used at radius RADIUS.
GRIDS = (4 << 20, 1 << 30)

#: Keys that may be broadcast: fewer than so many can hold more than that part of all rows.
HOT_KEYS = 10_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOW = np.uint64(0x5555555555555555)
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the shingles' XXH64 values, the majority of each bit; 0 if there is no word.

    Words are what stands between ASCII white space, A-Z lower-cased; a text of fewer words has one
    shingle, all its words.
    """
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    values = np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(values[at : at + 8192, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): a row for each row, the 64 bits as a signed integer."""

    def make() -> Callable:
        return lambda ids, texts: [ids, [signed(fingerprint(t, shingle)) for t in texts]]

    return map_texts(docs, make, "doc_id long, fp long", ["doc_id", "fp"], [pa.int64(), pa.int64()], id_col, text_col)


def embed(fp: np.ndarray) -> np.ndarray:
    """Counts of each two-bit segment in unary (00, 01, 11), so that bits that differ add up to the Manhattan distance."""
    either, both = (fp | (fp >> np.uint64(1))) & _LOW, fp & (fp >> np.uint64(1)) & _LOW
    return either | (both << np.uint64(1))


def grid_masks(z: int, radius: int = RADIUS) -> list[int]:
    """For each grid the bits of the embedding that make up its cells: z of radius + z groups."""
    edges = [2 * (32 * k // (radius + z)) for k in range(radius + z + 1)]
    groups = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(groups, z)]


def _spanning(fp: np.ndarray, side: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links (index pairs) within a cell, enough to connect what is linked.

    side: if given, only members of different blocks are compared.
    """
    n, unary = len(fp), embed(fp)
    if side is not None and not 0 < side.sum() < n:
        return []
    label, links = np.arange(n), []
    rows = np.arange(n) if side is None else np.flatnonzero(~side)
    cols = np.arange(n) if side is None else np.flatnonzero(side)
    step = max(1, (1 << 18) // max(1, len(cols)))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        near = np.bitwise_count(unary[own, None] ^ unary[cols]) <= radius
        if side is None:
            near &= own[:, None] < cols
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            a = int(own[k])
            found = cols[near[k]]
            found = found[label[found] != label[a]]  # what is joined already needs no link
            found = found[np.bitwise_count(fp[a] ^ fp[found]) <= radius]
            if len(found):
                groups, first = np.unique(label[found], return_index=True)
                links += [(a, int(b)) for b in found[first]]
                moved = np.arange(n)
                moved[groups] = label[a]
                label = moved[label]
    return links


def _cells(radius: int) -> Callable:
    """Reads members sorted by cell and gives each cell's links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(members: list[np.ndarray]) -> list[tuple[int, int]]:
            fp = np.concatenate([m[0] for m in members])
            if len(fp) < 2:
                return []
            side, cross = np.concatenate([m[1] for m in members]), members[0][2]
            fp, keep = np.unique(fp, return_index=True)
            s = fp.view(np.int64)
            return [(int(s[a]), int(s[b])) for a, b in _spanning(fp, side[keep] if cross else None, radius)]

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held, at, found = [], None, []
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("grid", "cell", "i", "j")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            side = batch.column("side").to_numpy(zero_copy_only=False).astype(bool)
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                key = tuple(int(c[a]) for c in columns)
                if held and key != at:
                    found += links(held)
                    held = []
                at = key
                held.append((fp[a:b], side[a:b], key[2] != key[3]))
            if len(found) > 50_000:
                yield emit(found)
                found = []
        if held:
            found += links(held)
        if found:
            yield emit(found)

    return run


def links(classes: DataFrame, n: int, radius: int = RADIUS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect what is linked. n: their number."""
    # cells of two-bit segments agree by chance with 3/8 a segment, so a larger radius needs more grids earlier
    z = 1 + sum(n > most * (8 / 3) ** (32 * k / (radius + k) - 32 * k / (RADIUS + k)) for k, most in enumerate(GRIDS, 1))
    fp = F.col("fp")
    low = F.lit(0x5555555555555555).cast("long")
    high = F.shiftrightunsigned(fp, 1)
    unary = (fp.bitwiseOR(high)).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))
    masks = F.array(*[F.lit(signed(m)) for m in grid_masks(z, radius)])
    members = classes.select(fp, unary.alias("u"), F.posexplode(masks).alias("grid", "mask")).select("grid", F.col("u").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    zero = F.lit(0)
    whole = members.select("grid", "cell", zero.alias("i"), zero.alias("j"), F.lit(False).alias("side"), "fp")
    large = members.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_members)
    if not large.isEmpty():
        # blocks of a large cell meet pairwise, each pair in a task of its own
        parts = F.ceil(F.col("n") / F.lit(cell_members)).cast("int")
        dealt = members.join(large, ["grid", "cell"], "left").withColumn("k", F.coalesce(parts, F.lit(1))).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        each = dealt.select("grid", "cell", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
        whole = each.select("grid", "cell", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).alias("side"), "fp")
    key = ["grid", "cell", "i", "j"]
    return whole.repartition(*key).sortWithinPartitions(*key).mapInArrow(_cells(radius), "a long, b long")


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups (one for each key, n: its rows), whatever part of the rows one key holds.

    Of `total` rows fewer than HOT_KEYS keys can hold more than total / HOT_KEYS each: those groups are
    broadcast, all others are dealt by the key.
    """
    most = max(total / HOT_KEYS, 1000)
    hot, cold = F.broadcast(groups.where(F.col("n") > most).drop("n")), groups.where(F.col("n") <= most).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n, root, component_id): for each distinct fingerprint its rows, its component and the smallest doc_id that links reach.

    prints: (doc_id, fp), staged by the caller, as the result is.
    """
    importable(prints.sparkSession)
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    count = classes.count()
    roots = component_roots(links(classes, count, radius))
    rooted = checkpointed(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return checkpointed(join_by_hot_key(rooted, linked, "root", count).select("fp", F.col("rows").alias("n"), "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each document.

    Fingerprints of `shingle` words link at `radius` or fewer differing bits; component_id is the smallest
    doc_id that links reach, a document's own included. Null text and text without words have fingerprint
    zero and link like any other. Repeated rows stay, equal in all columns. A null id stays null and
    is no component's id unless a component has no other. An empty table gives an empty one. Other
    columns are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    found = fingerprint_classes(prints, radius).select("fp", "n", "component_id")
    joined = join_by_hot_key(prints, found, "fp", prints.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents, of each component only the one with the smallest id; all columns stay, whatever their names.

    Of rows that repeat id and text one stays. A document of null id stays where it is alone in its
    component. Null text and text without words have fingerprint zero and count as copies of each other.
    An empty table gives an empty one.
    """
    names = [quoted(n) for n in docs.columns]
    row_text, k_id, k_th, k_n = free_names(docs.columns, "__row_text", "__k_id", "__k_th", "__k_n")
    own_id = F.col(quoted(id_col))
    hashed = docs.withColumn(row_text, F.xxhash64(quoted(text_col)))
    importable(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = pa.array([signed(fingerprint(t, shingle)) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), prints], names=["doc_id", "th", "fp"])

    own = hashed.select(own_id.cast("long").alias("doc_id"), F.col(row_text).alias("th"), F.col(quoted(text_col)).alias("text"))
    prints = checkpointed(own.mapInArrow(run, "doc_id long, th long, fp long"))
    found = fingerprint_classes(prints, radius).select(F.col("fp").alias("own_fp"), "root", "component_id")
    # dealt by fingerprint and id, so that copies spread
    best = prints.join(found, (F.col("fp") == F.col("own_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    # ids that repeat within a component: one text of them stays
    best = best.groupBy("root", "doc_id", "fp", "th").agg(F.count(F.lit(1)).alias("n"))
    best = checkpointed(best.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "th", "n")).alias("x")).select("x.*"))
    keepers = best.select(F.col("doc_id").alias(k_id), F.col("th").alias(k_th), F.col("n").alias(k_n))
    # the built side holds three numbers a kept document, the other one its row
    kept = hashed.join(keepers.hint("shuffle_hash"), own_id.eqNullSafe(F.col(k_id)) & (F.col(row_text) == F.col(k_th)))
    if best.where("n > 1").isEmpty():
        return kept.select(*names)
    once, often = kept.where(F.col(k_n) == 1), kept.where(F.col(k_n) > 1).dropDuplicates([id_col, row_text])
    return once.unionByName(often).select(*names)
