"""Near-duplicate documents: MinHash signatures joined through a multi-index over their chunks.

A document's signature has 27 symbols of 32 bits (MinHash minima) in nine chunks of three. Two signatures that differ
in at most 17 symbols agree, by the pigeonhole principle, on some chunk up to one error; each chunk is therefore entered
three times, each time without another of its symbols, and a plain equality join on these entries meets every pair
under that distance. A pair with a Jaccard similarity of 0.75 differs in more than 17 symbols with a probability of
6e-6, and even then most often still shares an entry. The signature ends in 192 further symbols of four bits, of which
at most 86 may differ (at 0.75 more do with a probability of 7e-11), and in a parity bitmap, whose bound is exact; they
are compared where two signatures meet, before the links are confirmed on the full shingle sets.

Copies of a text are one class. Within an entry each member is first tried with its nearest hubs only, and in some more
turns with other hubs, as long as these link a tenth of them; members that end in different components afterwards are tried
against each other, so that no link between different texts is lost while a group of near copies is never paired out. An
entry with many such members is dealt over several tasks.

Nulls, empty texts and texts without words have no shingles and link with nothing. A row without doc_id links with
nothing, keeps a null component_id and counts as kept. Rows that repeat a doc_id count as one document: they share a
component. Extra columns are ignored; an empty table gives no rows. Very long texts and words are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, mixed, row_slices, small_batches, text_bytes, word_hashes, written

SHINGLE_WORDS = 5
CHUNKS, CHUNK_SYMBOLS, NIBBLES = 9, 3, 192
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
FINE = NIBBLES // 16
#: Longs of a bitmap in which each shingle flips one bit: two bitmaps differ in no more bits than the sets in shingles.
PARITY = 16
#: Of the 192 four-bit symbols: mean and seven standard deviations at a similarity of 0.75.
MOST_DIFFERENT = 86
#: Hubs with which each member is tried first: the nearest of at most one for each of its entries.
HUBS = 3
#: Turns in which members that are still apart are tried with another hub of their entries, drawn by hash.
TURNS = 3
#: Members of an entry that one task tries against the rest of it.
SPREAD = 256
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**32, SYMBOLS + NIBBLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLACES = mixed(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes; and two hashes of its whole word sequence."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    places = _PLACES if width == SHINGLE_WORDS else mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(0, np.uint64)
    if len(words) >= width:
        n = len(words) - width + 1
        rolled = words[:n] * places[0]
        for k in range(1, width):
            rolled += words[k : n + k] * places[k]
        rolled = mixed(rolled)
    sets, one, two = [], np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        own = words[end - n : end]
        if n >= width:
            found = np.unique(rolled[end - n : end - width + 1])
        elif n:
            found = mixed((own * places[:n]).sum(keepdims=True) + np.array([n], np.uint64) * np.uint64(0x5851F42D4C957F2D))
        else:
            found = own
        sets.append(found)
        if n:
            order = np.arange(n, dtype=np.uint64) * np.uint64(2)
            one[i], two[i] = mixed(own + order * np.uint64(0xA24BAED4963EE407)).sum(), mixed((own ^ np.uint64(0xC2B2AE3D27D4EB4F)) + order * np.uint64(0x9FB21C651E98DF25)).sum()
    return sets, one, two


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 219 minima for each non-empty set."""
    if not sets:
        return np.zeros((0, SYMBOLS + NIBBLES), np.uint32)
    out = np.empty((len(sets), SYMBOLS + NIBBLES), np.uint32)
    sizes = np.array([len(s) for s in sets])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    firsts = np.cumsum(sizes) - sizes
    space = np.empty_like(values)
    for k, m in enumerate(_MULTIPLIERS):
        np.multiply(values, m, out=space)
        out[:, k] = np.minimum.reduceat(space, firsts)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The minima of four bits as longs of sixteen."""
    fine = (minima & 0xF).astype(np.uint64).reshape(len(minima), FINE, 16)
    return (fine << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's parity bitmap as 16 longs."""
    bits = 64 * PARITY
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64) if sets else np.zeros(0, np.int64)
    odd = (np.bincount(rows * bits + place, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(len(sets), bits)
    return np.packbits(odd, axis=1).view(np.int64)


_SYMBOLS, _LONGS = [f"c{i}" for i in range(SYMBOLS)], [f"s{i}" for i in range(FINE + PARITY)]
_SIGNED = f"doc_id long, n_shingles long, k1 long, k2 long, {', '.join(f'{c} int' for c in _SYMBOLS)}, {', '.join(f'{c} long' for c in _LONGS)}"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in row_slices(offsets):
            sets, one, two = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            symbols, longs = np.zeros((hi - lo, SYMBOLS), np.int32), np.zeros((hi - lo, len(_LONGS)), np.int64)
            own = [sets[i] for i in full]
            minima = signatures(own)
            symbols[full] = minima[:, :SYMBOLS].view(np.int32)
            longs[full] = np.concatenate([packed(minima[:, SYMBOLS:]), parities(own)], 1)
            columns = [batch.column(0).slice(lo, hi - lo), *map(pa.array, (sizes, one.view(np.int64), two.view(np.int64), *symbols.T.copy(), *longs.T.copy()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k1", "k2", *_SYMBOLS, *_LONGS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in row_slices(offsets):
            sets, _, _ = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "shingles"])


def _unequal(x: str, y: str) -> str:
    """In how many of their four-bit symbols two signatures differ, as SQL."""
    def one(i: int) -> str:
        v = f"({x}.s{i} ^ {y}.s{i})"
        return f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441L)"
    return " + ".join(one(i) for i in range(FINE))


def _near(x: str, y: str) -> str:
    """Whether two signatures may belong to similar sets, as SQL.

    Similar sets of n and m shingles differ in at most (n + m) / 7 of them, so that their parity bitmaps differ in no
    more bits: this never drops a link, and is sharp for short texts. The four-bit symbols are sharp for long ones.
    """
    parity = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(FINE, FINE + PARITY))
    sizes = f"4 * {x}.n_shingles >= 3 * {y}.n_shingles and 4 * {y}.n_shingles >= 3 * {x}.n_shingles"
    return f"{sizes} and 7 * ({parity}) <= {x}.n_shingles + {y}.n_shingles and {_unequal(x, y)} <= {MOST_DIFFERENT}"


def entries(signed: DataFrame) -> DataFrame:
    """(entry, doc_id): each chunk three times, without one of its symbols."""
    one = []
    for i in range(CHUNKS):
        for k in range(CHUNK_SYMBOLS):
            rest = ", ".join(f"c{CHUNK_SYMBOLS * i + j}" for j in range(CHUNK_SYMBOLS) if j != k)
            one.append(f"xxhash64({CHUNK_SYMBOLS * i + k}, {rest})")
    return signed.select("doc_id", F.explode(F.expr(f"array({', '.join(one)})")).alias("entry"))


def confirmed(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough: one set travels with each pair, row by row."""
    pairs = written(pairs, "pairs")
    ids = bounded(written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids"))
    sets = written(documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    n, m, same = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    return both.where((n > 0) & (4 * n >= 3 * m) & (4 * m >= 3 * n)).where(100 * same >= 75 * (n + m - same)).select("a", "b")


def _tried(stars: DataFrame, signs: DataFrame, documents: DataFrame) -> DataFrame:
    """The links (a, b) of the written stars(doc_id, hub): each document with the nearest HUBS of its hubs."""
    ids = bounded(written(stars.select(F.explode(F.array("doc_id", "hub")).alias("doc_id")).distinct(), "ids"))
    signs = signs.join(ids, "doc_id", "left_semi")
    x, y = signs.alias("x"), signs.alias("y")
    tried = stars.join(x, F.col("x.doc_id") == stars["doc_id"]).join(y, F.col("y.doc_id") == stars["hub"])
    tried = tried.where(_near("x", "y")).select(stars["doc_id"].alias("b"), stars["hub"].alias("a"), F.expr(_unequal("x", "y")).alias("d"))
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("d", "a"))), 1, HUBS)  # of at most one for each entry
    return confirmed(tried.groupBy("b").agg(nearest.alias("hubs")).select(F.explode("hubs.a").alias("a"), "b"), documents)


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.join(labels, shared["doc_id"] == labels["node"], "left").select("entry", "doc_id", F.coalesce("root", "doc_id").alias("label"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_shingles, component_id, kept; see the module's text.

    What several rows share is written before it is joined, so that Spark can split a key that holds many rows.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(documents.sparkSession)
    signed = written(documents.mapInArrow(_sign, _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    classes = bounded(written(classes.select("k1", "k2", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row")), "classes"))
    copies = written(named.select("doc_id", "row", "k1", "k2").join(classes, ["k1", "k2"]).where("row <> class_row").select("doc_id", "row", "class_id"), "copies")
    signs = named.join(bounded(copies.select("row")), "row", "left_anti").select("doc_id", "n_shingles", *_SYMBOLS, *_LONGS)
    signs = written(signs, "signs")
    copies = copies.where("doc_id <> class_id").select("doc_id", "class_id").distinct()

    made = entries(signs)
    hubs = made.groupBy("entry").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("entry", "hub")
    shared = written(made.join(written(hubs, "hubs"), "entry"), "shared")

    slim = signs.drop(*_SYMBOLS)
    links = _tried(written(shared.where("doc_id <> hub").select("doc_id", "hub").distinct(), "stars"), slim, documents)
    labels = written(connected_components(links), "labels")
    for turn in range(TURNS):
        labelled = written(_labelled(shared, labels), "labelled")
        hub = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "label")).alias("hub")
        open_entries = written(labelled.groupBy("entry").agg(F.min("label").alias("least"), F.max("label").alias("most"), hub).where("least < most").select("entry", F.col("hub.doc_id").alias("hub"), F.col("hub.label").alias("own")), "hubs")
        stars = written(labelled.join(open_entries, "entry").where("label <> own").select("doc_id", "hub").distinct(), "stars")
        new = written(_tried(stars, slim, documents), "links")
        found = new.count()
        if found:
            labels = written(connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)), "labels")
        if 10 * found <= stars.select("doc_id").distinct().count():  # most share an entry without being alike
            break
    labelled = written(_labelled(shared, labels), "labelled")

    sizes = labelled.groupBy("entry", "label").agg(F.count("*").alias("n"))
    mixed_entries = sizes.groupBy("entry").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("members"))
    mixed_entries = written(mixed_entries.where("labels > 1").select("entry", "most", F.expr("cast((members + {0} - 1) div {0} as int)".format(SPREAD)).alias("salts")), "mixed")
    open_rows = labelled.join(mixed_entries, "entry").join(slim, "doc_id")
    solid = [F.coalesce(c, F.lit(0).cast("int" if c in ("salts", "salt") else "long")).alias(c) for c in ("entry", "doc_id", "label", "most", "n_shingles", *_LONGS, "salts")]
    open_rows = written(open_rows, "open").select(solid)
    left = open_rows.where("label <> most").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("x")
    right = open_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    rest = left.join(right, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.salt") == F.col("y.salt")) & F.expr(
        f"x.label <> y.label and (y.label = y.most or x.doc_id < y.doc_id) and {_near('x', 'y')}"
    )).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = confirmed(rest, documents)

    whole = written(connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    # Rows that repeat a doc_id with several texts link the classes of these texts.
    repeated = copies.groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most").select("doc_id")
    repeated = repeated.union(copies.join(signs, "doc_id", "left_semi").select("doc_id"))
    if not repeated.isEmpty():
        whole = written(connected_components(whole.select(F.col("node").alias("a"), F.col("root").alias("b")).union(copies)), "roots")
    found = copies.join(whole, F.col("class_id") == F.col("node"), "left").select(F.col("doc_id").alias("node"), F.coalesce("root", "class_id").alias("root"))
    roots = whole.unionByName(found).groupBy("node").agg(F.min("root").alias("root"))
    out = signed.select("doc_id", "n_shingles").join(roots, signed["doc_id"] == roots["node"], "left")
    component = F.least(F.coalesce("root", "doc_id"), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
