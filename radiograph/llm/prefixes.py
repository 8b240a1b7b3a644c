"""Conversation prefix trie by composable fingerprints.

A run of turns has the fingerprint (B^n, h) in the monoid of affine maps over two prime fields of 61 bits: n turns with
elements v_1 ... v_n have h = v_1 B^(n-1) + ... + v_n, and (n, g) followed by (m, h) is (n+m, g B^m + h). Fingerprints of
all prefixes are scanned once, in sorted ranges whose totals compose, so that a conversation may span any number of
tasks. A rebuilt conversation, the head of one and the suffix of another, is never written out: with the head's product
H and that of its own first turns Q, the fingerprint after its own turn k is (H - Q) B^(k-h) + M_k, for which one number
a conversation suffices. The prefixes of equal fingerprint are a node; that they are equal is verified turn by turn by
the references (conversation, place) that they hold to the stored turns; if two should ever differ, all is done anew with
another base.

A node bears its smallest member. The nodes of one name are a chain (members only get fewer further down), so what is
summed over subtrees is summed over the tree of chains, by pointer doubling, and then along each chain.

Rows without conv_id belong to no conversation. Turns are ordered by number, null first; equal numbers by the first 32
characters of role and text and then by their hash; repeated rows are repeated turns. A null role or text is empty. An
empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, small_batches, written

P = (1 << 61) - 1
#: Conversations of one block of ids share its first one's head, of fewer turns than HEADS.
BLOCK, HEADS = 20, 4
#: Nodes of a chain that one window sums; a chain's blocks are then summed.
CHAIN_BLOCK = 4096
#: Ids that a task holds at once of a node's members.
IDS = 4096
TRIES = 4
NOTHING = hashlib.sha256(b"").hexdigest()


def bases(seed: int) -> tuple[int, int]:
    chosen = random.Random(seed)
    return chosen.randrange(1 << 32, P), chosen.randrange(1 << 32, P)


def _multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P for numbers below P, in 64-bit arithmetic."""
    low, part = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = al * bh + ah * bl
    x = ah * bh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & part) << np.uint64(31)) + al * bl
    x = (x & np.uint64(P)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    out, square, n = np.ones(len(n), np.uint64), np.array([base], np.uint64), n.copy()
    while n.any():
        out = np.where(n & 1 == 1, _multiplied(out, square), out)
        square, n = _multiplied(square, square), n >> 1
    return out


def _followed(before: np.ndarray, base: int, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The fingerprint of a run `before` followed by one of n turns with fingerprint h."""
    x = _multiplied(before, _powers(base, n)) + h
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.uint64) for n in names]


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """A written table of all turns, sorted by ranges: conv_id, pid, n, role, text, words, v1, v2, m1, m2.

    n and (m1, m2), place and fingerprint, count from the beginning of the range's part of the conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id is not null")
    order = ["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32), F.xxhash64("role", "text")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").withColumn("pid", F.spark_partition_id())
    b1, b2 = bases(seed)
    salt = seed.to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, m1, m2 = None, 0, 0, 0
        for batch in batches:
            out = [[] for _ in range(6)]
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if c != conv:
                    conv, n, m1, m2 = c, 0, 0, 0
                name, said = role.encode(), text.encode()
                digest = hashlib.blake2b(len(name).to_bytes(8, "little") + name + said, digest_size=16, salt=salt).digest()
                v1, v2 = int.from_bytes(digest[:8], "little") % P, int.from_bytes(digest[8:], "little") % P
                n, m1, m2 = n + 1, (m1 * b1 + v1) % P, (m2 * b2 + v2) % P
                for column, value in zip(out, (n, len(said.split()), v1, v2, m1, m2), strict=True):
                    column.append(value)
            held = [batch.column(c) for c in ("conv_id", "pid", "role", "text")]
            yield pa.RecordBatch.from_arrays(held + [pa.array(x, pa.int64()) for x in out], names=["conv_id", "pid", "role", "text", "n", "words", "v1", "v2", "m1", "m2"])

    return written(rows.select("conv_id", "pid", "role", "text").mapInArrow(scan, "conv_id long, pid int, role string, text string, n long, words long, v1 long, v2 long, m1 long, m2 long"), "turns")


def carried(turns: DataFrame, seed: int) -> DataFrame:
    """(pid, conv_id, n0, c1, c2): what a range's first conversation has behind it; one row a range at most."""
    b1, b2 = bases(seed)
    ends = turns.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n", "m1", "m2")).alias("end")).collect()  # one row for each range
    held, rows = None, []
    for r in sorted(ends, key=lambda r: r["pid"]):
        conv, n, m1, m2 = r["end"]
        goes_on = held is not None and held[0] == r["first"]
        if goes_on:
            rows.append((r["pid"], *held))
        if goes_on and conv == held[0]:
            n, m1, m2 = held[1] + n, (held[2] * pow(b1, n, P) + m1) % P, (held[3] * pow(b2, n, P) + m2) % P
        held = (conv, n, m1, m2)
    return F.broadcast(turns.sparkSession.createDataFrame(rows, "pid int, conv_id long, n0 long, c1 long, c2 long"))


def placed(turns: DataFrame, before: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, words, v1, v2, m1, m2) of the stored turns, places and fingerprints counted from the conversation's beginning."""
    both = bases(seed)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m1, m2, c1, c2 = _longs(batch, "n", "m1", "m2", "c1", "c2")
            full = [_followed(c, b, n.astype(np.int64), m).astype(np.int64) for c, b, m in zip((c1, c2), both, (m1, m2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "pos", "words", "v1", "v2")] + [pa.array(x) for x in full], names=["conv_id", "pos", "words", "v1", "v2", "m1", "m2"])

    rows = turns.drop("role", "text").join(before, ["pid", "conv_id"], "left")
    inside = rows.where("n0 is null").select("conv_id", F.col("n").alias("pos"), "words", "v1", "v2", "m1", "m2")
    later = rows.where("n0 is not null").withColumn("pos", F.col("n") + F.col("n0")).mapInArrow(whole, "conv_id long, pos long, words long, v1 long, v2 long, m1 long, m2 long")
    return inside.unionByName(later)


def plans(turns: DataFrame) -> DataFrame:
    """(conv_id, h, taken, length, head, d1, d2) of each conversation: how it is rebuilt.

    head has the `taken` turns from the block's first conversation; d is what the fingerprint of a prefix owes to them,
    in place of its own first h turns.
    """
    turn = F.struct("pos", "m1", "m2", "v1", "v2", "words")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, turn))).alias("own"))  # at most three turns
    own = written(own, "heads")
    rows = own.withColumn("h", F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")), F.lit(HEADS)).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    rows = rows.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs")), "base", "left")
    rows = rows.withColumn("head", F.slice(F.coalesce("theirs", F.slice("own", 1, 0)), F.lit(1), F.col("h"))).withColumn("taken", F.size("head"))
    last = lambda rows, n, m: F.when(n > 0, F.get(rows, n - 1)[m]).otherwise(F.lit(0))
    owes = lambda m: F.pmod(last(F.col("head"), F.col("taken"), m) - F.coalesce(last(F.col("own"), F.col("h"), m), F.lit(0)), F.lit(P))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return written(rows.select("conv_id", "base", "h", "taken", length.alias("length"), "head", owes("m1").alias("d1"), owes("m2").alias("d2")), "plans")


_PREFIX = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, v1 long, v2 long, words long, ref_conv long, ref_pos long, ends boolean"


def prefixes(turns: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: its fingerprint f, its parent's p, its last turn's v, words and reference."""
    both = bases(seed)
    inverse = [pow(b, -1, P) for b in both]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, m1, m2, v1, v2, d1, d2 = _longs(batch, "k", "m1", "m2", "v1", "v2", "d1", "d2")
            f = [_followed(d, b, k.astype(np.int64), m) for d, b, m in zip((d1, d2), both, (m1, m2), strict=True)]
            p = [_multiplied(np.where(x >= v, x - v, x + np.uint64(P) - v), np.array([i], np.uint64)) for x, v, i in zip(f, (v1, v2), inverse, strict=True)]
            named = dict(zip(("f1", "f2", "p1", "p2"), [pa.array(x.astype(np.int64)) for x in (*f, *p)], strict=True))
            names = [c.split()[0] for c in _PREFIX.split(", ")]
            yield pa.RecordBatch.from_arrays([named[c] if c in named else batch.column(c) for c in names], names=names)

    none, zero = F.lit(0).cast("long"), F.array().cast("array<struct<pos:bigint,m1:bigint,m2:bigint,v1:bigint,v2:bigint,words:bigint>>")
    suffix = turns.join(planned.select("conv_id", "h", "taken", "length", "d1", "d2"), "conv_id").where("pos > h")
    depth = F.col("pos") - F.col("h") + F.col("taken")
    suffix = suffix.select("conv_id", depth.alias("depth"), (F.col("pos") - F.col("h")).alias("k"), "m1", "m2", "v1", "v2", "d1", "d2", "words", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), (depth == F.col("length")).alias("ends"))
    head = planned.select("conv_id", "base", "length", F.explode(F.coalesce("head", zero)).alias("t"))
    head = head.select("conv_id", F.col("t.pos").alias("depth"), none.alias("k"), "t.m1", "t.m2", "t.v1", "t.v2", none.alias("d1"), none.alias("d2"), "t.words", F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"), (F.col("t.pos") == F.col("length")).alias("ends"))
    root = planned.select("conv_id", none.alias("depth"), *[none.alias(c) for c in ("f1", "f2", "p1", "p2", "v1", "v2", "words", "ref_conv", "ref_pos")], (F.col("length") == 0).alias("ends"))
    return written(suffix.unionByName(head).mapInArrow(fingerprints, _PREFIX).unionByName(root), "prefixes")


NODE = ["depth", "f1", "f2"]


def differing(found: DataFrame, nodes: DataFrame, turns: DataFrame, before: DataFrame) -> bool:
    """Whether some node holds prefixes that differ: in their parents or elements, or in what the stored turns say that they refer to."""
    if nodes.where("v1 <> w1 or v2 <> w2 or p1 <> q1 or p2 <> q2").limit(1).count():
        return True
    several = bounded(written(nodes.where("ref_conv <> ref_conv2 or ref_pos <> ref_pos2").select(*NODE), "several"))
    asked = found.join(several, NODE).select(*NODE, "ref_conv", "ref_pos").distinct()
    said = turns.select("pid", "conv_id", "n", "role", "text").join(before.select("pid", "conv_id", "n0"), ["pid", "conv_id"], "left")
    said = said.select(F.col("conv_id").alias("ref_conv"), (F.col("n") + F.coalesce("n0", F.lit(0))).alias("ref_pos"), "role", "text")
    told = asked.join(said, ["ref_conv", "ref_pos"]).groupBy(*NODE).agg(*[f(c).alias(f"{c}{i}") for c in ("role", "text") for i, f in enumerate((F.min, F.max))])
    return told.where("role0 <> role1 or text0 <> text1").limit(1).count() > 0


def end_digests(found: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes where conversations end: their ids, ascending, hashed as they stream by.

    Ids are sorted by ranges; those of a node that may go on in another range, or that are many, leave a task in pieces
    of IDS, which a second pass hashes in order. No task holds a node's ids at once.
    """
    keys = [*NODE, "conv_id"]
    rows = found.where("ends").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, ids, opened = [], None, [], True

        def told(open_: bool) -> None:
            text = ",".join(map(str, ids))
            out.append((*node, ids[0], None if open_ else hashlib.sha256(text.encode()).hexdigest(), text if open_ else None))

        for batch in batches:
            for *at, c in zip(*[batch.column(k).to_pylist() for k in keys], strict=True):
                if at != node:
                    if ids:
                        told(opened)
                    node, ids, opened = at, [], node is None
                elif len(ids) == IDS:
                    opened = True
                    told(True)
                    ids = []
                ids.append(c)
            yield _arrow(out)
            out = []
        if ids:
            told(True)
            yield _arrow(out)

    pieces = written(rows.mapInArrow(runs, "depth long, f1 long, f2 long, first long, digest string, piece string"), "ends")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *at, piece in zip(*[batch.column(k).to_pylist() for k in (*NODE, "piece")], strict=True):
                if at != node:
                    if node:
                        out.append((*node, None, state.hexdigest(), None))
                    node, state = at, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield _arrow(out)
            out = []
        if node:
            yield _arrow([(*node, None, state.hexdigest(), None)])

    opened = pieces.where("piece is not null").select(*NODE, "first", "piece").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    whole = opened.mapInArrow(joined, "depth long, f1 long, f2 long, first long, digest string, piece string")
    return pieces.where("digest is not null").unionByName(whole).select(*NODE, F.col("digest").alias("ends_sha256"))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["depth", "f1", "f2", "first", "digest", "piece"])


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) summed over each chain and all that hang below it; chains(conv_id, parent, leaves, saved).

    After k rounds a chain's sums cover what is less than 2^k chains below, and `up` is the chain 2^k above.
    """
    held = written(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "totals")
    while held.where("up is not null").limit(1).count():
        more = held.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = bounded(written(held.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "above"))
        held = held.join(above, "up", "left").join(more, "conv_id", "left")
        held = written(held.select("conv_id", F.col("next").alias("up"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))]), "totals")
    return held.select("conv_id", "leaves", "saved")


def below(rows: DataFrame) -> DataFrame:
    """rows(conv_id, depth, leaves, saved, ...) with n_leaves and saved_tokens: sums along each chain from a node down, block by block."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / CHAIN_BLOCK))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("l", "s")])  # one row for each block of nodes
    here = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_leaves", F.sum("leaves").over(here)).withColumn("saved_tokens", F.sum("saved").over(here))
    deep = sums.where("l > 0 or s > 0")
    return rows.join(deep, ["conv_id", "block"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    for seed in range(TRIES):
        turns = stored_turns(conversations, seed)
        before = carried(turns, seed)
        whole = placed(turns, before, seed)
        found = prefixes(whole, plans(whole), seed)
        sides = [f(c).alias(n) for c, a, b in (("v1", "v1", "w1"), ("v2", "v2", "w2"), ("p1", "p1", "q1"), ("p2", "p2", "q2"), ("ref_conv", "ref_conv", "ref_conv2"), ("ref_pos", "ref_pos", "ref_pos2")) for f, n in ((F.min, a), (F.max, b))]
        nodes = written(found.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *sides), "nodes")
        if not differing(found, nodes, turns, before):
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes agree under {TRIES} bases")
    return _measured(found, nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "words"))


def _measured(found: DataFrame, nodes: DataFrame) -> DataFrame:
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2"))
    parents = nodes.select((F.col("depth") + 1).alias("top"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent"))
    chains = written(chains.join(parents, ["top", "p1", "p2"], "left").select("conv_id", "top", "bottom", "parent"), "chains")
    none, flags = F.lit(None).cast("long"), lambda *on: [F.lit(x).alias(c) for c, x in zip(("first", "last", "hang"), on, strict=True)]
    marks = chains.select("conv_id", F.col("top").alias("depth"), "parent", *flags(1, 0, 0))
    marks = marks.unionByName(chains.select("conv_id", F.col("bottom").alias("depth"), none.alias("parent"), *flags(0, 1, 0)))
    marks = marks.unionByName(chains.where("parent is not null").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"), none.alias("parent"), *flags(0, 0, 1)))
    marks = marks.groupBy("conv_id", "depth").agg(F.max("parent").alias("parent"), F.max("first").alias("first"), F.max("last").alias("last"), F.sum("hang").alias("hang"))
    rows = nodes.join(marks, ["conv_id", "depth"], "left").join(end_digests(found), NODE, "left")
    children = (F.lit(1) - F.coalesce("last", F.lit(0)) + F.coalesce("hang", F.lit(0))).cast("long")
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("first") == 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    rows = written(rows, "measured")
    own = rows.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = chain_totals(chains.select("conv_id", "parent").join(own, "conv_id"))
    hung = chains.where("parent is not null").join(totals, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("l2"), F.sum("saved").alias("s2"))
    rows = rows.join(hung, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l2", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s2", F.lit(0)))
    return below(rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = "xor({0} >> 1, ({0} & 1) * 3988292384)"
_BYTE = "list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda b, i: " + _CRC.format("b") + ")"
PREFIX_SQL = f"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), convs as (
  select c, c - c % {BLOCK} as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length((c::varchar)) + 1), lambda i: ascii((c::varchar)[i])::bigint)), lambda a, x: {_BYTE}), 4294967295) % {HEADS} as h from (select distinct c from turns)
), placed as (
  select v.c, t.k as d, t.role, t.text from convs v join turns t on t.c = v.base and t.k <= v.h
  union all select v.c, t.k - v.h + least(v.h, (select count(*) from turns b where b.c = v.base)), t.role, t.text from convs v join turns t on t.c = v.c and t.k > v.h
), paths as (
  select c, 0 as d, [] as path, '' as said from convs
  union all select c, d, list([role, text]) over (partition by c order by d), text from placed
), lengths as (select c, max(d) as n from paths group by c),
nodes as (select d, path, min(c) as node, count(*) as n_convs, any_value(said) as said from paths group by d, path),
named as (select p.c, p.d, n.node from paths p join nodes n on n.d = p.d and n.path is not distinct from p.path),
edges as (select distinct x.node as parent, y.d, y.node from named x join named y on x.c = y.c and y.d = x.d + 1),
measured as (
  select n.node, n.d, (n_convs - 1) * len(list_filter(string_split_regex(said, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as saved,
    (select count(*) from edges e where e.parent = n.node and e.d = n.d + 1) as kids from nodes n
), under as (select distinct x.node as top, x.d as top_d, y.node, y.d from named x join named y on x.c = y.c and y.d >= x.d),
sums as (select top, top_d, count(*) filter (where kids = 0) as n_leaves, sum(saved)::bigint as saved_tokens from under join measured using (node, d) group by 1, 2),
ends as (select node, d, sha256(string_agg(c::varchar, ',' order by c)) as digest from named join lengths using (c) where d = n group by 1, 2)
select n.node as conv_id, n.d::bigint as depth, (select parent from edges e where e.node = n.node and e.d = n.d) as parent_conv_id, n_convs, kids as n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) as ends_sha256
from nodes n join measured m using (node, d) join sums on top = n.node and top_d = n.d left join ends e on e.node = n.node and e.d = n.d
"""
