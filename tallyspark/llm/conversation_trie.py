"""Prefix trie of conversations, with subtree totals by tree contraction.

A node is a distinct sequence of first turns.  Its key is its depth and two
sums of hashes of (place, role, text) over those turns.  A sum can be taken in
parts, so a conversation of any length is cut over many tasks: turns are
range-sorted, and the parts' sums before a part are added to its own.

Totals over subtrees come from parallel tree contraction (Miller and Reif).
A round rakes the leaves, each handing its total to its parent, and
compresses unary chains: a node with one child leaves, its parent takes the
child over, and the removed node notes that child.  Neighbours in a chain
never leave together: a node goes if the number of times two divides its
depth is the least around it, so a chain of consecutive depths halves.  A
round is one join (nodes with their only children) and one aggregation of
what the nodes send to each other, from which sums for a parent of very many
children are made before they shuffle.  The rounds are then undone from the
last to the first: a removed chain node's total is its own share and its
noted child's total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch

KEY = "decimal(30,0)"
#: conversation ids in one piece of a node's list
PIECE_IDS = 1 << 15
#: of the hash sum's halves
SALTS = (1, 2)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# -- turns ---------------------------------------------------------------

def ordered_turns(convs: DataFrame, scratch: Scratch, id_col: str, turn_col: str, role_col: str,
                  text_col: str) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, part, at, a, b, chars) in order, and (conv, part, low,
    n, skip) for each part of a conversation: the turn's place is
    at - low + skip + 1.

    Rows are range-sorted, so a long conversation lies in several parts.
    Ties of a turn number are ordered by role, then by hashes of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = convs.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                        F.xxhash64(F.lit(SALTS[0]), role, text).alias("a"),
                        F.xxhash64(F.lit(SALTS[1]), role, text).alias("b"),
                        F.length(text).cast("long").alias("chars")).filter("conv IS NOT NULL")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    turns = scratch.put(rows.repartitionByRange(_partitions(convs), *order).sortWithinPartitions(*order)
                        .withColumn("at", F.monotonically_increasing_id())
                        .select("conv", F.shiftright("at", 33).alias("part"), "at", "a", "b", "chars"), "turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (turns.groupBy("conv", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
             .withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return turns, scratch.put(parts, "parts")


def _hash(place: Column, salt: int, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(salt), place, a, b).cast("decimal(20,0)")


def _first_turns(turns: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """(conv, first): up to ``most`` first turns, with their sums so far."""
    place = F.col("at") - F.col("low") + F.col("skip") + 1
    few = (turns.join(parts.filter(F.col("skip") < most), ["conv", "part"]).withColumn("place", place)
           .filter(F.col("place") <= most)
           .select("conv", "place", "chars", *(_hash(F.col("place"), s, F.col("a"), F.col("b")).alias(f"f{s}")
                                               for s in SALTS)))
    upto = Window.partitionBy("conv").orderBy("place")
    return (few.select("conv", "place", "chars", "f1", "f2", *(F.sum(f"f{s}").over(upto).cast(KEY).alias(f"k{s}")
                                                               for s in SALTS))
            .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "chars", "f1", "f2", "k1", "k2"))).alias("first")))


def paths(convs: DataFrame, scratch: Scratch, family: int | None, most: int, id_col: str, turn_col: str,
          role_col: str, text_col: str) -> DataFrame:
    """(conv, depth, k1, k2, f1, f2, chars, last): a row for every
    conversation and every depth from 0 to its length.  With a ``family``,
    a conversation's first h turns give way to those of the one whose id is
    the multiple of ``family`` below (h = crc32 of the id, modulo ``most``)."""
    turns, parts = ordered_turns(convs, scratch, id_col, turn_col, role_col, text_col)
    own = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast(KEY)
    if family:
        h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
        lead = F.col("conv") - F.col("conv") % family
        first = _first_turns(turns, parts.filter(F.col("conv") % family == 0), most - 1).withColumnRenamed("conv", "lead")
        own = (own.select("conv", "n", h.cast("int").alias("h"), lead.alias("lead")).join(first, "lead", "left")
               .withColumn("first", F.coalesce(F.slice("first", 1, F.col("h")), F.expr("slice(first, 1, 0)"))))
        own = own.select("conv", "h", "first", F.when(F.col("first").isNull(), 0).otherwise(F.size("first")).alias("given"),
                         F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
        own = scratch.put(own.select("conv", "h", "first", "given", (F.col("given") + F.col("rest")).alias("total"),
                                     *(F.coalesce(F.when(F.col("given") > 0, F.element_at(f"first.k{s}", -1)), zero).alias(f"base{s}")
                                       for s in SALTS)), "own")
    else:
        own = scratch.put(own.select("conv", F.lit(0).alias("h"), F.lit(0).alias("given"), F.col("n").alias("total"),
                                     zero.alias("base1"), zero.alias("base2")), "own")
    info = parts.join(own.drop("first"), "conv")
    place = F.col("at") - F.col("low") + F.col("skip") + 1
    placed = (turns.join(info, ["conv", "part"]).filter(place > F.col("h"))
              .withColumn("depth", (place - F.col("h") + F.col("given")).cast("long")))
    in_part = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv", "part", "depth", "chars", "total", "base1", "base2",
                           *(_hash(F.col("depth"), s, F.col("a"), F.col("b")).alias(f"f{s}") for s in SALTS))
    run = scratch.put(placed.select("conv", "part", "depth", "chars", "f1", "f2", (F.col("depth") == F.col("total")).alias("last"),
                                    *((F.col(f"base{s}") + F.sum(f"f{s}").over(in_part)).cast(KEY).alias(f"r{s}")
                                      for s in SALTS)), "run")
    # a part can hold the middle of one conversation at most: as many rows as parts
    cut = parts.filter("skip > 0").select("conv").distinct()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (run.join(F.broadcast(cut), "conv", "left_semi").groupBy("conv", "part").agg(F.sum("f1").alias("s1"), F.sum("f2").alias("s2"))
             .select("conv", "part", *(F.sum(f"s{s}").over(before).alias(f"o{s}") for s in SALTS)))
    tail = (run.join(F.broadcast(ahead), ["conv", "part"], "left")
            .select("conv", "depth", *((F.col(f"r{s}") + F.coalesce(F.col(f"o{s}"), F.lit(0))).cast(KEY).alias(f"k{s}") for s in SALTS),
                    "f1", "f2", "chars", "last"))
    top = own.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("k1"), zero.alias("k2"),
                     *(F.lit(0).cast("decimal(20,0)").alias(f"f{s}") for s in SALTS), F.lit(0).cast("long").alias("chars"),
                     (F.col("total") == 0).alias("last"))
    out = tail.unionByName(top)
    if family:
        shared = own.select("conv", "total", F.explode("first").alias("t"))
        out = out.unionByName(shared.select("conv", F.col("t.place").alias("depth"), "t.k1", "t.k2", "t.f1", "t.f2", "t.chars",
                                            (F.col("t.place") == F.col("total")).alias("last")))
    return out


# -- contraction ---------------------------------------------------------

def _twos(x: Column) -> Column:
    """How many times two divides a depth (the root's: more than any)."""
    return F.when(x == 0, 64).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def _rank(x: Column, turn: int) -> Column:
    return F.struct(_twos(x), F.xxhash64(F.lit(turn), x))


def _sent(told: DataFrame) -> DataFrame:
    """The nodes that stay, with what raked and spliced ones hand them."""
    c, none = F.col, F.lit(None)
    own = F.struct(c("pconv").alias("pconv"), c("pdepth").alias("pdepth"), c("kids").alias("kids"))
    up = F.struct(c("pconv").alias("pconv"), c("pdepth").alias("pdepth"))

    def note(conv: str, depth: str, own=none, share=True, lost=0, up=none) -> Column:
        return F.struct(c(conv).alias("conv"), c(depth).alias("depth"),
                        own.cast("struct<pconv:bigint,pdepth:bigint,kids:bigint>").alias("own"),
                        *((c(x) if share else F.lit(0)).cast("long").alias(x) for x in ("leaves", "saved")),
                        F.lit(lost).cast("long").alias("lost"), up.cast("struct<pconv:bigint,pdepth:bigint>").alias("up"))

    notes = (F.when(c("state") == "stays", F.array(note("conv", "depth", own)))
             .when(c("state") == "raked", F.array(note("pconv", "pdepth", lost=1)))
             .otherwise(F.array(note("pconv", "pdepth"), note("child.conv", "child.depth", share=False, up=up))))
    return (told.select(F.explode(notes).alias("m")).select("m.*").groupBy("conv", "depth")
            .agg(F.max("own").alias("own"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                 F.sum("lost").alias("lost"), F.max("up").alias("up"))
            .select("conv", "depth", F.coalesce("up.pconv", "own.pconv").alias("pconv"),
                    F.coalesce("up.pdepth", "own.pdepth").alias("pdepth"), (c("own.kids") - c("lost")).alias("kids"),
                    "leaves", "saved"))


def subtree_totals(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, leaves, saved) of every node of ``tree`` (conv, depth,
    parent, kids, leaves, saved): the sums over its subtree.

    ``parent`` is the conv of the node a depth above, null for the root.
    Tables are written each round in the shared folder.
    """
    live = tree.select("conv", "depth", F.col("parent").alias("pconv"), (F.col("depth") - 1).alias("pdepth"), "kids", "leaves", "saved")
    rounds: list[tuple[DataFrame, bool]] = []
    while True:
        k = len(rounds)
        child = (live.filter("pconv IS NOT NULL").groupBy(F.col("pconv").alias("conv"), F.col("pdepth").alias("depth"))
                 .agg(F.min(F.struct("conv", "depth", "kids")).alias("child")))
        here = _rank(F.col("depth"), k)
        splice = ((F.col("kids") == 1) & (F.col("child.kids") > 0) & (here < _rank(F.col("pdepth"), k))
                  & ((F.col("child.kids") > 1) | (here < _rank(F.col("child.depth"), k))))
        state = (F.when(F.col("pconv").isNull(), F.lit("stays")).when(F.col("kids") == 0, F.lit("raked"))
                 .when(splice, F.lit("spliced")).otherwise(F.lit("stays")))
        told = scratch.put(live.join(child, ["conv", "depth"], "left").withColumn("state", state), f"round-{k}")
        n = {r["state"]: r["n"] for r in told.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        rounds.append((told, n.get("spliced", 0) > 0))

        live = _sent(told)
        if n.get("stays", 0) <= 1:
            break
    known = [scratch.put(live.select("conv", "depth", "leaves", "saved"), "total-root")]
    for k in range(len(rounds) - 1, -1, -1):
        told, spliced = rounds[k]
        total = told.filter("state = 'raked'").select("conv", "depth", "leaves", "saved")
        if spliced:
            later = known[0]
            for df in known[1:]:
                later = later.unionByName(df)
            later = later.select(*(F.col(x).alias(f"l_{x}") for x in later.columns))
            gone = told.filter("state = 'spliced'").select("conv", "depth", "leaves", "saved", "child")
            ahead = (gone.join(later, (F.col("child.conv") == F.col("l_conv")) & (F.col("child.depth") == F.col("l_depth")))
                     .select("conv", "depth", (F.col("leaves") + F.col("l_leaves")).alias("leaves"),
                             (F.col("saved") + F.col("l_saved")).alias("saved")))
            total = scratch.put(total.unionByName(ahead), f"total-{k}")
            scratch.drop(f"round-{k}")
        known.append(total)
    out = known[0]
    for df in known[1:]:
        out = out.unionByName(df)
    return out


# -- lists of ends -------------------------------------------------------

def _batch(done: list[tuple], names: list[str], text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], pa.string() if n == text else pa.int64())
                                       for i, n in enumerate(names)})


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (node, depth, conv) rows: ids of a node joined, a piece at a time."""
        names = ["node", "depth", "low", "ids"]
        held: list[int] = []
        at = None
        for b in batches:
            done = []
            for node, depth, conv in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "conv"))):
                if at != (node, depth) or len(held) >= size:
                    if held:
                        done.append((*at, held[0], ",".join(map(str, held))))
                    at, held = (node, depth), []
                held.append(conv)
            if done:
                yield _batch(done, names, "ids")
        if held:
            yield _batch([(*at, held[0], ",".join(map(str, held)))], names, "ids")
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: SHA-256 of each node's list, a piece held at a time."""
    names = ["conv_id", "depth", "ends_sha256"]
    at = digest = None
    for b in batches:
        done = []
        for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids"))):
            if at != (node, depth):
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _batch(done, names, "ends_sha256")
    if at is not None:
        yield _batch([(*at, digest.hexdigest())], names, "ends_sha256")


def ends_digest(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the ids of the conversations
    ending at a node, ascending and joined by commas, from (node, depth, conv).

    Ids are range-sorted and joined in pieces of bounded size, so a node at
    which very many conversations end is spread; only its pieces meet, in
    order, and are hashed one at a time.
    """
    piece = StructType([StructField("node", LongType()), StructField("depth", LongType()), StructField("low", LongType()),
                        StructField("ids", StringType())])
    out = StructType([StructField("conv_id", LongType()), StructField("depth", LongType()), StructField("ends_sha256", StringType())])
    n = _partitions(ends)
    pieces = (ends.select("node", "depth", "conv").repartitionByRange(n, "node", "depth", "conv")
              .sortWithinPartitions("node", "depth", "conv").mapInArrow(_pieces(piece_ids), piece))
    return pieces.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "low").mapInArrow(_digests, out)


# -- operator ------------------------------------------------------------

def prefix_trie(convs: DataFrame, family: int | None = None, most: int = 6, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The trie's nodes (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens) and the conversations ending at them (node, depth,
    conv).

    A node stands for the conversations that begin with its turns; the
    smallest of their ids and the depth name it.  ``saved_tokens`` is the sum
    over the node's subtree of (n_convs - 1) x code points of the last text:
    what sharing prefixes saves below it.  ``family`` and ``most`` first give
    conversations the turns of a leading one (see ``paths``); ``most`` bounds
    their number.

    Turns are ordered by ``turn_col``, null first, ties by role and then by
    hash; repeated rows are turns each.  A null role or text is empty, rows
    without an id are left out, other columns are ignored.  Without any id
    there is no node, not even a root.  Tables are written in the shared
    folder and the results read them.
    """
    scratch = Scratch(convs.sparkSession, "trie")
    rows = scratch.put(paths(convs, scratch, family, most, id_col, turn_col, role_col, text_col), "paths")
    scratch.drop("turns", "parts", "run", "own")
    key = ["depth", "k1", "k2"]
    nodes = scratch.put(rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
                                               *(F.min(f"f{s}").alias(f"f{s}") for s in SALTS)), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), *((F.col(f"k{s}") - F.col(f"f{s}")).cast(KEY).alias(f"k{s}") for s in SALTS)]
    below = nodes.filter("depth > 0")
    kids = below.select(*up).groupBy(*key).agg(F.count(F.lit(1)).alias("kids"))
    above = nodes.select(*(F.col(x).alias(f"p_{x}") for x in key), F.col("conv").alias("parent"))
    named = (below.select("depth", "k1", "k2", *(c.alias(f"u_{x}") for x, c in zip(key, up)))
             .join(above, [F.col(f"u_{x}") == F.col(f"p_{x}") for x in key]).select(*key, "parent"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).cast("long")
    tree = scratch.put(nodes.join(kids, key, "left").join(named, key, "left").select(
        "conv", "depth", "k1", "k2", "parent", "n_convs", F.coalesce("kids", F.lit(0)).cast("long").alias("kids"),
        F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), saved.alias("saved")), "tree")
    ends = scratch.put(rows.filter("last").select("conv", *key)
                       .join(tree.select(*key, F.col("conv").alias("node")), key).select("node", "depth", "conv"), "ends")
    scratch.drop("paths", "nodes")
    totals = subtree_totals(tree, scratch).select("conv", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = tree.drop("leaves", "saved", "k1", "k2").join(totals, ["conv", "depth"])
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                      F.col("kids").alias("n_children"), "n_leaves", "saved_tokens"), ends
