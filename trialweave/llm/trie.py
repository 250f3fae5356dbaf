"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

``turns`` numbers the turns of each conversation and reduces them to digests; ``paths`` gives every conversation its
row of prefixes; ``nodes`` merges equal prefixes; ``subtree_totals`` contracts the tree. One round of contraction

* *compresses*: a node with one child is taken out, and its child hangs on to its parent, if the node is a least one
  among itself, its parent and its child in the order (trailing zeros of the depth, hash). Such nodes are never
  adjacent, and of a plain chain every other node goes;
* *rakes*: leaves add their totals to their parents and go.

Each round is one stored table, a constant share smaller than the one before, so rounds are the logarithm of the
number of nodes however deep the tree is. Then the rounds are undone in reverse: the total of a compressed node is that
of its child plus what stood between. All joins are of unique keys; sums per parent combine before they shuffle.

A node is named by its least member and its depth. Rows without conv_id belong to no conversation; null role or text
is empty, null turns come first, and equal turns stand in the order of the md5 of their content (repeated rows are
turns of their own). Without conversations there is no node, not even the root. Other columns are ignored. A prefix is
identified by 128 bits: the xor of two 64-bit hashes of (position, md5 of role and text) over its turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordering import number_rows
from .lookups import looked_up
from .store import Scratch, stored

#: Turns of a conversation that one window holds.
RUN = 4096
#: Conversation ids (as a range of values) that one string of ids holds.
ID_BITS = 10
_REST, _LEAF, _OUT = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest (md5 of role and text), n_words; no conversation has to fit one task."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"),
    )
    return number_rows(rows, ["conv_id"], ["turn", "digest"], "pos").select("conv_id", "pos", "digest", "n_words")


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the prefix), up_a, up_b (the prefix before), n_words of its last turn.

    ``rows`` has (conv_id, pos, digest, n_words), positions from 1 without gaps. Prefix hashes are scanned within runs
    of ``RUN`` turns, and the runs' own hashes before that.
    """
    hashed = rows.withColumn("__run", F.shiftright(F.col("pos") - 1, RUN.bit_length() - 1)).select(
        "conv_id", "pos", "n_words", "__run",
        F.xxhash64("pos", "digest").alias("__a"), F.xxhash64("digest", "pos", F.lit(11)).alias("__b"),
    )
    run = ["conv_id", "__run"]
    before = Window.partitionBy("conv_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(*run).agg(F.bit_xor("__a").alias("__ra"), F.bit_xor("__b").alias("__rb"))
    offsets = offsets.select(*run, *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c + "0") for c in ("__ra", "__rb")])
    inside = Window.partitionBy(*run).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scanned = hashed.withColumn("__sa", F.bit_xor("__a").over(inside)).withColumn("__sb", F.bit_xor("__b").over(inside))
    joined = scanned.join(offsets, run)
    a, b = F.col("__sa").bitwiseXOR(F.col("__ra0")), F.col("__sb").bitwiseXOR(F.col("__rb0"))
    return joined.select(
        "conv_id", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"),
        a.bitwiseXOR(F.col("__a")).alias("up_a"), b.bitwiseXOR(F.col("__b")).alias("up_b"), "n_words",
    )


_KEY = ["depth", "a", "b"]


def nodes(steps: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct prefix: depth, a, b, conv_id, parent_conv_id, n_convs, n_children, own_saved.

    ``steps`` are ``paths``; ``conversations`` has every conv_id once, also those without turns.
    """
    below = steps.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"),
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
    )
    nought = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        *[nought.alias(c) for c in _KEY], "conv_id", "n_convs", nought.alias("n_words"),
        nought.alias("up_a"), nought.alias("up_b"),
    )
    found = scratch.stored(below.unionByName(root), "prefixes")
    up = found.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    counts = up.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    counted = scratch.stored(
        found.join(counts, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted"
    )
    parents = counted.select(
        F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    rows = counted.filter("depth > 0").withColumn("up_depth", F.col("depth") - 1)
    placed = looked_up(rows, parents, ["up_depth", "up_a", "up_b"], "n_children")
    top = counted.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [*_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    saved = ((F.col("n_convs") - 1) * F.col("n_words")).alias("own_saved")
    return placed.select(*columns, saved).unionByName(top.select(*columns, saved))


def _order(conv: str, depth: str) -> Column:
    """A total order of the nodes: trailing zeros of the depth, then a hash, then the name."""
    d = F.col(depth)
    low = F.when(d == 0, F.lit(1 << 62)).otherwise(d.bitwiseAND(-d))
    return F.struct(low, F.xxhash64(conv, depth), F.col(conv), d)


def subtree_totals(tree: DataFrame, values: dict[str, str], scratch: Scratch) -> DataFrame:
    """conv_id, depth and, per entry of ``values`` (total -> column), the sum of the column over the node's subtree.

    ``tree`` has conv_id, depth, parent_conv_id; a parent stands one level above its children.
    """
    totals = list(values)
    zero = F.lit(0).cast("long")
    state = tree.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        *[F.col(c).cast("long").alias(t) for t, c in values.items()],
        *[zero.alias(f"edge_{t}") for t in totals],  # what compressed nodes left between the node and its parent
        F.lit(_REST).alias("state"),
    )
    me, up = ["conv_id", "depth"], ["up_conv", "up_depth"]
    rounds, last = [], scratch.stored(state, "tree")
    while not last.filter(F.col("state") == _REST).isEmpty():
        rest, leaves = last.filter(F.col("state") == _REST), last.filter(F.col("state") == _LEAF)
        raked = leaves.filter("up_conv IS NOT NULL").groupBy(*up).agg(
            *[F.sum(F.col(t) + F.col(f"edge_{t}")).alias(f"__{t}") for t in totals]
        )
        kids = rest.filter("up_conv IS NOT NULL").groupBy(*up).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*me)).alias("__kid"))
        plain = ["conv_id", "depth", *up, *[f"edge_{t}" for t in totals]]
        grown = (
            rest.join(raked.withColumnsRenamed({"up_conv": "conv_id", "up_depth": "depth"}), me, "left")
            .join(kids.withColumnsRenamed({"up_conv": "conv_id", "up_depth": "depth"}), me, "left")
            .select(*plain, *[(F.col(t) + F.coalesce(f"__{t}", zero)).alias(t) for t in totals], "__n", "__kid")
        )
        grown = grown.withColumn("__kc", F.col("__kid.conv_id")).withColumn("__kd", F.col("__kid.depth")).drop("__kid")
        mine = _order("conv_id", "depth")
        out = (F.col("__n") == 1) & F.col("up_conv").isNotNull() & (mine < _order("up_conv", "up_depth")) & (mine < _order("__kc", "__kd"))
        grown = grown.withColumn("__out", F.coalesce(out, F.lit(False)))
        hung = grown.filter("__out").select(
            F.col("__kc").alias("conv_id"), F.col("__kd").alias("depth"),
            F.col("conv_id").alias("out_conv"), F.col("depth").alias("out_depth"),
            F.col("up_conv").alias("__uc"), F.col("up_depth").alias("__ud"),
            *[F.col(t).alias(f"__own_{t}") for t in totals], *[F.col(f"edge_{t}").alias(f"__edge_{t}") for t in totals],
        )
        moved = F.col("out_conv").isNotNull()
        last = scratch.stored(
            grown.join(hung, me, "left").select(
                *me,
                F.when(moved, F.col("__uc")).otherwise(F.col("up_conv")).alias("up_conv"),
                F.when(moved, F.col("__ud")).otherwise(F.col("up_depth")).alias("up_depth"),
                *totals,
                *[(F.col(f"edge_{t}") + F.coalesce(F.col(f"__own_{t}") + F.col(f"__edge_{t}"), zero)).alias(f"edge_{t}") for t in totals],
                F.when(F.col("__out"), _OUT).when(F.col("__n").isNull(), _LEAF).otherwise(_REST).alias("state"),
                # the compressed parent and what its total has beyond this node's
                "out_conv", "out_depth", *[(F.col(f"__own_{t}") + F.col(f"edge_{t}")).alias(f"add_{t}") for t in totals],
            ),
            "round",
        )
        rounds.append(last)
    known = None
    for table in reversed(rounds):
        leaves = table.filter(F.col("state") == _LEAF).select(*me, *totals)
        known = leaves if known is None else known.unionByName(leaves)
        ends = table.filter("out_conv IS NOT NULL").select(*me, "out_conv", "out_depth", *[f"add_{t}" for t in totals])
        if ends.isEmpty():
            continue
        back = ends.join(known, me).select(
            F.col("out_conv").alias("conv_id"), F.col("out_depth").alias("depth"), *[(F.col(t) + F.col(f"add_{t}")).alias(t) for t in totals]
        )
        known = known.unionByName(scratch.stored(back, "back"))
    if known is None:
        return tree.select(*me, *[F.col(c).cast("long").alias(t) for t, c in values.items()])
    return known


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conv_ids that end at a node, ascending, comma-joined: depth, a, b, ends_sha256.

    Tasks join ids of one range of values to a string; the strings of a node are then hashed one after another as
    they arrive in order, so no list of ids is ever held.
    """
    run = F.shiftright("conv_id", ID_BITS)
    texts = (
        ends.groupBy(*_KEY, run.alias("run"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(*_KEY, "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if row[:3] != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
            if out:
                yield _digests(out)
        if last is not None:
            yield _digests([(*last, state.hexdigest())])

    laid = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "run")
    return laid.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[*_KEY, "ends_sha256"]
    )


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of numbered turns (conv_id, pos, digest, n_words) of all ``conversations`` (conv_id, n_turns).

    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    with Scratch(rows.sparkSession) as scratch:
        conversations = scratch.stored(conversations.select("conv_id", "n_turns"), "conversations")
        steps = scratch.stored(paths(rows), "paths")
        tree = scratch.stored(nodes(steps, conversations, scratch), "nodes")
        weighed = tree.withColumn("__leaf", (F.col("n_children") == 0).cast("long"))
        totals = subtree_totals(weighed, {"n_leaves": "__leaf", "saved_tokens": "own_saved"}, scratch)
        # the last step of a conversation is the one at the depth of its number of turns
        nought = F.lit(0).cast("long")
        full = steps.join(conversations.filter("n_turns > 0").withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi")
        ends = full.select("conv_id", *_KEY).unionByName(
            conversations.filter("n_turns = 0").select("conv_id", *[nought.alias(c) for c in _KEY])
        )
        out = (
            tree.join(totals, ["conv_id", "depth"])
            .join(ends_digest(ends), _KEY, "left")
            .select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            )
        )
        return stored(out, "trie")
