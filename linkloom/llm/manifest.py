"""Merkle manifest of a dataset: a digest for each row, one root for each group and for all, and each row's proof.

Higher-order SQL only. The leaves of a group, in order, are cut into blocks of a fixed number of leaves. In a block an array of
leaves collapses level by level (``sequence``, ``transform``, ``slice``, ``aggregate``); the roots of the blocks are the nodes of
the next round, until a group has one. The groups' roots are a tree of their own. Proofs go the other way: what a block's root
needs up to the root of all is joined with the block, never with its leaves one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from .runtime import Scratch, partitions, small

#: A step of a proof: what stands beside the node, on the left or on the right; both are null where nothing does.
STEP = "struct<left:string,right:string>"


def digest_of(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts, concatenated; null parts are left out."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def field(value: Column) -> Column:
    """How a value goes into a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest_of(*[field(v) for v in values])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest_of(s["left"], h, s["right"]))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from the leaf to the root, left to right."""
    return F.flatten(F.transform(proof, lambda s: F.filter(F.array(s["left"], s["right"]), lambda d: d.isNotNull())))


def _levels(n: Column, most: int) -> Column:
    """How often n nodes of a group collapse within one block: until one is left, or as the block's size says."""
    return F.least(F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))), F.lit(most)).cast("int")


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """nodes with ``i``, the place in their group from 0 by ``order``, and ``of``, the group's size. ``_g`` is the group.

    Rows are dealt by ranges of group and order, so a large group is many tasks; only the number of rows of each group
    in each range is summed by window.
    """
    dealt = nodes.repartitionByRange(partitions(nodes), "_g", *order).sortWithinPartitions("_g", *order)
    dealt = scratch.table(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-order")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_g")
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_g", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("of"))
    parts = scratch.table(parts, f"{name}-parts")
    return dealt.join(small(parts), ["_g", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _collapsed(nodes: DataFrame, bits: int, payload: list[str], scratch: Scratch, name: str) -> DataFrame:
    """A row for each block of nodes (_g, i, of, digest, payload): (_g, i, of, blocks, digest, levels, rows). ``digest`` is the
    block's, ``levels`` its arrays of digests but the last one, ``rows`` its leaves' payload."""
    size = 1 << bits
    dealt = nodes.select("_g", "of", F.shiftright("i", bits).alias("block"), F.col("i").bitwiseAND(size - 1).cast("int").alias("_k"), "digest", *payload)
    blocks = dealt.groupBy("_g", "block").agg(F.max("of").alias("of"), F.array_sort(F.collect_list(F.struct("_k", "digest", *payload))).alias("_rows"))
    blocks = blocks.select("_g", "block", "of", F.transform("_rows", lambda r: r["digest"]).alias("_leaves"), F.transform("_rows", lambda r: F.struct(r["_k"].alias("_k"), *[r[c].alias(c) for c in payload])).alias("rows"))
    run = lambda level, j: F.slice(level, 2 * j + 1, F.lit(2))
    up = lambda level: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1)), lambda j: F.sha2(F.array_join(run(level, j), "").cast("binary"), 256))
    steps = F.slice(F.sequence(F.lit(1), F.lit(bits)), F.lit(1), _levels(F.col("of"), bits))
    levels = F.aggregate(steps, F.array("_leaves"), lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1)))))
    blocks = blocks.select("_g", "block", "of", "rows", levels.alias("_levels"))
    return scratch.table(
        blocks.select("_g", F.col("block").alias("i"), F.shiftright(F.col("of") + (size - 1), bits).alias("of"), F.element_at(F.element_at("_levels", -1), 1).alias("digest"), F.slice("_levels", F.lit(1), F.size("_levels") - 1).alias("levels"), "rows"), name
    )


def _step(levels: Column, k: Column, level: Column) -> Column:
    """What stands beside the ancestor of node k at a level of its block."""
    at = F.call_function("shiftright", k, level)
    row = F.get(levels, level)
    beside = F.get(row, at.bitwiseXOR(1))
    odd = at.bitwiseAND(1) == 1
    return F.struct(F.when(odd, beside).alias("left"), F.when(~odd, beside).alias("right"))


def _steps(levels: Column, k: Column) -> Column:
    """From node k of a block to the block's root."""
    return F.transform(F.sequence(F.lit(0), F.size(levels)), lambda level: F.when(level < F.size(levels), _step(levels, k, level)))


def _tree(nodes: DataFrame, order: list[str], payload: list[str], bits: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The rounds of blocks of all groups of nodes (_g, digest, order, payload), from the leaves up; in the last one each group
    has one block. Empty without nodes."""
    numbered = _numbered(nodes, order, scratch, name)
    most = numbered.agg(F.max("of")).first()[0]
    rounds: list[DataFrame] = []
    while most and (most > 1 or not rounds):
        rounds.append(_collapsed(numbered if not rounds else rounds[-1].select("_g", "i", "of", "digest"), bits, payload if not rounds else [], scratch, f"{name}-{len(rounds)}"))
        most = -(-most >> bits)
    return rounds


def _down(rounds: list[DataFrame], above: DataFrame, payload: list[str], bits: int, scratch: Scratch, name: str) -> DataFrame:
    """(payload, leaf, proof, and the other columns of above) for each leaf; above: (_g, proof, ...), what a group's root needs."""
    rest = [c for c in above.columns if c not in ("_g", "proof")]
    on = ["_g"]
    for k in reversed(range(len(rounds))):
        held = rounds[k].withColumnRenamed("i", "_block").join(small(above), on)
        more = payload if k == 0 else []

        def node(r):
            leaf = F.coalesce(F.get(F.get("levels", F.lit(0)), r["_k"]), F.col("digest"))
            proof = F.concat(F.filter(_steps(F.col("levels"), r["_k"]), lambda s: s.isNotNull()), F.col("proof"))
            return F.struct(r["_k"].alias("_k"), *[r[c].alias(c) for c in more], leaf.alias("leaf"), proof.alias("proof"))  # noqa: B023

        out = held.select("_g", "_block", *rest, F.inline(F.transform("rows", node)))
        if k:
            above, on = scratch.table(out.select("_g", (F.shiftleft("_block", bits) + F.col("_k")).alias("_block"), "proof", *rest), f"{name}-up{k}"), ["_g", "_block"]
    return out.select(*payload, "leaf", "proof", *rest)


def manifest(docs: DataFrame, fields: Sequence[str], order: str, group: str, carry: Mapping[str, Column] | None = None, bits: int = 10) -> DataFrame:
    """A row for each row of docs: ``carry``'s columns, leaf, proof (an array of ``STEP``), subroot and root.

    A leaf is H of ``fields``. In each ``group`` leaves ascend by ``order`` (null first, then by digest; rows that are the same in all
    fields stand side by side, in any order, as their leaves are equal). While several nodes remain, each two consecutive ones
    become their H, a last single one too; what remains is the subroot. Subroots, ordered by group (null first, then bytewise),
    give the root in the same way. ``carry``: further columns, by name, worked out as docs is read. Null texts and groups are
    values like others, empty texts differ from null ones, long texts are hashed as a whole; columns of docs that aren't named
    are not read, whatever they are called; an empty table gives no rows. ``bits``: a block has 2**bits leaves.
    """
    carry = dict(carry or {})
    if clash := {"leaf", "proof", "subroot", "root"} & {c.lower() for c in carry}:
        raise ValueError(f"columns of the manifest can't be carried: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession, "manifest")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("_g"), F.col(order).alias("_o"), leaf([F.col(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("_row"), *[c.alias(f"_c_{n}") for n, c in carry.items()])
    leaves, payload = scratch.table(leaves, "leaves"), [f"_c_{n}" for n in carry]
    rounds = _tree(leaves, ["_o", "digest", "_row"], payload, bits, scratch, "leaf")
    named = [F.col(f"_c_{n}").alias(n) for n in carry]
    if not rounds:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("leaf", "string"), ("proof", f"array<{STEP}>"), ("subroot", "string"), ("root", "string"))]
        return leaves.select(*named, *none)
    subroots = rounds[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_key"), "digest")
    top = _tree(subroots, ["_key"], ["_key"], bits, scratch, "top")
    root = top[-1].select("_g", F.array().cast(f"array<{STEP}>").alias("proof"), F.col("digest").alias("root"))
    above = _down(top, root, ["_key"], bits, scratch, "top").select(F.col("_key").alias("_g"), "proof", F.col("leaf").alias("subroot"), "root")
    out = _down(rounds, scratch.table(above, "above"), payload, bits, scratch, "leaf")
    return out.select(*named, "leaf", "proof", "subroot", "root")
