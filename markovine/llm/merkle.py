"""A Merkle manifest of a table, and proofs by lookup of sibling coordinates.

Every row is a leaf: the digest of its columns, each written as ``-`` if null and else as
byte count, ``:`` and value.  The leaves of a group, in ascending order, are the lowest level
of a tree; every ``fan`` consecutive nodes of a level (a level's last run may be shorter, down
to one node) become the digest of their concatenation, until one node is left, the group's
subroot.  The subroots, in order of their groups, are the leaves of one more tree, whose last
node is the root.

*Build.*  A leaf's index is its place in a range-partitioned order: counts of the partitions
give each its offset, so no group has to fit a task.  Levels are made two at a time from
blocks of ``fan * fan`` nodes and written: the node table, rows of ``tree, level, i, digest``.

*Proofs.*  What a node needs up to the root follows from its index and the size of its level:
at each level the other coordinates of its run.  Nodes explode these coordinates and are
joined with the node table; what comes back is ordered and concatenated.  Leaves of one run
need the same coordinates, so a run asks once for all of them, for its leaves, its own
level and the next one; the rest of the way is that of its ancestor two levels up, which asks
in the same way.  So a node is looked up by at most ``fan * fan`` others, however large a group
is, and nothing is asked for twice on the way to the root.  A proof is a list of steps
``left, right``: the siblings to the left and to the right at one level, as concatenated
digests.  Folding a leaf with its steps gives the root.

Everything is built-in functions; digests never pass through the driver, but the root.

Cases: null groups are one group, the first; a null order value comes first; rows that repeat
an order value are ordered by their digests, and equal rows are a leaf each; a group of one
leaf has that leaf as its subroot, a table of one group has its subroot as the root, a proof
without siblings is the digest of nothing; an empty table gives an empty result; extra columns
are not part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch

#: The tree of the subroots; group trees are ``n`` (null) and ``s`` with the group's name.
TOP = "t"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


@dataclass
class Tree:
    """Written leaves ``tree, i, n, digest`` with what they carry, and blocks per two levels
    ``tree, b, n, digests, ups, top``."""

    leaves: DataFrame
    blocks: list[DataFrame]
    fan: int
    sizes: list[int] = field(default_factory=list)  # of the largest tree, per level

    def level(self, k: int) -> DataFrame:
        """``tree, i, n, digest`` of level ``k``; ``n`` is the size of that level in its tree."""
        if k == 0:
            return self.leaves.select("tree", "i", "n", "digest")
        blocks, f = self.blocks[(k - 1) // 2], self.fan
        if k % 2 == 0:
            return blocks.where(f"n > {f}").select("tree", F.col("b").alias("i"), F.expr(f"(n + {f * f - 1}) DIV {f * f}").alias("n"), F.col("top").alias("digest"))
        ups = blocks.select("tree", "b", "n", F.posexplode("ups").alias("k", "digest"))
        return ups.select("tree", F.expr(f"b * {f} + k").alias("i"), F.expr(f"(n + {f - 1}) DIV {f}").alias("n"), "digest")

    def nodes(self, levels: list[int]) -> DataFrame:
        """The node table's rows of some levels."""
        out = None
        for k in levels:
            part = self.level(k).select("tree", F.lit(k).alias("level"), "i", "digest")
            out = part if out is None else out.unionByName(part)
        return out

    def roots(self) -> DataFrame:
        """``tree, digest`` of the last node of each tree."""
        out = self.leaves.where("n = 1").select("tree", "digest")
        for blocks in self.blocks:
            out = out.unionByName(blocks.where(f"n > 1 AND n <= {self.fan}").select("tree", F.col("ups")[0].alias("digest")))
            out = out.unionByName(blocks.where(f"n > {self.fan} AND n <= {self.fan**2}").select("tree", F.col("top").alias("digest")))
        return out


def plant(scratch: Scratch, rows: DataFrame, order: list[str], fan: int, name: str) -> Tree:
    """Index the leaves ``tree, digest`` of every tree in ``order`` and build the levels."""
    rows = scratch.written(rows.withColumn("at", F.monotonically_increasing_id()), f"{name}-rows")
    keys = ["tree", *order, "digest", "at"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at").withColumn("pos", F.monotonically_increasing_id())
    ordered = scratch.written(ordered.withColumn("task", F.shiftright("pos", 33)), f"{name}-ordered")
    stretches = ordered.groupBy("tree", "task").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("tree", "task", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    leaves = ordered.join(stretches, ["tree", "task"]).withColumn("i", F.col("pos") + F.col("shift")).drop("pos", "task", "shift")
    tree = Tree(scratch.written(leaves, f"{name}-leaves"), [], fan)
    size = tree.leaves.agg(F.max("n")).first()[0] or 0
    while size:
        tree.sizes.append(size)
        if size == 1:
            break
        size = -(-size // fan)
    level, f = tree.leaves.select("tree", "i", "n", "digest"), fan
    for k in range(0, max(len(tree.sizes) - 1, 1), 2):
        if k:
            level = tree.level(k).where("n > 1")
        blocks = level.groupBy("tree", F.expr(f"i DIV {f * f}").alias("b"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("digests"))
        ups = F.transform(F.expr(f"sequence(0L, (size(digests) - 1) DIV {f})"), lambda x: F.sha2(F.array_join(F.slice("digests", (x * f + 1).cast("int"), f), "").cast("binary"), 256))
        blocks = blocks.withColumn("ups", ups).withColumn("top", F.sha2(F.array_join("ups", "").cast("binary"), 256))
        tree.blocks.append(scratch.written(blocks, f"{name}-blocks"))
    return tree


def climb(scratch: Scratch, tree: Tree, tails: DataFrame, name: str) -> DataFrame:
    """``tree, run, own, steps, subroot`` of every run of leaves: its leaves' digests, the steps
    from the run's own level up, and then the ``tails`` (``tree, steps, subroot``)."""
    f = tree.fan
    starts = [b for b in range(1, len(tree.sizes), 2) if b == 1 or tree.sizes[b] > 1] or [1]
    above = None
    for b in reversed(starts):
        asking = tree.level(b).select("tree", F.col("i").alias("j"), "n")
        if b > 1:
            asking = asking.where("n > 1")
        asked = [(b, "j", "n"), (b + 1, f"(j DIV {f})", f"((n + {f - 1}) DIV {f})")]
        # the other coordinates of the run at each level, from the index and the level's size
        coordinates = [f"IF({n} > 1, filter(transform(sequence({j} - {j} % {f}, least({j} - {j} % {f} + {f - 1}, {n} - 1)), i -> struct({k} AS level, i AS i)), x -> x.i <> {j}), array())" for k, j, n in asked]
        if b == 1:  # a run's leaves as well
            coordinates.append(f"transform(sequence(j * {f}, j * {f} + {f - 1}), i -> struct(0 AS level, i AS i))")
        wanted = asking.select("tree", "j", "n", F.explode_outer(F.expr(f"concat({', '.join(coordinates)})")).alias("at")).select("tree", "j", "n", "at.level", "at.i")
        levels = ([0] if b == 1 else []) + [k for k, _, _ in asked if k < len(tree.sizes)]
        found = wanted.join(tree.nodes(levels), ["tree", "level", "i"], "left")
        found = found.groupBy("tree", "j", "n").agg(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "i", "digest")))).alias("others"))

        def side(k: int, where: str) -> str:
            return f"array_join(transform(filter(others, x -> x.level = {k} AND x.i {where}), x -> x.digest), '')"

        steps = [f"IF({n} > 1, array(struct({side(k, f'< {j}')} AS left, {side(k, f'> {j}')} AS right)), array())" for k, j, n in asked]
        found = found.select("tree", "j", "n", F.expr(f"concat({', '.join(steps)})").alias("steps"), *([F.expr("transform(filter(others, x -> x.level = 0), x -> x.digest)").alias("own")] if b == 1 else []))
        # the way from two levels up is an ancestor's, or the tree ends below and its tail goes on
        ends = F.expr(f"(n + {f * f - 1}) DIV {f * f} = 1")
        own = ["own"] if b == 1 else []
        onward = found.where(ends).join(tails.select("tree", F.col("steps").alias("rest"), "subroot"), "tree").select("tree", "j", *own, F.concat("steps", "rest").alias("steps"), "subroot")
        if above is not None:
            up = above.select("tree", F.col("j").alias("up"), F.col("steps").alias("rest"), "subroot")
            more = found.where(~ends).withColumn("up", F.expr(f"j DIV {f * f}")).join(up, ["tree", "up"]).select("tree", "j", *own, F.concat("steps", "rest").alias("steps"), "subroot")
            onward = onward.unionByName(more)
        above = scratch.written(onward, f"{name}-ways")
    return above.select("tree", F.col("j").alias("run"), "own", "steps", "subroot")


def with_steps(tree: Tree, runs: DataFrame) -> DataFrame:
    """Every leaf with its whole list of ``steps`` and its ``subroot``."""
    f = tree.fan
    joined = tree.leaves.withColumn("run", F.expr(f"i DIV {f}")).join(runs, ["tree", "run"])
    at = F.expr(f"CAST(i % {f} AS INT)")
    first = F.struct(F.array_join(F.slice("own", F.lit(1), at), "").alias("left"), F.array_join(F.slice("own", at + 2, F.lit(f)), "").alias("right"))
    return joined.withColumn("steps", F.when(F.col("n") > 1, F.concat(F.array(first), "steps")).otherwise(F.col("steps"))).drop("run", "own")


def proof_digest(steps: str = "steps") -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, steps: str = "steps") -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def prove(scratch: Scratch, df: DataFrame, columns: list[str], group_col: str, order_col: str, carry: dict[str, Column] | None = None, fan: int = 16) -> DataFrame:
    """Every row of ``df`` as a leaf of its group's tree: ``tree, i, n`` (its index and the number
    of leaves), ``leaf``, ``subroot``, ``root`` and the ``steps`` of its proof, with the columns
    of ``carry``.  The tables behind it live in ``scratch``."""
    group = _name(group_col).cast("string")
    carried = {f"carried_{k}": v for k, v in (carry or {}).items()}
    rows = df.select(
        F.when(group.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), group)).alias("tree"),
        _name(order_col).alias("key"),
        leaf_digest(*(_name(c) for c in columns)).alias("digest"),
        *(v.alias(k) for k, v in carried.items()),
    )
    groups = plant(scratch, rows, ["key"], fan, "groups")
    subroots = groups.roots()
    top = plant(scratch, subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], fan, "top")
    last = top.roots().first()
    root = last["digest"] if last else None
    nothing = top.leaves.where("i = 0").select("tree", F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("steps"), F.lit(None).cast("string").alias("subroot"))
    whole = with_steps(top, climb(scratch, top, nothing, "top"))
    tails = whole.select(F.col("group").alias("tree"), "steps", F.col("digest").alias("subroot"))
    out = with_steps(groups, climb(scratch, groups, scratch.written(tails, "tails"), "groups"))
    return out.select("tree", "i", "n", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "steps", *(F.col(k).alias(k.removeprefix("carried_")) for k in carried))


def verify(df: DataFrame, columns: list[str], group_col: str, order_col: str, carry: dict[str, Column], suspect: Column, scratch: Scratch, fan: int = 16) -> DataFrame:
    """Proofs of all rows, folded with the digest ``suspect`` in the leaf's place where it is not
    null: ``folded_root`` and whether it is the root (``verified``), with ``carry``."""
    rows = prove(scratch, df, columns, group_col, order_col, {**carry, "suspect": suspect}, fan)
    rows = rows.withColumn("folded_root", fold(F.coalesce("suspect", "leaf")))
    return rows.select(*carry, "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
