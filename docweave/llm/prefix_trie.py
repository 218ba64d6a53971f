"""The prefix trie of conversations, by van Emde Boas recursion over depth.

Sequences of turns, each ended by an end mark, are padded to a power of two of depths. The recursion cuts all of them at half
depth at once, one round of joins for each halving:

* *name*: the sequences below one root that agree in their upper half are one group; its smallest conversation names the node at
  the cut. A name with its depth is exact: different nodes of a depth have no member in common.
* *upper trie, lower forests*: the upper half of a group goes on once, with its number of members, below the old root;
  the lower halves go on below the name. Both are problems of half the depth, solved in the same round. At depth one a problem is
  an edge of the trie.
* *graft*: sums within blocks of depths go upward by doubling, block onto block along the names at the cuts, then whole
  subtrees' sums come down from the top; each of both sweeps is linear in the nodes.

Blocks of turns are equal if their digests (SHA-256 of the halves' digests) are; they are built beforehand, bottom up.
Nothing holds a conversation or a node's members in one row: turns are numbered within stretches of ``STRETCH`` turn numbers, and
the digests of member ids run over parcels of sorted ids as a stream (SHA-256 has no parallel form).

Defined results: turns are ordered by turn (null first), then role, then text; a null role or text is empty; rows of a null conv_id
take no part; repeated rows are turns like others; depths count rebuilt turns, however long their texts. ``%`` keeps the sign of a negative
conv_id, as SQL does. No conversations give no nodes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, rows

#: Turn numbers of a stretch in which turns are counted; span of conv_ids in a parcel of members.
STRETCH, PARCEL = 1_024, 4_096
#: Conversations from conv_id - conv_id % FAMILY on share their first turns; at most LONGEST - 1 of them.
FAMILY, LONGEST = 5, 9
_DIGEST = pa.schema([("rep", pa.int64()), ("ends_sha256", pa.string())])


def numbered_turns(said: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation from 0, without a window over a whole conversation."""
    t = said.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.where("conv_id is not null").withColumn("part", F.floor(F.col("turn") / STRETCH))  # null: the first part
    counts = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before"))
    t = t.withColumn("own", own)
    return t.join(offsets, (t.conv_id == offsets.c) & t.part.eqNullSafe(offsets.p)).select("conv_id", (F.col("before") + F.col("own") - 1).alias("pos"), "role", "text")


def shared_turns(conv: str) -> Column:
    return F.crc32(F.col(conv).cast("string").cast("binary")) % LONGEST


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the first turns of the family's first conversation, then each one's own further turns.

    ``turns``: cut. A conversation that is left without turns has no rows here.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    family = lambda c: F.col(c) - F.col(c) % FAMILY
    members = lengths.select(F.col("conv_id").alias("member"), family("conv_id").alias("conv_id"), shared_turns("conv_id").alias("h"))
    first = turns.where(F.col("pos") < LONGEST - 1).join(members, "conv_id").where("pos < h").select(F.col("member").alias("conv_id"), "pos", "role", "text")
    # a family whose first conversation has h turns or more moves nothing: only shorter ones need their length
    short = lengths.where(F.col("n") < LONGEST - 1).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    some = lengths.select("conv_id", shared_turns("conv_id").alias("h"), family("conv_id").alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.lit(True).alias("there"))
    some = some.join(bases, "base", "left").join(short, "base", "left")
    used = F.when(F.col("there").isNull(), 0).otherwise(F.least("h", F.coalesce("n_base", "h")))
    rest = turns.join(some.select("conv_id", "h", used.alias("used")), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("used")).alias("pos"), "role", "text")
    return first.unionByName(rest)


def _pair(a: str, b: str) -> Column:
    """The digest of a block of two halves; the second may lack."""
    return F.unhex(F.sha2(F.concat(F.col(a), F.coalesce(F.col(b), F.lit(b""))), 256))


class Blocks:
    """Digests of the aligned blocks of 1, 2, 4, ... turns of every sequence, end mark included; level by level in scratch files."""

    def __init__(self, sequences: DataFrame, convs: DataFrame, scratch: Scratch):
        turn = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256))
        ends = convs.join(sequences.groupBy("conv_id").agg(F.count("*").alias("block")), "conv_id", "left")
        ends = ends.select("conv_id", F.coalesce("block", F.lit(0)).cast("long").alias("block"), F.lit(b"end").alias("key"), F.lit(None).cast("long").alias("bytes"))
        level = sequences.select("conv_id", F.col("pos").alias("block"), turn.alias("key"), F.octet_length("text").cast("long").alias("bytes")).unionByName(ends)
        self.levels = [scratch.keep(level)]
        most = self.levels[0].agg(F.max("block")).first()[0] or 0
        while len(self.levels) < 2 or most >> len(self.levels) - 1:
            half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("key")))
            up = self.levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("b")).agg(half(0).alias("x"), half(1).alias("y"))
            self.levels.append(scratch.keep(up.select("conv_id", F.col("b").alias("block"), _pair("x", "y").alias("key"))))


def cut_halves(blocks: Blocks, scratch: Scratch) -> list[DataFrame]:
    """For each level j: (root, block, rep, n, key): below node ``root`` at depth block * 2^j, the n conversations that go on with the same 2^j turns.

    ``rep`` is the smallest of them, and the name of the node at their end. Level 0 (with bytes) has the edges of the trie.
    """
    top = blocks.levels[-1].groupBy("key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    top = cut(top)
    least = top.agg(F.min("rep")).first()[0]
    levels = [scratch.keep(top.select(F.lit(least).cast("long").alias("root"), F.lit(0).cast("long").alias("block"), "rep", "n", "key"))]
    for j in range(len(blocks.levels) - 2, -1, -1):
        more = [] if j else ["bytes"]
        least_bytes = [F.min(c).alias(c) for c in more]
        halves = blocks.levels[j].select(F.col("conv_id").alias("rep"), F.shiftright("block", 1).alias("whole"), F.col("block"), "key", *more)
        whole = levels[-1].select("rep", F.col("block").alias("whole"), "root", "n")
        both = scratch.keep(whole.join(halves, ["rep", "whole"]))
        first = F.col("block") % 2 == 0
        upper = scratch.keep(both.where(first).groupBy("root", "block", "key").agg(F.min("rep").alias("name"), F.sum("n").alias("n"), *least_bytes))
        # each lower half hangs below the name of its upper half
        tops = both.where(first).select("rep", "whole", "root", "block", "key").join(upper.select("root", "block", "key", "name"), ["root", "block", "key"]).select("rep", "whole", "name")
        lower = both.where(~first).select("rep", "whole", "block", "key", "n", *more).join(tops, ["rep", "whole"])
        lower = lower.groupBy(F.col("name").alias("root"), "block", "key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), *least_bytes)
        levels.append(scratch.keep(upper.withColumnRenamed("name", "rep").select("root", "block", "rep", "n", "key", *more).unionByName(lower.select("root", "block", "rep", "n", "key", *more))))
    return levels[::-1]


def grafted(own: DataFrame, levels: list[DataFrame], scratch: Scratch, *values: str) -> DataFrame:
    """(name, depth, *values): the values of the nodes (name, depth, parent) summed over their subtrees without their tops.

    ``own``: cut or in files, without the root. The root's name is that of its children's parent.
    """
    sums = [F.sum(v).alias(v) for v in values]
    # up: sums[j] of the nodes at multiples of 2^j, over the 2^j depths below them
    up = [scratch.keep(own.groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(*sums))]
    hung = [lv.select(F.col("rep").alias("name"), ((F.col("block") + 1) * (1 << j)).alias("depth"), F.col("root").alias("above"), (F.col("block") * (1 << j)).alias("at")) for j, lv in enumerate(levels)]
    for j in range(len(levels) - 1):
        wide = 1 << j
        odd = F.floor(F.col("depth") / wide) % 2 == 1
        low = up[j].where(odd).join(hung[j], ["name", "depth"]).groupBy(F.col("above").alias("name"), F.col("at").alias("depth")).agg(*sums)
        up.append(scratch.keep(up[j].where(~odd).unionByName(low).groupBy("name", "depth").agg(*sums)))
    # down: whole subtrees of the nodes at multiples of 2^j
    whole = up[-1]
    for j in range(len(levels) - 2, -1, -1):
        odd = F.floor(F.col("depth") / (1 << j)) % 2 == 1
        # whole has the even multiples of this level; those below an odd one add to its own block
        low = whole.where("depth > 0").join(hung[j], ["name", "depth"]).where(F.floor(F.col("at") / (1 << j)) % 2 == 1)
        low = low.groupBy(F.col("above").alias("name"), F.col("at").alias("depth")).agg(*sums)
        whole = scratch.keep(whole.unionByName(up[j].where(odd).unionByName(low).groupBy("name", "depth").agg(*sums)))
    return whole


def digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): the digest of each group's conv_ids, ascending and joined by commas; ``members``: (rep, conv_id).

    Parcels of sorted ids are joined in parallel; one stream over a group's parcels makes its digest, in bounded memory.
    """
    part = F.floor(F.col("conv_id") / PARCEL)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parcels = members.groupBy("rep", part.alias("part")).agg(text.alias("ids"))

    def run(batches):
        rep, state = None, None
        for b in batches:
            out = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != rep:
                    if rep is not None:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield rows(_DIGEST, list(zip(*out, strict=True)))
        if rep is not None:
            yield rows(_DIGEST, [[rep], [state.hexdigest()]])

    dealt = parcels.repartition("rep").sortWithinPartitions("rep", "part")
    return dealt.select("rep", "ids").mapInArrow(run, "rep long, ends_sha256 string")


def trie(said: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations; see the module."""
    with Scratch(said.sparkSession) as scratch:
        turns = scratch.keep(numbered_turns(said))
        convs = turns.select("conv_id").distinct()
        sequences = scratch.keep(rebuilt(turns))
        blocks = Blocks(sequences, convs, scratch)
        levels = cut_halves(blocks, scratch)
        end = F.col("key") == F.lit(b"end")
        edges = levels[0]
        nodes = edges.where(~end).select(F.col("rep").alias("name"), (F.col("block") + 1).alias("depth"), F.col("root").alias("parent"), "n", "bytes")
        root = edges.where("block = 0").groupBy(F.col("root").alias("name")).agg(F.sum("n").alias("n")).select("name", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("bytes"))
        children = nodes.groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        every = nodes.unionByName(root).join(children, ["name", "depth"], "left").fillna(0, ["n_children"])
        every = scratch.keep(every.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes")))
        below = grafted(every.where("depth > 0").select("name", "depth", "parent", "leaf", "saved"), levels, scratch, "leaf", "saved")
        # an end mark's edge stands for the conversations that end at its root
        groups = levels[-1].select("key", "rep")
        members = blocks.levels[-1].select("conv_id", "key").join(groups, "key").select("rep", "conv_id")
        ends = edges.where(end).select(F.col("root").alias("name"), F.col("block").alias("depth"), "rep").join(digests(members), "rep").drop("rep")
        total = lambda c: (F.col(f"every.{c}") + F.coalesce(F.col(f"below.{c}"), F.lit(0))).cast("long")
        out = every.alias("every").join(below.alias("below"), ["name", "depth"], "left").join(ends, ["name", "depth"], "left")
        return cut(out.select(
            F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
            total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ))


_crc = "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: case when v >= 0 then xor(a, v) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)"
ORACLE = f"""
with turns as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own from conversations where conv_id is not null group by 1
), families as (select conv_id, own, conv_id - conv_id % {FAMILY} as base, cast(xor({_crc}, 4294967295::bigint) % {LONGEST} as bigint) as h from turns
), seqs as (
  select f.conv_id, list_concat(coalesce(b.own[1:f.h], []), f.own[f.h + 1:]) as seq from families f left join turns b on b.conv_id = f.base
), prefixes as (
  select conv_id, d as depth, seq[1:d] as prefix, len(seq) = d as ends from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from seqs)
), nodes as (
  select prefix, depth, min(conv_id) as name, count(*) as n_convs, coalesce(sha256(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends)), sha256('')) as ends_sha256 from prefixes group by 1, 2
), edges as (
  select n.*, p.name as parent, case when n.depth > 0 then (n.n_convs - 1) * strlen(n.prefix[n.depth].t) else 0 end as saved from nodes n left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
), counted as (
  select e.*, (select count(*) from edges c where c.parent = e.name and c.depth = e.depth + 1) as n_children from edges e
), above as (
  select c.name as node, c.depth as node_depth, c.saved, cast(c.n_children = 0 as bigint) as leaf, u.name, u.depth from (select *, unnest(range(0, depth + 1)) as d from counted) c join nodes u on u.depth = c.d and u.prefix = c.prefix[1:c.d]
), sums as (select name, depth, sum(leaf) as n_leaves, sum(saved) as saved_tokens from above group by 1, 2)
select c.name as conv_id, c.depth, c.parent as parent_conv_id, c.n_convs, c.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, c.ends_sha256
from counted c join sums s using (name, depth)
"""
