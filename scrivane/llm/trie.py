"""The prefix trie of conversations, from their sorted order.

Every turn becomes a symbol of fixed width, a digest of role and text, and every
conversation a row in the order of their symbol sequences. Between neighbours stands
their longest common prefix (LCP). The Cartesian tree over these numbers is the trie's
branching: for each number the nearest smaller ones on both sides are found within
blocks of rows by a stack, and beyond them by the minima of the blocks; numbers of equal
value and bounds are one node; the depths between a node and its parent are rows that
the conversations' turns already are. What a node says of its subtree are differences of
prefix sums over its interval of conversations.

No conversation, block or group is gathered whole: turns are numbered by `ranked`, and
sequences longer than WIDTH symbols are named block by block by the sorted order of
their blocks (names sort as the blocks do), again and again until WIDTH are left.

Nulls and the like: a null role or text is an empty one; a null turn stands first, ties
stand in the order of their digests, so rows that repeat are turns of their own; rows with
a null conversation id belong to none; ids are numbers; a conversation without turns ends
at the root; an empty table has no root; a very long text is one digest and a length;
other columns are not read, so their names cannot clash. The list of ids that end in
one node is hashed as one text, in order, so the ids of one node go through one task,
joined before in pieces of PIECE, in constant memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import ranked, spread_join, write_table

#: Symbols in a key; conversations in a block of the LCP array, at least, and blocks at most.
WIDTH, BLOCK, MOST_BLOCKS = 64, 1 << 14, 1 << 18
#: Ids that are joined into one text before a node's ids meet.
PIECE = 4096
#: Turns of the first conversation of each FAMILY that the others may begin with, below REACH.
FAMILY, REACH = 5, 9


def symbol(role: Column, text: Column) -> Column:
    """A turn's symbol: 128 bits of SHA-256 as hex digits."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, sym, bytes): each conversation's turns, numbered from 0."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), symbol(role_, text_).alias("sym"), F.octet_length(text_).cast("bigint").alias("bytes"),
        F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256).alias("tie"),
    )
    return ranked(rows, ["conv"], ["turn", "tie"], "k", "n").select("conv", "k", "sym", "bytes")


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, sym, bytes) of conversations that begin with the first h turns of the first of their family; one without turns is a row of nulls.

    h is the CRC-32 of the decimal id modulo REACH; the family's first id is id - id % FAMILY.
    """
    own = write_table(turns_of(conversations, conv, turn, role, text), "turns")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(REACH))
    heads = own.where(F.col("k") == 0).select("conv", h.alias("h"))
    first = own.where((F.col("k") < REACH - 1) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), "k", "sym", "bytes")
    # REACH - 1 turns of a family's first at most, and FAMILY ids: no row meets more than a handful.
    based = heads.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    sizes = first.groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    based = based.join(sizes, "base", "left").withColumn("from_base", F.least(F.col("h"), F.coalesce(F.col("had"), F.lit(0))))
    begun = based.join(first, "base").where(F.col("k") < F.col("h")).select("conv", "k", "sym", "bytes")
    offsets = based.select("conv", "h", (F.col("from_base") - F.col("h")).alias("shift"))
    rest = spread_join(own, offsets, ["conv"]).where(F.col("k") >= F.col("h")).select("conv", (F.col("k") + F.col("shift")).alias("k"), "sym", "bytes")
    rows = begun.unionByName(rest)
    bare = heads.select("conv").join(rows.select("conv").distinct(), "conv", "left_anti")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("k", "bigint"), ("sym", "string"), ("bytes", "bigint"))]
    return rows.unionByName(bare.select("conv", *none))


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbols of each block of WIDTH in order, as an array)."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sym"))), lambda x: x.sym).alias("syms"))


def _sequences(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((conv, syms) of at most WIDTH symbols, the names that stand in them, level by level (name, syms))."""
    rows, levels = turns.where("k IS NOT NULL").select("conv", "k", "sym"), []
    while (rows.agg(F.max("k")).first()[0] or 0) >= WIDTH:
        blocks = write_table(_blocks(rows.withColumn("b", F.floor(F.col("k") / WIDTH).cast("bigint")), ["conv", "b"]).withColumn("key", F.array_join("syms", "")), "blocks")
        names = ranked(blocks.groupBy("key").agg(F.first("syms").alias("syms")), [], ["key"], "r", "n")
        names = write_table(names.select("key", F.lpad(F.hex("r"), 16, "0").alias("name"), "syms"), "names")
        levels.append(names.select("name", "syms"))
        rows = write_table(spread_join(blocks.drop("syms"), names.select("key", "name"), ["key"]).select("conv", F.col("b").alias("k"), F.col("name").alias("sym")), "named")
    whole = _blocks(rows, ["conv"])
    bare = turns.where("k IS NULL").select("conv", F.array().cast("array<string>").alias("syms"))
    return whole.unionByName(bare), levels


def _difference(a: Column, b: Column) -> Column:
    """The first place from 0 where both arrays have a symbol and these differ; null if there is none."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))).otherwise(F.array().cast("array<boolean>"))
    at = F.array_position(places, False)
    return F.when(at > 0, at - 1).cast("int")


def sorted_conversations(turns: DataFrame) -> DataFrame:
    """(i, conv, n, total, lcp): conversations in order from 0; their turns, all their bytes, and the LCP with the one before (-1 for the first). Written."""
    sizes = turns.groupBy("conv").agg(F.count("k").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    whole, levels = _sequences(turns)
    keyed = whole.join(sizes, "conv").withColumn("key", F.array_join("syms", ""))
    order = write_table(ranked(keyed, [], ["key", "conv"], "i", "_all").select("i", "conv", "n", "total", "syms"), "order")
    before = order.select((F.col("i") + 1).alias("i"), F.col("n").alias("n_before"), F.col("syms").alias("before"))
    both = order.join(before, "i", "left")
    at = _difference(F.col("before"), F.col("syms"))
    pairs = both.select("i", "conv", "n", "total", F.least("n", "n_before").alias("most"), at.alias("lcp"), F.get("before", at).alias("a"), F.get("syms", at).alias("b"))
    for names in reversed(levels):
        # Of each pair of names that differ the first difference of their symbols, once; `lcp` counts symbols of the level.
        pairs = write_table(pairs, "pairs")
        told = pairs.where("a IS NOT NULL").groupBy("a", "b").count().select("a", "b")
        told = told.join(names.select(F.col("name").alias("a"), F.col("syms").alias("sa")).hint("merge"), "a").join(names.select(F.col("name").alias("b"), F.col("syms").alias("sb")).hint("merge"), "b")
        at = _difference(F.col("sa"), F.col("sb"))
        told = told.select("a", "b", at.alias("at"), F.get("sa", at).alias("next_a"), F.get("sb", at).alias("next_b"))
        pairs = spread_join(pairs, told, ["a", "b"], "left").select("i", "conv", "n", "total", "most", (F.col("lcp") * WIDTH + F.col("at")).alias("lcp"), F.col("next_a").alias("a"), F.col("next_b").alias("b"))
    # Without a difference one of both is the other's beginning.
    return write_table(pairs.select("i", "conv", "n", "total", F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.coalesce("lcp", "most")).cast("bigint").alias("lcp")), "lcp")


def _nearest(lcp: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller numbers before and after each, counted from base; -1 where the block has none."""
    left, right, stack = np.full(len(lcp), -1, np.int64), np.full(len(lcp), -1, np.int64), []
    values = lcp.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = base + i
        # Equal ones stay: each has the same bounds, found through the one below it on the stack.
        below = stack[-1] if stack else -1
        left[i] = (left[below] if values[below] == v else base + below) if below >= 0 else -1
        stack.append(i)
    return left, right


_SUMS = ("leaves", "totals", "fresh")
_BLOCK_SCHEMA = "blk bigint, i bigint, conv bigint, n bigint, lcp bigint, next bigint, psv bigint, nsv bigint, inner bigint, up bigint, down bigint, leaf bigint, total bigint, new bigint, leaves bigint, totals bigint, fresh bigint"


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi + 1] of each pair, from minima of doubling widths."""
    widths = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out, level = np.empty(len(lo), np.int64), values
    for w in range(int(widths.max(initial=0)) + 1):
        mine = np.flatnonzero(widths == w)
        out[mine] = np.minimum(level[lo[mine]], level[hi[mine] - (1 << w) + 1])
        if len(level) > 1 << w:
            level = np.minimum(level[: len(level) - (1 << w)], level[1 << w :])
    return out


def _per_block(rows: pa.Table) -> pa.Table:
    """A block's conversations with what lies within the block: nearest smaller LCPs, the least id between them and from either end, running sums."""
    rows = rows.sort_by("i")
    c = {n: rows.column(n).to_numpy() for n in rows.column_names}
    conv, base = c["conv"], int(c["i"][0])
    psv, nsv = _nearest(c["lcp"], base)
    inner, both = np.full(len(conv), -1, np.int64), np.flatnonzero((psv >= 0) & (nsv >= 0))
    inner[both] = _range_least(conv, psv[both] - base, nsv[both] - 1 - base)
    known = np.zeros(len(conv), bool)
    known[both] = True
    leaf = (c["next"] < c["n"]).astype(np.int64)
    out = [c["blk"], c["i"], conv, c["n"], c["lcp"], c["next"], psv, nsv]
    out = [pa.array(x, pa.int64()) for x in out] + [pa.array(inner, pa.int64(), mask=~known)]
    more = [np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1], leaf, c["total"], c["new"], *map(np.cumsum, (leaf, c["total"], c["new"]))]
    return pa.table(out + [pa.array(x, pa.int64()) for x in more], names=[f.split()[0] for f in _BLOCK_SCHEMA.split(", ")])


class Minima:
    """The minima of blocks: the nearest block with a smaller one, and the least of a range."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1:
            v = self.levels[-1]
            self.levels.append(np.minimum.reduceat(v, np.arange(0, len(v), 2)))

    def after(self, block: int, value: int) -> int:
        """The first block after this one with a minimum below value; -1 if none."""
        level, at = 0, block + 1
        while level < len(self.levels) and at < len(self.levels[level]):
            if self.levels[level][at] < value:
                while level:
                    level, at = level - 1, 2 * at
                    at += self.levels[level][at] >= value
                return int(at)
            if at % 2:
                level, at = level + 1, at // 2 + 1
            elif level + 1 < len(self.levels):
                level, at = level + 1, at // 2
                if self.levels[level][at] >= value:
                    at += 1
                    continue
            else:
                return -1
        return -1

    def before(self, block: int, value: int) -> int:
        """The last block before this one with a minimum below value; -1 if none."""
        level, at = 0, block - 1
        while at >= 0 and level < len(self.levels):
            if self.levels[level][at] < value:
                while level:
                    level, at = level - 1, 2 * at
                    if at + 1 < len(self.levels[level]) and self.levels[level][at + 1] < value:
                        at += 1
                return int(at)
            if at % 2 == 0:
                level, at = level + 1, at // 2 - 1
            else:
                level, at = level + 1, at // 2
                if level < len(self.levels) and self.levels[level][at] >= value:
                    at -= 1
        return -1

    def least(self, lo: int, hi: int) -> int:
        """The least of blocks lo to hi - 1; the largest number if there are none."""
        best, level = np.iinfo(np.int64).max, 0
        while lo < hi:
            if lo % 2:
                best, lo = min(best, int(self.levels[level][lo])), lo + 1
            if hi % 2:
                hi -= 1
                best = min(best, int(self.levels[level][hi]))
            lo, hi, level = lo // 2, hi // 2, level + 1
        return best


def nearest_smaller(order: DataFrame, block: int) -> tuple[DataFrame, np.ndarray]:
    """(the rows of _per_block with psv and nsv for all and sums from the first block on, written; the blocks' least ids).

    psv is the place of the nearest smaller LCP before a conversation's own, nsv after it;
    the first conversation's -1 ends every search to the left, the number of conversations
    every search to the right.
    """
    spark = order.sparkSession
    next_ = order.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("next"))
    rows = order.join(next_, "i", "left").withColumns({"next": F.coalesce("next", F.lit(-1)), "blk": F.floor(F.col("i") / block)})
    table = write_table(rows.groupBy("blk").applyInArrow(_per_block, _BLOCK_SCHEMA), "blocked")  # `block` rows in a group
    per = table.groupBy("blk").agg(F.min("lcp").alias("least"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("rows"), *(F.max(c).alias(c) for c in _SUMS))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BLOCKS rows at most
    per = write_table(per.select("blk", "least", "conv", "rows", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in _SUMS)), "minima")
    found = per.select("blk", "least", "conv", "rows").toArrow().sort_by("blk")
    minima, ids = found.column("least").to_numpy(), found.column("conv").to_numpy()
    count = int(found.column("rows").to_numpy().sum())
    summed = table.join(F.broadcast(per.select("blk", *(f"{c}_before" for c in _SUMS))), "blk")
    table = summed.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in _SUMS}).drop(*(f"{c}_before" for c in _SUMS))
    if len(minima) == 1:
        return table.withColumn("nsv", F.when(F.col("nsv") < 0, F.lit(count)).otherwise(F.col("nsv"))), ids
    shared = spark.sparkContext.broadcast(minima)

    @F.arrow_udf("bigint")
    def block_after(blk: pa.Array, value: pa.Array) -> pa.Array:
        tree = Minima(shared.value)
        return pa.array([tree.after(b, v) for b, v in zip(blk.to_pylist(), value.to_pylist())], pa.int64())

    @F.arrow_udf("bigint")
    def block_before(blk: pa.Array, value: pa.Array) -> pa.Array:
        tree = Minima(shared.value)
        return pa.array([tree.before(b, v) for b, v in zip(blk.to_pylist(), value.to_pylist())], pa.int64())

    # What a block leaves open is asked once for each value: at most as many questions as its stack had different numbers.
    asked = write_table(
        table.where("nsv < 0").select("blk", "lcp", F.lit("nsv").alias("side")).unionByName(table.where("psv < 0 AND i > 0").select("blk", "lcp", F.lit("psv").alias("side"))).distinct(), "asked",
    )
    asked = asked.withColumn("there", F.when(F.col("side") == "nsv", block_after("blk", "lcp")).otherwise(block_before("blk", "lcp")))
    asked = write_table(asked, "asked-where")
    wanted = asked.where("there >= 0").select(F.col("there").alias("blk"), F.col("lcp").alias("value"), "side").distinct()

    def look(rows: pa.Table, questions: pa.Table) -> pa.Table:
        """In the block that has a smaller number: the first one from its start, or the last one before its end."""
        rows = rows.sort_by("i")
        lcp, base = rows.column("lcp").to_numpy(), rows.column("i")[0].as_py() if rows.num_rows else 0
        down, up = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])
        value, side = questions.column("value").to_numpy(), questions.column("side").to_pylist()
        first = np.searchsorted(-down, -value, "right")
        last = len(lcp) - 1 - np.searchsorted(-up, -value, "right")
        at = np.where(np.array(side) == "nsv", first, last) + base if len(value) else np.zeros(0, np.int64)
        return pa.table([questions.column("blk"), questions.column("value"), questions.column("side"), pa.array(at, pa.int64())], names=["blk", "value", "side", "at"])

    answers = table.select("blk", "i", "lcp").groupBy("blk").cogroup(wanted.groupBy("blk")).applyInArrow(look, "blk bigint, value bigint, side string, at bigint")
    told = asked.join(answers.select(F.col("blk").alias("there"), F.col("value").alias("lcp"), "side", "at"), ["there", "lcp", "side"], "left")
    both = write_table(told.groupBy("blk", "lcp").agg(F.max(F.when(F.col("side") == "psv", F.col("at"))).alias("psv_at"), F.max(F.when(F.col("side") == "nsv", F.col("at"))).alias("nsv_at")), "told")
    full = spread_join(table, both, ["blk", "lcp"], "left")
    psv = F.when(F.col("psv") < 0, F.coalesce("psv_at", F.lit(-1))).otherwise(F.col("psv"))
    nsv = F.when(F.col("nsv") < 0, F.coalesce("nsv_at", F.lit(count))).otherwise(F.col("nsv"))
    return write_table(full.withColumns({"psv": psv, "nsv": nsv}).drop("psv_at", "nsv_at"), "nearest"), ids


def _with_running_bytes(turns: DataFrame) -> DataFrame:
    """turns with `before`, the bytes of the conversation's earlier turns, without gathering a conversation."""
    rows = turns.where("k IS NOT NULL").withColumn("b", F.floor(F.col("k") / PIECE).cast("bigint"))
    within = Window.partitionBy("conv", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv", "b").agg(F.sum("bytes").alias("held"))
    across = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for PIECE turns
    bases = pieces.select("conv", "b", F.coalesce(F.sum("held").over(across), F.lit(0)).alias("base"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return placed.join(bases.hint("merge"), ["conv", "b"]).select("conv", "k", "bytes", (F.col("base") + F.col("inside")).alias("before"))


def _hashed(batches):
    """The digest and number of each node's ids, of pieces sorted by node and place."""
    key, text, n = None, None, 0
    names = ["l", "v", "ends", "ends_sha256"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for l, v, held, ids in zip(*(batch.column(c).to_pylist() for c in ("l", "v", "held", "ids"))):
            if (l, v) != key:
                if key:
                    for x, y in zip(out, (*key, n, text.hexdigest())):
                        x.append(y)
                key, text, n = (l, v), hashlib.sha256(), 0
            if n:
                text.update(b",")
            text.update(ids.encode())
            n += held
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, n, text.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)


def _ends(nodes: DataFrame) -> DataFrame:
    """(l, v, ends, ends_sha256) of the nodes in which conversations end."""
    last = nodes.select(F.when(F.col("lcp") == F.col("n"), F.col("psv")).otherwise(F.col("i")).alias("l"), F.col("n").alias("v"), "i", "conv")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "conv"))), lambda x: x.conv.cast("string"))
    pieces = last.groupBy("l", "v", F.floor(F.col("i") / PIECE).alias("piece")).agg(F.count(F.lit(1)).alias("held"), F.array_join(texts, ",").alias("ids"))
    return pieces.repartition("l", "v").sortWithinPartitions("l", "v", "piece").mapInArrow(_hashed, "l bigint, v bigint, ends bigint, ends_sha256 string")


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of turns (conv, k, sym, bytes), as `turns_of` or `rebuilt` gives them.

    conv_id is a node's smallest member, parent_conv_id its parent's; n_convs members,
    n_children children, n_leaves childless nodes below or at it, saved_tokens the bytes
    of the repeats of last turns below and at it, ends_sha256 the digest of the ids that
    end here.
    """
    spark = turns.sparkSession
    turns = write_table(turns, "trie-turns")
    order = sorted_conversations(turns)
    placed = order.select("conv", "i", "lcp")
    own = write_table(spread_join(_with_running_bytes(turns), placed, ["conv"], "inner", turns).where(F.col("k") >= F.col("lcp")).select("i", (F.col("k") + 1).alias("depth"), "bytes", "before"), "first-seen")
    new = own.groupBy("i").agg(F.sum("bytes").alias("new"))
    count = order.count()
    size = max(block, -(-count // MOST_BLOCKS))
    nodes, ids = nearest_smaller(order.join(new, "i", "left").fillna(0, ["new"]), size)
    nodes = write_table(nodes, "conversations")

    # Nodes that branch or repeat, and those of single conversations: members l to r, depth v.
    some = nodes.where("lcp >= 0").groupBy(F.col("psv").alias("l"), F.col("lcp").alias("v")).agg((F.max("nsv") - 1).alias("r"), F.count(F.lit(1)).alias("joins"), F.min("inner").alias("least"))
    single = nodes.where(F.col("n") > F.greatest("lcp", "next")).select(F.col("i").alias("l"), F.col("n").alias("v"), F.col("i").alias("r"), F.lit(0).cast("bigint").alias("joins"), F.col("conv").alias("least"))
    at_l = nodes.select(F.col("i").alias("l"), F.col("lcp").alias("lcp_l"), F.col("psv").alias("psv_l"), F.col("blk").alias("blk_l"), "down", (F.col("leaves") - F.col("leaf")).alias("leaves_l"), (F.col("totals") - F.col("total")).alias("totals_l"), (F.col("fresh") - F.col("new")).alias("fresh_l"), F.col("total").alias("own_total"), F.col("new").alias("own_new"))
    at_r = nodes.select(F.col("i").alias("r"), F.col("next").alias("next_r"), F.col("blk").alias("blk_r"), F.col("up").alias("up_r"), F.col("leaves").alias("leaves_r"), F.col("totals").alias("totals_r"), F.col("fresh").alias("fresh_r"))
    full = some.unionByName(single).join(at_l.hint("merge"), "l").join(at_r.hint("merge"), "r")
    shared = spark.sparkContext.broadcast(ids)  # MOST_BLOCKS numbers at most

    @F.arrow_udf("bigint")
    def least_between(lo: pa.Array, hi: pa.Array) -> pa.Array:
        tree = Minima(shared.value)
        return pa.array([tree.least(a, b) for a, b in zip(lo.to_pylist(), hi.to_pylist())], pa.int64())

    full = write_table(full, "nodes")
    # An interval within a block has its least id already, or ends with the block.
    wide = full.where("least IS NULL AND blk_l < blk_r").withColumn("least", F.least("down", "up_r", least_between(F.col("blk_l") + 1, F.col("blk_r"))))
    full = full.where("least IS NOT NULL OR blk_l = blk_r").withColumn("least", F.coalesce("least", "down")).unionByName(wide)
    full = full.withColumn("above", F.greatest("lcp_l", "next_r")).withColumn("l_above", F.when(F.col("above") > F.col("lcp_l"), F.col("l")).otherwise(F.col("psv_l")))
    full = write_table(full.join(_ends(nodes).hint("merge"), ["l", "v"], "left").fillna(0, ["ends"]), "intervals")
    parents = full.select(F.col("l").alias("l_above"), F.col("v").alias("above"), F.col("least").alias("parent"))
    told = spread_join(full, parents, ["l_above", "above"], "left")

    # The depths between a node and its parent, in two steps, so that no array is long.
    steps = told.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("v"), F.lit(PIECE).cast("bigint"))))
    deep = steps.withColumn("depth", F.explode(F.sequence(F.col("from"), F.least("v", F.col("from") + PIECE - 1))))
    seen = own.select(F.col("i").alias("l"), "depth", "before")
    deep = deep.join(seen.hint("merge"), ["l", "depth"], "left").fillna(0, ["before"])  # the root has no turn
    bottom, top = F.col("depth") == F.col("v"), F.col("depth") == F.col("above") + 1
    members = F.col("r") - F.col("l") + 1
    saved = (F.col("totals_r") - F.col("totals_l")) - members * F.col("before") - (F.col("fresh_r") - F.col("fresh_l") - F.col("own_new") + F.col("own_total") - F.col("before"))
    return deep.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.when(top, F.col("parent")).otherwise(F.col("least"))).alias("parent_conv_id"), members.alias("n_convs"),
        F.when(bottom, F.col("joins") + 1 - F.col("ends")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), (F.col("leaves_r") - F.col("leaves_l")).alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(bottom & (F.col("ends") > 0), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
