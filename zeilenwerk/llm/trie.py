"""The prefix trie of conversations, by chained digests.

A turn is the hash of its role and text. Turns are numbered in their conversation by a global order, dealt out by
ranges, so that a conversation of very many turns is no task's alone. A prefix's digest covers its last turn and the
digest of the prefix before it; the chain is cut in segments of SEGMENT turns, whose ends are chained once more, so that
long conversations are chained in parallel and conversations of equal beginnings still have equal digests.

Every prefix is a row. Grouped by (depth, digest) they are the nodes, each known by its smallest member. Nodes of one
smallest member are a chain down the trie. Subtree sums: a chain's nodes are summed upwards within it, and its total
goes to every ancestor of its top, which are the prefixes of that member. So each node reaches all its ancestors, but a
chain is one row for each of them instead of one for each of its nodes, and the rows are never more than the prefixes.

Members that end at a node are listed in their order as strings of RUN ids, and the strings of a node are hashed one
after another; a node where very many end is a row for RUN of them.

Null roles and texts are empty. Rows of a null conv_id belong to no conversation. Turns of equal number stand by role,
then text; repeated rows are turns of their own. An empty table has no nodes. Long texts are only hashed. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, written

#: Turns that are chained by one task.
SEGMENT = 1024
#: Ids in a string of members.
RUN = 4096
#: Conversations of a family (conv_id - conv_id % FAMILY) take their first turns from it, fewer than HEADS.
FAMILY, HEADS = 5, 9
_NONE = hashlib.sha256(b"").digest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turns(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, in the order of turn), digest, bytes (of the text); a written table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = df.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    digest = _sha(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = numbered(own, order, "conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    first = rows.groupBy("conv_id").agg(F.min("at").alias("first"))
    return written(rows.join(first.hint("merge"), "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "digest", "bytes"), "turns")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of `turns` -> (conv_id, pos, digest, bytes, last; conv_id, n). A conversation's first h turns are those of
    its family's first one, its own follow after h."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases.hint("merge"), "base", "left").withColumn("given", given).withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "given", "total"), "convs")
    own = rows.join(convs.hint("merge"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    heads = rows.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.hint("merge"), "base").where("pos < given")
    cols = ["conv_id", "pos", "digest", "bytes", (F.col("pos") == F.col("total") - 1).alias("last")]
    return own.select(*cols).unionByName(heads.select(*cols)), convs.select("conv_id", F.col("total").alias("n"))


def _links(key: list[str], value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, b""
        for b in batches:
            before, after = [], []
            for *k, v in zip(*[b.column(c).to_pylist() for c in [*key, value]]):
                if k != last:
                    last, digest = k, b""
                before.append(digest)
                digest = hashlib.sha256(digest + v).digest()
                after.append(digest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())], [*b.schema.names, "before", "after"])

    return run


def chained(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """df with `after`, the digest of the key's values up to a row, and `before`, that of the row before (first: empty)."""
    schema = T.StructType([*df.schema.fields, T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])
    return df.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(_links(key, value), schema)


def prefixes(rows: DataFrame, convs: DataFrame, segment: int | None = None) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, digest, parent (the digest of the prefix before), bytes (of
    its last text), last (nothing follows); a written table. convs: conv_id, n."""
    segment = segment or SEGMENT
    inner = chained(rows.withColumn("segment", F.floor(F.col("pos") / segment).cast("long")), ["conv_id", "segment"], "pos", "digest")
    inner = written(inner.drop("digest"), "chained")
    ends = inner.where(F.col("pos") % segment == segment - 1).select("conv_id", "segment", F.col("after").alias("end"))
    ends = chained(ends, ["conv_id"], "segment", "end").select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("after").alias("carry"), _sha(F.concat("before", "end")).alias("left"))
    empty, root = F.lit(b""), F.lit(_NONE)
    first = inner.where("segment = 0").withColumn("carry", empty).withColumn("left", root)
    later = inner.where("segment > 0").join(ends.hint("merge"), ["conv_id", "segment"])
    parent = F.when(F.col("pos") % segment == 0, F.col("left")).otherwise(_sha(F.concat("carry", "before")))
    each = first.unionByName(later).select("conv_id", (F.col("pos") + 1).alias("depth"), _sha(F.concat("carry", "after")).alias("digest"), parent.alias("parent"), "bytes", "last")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("n") == 0).alias("last"))
    return written(each.unionByName(roots), "prefixes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, digest, conv_id) -> depth, digest, first, ids."""
    node, ids = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "digest": pa.array([node[1]], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for b in batches:
        for d, g, c in zip(*[b.column(x).to_pylist() for x in ("depth", "digest", "conv_id")]):
            if ids and ((d, g) != node or len(ids) == RUN):
                yield made()
                ids = []
            node = (d, g)
            ids.append(c)
    if ids:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, digest, first, ids) -> depth, digest, ends_sha256."""
    node, state = None, hashlib.sha256()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "digest": pa.array([node[1]], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    for b in batches:
        for d, g, ids in zip(*[b.column(x).to_pylist() for x in ("depth", "digest", "ids")]):
            if (d, g) != node:
                if node:
                    yield made()
                node, state = (d, g), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
    if node:
        yield made()


def endings(each: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256 of the nodes where a conversation ends."""
    key = ["depth", "digest"]
    ended = each.where("last").select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    runs = ended.mapInArrow(_runs, "depth long, digest binary, first long, ids string")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def sums_below(nodes: DataFrame, each: DataFrame, values: list[str], segment: int | None = None) -> DataFrame:
    """depth, digest and the sums of the values over each node's subtree, itself included. nodes: conv_id, depth, digest
    and the values; each: the prefixes."""
    segment = segment or SEGMENT
    part = nodes.select("conv_id", "depth", "digest", F.floor(F.col("depth") / segment).cast("long").alias("part"), *values)
    parts = part.groupBy("conv_id", "part").agg(*[F.sum(v).alias(f"__{v}") for v in values], F.min("depth").alias("__top"))
    deeper = W.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = parts.select("conv_id", "part", *[F.coalesce(F.sum(f"__{v}").over(deeper), F.lit(0)).alias(f"__{v}") for v in values])
    down = W.partitionBy("conv_id", "part").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    inside = part.select("conv_id", "part", "depth", "digest", *[F.sum(v).over(down).alias(v) for v in values])
    within = inside.join(later.hint("merge"), ["conv_id", "part"]).select("depth", "digest", *[(F.col(v) + F.col(f"__{v}")).alias(v) for v in values])
    chains = parts.groupBy("conv_id").agg(F.min("__top").alias("__top"), *[F.sum(f"__{v}").alias(v) for v in values])
    above = each.select("conv_id", "depth", "digest").join(chains.hint("merge"), "conv_id").where("depth < __top").select("depth", "digest", *values)
    return within.unionByName(above).groupBy("depth", "digest").agg(*[F.sum(v).alias(v) for v in values])


def trie(df: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    each = prefixes(*rebuilt(turns(df)))
    key = ["depth", "digest"]
    nodes = each.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.hint("merge"), key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(parents.hint("merge"), ["depth", "parent"], "left")
    out = out.join(sums_below(nodes, each, ["n_leaves", "saved_tokens"]).hint("merge"), key).join(endings(each).hint("merge"), key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE.hex())).alias("ends_sha256"))
