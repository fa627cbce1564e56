"""A suffix array with its LCP intervals, built over many partitions.

Strings are put in order by range partitioning; each partition finds how much neighbours share and, from that,
the nested classes of strings with a common prefix. Classes that reach over a partition's end are completed from
the first and last string of every partition: a few numbers each, whatever the number of strings.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written

#: Strings of a partition, about, where there are more than the session's shuffle partitions would take.
PART_ROWS = 200_000
#: Strings of each partition that are looked at for the ranges of the order.
SAMPLED = 20
_SAMPLE = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: A class is numbered by its leftmost string (partition and place) and its depth; LEAF: the string alone.
_PLACE_BITS, _DEPTH_BITS = 27, 16
LEAF = (1 << _DEPTH_BITS) - 1


def _shared(strings: pa.BinaryArray) -> np.ndarray:
    """How many bytes each string has in common with the one before it (0 for the first)."""
    data = np.frombuffer(strings.buffers()[2] or b"\0", dtype=np.uint8)
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros(len(strings), dtype=np.int64)
    step = 4096
    for at in range(1, len(strings), step):
        end = min(len(strings), at + step)
        least = np.minimum(size[at - 1 : end - 1], size[at:end])
        reach = np.arange(int(least.max(initial=0)) + 1)
        a, b = (np.take(data, offsets[lo:hi, None] + reach, mode="clip") for lo, hi in ((at - 1, end - 1), (at, end)))
        out[at:end] = np.argmax((a != b) | (reach >= least[:, None]), axis=1)
    return out


def _common(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each string in its partition: at which depths its class ends to the left (and the leftmost member) and to the right."""
    held, shared, ends = [], [], []
    last: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays([b[c] for c in ("group", "key", "s", "uses", "part")], names=["group", "key", "s", "uses", "part"])
        both = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        group = both["group"].to_numpy()
        found = np.where(np.concatenate([[False], group[1:] == group[:-1]]), _shared(both["s"]), -1)
        shared.append(found if last is None else found[1:])
        ends = [*ends[:1], *([b["s"][0].as_py()] if last is None else []), b["s"][-1].as_py()]
        last = b.slice(b.num_rows - 1)
        held.append(pa.RecordBatch.from_arrays([b["group"], b["key"], b["uses"], b["part"], pc.binary_length(b["s"])], names=["group", "key", "uses", "part", "size"]))
    if not held:
        return
    lcp = np.concatenate(shared).tolist()
    n = len(lcp)
    right: list[tuple[int, ...]] = [()] * n
    stack: list[int] = []
    for k in range(n - 2, -1, -1):
        v = lcp[k + 1]
        if v < 0:
            stack = []
        else:
            while stack and stack[-1] >= v:
                stack.pop()
            stack.append(v)
        right[k] = tuple(stack)
    head = next((k for k in range(1, n) if lcp[k] < 0), n)  # the first group's end
    tail = next((k for k in range(n - 1, 0, -1) if lcp[k] < 0), 0)  # the last group's start
    depths: list[int] = []
    firsts: list[int] = []
    k = 0
    for b in held:
        left, left_first, own_right, his, nodes = [], [], [], [], []
        base, sizes = (b["part"][0].as_py() << _PLACE_BITS), b["size"].to_pylist()
        for size in sizes:
            v = lcp[k]
            if v < 0:
                depths, firsts = [], []
            else:
                first = k - 1
                while depths and depths[-1] >= v:
                    depths.pop()
                    first = firsts.pop()
                depths.append(v)
                firsts.append(first)
            if k < head or k >= tail:  # may go on in another partition
                left.append(tuple(depths))
                left_first.append(tuple(firsts))
                own_right.append(right[k])
                his.append(None)
                nodes.append(None)
            else:
                left.append(None)
                left_first.append(None)
                own_right.append(None)
                hi, node = _merged(depths, [base | f for f in firsts], right[k], base | k, size)
                his.append(hi)
                nodes.append(node)
            right[k] = ()
            k += 1
        place = np.arange(k - b.num_rows, k)
        edge = [ends[0] if p == 0 else ends[-1] if p == n - 1 else None for p in place]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(b[c] for c in ("group", "key", "uses", "part", "size")), pa.array(place.astype(np.int32)), pa.array(left, ints), pa.array(left_first, ints), pa.array(own_right, ints),
             pa.array(place < head), pa.array(place >= tail), pa.array(edge, pa.binary()), pa.array(his, ints), pa.array(nodes, pa.list_(pa.int64()))],
            names=["group", "key", "uses", "part", "size", "place", "left", "left_first", "right", "head", "tail", "edge", "hi", "node"],
        )


_LOCAL = "group long, key binary, uses long, part int, size int, place int, left array<int>, left_first array<int>, right array<int>, head boolean, tail boolean, edge binary, hi array<int>, node array<long>"


def _left_stack(row: dict, entering: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``(depth, leftmost)`` by depth: where the class of ``row`` ends to the left, over all partitions. ``leftmost``: part and place as one number."""
    own = {v: row["part"] << _PLACE_BITS | f for v, f in zip(row["left"], row["left_first"], strict=True)}
    if row["head"] and entering:
        reach = row["left"][0] if row["left"] else row["size"]  # in common with the partition's first string
        depths = [e for e, _ in entering]
        for v in {min(reach, e) for e in depths} | ({reach} if row["left"] else set()):
            i = bisect_left(depths, v)
            if i < len(depths):
                own[v] = entering[i][1]
    return sorted(own.items())


def _right_stack(row: dict, entering: list[int]) -> list[int]:
    if not (row["tail"] and entering):
        return list(row["right"])
    reach = row["right"][0] if row["right"] else row["size"]
    return sorted({*row["right"], *(min(reach, e) for e in entering)})


def _across(edges: list[dict]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
    """What classes bring into each partition from the left and from the right, from the partitions' first and last strings."""
    parts: dict[int, list[dict]] = {}
    for e in sorted(edges, key=lambda e: (e["part"], e["place"])):
        parts.setdefault(e["part"], []).append(e)
    order = sorted(parts)
    left: dict[int, list[tuple[int, int]]] = {}
    right: dict[int, list[int]] = {}
    meets = {}
    for p, q in zip(order, order[1:], strict=False):
        z, a = parts[p][-1], parts[q][0]
        if z["group"] != a["group"]:
            continue
        v = meets[p] = _common(z["edge"], a["edge"])
        stack = _left_stack(z, left.get(p, []))
        at = bisect_left(stack, (v, -1))
        first = stack[at][1] if at < len(stack) else z["part"] << _PLACE_BITS | z["place"]
        left[q] = [*stack[:at], (v, first)]
    for p, q in reversed(list(zip(order, order[1:], strict=False))):
        if p in meets:
            right[p] = [*(v for v in _right_stack(parts[q][0], right.get(q, [])) if v < meets[p]), meets[p]]
    return left, right


def _merged(depths: list[int], firsts: list[int], right: Sequence[int], own: int, size: int) -> tuple[list[int], list[int]]:
    """The classes of a string from the widest to itself: up to which depth each holds, and its number."""
    hi, node = [], []
    i = 0
    for b in sorted({*depths, *right}) if depths and right else depths or right:
        while i < len(depths) and depths[i] < b:
            i += 1
        hi.append(b)
        node.append((firsts[i] if i < len(depths) else own) << _DEPTH_BITS | b)
    if not hi or hi[-1] < size:
        hi.append(size)
        node.append(own << _DEPTH_BITS | LEAF)
    return hi, node


def _classes(row: dict, left: list[tuple[int, int]], right: list[int]) -> tuple[list[int], list[int]]:
    stack = _left_stack(row, left)
    return _merged([d for d, _ in stack], [f for _, f in stack], _right_stack(row, right), row["part"] << _PLACE_BITS | row["place"], row["size"])


def intervals(strings: DataFrame, name: str) -> DataFrame:
    """For ``strings`` (``group`` long, ``key`` binary, ``s`` binary, ``uses`` long; distinct strings in a group): ``group, key,
    uses`` and ``hi, node``.

    ``node``: numbers of the classes of strings of the group that share the string's first bytes, from the widest class on;
    class ``i`` is that of all depths over ``hi[i - 1]`` up to ``hi[i]``. Two strings are in one class just if they share so many bytes. A number
    that ends in LEAF is the string's own. Strings are under ``LEAF`` bytes; no strings give no rows.
    """
    spark = strings.sparkSession
    given = written(strings.select("group", "key", "s", "uses"), name)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), given.count() // PART_ROWS)
    before = spark.conf.get(_SAMPLE)
    spark.conf.set(_SAMPLE, SAMPLED)
    try:
        ordered = given.repartitionByRange(n, "group", "s").sortWithinPartitions("group", "s").withColumn("part", F.spark_partition_id())
        local = written(ordered.mapInArrow(_neighbours, _LOCAL), name)
    finally:
        spark.conf.set(_SAMPLE, before)
    dropped(given)
    edges = [r.asDict() for r in local.where("edge IS NOT NULL").drop("hi", "node").collect()]  # two for each partition
    left, right = _across(edges)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_classes(r, left.get(r["part"], []), right.get(r["part"], [])) for r in b.select(["part", "size", "place", "left", "left_first", "right", "head", "tail"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["group"], b["key"], b["uses"], pa.array([h for h, _ in done], pa.list_(pa.int32())), pa.array([x for _, x in done], pa.list_(pa.int64()))],
                names=["group", "key", "uses", "hi", "node"],
            )

    rest = local.where("head OR tail").mapInArrow(finish, "group long, key binary, uses long, hi array<int>, node array<long>")
    return local.where("NOT (head OR tail)").select("group", "key", "uses", "hi", "node").unionByName(rest)
