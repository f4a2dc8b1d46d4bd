"""All similar pairs between set-valued records, by T-occurrence merging of inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.functions.readings import category_reading, location_reading
from atlaswright.operators.skew import salted_join
from atlaswright.session import cut


def merge_skip(lists: list[list[int]], need: int, end: int) -> Iterator[tuple[int, int]]:
    """(number, occurrences) of every number below ``end`` that stands in at least ``need`` of the ascending lists.

    A heap holds each list's next number. If the least number stands at too few heads, the
    ``need - 1`` least heads are taken off, and their lists skip by binary search to the least head that is left:
    nothing in between can reach the count.
    """
    heap = [(a[0], k, 0) for k, a in enumerate(lists) if a and a[0] < end]
    heapq.heapify(heap)
    while len(heap) >= need:
        least, off = heap[0][0], []
        while heap and heap[0][0] == least:
            off.append(heapq.heappop(heap))
        if len(off) >= need:
            yield least, len(off)
            for _, k, at in off:
                if at + 1 < len(lists[k]) and lists[k][at + 1] < end:
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        while heap and len(off) < need - 1:
            off.append(heapq.heappop(heap))
        if not heap:
            return
        goal = heap[0][0]
        for _, k, at in off:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]) and lists[k][at] < end:
                heapq.heappush(heap, (lists[k][at], k, at))


def t_occurrence(lists: list[list[int]], need: int, end: int) -> Iterator[tuple[int, int]]:
    """Like :func:`merge_skip`, but the longest lists are only searched for numbers that the short ones bring up."""
    lists = sorted((a for a in lists if a), key=len)
    if len(lists) < need:
        return
    long = min(need - 1, int(need / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
    short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
    for number, n in merge_skip(short, need - long, end):
        for a in rest:
            at = bisect_left(a, number)
            n += at < len(a) and a[at] == number
        if n >= need:
            yield number, n


def required(t: float, a: int, b: int) -> int:
    """Common values that sets of a and b values need for a Jaccard similarity of t."""
    return max(1, math.ceil(t / (1 + t) * (a + b) - 1e-9))


def join_group(records: list[tuple], t: float, cross: bool) -> Iterator[tuple]:
    """Similar pairs among one group's records (size, id, block, side, values); of a group of two blocks only those across."""
    records.sort(key=lambda r: (r[0], r[1]))
    sizes = [r[0] for r in records]
    blocks = len({r[2] for r in records}) > 1
    lists: dict[int, list[int]] = {}
    for k, (size, name, block, side, values) in enumerate(records):
        own = [a for a in map(lists.get, values) if a]
        if own:
            first = bisect_left(sizes, math.ceil(t * size - 1e-9), 0, k)
            if first < k:
                need = required(t, size, sizes[first])
                if first:
                    own = [a[bisect_left(a, first) :] for a in own]
                for other, n in t_occurrence(own, need, k):
                    o = records[other]
                    if n >= required(t, size, o[0]) and (not blocks or o[2] != block) and (not cross or o[3] != side):
                        yield (o[1], name) if o[1] < name else (name, o[1])
        for v in values:
            lists.setdefault(v, []).append(k)


def numbered_values(rows: DataFrame, bits: int = 63) -> DataFrame:
    """``part, side, record, v``: values as numbers, equal ones only for equal values.

    A number is a hash of ``bits`` bits. Hashes that several values have are looked for among the distinct values (counted before the
    shuffle); such values, a handful among ten billion, are numbered one by one above all hashes.
    """
    hashed = lambda *c: F.shiftright(F.xxhash64(*c), 64 - bits)
    rows, _ = cut(rows.withColumn("v", hashed("part", "value")), "values")  # read twice
    clash = rows.select("part", "value", "v").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("part", "value"))).alias("who")).where("n > 1")
    clash, _ = cut(clash.select("v", "who"), "clashes")
    if clash.isEmpty():
        return rows.select("part", "side", "record", "v")
    place = F.row_number().over(Window.orderBy("v", "w")) + (1 << 62)
    anew = clash.select("v", F.explode("who").alias("w")).select("w.part", "w.value", place.alias("anew"))
    again = rows.join(anew, ["part", "value"], "left")
    return again.select("part", "side", "record", F.coalesce("anew", "v").alias("v"))


def similar_sets(rows: DataFrame, t: float = 0.6, min_size: int = 3, cross: bool = False, block: int = 2000, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct sets with Jaccard similarity of at least ``t``, and which record has which set.

    ``rows``: ``part`` (only records of one part are compared), ``side`` (with ``cross`` only records of different
    sides are, as for two tables), ``record`` and ``value``. Returns ``pairs(part, class_a, class_b)`` and
    ``members(part, record, class)``; a class is named after its smallest record. Equal sets are one class and hence similar.

    Values are ordered from rare to frequent. Similar sets of sizes a and b share at least
    T = t/(1+t) (a+b) values, so one of their first n - T + 1: inverted lists are partitioned by these.
    In each partition every record probes the lists of the smaller ones by T-occurrence merging.
    A partition of more than ``block`` sets is divided by a second (and third) common value, which
    similar sets must have too; what is still larger is split into blocks that meet pairwise. So no
    task holds more than two blocks, and a value that a third of all records hold, being last in order,
    hardly ever opens a partition. Values are compared by 64-bit numbers that differ for different values (:func:`numbered_values`).

    Null parts, records or values do not count; repeated rows count once; records of fewer than ``min_size`` values
    are in no class. A set is one array, so one record's values must fit a task.
    """
    base = numbered_values(rows.where("part is not null and record is not null and value is not null").select("part", "side", "record", "value")).distinct()
    df = base.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    # values of many records are spread over several tasks
    spread = F.ceil(F.col("df") / most).alias("salts")
    hot = df.where(F.col("df") > most).select("v", spread)
    base = base.join(hot, "v", "left").withColumn("salt", F.pmod(F.xxhash64("record"), F.coalesce("salts", F.lit(1)))).drop("salts")
    df = df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("df") / most) - 1)))
    sets = base.join(df, ["v", "salt"]).groupBy("part", "side", "record").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s")).where(F.size("s") >= min_size)
    sets, _ = cut(sets, "sets")
    keyed = ["part", "s"] + (["side"] if cross else [])
    named = sets.groupBy(*keyed).agg(F.min("record").alias("class"))
    members = sets.join(named, keyed).select("part", "side", "record", "class")
    side = F.col("side") if cross else F.lit("")
    n = F.size("s")
    least = F.greatest(F.lit(min_size), F.ceil(t * n - 1e-9))
    need = F.greatest(F.lit(1), F.ceil(t / (1 + t) * (n + least) - 1e-9)).cast("int")
    nil = F.slice("s", 1, 0)
    todo = named.select("part", F.struct("part", "class", side.alias("side")).alias("id"), n.alias("n"), need.alias("need"), F.lit(0).cast("long").alias("key"), nil.alias("path"), F.col("s").alias("rest"))
    done = []
    for depth in range(1, 4):
        # the next common value is among the first (rest - still needed + 1) values
        room = F.size("rest") - (F.col("need") - (depth - 1)) + 1
        first = F.slice("rest", 1, F.greatest(F.lit(0), room))
        nxt = todo.where(F.col("need") >= depth).select("id", "n", "need", "key", "path", F.col("rest").alias("all"), F.posexplode(first).alias("p", "x")).where("x.df > 1")
        nxt = nxt.select("id", "n", "need", F.xxhash64("key", "x.v").alias("key"), F.concat("path", F.array("x")).alias("path"), F.slice("all", F.col("p") + 2, F.size("all")).alias("rest"))
        sizes = nxt.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("least")).where("c > 1")
        met, _ = cut(nxt.join(sizes, "key"), "partitions")
        # a larger partition is refined, unless for sets that need no further common value: they meet it whole
        last = (F.col("c") <= block) | (F.col("least") <= depth) if depth < 3 else F.lit(True)
        done.append(met.where(last))
        todo = met.where((F.col("c") > block) & (F.col("need") > depth))
        if todo.isEmpty():
            break
    ready = done[0]
    for d in done[1:]:
        ready = ready.unionByName(d)
    count = F.ceil(F.col("c") / block).cast("int")
    ready = ready.withColumn("b", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    ready = ready.select(
        F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")).alias("group"), F.when(count > 1, F.when(F.col("b") == F.col("other"), -1).otherwise(F.col("b"))).otherwise(0).alias("block"),
        "id.part", "id.class", "id.side", "n", F.transform(F.concat("path", "rest"), lambda x: x["v"]).alias("values"),
    )
    schema = "part string, class_a string, class_b string"
    found = ready.repartition("group").sortWithinPartitions("group").mapInArrow(_probe(t, cross), schema)
    return found.distinct(), members


def _probe(t: float, cross: bool):  # noqa: ANN202
    """Groups arrive in order; each is joined when the next begins."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        group, part, held, out = None, None, [], ([], [], [])

        def flush() -> None:
            if len(held) > 1:
                for a, b in join_group(held, t, cross):
                    out[0].append(part)
                    out[1].append(a)
                    out[2].append(b)

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["part", "class_a", "class_b"])
            for c in out:
                c.clear()
            return b

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("group", "part", "n", "class", "block", "side", "values")]
            for g, p, n, name, block, side, values in zip(*cols):
                if g != group:
                    flush()
                    group, part = g, p
                    held.clear()
                held.append((n, name, block, side, values))
            if len(out[0]) > 20_000:
                yield batch()
        flush()
        yield batch()

    return run


def feature_rows(categories: DataFrame, named_locations: DataFrame) -> DataFrame:
    """``part, side, record, value`` of the two set-valued features, by their readings."""
    c = categories.select(F.lit("categories").alias("part"), F.lit("").alias("side"), F.col("title").alias("record"), category_reading(F.col("category")).alias("value"))
    loc = named_locations.where("cnt >= 1").select(F.lit("named_locations").alias("part"), F.lit("").alias("side"), F.col("title").alias("record"), location_reading(F.col("location")).alias("value"))
    return c.unionByName(loc)


def expand(pairs: DataFrame, members: DataFrame, most: int = 2000) -> DataFrame:
    """``part, record_a, record_b`` of all similar records; the size is that of the result, equal sets included.

    Where a class has more than ``most`` records, joins on classes are salted: a set that a third of all records have gives its pairs in many tasks.
    """
    m, _ = cut(members.select("part", "class", "record"), "members")
    pairs, _ = cut(pairs, "pairs")
    crowded = not m.groupBy("part", "class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).isEmpty()

    def joined(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
        return salted_join(left, right, ["part", key], record, most) if crowded else left.join(right, ["part", key])

    of = lambda c, r: m.select("part", F.col("class").alias(c), F.col("record").alias(r))
    across = joined(of("class_b", "y"), joined(of("class_a", "x"), pairs, "class_a", "x"), "class_b", "y")
    across = across.select("part", F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
    within = joined(of("class", "record_a"), of("class", "record_b"), "class", "record_a").where("record_a < record_b")
    return across.unionByName(within.select("part", "record_a", "record_b"))


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``part, record, class, links``: each record with its class and its number of similar records."""
    size = members.groupBy("part", "class").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("part", F.col("class_a").alias("class"), F.col("class_b").alias("o")).unionByName(pairs.select("part", F.col("class_b").alias("class"), F.col("class_a").alias("o")))
    links = both.join(size.select("part", F.col("class").alias("o"), "size"), ["part", "o"]).groupBy("part", "class").agg(F.sum("size").alias("n"))
    per = size.join(links, ["part", "class"], "left").select("part", "class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"))
    return members.join(per, ["part", "class"]).select("part", "record", "class", "links")
