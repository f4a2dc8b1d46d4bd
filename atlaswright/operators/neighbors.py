"""Postings, candidates and nearest neighbours by blended similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS, Settings, Weights
from atlaswright.operators.skew import salted_join
from atlaswright.session import cut

FEATURES = ("words", "locations", "categories")


def postings(words: DataFrame, locations: DataFrame, categories: DataFrame, located: DataFrame) -> DataFrame:
    """``feature, term, title, score, has_coords`` of word vectors, location vectors and categories (score 1).

    ``located`` has the titles with a position. Fields for words: title, word, score; locations: title, location, score.
    """
    rows = words.select(F.lit("words").alias("feature"), F.col("word").alias("term"), "title", "score")
    rows = rows.unionByName(locations.select(F.lit("locations").alias("feature"), F.col("location").alias("term"), "title", "score"))
    rows = rows.unionByName(categories.select(F.lit("categories").alias("feature"), F.col("category").alias("term"), "title", F.lit(1.0).alias("score")).distinct())
    known = located.select("title").distinct().withColumn("has_coords", F.lit(True))
    return rows.join(known, "title", "left").withColumn("has_coords", F.coalesce("has_coords", F.lit(False)))


def posting_lists(rows: DataFrame, most: int = 4096) -> DataFrame:
    """``feature, term, segment, list``: title and fixed-point score (millionths, truncated) of each term, by title. For export.

    A list of more than ``most`` titles comes in segments of about that length, by a hash of the title, so no row grows with the corpus.
    """
    point = F.struct("title", F.round(F.col("score") * 1_000_000, 3).cast("int").alias("score"))
    long = rows.groupBy("feature", "term").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("feature", "term", F.ceil(F.col("c") / most).alias("n"))
    segment = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("title"), F.col("n"))).otherwise(F.lit(0)).cast("int")
    cut = rows.join(long, ["feature", "term"], "left").withColumn("segment", segment)
    return cut.groupBy("feature", "term", "segment").agg(F.sort_array(F.collect_list(point)).alias("list"))


def _numbered(*tables: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Ids of all titles (in the titles' order), and each table with ``title`` replaced by ``id``: pairs of numbers shuffle lighter."""
    every = tables[0].select("title")
    for t in tables[1:]:
        every = every.unionByName(t.select("title"))
    ids, _ = cut(ordered_ids(every.where("title is not null").distinct(), ["title"], "id"), "ids")
    return ids, [t.join(ids, "title").drop("title") for t in tables]


def _named(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``a`` and ``b`` as ``title`` and ``neighbor`` again."""
    out = pairs.join(ids.select(F.col("id").alias("a"), "title"), "a").join(ids.select(F.col("id").alias("b"), F.col("title").alias("neighbor")), "b")
    return out.drop("a", "b")


def common_terms(queries: DataFrame, index: DataFrame, keep: Column | None = None, max_postings: int | None = None) -> DataFrame:
    """``title, neighbor, feature, n, dot``: terms in common and dot product of every query title and index title sharing a term.

    One self-join gives counts and dot products, both being sums over the same terms. A term with most of the postings makes
    a large join partition, which is salted. ``keep`` is a condition on ``feature``, ``n`` and ``dot``. ``max_postings`` leaves out
    terms with longer lists; that changes results and is off by default.
    """
    ids, (q, x) = _numbered(queries.select("feature", "term", "title", "score"), index.select("feature", "term", "title", "score"))
    right = x.select("feature", "term", F.col("id").alias("b"), F.col("score").alias("other"))
    if max_postings:
        short = x.groupBy("feature", "term").count().where(F.col("count") <= max_postings).select("feature", "term")
        right = right.join(short, ["feature", "term"], "left_semi")
    met = salted_join(q.withColumnRenamed("id", "a"), right, ["feature", "term"], "a", 256).where("a <> b")
    kind = F.when(F.col("feature") == FEATURES[0], 0).when(F.col("feature") == FEATURES[1], 1).otherwise(2)
    common = met.groupBy("a", "b", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score") * F.col("other")).alias("dot"))
    common = common.withColumn("feature", F.array(*map(F.lit, FEATURES))[F.col("kind")])
    return _named(common if keep is None else common.where(keep), ids).select("title", "neighbor", "feature", "n", "dot")


def candidates(common: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs sharing enough terms of at least one feature, each once."""
    least = {"words": settings.least_common_words, "locations": settings.least_common_locations, "categories": settings.least_common_categories}
    if min(least.values()) < 1:
        raise ValueError("thresholds must be positive")
    enough = F.lit(False)
    for feature, k in least.items():
        enough = enough | ((F.col("feature") == feature) & (F.col("n") >= k))
    return common.where(enough).select("title", "neighbor").distinct()


def pairs_in_common(rows: DataFrame, least: dict[str, int], counted: str | None = None, block: int = 16_384) -> DataFrame:
    """``title, neighbor`` of every title and every other one with a position that have at least ``least`` terms of some feature in common, each pair once.

    ``rows`` are postings (``has_coords`` marks titles with a position); features that ``least`` doesn't name do not count, rows without title or term neither, repeated ones once.
    ``counted`` names a feature: then ``n`` is the number of its common terms.

    Most titles share some frequent term, so pairs are never shuffled: titles are, with all their terms, in blocks by a hash. Every block of titles meets every block of
    titles with a position in one task, which works out all that a pair has in common and gives it away at once. A title's row is sent once for each block of the other side.
    """
    if min(least.values()) < 1:
        raise ValueError("thresholds must be positive")
    spark = rows.sparkSession
    own = rows.where(F.col("feature").isin(list(least)) & F.col("title").isNotNull() & F.col("term").isNotNull()).select("feature", "term", "title", "has_coords")
    own, _ = cut(own, "postings")
    order, _ = cut(ordered_ids(own.select("feature", "term").distinct(), ["feature", "term"], "t"), "terms")
    held = own.join(order, ["feature", "term"]).groupBy("title").agg(F.max("has_coords").alias("known"), *[F.collect_set(F.when(F.col("feature") == f, F.col("t"))).alias(f"t{k}") for k, f in enumerate(least)])
    held, _ = cut(held, "titles")
    n, m = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("known"), 1))).first()
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    across = max(1, -(-m // block))
    down = max(1, -(-2 * n // block), min(-(-tasks // across), -(-n // 256)))
    terms = [f"t{k}" for k in range(len(least))]
    place = lambda k: F.pmod(F.xxhash64("title"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = held.where("known").withColumn("i", every(down)).select((F.col("i") * across + place(across)).cast("int").alias("g"), F.lit(0).alias("side"), "title", *terms)
    left = held.withColumn("j", every(across)).select((place(down) * across + F.col("j")).cast("int").alias("g"), F.lit(1).alias("side"), "title", *terms)
    ready = right.unionByName(left).repartitionById(down * across, F.col("g")).sortWithinPartitions("g", "side")
    if counted is None:
        met = ready.mapInArrow(_share(list(least.values()), None), "title string, neighbors array<string>")
        return met.select("title", F.explode("neighbors").alias("neighbor"))
    met = ready.mapInArrow(_share(list(least.values()), list(least).index(counted)), "title string, neighbors array<struct<neighbor: string, n: bigint>>")
    return met.select("title", F.inline("neighbors"))


def _share(least: list[int], counted: int | None):  # noqa: ANN202
    """Rows of a group come with the indexed titles first; then each title's common terms are counted over all of them at once."""

    def index(table):  # noqa: ANN001, ANN202
        """Indexed titles by term: a row of flags for frequent terms, a list for others."""
        import numpy as np

        m = table.num_rows
        names = table.column("title").combine_chunks()
        kinds = []
        for k in range(len(least)):
            lists = table.column(f"t{k}").combine_chunks()
            t, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            owner = np.repeat(np.arange(m, dtype=np.int32), np.diff(at))
            order = np.argsort(t, kind="stable")
            terms, first = np.unique(t[order], return_index=True)
            ends = np.append(first, len(t))
            owner = owner[order]
            row = np.full(len(terms), -1)
            many = np.flatnonzero(np.diff(ends) > max(32, m // 128))
            row[many] = np.arange(len(many))
            flags = np.zeros((len(many), m), np.uint8)
            for r, x in enumerate(many):
                flags[r, owner[ends[x] : ends[x + 1]]] = 1
            kinds.append((terms, ends, owner, row, flags))
        return names, {x: k for k, x in enumerate(names.to_pylist())}, kinds

    def common(kind, ts, m, need, exact):  # noqa: ANN001, ANN202
        """How many terms each indexed title has in common with ``ts``; only whether any, where that is enough."""
        import numpy as np

        terms, ends, owner, row, flags = kind
        at = np.searchsorted(terms, ts)
        at = at[at < len(terms)]
        at = at[np.isin(terms[at], ts)] if len(at) else at
        at = np.unique(at)
        r = row[at]
        rare, dense = at[r < 0], r[r >= 0]
        if need == 1 and not exact:
            out = np.bitwise_or.reduce(flags[dense], axis=0) if len(dense) else np.zeros(m, np.uint8)
        else:
            small = np.uint8 if len(at) < 256 else np.int32
            out = np.add.reduce(flags[dense], axis=0, dtype=small) if len(dense) else np.zeros(m, small)
        for x in rare:
            if need == 1 and not exact:
                out[owner[ends[x] : ends[x + 1]]] = 1
            else:
                out[owner[ends[x] : ends[x + 1]]] += 1  # a term has a title once
        return out

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        def answer(found):  # noqa: ANN001, ANN202
            titles, hits, counts, names = found
            at = pa.array(np.append(0, np.cumsum([len(h) for h in hits])).astype(np.int32))
            values = names.take(pa.array(np.concatenate(hits)))
            if counted is not None:
                values = pa.StructArray.from_arrays([values, pa.array(np.concatenate(counts).astype(np.int64))], names=["neighbor", "n"])
            return pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), pa.ListArray.from_arrays(at, values)], names=["title", "neighbors"])

        group, held, ready = None, [], None
        for batch in batches:
            g, side = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("g", "side"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                if hi == lo:
                    continue
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if g[lo] != group:
                    group, held, ready = g[lo], [], None
                if side[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # no indexed title in this block
                if ready is None:
                    ready = index(pa.concat_tables(held))
                names, where, kinds = ready
                m = len(names)
                lists = [part.column(f"t{k}").combine_chunks() for k in range(len(least))]
                flat = [(x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in lists]
                titles, hits, counts, size = [], [], [], 0
                for q, title in enumerate(part.column("title").to_pylist()):
                    ok, n = None, None
                    for k, (t, at) in enumerate(flat):
                        c = common(kinds[k], t[at[q] - at[0] : at[q + 1] - at[0]], m, least[k], k == counted)
                        n = c if k == counted else n
                        ok = c >= least[k] if ok is None else ok | (c >= least[k])
                    if title in where:
                        ok[where[title]] = False
                    hit = np.flatnonzero(ok)
                    if not len(hit):
                        continue
                    titles.append(title)
                    hits.append(hit)
                    if counted is not None:
                        counts.append(n[hit])
                    size += len(hit)
                    if size > 500_000:
                        yield answer((titles, hits, counts, names))
                        titles, hits, counts, size = [], [], [], 0
                if titles:
                    yield answer((titles, hits, counts, names))

    return run


def blocked_pairs(
    rows: DataFrame, use: dict[str, float], least: float, enough: dict[str, int], drop_uncategorised_pairs: bool = True, block: int = 512, most_neighbors: int | None = None,
) -> DataFrame:
    """``a, b, score`` of all pairs of a query ``a`` and an indexed ``b`` with a blended similarity of at least ``least``.

    ``rows``: feature, term, id, score, indexed, extra. Word and location vectors have length 1; a category scores 1, and the similarity of two titles' categories is Jaccard's.
    A pair counts only if it has ``enough`` terms of some feature in common. ``extra`` rows are common terms of a query, but no part of its vector.

    Terms are ordered from rare to frequent. Of all terms of a pair, let x be the rarest common one: all common ones are among those from x on, in either's order. So
    with the lengths of what each vector has from x on, by feature, the sum of their products bounds the similarity (for categories by the cosine of sets, which is no less
    than Jaccard's). Each term's rows are kept only if they reach ``least`` with the longest such rests among its other rows: of a term that a third of
    all titles have, being last in order, hardly any remain. What remains of a term is paired in blocks of ``block`` rows by matrix products of the rests, which
    give the whole similarity at x (and less at later common terms, so the greatest counts). Nothing is lost and no length is capped.

    ``most_neighbors`` says that only so many best pairs of each query are asked for. Then a block gives only pairs that as many others of the query in the block do not exceed by
    more than 1e-8: what a pair has in a block is never more than its similarity, and is all of it in one block, so the others rank before it in the end, too.
    """
    code = F.when(F.col("feature") == FEATURES[0], 0).when(F.col("feature") == FEATURES[1], 1).otherwise(2)
    df = rows.groupBy("feature", "term").agg(F.count(F.lit(1)).alias("df"))
    order, _ = cut(ordered_ids(df, ["df", "feature", "term"], "t").select("feature", "term", "t"), "terms")
    held = rows.where(F.col("feature") == FEATURES[2]).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    p = rows.join(order, ["feature", "term"]).join(held, "id", "left").select("id", "t", code.alias("f"), F.coalesce("k", F.lit(0)).cast("double").alias("k"), "score", "indexed", "extra")
    weight = F.when(F.col("f") == 2, 1 / F.sqrt("k")).otherwise(F.col("score"))
    rest = Window.partitionBy("id").orderBy(F.desc("t"))
    length = lambda f: F.sqrt(F.sum(F.when(F.col("f") == f, weight * weight).otherwise(0.0)).over(rest))
    p = p.select("id", "t", "k", "indexed", "extra", *[length(f).alias(f"s{f}") for f in range(3)], F.collect_list(F.struct("t", "f", F.col("score").alias("w"), "extra")).over(rest).alias("rest"))
    p, _ = cut(p, "rests")
    is_b = F.col("indexed") & ~F.col("extra")
    most = p.groupBy("t").agg(
        *[F.max(f"s{f}").alias(f"a{f}") for f in range(3)], *[F.max(F.when(is_b, F.col(f"s{f}"))).alias(f"b{f}") for f in range(3)],
        F.ceil(F.count(F.lit(1)) / block).alias("na"), F.ceil(F.count(F.when(is_b, 1)) / block).alias("nb"),
    ).where("nb > 0")
    bound = lambda other: sum((use[name] * F.col(f"s{f}") * F.col(f"{other}{f}") for f, name in enumerate(FEATURES)), F.lit(0.0)) >= least - 1e-7
    met = p.join(most, "t").withColumn("own_a", F.pmod(F.xxhash64("id"), "na")).withColumn("own_b", F.pmod(F.xxhash64("id"), "nb"))
    sides = F.array(
        F.when(bound("b"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.col("own_a").alias("i"), j.alias("j")))),
        F.when(bound("a") & is_b, F.transform(F.sequence(F.lit(0).cast("long"), F.col("na") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.col("own_b").alias("j")))),
    )
    spread = met.select("t", "id", "k", "rest", F.explode(F.flatten(F.array_compact(sides))).alias("g")).select("t", "g.i", "g.j", "g.side", "id", "k", "rest")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ready = spread.repartition(parts, "t", "i", "j").sortWithinPartitions("t", "i", "j")
    found = ready.mapInArrow(_multiply([use[f] for f in FEATURES], least, [enough[f] for f in FEATURES], drop_uncategorised_pairs, most_neighbors), "a long, b long, score double")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def _multiply(use: list[float], least: float, enough: list[int], drop_uncategorised: bool, most: int | None = None):  # noqa: ANN202
    """Blocks of rests arrive in order; each is multiplied when the next begins."""

    def products(side, ids, k, at, t, f, w, extra):  # noqa: ANN001, ANN202
        import numpy as np

        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return None
        owner = np.repeat(np.arange(len(side)), np.diff(at))
        row = np.empty(len(side), np.int64)
        row[a], row[b] = np.arange(len(a)), np.arange(len(b))
        of_a = side[owner] == 0
        of_b = ~of_a & ~extra
        common = np.intersect1d(t[of_a], t[of_b])
        dots = np.zeros((len(a), len(b)))
        n = [np.zeros((len(a), len(b))) for _ in range(3)]
        col = np.minimum(np.searchsorted(common, t), len(common) - 1)
        hit = common[col] == t
        for lo in range(0, len(common), 2048):
            inside = hit & (col >= lo) & (col < lo + 2048)
            width = min(2048, len(common) - lo)
            for kind in range(3):
                x, y = inside & of_a & (f == kind), inside & of_b & (f == kind)
                if not x.any() or not y.any():
                    continue
                used = np.unique(col[x]) - lo
                place = np.zeros(width, np.int64)
                place[used] = np.arange(len(used))
                y &= np.isin(col - lo, used)
                left, right = np.zeros((len(a), len(used))), np.zeros((len(used), len(b)))
                left[row[owner[x]], place[col[x] - lo]] = 1.0
                right[place[col[y] - lo], row[owner[y]]] = 1.0
                n[kind] += left @ right
                if kind < 2 and use[kind]:
                    left[row[owner[x]], place[col[x] - lo]] = w[x]
                    right[place[col[y] - lo], row[owner[y]]] = w[y]
                    dots += use[kind] * (left @ right)
        union = k[a][:, None] + k[b][None, :] - n[2]
        known = union > 0
        score = dots + use[2] * np.divide(n[2], union, out=np.zeros_like(union), where=known)
        ok = (score >= least - 1e-7) & (ids[a][:, None] != ids[b][None, :])
        if drop_uncategorised:
            ok &= known
        ok &= (n[0] >= enough[0]) | (n[1] >= enough[1]) | (n[2] >= enough[2])
        if most and len(b) > most:
            last = np.partition(np.where(ok, score, -np.inf), len(b) - most, axis=1)[:, len(b) - most]
            ok &= score >= last[:, None] - 1e-8
        i, j = np.nonzero(ok)
        return ids[a][i], ids[b][j], score[i, j]

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        held: list[pa.Table] = []

        def work(table: pa.Table):  # noqa: ANN202
            """Products of all whole groups of a table."""
            c = {n: table.column(n).combine_chunks() for n in table.column_names}
            num = {n: c[n].to_numpy(zero_copy_only=False) for n in ("t", "i", "j", "side", "id", "k")}
            lists = c["rest"]
            at = lists.offsets.to_numpy()
            flat = lists.values
            ft, ff, fw, fe = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("t", "f", "w", "extra"))
            new = np.ones(len(num["t"]), bool)
            new[1:] = (num["t"][1:] != num["t"][:-1]) | (num["i"][1:] != num["i"][:-1]) | (num["j"][1:] != num["j"][:-1])
            heads = np.append(np.flatnonzero(new), len(new))
            out = []
            for lo, hi in zip(heads[:-1], heads[1:]):
                if hi - lo > 1:
                    x, y = at[lo], at[hi]
                    got = products(num["side"][lo:hi], num["id"][lo:hi], num["k"][lo:hi], at[lo : hi + 1] - x, ft[x:y], ff[x:y], fw[x:y], fe[x:y])
                    if got is not None and len(got[0]):
                        out.append(got)
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "score"])

        def key(table: pa.Table, k: int) -> tuple:
            return tuple(table.column(n)[k].as_py() for n in ("t", "i", "j"))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held and key(table, 0) == key(table, table.num_rows - 1) == key(held[-1], held[-1].num_rows - 1):
                held.append(table)
                continue
            # the last group may go on in the next batch
            last, first = key(table, table.num_rows - 1), table.num_rows - 1
            t, i, j = (table.column(n).to_numpy() for n in ("t", "i", "j"))
            first = int(np.argmax((t == last[0]) & (i == last[1]) & (j == last[2])))
            if first or held:
                yield work(pa.concat_tables([*held, table.slice(0, first)]))
            held = [table.slice(first)]
        if held:
            yield work(pa.concat_tables(held))

    return run


def nearest_neighbors(
    words: DataFrame, locations: DataFrame, all_locations: DataFrame, categories: DataFrame, located: DataFrame,
    weights: Weights = Weights(), settings: Settings = DEFAULTS, drop_uncategorised_pairs: bool = True,
) -> DataFrame:
    """``title, neighbor, score, rank``: up to ``most_neighbors`` located titles most similar to each title.

    Similarity is the weighted sum of the cosines of word and location vectors and the Jaccard similarity of categories. A pair is
    compared if it shares two words, a location or a category; a feature of weight 0 makes no candidates. Query titles' locations count for candidates
    beyond the vector's cut (``all_locations``). Pairs in which neither has a category have no Jaccard similarity and are dropped,
    unless told otherwise (then it is 0). Scores below ``least_similarity``, as single-precision numbers, do not count; ties go to the smaller neighbour.
    Only pairs that can reach that similarity are formed (:func:`blocked_pairs`).
    """
    use = {"words": weights.words, "locations": weights.locations, "categories": weights.categories}
    enough = {"words": settings.least_common_words, "locations": settings.least_common_locations, "categories": settings.least_common_categories}
    if min(enough.values()) < 1:
        raise ValueError("thresholds must be positive")
    enough = {f: k if use[f] > 0 else 1 << 30 for f, k in enough.items()}
    rows = postings(words, locations, categories, located).select("feature", "term", "title", "score", F.col("has_coords").alias("indexed"), F.lit(False).alias("extra"))
    # the categories of a title count for its Jaccard similarities even if they make no candidates
    rows = rows.where(F.col("feature").isin([f for f, w in use.items() if w > 0 or (f == "categories" and drop_uncategorised_pairs)]))
    if weights.locations > 0:
        beyond = all_locations.select("title", F.col("location").alias("term")).distinct().join(rows.where("feature = 'locations'").select("title", "term"), ["title", "term"], "left_anti")
        rows = rows.unionByName(beyond.select(F.lit("locations").alias("feature"), "term", "title", F.lit(0.0).alias("score"), F.lit(False).alias("indexed"), F.lit(True).alias("extra")))
    rows, _ = cut(rows, "postings")
    ids, (rows,) = _numbered(rows)
    pair = blocked_pairs(rows, use, settings.least_similarity, enough, drop_uncategorised_pairs, most_neighbors=settings.most_neighbors)
    scored = pair.where(F.col("score").cast("float").cast("double") >= settings.least_similarity)
    best = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.most_neighbors)
    return _named(ranked, ids).select("title", "neighbor", "score", "rank")


def similar_titles(rows: DataFrame, feature: str, least: float) -> DataFrame:
    """``title, neighbor, score``: pairs of a title and one with a position (``has_coords``) whose vectors of one feature have a cosine of at least ``least`` (to 1e-7).

    ``rows`` are postings; vectors have length 1.
    """
    use = {f: float(f == feature) for f in FEATURES}
    own = rows.where(F.col("feature") == feature).select("feature", "term", "title", "score", F.col("has_coords").alias("indexed"), F.lit(False).alias("extra"))
    own, _ = cut(own, "postings")
    ids, (own,) = _numbered(own)
    return _named(blocked_pairs(own, use, least, dict.fromkeys(FEATURES, 1), False), ids).select("title", "neighbor", "score")


def verified(neighbors: DataFrame, titles: DataFrame) -> DataFrame:
    """Without neighbours that are no known title, and without titles beside themselves."""
    known = titles.select(F.col("title").alias("neighbor")).distinct()
    return neighbors.where("title <> neighbor").join(known, "neighbor", "left_semi")


def ordered_ids(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` (distinct) with numbers that ascend in the order of the columns ``by``, with gaps; nothing is ordered in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """``column, id``: ids from 0 in the order of the distinct values, without ordering them in one task.

    Values are range-partitioned and numbered in their partition; partition sizes give the offsets.
    """
    spark = values.sparkSession
    once = values.select(column).where(F.col(column).isNotNull()).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = once.repartitionByRange(parts, column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    inside = ranged.withColumn("k", F.col("m") - F.shiftleft(F.col("p").cast("long"), 33))
    sizes = inside.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    return inside.join(F.broadcast(offsets), "p").select(column, (F.col("k") + F.col("offset")).cast("long").alias("id"))
