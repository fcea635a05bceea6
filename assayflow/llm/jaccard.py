"""N-gram Jaccard join by a token-group matrix.

A document's tokens are the 64-bit hashes of its distinct word 5-grams. Documents with equal sets are
one class; classes link when their Jaccard similarity reaches the threshold. The join

1. puts tokens into one order, frequent ones last, and keeps of every class the prefix that any
   linked class must share a token with (frequencies only choose the order, never drop a token).
   Sizes and places in the prefix bound the overlap of two classes whose first shared token this is;
   a token's rows that no other class can meet under this bound go;
2. puts similar classes into groups: each class is compared with the one of another group that most
   often is the centre of its tokens, the class in which the token stands first, if the two share
   enough prefix tokens; verified links form groups. Rounds go on while three of four comparisons
   are links. Groups are dealt into blocks of bounded size;
3. stores the matrix of tokens and blocks (a block's tokens are the union of its members'), looks up
   the prefix of every class of another group in it, and for the blocks it meets under the bound of
   sizes and places bounds the possible overlap by that of the class with the block's union, of
   prefix tokens first, then of all; only blocks that reach the needed overlap are opened, and
   their members compared exactly;
4. joins groups along the links found to components.

No pair within a group is ever listed: members of a group are already connected. Texts are read in
full for the frequencies and for the prefixes; a third time only those that can meet another class.
What is broadcast is bounded: HEAVY frequent tokens, and ids of classes up to BROADCAST_IDS (beyond,
the join is a shuffle).

Defined cases: null or empty texts have no tokens and are alone; fewer than five words form one
token; very long texts are hashed in pieces, in one token list; null ids are kept and never chosen
as a component's least id while another id is there; repeated rows are in one class; empty table,
empty result; further columns are ignored. Classes are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, remove, ship, stored, work_dir
from .components import connected_components
from .shingles import token_sets

WORDS = 5
PERCENT = 80
HEAVY = 1 << 18
ROUNDS = 4
#: Members and tokens of a block, about.
BLOCK = 64
BLOCK_TOKENS = 1 << 20
BROADCAST_IDS = 1 << 19
#: Classes that a task remembers to have given out.
REMEMBERED = 1 << 20


def class_of(tokens: np.ndarray) -> tuple[int, int] | None:
    """The 128 bits that stand for a token set; none for the empty one."""
    if not len(tokens):
        return None
    value = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def needed(n, percent: int = PERCENT):
    """The least overlap that a set of n tokens needs with a linked one."""
    return (n * percent + 99) // 100


def prefix(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens in the common order (not heavy by hash, then heavy by rank), as many as a
    linked set can't all lack. heavy is sorted; rank[i] is heavy[i]'s place."""
    n = len(tokens)
    most = n - needed(n, percent) + 1
    if not len(heavy):
        return tokens[:most]
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    is_heavy = heavy[at] == tokens
    light = tokens[~is_heavy][:most]
    if len(light) == most:
        return light
    rest, place = tokens[is_heavy], rank[at[is_heavy]]
    return np.concatenate([light, rest[np.argsort(place)][: most - len(light)]])


def lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
    values = [a for a in arrays if a is not None and len(a)]
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)),
        mask=pa.array([a is None for a in arrays], pa.bool_()),
    )


class Seen:
    """Classes that a task met before, as far as REMEMBERED goes: copies then cost no more rows."""

    def __init__(self) -> None:
        self.known: set[tuple[int, int]] = set()

    def new(self, c: tuple[int, int] | None) -> bool:
        if c is None or c in self.known:
            return False
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known.add(c)
        return True


def heavy_tokens(docs: DataFrame, k: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent tokens, sorted, and their places by frequency. Counts are over all
    documents, less those of a token that a task's chunk holds once."""
    chunk = 2_000_000
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often])], ["t", "n"])

        size, seen = 0, Seen()
        for batch in batches:
            for tokens in token_sets(batch.column(0), k):
                if seen.new(class_of(tokens)):
                    held.append(tokens)
                    size += len(tokens)
                    if size >= chunk:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    t = counts.orderBy(F.desc("n"), "t").limit(most).select("t").toArrow().column(0).to_numpy()
    order = np.argsort(t)
    return t[order], (len(t) - 1 - np.arange(len(t)))[order]


def class_prefixes(docs: DataFrame, heavy: np.ndarray, rank: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, c and c2 (class; null: no tokens) of every row, and the prefix of each class, null on
    rows whose class the task has met before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((heavy, rank))
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_heavy, own_rank = shared.value
        seen = Seen()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, firsts, seconds, prefixes = [], [], [], []
                for s in token_sets(part.column(1), k):
                    c = class_of(s)
                    sizes.append(len(s))
                    firsts.append(c and c[0])
                    seconds.append(c and c[1])
                    prefixes.append(prefix(s, own_heavy, own_rank, percent) if seen.new(c) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), lists(prefixes)],
                    ["doc_id", "n", "c", "c2", "prefix"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, c bigint, c2 bigint, prefix array<bigint>")


def told_apart(rows: DataFrame, path: str) -> Callable[[DataFrame], DataFrame]:
    """Makes the first half of the class hash serve alone (frames with c and c2): where two classes share
    it, both halves are hashed into a new one. Such classes are hardly ever there, and then few."""
    both = rows.where("c is not null").groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi"))
    clash = stored(both.where("lo < hi").select(F.col("c").alias("shared_c")), f"{path}/clash")
    if clash.isEmpty():
        return lambda df: df

    def mend(df: DataFrame) -> DataFrame:
        cols = [F.when(F.col("shared_c").isNull(), F.col("c")).otherwise(F.xxhash64("c", "c2")).alias("c") if c == "c" else F.col(c) for c in df.columns]
        return df.join(clash, F.col("c") == F.col("shared_c"), "left").select(*cols)

    return mend


def class_tokens(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """c, c2, n, tokens of the classes of the documents with these ids (column id), read from the texts
    again. Rows that share an id are all read, so a class may come unasked for; a task gives it once."""
    spark = docs.sparkSession
    own = ids.select(F.col("id").alias("i")).distinct()
    if ids.count() <= BROADCAST_IDS:
        own = F.broadcast(own)
    some = docs.join(own, F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = [(class_of(s), s) for s in token_sets(batch.column(0).slice(start, 512), k)]
                found = [(c, s) for c, s in found if seen.new(c)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c[0] for c, _ in found], pa.int64()), pa.array([c[1] for c, _ in found], pa.int64()),
                        pa.array([len(s) for _, s in found], pa.int64()), lists([s for _, s in found]),
                    ],
                    ["c", "c2", "n", "tokens"],
                )

    return some.select("text").mapInArrow(run, "c bigint, c2 bigint, n bigint, tokens array<bigint>")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """t, c, n, p (place) of the prefix tokens that two classes or more have. One shuffle, by token: it
    serves the search for such tokens and the lookup. Size and place travel as one number."""
    place = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("p").cast("long")).alias("np")
    posts = rows.where("prefix is not null").select("c", "n", F.posexplode("prefix").alias("p", "t")).select("t", "c", place)
    posts = posts.repartition("t")
    # Both sides ask for all columns, so that they share one shuffle.
    twice = posts.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("np").alias("np"))
    twice = twice.where("lo < hi and np >= 0").select("t")
    both = posts.join(twice.hint("shuffle_hash"), "t", "left_semi").distinct()
    return both.select("t", "c", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("p"))


def room(n: Column, p: Column, percent: int) -> Column:
    """What bounds the sizes that a class of n tokens can link with if its first shared token stands at
    place p: at most n - p tokens are shared, and a link with n2 needs percent * (n + n2) / (100 + percent).
    So percent * n2 <= room, for both classes."""
    return 100 * n - (100 + percent) * p


def meet(n1: Column, room1: Column, n2: Column, room2: Column, percent: int) -> Column:
    return (room1 >= percent * n2) & (room2 >= percent * n1)


def able_to_meet(live: DataFrame, percent: int) -> DataFrame:
    """Rows t, c, n, p, s (size bucket), u (room) of live that some other class may meet: one of its own bucket
    or a neighbouring one. Buckets are a little wider than the ratio of sizes that can link. A bucket is
    known by its bounds alone, the row's own included, so some rows stay that meet none."""
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.001 / percent))).cast("int")
    rows = live.select("t", "c", "n", "p", bucket.alias("s"), room(F.col("n"), F.col("p"), percent).alias("u")).repartition("t")
    most = rows.groupBy("t", "s").agg(F.max("u").alias("u2"), F.min("n").alias("n2"), F.count("*").alias("k"))
    most = most.select(F.col("t").alias("t2"), F.col("s").alias("s2"), "u2", "n2", "k").hint("shuffle_hash")
    other = (F.col("t") == F.col("t2")) & (F.abs(F.col("s") - F.col("s2")) <= 1) & ((F.col("s") != F.col("s2")) | (F.col("k") > 1))
    return rows.join(most, other & meet(F.col("n"), F.col("u"), F.col("n2"), F.col("u2"), percent), "left_semi")


def shared_lists(live: DataFrame, able: DataFrame) -> DataFrame:
    """c, shared: of each class that can meet another one, all prefix tokens that any other class has too."""
    return live.join(able.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.collect_list("t").alias("shared"))


def least_shared(n1: Column, n2: Column, percent: int) -> Column:
    """Prefix tokens that linked sets of these sizes share at least. Up to the lesser of the two
    prefixes' ends in the common order, both prefixes hold every token. The set whose prefix ends there
    has need - 1 tokens beyond it, so the overlap is at most the shared prefix tokens and those."""
    overlap = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return F.greatest(F.lit(1), overlap - F.ceil(F.greatest(n1, n2) * percent / F.lit(100)) + 1)


def least_shared_between(n: Column, low: Column, high: Column, percent: int) -> Column:
    """The minimum of least_shared(n, x) for x from low to high. Up to n it rises with x. Above n it falls by
    percent**2 / (100 * (100 + percent)) a step, but the ceilings can lift it by less than 2, so a size
    just below high may need one token less; sizes farther below need no less than high does."""
    near = -(-100 * (100 + percent) // percent**2)
    sizes = [low, *[F.greatest(low, high - k) for k in range(near)]]
    return F.least(*[least_shared(n, x, percent) for x in sizes])


def similar(inter: Column, n1: Column, n2: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n1 + n2 - inter)


def bounded(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of a few numbers each, broadcast if their count allows it."""
    return F.broadcast(rows) if n_rows <= BROADCAST_IDS else rows


def verified(pairs: DataFrame, tokens: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """The pairs (a, b, ...) of classes that link. The token lists of a and b meet in one shuffle by b."""
    x = tokens.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = tokens.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = x.join(bounded(pairs, n_pairs), "a").join(y.join(bounded(pairs.select("b").distinct(), n_pairs), "b", "left_semi"), "b")
    found = both.where(similar(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"), percent))
    return found.select(*pairs.columns)


def fits(n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return (100 * F.least(n1, n2)) >= percent * F.greatest(n1, n2)


def star_pairs(rows: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """For each class a the centre b of another group that it meets most often (ga, gb: their groups).
    rows: t, c, n, p, s, u, g. A token's centre among classes of like size is the one in which it stands
    first: it has least that others lack. Equals are told apart by a hash that changes with the seed."""
    rows = rows.repartition("t", "s")
    first = F.struct("p", F.xxhash64("c", F.lit(seed)).alias("h"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("g").alias("gb"))
    centre = rows.groupBy(F.col("t").alias("t2"), F.col("s").alias("s2")).agg(F.min(first).alias("m"))
    pairs = rows.join(centre, (F.col("t") == F.col("t2")) & (F.col("s") == F.col("s2")))
    pairs = pairs.where((F.col("g") != F.col("m.gb")) & meet(F.col("n"), F.col("u"), F.col("m.nb"), F.col("m.ub"), percent))
    counted = pairs.groupBy(F.col("c").alias("a"), F.col("m.b").alias("b")).agg(
        F.count("*").alias("k"), F.first("g").alias("ga"), F.first("m.gb").alias("gb"), F.first("n").alias("na"), F.first("m.nb").alias("nb")
    )
    best = counted.groupBy("a").agg(F.max(F.struct("k", "b", "ga", "gb", "na", "nb")).alias("m"))
    return best.select("a", "m.b", "m.ga", "m.gb", "m.na", "m.nb")


def likely(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b, ga, gb, na, nb that share enough prefix tokens."""
    x = shared.select(F.col("c").alias("a"), F.col("shared").alias("ta"))
    y = shared.select(F.col("c").alias("b"), F.col("shared").alias("tb"))
    both = pairs.join(x, "a").join(y, "b").where(
        F.size(F.array_intersect("ta", "tb")) >= least_shared(F.col("na"), F.col("nb"), percent)
    )
    return both.select("a", "b", "ga", "gb")


def labels_of(links: DataFrame) -> DataFrame:
    """x, y: a group and the one it joins. Each group follows its most linked centre, and that one's own
    centre if that is less; what this leaves apart is joined later."""
    to = links.groupBy("ga", "gb").agg(F.count("*").alias("k")).groupBy("ga").agg(F.max(F.struct("k", "gb")).alias("m")).select("ga", "m.gb")
    then = to.select(F.col("ga").alias("via"), F.col("gb").alias("far"))
    both = to.join(then, F.col("gb") == F.col("via"), "left")
    return both.select(F.col("ga").alias("x"), F.least("gb", F.coalesce("far", "gb")).alias("y")).where("x != y")


def grouped_rows(rows: DataFrame, path: str) -> DataFrame:
    """Rows of the tokens that two groups or more have, with the group's members m and the class's block k
    in it."""
    across = rows.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("t")
    members = rows.select("c", "n", "g").distinct().groupBy(F.col("g").alias("g1")).agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    of = rows.join(across, "t", "left_semi").join(stored(members, f"{path}/members"), F.col("g") == F.col("g1"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("m") / BLOCK), F.least(F.col("m"), F.floor(F.col("all") / BLOCK_TOKENS)))
    return of.select("t", "c", "n", "u", "g", "m", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("k"))


def met_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class and a block of another group that may link by sizes and places: c, n, g2, k2, found
    through the token-group matrix of rows (grouped_rows)."""
    # The matrix: a row for each token and block that has it, with what bounds the block's members
    # with the token.
    matrix = rows.groupBy("t", "g", "k").agg(F.min("n").alias("n2"), F.max("u").alias("u2"), F.first("m").alias("m2"))
    matrix = matrix.withColumnsRenamed({"t": "t2", "g": "g2", "k": "k2"})
    asks = (F.col("m") < F.col("m2")) | ((F.col("m") == F.col("m2")) & (F.col("g") < F.col("g2")))
    on = (F.col("t") == F.col("t2")) & (F.col("g") != F.col("g2")) & asks
    return rows.join(matrix, on & meet(F.col("n"), F.col("u"), F.col("n2"), F.col("u2"), percent)).select("c", "n", "g2", "k2").distinct()


def open_blocks(
    rows: DataFrame, met: DataFrame, shared: DataFrame, tokens: DataFrame, path: str, percent: int
) -> DataFrame:
    """Links (a, b) between the classes and blocks that met. The overlap is bounded twice by a block's union:
    by that of the prefix tokens, then, where that is enough, of all tokens."""
    wanted = met.select(F.col("g2").alias("g"), F.col("k2").alias("k")).distinct()
    inside = stored(rows.join(wanted, ["g", "k"], "left_semi").select("c", "n", "g", "k").distinct(), f"{path}/inside")

    def unions(lists: DataFrame, column: str) -> DataFrame:
        both = lists.join(bounded(inside.select("c", "n", "g", "k"), inside.count()), "c")
        return both.groupBy(F.col("g").alias("g2"), F.col("k").alias("k2")).agg(
            F.array_distinct(F.flatten(F.collect_list(column))).alias("union"), F.count_distinct("c").alias("size"),
            F.min("c").alias("only"), F.min("n").alias("n1"), F.max("n").alias("n2"),
        )

    n = F.col("n")
    low, high = F.greatest(F.col("n1"), F.ceil(n * percent / F.lit(100))), F.least(F.col("n2"), F.floor(n * 100 / F.lit(percent)))
    first = shared.join(bounded(met, met.count()), "c").join(unions(shared, "shared"), ["g2", "k2"])
    first = first.where(F.size(F.array_intersect("shared", "union")) >= least_shared_between(n, low, high, percent))
    near = stored(first.select("c", "g2", "k2"), f"{path}/near")
    wanted = near.select(F.col("g2").alias("g"), F.col("k2").alias("k")).distinct()
    inside = stored(inside.join(wanted, ["g", "k"], "left_semi"), f"{path}/near_inside")
    own = tokens.select("c", "n", "tokens")
    bound = own.join(bounded(near, near.count()), "c").join(unions(own.drop("n"), "tokens"), ["g2", "k2"]).select(
        "c", "n", "g2", "k2", "size", "only", F.size("union").alias("nu"),
        F.size(F.array_intersect("tokens", "union")).cast("long").alias("i"),
    )
    bound = stored(bound.where(100 * F.col("i") >= percent * n), f"{path}/bound")
    # A block of one class is its own union, so the bound is the overlap itself.
    single = bound.where("size = 1").where(similar(F.col("i"), n, F.col("nu"), percent))
    opened = bound.where("size > 1").select(F.col("c").alias("a"), n.alias("na"), F.col("g2").alias("g"), F.col("k2").alias("k"))
    pairs = opened.join(inside.select(F.col("c").alias("b"), F.col("n").alias("nb"), "g", "k"), ["g", "k"])
    pairs = stored(pairs.where(fits(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), f"{path}/opened")
    return single.select(F.col("c").alias("a"), F.col("only").alias("b")).unionByName(verified(pairs, tokens, percent, pairs.count()))


def similarity_components(
    docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (least id among all documents reachable by links)."""
    spark: SparkSession = docs.sparkSession
    path = work_dir(spark)
    src = keyed(docs, doc_id=id_col, text=text_col)
    heavy, rank = heavy_tokens(src, k)
    rows = stored(class_prefixes(src, heavy, rank, k, percent), f"{path}/rows")
    mend = told_apart(rows, path)
    rows = mend(rows)
    live = stored(shared_prefixes(rows), f"{path}/live")
    able = stored(able_to_meet(live, percent), f"{path}/able")
    shared = stored(shared_lists(live, able), f"{path}/shared")
    remove(spark, f"{path}/live")
    firsts = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("id"))
    ids = stored(firsts.join(shared.select("c"), "c", "left_semi"), f"{path}/ids")
    tokens = stored(mend(class_tokens(src, ids, k)).drop("c2"), f"{path}/tokens")

    grouped = able.withColumn("g", F.col("c"))
    links = spark.createDataFrame([], "a bigint, b bigint")
    for r in range(ROUNDS):
        pairs = stored(likely(star_pairs(grouped, percent, r), shared, percent), f"{path}/pairs{r}")
        n_pairs = pairs.count()
        found = stored(verified(pairs, tokens, percent, n_pairs).distinct(), f"{path}/links{r}")
        links = links.unionByName(found.select("a", "b"))
        n_found = found.count()
        if n_found:
            label = stored(labels_of(found), f"{path}/labels{r}")
            grouped = grouped.join(label, F.col("g") == F.col("x"), "left").withColumn("g", F.coalesce("y", "g")).drop("x", "y")
            grouped = stored(grouped, f"{path}/grouped{r}")
        if 4 * n_found < 3 * n_pairs or not n_pairs:
            break
    matrix_rows = stored(grouped_rows(grouped, path), f"{path}/matrix")
    met = stored(met_blocks(matrix_rows, percent), f"{path}/met")
    more = stored(open_blocks(matrix_rows, met, shared, tokens, path, percent), f"{path}/links")
    comps = stored(connected_components(links.unionByName(more), f"{path}/cc"), f"{path}/comps")
    rooted = rows.select("doc_id", "n", "c").join(comps, F.col("c") == F.col("v"), "left")
    rooted = rooted.select("doc_id", "n", "c", F.coalesce("root", "c").alias("r"))
    result = work_dir(spark)
    rooted = stored(rooted, f"{result}/rooted")
    remove(spark, path)
    # Stored, so that the join's sides are plain shuffles, which Spark can split where a group is large.
    least = stored(rooted.where("r is not null").groupBy(F.col("r").alias("r2")).agg(F.min("doc_id").alias("least")), f"{result}/least")
    return rooted.join(least, F.col("r") == F.col("r2"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )
