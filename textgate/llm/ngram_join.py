r"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct 5-word shingles (see shingles.py). Documents of equal sets are one class, known by a
64-bit key and the set's size n. Classes link when 100 * shared >= 75 * union, so each must share at least
ceil(0.75 * n) of its tokens, and two of them at least 3/7 of the sum of their sizes.

1. Counts. Each task sends the tokens of its classes, packed and grouped by the token's leading bits, to the part of that
   range; a part finds the tokens of two classes or more and their exact count of classes (`shared_tokens`). Tokens whose
   cell of a fixed sketch is far above the mean of all cells are frequent for certain: they skip the exchange, so no part
   has to hold the occurrences of a frequent token, and count as shared.
2. Sets. Only shared tokens go back to their class (`sets_of`). A class with fewer than ceil(0.75 * n) of them has no link. Two
   sets overlap in shared tokens alone, so these lists are all that is compared later; texts move nowhere.
3. Orders. Order 0: tokens of one class, then by exact count, frequent ones last, ties by hash. Orders 1 and 2 are hash
   orders. Under *any* total order the prefixes (the first own + shared - ceil(0.75 * n) + 1 tokens) of two linked sets
   share a token. Order 0's prefixes are the index (`members_of`). A candidate must share a token at places that leave
   enough tokens behind in both sets, and then, before any set moves, a token of the prefixes under orders 1 and 2.
   What passes all filters is verified by intersecting the lists.
4. Components are found without expanding large groups to pairs. In each round every bucket of a token (frequent tokens:
   every chunk of it) compares its members with one pivot, first the one with the least share of own tokens, which is the
   text that others were copied from; links are contracted. Only buckets with several components stay open. When
   comparing the places of what is left in them is in proportion to the index (or after ROUNDS), all pairs of different
   components in the open buckets are compared, members outside the bucket's largest component against all: that makes
   the result exact.

`links` leaves the rounds out and returns every link between classes. Intermediate tables cut the lineage.

Nulls and empty texts have no shingles and link with nothing; their component is their own doc_id. Rows of null doc_id
take part but never name a component, unless no other row does (then it is null). Repeated rows are one class. An empty
table gives no rows. Very long texts are taken whole: a set is held by one task at a time. Only doc_id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgate.llm import shingles
from textgate.llm.common import give_back, scratch, small_batches, stored, table

SKETCH_BITS = 22
BLOCKS = 64
FAN_IN = 64
COUNTED_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 21
PART_TOKENS = 1 << 22
LEAST_PARTS = 64
TOKEN_BITS = 48
FREQUENT = 1 << 20  # levels of frequent tokens begin here, behind all exact counts
CHUNK_ROWS = 512
MAX_CHUNKS = 4095
ROUNDS = 6
MOST_WORK = 512  # comparisons of places for each row of the index
MAX_BROADCAST = 100_000
MAX_KNOWN = 200_000
_U = np.uint64


def least_shared(n: Column) -> Column:
    """ceil(0.75 * n): the tokens that a set must share with any set it links with."""
    return F.floor((3 * n + 3) / 4).cast("int")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _key(tokens: np.ndarray) -> int:
    """64-bit key of a sorted set."""
    with np.errstate(over="ignore"):
        return int(shingles.mix(np.array([shingles.mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(tokens))]))[0].astype(np.int64))


def _bounded(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum to little more than most."""
    sizes = list(sizes)
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i + 1 == len(sizes):
            yield start, i + 1
            start, total = i + 1, 0


def _text_parts(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    return _bounded((len(t or "") for t in texts), size)


def classed(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, h (text hash), k, n for each row, and rows of block, counts with the sketch of each task; stored."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, h long, k long, n long, block int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        id_arrow = None
        for b in batches:
            id_arrow = b.column(0).type
            texts, keys, ns = b.column(2).to_pylist(), [], []
            for start, end in _text_parts(texts):
                for tokens in shingles.sets(texts[start:end]):
                    keys.append(_key(tokens) if len(tokens) else None)
                    ns.append(len(tokens))
                    waiting.append(_cells(tokens))
                    size += len(tokens)
                if size >= COUNTED_TOKENS:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, size = [], 0
            none = pa.nulls(len(keys), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), none, pa.nulls(len(keys), pa.binary())],
                names=["doc_id", "h", "k", "n", "block", "counts"],
            )
        if id_arrow is None:
            return
        if size:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        blocks = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in counts.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(BLOCKS, id_arrow),
                *(pa.nulls(BLOCKS, pa.int64()) for _ in range(3)),
                pa.array(range(BLOCKS), pa.int32()),
                pa.array(blocks, pa.binary()),
            ],
            names=["doc_id", "h", "k", "n", "block", "counts"],
        )
        give_back()

    return stored(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema), "shingle-classes")


def _summed(rows: pd.DataFrame) -> np.ndarray:
    return reduce(np.add, (np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in rows["counts"]))


def sketch(rows: DataFrame) -> np.ndarray:
    """The bit length of each counter's sum over all tasks (uint8), summed by a tree of bounded fan-in."""
    parts = rows.filter(F.col("block").isNotNull()).select("block", "counts")
    each = parts.count() / BLOCKS

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(_summed(group), 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    def levels(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.frexp(_summed(group).astype(np.float64))[1].astype(np.uint8)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "levels": [bits.tobytes()]})

    while each > FAN_IN:
        each /= FAN_IN
        deal = F.pmod(F.xxhash64("counts"), F.lit(max(1, int(each)))).alias("deal")
        parts = stored(parts.groupBy("block", deal).applyInPandas(add, "block int, counts binary"), "shingle-sketch")
    found = parts.groupBy("block").applyInPandas(levels, "block int, levels binary").collect()  # 2^22 bytes in all
    out = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.uint8)
    for r in found:
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _planes(tokens: np.ndarray) -> bytes:
    """The bytes of sorted tokens, place by place, which compresses the leading ones."""
    return tokens.view(np.uint8).reshape(-1, 8).T[: TOKEN_BITS // 8].tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(TOKEN_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : TOKEN_BITS // 8] = planes.T
    return out.view(_U).ravel()


PACKED = "part int, tokens binary, levels binary, owners binary, ks binary, ns binary"


def packed_tokens(docs: DataFrame, levels: np.ndarray, part_bits: int, frequent_from: int) -> DataFrame:
    """docs (text) -> PACKED: a row holds the tokens of one part (their trailing TOKEN_BITS bits, without levels), or
    frequent tokens (whole, with levels), and for each the place of its class in ks and ns."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)  # 4 MB
    shift = _U(max(0, 64 - part_bits - TOKEN_BITS))
    inside = _U((1 << (64 - part_bits)) - 1)

    def row(part: int, tokens: bytes, of_levels: bytes, owners: np.ndarray, ks: np.ndarray, ns: np.ndarray) -> tuple:
        present, at = np.unique(owners, return_inverse=True)
        return part, tokens, of_levels, at.astype(np.uint16).tobytes(), ks[present].tobytes(), ns[present].tobytes()

    def packed(group: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ks, ns = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int32)
        tokens = np.concatenate([g[2] for g in group])
        owners = np.repeat(np.arange(len(group), dtype=np.uint16), [len(g[2]) for g in group])
        level = shipped.value[_cells(tokens)]
        tokens = tokens >> shift << shift
        often = level >= frequent_from
        rows = []
        some, of, lv = tokens[often], owners[often], level[often]
        for k, start in enumerate(range(0, len(some), 1 << 15)):
            piece = slice(start, start + (1 << 15))
            part = (int(ks[0]) + k) & ((1 << part_bits) - 1)
            rows.append(row(part, some[piece].tobytes(), lv[piece].tobytes(), of[piece], ks, ns))
        some, of = tokens[~often], owners[~often]
        order = np.argsort(some, kind="stable")
        some, of = some[order], of[order]
        of_part = (some >> _U(64 - part_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of_part, prepend=-1))
        for start, end in zip(cuts, [*cuts[1:], len(some)], strict=True):
            rows.append(row(int(of_part[start]), _planes((some[start:end] & inside) >> shift), b"", of[start:end], ks, ns))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "tokens", "levels", "owners", "ks", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for start, end in _text_parts(texts, 1 << 21):
                for tokens in shingles.sets(texts[start:end]):
                    n = len(tokens)
                    if not n or (k := _key(tokens)) in known:
                        continue
                    if len(known) >= MAX_KNOWN:
                        known.clear()
                    known.add(k)
                    group.append((k, n, tokens))
                    size += n
                    if size >= GROUP_TOKENS or len(group) == 1 << 16:
                        yield packed(group)
                        group, size = [], 0
        if group:
            yield packed(group)
        group = []
        give_back()

    return docs.select("text").mapInArrow(run, PACKED)


def shared_tokens(packed: DataFrame, part_bits: int) -> DataFrame:
    """PACKED -> k, n, token, level: tokens of two classes or more. level: their exact count, or FREQUENT + the sketch's."""
    shift = max(0, 64 - part_bits - TOKEN_BITS)

    def shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], [], []]
        tokens, ks, ns = [], [], []
        for r in rows.itertuples(index=False):
            of = np.frombuffer(r.owners, np.uint16)
            k, n = np.frombuffer(r.ks, np.int64)[of], np.frombuffer(r.ns, np.int32)[of]
            if r.levels:
                for o, x in zip(out, (k, n, np.frombuffer(r.tokens, np.int64), FREQUENT + np.frombuffer(r.levels, np.uint8).astype(np.int32)), strict=True):
                    o.append(x)
            else:
                tokens.append(_from_planes(r.tokens))
                ks.append(k)
                ns.append(n)
        if tokens:
            t, k, n = np.concatenate(tokens), np.concatenate(ks), np.concatenate(ns)
            order = np.argsort(t, kind="stable")
            t, k, n = t[order], k[order], n[order]
            same = t[1:] == t[:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            t, k, n = t[twice], k[twice], n[twice]
            order = np.lexsort((k, t))
            t, k, n = t[order], k[order], n[order]
            # Copies of a class that several tasks have sent count once.
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k, n = t[first], k[first], n[first]
            _, at, count = np.unique(t, return_inverse=True, return_counts=True)
            kept = count[at] > 1
            whole = (t[kept] << _U(shift) | _U(int(key[0]) << (64 - part_bits))).view(np.int64)
            for o, x in zip(out, (k[kept], n[kept], whole, np.minimum(count[at][kept], FREQUENT - 1).astype(np.int32)), strict=True):
                o.append(x)
        found = pd.DataFrame({c: np.concatenate(o) if o else np.zeros(0, np.int64) for c, o in zip(("k", "n", "token", "level"), out, strict=True)})
        out = tokens = ks = ns = t = k = n = order = None
        give_back()
        return found

    return packed.groupBy("part").applyInPandas(shared, "k long, n int, token long, level int")


def _first_in_order(tokens: str, q: Column, order: int) -> Column:
    """The first q tokens under a hash order, as sorted 32-bit hashes: equal ones only make the filter less strict."""
    return F.slice(F.sort_array(F.transform(tokens, lambda t: F.hash(t, F.lit(order)))), F.lit(1), q)


def sets_of(postings: DataFrame) -> DataFrame:
    """k, n, own (tokens of no other class), tokens (shared ones under order 0, with levels), prefix_1 and prefix_2, of the
    classes that can have links; stored."""
    each = postings.groupBy("k", "n").agg(F.sort_array(F.collect_set(F.struct("level", "token"))).alias("ranked"))
    each = each.filter(F.size("ranked") >= least_shared(F.col("n")))
    q = F.size("ranked") - least_shared(F.col("n")) + 1
    named = each.select("k", "n", (F.col("n") - F.size("ranked")).alias("own"), q.alias("q"), F.transform("ranked", lambda r: r["token"]).alias("tokens"), F.slice("ranked", F.lit(1), q).alias("prefix_0"))
    return stored(named.withColumns({f"prefix_{o}": _first_in_order("tokens", F.col("q"), o) for o in (1, 2)}).drop("q"), "shingle-sets")


def members_of(sets: DataFrame, buckets: Column | None = None) -> DataFrame:
    """The index: token, chunk, k, n, own, place under order 0, for buckets of two classes or more (or in one of several
    chunks); stored. buckets: several keys in place of a token, of token and n, as an array<long>."""
    rows = sets.select("k", "n", "own", F.posexplode("prefix_0").alias("at", "p"))
    if buckets is not None:
        rows = rows.withColumn("token", F.col("p.token")).select("k", "n", "own", "at", F.explode(buckets).alias("bucket"), "p")
        rows = rows.withColumn("p", F.struct(F.col("p.level").alias("level"), F.col("bucket").alias("token"))).drop("bucket")
    about = F.when(F.col("p.level") < FREQUENT, F.col("p.level").cast("double")).otherwise(F.pow(F.lit(2.0), F.col("p.level") - FREQUENT))
    many = F.when(about > 2 * CHUNK_ROWS, F.least(F.lit(MAX_CHUNKS), F.floor(about / CHUNK_ROWS).cast("int"))).otherwise(1)
    chunk = F.when(many > 1, 1 + F.pmod(F.xxhash64("k"), many)).otherwise(0).cast("int")
    rows = rows.select(F.col("p.token").alias("token"), chunk.alias("chunk"), "k", "n", "own", (F.col("own") + F.col("at")).alias("place"))
    among = Window.partitionBy("token", "chunk")
    rows = rows.withColumn("several", F.count("*").over(among) > 1)
    return stored(rows.filter("several or chunk > 0").drop("several"), "shingle-members")


def _can_link(na: str, place_a: str, nb: str, place_b: str) -> Column:
    """Two sets that share a token at these places can still share 3/7 of their sizes' sum, and have sizes near enough."""
    a, b = F.col(na).cast("long"), F.col(nb).cast("long")
    left = F.least(a - F.col(place_a), b - F.col(place_b))
    return (7 * left >= 3 * (a + b)) & (4 * F.least(a, b) >= 3 * F.greatest(a, b))


def _oriented(rows: DataFrame) -> DataFrame:
    """a, ca, b, cb -> distinct pairs with a < b."""
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return rows.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("ca", "cb").alias("ca"), pick("cb", "ca").alias("cb")).distinct()


def pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """rows (token, chunk, k, n, own, place, c) -> pairs of each member with its chunk's pivot, and of each chunk's pivot with
    the token's. A member of the pivot's component is left out."""
    by_hash = F.xxhash64("k", F.lit(turn))
    # At first the class of which least is its own: the text that the others were copied from. Then others in turn.
    rank = F.struct(F.col("own") / F.col("n"), by_hash) if turn == 0 else F.struct(by_hash)
    me = F.struct("k", "n", "place", "c")
    ranked = rows.withColumn("rank", rank)
    pivot = F.first(me).over(Window.partitionBy("token", "chunk").orderBy("rank"))
    inner = ranked.withColumn("p", pivot)
    heads = inner.filter("chunk > 0 and k = p.k").drop("p")
    outer = heads.withColumn("p", F.first(me).over(Window.partitionBy("token").orderBy("rank")))
    both = inner.select("k", "n", "place", "c", "p").unionByName(outer.select("k", "n", "place", "c", "p"))
    both = both.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("c").alias("ca"), *(F.col(f"p.{x}").alias(y) for x, y in (("k", "b"), ("n", "nb"), ("place", "pb"), ("c", "cb"))))
    return _oriented(both.filter((F.col("ca") != F.col("cb")) & _can_link("na", "pa", "nb", "pb")))


def rest_pairs(rows: DataFrame, top: DataFrame | None) -> DataFrame:
    """All pairs of different components in a bucket. top: token, top (its largest component), whose members are compared
    with members of others only; without top every class is its own component."""
    if top is None:
        rows = rows.withColumn("top", F.lit(None).cast("long"))
    else:
        rows = rows.join(top, "token")
    inside = F.coalesce(F.col("c") == F.col("top"), F.lit(False))
    rows = rows.select("token", "k", "n", "place", "c", inside.alias("in_top"))
    x = rows.filter("not in_top").select("token", *(F.col(s).alias(t) for s, t in (("k", "a"), ("n", "na"), ("place", "pa"), ("c", "ca"))))
    y = rows.select("token", "in_top", *(F.col(s).alias(t) for s, t in (("k", "b"), ("n", "nb"), ("place", "pb"), ("c", "cb"))))
    other = F.col("in_top") | (F.col("ca") < F.col("cb"))
    return _oriented(x.join(y, "token").filter(other & _can_link("na", "pa", "nb", "pb")))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ca, cb) that link: prefixes share a token under orders 1 and 2, then the sets are compared."""
    pairs = stored(pairs, "shingle-pairs")
    needed = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    small = needed.count() <= MAX_BROADCAST
    sets = sets.join(F.broadcast(needed) if small else needed, "k", "left_semi")
    side = lambda x, *names: sets.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))
    share = F.lit(True)
    for o in (1, 2):
        share = share & F.arrays_overlap(f"prefix_{o}_a", f"prefix_{o}_b")
    passed = pairs.join(side("a", "prefix_1", "prefix_2"), "a").join(side("b", "prefix_1", "prefix_2"), "b").filter(share)
    passed = stored(passed.select("a", "b", "ca", "cb"), "shingle-candidates")
    whole = passed.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    return stored(whole.filter(100 * overlap >= 75 * (F.col("n_a") + F.col("n_b") - overlap)).select("a", "b", "ca", "cb"), "shingle-links")


def components(links: DataFrame, name: str) -> DataFrame | None:
    """links (a, b) -> k, c, stored: in each round every class points to its least neighbour, and the links are contracted.
    None without links."""
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("k"), "p"), f"{name}-step")
        if labels is None:
            labels = stored(step.withColumnRenamed("p", "c"), f"{name}-labels")
        else:
            moved = labels.join(step.withColumnRenamed("k", "c"), "c", "left")
            labels = stored(moved.select("k", F.coalesce("p", "c").alias("c")), f"{name}-labels")
        pa_, pb = (step.select(F.col("k").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        ends = links.join(pa_, "a").join(pb, "b").filter("pa != pb")
        links = stored(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-links")
    return labels


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, h, k, n) of document rows, and the sets."""
    found = classed(docs)
    levels = sketch(found)
    rows = found.filter(F.col("block").isNull()).select("doc_id", "h", "k", "n")
    total = rows.agg(F.sum("n")).first()[0] or 0
    part_bits = (max(LEAST_PARTS, -(-total // PART_TOKENS)) - 1).bit_length()
    frequent_from = int(2 * total / (1 << SKETCH_BITS) + 2 * CHUNK_ROWS).bit_length() + 1
    with small_batches(docs.sparkSession):
        return rows, sets_of(shared_tokens(packed_tokens(docs, levels, part_bits, frequent_from), part_bits))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between classes (a, b), and the membership (doc_id, h, k, n) of document rows."""
    rows, sets = _prepared(docs)
    return verified(sets, rest_pairs(members_of(sets).withColumn("c", F.col("k")), None)).select("a", "b"), rows


def contracted(sets: DataFrame, members: DataFrame) -> DataFrame:
    """sets and their index -> k, c: the component of each class that has links."""
    with scratch(sets.sparkSession) as keep:
        labels = _contracted(sets, members)
        return sets.select("k", F.col("k").alias("c")).limit(0) if labels is None else keep(labels)


def _contracted(sets: DataFrame, members: DataFrame) -> DataFrame | None:
    labels = None
    for turn in range(ROUNDS + 1):
        rows = members.withColumn("c", F.col("k"))
        if labels is not None:
            rows = members.join(labels, "k", "left").withColumn("c", F.coalesce("c", "k"))
        rows = stored(rows, "shingle-labelled")
        sizes = rows.groupBy("token", "c").agg(F.count("*").alias("m"))
        tops = sizes.groupBy("token").agg(F.max_by("c", "m").alias("top"), F.max("m").alias("most"), F.sum("m").alias("m"))
        still_open = stored(tops.filter("most < m"), "shingle-open")
        n, left, work = still_open.agg(F.count("*"), F.sum("m"), F.sum((F.col("m") - F.col("most")) * F.col("m"))).first()
        if not n:
            break
        some = still_open.select("token", "top")
        some = F.broadcast(some) if n <= MAX_BROADCAST else some
        last = turn == ROUNDS or (turn > 0 and work <= MOST_WORK * left)
        pairs = rest_pairs(rows, some) if last else pivot_pairs(rows.join(some, "token").drop("top"), turn)
        found = verified(sets, pairs)
        step = components(found.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "shingle-components")
        if step is None:
            pass
        elif labels is None:
            labels = step
        else:
            moved = labels.withColumnRenamed("c", "was").join(step.withColumnRenamed("k", "was"), "was", "left").select("k", F.coalesce("c", "was").alias("c"))
            new = step.join(labels.select(F.col("k")), "k", "left_anti")
            labels = stored(moved.unionByName(new.select("k", "c")), "shingle-labels")
        if last:
            break
        members = rows.join(some, "token", "left_semi").drop("c")
    return labels


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, k, n, ..) -> component_id besides: the smallest doc_id among all rows of the class's component."""
    classes = rows.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("least")).join(labels, "k", "left")
    classes = stored(classes.select("k", "least", "c"), "shingle-least")
    # Only components of several classes have a label; a row for each of them.
    of_all = stored(classes.filter("c is not null").groupBy("c").agg(F.min("least").alias("of_all")), "shingle-components")
    of_all = F.broadcast(of_all) if of_all.count() <= MAX_BROADCAST else of_all
    named = classes.join(of_all, "c", "left").select("k", F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("component_id"))
    return rows.join(named, "k", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h (xxhash64 of the text), n_shingles, component_id (smallest doc_id reachable)."""
    rows, sets = _prepared(docs)
    found = with_components(rows, contracted(sets, members_of(sets)))
    return found.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the first row (by doc_id, then text hash) of each component; all columns stay.

    Of rows that are equal in doc_id and text and differ elsewhere, the one of the least hash over all columns stays."""
    found = stored(near_duplicates(docs), "shingle-found")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    rank = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "h")
    least = found.filter("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(rank).alias("stays"))
    rows = found.filter("n_shingles > 0").groupBy("doc_id", "h", group.alias("g")).agg(F.count("*").alias("rows"))
    marked = rows.join(least, rows["g"].eqNullSafe(least["g"])).select("doc_id", "h", "rows", (rank == F.col("stays")).alias("is_first"))
    marked = stored(
        marked.filter(~F.coalesce("is_first", F.lit(False)) | (F.col("rows") > 1)).select(
            F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.coalesce("is_first", F.lit(False)).alias("_first")
        ),
        "shingle-dropped",
    )
    small = marked.count() <= MAX_BROADCAST
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    some = lambda t: F.broadcast(t) if small else t
    at = (F.col("_text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(some(marked.filter("_first")), at, "left_semi").groupBy("doc_id", "_text_hash").agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("_row"))
    return keyed.join(some(marked), at, "left_anti").drop("_text_hash").unionByName(once.select("_row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), both_in AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL
), link AS (
  SELECT a, b FROM both_in JOIN n AS na ON na.r = a JOIN n AS nb ON nb.r = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), reach AS (
  SELECT r AS a, r AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""
