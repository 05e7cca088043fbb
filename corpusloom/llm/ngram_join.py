"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct 3-word shingles, lower-cased in ASCII. Two sets with a Jaccard
similarity of t or more share s tokens (or all they need to) among the first |x| - ceil(t |x|) + s of
each, under any order of all tokens. Three orders are used. Each puts rare tokens first, by a count of
all documents' tokens in a table that follows the input's size (an overcount is harmless: any common
order is valid), and differs in the table or the hash that break ties. Candidates must meet under all
three, which is found on ids alone; only then do texts move. The steps:

1. Sketch: token counts of all documents, in two tables of 2**bits cells.
2. Sets: size, digest and first-order prefix of each document. Documents of equal sets form a class,
   named by its digest; only classes go on.
3. Candidates: prefixes are dealt out by token. Groups of up to `small` classes give all pairs of fitting
   length, kept if they meet s times. Larger groups give pairs with a pivot, the member that meets most
   others, and are remembered. Classes without either leave; the rest deal out their prefixes under the
   second and the third order too. A pair found under one order stays if under each other it was found
   as well or shares a token of a larger group.
4. Verification of these pairs on their whole texts; components of the links found.
5. Pairs that share tokens of larger groups alone, in every order, were met by pivots only. In groups
   that are not one component yet all pairs across components are settled, so no link between components
   is lost. Tokens are counted exactly among these groups' classes, a fourth order: pairs that share a
   rare token are found by it, and kept if these and the core, the tokens that more classes hold, may
   suffice for a link; how much core two classes can share is bounded part by part of 64. Pairs that
   share the core alone can link only if both are nearly all core: such classes are first linked to a
   pivot, and those outside a group's largest component, by then few, are held against the group.

Null texts and texts without words have empty sets and link with nothing; very long texts are taken
whole; ties of an order go by hash, so that one order holds everywhere. A row without an id links with nothing. Rows that repeat an id with equal texts are one class,
with different texts they are judged apart; each row is returned, with the smallest id that its own text
reaches. Only id and text are read, so other names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, cut, join_classes, partitions
from .components import components
from .sketch import Counts, cells, count_cells, member_test, split_by_keys
from .words import Words, by_places, from_places, mix, release, slices, sorted_unique

_PERCENT = 100
_PARTS = 6  # bits: what two classes can share of common tokens is bounded in 64 parts
_SALTS = 20  # bits of a vast group's places
_PIECE = 1 << 19  # bytes of text that a worker unfolds at once
_PREFIXES = 1 << 20  # and of prefixes


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct, by text. A text of fewer words than k has its whole sequence as one."""
    w = Words(texts, lower=True)
    hashes = w.hashes()
    doc, value = [], []
    for size in range(1, k + 1):
        v, where = w.windows(hashes, size)
        d = w.doc[where]
        if size < k:
            few = w.count[d] == size
            d, where = d[few], where[few]
        doc.append(d)
        value.append(v[where])
    return sorted_unique(np.concatenate(doc), np.concatenate(value))


def prefix_length(n: np.ndarray, percent: int, shared: int = 1) -> np.ndarray:
    """How many first tokens of sets of n tokens two linked sets share at least `shared` of, or all that a link needs."""
    need = (percent * n + _PERCENT - 1) // _PERCENT
    return n - need + np.minimum(need, shared)


class Orders:
    """Three orders of all tokens from two count tables."""

    def __init__(self, tables: list[np.ndarray] | list[Counts], bits: int):
        self.tables, self.bits = tables, bits

    def hashed(self, tokens: np.ndarray) -> list[np.ndarray]:
        return [mix(tokens, 1), mix(tokens, 2)]

    def prefix(self, doc: np.ndarray, tokens: np.ndarray, length: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, token) of each document's first tokens under an order, 0 to 2; doc ascending and gapless in `length`."""
        a, b = self.hashed(tokens)
        one, two = self.tables[0][cells(a, self.bits)], self.tables[1][cells(b, self.bits)]
        count, tie = ((one, a), (two, b), (np.minimum(one, two), mix(tokens, 3)))[order]
        ranked = np.lexsort((tie, count, doc))
        doc, tokens = doc[ranked], tokens[ranked]
        start = np.searchsorted(doc, np.arange(len(length)))
        keep = np.arange(len(doc)) - start[doc] < length[doc]
        return doc[keep], tokens[keep]


def summed(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and the sum of weights of each."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    return x[start], y[start], np.add.reduceat(weights[order], start) if len(x) else weights


def null_first(nulls: int, values: np.ndarray) -> pd.arrays.IntegerArray:
    """So many nulls and then `values`, without an object for each."""
    return pd.arrays.IntegerArray(np.concatenate([np.zeros(nulls, np.int64), values]), np.arange(nulls + len(values)) < nulls)


def rare_and_core(texts: DataFrame, k: int, deal: int, rare: int) -> DataFrame:
    """What classes of `texts` (c, z: compressed text) share, by how many of them hold a token.

    Rows (x, y, s, part): the number of tokens of two to `rare` classes that x < y share; and (x, null, s,
    part): the number of tokens of x that more classes hold, in one of the 2**deal places that tokens are
    dealt to, of which 64 parts are made. No token gives more than rare² / 2 pairs.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", _PIECE // 2):  # compressed
            doc, tokens = shingle_sets(pa.array([zlib.decompress(z).decode() for z in batch.column("z").to_pylist()], pa.large_string()), k)
            order = np.argsort(tokens, kind="stable")
            tokens, ids = tokens[order], batch.column("c").to_numpy()[doc[order]]
            cuts = np.searchsorted(cells(tokens, deal), np.arange((1 << deal) + 1))
            rows = [(i, tokens[a:b].tobytes(), ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2))], names=["bucket", "token", "ids"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        token, ids = (np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("token", np.uint64), ("ids", np.int64)))
        order = np.lexsort((ids, token))
        token, ids = token[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        size = np.repeat(size, size)
        known, n = np.unique(ids[size > rare], return_counts=True)
        few = np.flatnonzero((size > 1) & (size <= rare))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, rare):
            i = few[few + lag < len(token)]
            i = i[token[i] == token[i + lag]]
            if not len(i):
                break
            xs.append(ids[i])
            ys.append(ids[i + lag])
        x, y = np.concatenate(xs), np.concatenate(ys)
        x, y, times = summed(x, y, np.ones(len(x), np.int64))
        return pd.DataFrame({"x": np.concatenate([known, x]), "y": null_first(len(known), y), "s": np.concatenate([n, times]), "part": int(frame["bucket"].iloc[0]) >> (deal - _PARTS)})

    return texts.select("c", "z").mapInArrow(dealt, "bucket int, token binary, ids binary").groupBy("bucket").applyInPandas(count, "x bigint, y bigint, s bigint, part int")


def class_keys(doc: np.ndarray, tokens: np.ndarray, count: int, clashes: np.ndarray | None = None) -> np.ndarray:
    """Two 64-bit digests of each text's set, as columns. The first names the set; the second does where the first is one of `clashes`, names of several sets."""
    cuts = np.searchsorted(doc, np.arange(count + 1))
    raw = b"".join(hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    keys = np.frombuffer(raw, "<i8").reshape(count, 2).copy()
    if clashes is not None and len(clashes):
        twice = np.isin(keys[:, 0], clashes)
        keys[twice, 0] = keys[twice, 1]
    return keys


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return _PERCENT * np.minimum(a, b) >= percent * np.maximum(a, b)


def meetings(prefixes: DataFrame, deal: int, small: int, least: int, percent: int, counted: Callable[[np.ndarray], np.ndarray], vast: int) -> DataFrame:
    """Where prefixes (c, n, kind: order, first: tokens) meet, by order.

    Pairs (kind, x < y, token null, times): how often they meet in small groups, where a link that needs
    fewer common tokens than `least` counts each the more, or `least` for those of a pivot; and the members
    of larger groups (kind, x, its size as y, token). A token that `counted` puts into more than `vast`
    documents is dealt to as many more places by class, each with a pivot of its own: a larger group,
    however few meet in a place.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "first", _PREFIXES):
            raw = batch.column("first").to_pylist()
            tokens = np.frombuffer(b"".join(raw), np.uint64)
            per = np.array([len(x) // 8 for x in raw], np.int64)
            ids, n, kind = (np.repeat(batch.column(c).to_numpy(), per) for c in ("c", "n", "kind"))
            place = (kind.astype(np.int64) << deal) + cells(tokens, deal)
            many = counted(tokens) if len(tokens) else np.zeros(0, np.int64)
            salts = np.where(many > vast, many // vast + 1, 0)
            salted = np.flatnonzero(salts)
            salt = np.zeros(len(tokens), np.int64)
            salt[salted] = 1 + (mix(ids[salted].view(np.uint64), 5) % salts[salted].astype(np.uint64)).astype(np.int64)
            place = (place << _SALTS) + np.minimum(salt, (1 << _SALTS) - 1)
            order = np.lexsort((tokens, place))
            tokens, ids, n, place = tokens[order], ids[order], n[order], place[order]
            start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            ends = np.append(start[1:], len(place))[: len(start)]
            rows = [(int(place[a]), *(by_places(x[a:b]) for x in (tokens, ids, n.astype(np.int32)))) for a, b in zip(start, ends, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["bucket", "token", "ids", "n"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        token, ids, n = (np.concatenate([from_places(x, t) for x in frame[c]]) for c, t in (("token", np.uint64), ("ids", np.int64), ("n", np.int32)))
        n = n.astype(np.int64)
        order = np.lexsort((ids, n, token))
        token, ids, n = token[order], ids[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
        if int(frame["bucket"].iloc[0]) % (1 << _SALTS):  # a part of a vast group
            size = np.maximum(size, small + 1)
        xs, ys, ws = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def pair(i: np.ndarray, j: np.ndarray) -> None:
            ok = fits(n[i], n[j], percent) & (ids[i] != ids[j])
            xs.append(np.minimum(ids[i], ids[j])[ok])
            ys.append(np.maximum(ids[i], ids[j])[ok])
            need = -(-percent * (n[i] + n[j])[ok] // (_PERCENT + percent))
            ws.append(-(-least // np.clip(need, 1, least)))

        few = np.flatnonzero((size > 1) & (size <= small))
        for lag in range(1, small):
            i = few[few + lag < len(token)]
            i = i[token[i] == token[i + lag]]
            if not len(i):
                break
            pair(i, i + lag)
        x, y, times = summed(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
        large = np.flatnonzero(size > small)
        xs, ys, ws = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(large):
            known, where, met = np.unique(ids[large], return_inverse=True, return_counts=True)
            weight = np.zeros(len(token), np.int64)
            weight[large] = met[where]
            ends = np.append(first[1:], len(token))
            for a in first[size[first] > small]:
                own = np.arange(a, ends[np.searchsorted(first, a)])
                pivot = own[np.argmax(weight[own])]
                pair(own, np.full(len(own), pivot))
        star_x, star_y, _ = summed(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
        out = pd.DataFrame({
            "kind": int(frame["bucket"].iloc[0]) >> (deal + _SALTS),
            "x": np.concatenate([x, star_x, ids[large]]), "y": np.concatenate([y, star_y, n[large]]),
            "token": null_first(len(x) + len(star_x), token[large].view(np.int64)),
            "times": np.concatenate([times, np.full(len(star_x), least), np.zeros(len(large), np.int64)]),
        })
        if len(token) > _PREFIXES // 8:
            release()
        return out

    packed = "bucket bigint, token binary, ids binary, n binary"
    return prefixes.select("c", "n", "kind", "first").mapInArrow(dealt, packed).groupBy("bucket").applyInPandas(meet, "kind int, x bigint, y bigint, token bigint, times bigint")


def links(found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of the pairs `found` (x, y) whose `texts` (c, z) link. Pairs are small, so those of one pivot are many before they crowd a task, and then the adaptive skew join splits them."""
    for e in "xy":
        found = found.join(texts.select(F.col("c").alias(e), F.col("z").alias("z" + e)), e)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "zx", _PIECE // 4):  # compressed, and as much in "zy"
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            raw = dict(zip(x.tolist(), batch.column("zx").to_pylist(), strict=True)) | dict(zip(y.tolist(), batch.column("zy").to_pylist(), strict=True))
            number = {i: j for j, i in enumerate(raw)}
            doc, tokens = shingle_sets(pa.array([zlib.decompress(z).decode() for z in raw.values()], pa.large_string()), k)
            cuts = np.searchsorted(doc, np.arange(len(raw) + 1))
            linked = []
            for i, j in zip((number[v] for v in x.tolist()), (number[v] for v in y.tolist()), strict=True):
                both = np.concatenate([tokens[cuts[i] : cuts[i + 1]], tokens[cuts[j] : cuts[j + 1]]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(_PERCENT * common >= percent * (len(both) - common))
            keep = np.array(linked, bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["u", "v"])

    return found.select("x", "y", "zx", "zy").mapInArrow(verify, "u bigint, v bigint")


def ngram_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90,
    bits: int | None = None, small: int = 8, rare: int = 12, shared_least: int = 3, vast: int = 50_000, by_text: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id[, root, text_md5]) of each document: the smallest id that links of `percent` or more reach.

    With `by_text` each row also tells its text's digest and its component, by a class of it: rows of one
    id may be of several components.

    The two count tables have a cell for about every 256 bytes of text, 2**24 at most: 128 MB on the driver and
    in a task that counts, 64 MB in each worker that looks tokens up. Only prefixes, pairs and the texts of classes in candidate pairs are shuffled.
    """
    spark = docs.sparkSession
    kind, deal, p = dict(docs.dtypes)[id_col], bucket_bits(spark), partitions(spark)
    everything = docs.selectExpr(f"cast(`{id_col}` AS bigint) AS id", f"`{text_col}` AS text")
    volume = everything.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bits or min(24, max(16, (volume // 256).bit_length()))

    def counted(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for piece in slices([batch], "text", _PIECE):
            _, tokens = shingle_sets(piece.column("text"), k)
            yield [mix(tokens, 1), mix(tokens, 2)]

    shared = spark.sparkContext.broadcast([Counts(x) for x in count_cells(everything.select("text"), counted, bits, 2)])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(shared.value, bits)
        for batch in slices(batches, "text", _PIECE):
            doc, tokens = shingle_sets(batch.column("text"), k)
            n = np.bincount(doc, minlength=len(batch))
            d, first = orders.prefix(doc, tokens, prefix_length(n, percent, shared_least), 0)
            at = np.searchsorted(d, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_md5"), pa.array(n, pa.int64()), *map(pa.array, class_keys(doc, tokens, len(batch)).T.copy()), pa.array([first[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["id", "text_md5", "n", "c", "d", "first"],
            )

    digest = "md5(text)" if by_text else "CAST(NULL AS string)"
    sets = cut(everything.selectExpr("*", f"{digest} AS text_md5").mapInArrow(described, "id bigint, text_md5 string, n bigint, c bigint, d bigint, first binary"))
    usable = sets.where("id IS NOT NULL AND n > 0")
    named = usable.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.min("d").alias("one"), F.max("d").alias("other"))
    classes = cut(named)
    clashes = np.array([r.c for r in classes.where("one <> other").select("c").collect()], np.int64)  # by chance one for 10**10 classes or so
    if len(clashes):
        sets = sets.withColumn("c", F.when(F.col("c").isin(clashes.tolist()), F.col("d")).otherwise(F.col("c")))
        usable = sets.where("id IS NOT NULL AND n > 0")
        classes = cut(usable.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    classes = classes.select("c", "rep", "rows")
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # the least id of a class speaks for it; rows of classes of one row, which are most, are told by a bitmap and not shuffled
    often = classes.where("rows > 1")
    alone, some = split_by_keys(usable, F.col("c"), often.select("c"))
    hot = F.broadcast(often.where(F.col("rows") * p > total).select("c", "rep"))  # at most p classes
    heads = often.where(F.col("rows") * p <= total).select("c", "rep")
    crowd = some.join(hot, "c").where("id = rep").drop("rep")
    rest = some.join(hot.select("c"), "c", "left_anti").join(heads, "c", "left").where("rep IS NULL OR id = rep").drop("rep")
    leaders = alone.unionByName(crowd.unionByName(rest).dropDuplicates(["c"]))

    def held_by(tokens: np.ndarray) -> np.ndarray:
        """In how many documents tokens are, at least."""
        one, two = (table[cells(h, bits)] for table, h in zip(shared.value, (mix(tokens, 1), mix(tokens, 2)), strict=True))
        return np.minimum(one, two).astype(np.int64)

    def met_of(prefixes: DataFrame) -> DataFrame:
        return cut(meetings(prefixes, deal, small, shared_least, percent, held_by, vast))

    met = met_of(leaders.select("c", "n", "first", F.lit(0).alias("kind")))

    def met_often(found: DataFrame) -> DataFrame:
        # a link shares so many prefix tokens, or all it needs; one that meets in fewer small groups meets in a large one too, and is found there
        return found.where("token IS NULL").groupBy("kind", "x", "y").agg(F.sum("times").alias("times")).where(F.col("times") >= shared_least).select("kind", "x", "y")

    def both_ends(found: DataFrame) -> DataFrame:
        return found.select(F.explode(F.array("x", "y")).alias("c")).distinct()

    def hashed_ids(batch: pa.RecordBatch) -> np.ndarray:
        return mix(batch.column("rep").to_numpy().astype(np.int64).view(np.uint64), 9)

    def of_classes(wanted: DataFrame, make: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list[tuple]], names: str) -> DataFrame:
        """What `make` tells of one text of each class in `wanted` (c): rows of c and more. Texts are found by their least id, those of other ids are passed over."""
        wanted = cut(wanted)
        test = member_test(spark, wanted.join(classes, "c").select("rep"), hashed_ids, wanted.count())
        columns = ["c", *(x.split()[0] for x in names.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", _PIECE):
                part = batch.filter(pa.array(test(mix(batch.column("id").to_numpy().astype(np.int64).view(np.uint64), 9))))
                if len(part):
                    doc, tokens = shingle_sets(part.column("text"), k)
                    made = make(part.column("text"), doc, tokens, np.bincount(doc, minlength=len(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(class_keys(doc, tokens, len(part), clashes)[:, 0].copy()), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=columns)

        found = everything.where("id IS NOT NULL").mapInArrow(run, "c bigint, " + names)
        return cut(found.join(wanted.hint("shuffle_hash"), "c", "left_semi").dropDuplicates(["c"]))

    def later_prefixes(texts: pa.Array, doc: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> list:
        orders, out = Orders(shared.value, bits), [pa.array(n, pa.int64())]
        for order in (1, 2):
            d, t = orders.prefix(doc, tokens, prefix_length(n, percent, shared_least), order)
            at = np.searchsorted(d, np.arange(len(n) + 1))
            out.append(pa.array([t[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        return out

    def compressed(texts: pa.Array, doc: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> list:
        return [pa.array([zlib.compress((t or "").encode(), 6) for t in texts.to_pylist()], pa.binary())]

    pairs = cut(met_often(met))
    groups = met.where("token IS NOT NULL").select("kind", "token", F.col("x").alias("c"), F.col("y").alias("n"))
    later = of_classes(both_ends(pairs).unionByName(groups.select("c")).distinct(), later_prefixes, "n bigint, second binary, third binary")
    later = later.select("c", "n", F.lit(1).alias("kind"), F.col("second").alias("first")).unionByName(later.select("c", "n", F.lit(2).alias("kind"), F.col("third").alias("first")))
    again = met_of(later)
    pairs = pairs.unionByName(met_often(again)).groupBy("x", "y").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("under"))
    all_groups = groups.unionByName(again.where("token IS NOT NULL").select("kind", "token", F.col("x").alias("c"), F.col("y").alias("n")))
    shares = cut(all_groups.groupBy("c").agg(*(F.collect_set(F.when(F.col("kind") == j, F.col("token"))).alias(f"g{j}") for j in range(3))))
    ends = [shares.select(F.col("c").alias(e), *(F.col(f"g{j}").alias(f"g{j}{e}") for j in range(3))) for e in "xy"]
    pairs = cut(pairs)
    some = pairs.where("under < 7").join(ends[0], "x", "left").join(ends[1], "y", "left")
    for j in range(3):
        some = some.where((F.col("under").bitwiseAND(F.lit(1 << j)) > 0) | F.coalesce(F.arrays_overlap(f"g{j}x", f"g{j}y"), F.lit(False)))
    tried = cut(pairs.where("under = 7").select("x", "y").unionByName(some.select("x", "y")))

    edges = cut(links(tried, of_classes(both_ends(tried), compressed, "z binary"), k, percent))
    reached = components(edges)
    groups = groups.drop("kind")
    if groups.take(1):
        placed = cut(groups.join(reached.withColumnRenamed("node", "c"), "c", "left").select("token", "c", "n", F.coalesce("component", "c").alias("k")))
        split = placed.groupBy("token").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min("n").alias("least"), F.count("*").alias("n")).where("a <> b").select("token", "least", "n")
        rest = cut(join_classes(placed, split, "token", placed.count()))
        if rest.take(1):
            texts = of_classes(rest.select("c").distinct(), compressed, "z binary")
            met_by = cut(rare_and_core(texts, k, deal, rare))
            core = met_by.where("y IS NULL").groupBy(F.col("x").alias("c"), "part").agg(F.sum("s").alias("s")).groupBy("c").agg(F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("part", "s"))).alias("v"))
            core = core.select("c", "s", F.transform(F.sequence(F.lit(0), F.lit((1 << _PARTS) - 1)), lambda i: F.coalesce(F.try_element_at("v", i), F.lit(0)).cast("int")).alias("v"))
            none = F.array_repeat(F.lit(0), 1 << _PARTS)
            known = rest.groupBy("c").agg(F.first("n").alias("n"), F.first("k").alias("k")).join(core, "c", "left")
            known = cut(known.select("c", "n", "k", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("v", none).alias("v")))
            ends = [known.select(F.col("c").alias(e), *(F.col(c).alias(c + e) for c in ("n", "s", "k", "v"))) for e in "xy"]
            apart = (F.col("kx") != F.col("ky")) & (_PERCENT * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))

            def may_link(more=None):
                """Whether the core, at most the lesser count in each part, and what else is shared may make a link."""
                need = percent * (F.col("nx") + F.col("ny"))
                reach = lambda most: (_PERCENT + percent) * (most if more is None else most + more) >= need
                by_part = F.aggregate(F.zip_with("vx", "vy", lambda a, b: F.least(a, b)), F.lit(0), lambda t, a: t + a)
                return reach(F.least("sx", "sy")) & reach(by_part)

            def new_pairs(found: DataFrame) -> DataFrame:
                """Those not judged yet: neither verified nor filtered out under some order."""
                return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(pairs.select("x", "y"), ["x", "y"], "left_anti")

            # pairs that share rare tokens: what they share is at most these and the core that both hold
            sharing = met_by.where("y IS NOT NULL").groupBy("x", "y").agg(F.sum("s").alias("shared"))
            one = sharing.join(ends[0], "x").join(ends[1], "y").where(apart & may_link(F.col("shared"))).select("x", "y")
            # pairs that share core tokens alone: both must be nearly all core
            full = rest.select("token", "c", "least").join(known, "c").where(_PERCENT * F.col("s") >= percent * (F.col("n") + F.greatest("least", "s") - F.col("s")))
            full = cut(full.drop("least"))
            lead = F.max_by(F.struct(*(F.col(a).alias(b) for a, b in zip(("c", "n", "s", "k", "v"), ("y", "ny", "sy", "ky", "vy"), strict=True))), F.struct(F.col("s") / F.col("n"), -F.col("c")))
            pivots = full.groupBy("token").agg(F.min("k").alias("a"), F.max("k").alias("b"), lead.alias("lead"), F.count("*").alias("n")).where("a <> b").select("token", "lead.*", "n")
            members = full.select("token", F.col("c").alias("x"), *(F.col(a).alias(a + "x") for a in ("n", "s", "k", "v")))
            star = join_classes(members, pivots, "token", full.count()).where("x <> y").where(apart & may_link()).select("x", "y")
            second = cut(new_pairs(one.unionByName(star)))
            new = cut(links(second, texts, k, percent))
            if new.take(1):
                reached = components(reached.toDF("u", "v").unionByName(new))
            placed = cut(full.drop("k").join(reached.withColumnRenamed("node", "c"), "c", "left").withColumn("k", F.coalesce("component", "c")).drop("component"))
            parts = placed.groupBy("token", "k").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("n"), F.count("*").alias("parts"), F.max_by("k", F.struct("m", "k")).alias("main"))
            open_groups = parts.where("parts > 1").select("token", "main", F.ceil(F.col("n") / 1000).cast("int").alias("salts"), F.col("n").alias("size")).withColumnRenamed("size", "n")
            # classes outside a group's largest component against all of the group, which is dealt out by salts
            dealt = cut(join_classes(placed.withColumnRenamed("n", "nn"), open_groups, "token", placed.count()))
            named = lambda e: [F.col("c").alias(e), F.col("nn").alias("n" + e), *(F.col(a).alias(a + e) for a in ("s", "k", "v"))]
            left = dealt.where("k <> main").select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *named("x"))
            right = dealt.select("token", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), *named("y"))
            near = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.salt") == F.col("r.salt")) & apart & may_link())
            across = cut(new_pairs(near.select("x", "y")).join(second, ["x", "y"], "left_anti"))
            new = cut(links(across, texts, k, percent))
            if new.take(1):
                reached = components(reached.toDF("u", "v").unionByName(new))

    # the least id of each component, for the classes of a link or of more than one row
    linked = reached.withColumnRenamed("node", "c").join(classes, "c")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = often.join(reached.select(F.col("node").alias("c")), "c", "left_anti").select("c", "rows", F.col("rep").alias("component_id"), F.col("c").alias("root"))
    named = cut(named.unionByName(linked.join(least, "component").select("c", "rows", F.col("least").alias("component_id"), F.col("component").alias("root"))))
    hot = named.where(F.col("rows") * p > total).select("c", "component_id", "root")
    columns = ["id", "n", "component_id", "root", "text_md5"]
    plain = sets.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("root"), "text_md5")
    of_hot = usable.join(F.broadcast(hot), "c").select(columns)
    others = usable.join(F.broadcast(hot.select("c")), "c", "left_anti").join(named.where(F.col("rows") * p <= total).drop("rows"), "c", "left")
    out = plain.unionByName(of_hot).unionByName(others.select("id", "n", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("root", "c").alias("root"), "text_md5"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind), *(["root", "text_md5"] if by_text else []))
