"""N-gram Jaccard self-join: links documents whose word-shingle sets are alike.

1. Each text becomes the set of its k-word shingles (64-bit hashes). Texts of one
   set are one class, named by a hash of the set.
2. Of each class only the smallest hashes are dealt out: as many as make it sure
   that two alike sets share one of them. Hashes that a great many classes deal out, such as
   those of a passage that many texts share, are then put last in the order of all hashes, and dealt
   only by sets that hold little else. Equal hashes of classes of matching size
   are live; the others are dropped. Hashes that the very same classes share are one.
3. The classes of each live hash are joined by a signature tree over their bitmaps.
   What passes is a candidate link: a superset of the true links, as a spanning forest. First this is
   done for one hash in ``EARLY``; of the others those need not be looked at whose classes
   are in one candidate component by then.
4. The full sets of each candidate component, and no others, are brought together
   and joined by a signature tree again, this time with the exact test.
5. Connected components of the confirmed links.

Groups that are too large for one task are cut into blocks, as ``_linked`` tells. Nothing is capped or sampled: the links form a
spanning forest of each true component, so no component is lost.

Defined results: a text of fewer words than k has its whole word sequence as its
one shingle; a null text or one without words has an empty set and is linked with
nothing. Repeated rows are one class and each gets a result row. A row without an
id takes part, but is never the smallest id. Ids are whole numbers, or strings of such; any
other string raises. Other columns are not looked at. Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, in_small_batches, lower_ascii, mix64, shingle_sets, slices, text_bytes
from lodestone.llm.components import components
from lodestone.operators.durable import durable, small
from lodestone.llm.signature_tree import Groups, Similarity, bitmap, join_all, width

#: Hashes of a bucket, of which one task holds one at a time; the more hashes, the more buckets.
BUCKET_HASHES = 1 << 20
#: Classes of one live hash, and shingles of one candidate component, that one task takes whole.
BLOCK_CLASSES, BLOCK_SHINGLES = 16_384, 1 << 21
#: A hash is frequent if ``BLOCK_CLASSES`` classes or more deal it out, and more than one in so many of what is dealt out; so
#: there are at most so many of them, 8 bytes each. ``ROUNDS`` times at most frequent hashes are put last and dealt anew.
FREQUENT, ROUNDS = 1 << 17, 3
#: Hashes that a worker counts at once, and the least count of them that it hands on.
COUNTED, LEAST = 1 << 22, 16
#: One in so many live hashes is joined first.
EARLY = 16
#: A worker's memory of which classes it has dealt out already, and of which groups of classes.
SEEN = 200_000


def _class_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            raw, at = text_bytes(part.column("text"))
            words = Words(lower_ascii(raw), at)
            yield part, list(shingle_sets(words.hashes(), words.first, k))


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _last(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set with its frequent hashes last. Alike sets share one of their first hashes in any order that is the same for all."""
    if not len(frequent):
        return own
    there = np.isin(own, frequent)
    return np.concatenate([own[~there], own[there]])


def _sketches(rows: DataFrame, k: int, like: Similarity, frequent: np.ndarray) -> DataFrame:
    """id, key of the text, cls, n, and the first hashes and the bitmap of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            n = [len(s) for s in sets]
            first = [_last(s, frequent)[: len(s) - (like.num * len(s) + like.den - 1) // like.den + 1] for s in sets]
            bits = [bitmap(s, width(len(s))) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(n, pa.int32()), _binary(first), _binary(bits)], ["id", "key", "cls", "n", "first", "bits"])

    return rows.mapInArrow(run, "id long, key long, cls long, n int, first binary, bits binary")


#: ``inner`` hashes come so early in their set that they are shared with any alike set that is not smaller.
_DEALT = [("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("inner", "?")]
#: The same as it is shuffled: six bytes of the hash, of which the bucket gives some more, and three of the size and of ``inner``.
_SENT = [("token", "u1", 6), ("cls", "<i8"), ("n", "u1", 3)]


def _sent(packed: np.ndarray) -> np.ndarray:
    """Hashes that are cut short may be taken for equal, and sizes from 2^23 on for near ones: that only adds candidates."""
    out = np.zeros(len(packed), _SENT)
    out["token"] = np.ascontiguousarray(packed["token"]).view(np.uint8).reshape(-1, 8)[:, :6]
    out["cls"] = packed["cls"]
    size = np.minimum(packed["n"], (1 << 23) - 1) | np.where(packed["inner"], 1 << 23, 0)
    out["n"] = size.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
    return out


def _received(raw: bytes) -> np.ndarray:
    sent = np.frombuffer(raw, _SENT)
    out = np.zeros(len(sent), _DEALT)
    out["cls"] = sent["cls"]
    for name, size in (("token", 6), ("n", 3)):
        wide = np.zeros((len(sent), out[name].itemsize), np.uint8)
        wide[:, :size] = sent[name]
        out[name] = wide.view(out[name].dtype)[:, 0]
    out["inner"], out["n"] = out["n"] >> 23, out["n"] & (1 << 23) - 1
    return out


def _dealers(batches: Iterator[pa.RecordBatch], like: Similarity) -> Iterator[np.ndarray]:
    """The first hashes of the classes of batches, each class once as far as a worker remembers.

    Two alike sets have so many common hashes that the first one of these is among the dealt ones of the larger, and among the ``inner`` ones of
    the smaller: there the sizes' sum is at least twice its own.
    """
    seen: set[int] = set()
    for batch in batches:
        cls, first = batch.column("cls").to_pylist(), batch.column("first").to_pylist()
        fresh = {c: r for r, c in enumerate(cls) if c not in seen}
        if len(seen) < SEEN:
            seen.update(fresh)
        if not fresh:
            continue
        at = list(fresh.values())
        tokens = np.frombuffer(b"".join(first[r] for r in at), np.uint64)
        each = np.array([len(first[r]) // 8 for r in at])
        packed = np.zeros(len(tokens), _DEALT)
        packed["token"] = tokens
        packed["cls"] = np.repeat(np.array(list(fresh), np.int64), each)
        n = batch.column("n").to_numpy()[at]
        packed["n"] = np.repeat(n, each)
        inner = n - -(-2 * like.num * n.astype(np.int64) // (like.num + like.den)) + 1
        packed["inner"] = np.arange(len(tokens)) - np.repeat(np.cumsum(each) - each, each) < np.repeat(inner, each)
        yield packed


def _frequent(sketches: DataFrame, dealt: int, like: Similarity) -> np.ndarray:
    """The frequent ones of ``dealt`` first hashes, sorted. Counts of less than ``LEAST`` in ``COUNTED`` hashes are left out of the sums:
    a hash just above the bound may be overlooked by that, and is then joined in blocks like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add_up(held: list[np.ndarray]) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["token", "n"])

        held, total = [], 0
        for packed in _dealers(batches, like):
            held.append(packed["token"].copy())
            total += len(packed)
            if total > COUNTED:
                yield add_up(held)
                held, total = [], 0
        if held:
            yield add_up(held)

    most = max(BLOCK_CLASSES, dealt // FREQUENT)
    counts = sketches.where("n > 0").select("cls", "n", "first").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") > most).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _scatter(sketches: DataFrame, buckets: int, frequent: np.ndarray, like: Similarity) -> DataFrame:
    """The first hashes of all classes by bucket, packed as in ``_SENT``. Frequent ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in _dealers(batches, like):
            if len(frequent):
                packed = packed[~np.isin(packed["token"], frequent)]
            bucket = (mix64(packed["token"].copy()) >> np.uint64(16)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            held, cut = np.unique(bucket[order], return_index=True)
            parts = np.split(_sent(packed[order]), cut[1:]) if len(packed) else []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), _binary(parts)], ["bucket", "packed"])

    return sketches.where("n > 0").select("cls", "n", "first").mapInArrow(run, "bucket long, packed binary")


def _live_at_once(sketches: DataFrame, frequent: np.ndarray, like: Similarity) -> DataFrame:
    """(token, cls, n) of the frequent hashes that are dealt out all the same. That they are shared is known, so that they need not meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in _dealers(batches, like):
            packed = packed[np.isin(packed["token"], frequent)]
            yield pa.RecordBatch.from_arrays([pa.array(packed["token"].copy().view(np.int64)), pa.array(packed["cls"].copy()), pa.array(packed["n"].copy())], ["token", "cls", "n"])

    return sketches.where("n > 0").select("cls", "n", "first").mapInArrow(run, "token long, cls long, n int").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _live(scattered: DataFrame, like: Similarity, partitions: int) -> DataFrame:
    """(token, cls, n) of the hashes that two classes of matching sizes share, for the smaller one as an inner hash. A token is a hash of the classes that share it,
    so that hashes shared by the same classes are one; two unlike groups of one token would just be joined together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for group in _runs(batches, ["bucket"]):
            rows = _received(b"".join(group.column("packed").to_pylist()))
            rows = rows[np.lexsort((rows["cls"], ~rows["inner"], rows["n"], rows["token"]))]
            rows = rows[np.append(True, rows[1:] != rows[:-1])]
            n, place = rows["n"].astype(np.int64), np.arange(len(rows))
            # of equal sizes inner ones come first: each meets the next row, and any row the last inner one before it
            meets = np.append(rows["inner"][:-1] & (rows["token"][1:] == rows["token"][:-1]) & like.sizes(n[:-1], n[1:]), False)
            last = np.maximum.accumulate(np.append(-1, np.where(rows["inner"], place, -1)))[:-1]
            live = meets | (last >= 0) & (rows["token"][last] == rows["token"]) & like.sizes(n[last], n)
            rows = rows[live]
            if not len(rows):
                continue
            first = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
            many = np.diff(np.append(first, len(rows)))
            token = mix64(np.add.reduceat(mix64(np.ascontiguousarray(rows["cls"]).view(np.uint64)), first) + many.astype(np.uint64))
            _, fresh = np.unique(token, return_index=True)
            fresh = fresh[~np.isin(token[fresh], seen)]
            if len(seen) < SEEN:
                seen = np.concatenate([seen, token[fresh]])
            kept = np.zeros(len(first), bool)
            kept[fresh] = True
            own = np.repeat(kept, many)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(token, many)[own].view(np.int64)), pa.array(rows["cls"][own].copy()), pa.array(rows["n"][own].copy())], ["token", "cls", "n"])

    return scattered.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "token long, cls long, n int").distinct()


def _linked(rows: DataFrame, key: str, weight: str, limit: int, join: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """The links that ``join`` finds among the classes of each key of ``rows`` (key, cls, weight, ..., and ``known`` if there is one).

    ``join`` takes rows with (x, y), which together with the key name a task, and ``known``, a class that a
    class is linked with already; its second argument has the keys that are large, the first time, when all the others are joined. A key of more than ``limit`` weight is joined in blocks:
    first each block by itself, then one class of each group so found, and at last every pair of blocks
    that has classes outside the key's largest group. So a large group of copies costs as many tasks as
    it has blocks, not as many as these have pairs; and no pair of groups is left out.
    """
    none = F.lit(None).cast("long")
    if "known" not in rows.columns:
        rows = rows.withColumn("known", none)
    total = rows.groupBy(key).agg(F.sum(weight).alias("_w"))
    large = durable(total.where(F.col("_w") > limit).select(key))
    links = join(rows.join(small(large), key, "left_anti").withColumns({"x": F.lit(0), "y": F.lit(0)}), large)
    if large.isEmpty():
        return links
    links, rows = durable(links), durable(rows.drop("known").join(small(large), key))

    def cut(part: DataFrame) -> DataFrame:
        """``part`` with ``b``, the block of each class, and ``m``, the number of its key's blocks."""
        blocks = part.groupBy(key).agg(F.ceil(F.sum(weight) / limit).cast("int").alias("m"))
        return part.join(small(durable(blocks)), key).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))

    def grouped() -> DataFrame:
        labels = components(links).select(F.col("node").alias("cls"), F.col("label").alias("_label"))
        return durable(rows.join(labels, "cls", "left").withColumn("known", F.coalesce("_label", "cls")).select(*rows.columns, "known"))

    def each(part: DataFrame) -> DataFrame:
        return durable(join(cut(part).withColumns({"x": F.col("b"), "y": F.col("b")}), None))

    links = links.union(each(rows.withColumn("known", none)))
    links = links.union(each(_one_of_each_group(grouped(), key)))
    now = grouped()
    sizes = now.groupBy(key, "known").agg(F.sum(weight).alias("_w")).groupBy(key).agg(F.max_by("known", "_w").alias("_top"))
    now = now.join(small(durable(sizes)), key)
    rest = cut(now.where("known <> _top"))
    outside = durable(rest.select(key, F.col("m").alias("_r")).distinct())
    top = cut(now.where("known = _top")).join(small(outside), key)
    inside = durable(top.select(key, F.col("m").alias("_t")).distinct())
    rest = rest.join(small(inside), key)
    kept = [*rows.columns, "known"]
    # blocks of the largest group are numbered 0 to _t - 1, the others from _t on
    own = F.col("b") + F.col("_t")
    meet_top = top.withColumn("y", F.explode(F.sequence(F.col("m"), F.col("m") + F.col("_r") - 1))).select(*kept, F.col("b").alias("x"), "y")
    meet_rest = rest.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") + F.col("m") - 1))).select(*kept, F.least("_o", own).alias("x"), F.greatest("_o", own).alias("y"))
    return links.union(join(meet_top.union(meet_rest), None))


def _one_of_each_group(rows: DataFrame, key: str) -> DataFrame:
    """The smallest class of each key and group."""
    first = rows.groupBy(key, "known").agg(F.min("cls").alias("cls"))
    return rows.join(first, [key, "known", "cls"], "left_semi").select(rows.columns)


def _dealt(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys)


def _known(groups: Groups, keys: np.ndarray, group: pa.Table) -> None:
    for a, b in zip(keys.tolist(), group.column("known").to_pylist(), strict=True):
        if b is not None:
            groups.link(a, b, known=True)


def _links(groups: Groups) -> pa.RecordBatch:
    a, b = zip(*groups.links, strict=True) if groups.links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(live: DataFrame, sketches: DataFrame, like: Similarity, partitions: int) -> DataFrame:
    """Links (a, b) that the bitmaps allow among the classes of each live hash."""
    bits = sketches.where("n > 0").select("cls", "bits").dropDuplicates(["cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for group in _runs(batches, ["token", "x", "y"]):
            keys = group.column("cls").to_numpy()
            _known(groups, keys, group)
            if len(np.unique(groups.roots(keys))) > 1:
                join_all(keys, group.column("n").to_numpy().astype(np.int64), [np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()], like, groups)
        yield _links(groups)

    def join(rows: DataFrame, _: DataFrame | None) -> DataFrame:
        return _dealt(rows.join(bits, "cls").select("token", "x", "y", "cls", "n", "bits", "known"), ["token", "x", "y"], partitions).mapInArrow(run, "a long, b long")

    return _linked(live.withColumn("one", F.lit(1)), "token", "one", BLOCK_CLASSES, join)


def _full_sets(rows: DataFrame, sketches: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(label, cls, shingles) of the classes in ``labels``, from one text each. Labels go along with the texts, so that sets need not be joined with them."""
    labels = labels.select(F.col("node").alias("cls"), "label")
    wanted = sketches.select("cls", "id").join(labels, "cls").groupBy("cls", "label").agg(F.min("id").alias("id"))
    own = rows.join(small(durable(wanted.where("id IS NOT NULL"))), "id").select("text", "cls", "label")
    texts = own.union(rows.where("id IS NULL").select("text", F.lit(None).cast("long"), F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            cls = [_class_of(s) if len(s) else None for s in sets]
            # other texts of the same id are of other classes
            good = [j for j, (c, w) in enumerate(zip(cls, part.column("cls").to_pylist(), strict=True)) if c is not None and w in (None, c)]
            yield pa.RecordBatch.from_arrays([part.column("label").take(pa.array(good, pa.int64())), pa.array([cls[j] for j in good], pa.int64()), _binary([sets[j] for j in good])], ["label", "cls", "shingles"])

    sets = texts.mapInArrow(run, "label long, cls long, shingles binary")
    if sketches.where("id IS NULL AND n > 0").isEmpty():
        return sets
    lost = sets.where("label IS NULL").drop("label").join(labels, "cls").select("label", "cls", "shingles")
    return sets.where("label IS NOT NULL").union(lost)


def _confirmed(sets: DataFrame, sizes: DataFrame, like: Similarity, partitions: int) -> DataFrame:
    """Links (a, b) between classes that are alike; ``sets`` has (label, cls, shingles), ``sizes`` (label, cls, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["label", "x", "y"]):
            keys, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            held = group.column("shingles").to_pylist()
            sets = [np.frombuffer(held[i], np.uint64) for i in first]

            def same(i: int, j: int, sets: list = sets) -> bool:
                a, b = sorted((sets[i], sets[j]), key=len)
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                return bool(like.overlap(common, len(a), len(b)))

            groups = Groups()
            _known(groups, group.column("cls").to_numpy(), group)
            join_all(keys, np.array([len(s) for s in sets]), [bitmap(s, width(len(s))) for s in sets], like, groups, same)
            yield _links(groups)

    held: list[DataFrame] = []

    def join(rows: DataFrame, large: DataFrame | None) -> DataFrame:
        if large is not None:  # all groups but the large ones, in one piece each
            whole = sets.join(small(large), "label", "left_anti").withColumns({"x": F.lit(0), "y": F.lit(0), "known": F.lit(None).cast("long")})
        else:
            if not held:
                held.append(durable(sets.drop("label")))  # else each call would read the texts anew
            whole = rows.join(held[0], "cls")
        return _dealt(whole.select("label", "x", "y", "cls", "shingles", "known"), ["label", "x", "y"], partitions).mapInArrow(run, "a long, b long")

    return _linked(sizes, "label", "n", BLOCK_SHINGLES, join)


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """(id, key, n, component) of each row: its id, a hash of its text, the size of its set and the
    smallest id that links lead to."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    like = Similarity(num, den)
    rows = _rows(docs, id_col, text_col)
    frequent = np.zeros(0, np.uint64)
    for turn in range(ROUNDS + 1):
        sketches = durable(_sketches(rows, words, like, frequent))
        dealt = (sketches.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // 8
        fresh = np.setdiff1d(_frequent(sketches, dealt, like), frequent) if turn < ROUNDS else frequent[:0]
        if not len(fresh):
            break
        frequent = np.union1d(frequent, fresh)
    buckets = max(8 * partitions, -(-dealt // BUCKET_HASHES))
    live = _live(_scatter(sketches, buckets, frequent, like), like, partitions)
    live = durable(live.union(_live_at_once(sketches, frequent, like)) if len(frequent) else live)
    late = F.pmod("token", F.lit(EARLY)) != 0
    early = durable(_candidates(live.where(~late), sketches, like, partitions))
    known = components(early).select(F.col("node").alias("cls"), F.col("label").alias("_label"))
    rest = durable(live.where(late).join(known, "cls", "left").select("token", "cls", "n", F.coalesce("_label", "cls").alias("known")))
    apart = rest.groupBy("token").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("token")
    links = early.union(_candidates(rest.join(small(durable(apart)), "token", "left_semi"), sketches, like, partitions))
    labels = durable(components(links))
    sizes = sketches.select("cls", "n").join(labels.select(F.col("node").alias("cls"), "label"), "cls").distinct()
    links = _confirmed(_full_sets(rows, sketches, labels, words), durable(sizes), like, partitions)
    parts = durable(components(links))
    # the smallest id of each class, then of each component
    classes = sketches.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("many"))
    classes = classes.join(parts, F.col("cls") == F.col("node"), "left")
    linked = classes.where("label IS NOT NULL")
    smallest = linked.groupBy("label").agg(F.min("least").alias("component"))
    several = linked.join(smallest, "label").select("cls", "component").union(classes.where("label IS NULL AND many > 1").select("cls", "least"))
    out = sketches.select("id", "key", "cls", "n").join(small(durable(several)), "cls", "left")
    return out.select("id", "key", F.col("n").cast("long").alias("n"), F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row its id, ``n_shingles`` and ``component_id``, the smallest id that links
    lead to; two rows link when den * intersection >= num * union."""
    kind = docs.schema[id_col].dataType
    found = _members(docs, id_col, text_col, words, num, den)
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those of a component that have not its smallest id. Of rows of one
    id and one text one stays. Rows without an id go if a row with an id is linked to them."""
    found = durable(_members(docs, id_col, text_col, words, num, den).select("id", "key", "component"))
    gone = found.where("component IS NOT NULL AND NOT id <=> component").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    own = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key"))
    kept = docs.join(small(gone), own, "left_anti")
    again = found.where("id <=> component").groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).count().where("count > 1")
    if again.isEmpty():
        return kept
    again = small(durable(again.select("_id", "_key")))
    return kept.join(again, own, "left_anti").union(kept.join(again, own, "left_semi").dropDuplicates([id_col, text_col]))
