"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. A document's sketch holds the `SKETCH` smallest hashes of its distinct shingles. Documents with equal sets form a class
   at once; all further work is on one representative a class.
2. Inverted lists of retained values: two sketches of similar documents have at least `SHARED` values in common (a pair
   at 0.85 has fewer with probability 3.7e-7; sets of up to `WHOLE` shingles are whole in their sketches, which makes the
   bound exact). So two similar documents share one of each one's rarest `size - SHARED + 1` values, and only these are
   listed. Values of passages that many documents share are frequent, come last, and make no list as long as the rest
   of a document is its own.
3. Lists give overlaps by hubs: first each document meets the least hub of its lists, one row a document; then each list's
   hub meets the members of other components, with another hub every round while that closes lists. The sketch of the
   union estimates the similarity; pairs far below are dropped, the others are measured on full sets. A list whose members are
   in one component is closed. A group of n copies takes about n rows, and a round no more than the lists have entries.
4. Documents in lists that stay open are listed anew by the rarest values of their full sets, where the bound is exact and
   tight: unlike documents that share a passage drop out, whatever their number. What stays open even so, documents that
   are all just below the similarity, is compared in blocks of `BLOCK`, each document in its longest list first: that
   is the square of such a list over 128 rows, and a block pair returns no more links than join its components.
5. Components of the links give the groups.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, among, documents, map_texts
from keyloom.llm.graph import components, labels

WORDS = 5
SKETCH, SHARED, WHOLE = 48, 27, 40
#: The share of a union sketch below which no pair at the similarity is to be expected.
LEAST_LINK = SHARED / SKETCH
BLOCK = 128
#: Rounds of hubs go on while they leave at most this share of the open entries.
CLOSING = 0.7
#: Hashes of words that a task remembers.
REMEMBERED = 200_000


def _setup() -> dict[bytes, int]:
    return {}


def shingles(cache: dict[bytes, int], text: str, words: int = WORDS) -> np.ndarray:
    """The sorted 63-bit hashes of the distinct shingles of a whole text."""
    tokens = text.encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return np.empty(0, np.int64)
    if len(cache) > REMEMBERED:
        cache.clear()
    for t in set(tokens):
        if t not in cache:
            cache[t] = xxhash.xxh3_64_intdigest(t)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64))


def _sketch(cache, doc_id, text):
    s = shingles(cache, text)
    return doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, s[:SKETCH]


def _whole(cache, doc_id, text):
    return doc_id, shingles(cache, text)


def union_share(x: Column, y: Column) -> Column:
    """The estimated similarity: the share of the union's smallest values that are in both sketches."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union)


def _in_common(left: list, right: list) -> np.ndarray:
    """How many values each on the left shares with each on the right."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    seen = np.zeros((len(left) + len(right), len(values)), np.float32)
    seen[np.repeat(np.arange(len(seen)), [len(x) for x in (*left, *right)]), place] = 1
    return seen[: len(left)] @ seen[len(left) :].T


def _likely(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Pairs of different components whose sketches have enough in common. A union sketch of k values with a share s in both
    has s * k values in both sketches, and k is at least the size of the larger sketch."""
    x, y = ([np.asarray(v)[:SKETCH] for v in side.shingles] for side in (left, right))
    larger = np.maximum.outer([len(v) for v in x], [len(v) for v in y])
    return (_in_common(x, y) >= LEAST_LINK * larger) & (left.component.to_numpy()[:, None] != right.component.to_numpy()[None])


def _blocks(percent: int):
    """Links within one block pair of a list, on full sets: as many as join what isn't joined yet."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = group[group.side == 0]
        right = left if group.same.iloc[0] else group[group.side == 1]
        out: list[tuple[int, int]] = []
        label = {c: c for c in group.component.tolist()}

        def root(c: int) -> int:
            while label[c] != c:
                c = label[c]
            return c

        a, b, u, v = left.id.tolist(), right.id.tolist(), left.component.tolist(), right.component.tolist()
        for i, j in np.argwhere(_likely(left, right)).tolist() if len(left) and len(right) else []:
            p, q = root(u[i]), root(v[j])
            if p != q:
                x, y = left.shingles.iloc[i], right.shingles.iloc[j]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    label[max(p, q)] = min(p, q)
                    out.append((min(a[i], b[j]), max(a[i], b[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Members of each list in blocks of about BLOCK, every block with itself and each other block once."""
    blocks = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select(
        "key",
        "id",
        "component",
        "shingles",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("block") == F.col("other")).alias("same"),
    )


def rare_lists(sets: DataFrame, least: Column, scratch: Scratch) -> DataFrame:
    """key, id: lists of at least two documents by the rarest of their values; sets: id, part, n, values, where an id with
    several texts has a part for each.

    least: how many values any two similar documents share at least, by n. Values that one document has alone are the
    rarest and make no list. Of lists with the same members one stays, by 128 bits of their ids.
    """
    each = sets.select("id", "part", least.alias("least"), F.explode("values").alias("value"))
    # written first, so that the join is one of plain rows, of which adaptive execution can split a hot value's
    often = scratch.write(each.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"))
    shared = scratch.write(each.join(often, "value"))
    own = shared.groupBy("id", "part").agg(F.first("least").alias("least"), F.sort_array(F.collect_list(F.struct("often", "value"))).alias("own"))
    room = F.size("own") - F.col("least") + 1
    rarest = F.transform(F.slice("own", 1, room), lambda x: x["value"])
    entries = scratch.write(own.where(room > 0).select("id", F.explode(rarest).alias("key")).distinct())
    alike = entries.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    one_each = scratch.write(alike.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return scratch.write(entries.join(one_each, "key"))


class _Links:
    """The links found so far, the components that they give, and the measuring of pairs of candidates."""

    def __init__(self, candidates: DataFrame, percent: int, scratch: Scratch):
        """candidates: id, part, n, values, sketch of every document in a list."""
        self.candidates, self.percent, self.scratch = candidates, percent, scratch
        self.all: list[DataFrame] = []
        self.found: DataFrame | None = None

    def union(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.all)

    def add(self, links: DataFrame) -> None:
        self.all.append(self.scratch.write(links))
        self.found = labels(self.union(), self.scratch)

    def measure(self, pairs: DataFrame) -> None:
        """Adds those of the pairs (a, b) that are links: estimated on sketches first, then on full sets."""
        sketch, full = (lambda x, c=c: self.candidates.select(F.col("id").alias(x), F.col(c).alias(f"s{x}")) for c in ("sketch", "values"))
        near = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(union_share(F.col("sa"), F.col("sb")) >= LEAST_LINK).select("a", "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        linked = near.join(full("a"), "a").join(full("b"), "b").where(100 * shared >= self.percent * (F.size("sa") + F.size("sb") - shared))
        self.add(linked.select("a", "b"))

    def open(self, members: DataFrame, turn: int) -> DataFrame:
        """key, id, component, hub, size of the lists whose members aren't all in one component; the hub is another every turn."""
        known = self.found.select(F.col("node").alias("id"), F.col("component").alias("root"))
        whole = members.select("key", "id").join(known, "id", "left").select("key", "id", F.coalesce("root", "id").alias("component"))
        first = F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id", "component")
        lists = whole.groupBy("key").agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.min(first).alias("hub"), F.count("*").alias("size")
        )
        opened = self.scratch.write(lists.where("least < most").select("key", "hub", "size"))
        return self.scratch.write(whole.join(opened, "key"))

    def by_one_hub(self, members: DataFrame) -> DataFrame:
        """Each document meets the least hub of its lists; the lists that stay open."""
        order = F.struct(F.xxhash64("id").alias("order"), "id")
        hubs = self.scratch.write(members.groupBy("key").agg(F.min(order).alias("hub")))
        least = members.join(hubs, "key").groupBy("id").agg(F.min("hub").alias("hub")).where(F.col("id") != F.col("hub.id"))
        self.measure(least.select(F.col("hub.id").alias("a"), F.col("id").alias("b")))
        return self.open(members, 0)

    def by_hubs(self, left: DataFrame) -> DataFrame:
        """Each list's hub meets the members of other components, with another hub every round while that closes lists."""
        entries, turn = left.count(), 0
        while entries:
            turn += 1
            other = F.col("id") != F.col("hub.id")
            met = left.where(other & (F.col("component") != F.col("hub.component")))
            self.measure(met.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
            left = self.open(left.where(other), turn)
            before, entries = entries, left.count()
            if entries > CLOSING * before:
                break
        return left

    def by_blocks(self, left: DataFrame) -> None:
        """All pairs of what is left of the lists; each document in its longest list first, which often covers the others."""
        longest = self.scratch.write(left.groupBy("id").agg(F.min(F.struct((-F.col("size")).alias("size"), "key")).alias("in")))
        once = left.join(longest, "id")
        covered = once.groupBy("key").agg(F.min("in.key").alias("x"), F.max("in.key").alias("y")).where("x = y").select("key")
        full = self.candidates.select("id", F.col("values").alias("shingles"))
        for own in (once.where(F.col("in.key") == F.col("key")), left.join(covered, "key", "left_anti")):
            lists = self.open(own, 0).drop("hub")
            if not lists.isEmpty():
                pairs = _dealt(lists.join(full, "id")).groupBy("key", "x", "y")
                self.add(pairs.applyInPandas(_blocks(self.percent), "a long, b long").distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Linked: 100 * intersection >= percent * union of the distinct shingles of lower-cased words (percent 85 or more), of
    whole texts however long. Null and empty texts have no shingles and link with nothing. A null id is linked with nothing
    either, has no component and is kept. Rows that repeat an id stand for one document, which carries the links of each
    row's text. Of equal similarities none is preferred: every link counts. An empty table gives no rows; other columns are
    ignored.
    """
    if percent < 85:
        raise ValueError("lists and bounds are laid out for 85 percent or more")
    scratch = Scratch(docs.sparkSession, "near")
    texts = documents(docs, id_col, text_col)
    sketches = scratch.write(map_texts(texts, _sketch, "doc_id long, n_shingles long, digest binary, sketch array<long>", _setup))
    able = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = able.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.write(able.select("doc_id", "digest").join(least, "digest").select("doc_id", "digest", "class_id"))
    repeats = not able.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    reps = able.join(first, "doc_id", "left_semi")
    reps = reps.dropDuplicates(["doc_id", "digest"]) if repeats else reps
    reps = scratch.write(reps.select(F.col("doc_id").alias("id"), F.xxhash64("digest").alias("part"), F.col("n_shingles").cast("int").alias("n"), F.col("sketch").alias("values")))

    share = F.ceil(F.col("n") * percent / 100).cast("int")
    lists = rare_lists(reps, F.when(F.col("n") <= WHOLE, share).otherwise(SHARED), scratch)
    grouped = classes.select("doc_id", "class_id")
    if not lists.isEmpty():
        listed = scratch.write(lists.select(F.col("id").alias("doc_id")).distinct())
        own = map_texts(among(texts, listed), _whole, "id long, values array<long>", _setup).withColumn("part", F.xxhash64("values"))
        own = own.dropDuplicates(["id", "part"]) if repeats else own
        sets = scratch.write(own.select("id", "part", F.size("values").alias("n"), "values", F.slice("values", 1, SKETCH).alias("sketch")))
        links = _Links(sets, percent, scratch)
        left = links.by_hubs(links.by_one_hub(lists))
        if not left.isEmpty():
            open_ = rare_lists(sets.join(left.select("id").distinct(), "id", "left_semi"), share, scratch)
            left = links.by_one_hub(open_)
            if not left.isEmpty():
                links.by_blocks(left)
        found = components(links.union(), scratch).withColumnRenamed("node", "class_id")
        grouped = grouped.join(found, "class_id", "left").withColumn("class_id", F.coalesce("component", "class_id"))
    named = grouped.groupBy("doc_id").agg(F.min("class_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
