"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

Documents with equal sets become one. The tokens of a set (its shingles) are ordered by how many documents have
them, rare ones first. Two sets of similarity t or more share at least ceil(t * larger size) tokens, so that
their prefixes, extended by one token, share the two tokens that come first among all shared ones. Tokens in at
most `rare` documents are indexed by themselves; if both of the two are more frequent, the sets share that
combination of two, and only combinations of frequent tokens are indexed. Large sets would have too many
combinations: they index frequent tokens by themselves too, and sets that may link to them do both.

Entries carry how much their sets can still share if the entry is the first they share, which rules most pairs
out before any set is looked at. The others are verified on whole sets, token by token in 128 bits. Links only have to give the components
right, so each key's members are first tried against its most typical one, the one whose tokens are the most
frequent. What is then still in different components is tried pair by pair in keys of at most WHOLE entries; larger keys
are first worked off by rounds of pivots, so that each round tries a bounded number of partners for each entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import NO_ID, PER_CHUNK, SENT, Chunks, components, known_ids, looked_up, opened, opened_counts, pack_sorted, rows_of, send_counts, shared_counts, short, unpack_sorted
from .common import Scratch, hot_bound, join_groups
from .grid import mixed, shingle_hashes

RARE = 2000
#: Sets from this size index frequent tokens by themselves: their combinations would outnumber the entries they save.
LARGE = 300
#: Keys of more entries are worked off by rounds of so many pivots; the entries of the others meet each other: each has a bounded number of partners.
WHOLE, PIVOTS = 2048, 512
BUCKET_BYTES = 8 << 20


def distinct_per_text(h: np.ndarray, bounds: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text numbers, hashes), sorted and without repeats within a text; with other hashes of the same tokens, those too, in that order: tokens are then told apart by both."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    if other is None:
        return doc[first], h[first]
    other = other[order]
    if (~first[1:] & (other[1:] != other[:-1])).any():  # as good as never: equal hashes of different tokens
        order = np.lexsort((other, h, doc))
        h, doc, other = h[order], doc[order], other[order]
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])
    return doc[first], h[first], other[first]


def texts_at(buf: np.ndarray, off: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of some of the texts."""
    parts = [buf[a:b] for a, b in zip(off[places].tolist(), off[places + 1].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else buf[:0]), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def common_tokens(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many tokens two sets share. A set is two arrays with 64 bits of each token, in order of the first and then the second."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0
    at = np.searchsorted(b[0], a[0])
    inside = at < len(b[0])
    at = np.minimum(at, len(b[0]) - 1)
    same = inside & (b[0][at] == a[0]) & (b[1][at] == a[1])
    repeats = (b[0][1:] == b[0][:-1]).any()
    if repeats:  # tokens that 64 bits don't tell apart: compare all 128
        pairs = set(zip(b[0].tolist(), b[1].tolist(), strict=True))
        return sum(x in pairs for x in zip(a[0].tolist(), a[1].tolist(), strict=True))
    return int(same.sum())


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of this size shares with any partner at least."""
    return -(-size * percent // 100)


def prefix_keys(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, percent: int, rare: int, large: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, keys, most) of the index entries of sets given as sorted (doc, h) with document counts.

    most is how many tokens a set can share with another if the entry's token, or the first of its two, is the
    first that they share: what comes before it in the order is not shared.
    """
    size = np.bincount(doc, minlength=n_docs)
    prefix = np.minimum(size - needed(size, percent) + 2, size)
    alone = count < 2
    own = np.bincount(doc[alone], minlength=n_docs)
    left = prefix - own  # places in the prefix after tokens that no other document has
    live = ~alone & (left[doc] > 0)
    d, t, c = doc[live], h[live], count[live]
    order = np.lexsort((t, c, d))
    d, t, c = d[order], t[order], c[order]
    starts = np.searchsorted(d, np.arange(n_docs))
    place = np.arange(len(d)) - starts[d]
    keep = place < left[d]
    d, t, c, m = d[keep], t[keep], c[keep], (size[d] - own[d] - place)[keep]
    plain = c <= rare
    docs, keys, most = [d[plain]], [t[plain]], [m[plain]]
    fd, ft, fm = d[~plain], t[~plain], m[~plain]
    by_itself = size[fd] >= large * percent // 100
    docs.append(fd[by_itself]), keys.append(mixed(ft[by_itself] + np.uint64(1))), most.append(fm[by_itself])
    in_pairs = size[fd] < large
    fd, ft, fm = fd[in_pairs], ft[in_pairs], fm[in_pairs]
    if len(fd):
        cuts = np.nonzero(np.diff(fd))[0] + 1
        for part in np.split(np.arange(len(fd)), cuts):
            if len(part) > 1:
                i, j = np.triu_indices(len(part), 1)
                with np.errstate(over="ignore"):
                    keys.append(mixed(ft[part[i]] * np.uint64(0x9E3779B97F4A7C15) + ft[part[j]]))
                docs.append(np.full(len(i), fd[part[0]])), most.append(fm[part[i]])
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(most)


_NODE = "struct<none: boolean, doc: bigint, rid: bigint>"


def _node(doc_id: str) -> Column:
    """A row as a node whose order is that of doc_ids, null last, then of rows: the smallest node of a component names it."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.col("rid").alias("rid"))


class ShingleJoin:
    """One self-join: groups() gives a row per document. Everything is stored as it goes, in the shared folder."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80, rare: int = RARE, large: int = LARGE):
        self.spark, self.width, self.percent, self.rare, self.large = docs.sparkSession, width, percent, rare, large
        self.scratch = Scratch(self.spark)
        self.chunks = Chunks(docs, self.scratch)
        self.tried: DataFrame | None = None

    def _sets(self) -> None:
        """rows: rid, doc_id, n and two independent 64-bit prints of the set; groups of equal sets; and the hashes that chunks share."""
        width, n_buckets = self.width, self.chunks.buckets(BUCKET_BYTES)

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                ids, buf, off = opened(row)
                h, bounds = shingle_hashes(buf, off, width)
                doc, *both = distinct_per_text(h, bounds, shingle_hashes(buf, off, width, 1)[0])
                n, at, two = np.bincount(doc, minlength=len(ids)), np.searchsorted(doc, np.arange(len(ids) + 1)), []
                for x in both:
                    with np.errstate(over="ignore"):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x + np.uint64(1)), dtype=np.uint64)])
                        two.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
                rid = row["cid"] * PER_CHUNK + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids, mask=~known_ids(row)), pa.array(n.astype(np.int64)), *map(pa.array, two)], ["rid", "doc_id", "n", "p1", "p2"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                _, buf, off = opened(row)
                doc, h = distinct_per_text(*shingle_hashes(buf, off, width))
                if row["one"]:  # one row of each set counts
                    h = h[np.isin(doc, row["one"])]
                    values, n = np.unique(short(h), return_counts=True)
                    if len(values):
                        yield send_counts(row["cid"], values, n, n_buckets)

        table, save = self.chunks.joined(), self.scratch.save
        self.rows = save(table.mapInArrow(prints, "rid long, doc_id long, n long, p1 long, p2 long"), "rows")
        groups = self.rows.where("n > 0").groupBy("n", "p1", "p2").agg(F.min(_node("doc_id")).alias("rep"), F.count(F.lit(1)).alias("m"))
        self.groups = save(groups, "groups")
        one = self.groups.select(F.floor(F.col("rep.rid") / PER_CHUNK).alias("cid"), (F.col("rep.rid") % PER_CHUNK).cast("int").alias("place")).groupBy("cid").agg(F.collect_list("place").alias("one"))
        self.one = save(one, "one")
        self.shared = save(shared_counts(self.chunks.joined(self.one).mapInArrow(send, SENT), n_buckets), "shared")

    def _postings(self) -> DataFrame:
        width, percent, rare, large = self.width, self.percent, self.rare, self.large

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                known, counts = opened_counts(row["shared"])
                if not len(known) or not row["one"]:
                    continue
                ids, buf, off = opened(row)
                doc, h = distinct_per_text(*shingle_hashes(buf, off, width))
                size = np.bincount(doc, minlength=len(ids))
                mine = np.isin(doc, row["one"])
                doc, h = doc[mine], h[mine]
                count = looked_up(short(h), known, counts)
                docs, keys, most = prefix_keys(doc, h, count, len(ids), percent, rare, large)
                typical = np.bincount(doc, count, len(ids)) / np.maximum(size, 1)
                unknown = ~known_ids(row)
                for at in range(0, len(keys), 500_000):
                    d = docs[at : at + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500_000].view(np.int64)), pa.array(row["cid"] * PER_CHUNK + d), pa.array(ids[d], mask=unknown[d]), pa.array(size[d].astype(np.int64)), pa.array(typical[d]), pa.array(most[at : at + 500_000].astype(np.int64))], ["key", "rid", "doc_id", "n", "w", "most"])

        return self.chunks.joined(self.one, self.shared).mapInArrow(index, "key long, rid long, doc_id long, n long, w double, most long")

    def _needed_sets(self, rids: DataFrame) -> DataFrame:
        width = self.width

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                if not row["places"]:
                    continue
                places = np.array(sorted(row["places"]))
                _, buf, off = opened(row)
                buf, off = texts_at(buf, off, places)
                h, bounds = shingle_hashes(buf, off, width)
                doc, h, g = distinct_per_text(h, bounds, shingle_hashes(buf, off, width, 1)[0])
                cut = np.searchsorted(doc, np.arange(len(places) + 1))
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row["cid"] * PER_CHUNK + places), pa.array([pack_sorted(h[a:b]) for a, b in spans], pa.binary()), pa.array([g[a:b].tobytes() for a, b in spans], pa.binary())], ["rid", "tokens", "more"])

        places = rids.select(F.floor(F.col("rid") / PER_CHUNK).alias("cid"), (F.col("rid") % PER_CHUNK).cast("int").alias("place")).groupBy("cid").agg(F.collect_list("place").alias("places"))
        return self.chunks.joined(places).where("places is not null").mapInArrow(take, "rid long, tokens binary, more binary")

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs of nodes (a, b), those that link."""
        percent = self.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = lambda x, y: (unpack_sorted(x.as_py()), np.frombuffer(y.as_py(), np.uint64))
            for batch in batches:
                keep, last, left = [], None, None
                rid = batch.column(0).field("rid").to_pylist()
                for i in range(batch.num_rows):
                    if rid[i] != last:
                        last, left = rid[i], tokens(batch.column(2)[i], batch.column(3)[i])
                    right = tokens(batch.column(4)[i], batch.column(5)[i])
                    common = common_tokens(left, right)
                    keep.append(100 * common >= percent * (len(left[0]) + len(right[0]) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        sets = lambda side: self.sets.select(F.col("rid").alias(f"r_{side}"), F.col("tokens").alias(f"t_{side}"), F.col("more").alias(f"u_{side}")).hint("merge")
        keyed = pairs.select("a", "b", F.col("a.rid").alias("r_a"), F.col("b.rid").alias("r_b"))
        both = keyed.join(sets("b"), "r_b").join(sets("a"), "r_a").select("a", "b", "t_a", "u_a", "t_b", "u_b")
        return self.scratch.save(both.mapInArrow(check, f"a {_NODE}, b {_NODE}"), name)

    def _link(self) -> DataFrame:
        """(node, root) over the representatives of equal sets, as nodes (see _node)."""
        save = self.scratch.save
        raw = save(self._postings(), "postings-all")
        keys = save(raw.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "keys")
        post = save(join_groups(raw, keys, ["key"], "m").select("key", _node("doc_id").alias("node"), "n", "w", "most"), "left-0")
        self.scratch.drop("postings-all")
        self.sets = save(self._needed_sets(post.select("node.rid").distinct()), "sets")
        self.chunks.drop()
        roots, left = self._round(post.withColumn("root", F.col("node")), None, 1, 0)
        k = 1
        while True:
            sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
            if (sizes.agg(F.max("m")).first()[0] or 0) <= WHOLE:
                break
            sizes = save(sizes, f"sizes-{k}")
            large = join_groups(left, sizes.where(F.col("m") > WHOLE), ["key"], "m")
            small = left.join(sizes.where(F.col("m") <= WHOLE).select("key").hint("merge"), "key", "left_semi")
            roots, rest = self._round(save(large, f"large-{k}"), roots, PIVOTS, k)
            left = save(small.unionByName(rest), f"left-{k + 1}")
            k += 1
        return self._pairwise(left, roots, k)

    def _fits(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """Two entries of a key that may link: in different components, sizes close enough, and enough left to share after what comes before the key in either order."""
        near = (a("n") * 100 >= b("n") * self.percent) & (b("n") * 100 >= a("n") * self.percent)
        return (a("root") != b("root")) & near & (F.least(a("most"), b("most")) * (100 + self.percent) >= (a("n") + b("n")) * self.percent)

    def _linked(self, pairs: DataFrame, roots: DataFrame | None, k: int) -> DataFrame:
        """The roots after the links among the pairs (a, b) that aren't tried yet are added."""
        pairs = self.scratch.save(pairs.join(self.tried.hint("merge"), ["a", "b"], "left_anti") if self.tried is not None else pairs, f"pairs-{k}")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if roots is not None and pairs.isEmpty():
            return roots
        edges = self._verify(pairs, f"links-{k}")
        if roots is not None:
            edges = edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return components(edges, self.scratch, f"components-{k}")

    def _round(self, left: DataFrame, roots: DataFrame | None, pivots: int, k: int) -> tuple[DataFrame, DataFrame]:
        """Tries the entries of each key against its first so many, the most typical ones. Then roots, and the other entries of keys that are still in different components."""
        save, order, p = self.scratch.save, F.struct((-F.col("w")).alias("w"), "node"), F.col("p")
        place = F.row_number().over(Window.partitionBy("key").orderBy(order))
        first = left.withColumn("place", place).where(F.col("place") <= pivots).groupBy("key").agg(F.collect_list(F.struct(order.alias("at"), "node", "n", "most", "root")).alias("ps"), F.max(order).alias("last"))
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        hot, placed = hot_bound(sizes, "m") is not None, left.withColumn("at", order)
        met = join_groups(placed, save(first.join(sizes.hint("merge"), "key"), f"pivots-{k}"), ["key"], "m") if hot else placed.join(first.hint("merge"), "key")
        pairs = met.withColumn("p", F.explode("ps")).where((F.col("at") > p["at"]) & self._fits(F.col, lambda c: p[c])).select(F.least("node", p["node"]).alias("a"), F.greatest("node", p["node"]).alias("b")).distinct()
        roots = self._linked(pairs, roots, k)
        rest = met.where("at > last").select("key", "node", "n", "w", "most").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        if hot:
            rest = save(rest, f"rest-{k}")
            apart = rest.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("m")).where("r1 <> r2").select("key", "m")
            rest = join_groups(rest, save(apart, f"apart-{k}"), ["key"], "m")
        else:
            whole = Window.partitionBy("key")
            rest = rest.withColumns({"r1": F.min("root").over(whole), "r2": F.max("root").over(whole)}).where("r1 <> r2").drop("r1", "r2")
        return roots, save(rest, f"next-{k}")

    def _pairwise(self, left: DataFrame, roots: DataFrame, k: int) -> DataFrame:
        """The roots after the entries of each key, WHOLE at most, are tried against each other."""
        side = lambda x: left.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "most", "root")])
        met = side("a").join(side("b").hint("merge"), "key").where((F.col("node_a") < F.col("node_b")) & self._fits(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
        return self._linked(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), roots, k)

    def groups_of(self) -> DataFrame:
        """rid, doc_id, n_shingles, component_id, is_first: a row per row of the documents.

        component_id is the smallest doc_id reachable by links; documents without words are by themselves. Rows
        repeated under one doc_id are linked like any equal rows. Null doc_ids count as larger than any other: a
        component of nothing else has none. is_first marks one row of each component, that with the smallest
        doc_id (then the smallest row number).
        """
        try:
            self._sets()
            return self._named(self._link())
        finally:
            self.chunks.drop()
            for name in self.scratch.tables():
                if name != "result":
                    self.scratch.drop(name)

    def _named(self, roots: DataFrame) -> DataFrame:
        named = self.groups.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("n", "p1", "p2", F.coalesce("root", "rep").alias("root"), "m")
        named = self.scratch.save(named, "named")
        out = join_groups(self.rows.where("n > 0"), named, ["n", "p1", "p2"], "m").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(~F.col("root.none"), F.col("root.doc")).alias("component_id"), (F.col("rid") == F.col("root.rid")).alias("is_first"))
        blank = self.rows.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
        return self.scratch.save(out.unionByName(blank), "result")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rare: int = RARE, large: int = LARGE) -> DataFrame:
    """The components of docs (doc_id, text) under Jaccard similarity of percent / 100 or more; see ShingleJoin.groups_of."""
    return ShingleJoin(docs, width, percent, rare, large).groups_of()
