"""Jaccard join of word-shingle sets by prefix trees.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of at least 0.75. The work narrows in steps, none of
which can lose a link:

1. Sets travel as packed tokens, dealt by token. Where a token turns up once in all texts, no other text shares it. A text of n
   shingles needs ceil(0.75 n) shared ones, so texts with too many lone tokens leave. Equal sets become one.
2. For the texts left, each token's frequency is counted again and sent back: sets in one global order, rare tokens first, and
   texts that now have too many lone tokens leave.
3. Two linked sets share a token among the first n - ceil(0.75 n) + 1 of each. Neighbours by size under each such token, close enough
   in size, are joined to cells: every link lies within a cell.
4. A cell's sets, tokens now in the order of how many of its sets hold them, are stored in a trie with runs of single nodes joined.
   Each set descends it, and so shares the overlap with a common beginning among all that have it; a subtree goes once the overlap so
   far plus what can still come (the tokens left on either side) is below what its smallest set needs, or if it holds only sets that
   are in one component with the query already. Cells above a bound are dealt out in pairs of tiles.

What comes back are spanning forests of links, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, components, cut, fresh, release, roots, shingle_hashes, table

WIDTH, SHARE = 5, (75, 100)
#: Tokens that a map task packs together, and a reduce task sorts at once, about.
PACK, BUCKET = 500_000, 3_000_000
#: Tokens in a cell, or a group of small cells, at most, before cells are cut into tiles.
CELL = 2_000_000
#: Texts whose ids may be broadcast to find them again; more are found by a shuffled join.
BROADCAST = 500_000

_hashes = WordHashes()


def needed(n):
    """Tokens that a set of n must share with a partner, at least."""
    return -(-SHARE[0] * n // SHARE[1])


def packed(docs: DataFrame, buckets: int, width: int, whole: bool) -> DataFrame:
    """Shingle sets of (id, text), as rows (batch, bucket, doc, n, tokens): numbers of the batch's texts that have tokens in the bucket, how
    many, and the tokens (all 64 bits if whole, else the lower 32), all binary. A row with bucket -1 has the batch's ids, sizes and
    digests of the sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            n = np.array([len(s) for s in sets], np.int64)
            all_tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            bucket = ((all_tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 65536 else np.uint64), kind="stable")
            all_tokens, doc, bucket = all_tokens[order], doc[order], bucket[order]
            edge = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)]):
                if b > a:
                    start = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
                    rows.append((int(bucket[a]), doc[a:b][start].astype(np.uint32).tobytes(), np.diff(start, append=b - a).astype(np.uint32).tobytes(), (all_tokens[a:b] if whole else all_tokens[a:b].astype(np.uint32)).tobytes()))
            digests = b"".join([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets])
            rows.append((-1, np.array(ids, np.int64).tobytes(), n.tobytes(), digests))
            out = pd.DataFrame(rows, columns=["bucket", "doc", "n", "tokens"])
            out.insert(0, "batch", f"{part}:{number}")
            return out

        for b in batches:
            for i, text in zip(b["id"], b["text"]):
                s = shingle_hashes(text, _hashes, width)
                ids.append(i)
                sets.append(s)
                held += len(s) + 8
                if held >= PACK:
                    yield flush()
                    number, ids, sets, held = number + 1, [], [], 0
            del b
        if ids:
            yield flush()
        ids, sets = [], []
        release()

    return docs.mapInPandas(run, "batch string, bucket long, doc binary, n binary, tokens binary")


def frequencies(rows: pd.DataFrame, kind) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of one bucket's rows: text numbers and counts by row, and each token's frequency, in the rows' order."""
    tokens = np.concatenate([np.frombuffer(t, kind) for t in rows["tokens"]])
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(start, append=len(ordered))
    out = np.empty(len(tokens), np.uint32)
    out[order] = np.repeat(times, times)
    return [np.frombuffer(x, np.uint32) for x in rows["doc"]], [np.frombuffer(x, np.uint32) for x in rows["n"]], out


def lone_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: each batch row's texts with how many of their tokens occur nowhere else; rows of bucket -1 as they are."""
    if rows["bucket"].iloc[0] < 0:
        return rows[["batch", "bucket", "doc", "n", "tokens"]]
    docs, counts, f = frequencies(rows, np.uint32)
    out, at = [], 0
    for batch, doc, n in zip(rows["batch"], docs, counts):
        here = f[at : at + int(n.sum())] == 1
        at += len(here)
        alone = np.add.reduceat(here.astype(np.uint32), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)).astype(np.uint32)
        some = alone > 0
        if some.any():
            out.append((batch, 0, doc[some].tobytes(), alone[some].tobytes(), b""))
    return pd.DataFrame(out, columns=["batch", "bucket", "doc", "n", "tokens"])


def with_frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: each row with its tokens' frequencies; rows of bucket -1 as they are."""
    out = rows[["batch", "bucket", "doc", "n", "tokens"]].copy()
    if rows["bucket"].iloc[0] < 0:
        out["times"] = b""
        return out
    _, counts, f = frequencies(rows, np.uint64)
    ends = np.cumsum([int(n.sum()) for n in counts])
    out["times"] = [x.tobytes() for x in np.split(f, ends[:-1])]
    return out


def batch_sizes(rows: pd.DataFrame) -> pd.DataFrame:
    """For one batch: id, n, digest, and the number of lone tokens of each text."""
    own = rows[rows["bucket"] < 0].iloc[0]
    ids, n = np.frombuffer(own["doc"], np.int64), np.frombuffer(own["n"], np.int64)
    alone = np.zeros(len(ids), np.int64)
    for r in rows[rows["bucket"] >= 0].itertuples():
        alone[np.frombuffer(r.doc, np.uint32)] += np.frombuffer(r.n, np.uint32)
    return pd.DataFrame({"id": ids, "n": n, "digest": [own["tokens"][k : k + 16].hex() for k in range(0, 16 * len(ids), 16)], "alone": alone})


def ordered_sets(rows: pd.DataFrame) -> pd.DataFrame:
    """For one batch: id, n and the tokens that others share, in the global order (frequency, token), of texts that can have a partner."""
    own = rows[rows["bucket"] < 0].iloc[0]
    ids, n = np.frombuffer(own["doc"], np.int64), np.frombuffer(own["n"], np.int64)
    parts = rows[rows["bucket"] >= 0]
    columns = ["id", "n", "tokens"]
    if not len(parts):
        return pd.DataFrame({"id": [], "n": [], "tokens": []}, columns=columns)
    doc = np.concatenate([np.repeat(np.frombuffer(r.doc, np.uint32), np.frombuffer(r.n, np.uint32)) for r in parts.itertuples()])
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in parts["tokens"]])
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in parts["times"]])
    shared = times > 1
    doc, tokens, times = doc[shared], tokens[shared], times[shared]
    order = np.lexsort((tokens, times, doc))
    doc, tokens = doc[order], tokens[order]
    ends = np.searchsorted(doc, np.arange(len(ids) + 1))
    keep = [i for i in range(len(ids)) if n[i] and ends[i + 1] - ends[i] >= needed(int(n[i]))]
    return pd.DataFrame({"id": ids[keep], "n": n[keep], "tokens": [tokens[ends[i] : ends[i + 1]].tobytes() for i in keep]}, columns=columns)


def prefixes(buckets: int):
    """For mapInPandas over ordered sets: (bucket, tokens, ids, sizes) of what can be the first shared token, binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            first = []
            for n, t in zip(b["n"], b["tokens"]):
                t = np.frombuffer(t, np.uint64)
                first.append(t[: max(0, len(t) - needed(int(n)) + 1)])  # the lone ones, first of all, are gone already
            tokens, count = np.concatenate(first), [len(x) for x in first]
            ids, sizes = np.repeat(b["id"].to_numpy(np.int64), count), np.repeat(b["n"].to_numpy(np.int64), count)
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order])) + 1
            yield pd.DataFrame([(int(bucket[x[0]]), tokens[x].tobytes(), ids[x].tobytes(), sizes[x].tobytes()) for x in np.split(order, edge) if len(x)], columns=["bucket", "tokens", "ids", "sizes"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges (u, v) from each node to the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), place[: len(a)], place[len(a) :])
    other = root != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[other], "v": nodes[root[other]]})


def neighbours(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket of prefix tokens: a forest joining texts that follow each other by size under one token, if near enough in size."""
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["tokens"]])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
    sizes = np.concatenate([np.frombuffer(x, np.int64) for x in rows["sizes"]])
    order = np.lexsort((ids, sizes, tokens))
    tokens, ids, sizes = tokens[order], ids[order], sizes[order]
    near = (tokens[1:] == tokens[:-1]) & (SHARE[1] * sizes[:-1] >= SHARE[0] * sizes[1:])
    return forest(ids[:-1][near], ids[1:][near])


class Trie:
    """Sets of whole numbers, each in ascending order, as a tree of shared beginnings, with runs of single nodes joined.

    Sets stand in the order of their sequences, so a node is a range of them: (first set, last set + 1, depth above, depth below,
    smallest size, most tokens below it, children). Its run of tokens is that of its first set between the two depths.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        lengths, shared = np.array([len(s) for s in self.sets]), np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = differ[0] if len(differ) else m
        self.nodes: list[tuple] = []
        todo = [(0, len(sets), 0, None)]
        while todo:
            l, r, above, parent = todo.pop()
            if r - l == 1:
                below, cuts = int(lengths[l]), []
            else:
                below = int(shared[l + 1 : r].min())
                cuts = (np.flatnonzero(shared[l + 1 : r] == below) + l + 1).tolist()
            if parent is not None:
                self.nodes[parent][6].append(len(self.nodes))
            todo += [(x, y, below, len(self.nodes)) for x, y in zip([l, *cuts], [*cuts, r])] if cuts else []
            self.nodes.append((l, r, above, below, int(self.sizes[l:r].min()), int(lengths[l:r].max()) - below, []))

    def links(self, queries: list[np.ndarray], sizes: np.ndarray, n_tokens: int, own: np.ndarray, root: np.ndarray, place: np.ndarray) -> None:
        """Find the sets each query links with, but not itself nor sets in one component with it already, and join their components.
        own: the queries' places in root; place: those of the trie's sets. root: a union-find forest, changed in place."""
        held, nodes, of = np.zeros(n_tokens, np.uint8), self.nodes, root[place]
        for q, size, me in zip(queries, sizes.tolist(), own.tolist()):
            mine = root[me]
            held[q] = 1
            # Tokens that the query still has from a token on: it ends where a run starts.
            todo = [(0, 0)] if len(self.sets) and (of != mine).any() else []
            while todo:
                k, overlap = todo.pop()
                l, r, above, below, least, most, children = nodes[k]
                if r - l == 1 and of[l] == mine:
                    continue
                if below > above:
                    overlap += int(held[self.sets[l][above:below]].sum())
                left = min(most, len(q) - overlap)
                if (SHARE[0] + SHARE[1]) * (overlap + left) < SHARE[0] * (size + least):
                    continue
                if r - l == 1:
                    of_other = of[l]
                    low, high = min(mine, of_other), max(mine, of_other)
                    of[of == high] = low
                    root[root == high] = low
                    mine = low
                elif r - l > 8 and (of[l:r] == mine).all():
                    continue
                else:
                    todo += [(c, overlap) for c in children]
            held[q] = 0


def join_sets(sets: list[np.ndarray], sizes: np.ndarray, other: tuple[list[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The component of each set, then of each of other's, by links among the sets, or only by those between the two lists.

    Sets are tokens in any one order; sizes are those of the whole sets, with tokens that were left out as shared by nobody.
    """
    both = sets + (other[0] if other else [])
    size = np.concatenate([sizes, other[1]]) if other else sizes
    names, token, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -times))] = np.arange(len(names))  # the most frequent first
    lone = times == 1
    ends = np.cumsum([0, *map(len, both)])
    ranked = []
    for a, b in zip(ends, ends[1:]):
        t = token[a:b]
        ranked.append(np.sort(rank[t[~lone[t]]]))
    root, live = np.arange(len(both)), [i for i in range(len(both)) if len(ranked[i]) >= needed(int(size[i]))]
    n = len(sets)
    stored, asked = [i for i in live if i < n], [i for i in live if i >= n] if other else [i for i in live if i < n]
    if len(stored) and len(asked):
        trie = Trie([ranked[i] for i in stored], size[stored])
        place = np.array(stored)[trie.order]
        asked.sort(key=lambda i: (-size[i], i))
        trie.links([ranked[i] for i in asked], size[asked], int((~lone).sum()), np.array(asked), root, place)
    return root


def cell_links(rows: pd.DataFrame) -> pd.DataFrame:
    """For a group of cells, or a pair of a cell's tiles: the forest of its links as (u, v). Rows: cell, tile, p, q, id, n, tokens."""
    out = []
    for _, cell in rows.groupby("cell", sort=True):
        cell = cell.sort_values(["tile", "id"])
        ids, n = cell["id"].to_numpy(np.int64), cell["n"].to_numpy(np.int64)
        sets = [np.frombuffer(t, np.uint64) for t in cell["tokens"]]
        if cell["p"].iloc[0] == cell["q"].iloc[0]:
            if len(sets) < 2:
                continue
            root = join_sets(sets, n)
        else:
            k = int((cell["tile"] == cell["p"]).sum())
            if not 0 < k < len(sets):
                continue
            root = join_sets(sets[:k], n[:k], (sets[k:], n[k:]))
        other = np.flatnonzero(root != np.arange(len(root)))
        out.append(forest(ids[other], ids[root[other]]))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []})


def link_texts(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the size of each text's set and the smallest id that links lead to, its own included.

    Texts without words, empty or null, link with nothing. Rows that share an id are one document: its links are those of all of
    its rows, its size is the largest. Rows with a null id are left out. The empty table gives no rows. Texts of any length are read
    whole. Shingles are told apart by 64-bit hashes of theirs, equal sets by 128-bit digests. Other columns are ignored, whatever
    their names.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(2 * spark.sparkContext.defaultParallelism, volume // 6 // BUCKET))
    first = packed(rows, buckets, width, whole=False)
    one = "batch string, bucket long, doc binary, n binary, tokens binary"
    group = F.when(F.col("bucket") < 0, F.xxhash64("batch")).otherwise(F.col("bucket"))
    lone = first.groupBy(group.alias("g"), (F.col("bucket") < 0).alias("own")).applyInPandas(lone_counts, one)
    sizes = cut(lone.groupBy("batch").applyInPandas(batch_sizes, "id long, n long, digest string, alone long"))
    same = sizes.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("alone").alias("alone"))
    left = cut(same.where(F.col("alone") <= F.col("n") - F.expr(f"ceil({SHARE[0]} * n / {SHARE[1]})")).select(F.col("rep").alias("id"), "digest"))
    found = left.select("id").distinct()
    n_left = left.count()
    kept = rows.join(F.broadcast(found) if n_left <= BROADCAST else found, "id")

    tokens = packed(kept, buckets, width, whole=True)
    counted = tokens.groupBy(group.alias("g"), (F.col("bucket") < 0).alias("own")).applyInPandas(with_frequencies, one + ", times binary")
    sets = cut(counted.groupBy("batch").applyInPandas(ordered_sets, "id long, n long, tokens binary"))
    near = sets.mapInPandas(prefixes(buckets), "bucket long, tokens binary, ids binary, sizes binary").groupBy("bucket").applyInPandas(neighbours, "u long, v long")
    cells = components(near).select(F.col("node").alias("id"), F.col("component").alias("cell"))
    members = sets.join(cells, "id").withColumn("size", F.octet_length("tokens") / 8)
    per_cell = members.groupBy("cell").agg(F.ceil(F.sum("size") / CELL).cast("long").alias("tiles"), F.sum("size").alias("held"))
    groups = int(max(1, (per_cell.where("tiles = 1").agg(F.sum("held")).first()[0] or 0) // (CELL // 4), spark.sparkContext.defaultParallelism * 2))
    placed = members.join(per_cell, "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    p, q = F.least("tile", "other"), F.greatest("tile", "other")
    g = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cell"), F.lit(groups))).otherwise(F.xxhash64("cell", p, q))
    placed = placed.select(g.alias("g"), (F.col("tiles") == 1).alias("small"), "cell", "tile", p.alias("p"), q.alias("q"), "id", "n", "tokens")
    links = placed.groupBy("small", "g").applyInPandas(cell_links, "u long, v long")
    # Copies, equal sets and rows of one id: each joins its set's representative.
    copies = sizes.where("n > 0").join(same.select("digest", "rep"), "digest").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    whole = components(links.unionByName(copies.where("u <> v")))
    out = sizes.groupBy("id").agg(F.max("n").alias("n_shingles"))
    out = out.join(whole, out["id"] == whole["node"], "left").select(out["id"].cast(kind).alias(id_col), "n_shingles", F.coalesce("component", out["id"]).cast(kind).alias("component_id"))
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, as they are, with columns of any name; rows with a null id stay too."""
    (gone_,) = fresh(docs, "gone")
    gone = link_texts(docs, id_col=id_col, text_col=text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_))
    return docs.join(gone, docs[id_col] == gone[gone_], "left_anti")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """link_texts() of documents: one row for each document."""
    return link_texts(table(spark, sf_dir, "documents"))
