"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by
similarity, and a calibration fitted with each example left out of its own vote.

Vectors are plain TF-IDF over every word of the examples (1 + log of the count, times the logarithm of all documents over those
that hold the word, length 1): no word is left out of vectors, bounds or postings. What the labels say of a word enters the vote
alone: beside the share of toxic neighbours by similarity there is a second one, by the part of each cosine that comes from words
relevant to label 1 (lower confidence bound of the log odds among the examples, less a margin). Words are known by 64 bits of hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, payload, ranges, small_batches
from .features import word_hashes

#: The index holds about so many examples of each label at most, chosen by a hash of doc_id, and so many bytes of their texts; a vote
#: counts for all the rows that its example stands for. A text of over LONGEST bytes is no example (it is scored whole, as any).
EXAMPLES = {1: 1024, 0: 3072}
EXAMPLE_BYTES = {1: 8 << 20, 0: 24 << 20}
LONGEST = 1 << 20
#: Standard errors that the bound of a term's log odds lies below them, and how many times as common in toxic examples a term
#: must be by that bound to be relevant: documents of one label can be longer, which makes every word a little more common.
CAUTION, TIMES = 2.33, 1.35
NEIGHBOURS = 15
BLOCK = 64
#: Similarity that the prior's vote has, and what is added to the relevant part before its logarithm is taken.
PRIOR = FLOOR = 1e-3
#: Cells, or postings, that are summed at once.
CELLS = 1 << 20
#: Words in most examples have full lists, a weight for every example, unless that would be over so many times their postings.
FULL, THIN = 512, 32
#: What sums of full lists may be off by; cosines that are so near the k-th best are summed again, term by term.
SLACK = 1e-12
#: Words in most examples, by which blocks are made alike.
COMMON = 256


def cells(owner: np.ndarray, terms: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of occurrences, sorted by row and term; size is the number of terms."""
    cell, counts = np.unique(owner.astype(np.int64) * size + terms, return_counts=True)
    return cell // max(size, 1), cell % max(size, 1), counts


def weights(row: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of cells, in rows of length 1, and each row's length before."""
    w = (1 + np.log(counts)) * idf[term]
    length = np.sqrt(np.bincount(row, w * w, n))
    return w / np.maximum(length, 1e-150)[row], length


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to smaller ids, sorted by row and rank; with slack, those less by it than the k-th, too."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    opens = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(opens, len(rows)))
    keep = np.arange(len(rows)) - np.repeat(opens, sizes) < k
    if slack and len(rows):
        keep |= scores >= np.repeat(scores[opens + np.minimum(sizes, k) - 1], sizes) - slack
    return rows[keep], ids[keep], scores[keep]


@dataclass
class Index:
    """Postings (example, weight) by cell, a term's part of a block of BLOCK examples; cells by term and block, each with
    the greatest weight in it. The commonest terms' postings are added up from full lists, all rows of a batch at once."""

    terms: np.ndarray  # hashes of the words, ascending
    idf: np.ndarray
    relevance: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    heads: np.ndarray  # where a term's cells begin
    block: np.ndarray  # a cell's block
    most: np.ndarray  # a cell's greatest weight
    starts: np.ndarray  # where a cell's postings begin
    examples: np.ndarray
    weight: np.ndarray
    prior: float = 0.0
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0)  # factors of features(), the last one a constant

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}  # what can be derived isn't sent

    @cached_property
    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each term's full list or -1; the lists' weights (block, list, example of the block); their greatest weights (list, block)."""
        blocks, n = max(1, -(-len(self.ids) // BLOCK)), self.starts[self.heads[1:]] - self.starts[self.heads[:-1]]
        some = np.argsort(-n, kind="stable")[:FULL]
        some = some[n[some] * THIN > len(self.ids)]
        column = np.full(len(n), -1)
        column[some] = np.arange(len(some))
        lists = np.zeros((blocks, len(some), BLOCK))
        post = ranges(self.starts[self.heads[some]], n[some])
        lists[self.examples[post] // BLOCK, np.repeat(np.arange(len(some)), n[some]), self.examples[post] % BLOCK] = self.weight[post]
        return column, lists, lists.max(2, initial=0.0).T.copy()

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each example's terms begin, the terms in order, and their weights; and each example's first equal one."""
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.starts[self.heads[1:]] - self.starts[self.heads[:-1]])
        order = np.argsort(self.examples, kind="stable")
        starts, term, weight = np.searchsorted(self.examples[order], np.arange(len(self.ids) + 1)), term[order], self.weight[order]
        first: dict[bytes, int] = {}
        same = [first.setdefault(hashlib.blake2b(term[a:z].tobytes() + weight[a:z].tobytes(), digest_size=32).digest(), e) for e, (a, z) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False))]
        return starts, term, weight, np.array(same, np.int64)

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF rows of a batch of texts, as (row, term, weight) sorted by row, and each row's length before."""
        row, term, counts = cells(*known_words(data, offsets, self.terms), len(self.terms))
        return row, term, *weights(row, term, counts, len(offsets) - 1, self.idf)

    def nearest(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, example, cosine): for each of n sparse rows the k examples of the largest cosine above zero, ties to the
        earlier, nearest first. Rows go through their blocks by falling bound, until no block's bound can beat the row's
        k-th best. without: an example for each row that it doesn't find."""
        blocks = max(1, -(-len(self.ids) // BLOCK))
        column, lists, _ = self.full
        counts = (self.heads[1:] - self.heads[:-1])[term] * (column[term] < 0)
        load = np.concatenate([[0], np.cumsum(np.bincount(row, counts, n) + blocks + lists.shape[1])])  # cells that rows need
        found, at = [], 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(load, load[at] + CELLS, "right")) - 1)
            a, z = np.searchsorted(row, [at, end])
            found.append(self._nearest(row[a:z] - at, term[a:z], w[a:z], at, end - at, k, without, blocks))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, low: int, n: int, k: int, without: np.ndarray | None, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column, lists, tops = self.full
        listed = column[term] >= 0
        dense = np.zeros((n, lists.shape[1]))
        dense[row[listed], column[term[listed]]] = w[listed]
        words, (row, term, w) = (row, term, w), (x[~listed] for x in (row, term, w))
        counts = (self.heads[1:] - self.heads[:-1])[term]
        cell, q = ranges(self.heads[term], counts), np.repeat(w, counts)
        place = np.repeat(row * blocks, counts) + self.block[cell]  # (row, block) as a number
        begins = np.searchsorted(row, np.arange(n + 1))  # where a row's cells begin
        begins = np.concatenate([[0], np.cumsum(counts)])[begins]
        length = self.starts[cell + 1] - self.starts[cell]
        bound = np.bincount(place, q * self.most[cell], n * blocks).reshape(n, blocks) + dense @ tops
        load = np.bincount(place, length, n * blocks) + BLOCK
        rank = np.empty((n, blocks), np.int64)
        np.put_along_axis(rank, np.argsort(-bound, 1, kind="stable"), np.arange(blocks)[None, :], 1)
        out, kth, at, wave = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(n), 0, max(2, -(-2 * k // BLOCK))
        number = np.full(n * blocks, -1)
        while at < blocks:
            chosen = np.flatnonzero(((rank >= at) & (rank < at + wave) & (bound >= kth[:, None] - 2 * SLACK) & (bound > 0)).ravel())
            if not len(chosen):
                break  # bounds fall from wave to wave, and the k-th best don't
            found = [out]
            ends = np.cumsum(load[chosen])
            for some in np.split(chosen, np.unique(np.searchsorted(ends, np.arange(CELLS, ends[-1], CELLS)))):
                if not len(some):
                    continue
                number[some] = np.arange(len(some))
                a, z = begins[some[0] // blocks], begins[some[-1] // blocks + 1]
                mine = a + np.flatnonzero(number[place[a:z]] >= 0)
                post = ranges(self.starts[cell[mine]], length[mine])
                slot = np.repeat(number[place[mine]] * BLOCK, length[mine]) + self.examples[post] % BLOCK
                total = np.bincount(slot, np.repeat(q[mine], length[mine]) * self.weight[post], len(some) * BLOCK).astype(float, copy=False)  # of nothing it is of integers
                number[some] = -1
                by_block = np.argsort(some % blocks, kind="stable")
                for own in np.split(by_block, np.flatnonzero(np.diff(some[by_block] % blocks)) + 1):
                    total.reshape(-1, BLOCK)[own] += dense[some[own] // blocks] @ lists[some[own[0]] % blocks]
                hit = np.flatnonzero(total > np.repeat(kth[some // blocks], BLOCK) - 2 * SLACK)
                hit = hit[total[hit] > 0]
                rows, ids = some[hit // BLOCK] // blocks, some[hit // BLOCK] % blocks * BLOCK + hit % BLOCK
                if without is not None:
                    other = without[rows + low] != ids
                    rows, ids, hit = rows[other], ids[other], hit[other]
                found.append((rows, ids, total[hit]))
            out = best(*(np.concatenate(x) for x in zip(*found, strict=True)), k, 2 * SLACK)
            opens = np.searchsorted(out[0], np.arange(n + 1))
            full = np.diff(opens) >= k
            kth[full] = out[2][opens[:-1][full] + k - 1]
            at, wave = at + wave, wave * 2
        out = best(*out[:2], self.cosines(*words, *out[:2]), k)
        return out[0] + low, out[1], out[2]

    def cosines(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The cosine of each pair (row of sparse rows, example). Products are added in the order of terms."""
        starts, terms, weight, same = self.forward
        asked, back = np.unique(of * len(self.ids) + same[ids], return_inverse=True)
        of, ids = asked // max(len(self.ids), 1), asked % max(len(self.ids), 1)
        out, own = np.zeros(len(of)), np.zeros(len(self.terms))
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        begins, ends = np.searchsorted(row, of[edges[:-1]]), np.searchsorted(row, of[edges[:-1]], "right")
        for x, y, a, z in zip(edges.tolist(), edges[1:].tolist(), begins.tolist(), ends.tolist(), strict=False):
            own[term[a:z]] = w[a:z]
            count = starts[ids[x:y] + 1] - starts[ids[x:y]]
            post = ranges(starts[ids[x:y]], count)
            out[x:y] = np.bincount(np.repeat(np.arange(y - x), count), own[terms[post]] * weight[post], y - x)
            own[term[a:z]] = 0.0
        return out[back]

    def relevant(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """For each neighbour (row, example, cosine): its cosine's terms, each times the relevance of its word."""
        n, out = len(self.ids), np.zeros(len(near[0]))
        asked = near[0] * n + near[1]
        order = np.argsort(asked)
        asked = asked[order]
        told = np.flatnonzero(self.relevance[term] > 0)
        row, term, w = row[told], term[told], w[told]
        first, last = self.starts[self.heads[term]], self.starts[self.heads[term + 1]]
        ends = np.cumsum(last - first)
        for some in np.split(np.arange(len(row)), np.unique(np.searchsorted(ends, np.arange(CELLS, ends[-1] if len(ends) else 0, CELLS)))):
            length = (last - first)[some]
            post = ranges(first[some], length)
            key = np.repeat(row[some] * n, length) + self.examples[post]
            at = np.minimum(np.searchsorted(asked, key), max(len(asked) - 1, 0))
            hit = np.flatnonzero(asked[at] == key) if len(asked) else np.zeros(0, np.int64)
            out += np.bincount(at[hit], (np.repeat((w * self.relevance[term])[some], length) * self.weight[post])[hit], len(asked))
        back = np.empty(len(out))
        back[order] = out
        return back

    def features(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, length: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Log odds of the neighbours' votes weighted by similarity squared, and of those weighted by the relevant part of it; the logarithms
        of the greatest relevant part that a toxic neighbour has and of the length; and 1."""
        of, ids, scores = near
        n, part = len(length), self.relevant(row, term, w, near)
        shares = []
        for v in (self.votes[ids] * scores * scores, self.votes[ids] * part):
            share = (np.bincount(of, v * self.labels[ids], n) + PRIOR * self.prior) / (np.bincount(of, v, n) + PRIOR)
            share = np.clip(share, 1e-4, 1 - 1e-4)
            shares.append(np.log(share / (1 - share)))
        most = np.zeros(n)
        np.maximum.at(most, of, self.labels[ids] * part)
        return np.stack([*shares, np.log(most * length + FLOOR), np.log1p(length), np.ones(n)], 1)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30)))


def known_words(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and index in terms (hashes, ascending) of every occurrence of one of them."""
    owner, h = word_hashes(data, offsets)
    if not len(terms):
        return owner[:0], owner[:0]
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == h)
    return owner[hit], at[hit]


def alike(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, size: int) -> np.ndarray:
    """A cluster for each of n rows, by the words that most rows have: blocks of like examples have low bounds for unlike texts."""
    common = np.argsort(-np.bincount(term, minlength=size), kind="stable")[:COMMON]
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    dense = np.zeros((n, len(common)), np.float32)
    seen = column[term] >= 0
    dense[row[seen], column[term[seen]]] = w[seen]
    k = max(1, n // (4 * BLOCK))
    centres = dense[np.arange(k) * n // k]
    for _ in range(8):
        cluster = np.argmin((centres * centres).sum(1)[None, :] - 2 * dense @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cluster, dense)
        centres = sums / np.maximum(np.bincount(cluster, minlength=k), 1)[:, None].astype(np.float32)
    return cluster


def build(terms: np.ndarray, idf: np.ndarray, relevance: np.ndarray, ids: np.ndarray, labels: np.ndarray, votes: np.ndarray, row: np.ndarray, term: np.ndarray, counts: np.ndarray) -> Index:
    """An index of examples, whose cells (row, term, count) are sorted by row and term, and its calibration."""
    n = len(ids)
    w, length = weights(row, term, counts, n, idf)
    place = np.empty(n, np.int64)
    arrangement = np.lexsort((ids, alike(row, term, w, n, len(idf)))) if n else place
    place[arrangement] = np.arange(n)
    ids, labels, votes, length, row = ids[arrangement], labels[arrangement], votes[arrangement], length[arrangement], place[row]
    by_row = np.lexsort((term, row))
    row, term, w = row[by_row], term[by_row], w[by_row]
    blocks = max(1, -(-n // BLOCK))
    order = np.lexsort((row, term))
    cell, starts = np.unique(term[order] * blocks + row[order] // BLOCK, return_index=True)
    most = np.maximum.reduceat(w[order], starts) if len(w) else w
    heads = np.searchsorted(cell, np.arange(len(idf) + 1) * blocks)
    index = Index(terms, idf, relevance, ids, labels, votes, heads, cell % blocks, most, np.append(starts, len(w)), row[order], w[order])
    index.prior = float((votes * labels).sum() / votes.sum()) if n else 0.0
    if n and 0 < labels.sum() < n:  # a logistic curve over what the examples get from the others
        x = index.features(row, term, w, length, index.nearest(row, term, w, n, NEIGHBOURS, np.arange(n)))
        theta = start = np.array(index.curve)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            h = (x * (votes * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(theta))
            theta = theta - np.linalg.solve(h, x.T @ (votes * (p - labels)) + 1e-2 * (theta - start))
        if np.isfinite(theta).all() and theta[:3].max() > 0:
            index.curve = tuple(theta.tolist())
    for derived in ("full", "forward"):  # the driver has no more use for them
        index.__dict__.pop(derived, None)
    return index


def _bags(docs: DataFrame) -> DataFrame:
    """(row columns of docs, terms, counts): the distinct words of each text, by hash, and how often each occurs."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 4 << 20):
                owner, h = word_hashes(*payload(batch.column("text")))
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                edges = pa.array(np.searchsorted(owner[first], np.arange(len(batch) + 1)).astype(np.int32))
                counts = np.diff(np.append(first, len(h))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (h[first], counts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], [*keep, "terms", "counts"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), "terms array<long>", "counts array<int>"])
    return docs.mapInArrow(run, schema)


def _document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of docs (text), and of those that hold each term."""
    asked = docs.sparkSession.sparkContext.broadcast(terms)
    everywhere = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        df, rows = np.zeros(len(known), np.int64), 0
        for whole in batches:
            for batch in by_bytes(whole, "text", 4 << 20):
                _, term, _ = cells(*known_words(*payload(batch.column("text")), known), len(known))
                df += np.bincount(term, minlength=len(known))
                rows += len(batch)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(df[held], rows), pa.int64())], ["term", "n"])

    # One row a term at most, and the terms are those of a bounded sample.
    found = everywhere.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(terms) + 1, np.int64)  # the last place is that of -1
    df[term] = n
    return int(df[-1]), df[:-1]


def train(docs: DataFrame, labels: DataFrame, examples: dict[int, int] | None = None) -> Index:
    """An index of examples from docs (doc_id, text) and labels (doc_id, toxic); document frequencies come from all docs.

    Null ids, texts and labels teach nothing; of several labels of a doc_id the largest counts. Empty tables give an index that finds
    nothing. Columns other than those named are left out."""
    small_batches(docs.sparkSession)
    examples = examples or EXAMPLES
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {t: min(1.0, examples[t] / n) for t, n in counts.items()}

    def drawn(rates: dict[int, float], salt: int) -> Column:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) / (1 << 20)
        return F.when(F.col("toxic") == 1, draw < rates.get(1, 1.0)).otherwise(draw < rates.get(0, 1.0))

    # EXAMPLES bounds these rows of two numbers each, whatever the input; of several texts of a doc_id one is an example.
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known.where(drawn(rate, 1))), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(sample.where(F.octet_length("text") <= LONGEST), "examples")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    thin = {t: min(1.0, EXAMPLE_BYTES[t] / max(n, 1)) for t, n in sizes.items()}
    rows = _bags(sample.where(drawn(thin, 2)).select("doc_id", "toxic", "text")).toArrow().combine_chunks().sort_by("doc_id")
    label = rows.column("toxic").to_numpy().astype(np.float64)
    lists = [rows.column(c).combine_chunks() for c in ("terms", "counts")]
    owner = np.repeat(np.arange(len(rows)), lists[0].value_lengths().to_numpy())
    terms, term = np.unique(lists[0].flatten().to_numpy(), return_inverse=True)
    many = lists[1].flatten().to_numpy()
    order = np.lexsort((term, owner))
    owner, term, many = owner[order], term[order], many[order]
    bad, good = (np.bincount(term, is_one, len(terms)) for is_one in (label[owner], 1 - label[owner]))
    odds = np.log((bad + 0.5) / (good + 0.5) * ((len(label) - label.sum() + 1) / (label.sum() + 1)))
    relevance = np.maximum(odds - CAUTION * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)) - np.log(TIMES), 0)
    n, df = _document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + df)) + 1e-6
    votes = np.array([1 / (rate.get(t, 1.0) * thin.get(t, 1.0)) for t in rows.column("toxic").to_pylist()], np.float64)
    return build(terms, idf, relevance, rows.column("doc_id").to_numpy(), label, votes, owner, term, many)


def score(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, evidence, similarity) per row of docs (doc_id, text): the chance of label 1, whether
    it reaches the threshold, and the ids and cosines of the nearest examples, nearest first.

    A text without any word of the examples, an empty or a null one gets the prior's score and no evidence. Texts of any length are scored
    whole. Of examples with equal cosines the earlier one in the index is nearer. Repeated rows are scored each, a null doc_id is kept, an
    empty table gives no rows, and columns other than doc_id and text are left out."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # its size is bounded by EXAMPLE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "text", 4 << 20):
                *rows, length = found.vectors(*payload(batch.column("text")))
                near = found.nearest(*rows, len(batch), NEIGHBOURS)
                p = found.calibrated(found.features(*rows, length, near))
                edges = pa.array(np.searchsorted(near[0], np.arange(len(batch) + 1)).astype(np.int32))
                evidence, similarity = (pa.ListArray.from_arrays(edges, pa.array(x)) for x in (found.ids[near[1]].astype(np.int64), near[2]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), evidence, similarity], ["doc_id", "score", "predicted", "evidence", "similarity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>, similarity array<double>")
