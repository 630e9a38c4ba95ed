"""Subject areas of documents by bisecting k-means over document vectors.

1. Documents become sequences of hashed terms with sentence ends (words; character pairs of Han text).
2. Their tf-idf vectors, projected by fixed random signs and normalised, are clustered by bisecting spherical
   k-means over all documents.  A level of the tree takes two passes: one splits every chosen leaf along its
   first principal axis, one reassigns by the centres of the halves and gathers the moments of the next level.
   Only sums per leaf leave the executors.
3. Each leaf gets log-odds weights of its terms against the corpus.  Sentences are assigned to the leaf whose
   discriminative terms they hold; the weights are estimated once more from those sentences, as documents about
   two subjects blur the first ones.
4. A leaf is named by comparing its discriminative terms with those of the labelled documents of each subject,
   together with the labels of the documents it covers.  Labels may be wrong or disagree; each rater of a
   document counts its share.  At most ``max_labelled`` labelled documents are used (those of smallest hash),
   the words of the subject descriptions count as one more document each.
5. A document is about the subjects whose leaves hold at least ``share`` of its terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread, staged

#: Size of the term space, of the projected vectors and the number of leaves.
TERMS, DIM, LEAVES = 1 << 16, 64, 256
#: Tokens held and sentences scored at a time; the scores of so few sentences stay in the cache.
CHUNK, SCORED = 1 << 14, 1 << 8
#: Least divergence of a term that tells leaves apart.
TELLING = 1.0
#: Partial sums added up at a time.
FAN_IN = 64
#: Terms looked at together on the driver.
BLOCK = 1 << 12
#: Columns of the token table: distinct terms with counts, and the sequence.
TF, SEQUENCE = ("doc_id", "terms", "n"), ("doc_id", "toks")
#: Levels of the tree whose halves are reassigned by their centres; deeper ones keep the axis that split them.
REFINED = 24
#: Power of the size in the spread of a leaf.
ROOT = 0.5
#: A level splits the leaves of at least this multiple of the mean spread.
ABOVE = 0.5
#: Documents of which labels are used at most.
MAX_LABELLED = 20_000
_POINT = re.compile(r"\.(?=\d)")
_PART = re.compile(r"[㐀-鿿]+|[^\W\d_]+")
_ENDS = frozenset("!?。！？\n.")
_CACHE_LIMIT = 500_000
_cache: dict[str, int | list[int]] = {}


class _Plain(dict):
    """For ``translate``: letters, digits and ``_`` stay, ends of sentences become ``!``, all else a blank."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        out = self[code] = code if ch.isalnum() or ch == "_" else ord("!" if ch in _ENDS else " ")
        return out


_plain = _Plain()
_ASCII = bytes(_plain[c] if c < 128 else 0 for c in range(256))


@cache
def _plane() -> np.ndarray:
    return np.array([_plain[c] for c in range(1 << 16)], np.uint32)


def _plain_text(text: str) -> str:
    """``text.translate(_plain)``, by a table for all characters of a text at once."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text.translate(_plain) if codes.max() > 0xFFFF else _plane()[codes].tobytes().decode("utf-32-le")


def _tokens(text: str) -> list[str]:
    """Runs of letters, digits and ``_`` in lower case, and a ``!`` for each end of a sentence; a point before a digit is none."""
    return _plain_text(_POINT.sub(" ", text.lower())).replace("!", " ! ").split()


def _term(w: str) -> int | list[int]:
    """Terms of a token: one, or a list; -1 for the end of a sentence, -2 for a number."""
    if w in _ENDS:
        return -1
    out: list[int] = []
    for part in _PART.findall(w):
        pieces = [part[i : i + 2] for i in range(max(1, len(part) - 1))] if "㐀" <= part[0] <= "鿿" else [part]
        out += [zlib.crc32(x.encode()) % TERMS for x in pieces]
    return out if len(out) > 1 else out[0] if out else -2


def terms_of(text: str) -> np.ndarray:
    """Hashed terms in order; -1 ends a sentence and the text."""
    if len(_cache) > _CACHE_LIMIT:
        _cache.clear()
    words = _tokens(text)
    words.append(".")
    found = list(map(_cache.get, words))
    try:
        out = np.array(found, np.int32)
    except (TypeError, ValueError):  # new or manifold tokens
        flat: list[int] = []
        for w, v in zip(words, found):
            if v is None:
                v = _cache[w] = _term(w)
            if type(v) is int:
                flat.append(v)
            else:
                flat += v
        out = np.array(flat, np.int32)
    return out[out != -2]


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 512):
            part = b.slice(lo, 512)
            toks = [terms_of(t) for t in part.column(1).to_pylist()]
            tok, doc = np.concatenate(toks), np.repeat(np.arange(len(toks)), [len(t) for t in toks])
            real = tok >= 0
            key, n = np.unique((doc[real] * TERMS + tok[real]).astype(np.int32), return_counts=True)  # 512 documents fit 32 bits
            cuts = np.searchsorted(key // TERMS, np.arange(1, len(toks)))
            terms, counts = (np.split(v.astype(np.int32), cuts) for v in (key % TERMS, n))
            cols = [pa.array([v.tobytes() for v in x], pa.binary()) for x in (toks, terms, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "toks", "terms", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Whole documents: ids, the document of each entry, and the other columns, as many as were selected."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        cols = [[np.frombuffer(t, np.int32) for t in b.column(i).to_pylist()] for i in range(1, b.num_columns)]
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(cols[0][end]) <= CHUNK):
                size += len(cols[0][end])
                end += 1
            yield ids[at:end], np.repeat(np.arange(end - at), [len(t) for t in cols[0][at:end]]), [np.concatenate(c[at:end]) for c in cols]
            at = end


def _within(total, groups: int):
    return lambda pdf: total(pdf).assign(part=pdf["part"].iloc[0] % groups)


def _summed(partials: DataFrame, parts: int, key: str, total, kind: str) -> DataFrame:
    """Partial sums of each key added up in levels, so that no group has more than about ``FAN_IN`` rows.

    ``partials`` have, besides the columns of ``kind``, the number ``part`` of the task that made them, and ``parts`` is about how
    many tasks there are.  ``total`` adds the rows of one group.
    """
    columns = [c.split()[0] for c in kind.split(", ")]
    groups = 1
    while groups * FAN_IN < parts:
        groups *= FAN_IN
    while groups > 1:  # the part of a sum is the group it was made in
        partials = partials.groupBy(key, F.pmod("part", F.lit(groups)).alias("_group")).applyInPandas(_within(total, groups), f"{kind}, part int")
        groups //= FAN_IN
    return partials.select(*columns).groupBy(key).applyInPandas(total, kind)


@cache
def _signs() -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1, 1], np.float32), size=(TERMS, DIM))


def _project(d: np.ndarray, t: np.ndarray, n: np.ndarray, docs: int, idf: np.ndarray) -> np.ndarray:
    """Normalised vectors; a document without known terms has a zero vector."""
    keep = idf[t] > 0
    d, t, n = d[keep], t[keep], n[keep]
    out = np.zeros((docs, DIM), np.float32)
    if len(d):
        w = ((1 + np.log(n)) * idf[t]).astype(np.float32)
        at, signs = np.flatnonzero(np.append(True, d[1:] != d[:-1])), _signs()
        for doc, lo, hi in zip(d[at].tolist(), at.tolist(), np.append(at[1:], len(d)).tolist()):
            np.dot(w[lo:hi], signs[t[lo:hi]], out=out[doc])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


class Tree:
    """Bisecting tree: ``left``/``right`` children (or -1), and the rule of each node: ``x @ axis > bias`` goes right."""

    def __init__(self) -> None:
        self.left, self.right = [-1], [-1]
        self.axis, self.bias = [np.zeros(DIM, np.float32)], [0.0]

    def split(self, node: int, axis: np.ndarray, bias: float) -> None:
        self.axis[node], self.bias[node] = axis.astype(np.float32), float(bias)
        if self.left[node] < 0:
            self.left[node], self.right[node] = len(self.left), len(self.left) + 1
            for _ in range(2):
                self.left.append(-1)
                self.right.append(-1)
                self.axis.append(np.zeros(DIM, np.float32))
                self.bias.append(0.0)

    def merge(self, node: int) -> None:
        """Undo the split of a node whose children were the last to be added, or leave them unused."""
        self.left[node] = self.right[node] = -1

    def leaves(self) -> list[int]:
        """Reachable leaves."""
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            if self.left[k] < 0:
                out.append(k)
            else:
                todo += [self.left[k], self.right[k]]
        return out

    def route(self, x: np.ndarray) -> np.ndarray:
        left, right, axis, bias = np.array(self.left), np.array(self.right), np.stack(self.axis), np.array(self.bias, np.float32)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(left[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = np.where(np.einsum("ij,ij->i", x[inner], axis[at]) > bias[at], right[at], left[at])


def _moments(vectors: DataFrame, tree: Tree, second: bool) -> dict[int, tuple[int, np.ndarray, np.ndarray | None]]:
    """Number, sum and second moments of the vectors of each leaf; ``DIM ** 2`` numbers a leaf at most reach the driver."""
    out_schema = pa.schema([("node", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("part", pa.int32())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        part_id = TaskContext.get().partitionId()
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, DIM)
            node = tree.route(x)
            order = np.argsort(node, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(node[order]) != 0)) if len(order) else []
            for part in np.split(order, at[1:]) if len(order) else []:
                y = x[part].astype(np.float64)
                m = np.concatenate([y.sum(0), (y.T @ y).ravel() if second else []])
                old = acc.setdefault(int(node[part[0]]), [0, np.zeros(len(m))])
                old[0] += len(part)
                old[1] += m
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([a[0] for a in acc.values()], pa.int64()), pa.array([a[1].tobytes() for a in acc.values()], pa.binary()), pa.array([part_id] * len(acc), pa.int32())], schema=out_schema)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(s, np.float64) for s in pdf["sums"])
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "n": [pdf["n"].sum()], "sums": [sums.tobytes()]})

    schema = "node int, n bigint, sums binary"
    partials = vectors.select("vec").mapInArrow(partial, f"{schema}, part int")
    rows = _summed(partials, len(vectors.inputFiles()), "node", total, schema).collect()
    out = {}
    for r in rows:
        m = np.frombuffer(r["sums"], np.float64)
        out[r["node"]] = (r["n"], m[:DIM], m[DIM:].reshape(DIM, DIM) if second else None)
    return out


def bisect(vectors: DataFrame, leaves: int = LEAVES, min_leaf: int = 8, max_levels: int = 24) -> Tree:
    """Bisecting k-means; leaves below ``2 * min_leaf`` rows are kept whole.

    The leaf of largest spread is split first: its mean distance from the centre times a root of its size.  By the
    plain sum of distances large clusters of one subject would be split again and again, and small ones of several
    subjects never.
    """
    tree = Tree()
    stats = _moments(vectors, tree, True)
    whole: set[int] = set()
    for level in range(max_levels):
        open_leaves = [k for k, (n, _, _) in stats.items() if n >= 2 * min_leaf and k not in whole]
        spread = {k: (1 - np.linalg.norm(s) / n) * n**ROOT for k, (n, s, _) in stats.items()}
        open_leaves.sort(key=lambda k: -spread[k])
        chosen = [k for k in open_leaves[: leaves - len(stats)] if spread[k] >= ABOVE * np.mean(list(spread.values()))]
        if not chosen:
            break
        for k in chosen:
            n, s, m2 = stats[k]
            cov = m2 / n - np.outer(s / n, s / n)
            axis = np.linalg.eigh(cov)[1][:, -1]
            tree.split(k, axis, float(axis @ (s / n)))
        refined = level < REFINED
        halves = _moments(vectors, tree, not refined)
        for k in chosen:
            a, b = (halves.get(c) for c in (tree.left[k], tree.right[k]))
            if a is None or b is None or min(a[0], b[0]) < min_leaf:
                tree.merge(k)
                whole.add(k)
            elif refined:
                ca, cb = a[1] / max(np.linalg.norm(a[1]), 1e-12), b[1] / max(np.linalg.norm(b[1]), 1e-12)
                tree.split(k, cb - ca, 0.0)
        stats = _moments(vectors, tree, True) if refined else {k: halves[k] if k in halves else stats[k] for k in tree.leaves() if k in halves or k in stats}
    return tree


def _log_odds(n: np.ndarray, terms: np.ndarray, background: np.ndarray, strength: float) -> np.ndarray:
    """Log-odds of ``terms`` in each row of counts against the background, drawn to it by ``strength`` pseudo-counts."""
    bg = np.maximum(background[terms] / max(background.sum(), 1), 1e-12)
    size = n.sum(axis=1, keepdims=True, dtype=np.float64)
    return np.log((n[:, terms] + strength * bg + 1e-12) / (size + strength) / bg).astype(np.float32)


def _sentence_leaves(tok: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each token, and the leaf of each sentence (-1: none).

    Sentences are scored in blocks, longest first, word by word for all of a block: the scores stay in the cache.
    """
    sentence = np.cumsum(tok < 0) - (tok < 0)
    leaf = np.full(int(sentence[-1]) + 1, -1)
    row = model.row[tok]  # the last entry stands for -1
    use = np.flatnonzero(row >= 0)
    if not len(use):
        return sentence, leaf
    s, row = sentence[use], row[use]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    length = np.diff(np.append(start, len(use)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    best, top = np.empty(len(order), np.int64), np.empty(len(order), np.float32)
    held = np.empty((SCORED, model.weights.shape[1]), np.float32)
    for lo in range(0, len(order), SCORED):
        at, shorter = start[lo : lo + SCORED], -length[lo : lo + SCORED]
        score = model.weights[row[at]]
        for j in range(1, -shorter[0]):
            n = int(np.searchsorted(shorter, -j, side="left"))
            np.take(model.weights, row[at[:n] + j], axis=0, out=held[:n], mode="clip")
            score[:n] += held[:n]
        k = score.argmax(axis=1)
        best[lo : lo + SCORED], top[lo : lo + SCORED] = k, score[np.arange(len(k)), k]
    leaf[s[start]] = np.where(top > model.least, best, -1)
    return sentence, leaf


def _counts(frame: DataFrame, rows: int, work) -> np.ndarray:
    """Sums of ``work(acc, ids, doc, columns)`` over all chunks, as a ``rows x TERMS`` matrix; a table of bounded size."""
    schema = pa.schema([("row", pa.int32()), ("terms", pa.binary()), ("n", pa.binary()), ("part", pa.int32())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, part = np.zeros((rows, TERMS), np.float32), TaskContext.get().partitionId()
        for ids, doc, cols in _chunks(batches):
            work(acc, ids, doc, *cols)
        for r in np.flatnonzero(acc.any(axis=1)).tolist():
            t = np.flatnonzero(acc[r])
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([t.astype(np.int32).tobytes()], pa.binary()), pa.array([acc[r, t].astype(np.float64).tobytes()], pa.binary()), pa.array([part], pa.int32())], schema=schema)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(TERMS)
        for t, n in zip(pdf["terms"], pdf["n"]):
            acc[np.frombuffer(t, np.int32)] += np.frombuffer(n, np.float64)
        t = np.flatnonzero(acc)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "terms": [t.astype(np.int32).tobytes()], "n": [acc[t].tobytes()]})

    kind = "row int, terms binary, n binary"
    out = np.zeros((rows, TERMS), np.float32)
    for r in _summed(frame.mapInArrow(partial, f"{kind}, part int"), len(frame.inputFiles()), "row", total, kind).collect():
        out[r["row"], np.frombuffer(r["terms"], np.int32)] = np.frombuffer(r["n"], np.float64)
    return out


class Model:
    """Weights of the telling terms by leaf and the subject of each leaf (an empty name: none).

    A term tells leaves apart when its distribution over the leaves diverges from that of all terms by at least
    ``telling`` nats, less what chance alone gives a term of its frequency.  Names and words of any subject do not
    and are not scored.
    """

    def __init__(self, counts: np.ndarray, background: np.ndarray, names: list[str], least: float = 2.0, telling: float | None = None):
        telling = TELLING if telling is None else telling
        total = counts.sum(axis=0, dtype=np.float64)
        base = np.maximum(counts.sum(axis=1, keepdims=True, dtype=np.float64) / max(total.sum(), 1e-9), 1e-12)
        chance = (np.minimum(len(counts), total) - 1) / (2 * np.maximum(total, 1e-9))
        found = []
        for lo in range(0, TERMS, BLOCK):  # by blocks of terms, which bounds the memory of the driver
            at = np.arange(lo, min(lo + BLOCK, TERMS))
            share = counts[:, at] / np.maximum(total[at], 1e-9)
            divergence = (share * np.log(np.maximum(share, 1e-12) / base)).sum(axis=0)
            found.append(at[(total[at] >= 3) & (divergence - chance[at] >= telling)])
        self.terms = np.concatenate(found)
        self.weights = np.ascontiguousarray(_log_odds(counts, self.terms, background, 200.0).T)
        self.row = np.full(TERMS + 1, -1, np.int32)
        self.row[self.terms] = np.arange(len(self.terms))
        self.names, self.least = names, least


def fit(tokens: DataFrame, labels: DataFrame, areas: DataFrame, leaves: int = LEAVES, min_leaf: int = 8, max_labelled: int = MAX_LABELLED, label_evidence: bool = True) -> Model:
    """Cluster all documents and name the leaves; without ``label_evidence`` by their discriminative terms alone."""
    spark = tokens.sparkSession
    docs, df = _document_frequencies(tokens)
    idf = np.where(df >= 3, np.log(np.maximum(docs, 1) / np.maximum(df, 1)), 0.0).astype(np.float32)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, d, (t, n) in _chunks(batches):
            x = _project(d, t, n, len(ids), idf)
            x = x[np.abs(x).sum(axis=1) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["vec"])

    vectors = staged(tokens.select(*TF).mapInArrow(vectorise, "vec binary"), "subject-vectors")
    tree = bisect(vectors, leaves, min_leaf)
    nodes = tree.leaves()
    leaf_of_node = np.full(len(tree.left), -1)
    leaf_of_node[nodes] = np.arange(len(nodes))
    k_leaves = len(nodes)

    subjects = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    k_subjects = len(subjects) + 1
    label_of = _label_shares(labels, subjects, max_labelled)
    shared = spark.sparkContext.broadcast((idf, tree, leaf_of_node, label_of))

    def by_document(acc, ids, d, t, n):
        idf, tree, leaf_of_node, label_of = shared.value
        leaf = leaf_of_node[tree.route(_project(d, t, n, len(ids), idf))]
        np.add.at(acc.reshape(-1), leaf[d] * TERMS + t, n.astype(np.float32))
        for i, doc_id in enumerate(ids.tolist()):
            if (own := label_of.get(doc_id)) is not None:
                lo, hi = np.searchsorted(d, [i, i + 1])
                for s, w in own:
                    acc[k_leaves + s, t[lo:hi]] += w * n[lo:hi]

    first = _counts(tokens.select(*TF), k_leaves + k_subjects, by_document)
    by_subject, background = first[k_leaves:].copy(), first[:k_leaves].sum(axis=0, dtype=np.float64)
    rough = Model(first[:k_leaves], background, [])
    del first
    for name, title, scope in areas.select("subject", "title", "scope").distinct().collect():
        if name in subjects:
            toks = terms_of(" ".join([name.replace("_", " "), title or "", scope or ""]))
            np.add.at(by_subject[subjects.index(name)], toks[toks >= 0], 1)

    refine = spark.sparkContext.broadcast((rough, label_of))

    def by_sentence(acc, ids, doc, tok):
        model, label_of = refine.value
        sentence, leaf = _sentence_leaves(tok, model)
        at = leaf[sentence]
        real = (tok >= 0) & (at >= 0)
        np.add.at(acc.reshape(-1), at[real] * TERMS + tok[real], np.float32(1))
        for i, doc_id in enumerate(ids.tolist()):
            if (own := label_of.get(doc_id)) is not None:
                lo, hi = np.searchsorted(doc, [i, i + 1])
                inside, total = at[lo:hi][tok[lo:hi] >= 0], max(1, (tok[lo:hi] >= 0).sum())
                k, n = np.unique(inside[inside >= 0], return_counts=True)
                for leaf_id, share in zip(k.tolist(), (n / total).tolist()):
                    if share >= 0.15:
                        for s, w in own:
                            acc[k_leaves + s, leaf_id] += w * share

    second = _counts(tokens.select(*SEQUENCE), k_leaves + k_subjects, by_sentence)
    held = np.flatnonzero(second[:k_leaves].any(axis=1))  # every leaf that a sentence was assigned to, however small
    evidence = second[k_leaves:, held].T.astype(np.float64) * label_evidence
    second = second[held if len(held) else [0]]
    model = Model(second, background, [])
    model.names = _name_leaves(second[:, model.terms], model.weights.T, _log_odds(by_subject, model.terms, background, 50.0), evidence, [*subjects, ""])
    return model


def _document_frequencies(tokens: DataFrame) -> tuple[int, np.ndarray]:
    def work(acc, ids, d, t):
        acc[0] += np.bincount(t, minlength=TERMS)
        acc[1, 0] += (np.bincount(d, minlength=len(ids)) > 0).sum()

    got = _counts(tokens.select("doc_id", "terms"), 2, work)
    return int(got[1, 0]), got[0]


def _label_shares(labels: DataFrame, subjects: list[str], most: int) -> dict[int, list[tuple[int, float]]]:
    """``doc_id -> (subject, weight)``; each rater has the same weight, split over the subjects named; null is "none"."""
    once = labels.where("doc_id is not null").select("doc_id", "subject", F.coalesce("annotator", F.lit("")).alias("annotator")).distinct()
    per_doc = once.groupBy("doc_id").agg(F.collect_set(F.struct("annotator", F.coalesce("subject", F.lit("")).alias("subject"))).alias("votes"))
    rows = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    place = {s: i for i, s in enumerate(subjects)} | {"": len(subjects)}
    out = {}
    for doc_id, votes in rows:
        by_rater: dict[str, list[int]] = {}
        for v in votes:
            if v["subject"] in place:
                by_rater.setdefault(v["annotator"], []).append(place[v["subject"]])
        shares: dict[int, float] = {}
        for own in by_rater.values():
            for s in own:
                shares[s] = shares.get(s, 0.0) + 1 / len(own) / len(by_rater)
        out[int(doc_id)] = sorted(shares.items())
    return out


def _name_leaves(n: np.ndarray, weights: np.ndarray, subject_weights: np.ndarray, evidence: np.ndarray, names: list[str], top: int = 60, least: float = 0.25) -> list[str]:
    """Subject of each leaf by its discriminative terms and the labels of the documents it covers."""
    base = (evidence.sum(axis=0) + 1e-3) / (evidence.sum() + 1e-3 * evidence.shape[1])
    out = []
    for k in range(len(evidence)):
        gain = n[k] * np.maximum(weights[k], 0)
        best = np.argsort(-gain, kind="stable")[:top]
        best = best[gain[best] > 0]
        score = (gain[best][None] * np.clip(subject_weights[:, best], -1, 4)).sum(axis=1) / max(gain[best].sum(), 1e-9)
        labelled = evidence[k].sum()
        posterior = (evidence[k] + 0.5 * base) / (labelled + 0.5)
        score = score + np.log(posterior / base) * min(1.0, labelled / 2)
        s = int(score.argmax())
        out.append(names[s] if score[s] > least else "")
    return out


def leaf_mixtures(tokens: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, subject, share)``: the share of a document's terms in sentences of leaves of each subject."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = sorted(set(m.names) - {""})
        subject = np.array([names.index(x) if x else len(names) for x in m.names] + [len(names)])
        for ids, doc, (tok,) in _chunks(batches):
            sentence, leaf = _sentence_leaves(tok, m)
            real = tok >= 0
            of = subject[leaf[sentence]][real]
            table = np.zeros((len(ids), len(names) + 1))
            np.add.at(table, (doc[real], of), 1)
            share = table[:, :-1] / np.maximum(table.sum(axis=1, keepdims=True), 1)
            d, s = np.nonzero(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array([names[i] for i in s], pa.string()), pa.array(share[d, s], pa.float64())], schema=schema)

    return tokens.select(*SEQUENCE).mapInArrow(run, "doc_id bigint, subject string, share double")


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return staged(spread(src).mapInArrow(_tokenized, "doc_id bigint, toks binary, terms binary, n binary"), "subject-tokens")


def subjects_of(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, areas: DataFrame, share: float = 0.2, leaves: int = LEAVES, label_evidence: bool = True) -> DataFrame:
    """``(doc_id, subject, share)`` of every document and each of its subjects.

    Null ids and texts, blank texts and texts without a subject have no row; repeated rows count once for the
    result; without labels only the subject descriptions name leaves; empty tables give an empty result.
    """
    tokens = tokenized(docs, id_col, text_col)
    model = fit(tokens, labels, areas, leaves, label_evidence=label_evidence)
    return leaf_mixtures(tokens, model).where(F.col("share") >= share).groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
