"""Subject areas of documents (problem 8) by clustering and leaf mixtures.

Sentences become hashed terms, documents normalised TF-IDF vectors in a random projection.
Bisecting k-means splits all documents, first coarsely, which separates the languages, then
into leaves with the term weights of each language: words that come in bursts, as those of
a subject do, weigh most. A leaf is labelled with a mixture of subjects, by its
discriminative terms where a subject's name or description holds them, and by annotated
documents. The terms that set the mixtures of a language apart, with
the mixture of the document's leaf, tell the subject of a sentence, and a document takes
the subjects that its sentences treat in a large enough share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.session import cut, unpriced

#: hashed terms and dimensions of the projection: what is shared is of this size at any scale
TERMS, DIMENSIONS = 1 << 14, 64
#: terms and dimensions that the coarse clusters go by
FREQUENT, COARSE_DIMENSIONS = 400, 32
#: steps towards the widest spread of a node, from the products of all its vectors, and rounds of a level, at most; each goes over all vectors
STEPS, ROUNDS = 4, 6
#: documents up to which the vectors are added up in the driver, by the same steps and rounds
IN_DRIVER = 20_000
#: bytes of vectors that a task goes over in a round, and of sums that all tasks of a round may send to the driver without being added up before
TASK_BYTES, SENT_BYTES = 1 << 24, 1 << 20
#: most subject areas: a model has a number for each of them and each term
MAX_SUBJECTS = 2_000
TOKENS = "doc_id bigint, terms array<int>, lens array<int>, paras array<int>"
MIN_SENTENCES, MIN_WORDS, MIN_CJK = 2, 6, 10
#: words in small letters that tell a line of prose from a list of names
WORDS_OF_PROSE = 3
#: log odds that a sentence must have for a leaf to have a subject of its own
EVIDENCE = 2.3
#: and by which it must be ahead of the next subject
MARGIN = 1.0
#: most that the leaf of a document adds to its sentences' log odds, when terms are counted again
LEAF_LEAN = 1.5
#: share of it that counts when the subjects of sentences are settled
FINAL_LEAN = 0.5
#: documents that the leaves near to a leaf, and the subjects' descriptions, weigh at most in naming it
LEAN, DESCRIBED = 0.5, 0.5
#: coarse clusters, which separate the languages, and the least documents of a cluster, and of a leaf, that is halved
COARSE, LEAST_COARSE, LEAST = 8, 40, 8
#: leaves that a document is a mixture of, and how much nearer ones count more
NEAR_LEAVES, SHARPNESS = 3, 8.0
#: documents whose vectors are one row
PACKED = 1000

_BREAK = re.compile(r"[.!?][\"'”’»)]*\s+|[。！？]")
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_WORD = re.compile(r"[^\W\d_]{2,}")
_CJK = re.compile("[一-鿿]+")
#: ASCII letters, all else as blanks
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
_MARK = re.compile(r"^\s*(?:[*•\-–>]+\s+|\d+[.)]\s+)?")
_YEAR = re.compile(r"\d{4}\.(?:\s|$)")
_STOPS = frozenset(".!?。！？")
#: a label of one or two words, or of a few CJK characters, and a colon begin a field
_FIELD = re.compile(r"(?:[^\W\d_]+(?: [^\W\d_]+)?|[一-鿿]{1,6})\s*[:：](?:\s+|$|(?<=：))")
# fixed values: function words of German, the language that writes all nouns with capitals
_GERMAN = frozenset("der die das und wurde wurden im über nach weil mit von erst dass".split())


class _Terms(dict):
    """Hashed terms of words, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        term = zlib.crc32(word.encode()) % TERMS
        if len(self) < 1 << 17:
            self[word] = term
        return term


class _SmallTerms(_Terms):
    """The same of words in small letters, of others -1."""

    def __missing__(self, word: str) -> int:
        if word.islower():
            return super().__missing__(word)
        if len(self) < 1 << 17:
            self[word] = -1
        return -1


_TERM, _SMALL_TERM = _Terms(), _SmallTerms()


def _broken(text: str) -> list[str]:
    """Parts that end with a stop; quotes and blanks after it are left out."""
    out, begin = [], 0
    for stop in _BREAK.finditer(text):
        out.append(text[begin : stop.start() + 1])
        begin = stop.end()
    return [*out, text[begin:]]


def _stopped(line: str) -> bool:
    return line[-1:] in _STOPS or _END.search(line) is not None


def sentences(text: str) -> list[tuple[int, str]]:
    """(paragraph, sentence) of the running text; headings, lists of names and fields are none.

    A field, a line that begins with a short label and a colon, is running text where its
    value has several sentences or goes on in the next line; a single value is none. A line without a stop goes on in the next one, unless that is blank, a heading, a field
    or an item of a list, where it begins with a small letter or its first word had no
    room in the line of prose before; a title above a text has room, a list of names is no prose.
    """
    out: list[tuple[int, str]] = []
    paragraph, run = 0, []
    lines = [line.strip() for line in text.split("\n")]
    width, block_end = 0, 0

    def close() -> None:
        if run:
            for part in _broken("".join(run)):
                part = part.strip()
                if _stopped(part):
                    out.append((paragraph, part))
            run.clear()

    def field(at: int) -> re.Match | None:
        line = lines[at]
        return _FIELD.match(line) if ":" in line[:40] or "：" in line[:40] else None

    for at, line in enumerate(lines):
        if not line or line[0] == "#":
            close()
            paragraph += 1
            continue
        starts = False
        if label := field(at):
            close()
            paragraph += 1
            value = line[label.end() :]
            if len([x for x in _broken(value) if x]) < 2:
                if _stopped(value) or at + 1 == len(lines) or not lines[at + 1] or lines[at + 1][0] == "#" or field(at + 1):
                    continue
            starts, line = True, value
        elif not line[0].isalpha():
            # a year that a sentence ends with is no number of an item
            if not (run and _YEAR.match(line)):
                bare = _MARK.sub("", line, count=1)
                starts, line = bare != line, bare
        if run and not starts and not line[:1].islower():
            if at >= block_end:  # the longest line up to the next blank one
                block_end = next((k for k in range(at, len(lines)) if not lines[k]), len(lines))
                width = max(map(len, lines[at - 1 : block_end]))
            before = lines[at - 1]
            prose = sum(w.islower() for w in _WORD.findall(before)) >= WORDS_OF_PROSE or sum(map(len, _CJK.findall(before))) >= MIN_CJK
            word = 1 if _CJK.match(line[:1]) else 1 + len(line.split(None, 1)[0]) if line else 0
            starts = not prose or len(before) + word <= width
        if starts:
            close()
        if run and run[-1].endswith("-") and line[:1].islower():
            run[-1] = run[-1][:-1]
        elif run and not (_CJK.match(run[-1][-1:]) or _CJK.match(line[:1])):
            run.append(" ")
        run.append(line)
        if _stopped(line):
            close()
    close()
    return out


def terms_of(sentence: str) -> tuple[list[int], bool]:
    """Hashed words without names, of German with them, CJK characters in pairs; is it a full sentence."""
    if sentence.isascii():
        words = [w for w in sentence.encode().translate(_LETTERS).decode().split() if len(w) > 1]
        runs = []
    else:
        words = _WORD.findall(sentence)
        runs = _CJK.findall(sentence)
        if runs:
            words = [w for w in words if not _CJK.match(w)]
    full = len(words) >= MIN_WORDS or sum(map(len, runs)) >= MIN_CJK
    if len(_GERMAN.intersection(words)) > 1:
        terms = [_TERM[w.lower()] for w in words]
    else:
        terms = [t for w in words[1:] if (t := _SMALL_TERM[w]) >= 0] + [_TERM[w.lower()] for w in words[:1]]
    return terms + [_TERM[run[i : i + 2]] for run in runs for i in range(len(run) - 1)], full


def _lists(values: list[np.ndarray] | np.ndarray, lengths: list[int] | np.ndarray) -> pa.ListArray:
    """A column of integer lists from their numbers one after another."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(values, np.int32), pa.int32()))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: list[int] = []
        terms: list[int] = []
        lens: list[int] = []
        paras: list[int] = []
        n_terms, n_sentences = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = sentences(text)
            each = [terms_of(s) for _, s in found]
            if sum(full for _, full in each) < MIN_SENTENCES:
                continue
            ids.append(doc)
            before = len(terms)
            for ts, _ in each:
                terms.extend(ts)
                lens.append(len(ts))
            paras.extend(p for p, _ in found)
            n_terms.append(len(terms) - before)
            n_sentences.append(len(each))
        if ids:
            columns = [pa.array(ids, pa.int64()), _lists(terms, n_terms), _lists(lens, n_sentences), _lists(paras, n_sentences)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "terms", "lens", "paras"])


class _Batch:
    """The tokens of many documents as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda name: batch.column(name).flatten().to_numpy().astype(np.int64)
        self.n = batch.num_rows
        self.doc_id = batch.column("doc_id").to_numpy()
        #: coarse cluster and leaf, once they are known
        self.coarse = batch.column("coarse").to_numpy() if "coarse" in batch.schema.names else None
        self.leaf = batch.column("leaf").to_numpy() if "leaf" in batch.schema.names else None
        #: the leaves it is a mixture of, and their shares
        self.near = batch.column("near").flatten().to_numpy().reshape(self.n, -1) if "near" in batch.schema.names else None
        self.shares = batch.column("shares").flatten().to_numpy().reshape(self.n, -1) if "near" in batch.schema.names else None
        self.terms, self.lens, self.paras = flat("terms"), flat("lens"), flat("paras")
        self.n_sentences = batch.column("lens").value_lengths().to_numpy().astype(np.int64)
        self.doc_of_sentence = np.repeat(np.arange(self.n), self.n_sentences)
        self.sentence_of_term = np.repeat(np.arange(len(self.lens)), self.lens)
        self.doc_of_term = self.doc_of_sentence[self.sentence_of_term]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[_Batch]:
    """Arrow batches in parts, which bounds the memory of what is computed from one."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield _Batch(batch.slice(low, rows))


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


@lru_cache(maxsize=2)
def _projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20).normal(size=(TERMS, dimensions)).astype(np.float32) / np.sqrt(dimensions, dtype=np.float32)


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows of one owner; owners without rows have 0."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(rows):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = np.add.reduceat(rows, first)
    return out


class Space:
    """Document vectors by term weights: overall at first, then of each language."""

    def __init__(self, weights: np.ndarray, dimensions: int):
        #: a row of weights for each language
        self.weights, self.dimensions = weights.astype(np.float32), dimensions
        #: the coarse space and its centres, and the language of each coarse cluster
        self.coarse: tuple[Space, np.ndarray] | None = None
        self.language: np.ndarray | None = None

    def width(self) -> int:
        return self.dimensions + (0 if self.language is None else len(self.weights))

    def coarse_of(self, b: _Batch) -> np.ndarray:
        if b.coarse is None:
            space, centres = self.coarse
            b.coarse = np.argmax(space.vectors(b) @ centres.T, axis=1)
        return b.coarse

    def of_language(self, b: _Batch) -> np.ndarray:
        """The language of each document, by its coarse cluster."""
        return np.zeros(b.n, np.int64) if self.language is None else self.language[self.coarse_of(b)]

    def vectors(self, b: _Batch) -> np.ndarray:
        """Unit vectors of the documents, behind them a mark of the language; zero without weighty terms."""
        language = self.of_language(b)
        weight = self.weights[language[b.doc_of_term], b.terms] if len(self.weights) > 1 else self.weights[0, b.terms]
        some = np.flatnonzero(weight)
        weight, terms = weight[some], b.terms[some]
        ends = np.cumsum(np.bincount(b.doc_of_term[some], minlength=b.n)).tolist()
        v, directions = np.zeros((b.n, self.dimensions), np.float32), _projection(self.dimensions)
        for doc, (begin, end) in enumerate(zip([0, *ends], ends)):  # the terms of one document stay in the processor's cache
            if begin < end:
                np.matmul(weight[begin:end], directions[terms[begin:end]], out=v[doc])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v /= np.maximum(norm, 1e-9)
        if self.language is None:
            return v
        mark = np.eye(len(self.weights), dtype=np.float32)[language] * (norm > 1e-9)
        return np.concatenate([v, mark], axis=1) / np.sqrt(2, dtype=np.float32)


class Tree:
    """The bisections so far: a level holds the centres of both halves of every node before it."""

    def __init__(self, dimensions: int):
        self.dimensions, self.levels = dimensions, []

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.arange(len(v))
        node = np.zeros(len(v), np.int64)
        for centres in self.levels:
            # towards the right half where its centre is the nearer one; a product with all nodes beats a gather
            right = v @ (centres[1::2] - centres[::2]).astype(np.float32).T
            node = 2 * node + (right[at, node] > 0)
        return node


def _of_leaves(v: np.ndarray, tree: Tree) -> np.ndarray:
    """(leaves x dimensions + 1): sums of the vectors of each leaf, and behind them their counts."""
    leaf, n = tree.leaf_of(v), 2 ** len(tree.levels)
    order = np.argsort(leaf, kind="stable")
    return np.concatenate([_sums(v[order].astype(np.float64), leaf[order], n), np.bincount(leaf, minlength=n)[:, None]], axis=1)


def _with_products(v: np.ndarray, tree: Tree) -> np.ndarray:
    """What ``_of_leaves`` adds up, and behind it the products of any two dimensions, added up over the vectors of each leaf."""
    leaf = tree.leaf_of(v)
    order = np.argsort(leaf, kind="stable")
    v, counts = v[order].astype(np.float64), np.bincount(leaf, minlength=2 ** len(tree.levels))
    v = np.concatenate([v, np.ones((len(v), 1))], axis=1)
    out = np.zeros((len(counts), tree.dimensions + 1, tree.dimensions + 1))
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        own = v[ends[i] - counts[i] : ends[i]]
        out[i] = own.T @ own
    return np.concatenate([out[:, -1], out[:, :-1, :-1].reshape(len(out), -1)], axis=1)


def _lines(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each line of numbers."""
    if sums:
        yield _table(row=pa.array(list(sums), pa.int32()), line=pa.array([line.tobytes() for line in sums.values()], pa.binary()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one row added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, packed in zip(batch.column("row").to_pylist(), batch.column("line")):
            line = np.frombuffer(packed.as_buffer())
            sums[row] = sums[row] + line if row in sums else line
    yield from _lines(sums)


class Points:
    """The vectors of all documents, in the driver where they are few, else packed in tasks of ``TASK_BYTES``."""

    def __init__(self, packed: DataFrame, dimensions: int, n_docs: int):
        self.dimensions = dimensions
        if n_docs > IN_DRIVER:
            self.tasks = -(-n_docs * dimensions * 4 // TASK_BYTES)
            self.packed, self.few = cut(packed).coalesce(self.tasks), None
        else:
            few = [np.frombuffer(x, np.float32).reshape(-1, dimensions) for x in packed.toPandas().v]
            self.few = np.concatenate([np.zeros((0, dimensions), np.float32), *few])

    def added(self, of, width: int, tree: Tree) -> np.ndarray:
        """(leaves x width): ``of(vectors, tree)``, added up over all vectors."""
        if self.few is not None:
            return of(self.few, tree)
        shared, dimensions = self.packed.sparkSession.sparkContext.broadcast(tree), self.dimensions
        out = np.zeros((2 ** len(tree.levels), width))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = 0
            for batch in batches:
                for packed in batch.column("v"):
                    sums = sums + of(np.frombuffer(packed.as_buffer(), np.float32).reshape(-1, dimensions), shared.value)
            yield from _lines({i: sums[i] for i in np.flatnonzero(np.any(sums, axis=1)).tolist()} if np.ndim(sums) else {})

        lines = self.packed.mapInArrow(add, "row int, line binary")
        if self.tasks * out.nbytes > SENT_BYTES:
            lines = lines.repartition("row").mapInArrow(_merged, "row int, line binary")
        for r in lines.collect():
            out[r.row] += np.frombuffer(r.line)
        return out

    def sums(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the vectors of each leaf."""
        out = self.added(_of_leaves, self.dimensions + 1, tree)
        return out[:, :-1], out[:, -1]

    def spreads(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and counts, and (leaves x dimensions x dimensions) products of how far the vectors of each leaf are from its mean."""
        d = self.dimensions
        out = self.added(_with_products, d + 1 + d * d, tree)
        sums, counts, products = out[:, :d], out[:, d], out[:, d + 1 :].reshape(-1, d, d)
        return sums, counts, products - np.einsum("nd,ne->nde", sums, sums) / np.maximum(1, counts)[:, None, None]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _clustered(tokens: DataFrame, space: Space, k: int, seed: int, least: int, n_docs: int) -> np.ndarray | None:
    """Unit centres of at most k leaves of a bisecting k-means over all documents.

    All nodes of a level are halved at once: a node starts from its centre moved a little
    to both sides of its widest spread, which ``STEPS`` of a power iteration look for. The
    vectors of all documents are gone over once for the products that all steps of a level
    go by, and in every round.
    Nodes of fewer than ``least`` documents stay whole.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(space)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, PACKED):
            v = shared.value.vectors(b).astype(np.float32)
            yield _table(v=pa.array([v[np.abs(v).sum(axis=1) > 0].tobytes()], pa.binary()))

    points = Points(tokens.mapInArrow(vectors, "v binary"), space.width(), n_docs)
    tree = Tree(space.width())
    rng = np.random.default_rng(seed)
    for _ in range(max(1, int(np.ceil(np.log2(k))))):
        sums, counts, spreads = points.spreads(tree)
        if not counts.sum():
            return None
        centres = _unit(sums)
        direction = _unit(rng.normal(size=centres.shape))
        for _ in range(STEPS):
            direction = _unit(direction * 1e-6 + np.einsum("nde,ne->nd", spreads, direction))
        apart = 0.05 * direction
        # the largest nodes are halved, as many as leave at most k leaves
        spare = max(0, k - int((counts > 0).sum()))
        whole = counts < least
        whole[np.argsort(-counts, kind="stable")[spare:]] = True
        halves = np.stack([_unit(centres + apart), _unit(centres - apart)], axis=1)
        halves[whole, 0], halves[whole, 1] = centres[whole], -centres[whole]
        tree.levels.append(halves.reshape(-1, tree.dimensions))
        moving = ~np.repeat(whole, 2)
        before = None
        for _ in range(ROUNDS):
            sums, counts = points.sums(tree)
            if before is not None and np.array_equal(counts, before[1]) and np.allclose(sums, before[0], atol=1e-6):
                break  # settled
            before = sums, counts
            tree.levels[-1] = np.where((moving & (counts > 0))[:, None], _unit(sums), tree.levels[-1])
    return _unit(sums[counts > 0])


def _languages_of(profiles: np.ndarray) -> np.ndarray:
    """Coarse clusters that use the same words in the same share of documents are one language."""
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
    alike = unit @ unit.T > 0.5
    language = np.arange(len(profiles))
    for _ in profiles:
        language = np.array([language[alike[i]].min() for i in range(len(profiles))])
    return np.unique(language, return_inverse=True)[1]


def _burst_weights(df: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inverse document frequency times burstiness: in how many fewer documents a term stands
    than if its occurrences were strewn at random."""
    strewn = size * (1 - np.exp(-total / size))
    sure = np.sqrt(np.minimum(df, 400) / 400)
    burst = np.log(np.maximum(1, strewn) / np.maximum(1, df)) * sure
    return np.maximum(0, burst - 0.05) * np.log((1 + size) / (1 + df)) * (df >= 5)


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """(leaves x terms): how much more often than overall a leaf uses a term, shrunk towards 0."""
    share = counts.sum(axis=0) / max(1.0, counts.sum())
    expected = counts.sum(axis=1, keepdims=True) * share
    return np.clip(np.log((counts + 4) / (expected + 4)), -2.5, 4).astype(np.float32)


class Subjects:
    """Term log odds of subjects within each language."""

    def __init__(self, space: Space, counts: np.ndarray, n_subjects: int):
        #: languages x terms x subjects; counts may have a last row of sentences without a subject
        self.space = space
        self.odds = np.stack([_log_odds(c)[:n_subjects].T for c in counts])

    def of_sentences(self, b: _Batch, lean: np.ndarray | None = None) -> np.ndarray:
        """The subject of each sentence, -1 where the evidence is weak.

        ``lean`` is what the leaf of each document adds for each subject.
        """
        if not len(b.lens):
            return np.empty(0, np.int64)
        language = self.space.of_language(b)
        s = _sums(self.odds[language[b.doc_of_term], b.terms], b.sentence_of_term, len(b.lens))
        if lean is not None:
            # a sentence that says little of its own stays without a subject, whatever its document's leaf
            s = np.where(s >= EVIDENCE / 2, s + lean[b.doc_of_sentence], np.minimum(s, 0))
        if s.shape[1] > 1:
            two = np.partition(s, -2, axis=1)[:, -2:]
            clear = two[:, 1] - np.maximum(0, two[:, 0]) >= MARGIN
        else:
            clear = np.ones(len(s), bool)
        return np.where(clear & (s.max(axis=1) >= EVIDENCE), s.argmax(axis=1), -1)


def _placed(tokens: DataFrame, space: Space, centres: np.ndarray) -> DataFrame:
    """The tokens with the coarse cluster, the leaf and the mixture of near leaves of each document, written down."""
    shared = tokens.sparkSession.sparkContext.broadcast((space, centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = min(NEAR_LEAVES, len(shared.value[1]))
            coarse, near, shares = [np.empty(0, np.int64)], [np.empty((0, n), np.int64)], [np.empty((0, n), np.float32)]
            for b in _parts(iter([batch])):
                like = shared.value[0].vectors(b) @ shared.value[1].T.astype(np.float32)
                some = np.argpartition(-like, n - 1, axis=1)[:, :n]
                some = np.take_along_axis(some, np.argsort(-np.take_along_axis(like, some, axis=1), axis=1, kind="stable"), axis=1)
                weight = np.exp(SHARPNESS * np.take_along_axis(like, some, axis=1))
                near.append(some)
                shares.append(weight / weight.sum(axis=1, keepdims=True))
                coarse.append(b.coarse)
            near, shares = np.concatenate(near), np.concatenate(shares)
            offsets = pa.array(np.arange(len(near) + 1) * n, pa.int32())
            more = [
                pa.array(np.concatenate(coarse).astype(np.int32)), pa.array(near[:, 0].astype(np.int32)), _lists(near.ravel(), np.full(len(near), n)),
                pa.ListArray.from_arrays(offsets, pa.array(shares.ravel(), pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "coarse", "leaf", "near", "shares"])

    return cut(tokens.mapInArrow(place, TOKENS + ", coarse int, leaf int, near array<int>, shares array<float>"))


def _emitted(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group with what it uses, its terms and counts packed."""
    some = np.flatnonzero(counts.any(axis=1))
    for low in range(0, len(some), 256):
        rows = some[low : low + 256]
        terms = [np.flatnonzero(counts[row]) for row in rows]
        packed = [t.astype(np.int32).tobytes() for t in terms], [counts[row, t].tobytes() for row, t in zip(rows, terms)]
        yield _table(row=rows.astype(np.int32), term=pa.array(packed[0], pa.binary()), n=pa.array(packed[1], pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the tasks counted for a group, added up to one line."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, term, n in zip(batch.column("row").to_pylist(), batch.column("term"), batch.column("n")):
            if row not in sums:
                sums[row] = np.zeros(TERMS, np.int64)
            sums[row][np.frombuffer(term.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
    yield from _lines({row: line.astype(np.float32) for row, line in sums.items()})


def _counted(tokens: DataFrame, n_groups: int, groups, documents: bool = False, once: bool = False) -> np.ndarray:
    """(groups x terms): how often each group uses each term.

    ``groups(batch)`` gives the group of each term, -1 for none. With ``documents`` there
    are as many rows again: in how many documents of the group each term stands. With
    ``once`` a document counts once for a group and term, so that no long one outweighs others.
    """
    n_rows = n_groups * (1 + documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_rows * TERMS, np.int64)
        for b in _parts(batches):
            group = groups(b)
            own = np.flatnonzero(group >= 0)
            cell = group[own] * TERMS + b.terms[own]
            if not once:
                np.add.at(counts, cell, 1)
            if documents or once:
                single = np.unique(b.doc_of_term[own] * (n_groups * TERMS) + cell) % (n_groups * TERMS)
                np.add.at(counts[documents * n_groups * TERMS :], single, 1)
        yield from _emitted(counts.reshape(n_rows, TERMS))

    packed = tokens.mapInArrow(count, "row int, term binary, n binary").repartition("row")
    out = np.zeros((n_rows, TERMS))
    for r in packed.mapInArrow(_unpacked, "row int, line binary").collect():  # a row for each group
        out[r.row] = np.frombuffer(r.line, np.float32)
    return out


def _described(odds: np.ndarray, weights: np.ndarray, words: list[list[int]]) -> np.ndarray:
    """(leaves x subjects) shares of up to 1 in which a leaf's discriminative terms are a subject's own words.

    ``odds`` are a leaf's log odds of each term, ``weights`` those of the terms in the
    leaf's language, ``words`` the hashed words of each subject's name and description.
    """
    telling = np.maximum(0, odds) * (weights > 0)
    score = np.stack([telling[:, w].mean(axis=1) if w else np.zeros(len(odds)) for w in words], axis=1)
    return score / np.maximum(1.0, score.sum(axis=1, keepdims=True))


def _leaf_subjects(found: list, described: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """P(subject | leaf), the leaf's mixture.

    Evidence is how far a leaf's discriminative terms are the subjects' own words
    (``described``) and annotated documents, each of which is in its leaf for one of its
    subjects: expectation maximisation shares a document out among them. ``found`` has the
    number ``n`` of annotated documents for each leaf and set of subjects (``places``). Leaves with few
    annotated documents lean on leaves near to them.
    """
    n_leaves, n_subjects = described.shape
    allowed = np.zeros((len(found), n_subjects))
    for i, r in enumerate(found):
        allowed[i, r.places] = 1
    leaf, n = np.array([r.leaf for r in found], np.int64), np.array([r.n for r in found], float)
    plain = centres[:, :DIMENSIONS] / np.maximum(np.linalg.norm(centres[:, :DIMENSIONS], axis=1, keepdims=True), 1e-9)
    language = centres[:, DIMENSIONS:].argmax(axis=1)
    near = np.maximum(0, plain @ plain.T) ** 3 * (language[:, None] == language[None, :])
    np.fill_diagonal(near, 0)
    p = np.full((n_leaves, n_subjects), 1 / max(1, n_subjects))
    for _ in range(10):
        shared = allowed * p[leaf]
        shared /= np.maximum(shared.sum(axis=1, keepdims=True), 1e-12)
        counts = DESCRIBED * described
        np.add.at(counts, leaf, shared * n[:, None])
        weight = near * np.minimum(3, counts.sum(axis=1))
        lean = weight @ (counts / np.maximum(1e-9, counts.sum(axis=1, keepdims=True)))
        lean *= LEAN / np.maximum(LEAN, lean.sum(axis=1, keepdims=True))  # at most as much as LEAN documents
        p = counts + lean + 1e-6
        p = (p / p.sum(axis=1, keepdims=True)) ** 2  # a leaf is mostly of one subject
        p /= p.sum(axis=1, keepdims=True)
    return p


def _in_passages(subject: np.ndarray, doc: np.ndarray, para: np.ndarray) -> np.ndarray:
    """Sentences without a subject take that of the passage around them; a lone sentence
    between two of one other subject is a mention in passing."""
    n = len(subject)
    at = np.arange(n)
    passage = doc * (1 << 20) + para
    out = subject
    for group in (passage, doc):
        starts = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0)) if n else at
        last = np.maximum.accumulate(np.where(out >= 0, at, -1)) if n else at
        before = np.where(last >= starts, last, -1)
        back = out[::-1]
        group_r = group[::-1]
        starts_r = np.maximum.accumulate(np.where(np.append(True, group_r[1:] != group_r[:-1]), at, 0)) if n else at
        last_r = np.maximum.accumulate(np.where(back >= 0, at, -1)) if n else at
        after = np.where(last_r >= starts_r, n - 1 - last_r, -1)[::-1]
        out = np.where(out >= 0, out, np.where(before >= 0, out[before], np.where(after >= 0, out[after], -1)))
    if n > 2:
        lone = np.zeros(n, bool)
        lone[1:-1] = (out[:-2] == out[2:]) & (out[1:-1] != out[:-2]) & (doc[:-2] == doc[2:]) & (para[:-2] == para[1:-1]) & (para[2:] == para[1:-1])
        out = np.where(lone, np.roll(out, 1), out)
    return out


class _Model:
    """What the leaves stand for, and the documents placed in them."""

    def __init__(self, names, tokens, centres, leaf_language, leaf_terms, mixtures, first: Subjects):
        self.names, self.tokens, self.centres, self.leaf_language = names, tokens, centres, leaf_language
        self.leaf_terms, self.mixtures, self.first = leaf_terms, mixtures, first


def _lean(b: _Batch, mixtures: np.ndarray) -> np.ndarray:
    """(documents x subjects): what the mixture of the leaves near to a document adds to its sentences' log odds."""
    mixture = np.einsum("dn,dns->ds", b.shares, mixtures[b.near])
    return np.clip(np.log(mixture * mixtures.shape[1] + 0.1), -LEAF_LEAN, LEAF_LEAN).astype(np.float32)


def _fitted(documents: DataFrame, labels: DataFrame, areas: DataFrame, leaves: int, seed: int) -> _Model | None:
    """Leaves of all documents with their terms and mixtures; None where nothing is annotated or nothing is text."""
    spark = documents.sparkSession
    described = areas.where("subject is not null").groupBy("subject").agg(F.concat_ws(" ", F.collect_set("description")).alias("d"))
    rows = described.orderBy("subject").limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subject areas")
    names = [r.subject for r in rows]
    place = {s: i for i, s in enumerate(names)}
    known = F.broadcast(spark.createDataFrame(list(place.items()), "subject string, place int"))  # at most MAX_SUBJECTS
    annotated = labels.where("doc_id is not null").join(known, "subject").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    if annotated.isEmpty():
        return None

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    tokens = cut(texts.mapInArrow(_tokenise, TOKENS))
    n_docs = tokens.count()
    if not n_docs:
        return None
    broadcast = spark.sparkContext.broadcast  # of models, whose size does not depend on the corpus
    # the coarse clusters go by the words that are frequent anywhere, which tell the language
    total = _counted(tokens, 1, lambda b: np.zeros(len(b.terms), np.int64))[0]
    frequent = np.zeros(TERMS, bool)
    frequent[np.argsort(-total, kind="stable")[:FREQUENT]] = True
    raw = Space((np.log(total.sum() / np.maximum(1, total)) * (frequent & (total > 0)))[None, :], COARSE_DIMENSIONS)
    coarse = _clustered(tokens, raw, COARSE, seed, LEAST_COARSE, n_docs)
    if coarse is None:
        return None
    plain = Space(np.zeros((1, TERMS)), DIMENSIONS)
    plain.coarse = (raw, coarse)
    by_cluster = broadcast(plain)
    counts = _counted(tokens, len(coarse), lambda b: by_cluster.value.coarse_of(b)[b.doc_of_term], documents=True)
    total, df = counts[: len(coarse)], counts[len(coarse) :]
    language = _languages_of(df / np.maximum(1, df.max(axis=1, keepdims=True)))
    n_languages = int(language.max()) + 1
    merged = np.eye(n_languages)[language].T
    total, df = merged @ total, merged @ df
    # the most common term stands in nearly every document of its language
    space = Space(_burst_weights(df, total, np.maximum(1, df.max(axis=1, keepdims=True))), DIMENSIONS)
    space.coarse, space.language = (raw, coarse), language
    centres = _clustered(tokens, space, leaves, seed, LEAST, n_docs)
    if centres is None:
        return None
    leaf_language = centres[:, DIMENSIONS:].argmax(axis=1)
    tokens = _placed(tokens, space, centres)
    leaf_terms = _counted(tokens, len(centres), lambda b: b.leaf[b.doc_of_term], once=True)
    # a row for each leaf and set of subjects
    found = tokens.select("doc_id", "leaf").join(unpriced(annotated), "doc_id").groupBy("leaf", "places").agg(F.count(F.lit(1)).alias("n")).orderBy("leaf", "places").collect()
    words = [sorted(set(terms_of(f"{r.subject} {r.d}".lower())[0])) for r in rows]
    own_words = _described(_discriminative(leaf_terms, leaf_language), space.weights[leaf_language], words)
    mixtures = _leaf_subjects(found, own_words, centres)
    # leaves hand their terms to subjects in proportion to their mixtures
    within = np.eye(n_languages)[leaf_language]
    first = Subjects(space, np.einsum("lg,ls,lt->gst", within, mixtures, leaf_terms), len(names))
    return _Model(names, tokens, centres, leaf_language, leaf_terms, mixtures, first)


def _discriminative(leaf_terms: np.ndarray, leaf_language: np.ndarray) -> np.ndarray:
    """(leaves x terms): log odds of each term in a leaf against all leaves of its language."""
    odds = np.zeros(leaf_terms.shape, np.float32)
    for language in np.unique(leaf_language):
        odds[leaf_language == language] = _log_odds(leaf_terms[leaf_language == language])
    return odds


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, min_share: float = 0.25, leaves: int = 128, seed: int = 11) -> DataFrame:
    """(doc_id, subject, n_sentences, share): the subjects of each document, by share of its sentences.

    Subjects are those of ``areas``, at most ``MAX_SUBJECTS``, beyond which this raises;
    annotations (doc_id, subject) of others are ignored. Documents that are null, empty or
    without running text (fewer than two full sentences) have none, nor have any documents
    where nothing is annotated. Rows with a null id are left out; an id that comes with
    several texts gets the subjects of each text. All rows and all annotations are used.
    """
    spark = documents.sparkSession
    model = _fitted(documents, labels, areas, leaves, seed)
    if model is None:
        return spark.createDataFrame([], "doc_id bigint, subject string, n_sentences int, share double")
    broadcast = spark.sparkContext.broadcast
    names, tokens, mixtures = model.names, model.tokens, model.mixtures.astype(np.float32)
    # terms are counted again by sentences, as documents may have several subjects
    first = broadcast(model.first)

    def sentence_group(b: _Batch) -> np.ndarray:
        subject = first.value.of_sentences(b, _lean(b, mixtures))[b.sentence_of_term]
        subject = np.where(subject >= 0, subject, len(names))  # none is a group as well
        return first.value.space.of_language(b)[b.doc_of_term] * (len(names) + 1) + subject

    n_languages = len(model.first.odds)
    again = _counted(tokens, n_languages * (len(names) + 1), sentence_group, once=True)
    final = broadcast(Subjects(model.first.space, again.reshape(n_languages, len(names) + 1, TERMS), len(names)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            subject = final.value.of_sentences(b, FINAL_LEAN * _lean(b, mixtures))
            subject = _in_passages(subject, b.doc_of_sentence, b.paras)
            own = subject >= 0
            keys, n = np.unique(b.doc_of_sentence[own] * len(names) + subject[own], return_counts=True)
            doc = keys // len(names)
            share = n / b.n_sentences[doc]
            keep = share >= min_share - 1e-9
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.doc_id[doc[keep]], pa.int64()), pa.array([names[s] for s in (keys % len(names))[keep]], pa.string()), pa.array(n[keep].astype(np.int32)), pa.array(share[keep], pa.float64())],
                names=["doc_id", "subject", "n_sentences", "share"],
            )

    return tokens.mapInArrow(assign, "doc_id bigint, subject string, n_sentences int, share double")


def subject_leaves(documents: DataFrame, labels: DataFrame, areas: DataFrame, n_terms: int = 8, leaves: int = 128, seed: int = 11) -> DataFrame:
    """(leaf, language, n_documents, terms, mixture): the leaves, their discriminative terms and subjects.

    ``terms`` are the words of a leaf's ``n_terms`` highest log odds against its language,
    of a hashed term the word that is most frequent in the corpus; ``mixture`` has the
    share of each subject. ``language`` is the number of a group of coarse clusters.
    """
    spark = documents.sparkSession
    schema = "leaf int, language int, terms array<int>, mixture map<string,double>"
    model = _fitted(documents, labels, areas, leaves, seed)
    if model is None:
        return spark.createDataFrame([], "leaf int, language int, n_documents bigint, terms array<string>, mixture map<string,double>")
    odds = _discriminative(model.leaf_terms, model.leaf_language)
    telling = [[int(t) for t in np.argsort(-row, kind="stable")[:n_terms] if row[t] > 0] for row in odds]
    rows = [(i, int(g), t, dict(zip(model.names, map(float, m)))) for i, (g, t, m) in enumerate(zip(model.leaf_language, telling, model.mixtures))]
    known = spark.createDataFrame(rows, schema)  # a row for each leaf
    wanted = frozenset(t for ts in telling for t in ts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                for word in _WORD.findall(text):
                    for part in [word.lower()] if not _CJK.match(word) else [word[i : i + 2] for i in range(len(word) - 1)]:
                        if _TERM[part] in wanted:
                            counts[part] += 1
            yield _table(word=list(counts), n=list(counts.values()), term=pa.array([_TERM[w] for w in counts], pa.int32()))

    texts = documents.where("doc_id is not null and text is not null").select("text")
    frequent = texts.mapInArrow(words, "word string, n bigint, term int").groupBy("term", "word").agg(F.sum("n").alias("n"))
    spelled = frequent.groupBy("term").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    sizes = model.tokens.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_documents"))
    named = known.select("leaf", F.posexplode("terms").alias("place", "term")).join(spelled, "term").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return known.drop("terms").join(sizes, "leaf", "left").join(named, "leaf", "left").select("leaf", "language", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("w.word", F.array().cast("array<string>")).alias("terms"), "mixture")


def composition(subjects: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, n_documents, n_sentences, document_share): the corpus by subject.

    Shares are of all document and subject pairs; a subject without documents has 0.
    """
    counted = subjects.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
    total = counted.agg(F.sum("n_documents")).first()[0] or 1
    all_areas = areas.where("subject is not null").select("subject").distinct().join(counted, "subject", "left").fillna(0, ["n_documents", "n_sentences"])
    return all_areas.withColumn("document_share", F.col("n_documents") / F.lit(total))
