"""Variants of spelling: words one edit apart, found in tries over the counts of letter groups."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import cut, read_documents

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word of a document whose checksum this divides loses a letter.
DROPPED = 97
#: Distinct words that a task holds before it passes them on.
HELD = 300_000
#: Letter groups, one level of the trie each; a letter's group is its code modulo this.
GROUPS = 12
#: Upper levels of the trie by which words are dealt to tasks.
UPPER = 8
#: Words of a bucket on average, and rows (words and visitors) of one task.
BUCKET, TASK = 20_000, 400_000
#: Visitors that go down the trie together, and pairs that are verified together.
STEP, VERIFIED = 4096, 100_000
#: Words of a leaf that are all verified; in larger ones halves are looked up first.
LEAF = 24
#: Bytes of the matrices by which words are compared; longer ones are compared one by one.
WIDE = 48
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Odd numbers: a sum of counts times these names a node of the upper levels, or a few nodes at once.
_NODE = np.random.default_rng(20240607).integers(1, 2**62, UPPER, dtype=np.int64) * 2 + 1


# ---------------------------------------------------------------- words and their numbers


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> word, n: partial counts of words, letters dropped where the checksum says so."""
    held: Counter = Counter()

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                check = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                if check % DROPPED == 0:
                    at = check % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD:
                yield passed()
                held.clear()
    yield passed()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of words with enough letters and occurrences. Words are runs of letters, A-Z lowered; one letter is one byte of Latin-1."""
    rows = docs.select("doc_id", "text").mapInArrow(_words, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- the trie


def _vectors(words: list[bytes]) -> np.ndarray:
    """Counts of the letter groups of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    row = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(row * GROUPS + letters, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _visits() -> np.ndarray:
    """Changes of the node's number on the way to upper nodes that a later word can have: one more letter in a group, or also one fewer in a later group."""
    out = [0, *_NODE]
    out += [a - b for i, a in enumerate(_NODE) for b in _NODE[i + 1 :]]
    return np.array(out, dtype=np.int64)


def _mixed(node: np.ndarray) -> np.ndarray:
    x = node.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _dealt(buckets: int):
    """word, n -> bucket, own, word, n: each word to its own bucket, and as a visitor to each that can hold a later near word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = _visits()
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            with np.errstate(over="ignore"):
                node = _vectors(words)[:, :UPPER] @ _NODE
                to = (_mixed((node[:, None] + changes).ravel()) % np.uint64(buckets)).astype(np.int64).reshape(len(words), -1)
            own = to[:, 0].copy()
            to.sort(axis=1)
            new = np.ones(to.shape, dtype=bool)
            new[:, 1:] = to[:, 1:] != to[:, :-1]
            row = np.concatenate((np.arange(len(words)), np.nonzero(new)[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((own, to[new]))), pa.array(np.arange(len(row)) < len(words)), batch.column("word").take(pa.array(row)), batch.column("n").take(pa.array(row))],
                names=["bucket", "own", "word", "n"],
            )

    return run


class Trie:
    """Words in the order of their vectors; a node of level d is the range of words whose first d counts are equal."""

    def __init__(self, words: list[bytes]):
        vector = _vectors(words)
        order = np.lexsort(vector.T[::-1])
        self.words, self.vector = [words[i] for i in order], vector[order]
        self.wide = int(vector.max(initial=0)) + 3
        node, self.keys = np.zeros(len(words), dtype=np.int64), []
        for level in range(GROUPS):
            key = node * self.wide + self.vector[:, level]
            keys, node = np.unique(key, return_inverse=True)
            self.keys.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1)) if words else np.zeros(1, dtype=np.int64)
        self.halves = _Halves(self)

    def leaves(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, leaf): depth by depth, with a budget of one letter too many and one too few in all."""
        at = np.arange(len(vector))
        node, more, less = (np.zeros(len(vector), dtype=np.int64) for _ in range(3))
        for level, keys in enumerate(self.keys):
            steps = []
            for change in (-1, 0, 1):
                may = slice(None) if change == 0 else (less if change < 0 else more) == 0
                who, from_ = at[may], node[may]
                count = vector[who, level] + change
                key = from_ * self.wide + count
                to = np.searchsorted(keys, key)
                found = (count >= 0) & (count < self.wide) & (to < len(keys))
                found[found] = keys[to[found]] == key[found]
                steps.append((who[found], to[found], more[may][found] + (change > 0), less[may][found] + (change < 0)))
            at, node, more, less = (np.concatenate(x) for x in zip(*steps, strict=True))
        return at, node


class _Halves:
    """In large leaves: words by leaf, length and one half. Words one edit apart share the first or the last half of the shorter one's length."""

    def __init__(self, trie: Trie):
        self.at: dict[tuple[int, int, int, bytes], list[int]] = {}
        size = np.diff(trie.first)
        for leaf in np.flatnonzero(size > LEAF):
            for i in range(trie.first[leaf], trie.first[leaf + 1]):
                word = trie.words[i]
                for shorter in (len(word) - 1, len(word)):
                    half = shorter // 2
                    for side, part in enumerate((word[:half], word[len(word) - half :])):
                        self.at.setdefault((int(leaf), shorter, side, part), []).append(i)

    def find(self, leaf: int, word: bytes) -> set[int]:
        out: set[int] = set()
        for shorter in (len(word) - 1, len(word)):
            half = shorter // 2
            for side, part in enumerate((word[:half], word[len(word) - half :])):
                out.update(self.at.get((leaf, shorter, side, part), ()))
        return out


def _matrix(words: list[bytes], fill: bytes, right: bool) -> np.ndarray:
    """Words of at most WIDE bytes, filled up at their end or start."""
    return np.frombuffer(b"".join(w.rjust(WIDE, fill) if right else w.ljust(WIDE, fill) for w in words), np.uint8).reshape(-1, WIDE)


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether different words are one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    p, s = len(os.path.commonprefix([a, b])), len(os.path.commonprefix([a[::-1], b[::-1]]))
    return p + s >= max(len(a), len(b)) - 1


def near_words(visitors: list[bytes], words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, word) indexes of pairs one edit apart in which the word comes later.

    The order: by the counts of the upper levels (more of the first group that differs is later), then by the word.
    """
    if not words or not visitors:
        return
    place = {w: i for i, w in enumerate(words)}
    trie = Trie(words)
    back = np.fromiter((place[w] for w in trie.words), np.int64, len(words))
    lengths = np.fromiter(map(len, trie.words), np.int64, len(words))
    short = [w if len(w) <= WIDE else b"" for w in trie.words]
    left, right = _matrix(short, b"\0", False), _matrix(short, b"\0", True)
    size = np.diff(trie.first)
    for lo in range(0, len(visitors), STEP):
        some = visitors[lo : lo + STEP]
        vector = _vectors(some)
        who, leaf = trie.leaves(vector)
        large = size[leaf] > LEAF
        few, n = who[~large], size[leaf[~large]]
        ends = np.cumsum(n)
        pairs = [(np.repeat(few, n), np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(trie.first[leaf[~large]], n))]
        for w, x in zip(who[large].tolist(), leaf[large].tolist(), strict=True):
            found = np.fromiter(sorted(trie.halves.find(x, some[w])), np.int64)
            pairs.append((np.full(len(found), w), found))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        visitor_length = np.fromiter(map(len, some), np.int64, len(some))
        shorts = [w if len(w) <= WIDE else b"" for w in some]
        own_left, own_right = _matrix(shorts, b"\1", False), _matrix(shorts, b"\1", True)
        longest = np.maximum(visitor_length[a], lengths[b])
        for from_ in range(0, len(a), VERIFIED):
            x, y, most = (v[from_ : from_ + VERIFIED] for v in (a, b, longest))
            p = (own_left[x] != left[y]).argmax(axis=1)
            s = (own_right[x] != right[y])[:, ::-1].argmax(axis=1)
            near = (p + s >= most - 1) & (most <= WIDE)
            same = (own_left[x] == left[y]).sum(axis=1) >= most  # an equal word has no place that differs before its end
            near &= ~same
            for i in np.flatnonzero(most > WIDE):
                one, other = some[x[i]], trie.words[y[i]]
                near[i] = one != other and _one_edit(one, other)
            x, y = x[near], y[near]
            change = trie.vector[y, :UPPER] - vector[x, :UPPER]
            some_change = (change != 0).any(axis=1)
            sign = change[np.arange(len(x)), (change != 0).argmax(axis=1)]
            later = np.fromiter((some[i] < trie.words[j] for i, j in zip(x, y, strict=True)), bool, len(x))
            keep = np.where(some_change, sign > 0, later)
            yield lo + x[keep], back[y[keep]]


def _search(table: pa.Table) -> pa.Table:
    """Pairs of one bucket, or of a part of its visitors: a, a_n, b, b_n."""
    own, words, n = table.column("own").to_numpy(zero_copy_only=False), table.column("word").to_pylist(), table.column("n").to_numpy()
    coded = [w.encode("latin-1") for w in words]
    held, visiting = np.flatnonzero(own), np.flatnonzero(~own)
    found = list(near_words([coded[i] for i in visiting], [coded[i] for i in held]))
    a, b = (np.concatenate([visiting[:0], *x]) for x in ([visiting[p] for p, _ in found], [held[q] for _, q in found]))
    word = table.column("word")
    return pa.table({"a": word.take(pa.array(a)), "a_n": pa.array(n[a]), "b": word.take(pa.array(b)), "b_n": pa.array(n[b])})


def near_pairs(words: DataFrame, bucket: int = BUCKET, task: int = TASK) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart once. words: word, n (distinct, cut).

    The upper levels of the trie deal words to buckets. A word visits its own bucket and those of the upper nodes that
    one more letter, or one more and one fewer, lead to; each bucket's words are the trie that its visitors go down.
    The visitors of a bucket of more than `task` rows are dealt to parts, each with all of the bucket's words.
    """
    buckets = max(1, -(-words.count() // bucket))
    rows = cut(words.mapInArrow(_dealt(buckets), "bucket long, own boolean, word string, n long"))
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(task)).alias("parts"))
    rows = rows.join(parts, "bucket")
    part = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts"))))
    rows = rows.select("bucket", F.explode(part).alias("part"), "own", "word", "n")
    return rows.groupBy("bucket", "part").applyInArrow(_search, "a string, a_n long, b string, b_n long")


# ---------------------------------------------------------------- forms and roots


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of a word's forms. A form is at least twice as frequent, so there is no circle and a way has at most some forty steps; each round doubles the steps."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n, one row for each word.

    A word's form is its near word (one edit apart) of largest n, of equal ones the smallest, if that has at least
    twice the word's n; the root is the last of the forms that follow from a word, or the word itself.

    Null text has no words; a null id is '' in the checksum. Repeated rows count each. Words of any length are
    compared whole. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    words = cut(word_counts(docs))
    pairs = cut(near_pairs(words))
    side = lambda x, y: pairs.select(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = side("a", "b").unionByName(side("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    rows = words.join(near, "word", "left")
    form: Column = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best"))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["near"].alias("form"), (-form["less"]).alias("form_n")))
    out = rows.join(_roots(rows.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read_documents(spark, sf_dir))
