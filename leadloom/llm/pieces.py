"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.shared import read_documents

#: Entries of a task's caches; a full cache starts anew. Longer units (in characters) are not cached.
CACHE, CACHED_LENGTH = 250_000, 64


class PieceEncoder:
    """Encodes with a merge-type (BPE) model with byte fallback, identity normalisation and a leading space.

    A text is the result of merging if and only if each of its tokens and each pair of adjacent tokens is what
    merging makes of their own characters. So the encoder takes the longest match at each position, checks the pair
    with the token before by merging the pair's characters anew, and else tries shorter matches; when none is left,
    it marks the position as failed in a bit field and goes back one token. Each position fails at most once.

    No piece reaches from another character into a space, so texts are encoded in units of spaces and the characters
    up to the next space; units recur, and a bounded cache keeps their ids.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.byte_fallback or not norm.add_dummy_prefix:
            raise ValueError("a merge-type model with byte fallback, identity normalisation and a leading space is needed")
        self.rank: dict[str, float] = {}
        self.text: dict[int, bytes] = {}
        self.name: dict[str, str] = {}  # of each token its decimal id
        self.bytes: dict[int, str] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                piece = p.piece.replace("▁", " ")
                self.rank[piece], self.name[piece], self.text[i] = -p.score, str(i), piece.encode()
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = str(i)
                self.text[i] = bytes([int(p.piece[3:5], 16)])
        if any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("a piece has a space after another character")
        # characters that occur in no longer piece end a unit
        alone = {c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.rank)}
        ends = "".join(map(re.escape, sorted(alone)))
        self.units = re.compile(rf" *[^ {ends}]+|[{ends}]| +" if ends else r" *[^ ]+| +")
        # of each piece that merging makes of its own characters: the two parts of its last merge
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            if len(p) > 1 and (last := self.last_merge(p)):
                self.parts[p] = last
        self.matches = ahocorasick.Automaton()
        for p in self.parts:
            self.matches.add_word(p, (len(p) - 1, p))
        self.matches.make_automaton()
        # of each piece the next shorter one that begins it
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.parts), p[0]) for p in self.parts}
        self.age = {p: self.rank[p] for p in self.parts}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, str] = {}

    def last_merge(self, chars: str) -> tuple[str, str] | None:
        """Merges the best-ranked adjacent pair, leftmost first, while there is one; the last pair if one token is left."""
        parts, rank, last = list(chars), self.rank, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves both tokens as they are, side by side.

        Their merges are undone from the last to the first; if at any time the tokens on both sides of the border
        could be joined before the merge that was undone, merging would have joined them.
        """
        rank, age, parts = self.rank, self.age, self.parts
        limit = float("inf")
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = age.get(left, -1), age.get(right, -1)
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 0.5, parts[right][0]  # of equal ranks the one on the left goes first
            else:
                return True

    def split(self, unit: str) -> list[str]:
        """Tokens of one unit; a character without a piece is a token."""
        longest = list(unit)
        for end, (back, piece) in self.matches.iter(unit):
            longest[end - back] = piece  # longer ones come later
        n, pos, failed = len(unit), 0, 0
        pairs, shorter = self.pairs, self.shorter
        tokens: list[str] = []
        last, token = "", longest[0]
        while True:
            end = pos + len(token)
            if not failed >> end & 1:
                good = not last or pairs.get((last, token))
                if good is None:
                    if len(pairs) >= CACHE:
                        pairs.clear()
                    good = pairs[last, token] = self.fits(last, token)
                if good:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    pos, last, token = end, token, longest[end]
                    continue
            while (token := shorter.get(token)) is None:
                failed |= 1 << pos
                if not tokens:
                    raise ValueError(f"no encoding of {unit!r}")
                token = tokens.pop()
                pos -= len(token)
                last = tokens[-1] if tokens else ""

    def unit_ids(self, unit: str) -> str:
        out: list[str] = []
        for t in self.split(unit):
            i = self.name.get(t)
            out += [i] if i is not None else [self.bytes[b] for b in t.encode()]
        return ",".join(out)

    def encode_joined(self, text: str) -> tuple[str, int]:
        """Decimal ids joined by commas, and their number."""
        if not text:
            return "", 0
        units = self.units.findall(" " + text.replace("▁", " "))
        cache = self.cache
        try:
            found = [cache[u] for u in units]
        except KeyError:
            if len(cache) >= CACHE:
                cache.clear()
            for u in {u for u in units if len(u) <= CACHED_LENGTH and u not in cache}:
                cache[u] = self.unit_ids(u)
            found = [cache[u] if len(u) <= CACHED_LENGTH else self.unit_ids(u) for u in units]
        joined = ",".join(found)
        return joined, joined.count(",") + 1

    def encode(self, text: str) -> list[int]:
        joined, n = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if n else []

    def decode(self, ids) -> str:
        """Pieces joined, bytes as UTF-8 (invalid ones replaced), without the leading space."""
        table = self.text
        out = b"".join([table.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_coders: dict[str, PieceEncoder] = {}


def coder_of(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if path not in _coders:
        _coders[path] = PieceEncoder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and the decoded text.

    One pass without a shuffle. Null text is empty: no ids, digests of the empty string. Repeated rows are encoded
    each. Very long texts are encoded whole. An empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        names = {str(i): t for i, t in coder.text.items()}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, digests, back, all_ids, decoded = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                joined, size = coder.encode_joined(text or "")
                n.append(size)
                digests.append(sha(joined.encode()))
                pieces = joined.split(",") if size else []
                whole = b"".join([names[i] for i in pieces]).decode("utf-8", "replace")
                whole = whole[1:] if whole[:1] == " " else whole
                back.append(sha(whole.encode()))
                if with_ids:
                    all_ids.append([int(i) for i in pieces])
                    decoded.append(whole)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
