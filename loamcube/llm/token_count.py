"""Token counts from a compiled finite-state transducer.

A byte-level BPE tokenizer cuts text into pre-tokens by a regular pattern and merges bytes inside each. Both
are finite-state, so counts need no merging:

* Inside a pre-token, ``CountingTransducer`` reads bytes. Its state holds the longest suffix read that some
  token continues, and for every cut from which a token may still read on, the last token of the encoding up to
  there and how far the count stood. Reading a byte finds the token that ends the encoding now: the one whose neighbour before it
  doesn't merge with it. The transition is annotated with the change in the number of tokens (it may be
  negative: a merge). States and transitions are compiled when first reached and then only looked up.
* Between pre-tokens nothing is carried, so a word's total is one transition of a coarser transducer, kept
  by word.
* A long text is cut into chunks wherever the size falls. A chunk is a map from what is open on its left to
  what is open on its right: the part before its first certain boundary, the tokens between its certain
  boundaries, the part behind the last (a boundary is certain where a letter is followed by white space).
  Maps compose associatively, and a chunked text is a balanced product of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of

LIMIT = 512
CHUNK = 1 << 16
#: Entries kept in a worker's tables; they start anew beyond it.
MOST_WORDS = 400_000
MOST_STATES = 120_000
#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60
_BOUNDARY = r"(?<=\p{L})(?=\s)"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(moved)}


class CountingTransducer:
    """Bytes of one pre-token to its number of BPE tokens."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.tokens = set(tokens)
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.open = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.origins: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((0, b"", 0),))
        self.number = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, int]] = {}

    def origin(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge completes a token from its bytes; empty for a byte, null for a token never reached."""
        if token not in self.origins:
            parts, last = [token[i : i + 1] for i in range(len(token))], (b"", b"")
            while len(parts) > 1:
                ranks = [self.rank.get(pair, _NEVER) for pair in pairwise(parts)]
                best = min(ranks)
                if best == _NEVER:
                    break
                i = ranks.index(best)
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.origins[token] = last if len(parts) == 1 else None
        return self.origins[token]

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The pieces that stand at one end of a token while it is merged, each with the rank of the merge that ends it."""
        got = self.edges.get((token, right))
        if got is None:
            got, piece, end = [], token, _NEVER
            while piece:
                got.append((piece, end))
                pair = self.origin(piece)
                if pair is None:
                    got = []
                    break
                end = self.rank.get(pair, _NEVER)
                piece = pair[right]
            self.edges[token, right] = got
        return got

    def stays_apart(self, a: bytes, b: bytes) -> bool:
        """Do two neighbouring tokens stay as they are?

        They don't if the pieces at their border at some time form a pair that merges before either piece
        is taken up by its own token (of equal ranks the left pair goes first).
        """
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > MOST_STATES:
                self.apart.clear()
            left, right = self.edge(a, True), self.edge(b, False)
            got = bool(left and right) and not any((r := self.rank.get((x, y))) is not None and r < x_end and r <= y_end for x, x_end in left for y, y_end in right)
            self.apart[a, b] = got
        return got

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: next state, change in the number of tokens."""
        suffix, cuts = self.states[state]
        text = suffix + bytes([byte])
        for at, before, count in cuts:
            token = text[at:]
            if token in self.tokens and (not before or self.stays_apart(before, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count + 1
        # only a cut that some token reads on from can matter again
        kept = [(at, t, n - change) for at, t, n in cuts if text[at:] in self.open]
        first = kept[0][0] if kept else len(text)
        new = (text[first:], (*((at - first, t, n) for at, t, n in kept), (len(text) - first, token, 0)))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (self.number[new], change)
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state, total, moves = 0, 0, self.moves
        for byte in word:
            move = moves.get(state << 8 | byte)
            state, change = move if move is not None else self.compile(state, byte)
            total += change
        return total


class _Words(dict):
    """Word to number of tokens, filled by the transducer."""

    def __init__(self, transducer: CountingTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        n = self.transducer.count(word.encode())
        if len(word) < 100:
            self[word] = n
        return n


class TokenCounter:
    """Counts for one tokenizer file (byte-level BPE as JSON)."""

    _loaded: dict[str, TokenCounter] = {}

    @classmethod
    def load(cls, spec: str) -> TokenCounter:
        """One for each tokenizer (the text of its file) and process."""
        if spec not in cls._loaded:
            cls._loaded[spec] = cls(json.loads(spec))
        return cls._loaded[spec]

    def __init__(self, spec: dict):
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalisation is compiled")
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        if any(t.get(x) for t in spec["added_tokens"] for x in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only added tokens that take nothing around them are compiled")
        special = [t["content"] for t in spec["added_tokens"]]
        self.heads = {s[0] for s in special}
        tokens = [to_bytes(t) for t in spec["model"]["vocab"] if t not in special]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.words = _Words(CountingTransducer(tokens, [(to_bytes(a), to_bytes(b)) for a, b in pairs]))
        self.find = regex.compile(PATTERN).findall
        self.boundary = regex.compile(_BOUNDARY)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(open on the left, tokens between, open on the right); None where no boundary is certain."""
        first = self.boundary.search(chunk)
        if first is None:
            return chunk, None, ""
        at = first.start()
        last = at
        # the last certain boundary: look back over growing stretches
        reach = 256
        while True:
            low = max(at, len(chunk) - reach)
            found = [m.start() for m in self.boundary.finditer(chunk, low)]
            if found or low == at:
                last = max([at, *found])
                break
            reach *= 4
        return chunk[:at], self.plain(chunk[at:last]), chunk[last:]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if b[1] is None:
            return (a[0] + b[0], None, "") if a[1] is None else (a[0], a[1], a[2] + b[0])
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        return a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2]

    def segment(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.plain(text)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.plain(head) if between is None else self.plain(head) + between + self.plain(tail)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text; a special token's string counts as that token."""
        if not any(h in text for h in self.heads):
            return self.segment(text, chunk)
        parts = self.special.split(text)
        return sum(self.segment(p, chunk) for p in parts) + len(parts) - 1


def token_count(text: Column | str, path: str) -> Column:
    """Number of tokens as long. Null counts as empty. The file is read by the driver and broadcast: executors needn't have it."""
    with open(path, encoding="utf-8") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter.load(shared.value)
        for column in batches:
            yield pa.array([counter.count(x.as_py().decode("utf-8", "replace")) for x in binary_of(column)], pa.int64())

    return run(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``tk_n_bytes``, ``tk_n_tokens`` and ``tk_over_limit`` (more tokens than ``limit``).

    Each row is counted by itself: null and empty texts have none, very long ones are counted whole (in chunks of
    ``CHUNK`` characters, one task a text), equal rows count alike, an empty table gives an empty one. Columns named ``tk_*`` are replaced, all others stay.
    """
    out = docs.withColumns({"tk_n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "tk_n_tokens": token_count(text_col, path)})
    return out.withColumn("tk_over_limit", F.col("tk_n_tokens") > limit)
