"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (``LEXICON`` of them, counted over all texts) are encoded once by exact merging and
compiled into a minimal acyclic automaton: states with the same right language are one, so words share suffixes as well as
prefixes. Numbers on the edges count the words passed by, so walking a word yields its index, and with it its ids. The
compiled arrays are one byte string, broadcast, put into an unlinked file and memory-mapped by each Python worker. A word
that the automaton doesn't accept is merged exactly, pair by pair in rank order; a bounded memo keeps what was met last.

The scheme is the given file's: special tokens are matched in the raw text; the rest is put to NFC and lower case, cut by
the file's pattern (what doesn't match, blanks that is, disappears), mapped from bytes to characters, and merged with an
end-of-word mark. Decoding joins the tokens' strings by single spaces, as the file names no decoder.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
repeated rows are encoded each; an empty table gives an empty result; columns other than (doc_id, text) never matter."""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import ship

#: Words in the automaton; occurrences in a task before a word is reported; words of a worker's memo.
LEXICON, LEAST_LOCAL, MEMO = 50_000, 3, 400_000

# Fixed values of Unicode that this Python's tables may not have yet: letters of version 16, which the files' library cuts
# as letters (it takes younger ones for symbols), and lower-case letters up to version 17, which it knows.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
              (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
              (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
              (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LOWER_17 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
            **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def _rare():
    """Finds characters outside the scripts that are old and common."""
    import regex

    return regex.compile("[^\0-\u0557]")


@dataclass
class Scheme:
    """What a tokenizer file says."""

    vocabulary: dict[str, int]
    ranks: dict[tuple[str, str], int]
    end: str
    pattern: str
    special: dict[str, int]
    file: str = ""  # digest of the file

    @classmethod
    def read(cls, path: str) -> Scheme:
        with open(path, "rb") as f:
            raw = f.read()
        d = json.loads(raw)
        m = d["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        cut = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        return cls(m["vocab"], {p: i for i, p in enumerate(merges)}, m["end_of_word_suffix"] or "", cut,
                   {t["content"]: t["id"] for t in d["added_tokens"]}, hashlib.sha256(raw).hexdigest())

    def __post_init__(self):
        self.characters = byte_characters()
        self.strings = {i: s for s, i in [*self.vocabulary.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.strings}
        # pairs as one number of their ids: its rank, and by rank the id of the merged token
        self.base, ids = max(self.strings) + 1, self.vocabulary
        self.byte_ids = [ids[c] for c in self.characters]
        self.last_ids = [ids[c + self.end] for c in self.characters]
        self.pair_ranks = {ids[a] * self.base + ids[b]: r for (a, b), r in self.ranks.items()}
        self.merged = {r: ids[a + b] for (a, b), r in self.ranks.items()}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # a capital sigma is lowered without regard to its place
                text = "".join(c.lower() for c in text)
            return text.lower().translate(LOWER_17) if _rare().search(text) else text.lower()
        return text.lower()

    def merge(self, word: str) -> list[int]:
        """Exact ids of a word: the pair of least rank is merged, leftmost first, until none is left."""
        raw = word.encode()
        if len(raw) > 256:
            parts = [self.characters[b] for b in raw]
            parts[-1] += self.end
            return [self.vocabulary[p] for p in _merge_long(parts, self.ranks)]
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        rank, merged, base, none = self.pair_ranks.get, self.merged, self.base, 1 << 60
        order = [rank(a * base + b, none) for a, b in zip(ids, ids[1:])]  # of each neighbouring pair
        while order and (least := min(order)) < none:
            i = order.index(least)
            ids[i] = new = merged[least]
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = rank(ids[i - 1] * base + new, none)
            if i < len(order):
                order[i] = rank(new * base + ids[i + 1], none)
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def _merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges with a heap over a linked list, for words of many bytes."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ranks.get((parts[i], parts[j])) != r:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (p := (parts[i], parts[after[i]])) in ranks:
                heapq.heappush(heap, (ranks[p], i))
        if before[i] >= 0 and (p := (parts[before[i]], parts[i])) in ranks:
            heapq.heappush(heap, (ranks[p], before[i]))
    return [p for p, a in zip(parts, alive) if a]


# --- the automaton ---------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words with their ids, as one byte string.

    Words go in by byte order; a state that can't change any more is replaced by an equal one that exists already (same
    finality, same edges), so the automaton stays minimal all along."""
    register: dict[tuple, int] = {}
    edges: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    size: list[int] = []  # words accepted from a state

    def settle(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        state = register.get(key)
        if state is None:
            state = register[key] = len(edges)
            edges.append(key)
            size.append(int(final) + sum(size[t] for _, t in out))
        return state

    order = sorted(words)
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # open states along the last word
    last = b""
    for w in [*order, None]:
        same = 0
        if w is not None:
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
        for d in range(len(last), same, -1):
            final, out = path.pop()
            path[-1][1].append((last[d - 1], settle(final, out)))
        if w is None:
            break
        for d in range(same, len(w)):
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = w
    root = settle(*path[0])
    starts, labels, targets, skips, finals = array("I"), bytearray(), array("I"), array("I"), bytearray()
    for final, out in edges:
        starts.append(len(labels))
        finals.append(final)
        passed = int(final)
        for label, target in out:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += size[target]
    starts.append(len(labels))
    offsets, ids = array("I", [0]), array("I")
    for w in order:
        ids.extend(words[w])
        offsets.append(len(ids))
    parts = [starts.tobytes(), bytes(labels), targets.tobytes(), skips.tobytes(), bytes(finals), offsets.tobytes(), ids.tobytes()]
    head = array("Q", [root, len(parts), *map(len, parts)])
    return head.tobytes() + b"".join(parts)


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, compiled: bytes):
        import mmap
        import tempfile

        with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        self.root, n = view[:16].cast("Q")
        at, parts = 16 + 8 * n, []
        for length in view[16:16 + 8 * n].cast("Q"):
            parts.append((at, view[at:at + length]))
            at += length
        self.labels_at = parts[1][0]
        self.finals = parts[4][1]
        # 32-bit parts needn't be aligned in the file, and cast() doesn't ask for it
        self.starts, self.targets, self.skips, self.offsets, self.ids = (parts[i][1].cast("I") for i in (0, 2, 3, 5, 6))

    def find(self, word: bytes) -> list[int] | None:
        """Ids of a word, None if the automaton doesn't accept it."""
        state, index, find, base = self.root, 0, self.map.find, self.labels_at
        for b in word:
            edge = find(b.to_bytes(), base + self.starts[state], base + self.starts[state + 1]) - base
            if edge < 0:
                return None
            index += self.skips[edge]
            state = self.targets[edge]
        if not self.finals[state]:
            return None
        return list(self.ids[self.offsets[index]:self.offsets[index + 1]])


class Encoder:
    """Encodes texts: memo, then automaton, then exact merging."""

    def __init__(self, scheme: Scheme, lexicon: Lexicon | None = None, memo: int = MEMO):
        import regex

        self.scheme, self.lexicon, self.most, self.numbers = scheme, lexicon, memo, scheme.numbers
        self.cut = regex.compile(scheme.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(scheme.special, key=len, reverse=True)))) if scheme.special else None
        encoder = self

        class Memo(dict):
            """Ids of a word joined by spaces; ``decoded`` holds the decoded strings of the same words."""

            def __missing__(self, word):
                if len(self) >= encoder.most:
                    self.clear()
                    encoder.decoded.clear()
                got, encoder.decoded[word] = encoder.word(word)
                self[word] = got
                return got

        class Decoded(dict):
            def __missing__(self, word):  # the memo was cleared after the word's ids were looked up
                return encoder.word(word)[1]

        self.memo, self.decoded = Memo(), Decoded()

    def word(self, word: str) -> tuple[str, str]:
        """(ids joined by spaces, decoded string)"""
        ids = self.lexicon.find(word.encode()) if self.lexicon else None
        if ids is None:
            ids = self.scheme.merge(word)
        return " ".join([self.numbers[i] for i in ids]), self.scheme.decode(ids)

    def words(self, text: str):
        """Lists of the words of a text without special tokens."""
        from replenish.llm.token_counts import pieces_of

        text = self.scheme.normal(text)
        if _rare().search(text):
            young = lambda c: unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in LETTERS_16)
            masked = "".join("\u00a6" if young(c) else c for c in text)
            if masked != text:
                yield [text[m.start():m.end()] for m in self.cut.finditer(masked)]
                return
        yield from pieces_of(self.cut, text)

    def parts(self, text: str):
        """(ids, decoded) of runs of words of a text, in order, each joined by spaces."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.looked_up(text[at:m.start()])
            i = self.scheme.special[m.group()]
            yield str(i), self.scheme.strings[i]
            at = m.end()
        yield from self.looked_up(text[at:] if at else text)

    def looked_up(self, text: str):
        ids, decoded = self.memo.__getitem__, self.decoded.__getitem__
        for some in self.words(text):
            if some:
                yield " ".join(map(ids, some)), " ".join(map(decoded, some))

    def digests(self, text: str) -> tuple[int, str, str]:
        """(ids, sha256 of the ids joined by spaces, sha256 of the decoded text)"""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for numbers, strings in self.parts(text):
            gap = " " if n else ""
            ids.update((gap + numbers).encode())
            decoded.update((gap + strings).encode())
            n += numbers.count(" ") + 1
        return n, ids.hexdigest(), decoded.hexdigest()

    def ids(self, text: str) -> list[int]:
        return [int(i) for numbers, _ in self.parts(text) for i in numbers.split(" ")]


_KEPT: dict[str, Encoder] = {}


def _encoder_of(key: str, known) -> Encoder:
    """The encoder of a Python worker, kept for its later tasks with its bounded memo; one at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        scheme, compiled = known.value
        _KEPT[key] = Encoder(scheme, Lexicon(compiled))
    return _KEPT[key]


def frequent_words(docs: DataFrame, scheme: Scheme, most: int = LEXICON) -> list[str]:
    """The corpus's most frequent words, counted over all texts (a word counts where a task has met it LEAST_LOCAL times);
    ``most`` words reach the driver."""
    import pyarrow as pa

    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(scheme)

    def count(batches):
        import regex
        from collections import Counter

        from replenish.llm.token_counts import pieces_of

        cut, seen = regex.compile(known.value.pattern), Counter()

        def told():
            some = [(w, n) for w, n in seen.items() if n >= LEAST_LOCAL and len(w) <= 64]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for some in pieces_of(cut, known.value.normal(text or "")):
                    seen.update(some)
                if len(seen) > 1_000_000:
                    yield told()
                    seen.clear()
        yield told()

    top = (docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(most).toArrow())
    return top["word"].to_pylist()


def encode_digests(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import pyarrow as pa

    scheme = Scheme.read(path)
    compiled = compile_lexicon({w.encode(): scheme.merge(w) for w in frequent_words(docs, scheme, most)})
    known = docs.sparkSession.sparkContext.broadcast((scheme, compiled))
    key = scheme.file + hashlib.sha256(compiled).hexdigest()

    def encode(batches):
        encoder = _encoder_of(key, known)
        for batch in batches:
            rows = [encoder.digests(t or "") for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and its ids."""
    import pyarrow as pa

    scheme = Scheme.read(path)
    compiled = compile_lexicon({w.encode(): scheme.merge(w) for w in frequent_words(docs, scheme, most)})
    known = docs.sparkSession.sparkContext.broadcast((scheme, compiled))
    key = scheme.file + hashlib.sha256(compiled).hexdigest()

    def encode(batches):
        encoder = _encoder_of(key, known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.ids(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")
