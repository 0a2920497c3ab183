"""Token counts of a unigram tokenizer, by dynamic programming over a shared trie.

Texts are cut into pre-tokens by the public pattern; distinct pre-tokens are inserted byte by byte in a trie, and each node
holds the unigram forward score of its prefix: the best sum of piece costs over all ways to cut it into vocabulary pieces.
A node is computed once, whatever number of pre-tokens share the prefix, and terminal counts are stored by pre-token. The
pieces are a public byte-level vocabulary; as its file has no probabilities, a piece of rank r has Zipf's probability,
proportional to 1 / (r + 2.7). Costs are whole micro-nats, so sums are exact; of equal scores the cut with fewer tokens
counts, so the count is well defined.

Each task grows its own trie over the pre-tokens it meets and empties it at ``NODES_MOST`` nodes, so memory is bounded and
nothing is shuffled; emptying costs time only. Pre-tokens of over ``LONG`` bytes aren't inserted but scored by the same
recurrence with a sliding window, so texts without blanks are no problem; texts are cut pre-token by pre-token, never
truncated.

Defined results: null and empty texts have no tokens and cost 0; repeated rows are counted each; an empty table gives an
empty result; columns other than (doc_id, text) never matter."""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import ship

#: Nodes and pre-tokens of a task's trie, at most; longest pre-token in it; characters of a text that are cut at once.
NODES_MOST, LONG, PIECE = 2_000_000, 64, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Piece -> cost in micro-nats."""
    norm = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {p: round(1e6 * (norm + math.log(r + 2.7))) for p, r in ranks.items()}


class PrefixTrie:
    """Forward scores of pre-tokens, computed once per shared prefix."""

    def __init__(self, cost: dict[bytes, int], most: int = NODES_MOST):
        self.cost, self.most = cost, most
        #: longest piece by its last two bytes, to bound the look back
        self.longest: dict[bytes, int] = {}
        for p in cost:
            self.longest[p[-2:]] = max(self.longest.get(p[-2:], 1), len(p))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [(0, 0)]  # (cost, tokens) of the prefix
        self.terminal: dict[str, tuple[int, int]] = {}

    def _step(self, t: bytes, d: int, score) -> tuple[int, int]:
        """(cost, tokens) of t[:d] from those of shorter prefixes, score(j)."""
        cost, top = self.cost, None
        for j in range(d - 1, max(-1, d - 1 - self.longest.get(t[max(0, d - 2):d], 1)), -1):
            c = cost.get(t[j:d])
            if c is not None:
                c0, n0 = score(j)
                if top is None or (c0 + c, n0 + 1) < top:
                    top = (c0 + c, n0 + 1)
        return top

    def insert(self, t: bytes) -> tuple[int, int]:
        if len(t) > LONG:
            done = [(0, 0)]
            for d in range(1, len(t) + 1):
                done.append(self._step(t, d, done.__getitem__))
            return done[-1]
        path, node, child, best = [0], 0, self.child, self.best
        for d in range(1, len(t) + 1):
            key = node << 8 | t[d - 1]
            nxt = child.get(key)
            if nxt is None:
                best.append(self._step(t, d, lambda j: best[path[j]]))
                nxt = child[key] = len(best) - 1
            path.append(nxt)
            node = nxt
        return best[node]

    def count(self, token: str) -> tuple[int, int]:
        """(cost, tokens) of a pre-token, from its terminal entry."""
        got = self.terminal.get(token)
        if got is None:
            if len(self.best) + len(self.terminal) > self.most:
                self.clear()
            got = self.insert(token.encode())
            if len(token) <= LONG:
                self.terminal[token] = got
        return got


def pieces_of(pattern, text: str):
    """Lists of the pre-tokens of a text, PIECE of them at most at once."""
    if len(text) <= PIECE:
        yield pattern.findall(text)
        return
    out = []
    for m in pattern.finditer(text):
        out.append(m.group())
        if len(out) >= PIECE:
            yield out
            out = []
    yield out


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pretokens, n_tokens, cost (micro-nats)."""
    import pyarrow as pa

    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(costs(ranks))

    def count(batches):
        import regex

        cut, trie = regex.compile(pattern), PrefixTrie(known.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n = tokens = cost = 0
                for some in pieces_of(cut, text or ""):
                    n += len(some)
                    try:
                        found = [trie.terminal[t] for t in some]
                    except KeyError:
                        found = [trie.count(t) for t in some]
                    cost += sum([c for c, _ in found])
                    tokens += sum([k for _, k in found])
                rows.append((n, tokens, cost))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], [])))],
                                             ["doc_id", "n_pretokens", "n_tokens", "cost"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(count, f"doc_id {kind}, n_pretokens long, n_tokens long, cost long")
