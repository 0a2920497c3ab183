"""Spelling variants: pairs of words one edit apart, by finite-state composition.

1. Words are counted per document and task, then summed; those that are long and frequent enough are the vocabulary.
2. An edit sits at one place of the shorter word (m code points), so the words of a pair share all before and all after it.
   Every word joins the group of its own length and that of a word one shorter; each group is split in halves: one part
   shares the first half and holds the edits behind it, the other shares the second half and holds those before it. A
   part of more than ``GROUP_MOST`` words is split again in the same way, until the words differ in one place only. A pair
   belongs to exactly one part: that of its edit, or for an insertion of the last place where it can be made.
3. What is left of a part's words is compiled into a minimised acyclic acceptor, whose start is the state that the shared
   pieces reach. The acceptor is composed with the one-edit transducer and itself: before the edit both copies are in one
   state; a replacement leads to two states by different letters, an insertion to a state and its successor; behind it
   both must accept the same rest. The pairs that a state's edits accept are found once, however many words pass it.
4. Each part gives one row per word that has a neighbour: how many, and the most frequent. These are combined per word, and
   roots follow the forms by pointer jumping; a form is ten times as frequent, so chains are short.

Defined results: a null or empty text has no words, an empty table an empty result; a null id counts as an empty one;
repeated rows are counted each; ties of a form go to the word that is smallest in code-point order; columns other than
(doc_id, text) never matter."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import ship, stored

#: A run of letters A-Z, a-z, U+00C0-U+00FF in UTF-8, lower-cased in A-Z; letters that never belong to one.
RUN, BETWEEN = re.compile(rb"(?:[a-z]+|\xC3[\x80-\xBF])+"), re.compile(rb"[\x00-@\[-`{-\x7F]")
#: Code points and occurrences of a word at least; one document and run in so many loses a code point; a form's lead.
LEAST, TIMES, LOSES, LEAD = 7, 2, 31, 10
#: Words of a part before it is split; words that a task holds; bytes of a text whose runs are listed at once.
GROUP_MOST, HELD, PIECE = 20_000, 200_000, 1 << 22


def runs(text: bytes) -> Counter:
    """Occurrences of every lower-cased run of a text."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (gap := BETWEEN.search(text, at + PIECE)):
            end = gap.start()
        found.update(RUN.findall(text[at:end].lower()))
        at = end
    return found


def worn(run: bytes, seed: int, loses: int) -> bytes:
    """The run, or one in ``loses`` of them by its checksum after ``seed`` without one code point."""
    h = zlib.crc32(run, seed)
    if h % loses:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES, loses: int = LOSES) -> DataFrame:
    """(word, n): the words of the texts of ``docs`` (doc_id, text) with ``least`` code points and ``times`` occurrences."""
    import pyarrow as pa

    def count(batches):
        found: Counter = Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(map(bytes.decode, found), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = (c.cast(pa.large_binary()).to_pylist() for c in batch.columns)
            for i, text in zip(ids, texts):
                seed = zlib.crc32(i + b":")
                for run, n in runs(text).items():
                    if len(run) >= least:
                        word = worn(run, seed, loses)
                        if len(word) >= least and (word.isascii() or len(word.decode()) >= least):
                            found[word] += n
                if len(found) > HELD:
                    yield batch_of()
                    found.clear()
        yield batch_of()

    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), empty).alias("id"), F.coalesce("text", empty).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


# --- groups of words that share all but a stretch ----------------------------------------------------------------

#: m: length of the shorter word of a pair; lo, r: first place and number of places where the edit may be; shared: the code
#: points before and after them; mid: the word's own code points there, r or (longer word) r + 1.
GROUP = ["m", "lo", "r", "shared"]


def halves(rows: DataFrame) -> DataFrame:
    """Both halves of every group: edits in the second half share the first, edits in the first half share the second."""
    h = F.floor(F.col("r") / 2).cast("int")
    before, after = F.substring("shared", F.lit(1), F.col("lo")), F.substring("shared", F.col("lo") + 1, F.col("m"))
    size = F.char_length("mid")
    second = F.struct((F.col("lo") + h).alias("lo"), (F.col("r") - h).alias("r"),
                      F.concat(before, F.substring("mid", F.lit(1), h), after).alias("shared"), F.substring("mid", h + 1, size).alias("mid"))
    kept = size - F.col("r") + h
    first = F.struct("lo", h.alias("r"), F.concat(before, F.substring("mid", kept + 1, size), after).alias("shared"),
                     F.substring("mid", F.lit(1), kept).alias("mid"))
    return rows.withColumn("half", F.explode(F.array(second, first))).select("m", "half.lo", "half.r", "half.shared", "half.mid", "n")


def groups(words: DataFrame, least: int = LEAST, most: int = GROUP_MOST) -> DataFrame:
    """The words (word, n) in all their groups, none of more than ``most`` words unless they differ in one place only."""
    size = F.char_length("word")
    whole = (words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= least)
             .select("m", F.lit(0).alias("lo"), F.col("m").alias("r"), F.lit("").alias("shared"), F.col("word").alias("mid"), "n"))
    rows, done = stored(halves(whole), "groups"), None
    while True:
        # at most rows / most groups
        large = stored(rows.where("r > 1").groupBy(GROUP).agg(F.count("*").alias("words")).where(F.col("words") > most).select(GROUP), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, GROUP, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(halves(rows.join(large, GROUP, "left_semi")), "groups")


# --- one group: minimised acceptor, composition with one edit ----------------------------------------------------


class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct words. States are numbered so that successors come first."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # open states of the last word: accepting, arcs (letter, state or None if open)
        last = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                end, arcs = path.pop()
                state = known.setdefault((end, tuple(arcs)), len(self.final))
                if state == len(self.final):
                    self.final.append(end)
                    self.arcs.append(tuple(arcs))
                path[-1][1][-1] = (path[-1][1][-1][0], state)

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                path[-1][1].append((letter, None))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        end, arcs = path.pop()
        self.start = len(self.final)
        self.final.append(end)
        self.arcs.append(tuple(arcs))

    def both(self, p: int, q: int) -> list[str]:
        """The strings that both states accept."""
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, said = stack.pop()
            if self.final[p] and self.final[q]:
                out.append(said)
            if p == q:
                stack += [(to, to, said + letter) for letter, to in self.arcs[p]]
            else:
                other = dict(self.arcs[q])
                stack += [(to, other[letter], said + letter) for letter, to in self.arcs[p] if letter in other]
        return out

    def edits(self, p: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """Pairs of strings from state ``p`` on whose edit comes first: replacements, and insertions (shorter first). An
        insertion is made at its last place: what follows doesn't begin with the letter inserted."""
        arcs = self.arcs[p]
        replaced = [(a + s, b + s) for i, (a, x) in enumerate(arcs) for b, y in arcs[i + 1:] for s in self.both(x, y)]
        inserted = [(s, a + s) for a, x in arcs if len(arcs) > 1 or self.final[p] for s in self.both(p, x) if not s.startswith(a)]
        return replaced, inserted

    def pairs(self):
        """All (shorter or smaller word, other, whether a letter was inserted) one edit apart."""
        known: dict[int, tuple] = {}
        stack = [(self.start, "")]
        while stack:
            p, said = stack.pop()
            if p not in known:
                known[p] = self.edits(p)
            replaced, inserted = known[p]
            for a, b in replaced:
                yield said + a, said + b, False
            for a, b in inserted:
                yield said + a, said + b, True
            stack += [(to, said + letter) for letter, to in self.arcs[p]]


def near_words(m: int, lo: int, r: int, mids: list[str]) -> list[tuple[str, str]]:
    """The pairs of one group: both words of length m, or one of m + 1; the edit in the group's own places."""
    return [(a, b) for a, b, longer in Acceptor(mids).pairs()
            if len(a) == r and (not longer or lo + r == m or b[:-1] != a)]


def _neighbours(batches):
    """Rows of groups, in order of group and mid, to (word, n, n_near, best): a row per word of a group with near words."""
    import pyarrow as pa

    columns = ["word", "n", "n_near", "near_n", "near"]
    out: list[tuple] = []

    def scan(key, mids, counts):
        m, lo, r, shared = key
        n = dict(zip(mids, counts))
        met: dict[str, list] = {}
        for pair in near_words(m, lo, r, mids):
            for a, b in (pair, pair[::-1]):
                own = met.setdefault(a, [0, 0, ""])
                own[0] += 1
                if n[b] > own[1] or n[b] == own[1] and b < own[2]:
                    own[1:] = n[b], b
        before, after = shared[:lo], shared[lo:]
        out.extend((before + a + after, n[a], c, k, before + b + after) for a, (c, k, b) in met.items())

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], columns)

    key, mids, counts = None, [], []
    for batch in batches:
        for m, lo, r, shared, mid, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (m, lo, r, shared) != key:
                if len(mids) > 1:
                    scan(key, mids, counts)
                key, mids, counts = (m, lo, r, shared), [], []
            mids.append(mid)
            counts.append(n)
        if len(out) > 20_000:
            yield batch_of()
            out.clear()
    if len(mids) > 1:
        scan(key, mids, counts)
    if out:
        yield batch_of()


def neighbours(words: DataFrame, least: int = LEAST, most: int = GROUP_MOST) -> DataFrame:
    """(word, n, n_near, near_n, near) of the words (word, n) with near words; near is the most frequent of them."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups(words, least, most).select(*GROUP, "mid", "n").repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "mid")
    found = rows.mapInArrow(_neighbours, "word string, n long, n_near long, near_n long, near string")
    # of equal counts the smallest word: the least of (-count, word)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return (found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")))


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, loses: int = LOSES, lead: int = LEAD,
             most: int = GROUP_MOST) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    ship(docs.sparkSession)
    words = stored(vocabulary(docs, least, times, loses), "vocabulary")
    near = stored(neighbours(words, least, most), "near")
    form = F.when(F.col("near_n") >= lead * F.col("n"), F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    formed = near.select("word", "n_near", form.alias("f")).select("word", "n_near", "f.form", "f.form_n")
    ends = stored(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ends")
    while not ends.where("moved").isEmpty():
        up = ends.select(F.col("word").alias("mid"), F.col("root").alias("top"))
        ends = stored(ends.join(up, ends["root"] == up["mid"], "left")
                      .select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "ends")
    return (words.join(formed, "word", "left").join(ends.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
