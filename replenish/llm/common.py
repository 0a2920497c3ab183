"""Helpers shared by the training-data operators: tables in the shared folder, connected components,
word hashing over byte buffers, fixed-size id bitmaps."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.session import scratch_path

#: Blank characters of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: ContextVar[tuple] = ContextVar("open", default=())

#: Spark deletes a job's shuffle files when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """The session's ``key`` is ``value`` inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint folder and read it back: lineage ends here and a
    lost executor costs a re-read. The folder has to live as long as results that read it (see ``passing``)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with setting(spark, SHUFFLES_GO, "true"):
        df.write.parquet(f"{path}/t")
    out = spark.read.schema(df.schema).parquet(f"{path}/t")
    out.scratch = path
    if scopes := _open.get():
        scopes[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.pop("scratch", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def passing():
    """Tables ``stored`` inside are deleted at the end, but for those given to the function that this yields."""
    own, outer = [], _open.get()
    token = _open.set((*outer, own))

    def keep(table: DataFrame) -> DataFrame:
        own[:] = [t for t in own if t is not table]
        if outer:
            outer[-1].append(table)
        return table

    try:
        yield keep
    finally:
        _open.reset(token)
        dropped(*own)


#: Rows that Spark hands to Python at once, where they are whole texts.
TEXTS_AT_ONCE = 2_000


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside hand ``TEXTS_AT_ONCE`` rows to Python at once at most: a batch of texts lies in the executor's
    and its Python worker's memory, there in several forms."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    with setting(spark, key, now if 0 < now <= TEXTS_AT_ONCE else TEXTS_AT_ONCE):
        yield


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application, once (they needn't have it installed). The archive
    stays in the driver's temp folder until the driver ends, as Spark serves it from there."""
    import atexit
    import os
    import shutil
    import tempfile
    import zipfile

    import replenish

    home, sc = os.path.dirname(replenish.__file__), spark.sparkContext
    if sc.applicationId in _shipped or not os.path.isdir(home):
        return
    folder = tempfile.mkdtemp(prefix="replenish-workers-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, "replenish_workers.zip"), "w") as z:
        for at, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.join("replenish", os.path.relpath(os.path.join(at, n), home)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join on a unique right key with hot keys split off: rows whose key is in ``hot`` (a table of bounded size) meet
    their right rows in a broadcast join; in the shuffle of the others they are dealt out evenly by a salt that no right
    row has."""
    names = [c for c in right.columns if c != key]
    hot_right = F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names]))
    spread = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1000))
    marked = (left.join(hot_right, left[key] == F.col("__key"), "left")
              .withColumn("__salt", F.when(F.col("__key").isNull(), F.lit(0).cast("long")).otherwise(spread)))
    return (marked.join(right.withColumn("__salt", F.lit(0).cast("long")), [key, "__salt"], "left")
            .select(*left.columns, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in names]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph of ``edges`` (u, v): one row (node, root) per node that has an edge to
    another node; root is the smallest node of the component. Nulls must be filtered out before.

    Each round hooks every node to its smallest neighbour (a combinable minimum, so a hub is pre-aggregated before the
    shuffle), flattens the trees by pointer jumping and contracts the edges to the roots. Every tree holds two nodes at
    least, so the number of rounds is logarithmic. Only emptiness tests reach the driver."""
    with passing() as keep:
        return keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    e = stored(edges.where(F.col("u") != F.col("v"))
               .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    found = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")) \
            .union(e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        p = stored(both.groupBy("node").agg(F.min("other").alias("other"))
                   .select("node", F.least("node", "other").alias("root")), "hooks")
        while True:
            up = p.where("node != root").select(F.col("node").alias("mid"), F.col("root").alias("top"))
            q = stored(p.join(up, p["root"] == up["mid"], "left")
                       .select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")),
                       "jumps")
            before, p = p, q
            if q.where("moved").isEmpty():
                break
            dropped(before)
        p = p.select("node", "root")
        if found is None:
            found = p
        else:
            nxt = p.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            found = found.join(nxt, found["root"] == nxt["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
        pu, pv = p.toDF("u", "ru"), p.toDF("v", "rv")
        last = e
        e = stored(e.join(pu, "u").join(pv, "v").where("ru != rv")
                   .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        dropped(last)
    if found is None:
        found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(found, "components")


# --- words as 64-bit hashes, computed over whole Arrow buffers -------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of an Arrow string column (nulls count as empty)."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = 1 << 20):
    """Runs [i, j) of rows with about ``most`` bytes together (a single longer row stays whole)."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, lower-casing A-Z; and the n + 1 offsets of each text's words.

    A word is a maximal run of bytes that ``is_word`` allows (default: all but blanks), inside one text. A word's hash
    is a polynomial in its bytes modulo 2^64, finished by a mixer."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_IS_BLANK[raw] if is_word is None else is_word[raw]
    first = np.empty(n, bool)
    first[0] = inside[0]
    first[1:] = inside[1:] & ~inside[:-1]
    cut = at[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    end = np.flatnonzero(last) + 1
    low = _LOWER[raw]
    # Horner's rule over all words at once: step k takes the k-th byte of the words that have one
    size = end - start
    h = size.astype(np.uint64) * _ODD
    longest = int(size.max()) if len(size) else 0
    if longest <= 64:
        rest = np.arange(len(start))
        for k in range(longest):
            if k:
                rest = rest[size[rest] > k]
            h[rest] = h[rest] * _ODD + _BYTE[low[start[rest] + k]]
    else:
        short = size <= 64
        rest = np.flatnonzero(short)
        for k in range(64):
            if k:
                rest = rest[size[rest] > k]
            if not len(rest):
                break
            h[rest] = h[rest] * _ODD + _BYTE[low[start[rest] + k]]
        import xxhash
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh64_intdigest(low[start[i]:end[i]].tobytes(), 7)
    return mix(h), np.searchsorted(start, at).astype(np.int64)


# --- id bitmaps: a fixed-size superset filter ------------------------------------------------------------------

#: Bits of an id bitmap: 2 MB on the driver and in each worker, however many ids there are.
BITMAP_BITS = 1 << 24


def bitmap(ids: Column) -> Column:
    """Bit number of an id."""
    return F.pmod(F.xxhash64(ids), F.lit(BITMAP_BITS))


def collect_bitmap(df: DataFrame, col: str) -> np.ndarray:
    """The set of bits that the values of ``col`` occupy, as 2^18 64-bit words: its size is fixed, so nothing that
    grows with the data reaches the driver. With very many ids it fills up and filters less; it never loses one."""
    bit = bitmap(F.col(col))
    words = (df.select((bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("b"))
             .groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toArrow())
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def row_key(doc_id: Column, text: Column) -> Column:
    """Hash of a row's id and text."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` isn't in ``gone`` (key), all columns as they were. Rows that miss the
    fixed-size bitmap of the keys stay where they are; only the others, all that go among them, are shuffled and joined."""
    ship(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(collect_bitmap(gone, "key"))

    @F.pandas_udf("boolean")
    def hit(bit: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, bit.to_numpy()))

    # the input travels as one column, so its own columns may have any name
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    keyed = keyed.withColumn("hit", hit(bitmap(F.col("key"))))
    far = keyed.where("hit").join(gone.select("key"), "key", "left_anti")
    return keyed.where("not hit").select("row.*").unionByName(far.select("row.*"))
