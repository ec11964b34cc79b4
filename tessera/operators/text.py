"""Text analytics: cleaning, fingerprints, mentions and their scores, headline similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.sources.shared import ensure_checkpoints


def clean(text: Column) -> Column:
    """Without tags, with white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), "\\s+", " "))


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def fingerprint(text: Column) -> Column:
    """sha256 of the text without white space, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")), 256)


def dedupe(docs: DataFrame, text: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """The earliest row of each fingerprint, with fp; of its columns only ``keep``, if given.

    One pass: a text is hashed once, and a minimum is taken before rows move, so a text that
    everyone copies is no hot group.
    """
    row = F.struct(*(keep or docs.columns))
    return docs.groupBy(fingerprint(F.col(text)).alias("fp")).agg(F.min_by(row, order).alias("r")).select("r.*", "fp")


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name, n): words of a text that stand in ``names`` (name), a column of lower-case words."""
    words = docs.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+")).alias("name"))
    return words.join(names, "name").groupBy(key, "name").agg(F.count("*").alias("n"))


def mention_scores(found: DataFrame, source: str) -> DataFrame:
    """Per name: damped within a source (1 + ln n), summed over sources, boosted by their number."""
    by_source = found.groupBy("name", source).agg(F.sum("n").alias("n"))
    damped = by_source.groupBy("name").agg(F.sum(1 + F.log(F.col("n"))).alias("s"), F.count("*").alias("sources"))
    return damped.select("name", "sources", (F.col("s") * (1 + 0.1 * (F.col("sources") - 1))).alias("score"))


def grams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a shorter text is one. Characters are listed once and put side by side, so long texts cost their length."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    many = F.greatest(F.size(chars) - n + 1, F.lit(0))
    out = F.slice(chars, 1, many)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(chars, k, many), lambda a, c: F.concat(a, c))
    return F.array_distinct(F.when(F.length(text) >= n, out).otherwise(F.array(text)))


#: Weight of a tile (numbers in its sets, and ROW a set), bits of a signature, numbers that have a bit of their own, pairs of a block. Fixed values.
TILE, ROW, BITS, EXACT, HIGH, WIDE = 2_000_000, 32, 512, 1024, 64, 2048


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with n and g in place of ``text``: its distinct bigrams, as numbers. A text of one character, and one of none, have a number of their own."""
    others = [c for c in rows.columns if c != text]

    def numbers(t: str) -> np.ndarray:
        points = np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        return np.unique(points[:-1] << 21 | points[1:]) if len(points) > 1 else -1 - (points + 1).sum(keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbers(t or "") for t in batch.column(text).to_pylist()]
            n = np.array([len(x) for x in found], dtype=np.int32)
            g = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(n), g], names=[*others, "n", "g"])

    fields = [rows.schema[c] for c in others]
    return rows.mapInArrow(run, StructType([*fields, StructField("n", IntegerType(), False), StructField("g", ArrayType(LongType(), False), False)]))


def _differ(table: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers of the rows that begin a group other than that of the row before."""
    found = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for c in by:
        column = table.column(c).combine_chunks()
        found |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found) + 1


def _together(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole groups of sorted rows: several small ones, or a large one, at a time."""
    held, weight = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = _differ(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]).select(by), by)
        if held and len(begin) and weight >= TILE // 4:
            cut = int(begin[-1]) - 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, weight, batch = [], 0, batch.slice(cut)
        held.append(batch)
        weight += batch.num_rows * ROW + len(batch.column("g").flatten())
    if held:
        yield pa.Table.from_batches(held)


class _Bits:
    """Sets as bits: exact ones of the numbers that most sets hold, and signatures, where each bit tells whether an odd number of members fall on it.

    The signatures of two sets differ in at most as many bits as members are in one of them alone, and so do their halves laid upon each other.
    """

    def __init__(self, g: pa.ListArray, n: np.ndarray) -> None:
        listed = g.flatten().dictionary_encode()
        at = listed.indices.to_numpy()
        self.n, self.values = n, len(listed.dictionary)
        rank = np.empty(self.values, dtype=np.int64)
        rank[np.argsort(-np.bincount(at, minlength=self.values), kind="stable")] = np.arange(self.values)
        place, row, ends = rank[at], np.repeat(np.arange(len(n)), n), np.concatenate([[0], n.cumsum()])
        self.exact = np.zeros((len(n), EXACT // 64), dtype=np.uint64)
        signature = np.zeros((len(n), BITS // 64), dtype=np.uint64)
        for lo in range(0, len(n), WIDE):
            hi = min(lo + WIDE, len(n))
            p, r = place[ends[lo] : ends[hi]], row[ends[lo] : ends[hi]] - lo
            odd = np.bincount(r * BITS + p % BITS, minlength=(hi - lo) * BITS).reshape(-1, BITS) & 1
            signature[lo:hi] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
            own = np.zeros((hi - lo, EXACT), dtype=np.uint8)
            own[r[p < EXACT], p[p < EXACT]] = 1
            self.exact[lo:hi] = np.packbits(own, axis=1).view(np.uint64)
        self.folds = {}
        while True:
            self.folds[signature.shape[1]] = np.ascontiguousarray(signature.T)
            if signature.shape[1] == 1:
                break
            signature = signature[:, : signature.shape[1] // 2] ^ signature[:, signature.shape[1] // 2 :]
        rest = place >= EXACT
        self.rest_n = np.bincount(row[rest], minlength=len(n))
        self.rest = np.sort(row[rest] * self.values + place[rest])
        self.rest_at = np.concatenate([[0], self.rest_n.cumsum()])

    def apart(self, words: int, x: slice | np.ndarray, y: slice | np.ndarray) -> np.ndarray:
        """Bits in which signatures of so many words differ: of each row of x and each of y (slices), or of pairs."""
        side = (lambda w: w[x][:, None]) if isinstance(x, slice) else (lambda w: w[x])
        out = None
        for w in self.folds[words]:
            d = np.bitwise_count(side(w) ^ w[y])
            out = (d.astype(np.uint16) if words > 2 else d) if out is None else np.add(out, d, out=out)
        return out

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Members that both sets of each pair hold."""
        out = np.bitwise_count(self.exact[x] & self.exact[y]).sum(axis=1, dtype=np.int64)
        few = np.where(self.rest_n[x] <= self.rest_n[y], x, y)
        open_ = np.flatnonzero(self.rest_n[few])
        upto = self.rest_n[few[open_]].cumsum()
        # so many pairs at a time that their members are about as many as a tile's
        for part in np.split(open_, np.flatnonzero(np.diff(upto // TILE)) + 1) if len(open_) else []:
            mine, other, count = few[part], (x + y - few)[part], self.rest_n[few[part]]
            pair = np.repeat(np.arange(len(part)), count)
            member = self.rest[np.arange(len(pair)) - np.repeat(count.cumsum() - count, count) + self.rest_at[mine][pair]] % self.values
            wanted = other[pair] * self.values + member
            found = self.rest[np.minimum(np.searchsorted(self.rest, wanted), len(self.rest) - 1)] == wanted
            out[part] += np.bincount(pair[found], minlength=len(part))
        return out

    def alike(self, a: range, b: range, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows of a and b, each sorted by size, and their similarities; of a range and itself those whose first row comes first."""
        sizes, far = self.n[b.start : b.stop], (1 - least) / (1 + least)
        for i in range(a.start, a.stop, HIGH):
            high = min(i + HIGH, a.stop)
            low, top = np.searchsorted(sizes, [self.n[i] * least - 1e-6, self.n[high - 1] / least + 1e-6])
            for j in range(max(b.start + low, i if a == b else 0), b.start + top, WIDE):
                wide = min(j + WIDE, b.start + top)
                both = int(self.n[high - 1]) + int(self.n[wide - 1])
                words = next((k for k in (1, 2, 4) if both <= 80 * k), BITS // 64)
                x, y = np.divmod(np.flatnonzero(self.apart(words, slice(i, high), slice(j, wide)) <= int(both * far + 1e-6)), wide - j)
                x, y = x + i, y + j
                if a == b and j < high:
                    x, y = x[x < y], y[x < y]
                keep = self.apart(BITS // 64, x, y) <= (self.n[x] + self.n[y]) * far + 1e-6
                x, y = x[keep], y[keep]
                if len(x):
                    shared = self.shared(x, y)
                    similarity = shared / (self.n[x] + self.n[y] - shared)
                    keep = similarity >= least
                    yield x[keep], y[keep], similarity[keep]


def _compared(by: list[str], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the two tiles of each group (by) of rows, sorted by it, late and n; a group without late rows is a tile and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, by):
            bits = _Bits(table.column("g").combine_chunks(), table.column("n").to_numpy().astype(np.int64))
            key, late = table.column("key").combine_chunks(), table.column("late").to_numpy()
            begin = [0, *_differ(table, by).tolist(), table.num_rows]
            itself = table.column("itself").to_numpy()
            held, many = [], 0
            for lo, hi in zip(begin, begin[1:]):
                cut = lo + int(np.searchsorted(late[lo:hi], 1))
                for found in bits.alike(range(lo, hi), range(lo, hi), least) if itself[lo] else bits.alike(range(lo, cut), range(cut, hi), least):
                    held.append(found)
                    many += len(found[0])
                    if many >= WIDE * HIGH:
                        yield _pairs(key, held)
                        held, many = [], 0
            if many:
                yield _pairs(key, held)

    return run


def _pairs(key: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y, similarity = (np.concatenate(part) for part in zip(*found))
    return pa.RecordBatch.from_arrays([key.take(pa.array(x)), key.take(pa.array(y)), pa.array(similarity)], names=["x", "y", "similarity"])


def _alike(rows: DataFrame, on: list[str], least: float) -> DataFrame:
    """Pairs (a, b, similarity) of keys, a < b, of one on..., whose sets (on..., key, n, g: distinct numbers, one at least) are as similar as that.

    The rows of on..., sorted by size, are cut into tiles of bounded weight. Sets as alike are of like size, so a row goes
    once to each tile that holds such sizes, with its own, and any two rows that may be alike meet in one task. There
    signatures are compared first, and full sets only where these allow it. All pairs of like size are gone through: the
    time is quadratic in their number, what a task holds is not.
    """
    sizes = rows.where("key is not null").groupBy(*on, "n").agg(F.count("key").alias("many"))
    weight = F.col("n") + ROW
    step = 10**6  # parts of a logarithm
    width = math.ceil(-math.log(least) * step) + 2
    ordered = Window.partitionBy(*on).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = Window.partitionBy(*on).orderBy(F.floor(F.ln("n") * step)).rangeBetween(-width, width)
    tile = lambda w: F.floor(w / TILE).cast("long")
    sizes = sizes.withColumn("before", F.sum(F.col("many") * weight).over(ordered) - F.col("many") * weight)
    sizes = sizes.withColumn("low", F.min(tile(F.col("before"))).over(reached)).withColumn("high", F.max(tile(F.col("before") + F.col("many") * weight - 1)).over(reached))
    placed = rows.where("key is not null").join(sizes, [*on, "n"]).withColumn("tile", tile(F.col("before") + F.pmod(F.xxhash64("key"), F.col("many")) * weight))
    placed = placed.withColumn("other", F.explode(F.sequence("low", "high")))
    one, two = F.least("tile", "other"), F.greatest("tile", "other")
    placed = placed.select(*on, one.alias("one"), two.alias("two"), (F.col("tile") > F.col("other")).cast("int").alias("late"), (one == two).alias("itself"), "key", "n", "g")
    by = [*on, "one", "two"]
    # tasks have little to read and much to compare: as many as the session has, not as their bytes ask for
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["key"].dataType
    schema = StructType([StructField("x", kind), StructField("y", kind), StructField("similarity", DoubleType())])
    pairs = placed.repartition(parts, *by).sortWithinPartitions(*by, "late", "n").mapInArrow(_compared(by, least), schema)
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_headlines(docs: DataFrame, key: str, text: str, least: float, block: list[str]) -> DataFrame:
    """Pairs (a, b) in one block whose headlines' bigrams are similar; rows with equal headlines are one, known by the smallest key."""
    heads = docs.select(*block, F.lower(clean(F.col(text))).alias("head"), F.col(key).alias("key")).groupBy(*block, "head").agg(F.min("key").alias("key"))
    pairs = _alike(_sets(heads, "head"), block, least)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def layered(docs: DataFrame, key: str, text: str, layers: dict[str, list[str]]) -> DataFrame:
    """(key, layer, term): of each layer of terms the longest that the text holds, letters in any case. The layers are a short list in the plan."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = []
    for layer, terms in layers.items():
        ordered = sorted((t.lower() for t in terms), key=lambda t: (-len(t), [-ord(c) for c in t]))
        term = F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in ordered])
        found.append(F.struct(F.lit(layer).alias("layer"), term.alias("term")))
    return docs.select(key, F.explode(F.array(*found)).alias("x")).select(key, "x.*").where("term is not null")


def named(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, name, n): names found from left to right, none inside another; of those that begin at one place the first in the list.

    A name that ends in a digit is not found before another digit. The list is part of the plan, so it holds hundreds, not millions.
    """
    quoted = ["\\Q" + n + "\\E" + ("(?![0-9])" if n[-1].isdigit() else "") for n in names]
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("|".join(quoted)), F.lit(0))
    return docs.select(key, F.explode(found).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))


def source_fingerprint(text: Column, media: Column, least: int = 20) -> Column:
    """Fingerprint of a text; a text shorter than ``least`` characters is known by its media instead, if it has any."""
    short = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")) < least
    return F.when(short & (F.coalesce(media, F.lit("")) != ""), F.sha2(media, 256)).otherwise(fingerprint(text))


def growth(mentions_: DataFrame, since: str, until: str) -> DataFrame:
    """Per name: damped score of the window against that of the time before it; mentions_: (name, source, at, n).

    A source counts 1 + ln n in each of the two, so that none outshouts the others.
    """
    window = F.when(F.col("at").between(since, until), "now").when(F.col("at") < since, "before")
    by = mentions_.withColumn("w", window).where("w is not null").groupBy("name", "source", "w").agg((1 + F.ln(F.sum("n"))).alias("s"))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("w") == k, F.col("s"))), F.lit(0.0))
    both = by.groupBy("name").agg(side("now").alias("score"), side("before").alias("baseline"))
    return both.withColumn("growth", F.col("score") / (F.col("baseline") + 1))


def pairs_in_time(docs: DataFrame, key: str, text: str, ts: str, seconds: int, least: float, block: list[str]) -> DataFrame:
    """Pairs (a, b) of one block whose texts' bigrams are similar and whose times lie within ``seconds``. Keys name one row each.

    A row stands in its stretch of time and in the next one, so that near rows share one.
    """
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = docs.select(*block, F.struct(F.col(key).alias("key"), at.alias("at")).alias("key"), F.lower(clean(F.col(text))).alias("t"))
    stretch = F.floor(F.col("key.at") / seconds)
    placed = _sets(rows, "t").withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    pairs = _alike(placed, [*block, "stretch"], least).where(F.abs(F.col("a.at") - F.col("b.at")) <= seconds)
    return pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def clusters(keys: DataFrame, pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(key, cluster): the smallest key that pairs lead to; a key without a pair is its own cluster.

    Each round passes on the smallest label of the neighbours and follows it once, so long
    chains take few rounds; a round ends in a checkpoint, which cuts its lineage.
    """
    ensure_checkpoints(keys.sparkSession)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct().checkpoint()
    labels = keys.select(F.col("key"), F.col("key").alias("cluster")).distinct().checkpoint()
    for _ in range(most_rounds):
        passed = both.join(labels.withColumnsRenamed({"key": "b", "cluster": "c"}), "b").groupBy(F.col("a").alias("key")).agg(F.min("c").alias("c"))
        least = labels.join(passed, "key", "left").select("key", F.least("cluster", "c").alias("cluster"))
        up = least.select(F.col("key").alias("cluster"), F.col("cluster").alias("up"))
        new = least.join(up, "cluster").select("key", F.col("up").alias("cluster")).checkpoint()
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new
    raise RuntimeError(f"clusters are not settled after {most_rounds} rounds")


def search(docs: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows any of whose columns holds the text as it is written: no character of it is a wildcard."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return docs.where(hit)
