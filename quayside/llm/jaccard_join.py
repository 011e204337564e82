"""N-gram Jaccard join by a partition of the token universe, verified exactly.

Two sets with a Jaccard similarity of at least ``percent`` / 100 differ in at
most ``(100 - percent) * (a + b) / (100 + percent)`` tokens, a and b being
their sizes. Sets are put into bands of sizes. In a band whose largest pair
may differ in H tokens, the hashed universe is cut into m = H + 1 segments.
By the pigeonhole principle two similar sets agree on a whole segment, so the
subset of a set that falls into a segment, hashed, is a signature, and similar
sets share one. A set also enters the next band if it has partners there.

An almost empty segment says little, and very many sets would share it. Such
a segment is not indexed alone: the allocation takes its unit of difference
and gives it to the next segment, which is then indexed with its
one-deletion neighbourhood. Nothing is lost by that: among the segments on
which two similar sets agree there is always one whose follower differs by
one token at most, since otherwise the differences would add up to more than
H. Whether a segment is "almost empty" depends on what is in it and on the
band alone, hence both sets of a pair decide alike.

Signatures are combined inside each map task, as counts would be: of the sets
of a task that are connected by signatures one stands for all, and is tied to
the others by a signature of their own. A signature of a third of all rows thus arrives as
one row per task. Sets that share signatures form candidate clusters; the
words of their documents are read again, and every cluster is linked exactly
in blocks of bounded size. A task of blocks compares sets in memory and
returns a spanning forest of the verified links, never the pairs.

Passages that many documents share tie documents that are not similar at all.
A cluster of more than two blocks is therefore refined before it is compared,
by prefixes: whatever the order of all tokens, two similar sets share one of
the first ``size - ceil(size * percent / 100) + 1`` tokens of each. The order
puts tokens first that few sets hold, so a set with enough tokens of its own
is tied to none, however many passages it shares. How many sets hold a token
is counted for the lowest hashes only, about twice what a prefix takes;
the others come last, and are counted as tokens of a prefix where a set has
too few low ones. A token that many sets of one task hold arrives as a count;
sets whose prefix might reach such tokens take all of theirs.

Clusters that are still very large are refined once more: a signature that
several sets share is grown by the next segment, less up to one token. Similar
sets stay together, for by the cycle lemma there is a segment from which on
the first l segments differ in l - 1 tokens at most, for every l. A signature
that one set has alone ties nothing and is dropped. What is shared is told by
a Bloom filter of bounded size; a full one only grows more signatures.

Equal sets are one class, whatever their number. Tokens and classes are known
by 64-bit hashes.

Defined results: a document without words has an empty set, no links and its
own id as component. Fewer words than ``k`` make one token. Rows that share
an id share a component if their sets do; a null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.collocations import FILTER_BITS_PER_KEY, LARGEST_FILTER, Filter
from quayside.llm.common import beside, ready, whole_text
from quayside.llm.components import connected
from quayside.llm.linear import Remembered
from quayside.session import settle

# A band ends where its sizes have grown by a half.
BAND_GROWTH = 1.5
# A segment with less than this share of the tokens it has on average is almost empty.
SPARSE = 0.25
# Signatures that a task holds before it combines and hands them on.
HELD_SIGNATURES = 1_000_000
# Bounds of one block: documents and tokens.
BLOCK_SETS, BLOCK_TOKENS = 256, 1_500_000
# Clusters of more blocks than this are refined: by prefixes, then by grown signatures. These
# multiply the signatures of true copies, which they cannot part; they are for clusters that cost more to compare.
REFINED_ABOVE = (2, 64)
# The owners of a low token are counted for so many times the tokens of a prefix.
LOW_PER_PREFIX = 2
# Tokens that a task holds before it hands them on, and from how many sets among them on a token is handed on as a count.
HELD_TOKENS, HOT = 2_000_000, 32

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, k: int):
        self.k, self.of_word = k, Remembered(xxhash.xxh64_intdigest)

    def __call__(self, text: str) -> np.ndarray:
        # Bytes know only ASCII letters and the six ASCII white-space characters.
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(self.of_word.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.k, len(words))
        rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for shift in range(width):
                rolled = rolled * _B + hashes[shift : shift + len(rolled)]
        return np.unique(mixed(rolled))


def class_of(tokens: np.ndarray) -> int:
    """The identity of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(tokens ^ _C), dtype=np.uint64) + np.uint64(len(tokens)) * _A
    return int(mixed(np.array([total]))[0].astype(np.int64))


class Bands:
    """Size bands: their smallest size and number of segments."""

    def __init__(self, percent: int):
        assert 70 <= percent <= 100, "bands are wide enough for a similarity of 0.7 and more"
        self.percent, self.lows = percent, [1]

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size or len(self.lows) < 2:
            low = self.lows[-1]
            self.lows.append(max(low + 1, int(np.ceil(low * BAND_GROWTH))))

    def low(self, band: int) -> int:
        while band >= len(self.lows):
            self._grow(self.lows[-1])
        return self.lows[band]

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size may meet a partner."""
        self._grow(size)
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        bands = [band]
        while 100 * size >= self.percent * self.low(bands[-1] + 1):
            bands.append(bands[-1] + 1)
        return bands

    def segments(self, band: int) -> int:
        largest = self.low(band + 1) - 1
        return (100 - self.percent) * 2 * largest // (100 + self.percent) + 1


def signatures(tokens: np.ndarray, bands: Bands, shared: tuple[Filter, ...] = ()) -> np.ndarray:
    """All signatures of a set. In a band of one segment only equal sets are similar; it needs none.

    ``shared`` has a filter per round of refinement: of the signatures that
    several sets have before it. Those, and only those, are grown.
    """
    found = []
    values = mixed(tokens)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        for band in bands.of(len(tokens)):
            m = bands.segments(band)
            if m == 1:
                continue
            # Tokens are sorted and segments are ranges of their high bits.
            segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            bounds = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
            subset = sums[bounds[1:]] - sums[bounds[:-1]]
            named = mixed(subset ^ mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32)))
            sparse = np.diff(bounds) < SPARSE * bands.low(band) / m

            def grown(heads: np.ndarray, start: int, length: int) -> np.ndarray:
                """Chains of ``length`` segments with the next one, less up to ``length`` tokens."""
                j = (start + length) % m
                rests = less(subset[j], values[bounds[j] : bounds[j + 1]], length)
                return mixed(mixed(rests)[None, :] ^ heads[:, None]).ravel()

            if not shared:
                found.append(named[~sparse])
            starts = np.flatnonzero(sparse | shared[0].may_hold(named) if shared else sparse)
            for i in starts.tolist():
                heads, length = named[i : i + 1], 1
                if sparse[i]:
                    heads, length = grown(heads, i, 1), 2
                for round_, held in enumerate(shared, 1):
                    heads = heads[held.may_hold(heads)]
                    if length == round_ and length < m and len(heads):
                        heads, length = grown(heads, i, length), length + 1
                found.append(heads)
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def less(total: np.uint64, values: np.ndarray, most: int) -> np.ndarray:
    """The sum of a segment without up to ``most`` (one or two) of its values."""
    sums = [np.array([total]), total - values]
    if most > 1:
        one, other = np.triu_indices(len(values), 1)
        sums.append(total - values[one] - values[other])
    return np.concatenate(sums)


def combined(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row per signature, and a signature of their own for each tie between sets that shared one.

    The third array tells which signatures several sets of the task share, the fourth which rows stand for another set.

    Ties are a spanning forest: a set is tied once to the smallest set of the
    task that it is connected with, and that one stands for it everywhere else.
    """
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    hub = classes[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    shared = np.flatnonzero(~first & (classes != hub))
    root: dict[int, int] = {}

    def find(of: int) -> int:
        while (up := root.get(of, of)) != of:
            root[of] = of = root.get(up, up)
        return of

    pairs = np.unique(np.stack([hub[shared], classes[shared]], axis=1), axis=0) if len(shared) else np.empty((0, 2), np.int64)
    for one, other in pairs.tolist():
        low, high = sorted((find(one), find(other)))
        root.setdefault(low, low)
        root[high] = low
    tied = np.array(sorted((find(member), member) for member in root), dtype=np.int64).reshape(-1, 2)
    own = mixed(mixed(tied[:, 0].astype(np.uint64)) ^ tied[:, 1].astype(np.uint64))
    standing = classes[first]
    several, stands = np.diff(np.append(np.flatnonzero(first), len(keys))) > 1, np.zeros(len(standing), dtype=bool)
    if len(tied):
        by_member = tied[np.argsort(tied[:, 1])]
        at = np.minimum(np.searchsorted(by_member[:, 1], standing), len(by_member) - 1)
        stood = np.where(by_member[at, 1] == standing, by_member[at, 0], standing)
        stands, standing = stood != standing, stood
    alone = np.zeros(2 * len(tied), dtype=bool)
    return (
        np.concatenate([keys[first], own, own]), np.concatenate([standing, tied[:, 0], tied[:, 1]]),
        np.concatenate([several, alone]), np.concatenate([stands, alone]),
    )


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the smallest position it is linked with, directly or through others.

    Parities of the tokens in a bit field tell most pairs apart: they differ
    in no more bits than the sets do in tokens. The rest is compared exactly.
    """
    n = len(sets)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    width = 1 << int(min(max(4 * int(sizes.max()), 512), 1 << 16) - 1).bit_length()
    bits = np.zeros((n, width // 64), dtype=np.uint64)
    for i, tokens in enumerate(sets):
        odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        bits[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    for i in range(1, n):
        others = np.flatnonzero(root[:i] != root[i])
        total = sizes[others] + sizes[i]
        others = others[np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * percent]
        if not len(others):
            continue
        total = sizes[others] + sizes[i]
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in others[apart * (100 + percent) <= (100 - percent) * total]:
            if root[j] == root[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return root.tolist()


def classes(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_shingles`` and ``class`` (null for an empty set)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(k)
        for batch in batches:
            sets = [shingles(text) for text in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "n_shingles": [len(s) for s in sets],
                "class": pd.array([class_of(s) if len(s) else None for s in sets], dtype="Int64"),
            })

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, n_shingles bigint, class bigint")


def shared_signatures(docs: DataFrame, k: int, percent: int, text_col: str = "text", shared: tuple[Filter, ...] = ()) -> DataFrame:
    """Signatures (``key``) of several classes, and pairs of classes ``a``, ``b`` that connect all classes which share one.

    ``a`` and ``b`` are equal where all the classes of a task that share the
    signature are tied by others.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, bands = Shingles(k), Bands(percent)
        keys, owners, seen, held = [], [], set(), 0

        def handed_on() -> pd.DataFrame:
            names, of, several, stands = combined(np.concatenate(keys), np.concatenate(owners))
            return pd.DataFrame({"key": names.astype(np.int64), "class": of, "several": several, "stands": stands})

        for batch in batches:
            for text in batch["text"]:
                tokens = shingles(text)
                if not len(tokens) or (own := class_of(tokens)) in seen:
                    continue
                seen.add(own)
                found = signatures(tokens, bands, shared)
                keys.append(found)
                owners.append(np.full(len(found), own, dtype=np.int64))
                held += len(found)
            if held >= HELD_SIGNATURES:
                yield handed_on()
                keys, owners, seen, held = [], [], set(), 0
        if held:
            yield handed_on()

    return tied(docs.select(whole_text(text_col).alias("text")).mapInPandas(run, "key bigint, class bigint, several boolean, stands boolean"))


def tied(rows: DataFrame) -> DataFrame:
    """Pairs of classes that connect all classes which share a key, from rows that :func:`combined` has made."""
    # Equal signatures come in runs; the first class of a run stands for all. Two rows of one class, of which
    # one stands for another, are several sets as well.
    by_key = Window.partitionBy("key").orderBy("class", "stands")
    return (
        rows.withColumns({"a": F.first("class").over(by_key), "place": F.row_number().over(by_key)})
        .filter("several OR a <> class OR (stands AND place > 1)")
        .select("key", "a", F.col("class").alias("b")).distinct()
    )


def prefix_length(size: int, percent: int) -> int:
    """Tokens of a set of this size, first in any order, of which similar sets share one."""
    return size - -(-percent * size // 100) + 1


def ordered_key(tokens: np.ndarray) -> np.ndarray:
    """Tokens as signed numbers of the same order."""
    return (tokens ^ np.uint64(1 << 63)).astype(np.int64)


def low_tokens(docs: DataFrame, k: int, percent: int, text_col: str = "text") -> tuple[DataFrame, int]:
    """Tokens of which prefixes are made, and the key below which their order goes by their number of owners.

    Rows are of three kinds: a token (``key``) of a ``class``; a token that ``n`` sets of a task hold, without them;
    and, with ``inside``, per class the ``wanted`` length of its prefix, how many tokens are ``inside``, and the
    ``hot`` ones among them, which are handed on as counts.
    """
    ready(docs.sparkSession)
    bound = min((100 - percent) * LOW_PER_PREFIX, 100) * (1 << 64) // 100 - (1 << 63)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(k)
        tokens, owners, wanted, held = [], [], [], 0

        def rows_of(key, class_=None, hot=None, **numbers) -> pd.DataFrame:
            columns = {"class": class_, "n": None, "wanted": None, "inside": None} | numbers
            none = pd.arrays.IntegerArray(np.zeros(len(key), np.int64), np.ones(len(key), bool))
            filled = {name: none if of is None else pd.array(of, dtype="Int64") for name, of in columns.items()}
            return pd.DataFrame({"key": key, **filled, "hot": pd.Series([None] * len(key) if hot is None else hot, dtype=object)})

        def handed_on() -> Iterator[pd.DataFrame]:
            sizes = np.array([len(t) for t in tokens])
            keys, of = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), sizes)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            counts = np.diff(np.append(begins, len(keys)))
            hot = np.empty(len(keys), dtype=bool)
            hot[order] = np.repeat(counts >= HOT, counts)
            own, counted = np.array(owners), counts >= HOT
            ends = np.cumsum(sizes)
            yield rows_of(keys[~hot], own[of[~hot]])
            yield rows_of(ordered[begins[counted]], n=counts[counted])
            parts = [keys[end - size : end][hot[end - size : end]] for size, end in zip(sizes, ends)]
            yield rows_of(own, own, wanted=wanted, inside=sizes, hot=parts)

        seen = set()
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text)
                if not len(found) or (own := class_of(found)) in seen:
                    continue
                seen.add(own)
                keys, length = ordered_key(found), prefix_length(len(found), percent)
                tokens.append(keys[: max(length, int(np.searchsorted(keys, bound)) if bound < 1 << 63 else len(keys))])
                owners.append(own)
                wanted.append(length)
                held += len(tokens[-1])
                if held >= HELD_TOKENS:
                    yield from handed_on()
                    tokens, owners, wanted, held = [], [], [], 0
                    seen.clear()
        if held:
            yield from handed_on()

    rows = docs.select(whole_text(text_col).alias("text"))
    return rows.mapInPandas(run, "key bigint, class bigint, n bigint, wanted bigint, inside bigint, hot array<bigint>"), bound


def prefixes(docs: DataFrame, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """``key`` and ``class``: the tokens of every set's prefix that another set may have in its own."""
    rows, bound = low_tokens(docs, k, percent, text_col)
    by_key = Window.partitionBy("key")
    owner = F.when(F.col("inside").isNull(), F.col("class"))
    known = rows.withColumns({
        "one": F.min(owner).over(by_key), "other": F.max(owner).over(by_key), "elsewhere": F.sum("n").over(by_key),
        "known": F.count(owner).over(by_key),
    })
    # A row per token that several sets hold, and those of the classes. What comes behind the low tokens goes by its hash.
    many = F.col("known") + F.coalesce("elsewhere", F.lit(0))
    rank = F.when(F.col("key") < F.lit(bound), many).otherwise(F.lit((1 << 63) - 1)) if bound < 1 << 63 else many
    known = known.filter("class IS NOT NULL AND (inside IS NOT NULL OR one <> other OR elsewhere IS NOT NULL)")
    sets = known.groupBy("class").agg(
        F.max("wanted").alias("wanted"), F.max("inside").alias("inside"),
        F.array_sort(F.collect_set(F.when(F.col("inside").isNull(), F.struct(rank.alias("rank"), "key")))).alias("known"),
        F.array_distinct(F.flatten(F.collect_list("hot"))).alias("hot"),
    )
    # Tokens that no other set holds come first in the prefix, and tie nothing.
    left = (F.col("wanted") - F.col("inside") + F.size(F.array_union("known.key", "hot"))).cast("int")
    sets = sets.withColumn("left", left).filter("left > 0")
    first = F.slice(F.col("known.key"), F.lit(1), F.col("left"))
    rare = F.size(F.filter("known", lambda token: token["rank"] < HOT))
    return sets.select(F.explode(F.when(rare >= F.col("left"), first).otherwise(F.array_union(first, "hot"))).alias("key"), "class")


def shared_prefixes(docs: DataFrame, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """Pairs of classes ``a``, ``b`` that connect all classes whose prefixes share a token, with that ``key``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, owners, held = [], [], 0

        def handed_on() -> pd.DataFrame:
            names, of, several, stands = combined(np.concatenate(keys).astype(np.uint64), np.concatenate(owners))
            return pd.DataFrame({"key": names.astype(np.int64), "class": of, "several": several, "stands": stands})

        for batch in batches:
            keys.append(batch["key"].to_numpy())
            owners.append(batch["class"].to_numpy())
            held += len(batch)
            if held >= HELD_SIGNATURES:
                yield handed_on()
                keys, owners, held = [], [], 0
        if held:
            yield handed_on()

    return tied(prefixes(docs, k, percent, text_col).mapInPandas(run, "key bigint, class bigint, several boolean, stands boolean"))


def key_filter(keys: DataFrame) -> Filter:
    """A filter of the signatures ``key``. Its bits are set in Spark; at most 32 MB of them come to the driver."""
    ready(keys.sparkSession)
    size = min(max(15, (keys.count() * FILTER_BITS_PER_KEY - 1).bit_length()), LARGEST_FILTER)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Filter.positions(batch["key"].to_numpy().astype(np.uint64), np.uint64((1 << size) - 1))
            yield pd.DataFrame({"place": np.concatenate(found).astype(np.int64)})

    # Spark's bitmaps of 32,768 bits count places from 1.
    at = keys.select("key").mapInPandas(places, "place bigint").select((F.col("place") + 1).alias("at"))
    bitmaps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = bytearray(1 << (size - 3))
    for row in bitmaps.toLocalIterator():
        start = (row["bucket"] - 1) * len(row["bits"])
        whole[start : start + len(row["bits"])] = row["bits"]
    return Filter(bytes(whole))


def sized(members: DataFrame) -> DataFrame:
    """Members with ``blocks``, the number of blocks in which their cluster is compared."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("tokens"))
    blocks = settle(sizes.select(
        "cluster", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("bigint").alias("blocks")
    ), "blocks")
    return settle(members.join(blocks, "cluster"), "placed")


def refined(
    docs: DataFrame, members: DataFrame, shared: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``members`` with ``blocks``, after clusters of many blocks are split as far as prefixes and grown signatures allow.

    ``shared`` are the signatures by which the clusters were found. Members
    that are left alone have no links and go.
    """
    placed = sized(members)
    for above, by_prefixes in zip(REFINED_ABOVE, (True, False)):
        large = placed.filter(F.col("blocks") > above)
        if large.isEmpty():
            break
        whole = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).hint("merge")
        texts = large.join(whole, F.col("id").eqNullSafe(F.col("_id"))).select("text")
        if by_prefixes:
            ties = shared_prefixes(texts, k, percent)
        else:
            ties = shared_signatures(texts, k, percent, "text", (key_filter(shared.select("key").distinct()),))
        ties = settle(ties.filter("a <> b").select("a", "b").distinct(), "ties")
        finer = connected(ties).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
        split = large.drop("cluster", "blocks").join(finer, "class")
        kept = placed.filter(F.col("blocks") <= above).drop("blocks")
        placed = sized(settle(kept.unionByName(split), "members"))
    return placed


def links(docs: DataFrame, placed: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of classes ``a``, ``b`` that connect what is linked inside the candidate clusters.

    ``placed`` has ``id``, ``class``, ``cluster`` and ``blocks``, a row per class.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    # A cluster of several blocks is compared block against block; a set goes to each pair with its block.
    # The texts are always shuffled to their members, whose number grows with the corpus.
    rows = (
        placed.join(texts.hint("merge"), F.col("id").eqNullSafe(F.col("_id"))).withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("blocks") < 3, F.array(F.lit(0).cast("bigint"))).otherwise(
            F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda block: block != own))))
        .select(
            "cluster", "class", "text",
            F.when(F.col("blocks") < 3, F.lit(0)).otherwise(F.least("own", "other")).cast("bigint").alias("low"),
            F.when(F.col("blocks") < 3, F.lit(0)).otherwise(F.greatest("own", "other")).cast("bigint").alias("high"),
        )
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shingles, sets = Shingles(k), {}
        for own, text in zip(group["class"], group["text"]):
            tokens = shingles(text)
            # An id that several texts share brings the others as well.
            if len(tokens) and class_of(tokens) == own:
                sets[own] = tokens
        names = sorted(sets)
        roots = linked([sets[name] for name in names], percent) if names else []
        found = [(names[r], name) for r, name in zip(roots, names) if names[r] != name]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cluster", "low", "high").applyInPandas(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Links join documents whose sets of ``k``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100.
    """
    known = settle(classes(docs, k, id_col, text_col), "classes")
    per_class = settle(
        known.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles")), "per-class"
    )
    shared = settle(shared_signatures(docs, k, percent, text_col), "shared")
    clusters = connected(shared.filter("a <> b")).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    members = settle(per_class.join(clusters, "class"), "members")
    placed = refined(docs, members, shared, k, percent, id_col, text_col)
    roots = connected(settle(links(docs, placed, k, percent, id_col, text_col), "links"))
    rooted = per_class.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "id", F.coalesce("root", "class").alias("root")
    )
    rooted = settle(rooted, "rooted")
    lowest = settle(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "lowest")
    named = settle(rooted.join(lowest, "root").select("class", "component_id"), "named")
    alone = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return known.join(named, "class", "left").select(
        F.col("id").alias(id_col), "n_shingles", alone.alias("component_id")
    )


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; documents without words all stay."""
    kept = (
        jaccard_components(docs, k, percent, id_col, text_col)
        .filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id"))
    )
    kept = settle(kept.distinct(), "kept")
    return beside(docs, [id_col, text_col], lambda rows: rows.join(kept, rows[id_col].eqNullSafe(kept["_id"]), "left_semi"))
