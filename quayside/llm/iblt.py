"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, at sentence ends, and after
``LONGEST`` characters without either. The distinct 64-bit digests of the
paragraphs are put into cells, each digest into one cell of each of three
tables; a cell holds the number of its digests, their XOR and the XOR of a
check of each. Subtracting the cells of two versions leaves the digests in
which they differ, and peeling recovers those: a cell with one digest gives it
away, and taking it out of its other cells uncovers more.

The stored fingerprint has few cells and decodes small differences. Where
peeling gets stuck, the comparison is tried again with a larger sketch: both
digest sets are divided by their bits into groups of a few digests with a
small sketch each, and a group that gets stuck again is retried with larger
ones. Peeling a group that still fails at the largest size, which takes
dozens of differing digests where a few are expected, is replaced by comparing
its digests. The likeness of two texts is the Jaccard similarity of their
digest sets, which follows from the set sizes and the number of recovered
digests.

Fingerprints alone are made of DataFrame expressions. Comparing versions takes
many small sketches a row; it is done in Python, row by row, inside the
partitions, with the same digests and cells. The only shuffle brings the texts
into the order of their ids.

Defined results: a null or empty text has no digests; two of them have the
likeness 1. Rows with equal ids are ordered by text; rows without an id come
last. A single document follows itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.session import settle

LONGEST = 240
PARAGRAPH = rf"[^.!?\n]{{1,{LONGEST}}}+[.!?\n]*+|[.!?\n]++"
# The seed of Spark's xxhash64.
SEED = 42

# Cells per table: of the stored fingerprint, and of the groups at the first try and the retries.
STORED = 8
GROUP_SIZES = (4, 16, 64)
# Digests per group, both versions together, that a retry aims at.
GROUP_DIGESTS = 4
MOST_GROUP_BITS = 16

CELL = "struct<n:int,keys:bigint,checks:bigint>"


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, table: int, width: int) -> Column:
    """The cell of a digest in one of the three tables; its low bits choose the group."""
    return F.shiftright(key, 24 + 12 * table).bitwiseAND(F.lit(width - 1))


def _put(cell: Column, times: Column, key: Column) -> Column:
    return F.struct(
        (cell["n"] + times).cast("int").alias("n"), cell["keys"].bitwiseXOR(key).alias("keys"),
        cell["checks"].bitwiseXOR(_check(key)).alias("checks"),
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(keys: Column, width: int) -> Column:
    """Three tables of ``width`` cells each, one after the other."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("keys"), F.lit(0).cast("bigint").alias("checks"))

    def of(table: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), lambda place: F.aggregate(
            F.filter(keys, lambda key: _place(key, table, width) == place), empty, lambda cell, key: _put(cell, F.lit(1), key)
        ))

    return F.concat(of(0), of(1), of(2))


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: F.struct(
        (a["n"] - b["n"]).cast("int").alias("n"), a["keys"].bitwiseXOR(b["keys"]).alias("keys"),
        a["checks"].bitwiseXOR(b["checks"]).alias("checks"),
    ))


def peel(cells: Column, width: int) -> Column:
    """The number of digests recovered from a difference, or null if some stay hidden.

    A round takes out every digest that a cell gives away. Each round but the
    last takes one at least, so as many rounds as there are cells suffice;
    rounds after the last do nothing.
    """
    def given_away(cell: Column) -> Column:
        return (F.abs(cell["n"]) == 1) & (cell["checks"] == _check(cell["keys"]))

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(state["cells"], given_away), lambda c: F.struct(c["n"].alias("n"), c["keys"].alias("key"))))

        def taken_out(found: Column) -> Column:
            def rest(cell: Column, at: Column) -> Column:
                here = F.filter(found, lambda p: (
                    F.when(at < width, _place(p["key"], 0, width)).when(at < 2 * width, _place(p["key"], 1, width) + width)
                    .otherwise(_place(p["key"], 2, width) + 2 * width) == at
                ))
                return F.aggregate(here, cell, lambda c, p: _put(c, -p["n"], p["key"]))

            return F.struct(
                F.transform(state["cells"], rest).alias("cells"),
                (state["found"] + F.size(found)).cast("int").alias("found"), (F.size(found) > 0).alias("going"),
            )

        return F.when(state["going"], _let(pure, taken_out)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("going"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(3 * width)), start, step,
        lambda end: F.when(F.forall(end["cells"], lambda c: (c["n"] == 0) & (c["keys"] == 0)), end["found"]),
    )


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of digests, then every cell."""
    return F.concat_ws("|", F.size(keys).cast("string"), F.array_join(F.transform(
        cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["keys"]), F.hex(c["checks"]))
    ), "|"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``digests``, ``cells`` and ``fingerprint`` of the whole text."""
    rows = docs.select(F.col(id_col), digests(whole_text(text_col)).alias("digests"))
    rows = rows.withColumn("cells", sketch(F.col("digests"), STORED))
    return rows.withColumn("fingerprint", as_text(F.col("digests"), F.col("cells")))


def row_digests(text: str) -> dict[int, int]:
    """As :func:`digests`, of one text: the digests and their checks, without sign."""
    keys = dict.fromkeys(xxhash.xxh64_intdigest(p.encode(), SEED) for p in re.findall(PARAGRAPH, text))
    return {key: row_check(key) for key in keys}


def row_check(key: int) -> int:
    return xxhash.xxh64_intdigest(key.to_bytes(8, "little"), SEED) & 0xFFFFFFFF


def row_put(cells: list[list[int]], width: int, key: int, check: int, times: int) -> None:
    for table in range(3):
        cell = cells[table * width + (key >> 24 + 12 * table & width - 1)]
        cell[0] += times
        cell[1] ^= key
        cell[2] ^= check


def row_sketch(pairs: list[tuple[int, int, int]], width: int) -> list[list[int]]:
    """As :func:`sketch`, of digests with their check and sign."""
    cells = [[0, 0, 0] for _ in range(3 * width)]
    for key, check, sign in pairs:
        row_put(cells, width, key, check, sign)
    return cells


def row_peel(cells: list[list[int]], width: int) -> int | None:
    """As :func:`peel`; uses up the cells."""
    found = 0
    for _ in range(3 * width):
        pure = {(n, key, check) for n, key, check in cells if n in (1, -1) and check == row_check(key)}
        if not pure:
            break
        for n, key, check in pure:
            row_put(cells, width, key, check, -n)
        found += len(pure)
    return found if not any(n or key for n, key, _ in cells) else None


def row_decoded(pairs: list[tuple[int, int, int]]) -> int:
    """Differing digests of one group of signed digests: peeled at growing sizes, compared if all get stuck.

    Digests of the other version enter the cells with a minus, which is the
    sketch of one version less that of the other. A group of one version only
    has nothing to cancel.
    """
    if abs(sum(sign for _, _, sign in pairs)) == len(pairs):
        return len(pairs)
    for width in GROUP_SIZES:
        found = row_peel(row_sketch(pairs, width), width)
        if found is not None:
            return found
    return len({key for key, _, sign in pairs if sign > 0} ^ {key for key, _, sign in pairs if sign < 0})


def row_likeness(one: dict[int, int], other: dict[int, int], one_sketch: list[list[int]], other_sketch: list[list[int]]) -> float:
    """Jaccard similarity of two digest sets, from their stored sketches or from groups with a larger one."""
    total, apart = len(one) + len(other), None
    if not total:
        return 1.0
    # Nothing to peel where the sizes alone differ by more than the stored cells can hold.
    if abs(len(one) - len(other)) <= 3 * STORED:
        apart = row_peel([[a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]] for a, b in zip(one_sketch, other_sketch)], STORED)
    if apart is None:
        bits = min(math.ceil(math.log2(max(total / GROUP_DIGESTS, 1.0))), MOST_GROUP_BITS)
        groups = defaultdict(list)
        for keys, sign in ((one, 1), (other, -1)):
            for key, check in keys.items():
                groups[key & (1 << bits) - 1].append((key, check, sign))
        apart = sum(map(row_decoded, groups.values()))
    return (total - apart) / (total + apart)


def row_text(keys: dict[int, int], cells: list[list[int]]) -> str:
    """As :func:`as_text`."""
    return "|".join([str(len(keys)), *[f"{n}.{key:X}.{check:X}" for n, key, check in cells]])


# Documents per range of ids, and quantiles that follow the density of the ids.
RANGE_ROWS = 4_000
QUANTILES = 64


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the value in the next row by descending id, in the last row that of the first.

    The ids are cut into ranges, so that no task sorts them all: quantiles
    first (a fixed number, whatever the ids), then equal widths inside each.
    Every range borrows the first row of the range after it.
    """
    ranked = docs.select(F.col(id_col).cast("bigint").alias("_id"), *columns)
    facts = ranked.agg(
        F.percentile_approx("_id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("cuts"),
        F.min("_id").alias("low"), F.max("_id").alias("high"), F.count(F.lit(1)).alias("n"),
    ).first()
    cuts = sorted({facts["low"], *(facts["cuts"] or []), facts["high"]} - {None}) or [0]
    pieces = max(-(-facts["n"] // (RANGE_ROWS * QUANTILES)), 1)
    # Where an id falls between the cuts, by bisection.
    def located(first: int, last: int) -> Column:
        if first == last:
            end = cuts[first + 1] if first + 1 < len(cuts) else cuts[first] + 1
            width = max((end - cuts[first]) // pieces, 1)
            inside = F.least(F.floor((F.col("_id") - F.lit(cuts[first])) / F.lit(width)), F.lit(pieces - 1))
            return (inside + F.lit(first * pieces)).cast("bigint")
        middle = (first + last + 1) // 2
        return F.when(F.col("_id") >= F.lit(cuts[middle]), located(middle, last)).otherwise(located(first, middle - 1))

    ranked = ranked.withColumn("_range", F.when(F.col("_id").isNull(), F.lit(-1).cast("bigint")).otherwise(located(0, len(cuts) - 1)))
    order = [F.col("_id").desc_nulls_last(), *[F.col(c) for c in columns[:1]]]
    ranges = settle(ranked.select("_range").distinct(), "ranges")
    # One row per range of thousands.
    after = ranges.withColumn("_after", F.lead("_range").over(Window.orderBy(F.desc("_range"))))
    top = ranges.agg(F.max("_range")).first()[0]
    after = after.select("_range", F.coalesce("_after", F.lit(top)).alias("_after"))
    # The first row of every range: its id is found on narrow rows, so that no text is sorted for it.
    # There is one such row per thousands, small enough to be broadcast unless Spark knows better.
    tops = settle(ranked.groupBy("_range").agg(F.max("_id").alias("_top")), "tops")
    at_top = ranked.join(tops.withColumnRenamed("_range", "_of"), (F.col("_range") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_top")))
    head = at_top.groupBy("_range").agg(F.min(F.struct(*columns)).alias("_head"))
    borrowed = after.join(head.withColumnRenamed("_range", "_after"), "_after").select(
        "_range", *[F.col(f"_head.{c}").alias(c) for c in columns], F.lit(True).alias("_borrowed")
    )
    rows = ranked.withColumn("_borrowed", F.lit(False)).unionByName(borrowed, allowMissingColumns=True)
    window = Window.partitionBy("_range").orderBy("_borrowed", *order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).filter(~F.col("_borrowed")).select(
        F.col("_id").alias(id_col), *columns, *[f"next_{c}" for c in columns]
    )


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text, its edited version, their fingerprints, and the likeness to the edited and the next text.

    The edited text has its last third replaced by the beginning of the next document.
    """
    rows = with_next(docs.select(F.col(id_col), whole_text(text_col).alias("text")), id_col, ["text"])
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(text: str) -> tuple:
            keys = row_digests(text)
            return keys, row_sketch([(key, check, 1) for key, check in keys.items()], STORED)

        def row(text: str, following: str) -> tuple:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            own, edit, after = of(text), of(edited), of(following)
            near = [row_likeness(own[0], to[0], own[1], to[1]) for to in (edit, after)]
            return len(text), edited, row_text(*own), row_text(*edit), *near

        for batch in batches:
            out = pd.DataFrame(list(map(row, batch["text"], batch["next_text"])), columns=names)
            out.insert(0, "id", batch["id"].array)
            yield out

    kinds = "n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [kind.split()[0] for kind in kinds.split(", ")]
    rows = rows.select(F.col(id_col).alias("id"), "text", "next_text")
    return rows.mapInPandas(run, f"id bigint, {kinds}").withColumnRenamed("id", id_col)
