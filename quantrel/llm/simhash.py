"""Operator 10: SimHash near-duplicates by pivot distance tables, in DataFrame expressions only.

A fingerprint has 64 bits; a bit is set where over half of the shingles' XXH64 values have it set. Each
distinct fingerprint gets a table of Hamming distances to PIVOTS reference fingerprints. By the
triangle inequality no coordinate of a linked pair differs by more than RADIUS, and as the three
bands of bits cannot all differ within RADIUS = 2, in one band at least the distances to the
references, taken over that band alone, agree. So pairs are met by an equality join on a band's coordinates,
pairs whose largest coordinate difference exceeds RADIUS are discarded, and survivors are verified by bit_count.

A cell (equal band coordinates) of over CELL fingerprints is dealt anew: the bits outside its bands fall into three bands
again, of which a linked pair agrees in one, and its members meet by the references' distances over that band besides. Each round
leaves two thirds of the bits open (43, 29, 19, 13, 9, 6), so what can be in one cell shrinks to some dozens of fingerprints, and all
cells of the last round are paired. Copies share a fingerprint and are never expanded to pairs.

Defined cases: null and empty texts, and texts of blanks, have fingerprint zero, which links like any other. Repeated
rows (and ids) each keep their row. A component whose ids are all null has a null component_id. An
empty table gives an empty result. Extra columns, whatever their names, pass through keep_one().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialise, one_of_each, reserve, split_words, table, upto
from .components import components

SHINGLE, RADIUS = 3, 2
PIVOTS, BAND_PIVOTS = 16, 10
#: Cells of at most so many fingerprints are paired; larger ones are dealt to further bands, at most MAX_DEPTH times.
CELL, MAX_DEPTH = 48, 5


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def pivot(i: int) -> int:
    """Reference fingerprint i, from a mixing rule over i."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return signed(x ^ x >> 31)


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle; a text of fewer words is one shingle, one without words a null."""

    def hashes(w: Column) -> Column:
        grams = F.transform(upto(F.size(w) - (size - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(size)))))
        return F.when(F.size(w) >= size, grams).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array(F.lit(None).cast("long")))

    return let(split_words(lower_ascii(F.coalesce(text.cast("string"), F.lit("")))), hashes)


def fingerprints(df: DataFrame, keys: list[str], text: str, size: int = SHINGLE) -> DataFrame:
    """keys, mult (rows with that key), fp. Bits are counted two to a sum, in the halves of a long."""
    rows = df.select(*keys, F.posexplode(shingle_hashes(F.col(text), size)).alias("p", "h"))
    halves = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(long(0x100000001))).alias(f"s{k}") for k in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum((F.col("p") == 0).cast("long")).alias("mult"), F.count("h").alias("n"), *halves)
    bits = []
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(long(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}", 32)
        bits += [F.when(2 * low > F.col("n"), long(1 << k)).otherwise(long(0)), F.when(2 * high > F.col("n"), long(signed(1 << k + 32))).otherwise(long(0))]
    while len(bits) > 1:
        bits = [reduce(Column.bitwiseOR, bits[i : i + 8]) for i in range(0, len(bits), 8)]
    return sums.select(*keys, "mult", bits[0].alias("fp"))


def distance_table(prints: DataFrame) -> DataFrame:
    """fp, d0.. (distances to the references) for distinct fingerprints."""
    return prints.select("fp", *(F.bit_count(F.col("fp").bitwiseXOR(long(pivot(i)))).cast("byte").alias(f"d{i}") for i in range(PIVOTS)))


def parts_of(open_bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Three nearly equal runs of the bits that no band has settled."""
    n = len(open_bits)
    return [open_bits[i * n // 3 : (i + 1) * n // 3] for i in range(3)]


def band_cell(bits: tuple[int, ...]) -> Column:
    """The distances over these bits to their references, six bits each."""
    mask = sum(1 << b for b in bits)
    within = F.col("fp").bitwiseAND(long(signed(mask)))
    distances = [F.shiftleft(F.bit_count(within.bitwiseXOR(long(signed(pivot(PIVOTS + i) & mask)))).cast("long"), 6 * i) for i in range(BAND_PIVOTS)]
    return reduce(Column.bitwiseOR, distances)


def dealt(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of (fp, d0.., band, cell) dealt to the three bands of the bits that are open after `depth` rounds: band is the path of bands, cell a
    hash of the cells along it."""

    def at(path: tuple[int, ...], open_bits: tuple[int, ...]) -> list[tuple[tuple[int, ...], list[tuple[int, ...]]]]:
        parts = parts_of(open_bits)
        if len(path) == depth:
            return [(path, parts)]
        return [x for i in range(3) for x in at((*path, i), tuple(b for b in open_bits if b not in parts[i]))]

    columns = [c for c in rows.columns if c not in ("band", "cell")]
    keys = F
    for path, parts in at((), tuple(range(64))):
        own = F.array(*(F.struct(F.lit("".join(map(str, (*path, i)))).alias("band"), (F.xxhash64("cell", band_cell(p)) if depth else band_cell(p)).alias("cell")) for i, p in enumerate(parts)))
        keys = keys.when(F.col("band") == "".join(map(str, path)), own)
    return rows.select(*columns, F.explode(keys).alias("c")).select(*columns, "c.band", "c.cell")


def paired(cell_rows: DataFrame) -> DataFrame:
    """Links among the members of each cell: coordinates discard, bit_count verifies."""
    a, b = cell_rows.alias("a"), cell_rows.alias("b")
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    largest = F.greatest(*(F.abs(F.col(f"a.d{i}").cast("int") - F.col(f"b.d{i}").cast("int")) for i in range(PIVOTS)))
    return a.join(b, near & (largest <= RADIUS) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def link_table(prints: DataFrame) -> DataFrame:
    """Links (a, b): all pairs of distinct fingerprints within RADIUS."""
    links = None
    rows = distance_table(prints).withColumns({"band": F.lit(""), "cell": F.lit(0).cast("long")})
    for depth in range(MAX_DEPTH + 1):
        placed = dealt(rows, depth)
        sizes = placed.groupBy("band", "cell").agg(F.count("fp").alias("members")).where(F.col("members") > 1)
        sized = materialise(placed.join(sizes, ["band", "cell"]), "simhash-sized")
        small = F.col("members") <= CELL if depth < MAX_DEPTH else F.lit(True)
        found = paired(sized.where(small).drop("members"))
        links = found if links is None else links.union(found)
        rows = sized.where(~small).drop("members")
        if depth == MAX_DEPTH or rows.isEmpty():
            break
    return links.distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), fp (long), root, component (smallest id reachable) and mult, a row for each distinct id, text and input partition."""
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t")).withColumn("part", F.spark_partition_id())
    own = materialise(fingerprints(rows, ["part", "id", "th"], "t").select("id", "th", "fp", "mult"), "simhash-prints")
    prints = own.groupBy("fp").agg(F.min("id").alias("first_id"))
    found = materialise(components(link_table(prints.select("fp"))), "simhash-roots").select(F.col("v").alias("fp"), "root")
    rooted = materialise(prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return own.join(rooted.join(least, "root").select("fp", "root", "component"), "fp")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null ids last), then of the smallest hash of its text; columns as they were.

    Of rows that repeat both, that of the smallest hash of all its columns stays.
    """
    n = reserve(df, "id", "th", "own")
    best = near_duplicates(df, id_column, text).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "th")).alias("b"))
    keep = best.select(F.col("b.id").alias(n["id"]), F.col("b.th").alias(n["th"]))
    marked = df.withColumn(n["own"], F.xxhash64(F.col(f"`{text}`").cast("string")))
    kept = marked.join(keep, F.col(f"`{id_column}`").eqNullSafe(F.col(n["id"])) & (F.col(n["own"]) == F.col(n["th"])), "left_semi")
    return one_of_each(kept, [id_column, n["own"]]).drop(n["own"])


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
