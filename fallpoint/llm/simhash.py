"""Near-duplicates by SimHash with multi-index hashing.

Fingerprints are made in the tasks that read the text; from then on only distinct
fingerprints travel.  Each is filed under each of its two halves.  Of two fingerprints that
differ in at most two bits, one half differs in at most one; so each half is looked up together
with its Hamming ball of radius one, and whole distances are verified in the join.  Of
two halves that differ in one bit exactly one has that bit set, so clearing set bits is enough
to enumerate the ball.  A fingerprint has at most 64 + 2016 others within two bits, so the
links grow in proportion to the distinct fingerprints however large a group of copies is.

Fingerprints of 64 bits do not find all texts of a given Jaccard similarity.  ``near_representatives``
therefore also joins the texts on the first shingles of each set in one common order: sets that are similar
enough share one there, so no pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallpoint.llm.common import only_rows, prepared, row_key, store, text_of
from fallpoint.llm.components import components

WORDS = 3  # of a shingle in the plain query
SEED = 42
MASK = 0xFFFFFFFF
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text: a bit is set where over half of the shingles' XXH64 values have it set.

    Words are runs of non-ASCII-space characters after lower-casing A-Z; fewer words than a shingle
    make one shingle of all, none make zero.
    """
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(parts) - words + 1
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1:].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(POWERS[2 * counts > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, *more: Column) -> DataFrame:
    """doc_id, fp (64 bits as a long) and ``more`` columns of every row; null text counts as empty."""
    prepared(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, text_of(text_col).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.columns[-1]), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in one or two bits; ``distinct`` holds (id, fp), each fp once."""
    low, high = F.col("fp").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("fp", 32)
    halves = distinct.select("id", "fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half")),
                                                          F.struct(F.lit(1).alias("side"), high.alias("half")))).alias("h"))
    table = halves.select("h.side", "h.half", "id", "fp")
    half = F.col("half")
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), k)))),
                    lambda x: x != half)
    probes = table.select("side", F.explode(F.concat(F.array(half), ball)).alias("half"), F.col("id").alias("p_id"), F.col("fp").alias("p_fp"),
                          half.alias("own"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("p_fp")))
    # An exact half meets its like from both ends; one order is enough there.
    once = (F.col("own") != half) | (F.col("p_id") < F.col("id"))
    return probes.join(table, ["side", "half"]).where((distance <= 2) & (F.col("p_id") != F.col("id")) & once).select(
        F.col("p_id").alias("a"), F.col("id").alias("b"))


def near_groups(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of up to two bits lead to, the row's own included.

    Fingerprints are the nodes, so ids that are null or repeated with other texts link nothing.  Null ids are
    carried along without being a smallest id unless a group has no other.  Repeated rows each stay.
    """
    prints = store(prints, "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = components(links(distinct.select(F.col("fp").alias("id"), "fp")))
    named = distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "group").select("fp", "component_id"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, fingerprint (16 lower-case hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows each give a row; an empty
    table gives no rows; other columns are ignored.  A text is hashed whole by the task that reads it, however long.
    """
    groups = near_groups(fingerprints(docs, id_col, text_col, words))
    hexed: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select(F.col("doc_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


SHINGLE, SIMILARITY = 5, 0.8


BLOCK = 65_536  # words that are hashed at once


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than a shingle make one of all.  Beside the words a long text takes the hashes of one block."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(parts) - words + 1)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, BLOCK):
        some = parts[at:at + BLOCK + words - 1]
        m = min(BLOCK, n - at)
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:m].tolist()
        stops = ends[words - 1:].tolist() if len(some) >= words else [len(joined)]
        out[at:at + m] = np.fromiter((xxh64_intdigest(joined[x:y]) for x, y in zip(starts, stops)), dtype=np.uint64, count=m)
    return np.unique(out)


def slices(batch: pa.RecordBatch, text_at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about ``most`` bytes; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.nonzero(np.diff(piece))[0] + 1).tolist(), batch.num_rows]
    for x, y in zip(cuts, cuts[1:]):
        if y > x:
            yield batch.slice(x, y - x)


def rare_first(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Distinct shingles in an order common to all texts: those that are not in ``late`` first, each part as given."""
    if not len(late):
        return tokens
    last = np.isin(tokens, late, assume_unique=True)
    return np.concatenate((tokens[~last], tokens[last]))


PLACES = 1 << 22  # bits by which a scan tells most texts that are not wanted


def shingle_sets(texts: DataFrame, wanted: DataFrame, words: int = SHINGLE, hot: np.ndarray | None = None) -> DataFrame:
    """item, fp and the text's shingles as an array of longs, of ``texts`` (_sha, text) that are in ``wanted`` (item, fp, _sha).

    The tasks that read the texts leave out most others by a table of ``PLACES`` bits, so that few sets are
    shuffled; the join leaves out the rest.  With ``hot`` the shingles are in the order of ``prefixes`` and a text comes once for each of its rows.
    """
    places = wanted.select(F.pmod("item", F.lit(PLACES)).alias("place")).distinct().toArrow()["place"].to_numpy()  # PLACES rows at most
    bits = np.zeros(PLACES, dtype=bool)
    bits[places] = True
    shipped = texts.sparkSession.sparkContext.broadcast((np.packbits(bits), np.zeros(0, np.uint64) if hot is None else hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, late = np.unpackbits(shipped.value[0]).astype(bool), shipped.value[1]
        for b in batches:
            some = b.filter(pa.array(asked[b.column(2).to_numpy(zero_copy_only=False)], pa.bool_()))
            for part in slices(some, 1):
                sets = [rare_first(shingles(t.as_py(), words), late).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets))], names=["_sha", "shingles"])

    place = F.pmod(F.xxhash64("_sha"), F.lit(PLACES)).alias("place")
    found = texts.select("_sha", text_of("text"), place).mapInArrow(run, "_sha string, shingles array<long>")
    found = found.join(wanted, "_sha")
    return (found.dropDuplicates(["_sha"]) if hot is None else found).select("item", "fp", "shingles")


HOT_SAMPLE, HOT_TIMES, HOT_MOST = 64, 3, 100_000  # one text of so many is asked; shingles met so often in it; at most so many


def hot_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts share, by a sample.  They only come last in the order: results do not hang on them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["token"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select(text_of("text")).mapInArrow(run, "token long")
    often = some.groupBy("token").count().where(F.col("count") >= HOT_TIMES).orderBy(F.desc("count"), "token").limit(HOT_MOST)
    return np.sort(often.select("token").toArrow()["token"].to_numpy().view(np.uint64))


def prefix_length(size: int, least: float) -> int:
    """So many shingles of a set, in a common order, hold one of every set that is similar enough."""
    return size - math.ceil(least * size - 1e-6) + 1


def prefixes(texts: DataFrame, hot: np.ndarray, least: float = SIMILARITY) -> DataFrame:
    """token, item, size: the first shingles of every text, rare ones before hot ones and then by hash; size is that of the whole set."""
    shipped = texts.sparkSession.sparkContext.broadcast(hot)  # HOT_MOST entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shipped.value
        for b in (part for whole in batches for part in slices(whole, 1)):
            tokens, sizes, taken = [np.zeros(0, np.uint64)], [], []
            for t in b.column(1):
                x = shingles(t.as_py())
                tokens.append(rare_first(x, late)[:prefix_length(len(x), least)])
                sizes.append(len(x))
                taken.append(len(tokens[-1]))
            items = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(items, taken), pa.int64()),
                                              pa.array(np.repeat(np.array(sizes, np.int32), taken), pa.int32())], names=["token", "item", "size"])

    return texts.select("item", text_of("text")).mapInArrow(run, "token long, item long, size int")


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Fingerprints (a, b) of the pairs (item, other) whose sets of shingles overlap in at least that share of their union.

    The sets meet in Spark's own rows, one pair at a time, so no batch of pairs is held."""
    mine = sets.select("item", F.col("fp").alias("a"), "shingles")
    theirs = sets.select(F.col("item").alias("other"), F.col("fp").alias("b"), F.col("shingles").alias("shingles_b"))
    both = pairs.join(mine, "item").join(theirs, "other")
    common = F.size(F.array_intersect("shingles", "shingles_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("shingles") + F.size("shingles_b")).alias("sizes"))
    return counted.where(F.col("common") >= F.lit(least) * (F.col("sizes") - F.col("common"))).select("a", "b")


def likely(matches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (item, other) that share as many first shingles as similar sets of their sizes must; one row of ``matches``
    (item, size, other, size_b) for each shared one."""
    taken = lambda n: 1 - F.ceil(F.lit(least) * F.col(n) - 1e-6)  # prefix less size
    overlap = F.ceil(F.lit(least / (1 + least)) * (F.col("size") + F.col("size_b")) - 1e-6)
    counted = matches.groupBy("item", "other", "size", "size_b").count()
    return counted.where(F.col("count") >= overlap + F.least(taken("size"), taken("size_b"))).select("item", "other")


LARGE = 128  # texts of a shingle that are compared two by two; larger groups are divided


def leaders(rows: DataFrame) -> DataFrame:
    """item, size, other: every text of ``rows`` (token, item, size) with the smallest one of each of its groups."""
    least = F.min(F.struct("size", F.col("item").alias("other"))).alias("l")
    return rows.join(rows.groupBy("token").agg(least), "token").select("item", "size", "l.other").where("item <> other").distinct()


def divided(met: DataFrame, sets: DataFrame, led: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to leaders, and the places (token, item, size, gap, early) at which the texts of one leader meet.

    ``met`` is that of ``leaders``, ``sets`` and ``led`` are the ordered shingles of the texts and of the leaders.  Two texts
    differ from each other where their differences from the leader differ.  So of two similar ones the one with fewer
    differences (``gap``) has one of its early places in common with a place of the other: first the shingles that the leader
    lacks, rare ones first, then those that few texts lack.  Only two that differ from the leader at no common place have
    none; they are similar to each other only if both are to the leader, and linked.
    """
    mine = sets.select("item", F.col("fp").alias("a"), "shingles")
    theirs = led.select(F.col("item").alias("other"), F.col("fp").alias("b"), F.col("shingles").alias("shingles_b"))
    own, missing = F.array_except("shingles", "shingles_b"), F.array_except("shingles_b", "shingles")
    # So many places and no more lie between a text and a similar one; at most half of them are only the one's that has fewer.
    most = F.floor(F.lit((1 - least) / least) * F.col("size") + 1e-6).cast("int")
    both = mine.join(met, "item").join(theirs, "other").select(
        "item", "size", "other", "a", "b", (F.size("shingles") + F.size("shingles_b")).alias("sizes"), own.alias("own"), missing.alias("missing"))
    both = both.withColumn("gap", F.size("own") + F.size("missing")).withColumn("far", F.size("own") > most)
    both = both.withColumns({"own": F.slice("own", 1, most + 1), "missing": F.when(~F.col("far"), F.col("missing"))})
    both = store(both.dropDuplicates(["item", "other"]), "differences")
    common = (F.col("sizes") - F.col("gap")) / 2
    found = both.where(common >= F.lit(least) * (F.col("sizes") - common)).select("a", "b")
    base = ["item", "size", "other", "gap"]
    first = both.select(*base, F.posexplode("own").alias("at", "place")).select(*base, "place", (F.col("at") + 1).alias("at"))
    lacking = both.select(*base, F.size("own").alias("before"), F.explode("missing").alias("place"))
    often = lacking.groupBy("other", "place").agg(F.count("*").alias("n"))
    behind = F.row_number().over(Window.partitionBy("other", "item").orderBy("n", "place"))
    last = lacking.join(often, ["other", "place"]).select(*base, "place", (F.col("before") + behind).alias("at"))
    places = first.union(last).where(F.col("at") <= most + 1)
    return found, places.select(F.xxhash64("other", "place").alias("token"), "item", "size", "gap", (F.col("at") <= F.floor(most / 2) + 1).alias("early"))


def similar_links(docs: DataFrame, prints: DataFrame, known: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """Links (a, b) of fingerprints that, with ``known`` ones, connect all texts of at least that Jaccard similarity.

    ``prints`` holds (fp, _sha) of the rows.  Texts that share a first shingle are candidates.  In ``rounds`` rounds the
    texts of a shingle meet one of them, the leader, which puts large groups together with few pairs.  Groups that are still
    larger than ``LARGE`` are divided by what differs from a leader.  Then all pairs of a group that are not yet connected
    meet: no pair is left out, and those of one component need no look.
    """
    keyed = docs.select(row_key(id_col, text_col)[1], F.col(text_col).alias("text"))
    texts = keyed.select(F.xxhash64("_sha").alias("item"), "text")
    hot = hot_shingles(texts)
    tokens = prefixes(texts, hot, least)
    fit = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-6
    fits = fit(F.col("size"), F.col("size_b"))
    # Where only two texts share a shingle, their sizes tell at once.
    shared = tokens.groupBy("token").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    shared = shared.where((F.col("lo") != F.col("hi")) & ((F.col("n") > 2) | fit(F.col("least"), F.col("most")))).select("token")
    live = store(tokens.join(shared, "token").distinct(), "shared-shingles")
    numbered = store(prints.select("_sha", "fp", F.xxhash64("_sha").alias("item")).distinct(), "items")

    def wanted(items: DataFrame) -> DataFrame:
        return store(numbered.join(items.distinct(), "item"), "candidate-texts")

    def verified(candidates: DataFrame) -> DataFrame:
        pairs = store(candidates, "candidates")
        texts = wanted(pairs.select("item").union(pairs.select("other")))
        return store(similar(pairs, store(shingle_sets(keyed, texts), "shingles"), least), "links")

    def opened(rows: DataFrame) -> DataFrame:
        found = components(known).select(F.col("node").alias("fp"), "component")
        named = numbered.join(found, "fp", "left").select("item", F.coalesce("component", "fp").alias("comp")).distinct()
        rows = rows.join(named, "item")
        apart = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        return store(rows.join(apart, "token"), "open-shingles")

    def marked(rows: DataFrame) -> DataFrame:
        # Of two components at least one is not the largest of the shingle, so its rows (few) meet all others and the largest one's do not meet each other.
        most = rows.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp"))["comp"].alias("largest"))
        return rows.join(most, "token").withColumn("few", F.col("comp") != F.col("largest")).drop("largest")

    def others(rows: DataFrame) -> DataFrame:
        return rows.select("token", *[F.col(c).alias(d) for c, d in (("item", "other"), ("size", "size_b"), ("comp", "comp_b"), ("few", "few_b"))],
                           *[F.col(c).alias("gap_b") for c in rows.columns if c == "gap"])

    # Which of two is named first may differ by shingle.
    ordered = [F.when(F.col("item") < F.col("other"), F.col(x)).otherwise(F.col(y)).alias(x)
               for x, y in (("item", "other"), ("other", "item"), ("size", "size_b"), ("size_b", "size"))]

    for k in range(rounds):
        rows = opened(live)
        leader = F.min(F.struct(F.xxhash64("item", F.lit(k)), F.col("item").alias("other"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b")))
        met = rows.join(rows.groupBy("token").agg(leader.alias("l")), "token").select("item", "size", "comp", "l.other", "l.size_b", "l.comp_b")
        new = verified(likely(met.where((F.col("comp") != F.col("comp_b")) & fits), least))
        if new.isEmpty():
            break
        known = known.union(new)
    rows, parts = opened(live), None
    large = store(rows.groupBy("token").count().where(F.col("count") > LARGE).select("token"), "large-groups")
    if not large.isEmpty():
        met = store(leaders(rows.join(large, "token")), "leaders")
        led = store(shingle_sets(keyed, wanted(met.select(F.col("other").alias("item"))), hot=hot).dropDuplicates(["item"]), "shingles")
        new, places = divided(met, shingle_sets(keyed, wanted(met.select("item")), hot=hot), led, least)
        known = known.union(store(new, "links"))
        places = store(places, "places")
        shared = places.groupBy("token").agg(F.count("*").alias("n"), F.max("early").alias("early")).where("n > 1 and early").select("token")
        places = store(places.join(shared, "token"), "places")
        near = opened(places)  # texts of one place are often copies of each other: one of them puts most together
        first = near.groupBy("token").agg(F.min(F.struct(F.xxhash64("item"), F.col("item").alias("other"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"))).alias("l"))
        met = near.join(first, "token").select("item", "size", "comp", "l.other", "l.size_b", "l.comp_b")
        known = known.union(verified(met.where((F.col("comp") != F.col("comp_b")) & fits).select("item", "other").distinct()))
        parts = marked(opened(places))
        rows = opened(live.join(large, "token", "left_anti"))
    rows = marked(rows)
    once = ~F.col("few_b") | (F.col("item") < F.col("other"))
    met = rows.where("few").join(others(rows), "token").where((F.col("comp") != F.col("comp_b")) & once & fits).select(*ordered)
    # A pair that shares a divided shingle as well meets in the parts, so the number of shared shingles is whole for the others.
    candidates = likely(met, least)
    if parts is not None:
        fewer = (F.col("comp") != F.col("comp_b")) & (F.struct("gap", "item") < F.struct(F.col("gap_b"), F.col("other"))) & fits
        for early, late in ((parts.where("early and few"), others(parts)), (parts.where("early and not few"), others(parts).where("few_b"))):
            candidates = candidates.union(early.join(late, "token").where(fewer).select(*ordered[:2]))
    return known.union(verified(candidates.distinct()))


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, wider: bool = True) -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest id, of a null id only where there is no other.

    Fingerprints within two bits are linked.  With ``wider``, all texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more are linked as well, however far apart their fingerprints are.
    Rows that repeat id and text count once; where an id is repeated with other texts of the group, the
    text with the smallest digest stays.
    """
    prints = store(fingerprints(docs, id_col, text_col, words, *row_key(id_col, text_col)), "fingerprints")
    known = store(links(prints.select(F.col("fp").alias("id"), "fp").distinct()), "links")
    if wider:
        known = similar_links(docs, prints, known, id_col, text_col)
    found = components(known).select(F.col("node").alias("fp"), "component")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_sha", "_key")).alias("first")
    first = prints.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(one).select("first.*")
    return only_rows(docs, first.select("_key", "_sha"), id_col, text_col)
