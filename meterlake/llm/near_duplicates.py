"""Near duplicates: tensored MinHash tables for candidates, exact verification, components.

1. One pass over the texts gives each document its shingle set's size, fingerprint, group keys and a
   sketch of one byte for each minhash. Equal sets are one class from here on.
2. A class whose group keys are shared by others on both sides gets the keys of those tables; in
   each table, members are tied to the smallest. Classes that are tied, directly or not, are a family.
3. Families are verified in tasks of a bounded size. The classes of a family beyond that are first
   held against single classes that they are tied to, which joins most copies in linear time; tables
   that still hold classes apart make smaller families. These are dealt into blocks, and each pair of
   blocks is a task. Pairs with agreeing sketches are compared on their full sets, except where a
   chain of verified links joins them already.
4. Components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import among, materialize, only, small_batches, spread_join, table, without
from .shingles import Tensored, fingerprint, forget, shingles

#: Shingle words and similarity in percent, unless a contract says otherwise.
WORDS, PERCENT = 5, 80
#: Groups in each of the two collections at 85 percent and minhashes in a group: 72 minhashes make 144 tables of six.
COLLECTION, GROUP = 12, 3
#: Probability that a pair at the threshold may escape all tables.
ESCAPE = 2.5e-5
#: Bytes of full sets, and classes, in a block of a family.
BLOCK_BYTES, BLOCK_CLASSES = 8_000_000, 1_024
#: Times that the classes of a larger family are held against one other class before all pairs are.
ROUNDS = 2
#: Pairs that are compared before those that a chain of links joins by then are left out.
CHUNK = 4_096
#: Standard deviations below the threshold at which sketches still send a pair to verification.
DEVIATIONS = 5.5


def groups_for(percent: int, group: int = GROUP) -> int:
    """Groups of a collection by which a pair at the threshold escapes with at most ESCAPE: 12 at 85, 16 at 80 percent."""
    missed = 1 - (percent / 100) ** group
    return max(1, math.ceil(math.log(ESCAPE / 2) / math.log(missed))) if missed else 1


def signatures(docs: DataFrame, key: str, text: str, words: int, tensored: Tensored) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, left, right, sketches = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                codes = shingles(t, words)
                sizes.append(len(codes))
                prints.append(fingerprint(codes))
                keys, sketch = tensored.signature(codes) if len(codes) else (None, b"")
                left.append(keys[0].tolist() if len(codes) else [])
                right.append(keys[1].tolist() if len(codes) else [])
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "hash", "n", "print", "left", "right", "sketch"])
        forget()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(run, "id long, hash long, n long, print binary, left array<long>, right array<long>, sketch binary")


def shared_tables(classes: DataFrame) -> DataFrame:
    """node, table, n, least: each class and each table that it shares with another, with the smallest class there.

    Only classes that share a group key of the first collection are looked up by the second one's.
    """

    def shared(rows: DataFrame, side: str) -> DataFrame:
        keyed = rows.select("node", F.explode(side).alias("key"))
        common = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("times")).filter("x < y").select("key", "times")
        return only(keyed, materialize(common, f"{side}-keys"), ["key"], "times", F.col("node")).select("node", F.col("key").alias(side))

    left = materialize(shared(classes, "left"), "left-groups")
    right = shared(among(classes, left.select("node"), "node"), "right")
    tables = materialize(left.join(right, "node").select("node", F.xxhash64("left", "right").alias("table")), "tables")
    least = tables.groupBy("table").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count("*").alias("times")).filter("least < last").drop("last")
    met = only(tables, materialize(least, "table-heads"), ["table"], "times", F.col("node"))
    return materialize(met.join(classes.select("node", "n"), "node"), "shared-tables")


def agreement(sketch: int, percent: int) -> int:
    """Agreeing sketch bytes below which a pair at the threshold lies with probability under 10**-6."""
    p = percent / 100
    return max(1, math.floor(sketch * p - DEVIATIONS * math.sqrt(sketch * p * (1 - p))))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(rows: list[tuple], first: int, second: int, percent: int) -> list[tuple[int, int]]:
    """Links that span all verified links of a task and aren't known. rows: (node, block, set, sketch,
    known), known being one for nodes that links join already; pairs lie in one block if first ==
    second, else across the two."""
    rows = sorted({r[0]: r for r in rows}.values())
    above = [i for i, r in enumerate(rows) if r[1] == first]
    beside = above if first == second else [i for i, r in enumerate(rows) if r[1] == second]
    if not above or not beside:
        return []
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    component = np.unique(np.array([r[4] for r in rows]), return_inverse=True)[1].astype(np.int32)
    least = agreement(sketches.shape[1], percent)
    pairs = []
    other = sketches[beside]
    step = max(1, 8_000_000 // other.size)
    for at in range(0, len(above), step):
        part = above[at : at + step]
        agree = (sketches[part][:, None, :] == other[None, :, :]).sum(axis=2, dtype=np.int16)
        x, y = np.nonzero(agree >= least)
        i, j = np.array(part, np.int32)[x], np.array(beside, np.int32)[y]
        ok = (i < j if first == second else i >= 0) & (component[i] != component[j])
        pairs.append((agree[x, y][ok], i[ok], j[ok]))
    agree, i, j = (np.concatenate(c) for c in zip(*pairs))
    order = np.argsort(-agree, kind="stable")  # the likeliest links first, so that they join the most
    i, j = i[order], j[order]
    links = []
    at = 0
    while at < len(i):
        apart = component[i[at:]] != component[j[at:]]
        i, j, at = i[at:][apart], j[at:][apart], 0
        for x, y in zip(i[:CHUNK].tolist(), j[:CHUNK].tolist()):
            if component[x] != component[y] and linked(sets[x], sets[y], percent):
                component[component == component[y]] = component[x]
                links.append((rows[x][0], rows[y][0]))
        at = CHUNK
    return links


def blocks_for(n: Column) -> Column:
    """Blocks that sets of n codes need, by their bytes and by their number."""
    return F.ceil(F.greatest(F.sum(n) * 8 / BLOCK_BYTES, F.count("*") / BLOCK_CLASSES)).cast("int")


def in_blocks(members: DataFrame) -> DataFrame:
    """members (node, component, n) with the number of blocks of their family and their own block."""
    sizes = materialize(members.groupBy("component").agg(blocks_for(F.col("n")).alias("blocks"), F.count("*").alias("times")), "family-sizes")
    return spread_join(members, sizes, ["component"], "times", F.col("node")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def with_sets(docs: DataFrame, key: str, text: str, members: DataFrame, words: int) -> DataFrame:
    """members (node, n, least, at, print, sketch and more) with codes, their full set, instead of at, least and print.

    Few members go to the texts; of many, only texts that a bit map takes for members' are shuffled.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    named = lambda x, y: [F.coalesce(x, F.lit(0).cast("long")).alias("_id"), F.xxhash64(F.isnull(x), y).alias("_at")]
    texts = texts.filter("id IS NOT NULL").union(texts.filter("id IS NULL").dropDuplicates(["at"])).select(*named(F.col("id"), F.col("at")), "text")
    own = [c for c in members.columns if c not in ("least", "at", "print")]
    members = materialize(members.select(*named(F.col("least"), F.col("at")), F.lit(1).alias("times"), "print", *own), "members")
    found = only(texts, members, ["_id", "_at"], "times", F.col("_at")).select("text", "print", *own)
    kinds = dict(found.dtypes)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            same = pa.array([fingerprint(x) == y for x, y in zip(sets, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([x.tobytes() for x in sets], pa.binary())], [*own, "codes"]).filter(same)
        forget()

    return found.mapInArrow(full, ", ".join([*(f"{c} {kinds[c]}" for c in own), "codes binary"]))


def task_links(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: forest() of each task (component, first, second) of dealt (and node, block, codes, sketch, known)."""
    dealt = dealt.select("component", "first", "second", "node", "block", "codes", "sketch", "known").repartition("component", "first", "second").sortWithinPartitions("component", "first", "second")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for (_, first, second), group in groupby(rows(batches), lambda r: r[:3]):
            links += forest([r[3:] for r in group], first, second, percent)
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def all_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that span all links in the families of sets, every two blocks of a family being a task."""
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return task_links(dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}), percent)


def mixed(tables: DataFrame, known: DataFrame | None, salt: int) -> DataFrame:
    """Rows of tables whose table holds classes that no known link joins: with known, and one class of the table's smallest component."""
    if known is None:
        named = tables.withColumn("known", F.col("node"))
    else:
        named = tables.join(known.select("node", F.col("component").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
    named = materialize(named.select("node", "table", "n", "known"), "known-tables")
    draw = F.struct("known", F.xxhash64("node", F.lit(salt)).alias("draw"), "node")
    heads = named.groupBy("table").agg(F.min(draw).alias("head"), F.max("known").alias("last"), F.count("*").alias("times")).filter("head.known < last")
    heads = heads.select("table", "times", F.col("head.known").alias("least"), F.col("head.node").alias("a"))
    return materialize(only(named, materialize(heads, "mixed-heads"), ["table"], "times", F.col("node")), "mixed-tables")


def star_links(found: DataFrame, sets: DataFrame, percent: int, salt: int) -> DataFrame:
    """a, b: verified links of each class of mixed() tables with one class, drawn from those that it is tied to."""
    edges = found.filter("known > least").groupBy(F.col("node").alias("b"), "n").agg(F.min_by("a", F.xxhash64("a", "node", F.lit(salt))).alias("a"))
    edges = materialize(edges, "star-edges")
    hubs = materialize(edges.groupBy("a").agg(blocks_for(F.col("n")).alias("chunks"), F.count("*").alias("times")), "star-hubs")
    leaves = spread_join(edges, hubs, ["a"], "times", F.col("b")).select(F.col("b").alias("node"), F.col("a").alias("component"), (2 * F.pmod(F.xxhash64("b"), F.col("chunks"))).cast("int").alias("first"), F.lit(1).alias("side"))
    middle = hubs.select(F.col("a").alias("node"), F.col("a").alias("component"), F.explode(F.sequence(F.lit(0), 2 * F.col("chunks") - 2, F.lit(2))).alias("first"), F.lit(0).alias("side"))
    dealt = leaves.unionByName(middle).join(sets.select("node", "codes", "sketch"), "node")
    return task_links(dealt.withColumns({"second": F.col("first") + 1, "block": F.col("first") + F.col("side"), "known": F.col("node")}), percent)


def verified_links(docs: DataFrame, key: str, text: str, classes: DataFrame, tables: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links that span all links between classes that share a table.

    A family of one block is compared whole. The classes of a larger one are held against one class
    they are tied to, ROUNDS times; tables whose classes those links join are done. What
    remains makes smaller families, and those are compared in pairs of blocks.
    """
    families = components(tables.select(F.col("least").alias("a"), F.col("node").alias("b")))
    members = families.join(classes.select("node", "least", F.col("hash").alias("at"), "print", "n", "sketch"), "node")
    members = materialize(in_blocks(members).withColumn("known", F.col("node")), "families")
    out = all_pairs(with_sets(docs, key, text, members.filter("blocks = 1"), words), percent)
    large = members.filter("blocks > 1").drop("component", "blocks", "block", "known")
    if large.isEmpty():
        return out
    sets = materialize(with_sets(docs, key, text, large, words), "family-sets")
    # tables with the same smallest class count as one: whatever shares a table shares that
    heads = tables.select("node", F.col("least").alias("table"), "n").distinct().join(sets.select("node"), "node", "left_semi")
    rest, links, known = heads, None, None
    for k in range(ROUNDS):
        rest = mixed(rest.select("node", "table", "n"), known, k)
        more = materialize(star_links(rest, sets, percent, k), "star-links")
        links = more if links is None else links.unionByName(more)
        known = components(links)
    rest = mixed(rest.select("node", "table", "n"), known, ROUNDS)
    heads = materialize(rest.groupBy("table").agg(F.min("node").alias("first"), F.count("*").alias("times")), "unresolved-heads")
    families = components(spread_join(rest.select("node", "table"), heads, ["table"], "times", F.col("node")).select(F.col("first").alias("a"), F.col("node").alias("b")))
    members = families.join(rest.select("node", "known").distinct(), "node").join(sets.select("node", "n", "codes", "sketch"), "node")
    return out.unionByName(links).unionByName(all_pairs(in_blocks(materialize(members, "unresolved-sets")), percent))


def judged(docs: DataFrame, key: str, text: str, words: int, percent: int, collection: int | None, group: int) -> DataFrame:
    """id, hash (of the text), n, component_id and kept for every row of docs, as near_duplicates() says.

    A class, the rows of equal sets, is numbered (node) and read by one row of its smallest key (least).
    """
    tensored = Tensored(collection or groups_for(percent, group), group)
    signed = materialize(signatures(docs, key, text, words, tensored), "signatures")
    first = F.min_by(F.struct("id", "hash", "n", "left", "right", "sketch"), F.struct(F.isnull("id"), F.col("id"), F.col("hash"))).alias("x")
    classes = signed.filter("n > 0").groupBy("print").agg(first, F.count("*").alias("times"))
    classes = classes.select("print", "times", F.monotonically_increasing_id().alias("node"), F.col("x.id").alias("least"), "x.hash", "x.n", "x.left", "x.right", "x.sketch")
    classes = materialize(classes, "classes")
    links = verified_links(docs, key, text, classes, shared_tables(classes), words, percent)
    joined = components(materialize(links, "links"))
    named = materialize(joined.join(classes.select("node", "least"), "node"), "linked")
    heads = materialize(named.groupBy("component").agg(F.min("least").alias("head"), F.min("node").alias("first"), F.count("*").alias("times")), "heads")
    joined = spread_join(named.select("node", "component"), heads, ["component"], "times", F.col("node"))
    found = classes.select("print", "times", "node", "least").join(joined, "node", "left")
    found = found.select("print", "times", F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("head")).alias("head"), (F.coalesce("first", "node") == F.col("node")).alias("leads"))
    rows = signed.select("id", "hash", "n", "print")
    out = spread_join(rows.filter("n > 0"), materialize(found, "answers"), ["print"], "times", F.col("id")).select("id", "hash", "n", F.col("head").alias("component_id"), "leads")
    out = out.unionByName(rows.filter("n = 0").select("id", "hash", "n", F.col("id").alias("component_id"), F.lit(True).alias("leads")))  # linked with nothing
    kept = F.when(F.col("component_id").isNull(), F.col("leads")).otherwise(F.col("id").eqNullSafe(F.col("component_id")))
    return out.select("id", "hash", "n", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, collection: int | None = None, group: int = GROUP) -> DataFrame:
    """key, n_shingles, component_id (the smallest key of the component) and kept for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles.
    Null and blank texts have no shingles and are linked with nothing. Equal texts are linked
    whatever their number. Rows that repeat a key and text are one document; those that repeat a key
    with another text are linked by their own text each. Rows with a null key are linked alike; a
    component of such rows only has a null component_id, and the rows of one of its texts are kept.
    A pair at the threshold escapes the tables with a probability of about 2 * (1 - s ** group) ** collection, 2 in 100,000 with the
    collection that groups_for() gives, which is used where none is set; nothing that is linked
    falsely passes the verification. Keys must be whole numbers; other columns are ignored; an empty
    table gives no rows.
    """
    out = judged(docs, key, text, words, percent, collection, group)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that near_duplicates() keeps, of each group those with the smallest doc_id.

    Rows are told apart by doc_id and text, so rows that repeat both stay or go together. Only the rows that go,
    and few that a bit map takes for them, meet in a shuffle.
    """
    own = lambda x, h: [F.coalesce(x, F.lit(0).cast("long")).alias("_id"), F.xxhash64(F.isnull(x), h).alias("_at")]
    gone = judged(docs, "doc_id", "text", WORDS, PERCENT, None, GROUP).filter("NOT kept").select(*own(F.col("id"), F.col("hash")))
    rows = docs.select("*", *own(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return without(rows, materialize(gone, "copies"), "_id", "_at").select("doc_id", *[c for c in docs.columns if c != "doc_id"])


OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.c)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = t.doc_id AS kept
FROM t JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
