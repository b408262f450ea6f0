"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle space gives two signature values, its minimum
and its maximum over the document's shingles; both agree between two sets with
probability equal to their Jaccard similarity. PERMS permutations thus give
2 * PERMS values, cut into bands of ROWS values.

Documents with equal shingle sets form a class at once. Classes meet in band
buckets. Each bucket links its members to its smallest one (a star, never all
pairs), and each link is confirmed on the full sets. Where the members of a
star remain in several components, the members outside the centre's component
are compared with all others, in blocks of bounded size, so that no link
between different texts is lost. Everything is a table in the shared folder;
the driver sees counts only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bitmap, mark, marked, stage, table, unstage
from docloom.llm.graph import connected_components
from docloom.ship import ship

WIDTH = 5
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 75
PERMS, ROWS = 64, 4
BANDS = 2 * PERMS // ROWS
#: Members, and shingles of all members, of a block in the comparison of what stars leave open, about.
BLOCK, BLOCK_SHINGLES = 2048, 400_000
#: Members of a star that are compared with its centre in one task, about.
CENTRE = 4096
#: Bytes of text or shingle values that are worked on at once.
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at [\\x20\\x09-\\x0D]: what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Fewer words than width make one shingle; no words make none.
    """
    lists = [words(t) for t in texts]
    flat = [w for ws in lists for w in ws]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    out, at = [], 0
    for ws in lists:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        if len(ws) >= width:
            x = h[: len(h) - width + 1].copy()
            for j in range(1, width):
                x = x * _ODD + h[j : len(h) - width + 1 + j]
        elif len(ws):
            x = np.zeros(1, np.uint64)
            for v in h:
                x = x * _ODD + v
            x = x + np.uint64(len(ws))
        else:
            x = h
        out.append(np.unique(_mix(x)))
    return out


def permutations(perms: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, perms, dtype=np.uint64)


def signatures(sets: list[np.ndarray], perms: int = PERMS) -> np.ndarray:
    """(sets, 2 * perms): minima and maxima of each permutation. All sets must have members."""
    a, b = permutations(perms)
    out = np.empty((len(sets), 2 * perms), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= CHUNK // 32):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for k in range(perms):
            y = flat * a[k]
            y += b[k]
            y ^= y >> np.uint64(29)
            out[i:j, k] = np.minimum.reduceat(y, starts)
            out[i:j, perms + k] = np.maximum.reduceat(y, starts)
        i = j
    return out


def band_keys(sigs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) 64-bit bucket keys. A band takes minima and maxima of different permutations in turn."""
    n, values = sigs.shape
    perms, bands = values // 2, values // rows
    order = np.array([[(b + j * perms // rows) % perms + perms * (j % 2) for j in range(rows)] for b in range(bands)])
    keys = np.zeros((n, len(order)), np.uint64)
    for j in range(rows):
        keys = _mix(keys * _ODD + sigs[:, order[:, j]])
    return _mix(keys + np.arange(len(order), dtype=np.uint64))


def set_digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def slices(texts: pa.Array):
    """(start, list of texts) with about CHUNK characters each."""
    i, n = 0, len(texts)
    while i < n:
        got, size, j = [], 0, i
        while j < n and (size < CHUNK or j == i):
            t = texts[j].as_py()
            got.append(t)
            size += len(t or "")
            j += 1
        yield i, got
        i = j


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for at, texts in slices(batch.column(1)):
            sets = shingle_sets(texts)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)).view(np.int64)) if full else iter(())
            bands = [next(keys) if len(s) else np.empty(0, np.int64) for s in sets]
            values = pa.array(np.concatenate(bands), pa.int64())
            offsets = pa.array(np.cumsum([0] + [len(x) for x in bands]), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, values)], schema=_SIGNED)


def _shingled(marks):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(marks.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for at, texts in slices(batch.column(1)):
                sets = shingle_sets(texts)
                values = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                offsets = pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, values)], names=["node", "members"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two small lists of sets, by counting shared members in slices."""
    out = np.zeros((len(left), len(right)), np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(lv, rv)  # what only one side has, counts nowhere
    if not len(shared):
        return out
    sides = []
    for v, i in ((lv, li), (rv, ri)):
        pos = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[pos] == v
        sides.append((pos[hit], i[hit]))
    for at in range(0, len(shared), 2048):
        parts = []
        for (pos, i), n in zip(sides, (len(left), len(right)), strict=True):
            own = (pos >= at) & (pos < at + 2048)
            m = np.zeros((n, min(2048, len(shared) - at)), np.float32)
            m[i[own], pos[own] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(inter, a, b, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the open members (side 0) and others (side 1) of one block pair that join different components."""
    open_, other = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(open_) or not len(other):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    left, right = [[np.asarray(m) for m in s["members"]] for s in (open_, other)]
    la, lb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    hit = linked(overlaps(left, right).astype(np.int64), la[:, None], lb[None, :]) & (open_["component"].to_numpy()[:, None] != other["component"].to_numpy()[None, :])
    i, j = np.nonzero(hit)
    # One link for each pair of components is enough.
    found = pd.DataFrame({"a": open_["component"].to_numpy()[i], "b": other["component"].to_numpy()[j]})
    return found.drop_duplicates()


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct shingles of five words of its whole
    text, A-Z lower-cased; with fewer words, the whole sequence. Documents are
    linked if 100 * intersection >= 75 * union. component_id is the smallest id
    that links reach. Null or blank text has no shingles and is alone: its
    component_id is its own id. Rows that repeat an id are one node. A row with
    a null id takes no part: component_id is null and kept is true. An empty
    table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed, _ = stage(given.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")
    usable = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes, _ = stage(classes, "classes")

    # Stars: each bucket's members, with its smallest member as centre.
    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met, met_path = stage(members.join(buckets, "bucket").where("node <> centre").groupBy("centre", "node").agg(F.max("size").alias("size")), "met")
    nodes = met.select("node").union(met.select(F.col("centre").alias("node"))).distinct()
    # Texts outside the bitmap of wanted ids are passed over where they are read; only sets go to the join.
    found = given.where("doc_id IS NOT NULL").select("doc_id", "text", mark("doc_id").alias("mark")).mapInArrow(_shingled(bitmap(nodes, "node")), "node long, members array<long>")
    # A repeated id gives several sets; links of any of them count.
    sets, sets_path = stage(found.join(nodes, "node", "left_semi"), "sets")

    size = F.size(F.array_intersect("x.members", "y.members")).cast("long")
    # A centre with many members has its set dealt to several tasks, CENTRE members each.
    dealt = met.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CENTRE).cast("int").alias("salts"))
    centres = dealt.join(sets, F.col("centre") == F.col("node")).select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "members")
    salted = met.join(dealt, "centre").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    pairs = salted.alias("m").join(sets.alias("x"), F.expr("m.node = x.node")).join(centres.alias("y"), F.expr("m.centre = y.centre AND m.salt = y.salt"))
    sized = pairs.select("m.node", "m.centre", F.size("x.members").cast("long").alias("p"), F.size("y.members").cast("long").alias("q"), size.alias("i"))
    links, _ = stage(sized.where(F.expr(f"100 * i >= {PERCENT} * (p + q - i)")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "links")
    first = connected_components(links)
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"))
    parts, _ = stage(nodes.join(first, "node", "left").join(sizes, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n"), "parts")

    found = _open_links(met, parts, sets)
    merged = connected_components(found)
    final = parts.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component_id"))

    own, _ = stage(classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component_id", "node").alias("component_id")), "own")
    unstage(docs.sparkSession, met_path, sets_path)
    if not usable.groupBy("doc_id").count().where("count > 1").isEmpty():
        own = _tie_repeated(usable, own)
    # Rows with a null id find no component, even of an equal text.
    out = signed.join(own, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _tie_repeated(usable: DataFrame, own: DataFrame) -> DataFrame:
    """own with the components merged that share an id."""
    rows = usable.select("doc_id", "digest").distinct().join(own, "digest")
    ties = rows.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    merged = connected_components(ties)
    return own.join(merged.select(F.col("node").alias("component_id"), F.col("component").alias("root")), "component_id", "left").select("digest", F.coalesce("root", "component_id").alias("component_id"))


def _open_links(met: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that stars left apart, as pairs of components (a, b).

    A star is settled if all its members share a component, or if no bucket
    of it had three members. In the others, each member outside the centre's
    component is compared with all members. Open members and all members are
    dealt into blocks by hash; a task gets one block of either.
    """
    part = parts.withColumnRenamed("component", "part")
    stars = met.join(part, "node").join(part.select(F.col("node").alias("centre"), F.col("part").alias("home")), "centre")
    apart = F.col("part") != F.col("home")
    unsettled = stars.groupBy("centre").agg(F.max("size").alias("size"), F.count_if(apart).alias("open"), F.sum(F.when(apart, F.col("n"))).alias("open_n"), F.count(F.lit(1)).alias("all"), F.sum("n").alias("all_n")).where("size > 2 AND open > 0 AND all > 1")
    blocks = lambda n, shingles: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    unsettled, _ = stage(unsettled.select("centre", blocks("open", "open_n").alias("open_blocks"), blocks("all", "all_n").alias("blocks")), "unsettled")
    rows = stars.join(unsettled, "centre")
    own, others = F.pmod(F.xxhash64("node"), "open_blocks"), F.pmod(F.xxhash64("node"), "blocks")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = rows.where("part <> home").select("centre", "node", "part", F.lit(0).alias("side"), own.cast("int").alias("i"), every("blocks").alias("j"))
    right = rows.select("centre", "node", "part", F.lit(1).alias("side"), every("open_blocks").alias("i"), others.cast("int").alias("j"))
    dealt = left.union(right).join(sets, "node").select("centre", "i", "j", "side", F.col("part").alias("component"), "members")
    return dealt.groupBy("centre", "i", "j").applyInPandas(_block_links, "a long, b long").distinct()


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with the columns of docs, whatever their names.

    Rows with a null id, and null or blank texts, stay. Rows that repeat an id
    go or stay together. Texts of any length are compared whole. An empty table
    gives an empty result.
    """
    kept, _ = stage(near_components(docs, id_col, text).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(kept, docs[id_col] == kept["_gone"], "left_anti")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_components() over all documents; edge cases are near_components()'s."""
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
