"""Near-duplicates by MinHash: banded minima, verified signatures, confirmed sets, components.

A document's set is its distinct shingles of lower-case words. Documents whose sets are equal form a class first, so copies
cost one row each from there on. Classes meet in the buckets of ``BANDS`` bands of
``ROWS`` minima; at a similarity of 0.8 one in 2 * 10**7 pairs shares no bucket.

A bucket is never expanded into pairs. First each bucket names a pivot, the member with most
bucket-mates overall, and every other member is compared with it; that settles most buckets, for
their members are then in one component. In the buckets that still hold several components, members of
different components are compared inside tasks of bounded size, and only links that join
two components leave the task. Larger buckets are dealt out to pairs of chunks. Signatures screen (five standard
errors below the threshold), full sets confirm.

Defined results: a document without words has an empty set and is linked with nothing; one with
fewer words than a shingle has one shingle, the whole sequence; a null id takes no part in links, is
kept and has no component; rows of one id are one document for linking, also if their texts differ or some have no words, and keep a
row each; all columns but id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.batches import Texts, pieces
from tierwalk.llm.components import components
from tierwalk.llm.shingles import BANDS, N_MINIMA, band_keys, linked, set_hashes, shingle_sets, signatures
from tierwalk.workspace import Workspace

#: Members of a bucket that one task compares with each other.
CHUNK = 2_048


def least_agreement(percent: int) -> int:
    """Equal minima below which a pair cannot reach the similarity, but for five standard errors."""
    p = percent / 100
    return max(0, int(N_MINIMA * p - 5 * (N_MINIMA * p * (1 - p)) ** 0.5))


def sketches(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, s1, s2, signature: a byte per minimum, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sets = shingle_sets(Texts(batch.column(1)), size)
            signature, pair = signatures(sets), set_hashes(sets)
            some = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
            low = signature.astype(np.uint8)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(pair[:, 0]),
                    pa.array(pair[:, 1]),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(signature)[some].ravel())),
                ],
                ["id", "n_shingles", "s1", "s2", "signature", "bands"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_shingles bigint, s1 bigint, s2 bigint, signature binary, bands array<bigint>"
    return docs.select(key, text).mapInArrow(run, schema)


def _sets_of(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, signature, set, bands) of rows: the set as bytes of ascending hashes, the bands as bytes of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sets = shingle_sets(Texts(batch.column(1)), size)
            signature = signatures(sets)
            columns = (signature.astype(np.uint8), sets, band_keys(signature))
            whole = pa.record_batch(
                [batch.column(0), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in columns)], ["id", "signature", "words", "keys"]
            )
            yield whole.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))  # a repeated id may also have rows without words

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, signature binary, words binary, keys binary")


def _agreement(column: pa.Array, other: pa.Array) -> np.ndarray:
    a = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, N_MINIMA)
    b = np.frombuffer(b"".join(other.to_pylist()), np.uint8).reshape(-1, N_MINIMA)
    return (a == b).sum(axis=1)


def _confirm(pairs: DataFrame, percent: int, kind: str) -> DataFrame:
    """The links (a, b) among pairs (id, signature, words, pivot, pivot_signature, pivot_words)."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = np.flatnonzero(_agreement(batch.column(1), batch.column(4)) >= least) if batch.num_rows else []
            links = [
                i for i in close
                if linked(np.frombuffer(batch.column(2)[i].as_py(), np.uint64), np.frombuffer(batch.column(5)[i].as_py(), np.uint64), percent)
            ]
            rows = pa.array(links, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(3).take(rows)], ["a", "b"])

    columns = ("id", "signature", "words", "pivot", "pivot_signature", "pivot_words")
    return pairs.select(*columns).mapInArrow(run, f"a {kind}, b {kind}")


def spanning_links(
    label: np.ndarray, part: np.ndarray, band: int, signature: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links between members of different labels, as many as it takes to join what is linked.

    Only pairs whose first common band is ``band`` count, as others meet in an earlier bucket, and, if there are two parts, only
    pairs across them. Bands are compared by ``keys``, which the buckets are made of: low bytes also agree where no bucket is shared.
    """
    n, least = len(label), least_agreement(percent)
    _, group = np.unique(label, return_inverse=True)
    size = np.array([len(s) for s in sets])
    earlier = keys[:, :band]
    waiting, out = np.ones(n, bool), []
    across = len(np.unique(part)) > 1
    for p in np.argsort(np.bincount(group)[group], kind="stable").tolist():
        waiting[p] = False
        fit = waiting & (group != group[p]) & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
        if across:
            fit &= part != part[p]
        near = np.flatnonzero(fit)
        near = near[(signature[near] == signature[p]).sum(axis=1) >= least]
        near = near[~(earlier[near] == earlier[p]).any(axis=1)]
        if not len(near):
            continue
        flat = np.concatenate([sets[q] for q in near])
        at = np.minimum(np.searchsorted(sets[p], flat), size[p] - 1)
        both = np.add.reduceat((sets[p][at] == flat).astype(np.int64), np.cumsum(size[near]) - size[near])
        for q in near[100 * both >= percent * (size[near] + size[p] - both)].tolist():
            if group[q] != group[p]:
                group[group == group[q]] = group[p]
                out.append((p, q))
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least id reachable over links), kept."""
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    kind = docs.schema[key].dataType.simpleString()
    all_sketches, _ = space.save(sketches(docs, size, key, text), "sketches")
    classes = all_sketches.where("id IS NOT NULL AND n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    classes, _ = space.save(classes, "classes")
    # Ids whose rows have different sets join the classes of these.
    several = all_sketches.where("id IS NOT NULL").groupBy("id").agg(
        F.min(F.struct("s1", "s2")).alias("low"), F.max(F.struct("s1", "s2")).alias("high")
    )
    several, n_several = space.save(several.where("low <> high").select("id"), "several")
    # Classes of equal size of set and bands: the rows of their first documents.
    firsts = all_sketches.join(classes.select(F.col("first").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi")
    banded = firsts.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets, _ = space.save(banded.join(crowded, "bucket"), "buckets")
    popular = buckets.groupBy("id").agg(F.sum("n").alias("mates"))
    buckets = buckets.join(popular, "id")
    pivots = buckets.groupBy("bucket").agg(F.max_by("id", F.struct("mates", F.xxhash64("id"))).alias("pivot"))
    pivoted, _ = space.save(buckets.join(pivots, "bucket").select("bucket", "band", "id", "n", "pivot"), "pivots")
    members, _ = space.save(
        _sets_of(docs.select(F.col(key).alias(key), text).join(popular.select(F.col("id").alias(key)), key, "left_semi"), size, key, text),
        "members",
    )
    pairs = pivoted.where("id <> pivot").select("id", "pivot").distinct()
    pairs = pairs.join(members, "id").join(
        members.select(F.col("id").alias("pivot"), F.col("signature").alias("pivot_signature"), F.col("words").alias("pivot_words")), "pivot"
    )
    links, _ = space.save(_confirm(pairs, percent, kind), "links")
    if n_several:
        same = all_sketches.join(several, "id", "left_semi").join(classes, ["s1", "s2"]).select(F.col("first").alias("a"), F.col("id").alias("b"))
        same, _ = space.save(same.where("a <> b").distinct(), "same")
        links = links.unionByName(same)
    labels, _ = space.save(components(links, space, "near"), "labels")
    rest = _rest(pivoted, labels, members, percent, kind)
    more, n_more = space.save(rest, "more")
    if n_more:
        labels = components(links.unionByName(more), space, "all")
    named = classes.join(labels, F.col("first") == F.col("node"), "left").select(
        "s1", "s2", F.coalesce("component", "first").alias("component"), "n", "first"
    )
    # Only classes of several rows, or linked with others, say more than the row's own id.
    named = named.where((F.col("n") > 1) | (F.col("component") != F.col("first"))).select("s1", "s2", "component")
    out = all_sketches.select("id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    none = F.col("id")
    if n_several:  # a row without words goes with the other rows of its id
        out = out.join(several.join(labels, F.col("id") == F.col("node")).select("id", F.col("component").alias("of_id")), "id", "left")
        none = F.coalesce("of_id", "id")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(none)
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )


def _rest(pivoted: DataFrame, labels: DataFrame, members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) across components inside the buckets that still hold several."""
    left = pivoted.where("id <> pivot").join(labels, F.col("id") == F.col("node"), "left").select(
        "bucket", "band", "id", "n", F.coalesce("component", "id").alias("label")
    )
    mixed = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_rows = left.join(mixed.select("bucket"), "bucket", "left_semi")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    dealt = open_rows.select("bucket", "band", "id", "label", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("other")
    dealt = dealt.join(members, "id").select("bucket", "x", "y", "band", "id", "label", "part", "signature", "words", "keys")

    def run(table: pa.Table) -> pa.Table:
        names = table.column("id").combine_chunks()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, N_MINIMA)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
        sets = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        # In the order of ids, so that a repeated task finds the same links.
        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
        label, part = (table.column(c).to_numpy()[order] for c in ("label", "part"))
        band = table.column("band")[0].as_py()
        found = spanning_links(label, part, band, signature[order], keys[order], [sets[i] for i in order], percent)
        a, b = ([int(order[pair[side]]) for pair in found] for side in (0, 1))
        return pa.table({"a": names.take(pa.array(a, pa.int64())), "b": names.take(pa.array(b, pa.int64()))})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")
