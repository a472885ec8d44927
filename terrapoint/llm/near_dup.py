"""Near-duplicate documents by Order MinHash, with verification by banded alignment.

A text is the sequence of its `k`-word shingles (lower-cased words, without punctuation), each labelled with its
occurrence number, so that no two are equal. A sketch keeps, for one hash function, the `l` smallest labelled shingles
in the order of the text: two texts share it when they share these shingles in the same order, which edits and moves
both disturb. Texts that share a sketch are candidates; the two sequences are then aligned inside a band, and the pair
is linked when the longest common run of aligned shingles is at least `similarity` of all different positions:
aligned / (m + n - aligned). Wider bands can't hold a pair that is similar enough, so the band loses nothing.

Texts with equal words are one node, named by the digest of their words, and take part once. Each group that shares a
sketch is compared with its most central member, the one whose sketches are shared by most: one pair a text and sketch
at most. Classes are the connected parts of the links. Pairs that these stars leave open, members of one group in
different parts, are then looked at too, every one, in blocks of bounded size: a parity bit map of the two shingle sets
is a lower bound of their difference, so that only pairs that may be similar enough are aligned. Every pair that shares
a sketch is thus linked, in one part already, or known not to be similar, whatever the group's size.

Edge cases: null, empty and wordless texts are classes of their own, one each; texts of under k words are one shingle;
texts of any length are used whole; repeated rows fall into one class; a class is named by its smallest doc_id, and
rows without an id belong to the class of their words (its name is null where no row has an id); rows that share a
doc_id but no text are judged by their texts; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapoint.llm.common import IdFilter, discard, fresh, scratch, staged, trimmed

_WORD = re.compile(r"\w+")
_KEPT_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio
_KNOWN: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word of the lower-cased text."""
    words = _WORD.findall(text.lower())
    if len(_KNOWN) > _KEPT_WORDS:
        _KNOWN.clear()
    known = _KNOWN
    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, each mixed with its occurrence number; empty without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(0x100000001B3) + words[i : len(words) - k + 1 + i])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        places = np.arange(len(out))
        occurrence = np.empty(len(out), dtype=np.uint64)
        occurrence[order] = places - np.maximum.accumulate(np.where(new, places, 0))
        out = np.where(occurrence > 0, _mixed(out + occurrence * _MIX), out)
    return out


def sketches(labelled: np.ndarray, seeds: np.ndarray, l: int) -> np.ndarray:
    """One 64-bit value a seed: the l smallest shingles under that seed's hash, in text order."""
    n = len(labelled)
    l = min(l, n)
    out = seeds.copy()
    step = max(1, (1 << 20) // n)
    for at in range(0, len(seeds), step):
        hashed = (labelled[None, :] ^ seeds[at : at + step, None]) * _MIX
        hashed ^= hashed >> np.uint64(32)
        hashed *= _MIX
        picked = np.argpartition(hashed, l - 1, axis=1)[:, :l] if l < n else np.broadcast_to(np.arange(l), (len(hashed), l))
        for column in labelled[np.sort(picked, axis=1)].T:
            out[at : at + step] = _mixed(out[at : at + step] * np.uint64(31) + column)
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of aligned shingles over all different positions; 0 where the band shows it is under `least`."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(at_a - at_b) <= band
    if inside.sum() < least * (n + m) / (1 + least) - 1e-9:
        return 0.0
    at_a, at_b = at_a[inside], at_b[inside]
    ends: list[int] = []  # the longest increasing run of places in b, in the order of a
    for place in at_b[np.argsort(at_a)].tolist():
        i = bisect_left(ends, place)
        if i == len(ends):
            ends.append(place)
        else:
            ends[i] = place
    return len(ends) / (n + m - len(ends))


def parity(labelled: np.ndarray) -> np.ndarray:
    """1,024 bits: for each, whether an odd number of the shingles falls on it. Two texts' maps differ in as many bits
    as their shingles differ, at most."""
    places = ((labelled * _MIX) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=1024).astype(np.uint8) & 1).view(np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digest(words: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(words.tobytes()) if len(words) else None


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and th, a hash of the text by which the few rows that matter are found again."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def grouped(docs: DataFrame, k: int = 5, l: int = 3, count: int = 16, similarity: float = 0.8, block_bytes: int = 4 << 20, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, th, digest (of the row's words; null without any), root (digest that names its class), class_id, words_id
    and links of every row; see classes()."""
    spark = docs.sparkSession
    seeds = np.random.default_rng(seed).integers(1, 2**63, size=count, dtype=np.uint64)
    rows = _numbered(docs, id_column, text_column)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    names, made = [], []
                    for text in part.column(1).to_pylist():
                        words = word_hashes(text or "")
                        names.append(_digest(words))
                        made.append(_signed(sketches(shingles(words, k), seeds, l)).tolist() if len(words) else None)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.binary()), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "th", "digest", "s"])

    digests = staged(rows.mapInArrow(trimmed(digest), "doc_id long, th long, digest binary, s array<bigint>"), "near-digests")
    nodes = digests.where("digest is not null").groupBy(F.col("digest").alias("id"))
    nodes = staged(nodes.agg(F.min("doc_id").alias("words_id"), F.min("th").alias("th"), F.first("s").alias("s")), "near-nodes")

    # One key for each sketch; only keys that several texts share go on, as one row a text.
    keys = nodes.select("id", F.posexplode("s").alias("j", "key")).select("id", "j", F.xxhash64("j", "key").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(shared, "near-shared")  # written: both sides of the join are then dealt anew, and a hot key can be split
    held = keys.join(shared, "key").groupBy("id").agg(F.sum(F.log2("n")).alias("weight"), F.collect_list(F.struct("key", "j", "n")).alias("keys"))  # `count` keys at most
    held = staged(held, "near-held")

    # Stars: each text with the most central one of each of its groups.
    spread = held.select("id", "weight", F.inline("keys"))
    pivots = staged(spread.groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("pivot")), "near-pivots")
    stars = spread.join(pivots, "key").where("id != pivot")
    pairs = staged(stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "near-pairs")

    # Verification: the sequences of the texts that have candidates, joined to the pairs.
    needed = IdFilter(nodes.select("id", "th").join(held.select("id"), "id"), "th")
    bits = spark.sparkContext.broadcast(needed.words)

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                places = batch.column(1).to_numpy()
                batch = batch.filter(pa.array((bits.value[places >> 6] >> (places & 63)) & 1 == 1))
                found = [word_hashes(t or "") for t in batch.column(0).to_pylist()]
                packed = [shingles(x, k).astype("<u8").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array(packed, pa.binary())], ["id", "seq"])

    placed = rows.select("text", IdFilter.place(F.col("th")).alias("place"))
    sequences = placed.mapInArrow(trimmed(sequence), "id binary, seq binary").where("id is not null").dropDuplicates(["id"])
    sequences = staged(sequences.join(held.select("id").hint("merge"), "id", "left_semi"), "near-sequences")

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype="<u8")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [aligned_similarity(unpacked(x.as_py()), unpacked(y.as_py()), similarity) >= similarity - 1e-9 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(sequences.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a")
    both = with_a.join(sequences.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b")
    links = verified = staged(both.select("a", "b", "x", "y").mapInArrow(trimmed(verify), "a binary, b binary"), "near-links")
    parts = staged(components(links), "near-parts")

    # The rest: members of one group that the stars left in different parts. A group of two is compared already.
    crowded = F.filter("keys", lambda x: x["n"] > 2)
    size = sequences.select("id", F.octet_length("seq").cast("long").alias("bytes"))
    rooted = held.select("id", crowded.alias("keys")).where(F.size("keys") > 0).join(size, "id").join(parts.hint("merge"), "id", "left")
    rooted = staged(rooted.select("id", "bytes", "keys", F.coalesce("root", "id").alias("root")), "near-rooted")
    members = rooted.select("id", "bytes", "root", F.inline("keys"))
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("c", "root", "bytes"))
    mixed = by_root.groupBy("key").agg(largest.alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("bytes").alias("bytes")).where("parts > 1")
    pieces = lambda b: F.ceil(b / F.lit(float(block_bytes))).cast("long")
    mixed = staged(mixed.select("key", F.col("main.root").alias("main"), F.greatest(F.lit(1).cast("long"), pieces(F.col("bytes") - F.col("main.bytes"))).alias("minor_blocks"), F.greatest(F.lit(1).cast("long"), pieces(F.col("bytes"))).alias("blocks")), "near-mixed")
    if mixed.isEmpty():
        more = links.limit(0)
    else:
        wanted = members.join(mixed, "key").groupBy("id", "root").agg(F.collect_list(F.struct("key", "j", "main", "minor_blocks", "blocks")).alias("keys"))
        path = scratch(spark, "near-full")
        full = staged(wanted.join(nodes.select("id", "s"), "id").join(sequences, "id").select("id", "root", "s", "seq", "keys"), "near-full", path)
        again = spark.read.schema(full.schema).parquet(path)
        every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        columns = ["id", "root", "s", "seq", "key", "j", "main"]
        minor = full.select("id", "root", "s", "seq", F.inline("keys")).where("root != main").select(*columns, own("minor_blocks").alias("x"), every_block("blocks").alias("y"))
        every = again.select("id", "root", "s", "seq", F.inline("keys")).select(*columns, every_block("minor_blocks").alias("x"), own("blocks").alias("y"))

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """Links between the two sides' texts that lie in different parts. A pair is looked at in the group of its
            first common sketch, the likeliest first, and not once its parts have met."""
            found: list[tuple[bytes, bytes]] = []
            if len(left) and len(right):
                left, right = left.sort_values("id"), right.sort_values("id")
                _, codes = np.unique(np.append(left["root"].to_numpy(), right["root"].to_numpy()), return_inverse=True)
                ra, rb = codes[: len(left)], codes[len(left) :]
                ia, ib, main = left["id"].to_numpy(), right["id"].to_numpy(), right["main"].iloc[0]
                second_main = (right["root"] == main).to_numpy()
                a, b, j = np.stack(left["s"].to_numpy()), np.stack(right["s"].to_numpy()), int(left["j"].iloc[0])
                sa, sb = [unpacked(x) for x in left["seq"]], [unpacked(x) for x in right["seq"]]
                with np.errstate(over="ignore"):
                    ma, mb = np.stack([parity(x) for x in sa]), np.stack([parity(x) for x in sb])
                na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
                open_pairs = []
                step = max(1, (1 << 20) // len(b))
                for at in range(0, len(a), step):
                    here = slice(at, at + step)
                    agree = np.zeros((len(a[here]), len(b)), dtype=np.int16)
                    earlier = np.zeros(agree.shape, dtype=bool)
                    for i in range(count):
                        same = a[here, None, i] == b[None, :, i]
                        agree += same
                        if i < j:
                            earlier |= same
                    wanted = ~earlier & (ra[here, None] != rb[None, :]) & ((ia[here, None] < ib[None, :]) | second_main[None, :])
                    both = na[here, None] + nb[None, :]
                    wanted &= np.minimum(na[here, None], nb[None, :]) >= similarity * np.maximum(na[here, None], nb[None, :])
                    p, q = np.nonzero(wanted)
                    for cut in range(0, len(p), 1 << 16):
                        x, y = p[cut : cut + (1 << 16)], q[cut : cut + (1 << 16)]
                        differ = np.bitwise_count(ma[at + x] ^ mb[y]).sum(axis=1, dtype=np.int64)
                        near = differ <= both[x, y] * (1 - similarity) / (1 + similarity) + 1e-9
                        open_pairs.append(np.stack([at + x[near], y[near], -agree[x[near], y[near]].astype(np.int64)]))
                at_a, at_b, order = np.concatenate(open_pairs, axis=1) if open_pairs else np.empty((3, 0), dtype=np.int64)
                joined: dict[int, int] = {}

                def part(r: int) -> int:
                    while r in joined:
                        r = joined[r]
                    return r

                for n in np.argsort(order, kind="stable").tolist():
                    p, q = int(at_a[n]), int(at_b[n])
                    x, y = part(int(ra[p])), part(int(rb[q]))
                    if x != y and aligned_similarity(sa[p], sb[q], similarity) >= similarity - 1e-9:
                        found.append((min(ia[p], ib[q]), max(ia[p], ib[q])))
                        joined[max(x, y)] = min(x, y)
            return pd.DataFrame(found, columns=["a", "b"], dtype=object)

        more = staged(minor.groupBy("key", "x", "y").cogroup(every.groupBy("key", "x", "y")).applyInPandas(compare, "a binary, b binary"), "near-more")
        discard(full)
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = parts.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)
        parts = staged(components(joined), "near-all-parts")
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.select("id", "words_id").join(parts, "id", "left").join(degree, "id", "left").select("id", "words_id", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    named = every_node = staged(named, "near-named")
    names = staged(named.groupBy("root").agg(F.min("words_id").alias("class_id")), "near-names")
    named = staged(named.join(names, "root").select(F.col("id").alias("digest"), "words_id", "class_id", "root", "links"), "near-classes")
    discard(every_node, nodes, shared, held, pivots, pairs, sequences, verified, more, rooted, mixed, names)
    columns = ["doc_id", "th", "digest", "root", "class_id", "words_id", "links"]
    found = digests.where("digest is not null").select("doc_id", "th", "digest").join(named, "digest").select(*columns)
    alone = digests.where("digest is null").select("doc_id", "th", "digest", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("words_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(alone)


def classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), words_id (the smallest doc_id with equal words) and links
    (verified links of its words' text to other texts) for every row. settings: as grouped()."""
    return grouped(docs, **settings).select("doc_id", "class_id", "words_id", "links")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """docs with one row of each class: one with the smallest id, and of those the one with the smallest digest of its
    words; of repeated rows one stays. Rows without words are classes of their own and all stay. Only rows that
    may belong to a larger class are shuffled."""
    spark = docs.sparkSession
    rows = staged(grouped(docs, id_column=id_column, text_column=text_column, **settings).where("digest is not null").select("doc_id", "th", "digest", "root"), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    large = staged(rows.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first"), "near-large")
    held = staged(rows.join(large, "root"), "near-large-rows")
    stays = (F.col("digest") == F.col("first.digest")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = held.groupBy("doc_id", "digest").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = staged(judged.where("not stays or n > 1"), "near-judged")
    th, digest, maybe, doc, node = (fresh(docs.columns, n) for n in ("near_th", "near_digest", "near_maybe", "near_doc", "near_node"))

    @F.pandas_udf("binary")
    def digest_of(texts: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([_digest(word_hashes(t or "")) for t in texts], dtype=object)

    text = F.col(text_column).cast("string")
    hashed = docs.withColumn(th, F.xxhash64(text))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(doc)) & (F.col(digest) == F.col(node))
    named = lambda df: df.select(F.col("doc_id").alias(doc), F.col("digest").alias(node)).hint("merge")
    marked = hashed.withColumn(maybe, IdFilter(held.select("th"), "th").test(spark, F.col(th)))
    kept = marked.where(~F.col(maybe)).select(*docs.columns)
    kept = kept.unionByName(marked.where(F.col(maybe)).withColumn(digest, digest_of(text)).join(named(judged), same, "left_anti").select(*docs.columns))
    repeats = judged.where("stays")
    if repeats.isEmpty():
        return kept
    again = held.join(repeats.select(F.col("doc_id").alias("d"), F.col("digest").alias("g")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi")
    some = hashed.where(IdFilter(again.select("th"), "th").test(spark, F.col(th))).withColumn(digest, digest_of(text)).join(named(repeats), same)
    one = some.groupBy(doc, node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and root (the smallest id of its connected part) for every id in links(a, b). Large stars and small stars in
    turn until the links are stars; each step is written, so a lost executor costs no more than one, and the smallest
    neighbours are written before they are joined, so that a node with many links can be split."""
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links-0")
    for turn in range(most_rounds):
        # Stars: every node above another has one neighbour below it, and that one none.
        forks = edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
        chains = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct().hint("merge"), "u", "left_semi")
        if forks.where("n > 1").select("u").unionByName(chains).isEmpty():
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        # Large star: a node's larger neighbours go to its smallest neighbour, if that is smaller than the node.
        least = staged(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), f"links-least-{turn}")
        large = edges.join(least.hint("merge"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        large = staged(large.distinct(), f"links-large-{turn}")
        discard(least, edges)
        # Small star: every smaller neighbour of a node, and the node, go to the smallest of them.
        least = staged(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), f"links-small-{turn}")
        moved = large.join(least.hint("merge"), F.col("u") == F.col("w")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
        edges = staged(moved.distinct(), f"links-{turn + 1}")
        discard(least, large)
    raise RuntimeError(f"the links were not stars after {most_rounds} rounds")
