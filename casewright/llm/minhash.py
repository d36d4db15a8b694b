"""Near-duplicates by ProbMinHash over weighted shingles, banding and verification.

A text's shingles are its runs of five words (fewer words make one shingle), weighted 1 + ln(times).
Each shingle sends out arrivals of a Poisson process whose rate is its weight; every arrival falls into one
of 100 registers, which keeps its earliest. A shingle stops as soon as its next arrival comes after
the latest register, so most send one or two. Two texts agree in a register with the probability Jaccard
similarity of their weighted shingles. 20 bands of 5 registers give candidates.

Verification is exact. First every text of a bucket is compared with the bucket's smallest one, its leader,
and links of similarity 0.8 or more are joined to classes. The texts compared with one leader are its ball. What
is left are pairs of a ball whose classes differ, one of them outside the leader's class. 1 minus the similarity is a
metric, so a text below 0.6 to the leader has no link to one near it. All other such pairs are compared in blocks: texts of
a ball are gathered into blocks of a bounded size, a pair of blocks is one row, and one product of matrices gives the
shared shingles of all its pairs. Only links leave a task. So no link that joins classes is lost; texts
just below the threshold to a large class cost a product with each block of it. Classes are the connected components.

Equal texts are one node, by their MD5, so a group of copies never meets in one task.

Defined results: a NULL text counts as empty; texts without words are near only to equal ones; repeated
or NULL keys keep a row each; an empty table gives no rows; of the columns only the key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import GOLDEN, blocks, fresh, mix, stored, word_hashes
from casewright.llm.graph import components

SHINGLE, SIMILAR, NOT_FAR = 5, 0.8, 0.6
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Kinds of texts by their similarity to a leader; bytes of a block of texts, and shingles counted at once.
NEAR, DOUBTFUL, FAR = range(3)
BLOCK, COLUMNS = 1 << 19, 4096


def shingle_weights(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle, by text and then hash."""
    words, at = word_hashes(texts)
    sizes = np.diff(at)
    joined = np.zeros(len(words), np.uint64)
    for shift in range(SHINGLE):
        end = len(words) - shift
        joined[:end] = joined[:end] * GOLDEN + mix(words[shift:] + np.uint64(shift))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    full = np.arange(len(words)) + SHINGLE <= np.repeat(at[1:], sizes)
    hashes = [mix(joined[full])]
    owners = [owner[full]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(sizes == size)
        few = np.full(len(short), size, np.uint64)
        for place in range(size):
            few = few * GOLDEN + mix(words[at[short] + place])
        hashes.append(mix(few))
        owners.append(short)
    shift = np.uint64(max(1, int(len(sizes)).bit_length()))
    high = np.uint64(64) - shift
    both, times = np.unique(
        np.concatenate(owners).astype(np.uint64) << high | np.concatenate(hashes) >> shift, return_counts=True
    )
    return (both >> high).astype(np.int64), both << shift, 1 + np.log(times)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The registers of each text, a row per text, and whether it has any shingle."""
    n = len(texts)
    owner, element, weight = shingle_weights(texts)
    has = np.zeros(n, bool)
    has[owner] = True
    first = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    last = np.full(n, np.inf)
    time = np.zeros(len(element))
    # a hash loses its lowest bits to the text number; scrambling depends on the rest only
    element = mix(element >> np.uint64(20))
    draw = np.zeros(1, np.uint64)
    while len(element):
        draw = draw + GOLDEN
        bits = mix(element + draw)
        time = time - np.log(((bits >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / weight
        place = owner * REGISTERS + (mix(bits) % np.uint64(REGISTERS)).astype(np.int64)
        early = time < last[owner]
        owner, element, weight, time, place = (x[early] for x in (owner, element, weight, time, place))
        np.minimum.at(first, place, time)
        won = first[place] == time
        holder[place[won]] = element[won]
        touched = np.unique(owner)
        last[touched] = first.reshape(n, REGISTERS)[touched].max(1)
    return holder.reshape(n, REGISTERS), has


def band_hashes(registers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(registers), BANDS), np.uint64)
    for row in range(ROWS):
        out = mix(out * GOLDEN + registers[:, row::ROWS])
    return mix(out + np.arange(BANDS, dtype=np.uint64) * GOLDEN).view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets given as sorted hashes and weights."""
    every = np.union1d(a, b)
    if not len(every):
        return 1.0
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0], np.cumsum(x[order])])
    above = np.concatenate([np.cumsum(y[order][::-1])[::-1], [0]])
    both = (x > 0) & (y > 0)
    cut = np.searchsorted(ratio[order], ratio[both], "right")
    return float(np.sum(1 / (below[cut] / x[both] + above[cut] / y[both])))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))


def _bands(keyed: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            registers, has = signatures(block.column(2))
            values = pa.array(band_hashes(registers)[has].ravel())
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["id", "key", "bands"],
            )

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(work, f"id {kind}, key binary, bands array<long>")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(``key``, ``hashes``, ``weights``): sorted 32-bit hashes; no weights where all are 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            owner, element, weight = shingle_weights(block.column(1))
            at = np.searchsorted(owner, np.arange(block.num_rows + 1))
            short = (element >> np.uint64(32)).astype(np.uint32)
            rows = [(short[a:b], weight[a:b].astype(np.float32)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array([h.tobytes() for h, _ in rows], pa.binary()),
                    pa.array([w.tobytes() if (w != 1).any() else b"" for _, w in rows], pa.binary()),
                ],
                ["key", "hashes", "weights"],
            )

    return texts.mapInArrow(work, "key binary, hashes binary, weights binary")


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(``key``, ``leader``, ``similarity``) of every pair."""
    mine = sets.select("key", F.col("hashes").alias("h1"), F.col("weights").alias("w1"))
    other = sets.select(F.col("key").alias("leader"), F.col("hashes").alias("h2"), F.col("weights").alias("w2"))

    def weighted(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(hashes, np.uint32)
        return h, np.frombuffer(weights, np.float32) if weights else np.ones(len(h), np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                probability_jaccard(*weighted(h1, w1), *weighted(h2, w2))
                for h1, w1, h2, w2 in zip(*(batch[c].to_pylist() for c in ("h1", "w1", "h2", "w2")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["leader"], pa.array(found, pa.float64())], ["key", "leader", "similarity"]
            )

    joined = pairs.join(mine, "key").join(other, "leader").select("key", "leader", "h1", "w1", "h2", "w2")
    return joined.mapInArrow(work, "key binary, leader binary, similarity double")


def _unpacked(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and weights of each set."""
    out = []
    for row in rows:
        h = np.frombuffer(row["hashes"], np.uint32)
        out.append((h, np.frombuffer(row["weights"], np.float32) if row["weights"] else np.ones(len(h), np.float32)))
    return out


def shared_weights(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of sets the weight that the first has on shared elements, and that the second has."""
    every, place = np.unique(np.concatenate([h for h, _ in (*a, *b)]), return_inverse=True)
    ends = np.cumsum([len(h) for h, _ in (*a, *b)])
    places = np.split(place, ends[:-1])
    first, second = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(every), COLUMNS):
        dense = []
        for sets, own in ((a, places[: len(a)]), (b, places[len(a) :])):
            side = np.zeros((len(sets), COLUMNS), np.float32)
            for i, ((_, w), p) in enumerate(zip(sets, own, strict=True)):
                start, stop = np.searchsorted(p, (low, low + COLUMNS))
                side[i, p[start:stop] - low] = w[start:stop]
            dense.append(side)
        x, y = dense
        first += x @ (y > 0).astype(np.float32).T
        second += (x > 0).astype(np.float32) @ y.T
    return first, second


def block_links(a: list[dict], b: list[dict]) -> list[tuple[bytes, bytes]]:
    """Similar pairs of two blocks (rows with ``key``, ``root``, ``hashes``, ``weights``), as far as they join roots."""
    x, y = _unpacked(a), _unpacked(b)
    if not sum(len(h) for h, _ in (*x, *y)):
        return []
    first, second = shared_weights(x, y)
    wx, wy = (np.array([w.sum() for _, w in side], np.float32) for side in (x, y))
    # the similarity is at most the share of either side that both have; between sets without weights it is known
    likely = np.minimum(first / np.maximum(wx, 1)[:, None], second / np.maximum(wy, 1)) >= SIMILAR - 1e-4
    plain = np.array([not r["weights"] for r in a])[:, None] & np.array([not r["weights"] for r in b])
    likely &= ~plain | (first / np.maximum(wx[:, None] + wy - first, 1) >= SIMILAR - 1e-4)
    top = {r["root"]: r["root"] for r in (*a, *b)}

    def root(node: bytes) -> bytes:
        while top[node] != node:
            top[node] = node = top[top[node]]
        return node

    links = []
    for i, j in np.argwhere(likely).tolist():
        mine, other = root(a[i]["root"]), root(b[j]["root"])
        # a pair of classes is joined once
        if mine != other and probability_jaccard(*x[i], *y[j]) >= SIMILAR:
            links.append((a[i]["key"], b[j]["key"]))
            top[mine] = other
    return links


def _balls(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """(``leader``, ``key``, ``kind``, ``root``, ``asks``) of the balls that hold a text outside the leader's class.

    ``kind`` tells near, doubtful and far texts apart; those that ask are not in the leader's class.
    """
    similarity = F.col("similarity")
    kind = F.when(similarity >= SIMILAR, NEAR).when(similarity >= NOT_FAR, DOUBTFUL).otherwise(FAR)
    leaders = tested.select("leader").distinct().select("leader", F.col("leader").alias("key"), F.lit(NEAR).alias("kind"))
    members = tested.select("leader", "key", kind.alias("kind")).union(leaders)
    mine = roots.select(F.col("node").alias("key"), F.col("root").alias("r1"))
    other = roots.select(F.col("node").alias("leader"), F.col("root").alias("r2"))
    members = members.join(mine, "key", "left").join(other, "leader", "left")
    root, head = F.coalesce("r1", "key"), F.coalesce("r2", "leader")
    members = stored(members.select("leader", "key", "kind", root.alias("root"), (root != head).alias("asks")), "balls")
    return members.join(members.where("asks").select("leader").distinct(), "leader", "left_semi")


def _blocked(members: DataFrame) -> DataFrame:
    """(``leader``, ``kind``, ``block``, ``blocks``, ``rows``): the texts of each ball and kind in blocks of a bounded size."""
    group = ["leader", "kind"]
    size = F.octet_length("hashes") + F.octet_length("weights") + 100
    many = F.ceil(F.sum(size) / BLOCK).cast("int").alias("blocks")
    sizes = members.groupBy(F.struct(*group).alias("g")).agg(many).select("g.*", "blocks")
    dealt = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = F.collect_list(F.struct("key", "root", "hashes", "weights")).alias("rows")
    return dealt.groupBy(*group, "block").agg(F.max("blocks").alias("blocks"), rows)


def _links(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """All links (``a``, ``b``) between texts that share a bucket, as far as they join classes."""
    heads = members.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n"))
    held = members.join(heads.where("n > 1").select("bucket", "leader"), "bucket").where(F.col("key") > F.col("leader"))
    tested = stored(_similarities(held.select("key", "leader").distinct(), sets), "tested")
    if tested.isEmpty():
        return None
    near = tested.where(F.col("similarity") >= SIMILAR)
    links = stored(near.select(F.col("key").alias("a"), F.col("leader").alias("b")), "links")
    balls = stored(_balls(tested, components(links)).join(sets, "key"), "ball-sets")
    blocks_of = stored(_blocked(balls).withColumnRenamed("rows", "held"), "blocks")
    counts = blocks_of.select("leader", F.col("kind").alias("other"), "blocks").distinct()
    asked = stored(_blocked(balls.where("asks")).select("leader", F.col("kind").alias("mine"), "rows"), "asked")
    # a block that asks goes to each block of the ball; far and near texts have no link
    pairs = asked.join(counts, "leader").where(~((F.col("mine") == FAR) & (F.col("other") == NEAR)))
    pairs = pairs.select("leader", F.col("other").alias("kind"), "rows", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = pairs.join(blocks_of.drop("blocks"), ["leader", "kind", "block"]).select("rows", "held")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, other in zip(batch["rows"], batch["held"], strict=True):
                found = block_links(mine.as_py(), other.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return links.union(stored(pairs.mapInArrow(work, "a binary, b binary").distinct(), "crossed"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``key``, ``class``) per row: the row's key, its text's MD5, and the smallest MD5 of its class."""
    keyed = _keyed(docs, doc_id, text)
    banded = stored(_bands(keyed), "bands")
    texts = banded.groupBy("key").agg(F.any_value("bands").alias("bands"))
    members = stored(texts.select("key", F.explode("bands").alias("bucket")), "members")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stored(members.join(shared, "bucket"), "shared")
    wanted = members.select("key").distinct().join(
        banded.groupBy("key").agg(F.min("id").alias("id")), "key"
    )
    picked = keyed.join(wanted.withColumnRenamed("id", "one"), "key").where(F.col("id").eqNullSafe(F.col("one")))
    sets = stored(_shingle_sets(picked.select("key", "text")).dropDuplicates(["key"]), "sets")
    links = _links(members, sets)
    rows = banded.select("id", "key")
    if links is None:
        return rows.withColumn("class", F.col("key"))
    roots = components(links).select(F.col("node").alias("key"), F.col("root").alias("class"))
    return rows.join(roots, "key", "left").select("id", "key", F.coalesce("class", "key").alias("class"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``class_id`` (the smallest key of its class) and ``class_size`` (rows of the class)."""
    found = stored(classes(docs, doc_id, text), "classes")
    sizes = found.groupBy(F.struct("class").alias("g")).agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(sizes.select("g.class", "class_id", "class_size"), "class").select(
        F.col("id").alias(doc_id), "class_id", "class_size"
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns: the smallest key, and of its rows the smallest MD5."""
    found = stored(classes(docs, doc_id, text), "classes")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key")).alias("first"))
    md5, kept, one = (fresh(docs.columns, name) for name in ("_md5", "_kept", "_one"))
    first = stored(first.select(F.col("first.key").alias(kept), F.col("first.id").alias(one)), "first")
    rows = docs.withColumn(md5, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = rows.join(first, (F.col(md5) == F.col(kept)) & F.col(doc_id).eqNullSafe(F.col(one)))
    if not found.groupBy("id", "key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([kept])  # rows that repeat key and text
    return rows.select(docs.columns)
