"""All pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, by a chosen-path join.

1. Each text becomes its set of shingle hashes (lower case, split at white space; a text of one
   to four words is one shingle, a text without words has none and no partner). Texts with the
   same set are one representative from here on. MinHash embeds a set in COORDINATES numbers,
   two of which agree with the probability of the Jaccard similarity.
2. Chosen paths: a run begins with all representatives in one node. A node splits its sets by
   the value at a sampled coordinate (1/0.8 coordinates are expected, so that a similar pair is
   expected to stay together in one child). Nodes of one set go, nodes of up to LEAF sets are
   compared pair by pair on their embeddings, larger nodes split again. A child that keeps most
   of a large node is made of sets that are nearly all alike: splitting it wouldn't end, so
   its sets are linked as they are.
3. Runs are repeated until the target recall. It is measured: up to PROBES sets, taken by a hash, are held
   against all others, each with the partner that agrees least of those that agree in 0.8 of the coordinates,
   the hardest to find. STEP runs are added until RECALL of these pairs meet in a node, MOST_RUNS at most. A pair
   at similarity 0.8 is missed by a run with probability 0.16 at one split, 0.36 at three and 0.47 at
   five, and so by ten with probability 1e-8, 4e-5 and 5e-4, leaving aside the few pairs (1e-4) whose
   embeddings agree far less than the sets.
4. Linked sets make candidate components. They hold too many pairs, never fewer than were found.
   Within each, every pair is compared exactly, on the sets of shingles: the component is
   cut into blocks and a task gets two blocks. Only counts and one link for each set leave
   the task. Blocks grow with the square root of the component, so that k near copies make about k ** 1.5 / 8 rows
   and not k * k, up to BLOCK_SHINGLES shingles, which bounds a task's memory.
5. Components of the exact links are the classes.

Joins on a component, a class or a path, any of which may hold a third of all rows, go through join_groups().

Defined results: null counts as empty; rows that repeat a text are linked to each other; an empty
table gives no rows; ids may be null or repeat; very long texts are compared whole; columns other than the id and the
text are left out by join(), whatever their names, and carried by drop(), if they don't start with "__near_".
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import TASK_ROWS, batch_hashes, checkpoint, fewer, join_groups, mix, shingle_hashes, sorted_groups, text_chunks, word_hashes
from vellum.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
COORDINATES, LEAF, DEPTH = 64, 64, 9
#: Runs are made so many at once until RECALL of the probed pairs meet; probes are the first sets by a hash.
STEP, MOST_RUNS, RECALL, PROBES = 8, 32, 0.99, 400
#: At least so many runs are made: all pairs share a run's root, so the recall of a single run is a single draw.
LEAST_RUNS = 8
#: A child with this share of its node isn't split again.
ALIKE = 0.7
#: Embeddings that agree in fewer coordinates (4 standard deviations under 0.8) aren't compared exactly.
AGREE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
#: Sets in a block: GROWTH times the square root of the component, BLOCK at least; so k sets make about k ** 1.5 / GROWTH rows.
BLOCK, GROWTH = 64, 8
#: Shingles in a block, about, at most.
BLOCK_SHINGLES = 2_000_000
#: Paths that one task takes, about; the number of tasks follows the paths.
TASK_PATHS = 50_000
#: Rows with an embedding (some 300 bytes each) that one task takes, about.
TASK_SETS = 20_000
#: Candidates up to so many are broadcast to the texts (24 bytes each); beyond, the texts are shuffled.
BROADCAST_ROWS = 500_000

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pd.Series, memo) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in text_chunks(texts):
        h, bounds = batch_hashes(texts.iloc[part], memo)
        s = shingle_hashes(h, WIDTH)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= WIDTH:
                yield np.unique(s[a : b - WIDTH + 1])
            else:
                yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())] if b > a else [], np.uint64)


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima of each set; sets must not be empty."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    every = np.concatenate(sets)
    return np.stack([np.minimum.reduceat((every * f) >> np.uint64(32), at) for f in _FACTORS], 1).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n (shingles), d1 and d2 (the set's digest), sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = word_hashes()
        for batch in batches:
            for part in text_chunks(batch["text"]):
                out = batch.iloc[part][["doc_id", "text_hash"]].copy()
                sets = list(shingle_sets(batch["text"].iloc[part], memo))
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                out["n"] = [len(s) for s in sets]
                out["d1"], out["d2"] = [d[0] for d in digests], [d[1] for d in digests]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, e in zip(full, embed([sets[i] for i in full]), strict=True):
                        sig[i] = e
                out["sig"] = sig
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.mapInPandas(run, "doc_id long, text_hash long, n long, d1 long, d2 long, sig array<int>")
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def _picks(node):
    """One coordinate, or two in a quarter of the nodes: 1 / 0.8 on average."""
    pick = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(COORDINATES)).cast("int")
    return F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(100)) < round(100 / SIMILARITY) - 100, F.array(pick(1), pick(2))).otherwise(F.array(pick(1)))


def _split(nodes: DataFrame) -> DataFrame:
    """nodes: rep, sig, path, parent -> rep, path (of the child), parent."""
    picked = nodes.withColumn("pick", F.explode(F.array_distinct(_picks(F.col("path")))))
    return picked.select("rep", F.xxhash64("path", "pick", F.element_at("sig", F.col("pick") + 1)).alias("path"), "parent")


def paths(reps: DataFrame, n: int, first: int, runs: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """reps: rep, sig, n of them. The leaves and the nodes of sets that are nearly all alike of `runs` runs from number `first`: rep, path."""
    leaves, alike = [], []
    roots = F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(first + r)) for r in range(runs)]))
    level, total = _split(reps.select("rep", "sig", roots.alias("path"), F.lit(1 << 60).alias("parent"))), 2 * n * runs
    for depth in range(DEPTH):
        level = fewer(checkpoint(level), total, TASK_ROWS)
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level = fewer(checkpoint(join_groups(level, sizes, ["path"], "size", total)), total, TASK_ROWS)
        ends = (F.col("size") >= ALIKE * F.col("parent")) | F.lit(depth == DEPTH - 1)
        kinds = [F.col("size") <= LEAF, (F.col("size") > LEAF) & ends, (F.col("size") > LEAF) & ~ends]
        n_leaf, n_alike, n_large = level.agg(*[F.count_if(kind) for kind in kinds]).first()
        leaves.append(fewer(level.where(kinds[0]).select("rep", "path"), n_leaf, TASK_ROWS))
        alike.append(fewer(level.where(kinds[1]).select("rep", "path", "size"), n_alike, TASK_ROWS))
        total = 2 * n_large
        if not total:
            break
        level = _split(level.where(kinds[2]).select("rep", "path", F.col("size").alias("parent")).join(reps, "rep"))
    return leaves, alike


def probes(reps: DataFrame) -> DataFrame:
    """(u, v): PROBES sets at most, each with its partner that agrees least, of those that agree in 0.8 of the coordinates; sets without one are left out."""
    chosen = checkpoint(reps.select("rep").orderBy(F.xxhash64("rep", F.lit(9)), "rep").limit(PROBES))
    first = reps.join(F.broadcast(chosen), "rep", "left_semi").collect()  # PROBES rows
    if not first:
        return reps.sparkSession.createDataFrame([], "u long, v long")
    ids, table = np.array([r["rep"] for r in first]), np.array([r["sig"] for r in first], np.int32).T.copy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, who = np.full(len(ids), 127, np.int8), np.zeros(len(ids), np.int64)
        for batch in batches:
            for start in range(0, len(batch), 512):
                reps_, sig = batch["rep"].to_numpy()[start : start + 512], np.stack(batch["sig"].to_numpy()[start : start + 512])
                same = np.zeros((len(sig), len(ids)), np.int8)
                for k in range(COORDINATES):
                    same += sig[:, k, None] == table[k][None]
                same[(same < SIMILARITY * COORDINATES) | (reps_[:, None] == ids[None])] = 127
                at = same.argmin(0)
                less = same[at, np.arange(len(ids))] < best
                best[less], who[less] = same[at, np.arange(len(ids))][less], reps_[at][less]
        some = best < 127
        yield pd.DataFrame({"u": ids[some], "v": who[some], "agree": best[some].astype(np.int32)})

    found = reps.select("rep", "sig").mapInPandas(run, "u long, v long, agree int")
    return checkpoint(found.groupBy("u").agg(F.min(F.struct("agree", "v")).alias("b")).select("u", F.col("b.v").alias("v")))


def met(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v; at most PROBES) whose sets lie in one of the nodes (rep, path)."""
    wanted = pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct()
    near = checkpoint(nodes.join(F.broadcast(wanted), "rep", "left_semi"))
    a, b = near.select(F.col("rep").alias("u"), "path"), near.select(F.col("rep").alias("v"), "path")
    return F.broadcast(pairs).join(a, "u").join(b, ["v", "path"]).select("u", "v").distinct()


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each item's component."""
    root = np.arange(n)
    for a, b in pairs:
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


def _compare_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    us, vs = [], []
    for group in sorted_groups(batches, ["path"]):
        reps, sig = group["rep"].to_numpy(), np.stack(group["sig"].to_numpy())
        near = np.argwhere(np.triu((sig[:, None] == sig[None]).mean(2) >= AGREE, 1))
        root = _roots(len(reps), near)
        out = np.flatnonzero(root != np.arange(len(reps)))
        us.append(reps[out])
        vs.append(reps[root[out]])
        if len(us) >= 5000:
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})
            us, vs = [], []
    if us:
        yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, budget: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by matrix products over the shingles that at least two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = shared.cumsum() - 1
    use = shared[code]
    owner, code = owner[use], rank[code[use]]
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], code[by]
    out = np.zeros((len(left), len(right)), np.float32)
    total, step = int(shared.sum()), max(1, budget // max(1, len(sets)))
    for start in range(0, total, step):
        a, b = np.searchsorted(code, [start, start + step])
        table = np.zeros((len(sets), min(step, total - start)), np.float32)
        table[owner[a:b], code[a:b] - start] = 1
        out += table[left] @ table[right].T
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups (root, i, j) -> for each set its links in the two blocks and one set of its component there."""
    found, rows = [], 0
    for group in sorted_groups(batches, ["root", "i", "j"]):
        group = group.drop_duplicates("rep")
        reps, block, copies = group["rep"].to_numpy(), group["block"].to_numpy(), group["copies"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in group["shingles"]]
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        n = np.array([len(s) for s in sets])
        if len(left) == len(right) == len(sets) == 2:
            both = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)), np.float32)
        else:
            both = intersections(sets, left, right)
        near = both >= SIMILARITY * (n[left][:, None] + n[right][None] - both) - 1e-3
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, left, near @ copies[right])
        if i != j:
            np.add.at(links, right, near.T @ copies[left])
        pairs = np.argwhere(near)
        root = _roots(len(sets), np.column_stack([left[pairs[:, 0]], right[pairs[:, 1]]]))
        some = links > 0
        found.append(pd.DataFrame({"rep": reps[some], "links": links[some], "to": reps[root[some]]}))
        rows += len(found[-1])
        if rows >= 20_000:
            yield pd.concat(found)
            found, rows = [], 0
    if found:
        yield pd.concat(found)


def _with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, text_hash, ...) with the shingles of the text it names, and without the text's keys."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, seen = word_hashes(), set()
        for batch in batches:
            # Rows that repeat an id and a text all meet the one candidate of that text: a task passes one of them on.
            batch = batch[[not (r in seen or seen.add(r)) for r in batch["rep"].tolist()]]
            for part in text_chunks(batch["text"]):
                out = batch.iloc[part][rest].copy()
                out["shingles"] = [s.view(np.int64) for s in shingle_sets(batch["text"].iloc[part], memo)]
                yield out

    keyed = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"), "text")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    joined = keyed.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash")))
    return joined.select(*rest, "text").mapInPandas(run, schema + ", shingles array<long>")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def candidate_links(reps: DataFrame, n: int) -> DataFrame:
    """reps: rep, sig, n of them. Links (u, v) whose components hold the similar pairs, but for 1 - RECALL of the probed ones."""
    pairs, links, found = probes(reps), [], None
    wanted = pairs.count()
    for first in range(0, MOST_RUNS, STEP):
        leaves, alike = paths(reps, n, first, STEP)
        leaf, same = _union(leaves), _union(alike)
        n_leaf, n_alike = leaf.count(), same.count()
        leaf, same = fewer(leaf, n_leaf, TASK_ROWS), fewer(same, n_alike, TASK_ROWS)
        compared = leaf.join(reps, "rep").select("path", "rep", "sig").repartition(max(1, math.ceil(n_leaf / TASK_PATHS)), "path")
        edges = compared.sortWithinPartitions("path", "rep").mapInPandas(_compare_leaves, "u long, v long")
        least = same.groupBy("path").agg(F.min("rep").alias("v"), F.count("*").alias("n"))
        stars = join_groups(same.select("rep", "path"), least, ["path"], "n", n_alike, most=n_alike).select(F.col("rep").alias("u"), "v")
        links.append(checkpoint(edges.unionByName(stars).distinct()))
        if not wanted:  # no probed set has a partner; the least number of runs is made all the same
            if first + STEP >= LEAST_RUNS:
                break
            continue
        now = met(pairs, leaf.unionByName(same.select("rep", "path")))
        found = checkpoint((found.unionByName(now) if found is not None else now).distinct())
        have = found.count()
        if have >= RECALL * wanted and first + STEP >= LEAST_RUNS:
            break
    else:
        raise RuntimeError(f"{MOST_RUNS} runs have met {have} of {wanted} probed pairs, less than the target recall {RECALL}")
    return _union(links)


def join(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, text_hash, class_id (the least doc_id of its class), links (rows of similar text, equal ones too), class_size, first (true for one row of each class)."""
    rows = signatures(docs)
    n_rows = rows.count()
    rows = fewer(rows, n_rows, TASK_SETS)
    groups = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    rows = checkpoint(join_groups(rows, groups, ["d1", "d2"], "copies", n_rows, "left", n_rows).withColumns({"rep": F.coalesce("rep", "row"), "copies": F.coalesce("copies", F.lit(1))}))
    rows = fewer(rows, n_rows, TASK_SETS)
    sets = rows.where("row = rep AND n > 0")
    reps, n_reps = sets.select("rep", "sig"), sets.count()
    candidates = components(candidate_links(reps, n_reps))

    members = checkpoint(sets.select("rep", "n", "copies", "doc_id", "text_hash").join(candidates.select(F.col("id").alias("rep"), "root"), "rep"))
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    k = F.ceil(F.greatest(F.col("size") / F.greatest(GROWTH * F.sqrt("size"), F.lit(BLOCK)), F.col("weight") / BLOCK_SHINGLES)).cast("int")
    n_members = members.count()
    placed = join_groups(members, sizes.select("root", "size", k.alias("k")), ["root"], "size", n_members, most=n_members)
    wanted = checkpoint(placed.select("rep", "copies", "doc_id", "text_hash", "root", "k", "n", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int").alias("block")))
    shipped, pieces = (x or 0 for x in wanted.agg(F.sum(F.col("k") * F.col("n")), F.sum("k")).first())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(shipped / BLOCK_SHINGLES))
    pairs = _with_shingles(docs, wanted.drop("n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pairs = pairs.select("root", "i", "j", "rep", "block", "copies", "shingles").repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j", "rep")
    exact = fewer(checkpoint(pairs.mapInPandas(_verify, "rep long, links long, to long")), pieces, TASK_ROWS)

    links = exact.groupBy("rep").agg(F.sum("links").alias("near"))
    classes = components(exact.select(F.col("rep").alias("u"), F.col("to").alias("v"))).select(F.col("id").alias("rep"), F.col("root").alias("class"))
    linked = checkpoint(links.join(classes, "rep").join(sets.select("rep", "copies"), "rep"))
    narrow = rows.select("row", "rep", "doc_id", "text_hash", F.col("copies").alias("rows"))
    out = checkpoint(join_groups(narrow, linked, ["rep"], "copies", n_rows, "left", n_reps).withColumn("class", F.coalesce("class", "rep")))
    least = out.groupBy("class").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("least"), F.count("*").alias("class_size"))
    marked = join_groups(out, least, ["class"], "class_size", n_rows, most=n_rows)
    return marked.select("doc_id", "text_hash", F.col("least.id").alias("class_id"), (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "class_size", (F.col("least.row") == F.col("row")).alias("first"))


def drop(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of similar texts: the one with the least doc_id, with all its columns. Of rows that repeat its id and text the one whose columns, as JSON, come first."""
    columns = docs.columns
    key = {"__near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__near_null": F.col("doc_id").isNull(), "__near_hash": F.xxhash64("text")}
    marks = join(docs).groupBy("doc_id", "text_hash").agg(F.bool_or("first").alias("__near_first"), F.count("*").alias("__near_n"))
    marks = checkpoint(marks.select(F.coalesce("doc_id", F.lit(0)).alias("__near_id"), F.col("doc_id").isNull().alias("__near_null"), F.col("text_hash").alias("__near_hash"), "__near_first", "__near_n"))
    special, total = marks.where("NOT __near_first OR __near_n > 1"), marks.agg(F.sum("__near_n")).first()[0] or 0
    if special.count() <= BROADCAST_ROWS:
        found = docs.withColumns(key).join(F.broadcast(special), list(key), "left")
    else:
        found = join_groups(docs.withColumns(key), special, list(key), "__near_n", total, "left")
    kept = found.where("coalesce(__near_first, true)")
    every = F.struct(*[F.col(f"`{c}`") for c in columns])
    repeated = kept.where("__near_n > 1").groupBy(*key).agg(F.min_by(every, F.to_json(every)).alias("__near_doc"))
    return kept.where("coalesce(__near_n, 1) = 1").select(*[F.col(f"`{c}`") for c in columns]).unionByName(repeated.select("__near_doc.*"))
