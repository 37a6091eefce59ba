"""A Merkle manifest of a dataset: every row a leaf, a tree for each key, a tree over the keys' roots, and proofs.

Leaves. H is SHA-256 in lower-case hexadecimal of its inputs joined, digests as hexadecimal text. A row's leaf is H of its columns,
each `-` if null, else the number of its UTF-8 bytes, a colon and the value.

Trees. Within a key, leaves ascend by id (null first); every 8 consecutive nodes of a level, or what is left of them, become their H, until one
node is left, the subroot. The subroots, by key (null first, by bytes), likewise give the root.

Sparse forest. Rows are sorted into range partitions, so that a partition holds consecutive leaves of one key or of several. How many rows of
its first key lie before it, and how many its first and last keys have in all, follow from one row of counts for each partition; so the
number of children of every node is known. A partition folds all sibling runs that it holds whole. What is left is a sparse forest: nodes that
wait for siblings, keyed by tree, level and index. Forests form a commutative monoid: the sum of two is their union, in which every
run that has become whole is replaced by its parent, and so on upwards. A tree reduce adds FAN neighbouring forests in each round, so a
forest never holds more than the nodes at its two ends, fewer than 8 for each level and end.

Proofs. A leaf's proof is its siblings level by level. A partition has most of them itself; the others are nodes that once waited in some forest, or were made
in a round. Partitions ask for them by key (a join), and get them beside their rows (a cogroup).

No step takes a key, a level or the tree as a whole: a key with a third of all rows is in a third of the partitions. The driver gets one row for
each partition, and the root.

Defined results: null keys are one tree, null ids come first, null columns are `-`; very long texts are hashed in the JVM; repeated rows are leaves
each, next to each other; rows that share an id and key are ordered by their leaves; an empty table gives no rows; extra columns are left out of leaves and
result, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint

#: Children of a node.
ARITY = 8
#: Forests that one task of a round adds up.
FAN = 16
#: Rows of a range partition, about.
TASK_ROWS = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over all subroots.
TOP = -1


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Iterable[Column]) -> Column:
    """The digest of a row's columns."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n // ARITY**level)


def run_of(n: int, level: int, index: int) -> range:
    """The indexes of a node and its siblings."""
    first = index // ARITY * ARITY
    return range(first, min(first + ARITY, width(n, level)))


def climb(n: int, first: int, digests: list[str]) -> list[tuple[int, list[str]]]:
    """From consecutive leaves of a tree with n: for each level the first index and the digests of the nodes whose leaves are all among them."""
    levels = [(first, digests)]
    while levels[-1][1] and width(n, len(levels) - 1) > 1:
        a, held = levels[-1]
        b, most = a + len(held), width(n, len(levels) - 1)
        low = -(-a // ARITY)
        high = -(-b // ARITY) if b == most else b // ARITY
        levels.append((low, [digest(held[r * ARITY - a : (r + 1) * ARITY - a]) for r in range(low, high)]))
    return levels


class Forest:
    """The monoid: waiting nodes as (tree, level, index) -> (leaves of the tree, digest), and the number of trees."""

    def __init__(self, trees: int, waiting: dict | None = None):
        self.trees, self.waiting = trees, waiting or {}

    def add(self, tree: int, n: int, level: int, index: int, value: str) -> list[tuple]:
        """Adds a node; the nodes that this makes, as (tree, leaves, level, index, digest)."""
        made = []
        while True:
            self.waiting[tree, level, index] = (n, value)
            if width(n, level) == 1:
                if tree == TOP:
                    return made
                del self.waiting[tree, level, index]
                tree, n, level, index = TOP, self.trees, 0, tree
            else:
                run = run_of(n, level, index)
                if not all((tree, level, k) in self.waiting for k in run):
                    return made
                value = digest(self.waiting.pop((tree, level, k))[1] for k in run)
                level, index = level + 1, index // ARITY
            made.append((tree, n, level, index, value))

    def __add__(self, other: Forest) -> Forest:
        return self.joined(other)[0]

    def joined(self, other: Forest) -> tuple[Forest, list[tuple]]:
        out, made = Forest(self.trees, dict(self.waiting)), []
        for (tree, level, index), (n, value) in other.waiting.items():
            made += out.add(tree, n, level, index, value)
        return out, made


class Piece:
    """What a range partition holds of the trees."""

    def __init__(self, plan: dict, keys: list, leaves: list[str]):
        bounds = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        self.trees, self.first = plan["trees"], plan["tree"]
        self.parts = []  # (first index, leaves of the tree, levels) of each tree
        last = len(bounds) - 2
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            offset = plan["offset"] if k == 0 else 0
            n = plan["first_n"] if k == 0 else plan["last_n"] if k == last else b - a
            self.parts.append((a, b, offset, n, climb(n, offset, leaves[a:b])))
        whole = [k for k, p in enumerate(self.parts) if p[1] - p[0] == p[3]]
        self.top = climb(self.trees, self.first + whole[0], [self.parts[k][4][-1][1][0] for k in whole]) if whole else []

    def spans(self) -> Iterator[tuple[int, int, int, int, list]]:
        """(tree, leaves, first index, last index, levels) of the trees that it has only a part of, and of the top."""
        for k, (a, b, offset, n, levels) in enumerate(self.parts):
            if b - a < n:
                yield self.first + k, n, offset, offset + b - a - 1, levels
        yield TOP, self.trees, self.first, self.first + len(self.parts) - 1, self.top

    def waiting(self) -> Iterator[tuple]:
        """The forest: nodes whose siblings aren't all here, as (tree, leaves, level, index, digest)."""
        for tree, n, _, _, levels in self.spans():
            for level, (first, held) in enumerate(levels):
                done = levels[level + 1] if level + 1 < len(levels) else (0, [])
                taken = range(done[0] * ARITY, (done[0] + len(done[1])) * ARITY)
                for index, value in enumerate(held, first):
                    if index not in taken:
                        yield tree, n, level, index, value

    def wanted(self) -> Iterator[tuple[int, int, int]]:
        """(tree, level, index) of the nodes that its leaves' proofs need and that it can't make."""
        if self.trees == 1 and not self.top:
            yield TOP, 0, 0
        for tree, n, low, high, levels in self.spans():
            level = 0
            while width(n, level) > 1:
                first, held = levels[level] if level < len(levels) else (0, [])
                here = range(first, first + len(held))
                for index in range(low // ARITY * ARITY, run_of(n, level, high).stop):
                    if index not in here:
                        yield tree, level, index
                low, high, level = low // ARITY, high // ARITY, level + 1

    def proofs(self, other: dict, changed: list) -> Iterator[tuple[str, str, str]]:
        """(subroot, proof's digest, root folded from the changed leaf) for each leaf; other: the wanted nodes."""
        tops = Path(TOP, self.trees, self.top, other)
        for k, (a, b, offset, n, levels) in enumerate(self.parts):
            tree = self.first + k
            path = Path(tree, n, levels, other)
            subroot = levels[-1][1][0] if b - a == n else other[TOP, 0, tree]
            beyond = tops.siblings(0, tree)
            roots: dict[str, str] = {}
            for at in range(a, b):
                index = offset + at - a
                own = levels[0][1][at - a] if changed[at] is None else changed[at]
                folded = path.fold(0, index, own)
                if folded not in roots:
                    roots[folded] = tops.fold(0, tree, folded)
                yield subroot, digest((path.siblings(0, index), beyond)), roots[folded]


class Path:
    """The way up in one tree, from nodes that are here or were asked for."""

    def __init__(self, tree: int, n: int, levels: list, other: dict):
        self.tree, self.n, self.levels, self.other = tree, n, levels, other
        self.above: dict[tuple[int, int], str] = {}
        self.folded: dict[tuple[int, int, str], str] = {}

    def node(self, level: int, index: int) -> str:
        if level < len(self.levels):
            first, held = self.levels[level]
            if first <= index < first + len(held):
                return held[index - first]
        return self.other[self.tree, level, index]

    def siblings(self, level: int, index: int) -> str:
        """The digests of the siblings, level by level, joined."""
        if width(self.n, level) == 1:
            return ""
        up = (level + 1, index // ARITY)
        if up not in self.above:
            self.above[up] = self.siblings(*up)
        return "".join([*(self.node(level, k) for k in run_of(self.n, level, index) if k != index), self.above[up]])

    def fold(self, level: int, index: int, value: str) -> str:
        """The tree's root if the node were `value`."""
        if width(self.n, level) == 1:
            return value
        parent = digest(value if k == index else self.node(level, k) for k in run_of(self.n, level, index))
        key = (level + 1, index // ARITY, parent)
        if level:
            return self.fold(*key)
        if key not in self.folded:
            self.folded[key] = self.fold(*key)
        return self.folded[key]


def names(keys: pd.Series) -> list[str | None]:
    return [k if isinstance(k, str) else None for k in keys]


NODES = "tree long, n long, level int, index long, digest string"


def place(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows (key, id, leaf, ...) sorted into range partitions, with part and pos."""
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    tasks = max(1, math.ceil(rows.count() / task_rows))
    order = [F.col(key).asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    numbered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    return checkpoint(numbered.select("*", F.shiftright("row", 33).cast("int").alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("pos")).drop("row"))


def plans(placed: DataFrame, key: str) -> tuple[dict[int, dict], int]:
    """For each partition the number of its first tree, how many leaves of that lie before, and the leaves of its first and last tree in all; and the number of trees."""
    counts = placed.groupBy("part", F.col(key).alias("key")).agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("key", "n")).alias("first"), F.max(F.struct("key", "n")).alias("last"), F.count("*").alias("keys"))
    found, tree, past, totals = {}, -1, None, {}
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        if past is None or r["first"]["key"] != past["key"]:
            tree += 1
        found[r["part"]] = {"tree": tree, "offset": totals.get(tree, 0), "last": tree + r["keys"] - 1}
        totals[tree] = totals.get(tree, 0) + r["first"]["n"]
        if r["keys"] > 1:
            tree += r["keys"] - 1
            totals[tree] = r["last"]["n"]
        past = r["last"]
    for p in found.values():
        p |= {"first_n": totals[p["tree"]], "last_n": totals[p["last"]], "trees": tree + 1}
    return found, tree + 1


def reduce_forests(forests: DataFrame, parts: int, trees: int) -> DataFrame:
    """forests (part, nodes) -> all nodes that ever waited or were made, as NODES; rounds of FAN forests each."""

    def merge(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        total, made = Forest(trees), []
        for _, one in nodes.groupby("part", sort=True):
            rows = one[["tree", "level", "index", "n", "digest"]].itertuples(index=False, name=None)
            total, new = total.joined(Forest(trees, {(t, v, i): (n, d) for t, v, i, n, d in rows}))
            made += new
        waits = set(total.waiting)
        rows = [(key[0], *m, (m[0], m[2], m[3]) in waits, True) for m in made]
        new = {(m[0], m[2], m[3]) for m in made}
        rows += [(key[0], t, n, v, i, d, True, False) for (t, v, i), (n, d) in total.waiting.items() if (t, v, i) not in new]
        return pd.DataFrame(rows, columns=["part", "tree", "n", "level", "index", "digest", "waits", "made"])

    every = forests.select("tree", "n", "level", "index", "digest")
    while parts > 1:
        parts = -(-parts // FAN)
        forests = checkpoint(
            forests.withColumn("into", F.expr(f"CAST(part div {FAN} AS INT)")).groupBy("into").applyInPandas(merge, f"part int, {NODES}, waits boolean, made boolean")
        )
        every = every.unionByName(forests.where("made").select("tree", "n", "level", "index", "digest"))
        forests = forests.where("waits").drop("waits", "made")
    return every


def manifest(docs: DataFrame, changed: Column | None = None, key: str = "lang", id_col: str = "doc_id", columns: Iterable[str] = COLUMNS, task_rows: int = TASK_ROWS) -> DataFrame:
    """A row for each row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    changed: the leaf as it is now where a row was tampered with, else null. The folded root is that of the changed leaf, or of the leaf itself,
    with the original siblings."""
    now = F.lit(None).cast("string") if changed is None else changed
    shown = leaf(F.col(f"`{c}`") for c in columns)
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), shown.alias("leaf"), now.alias("changed"))
    placed = place(rows, "key", task_rows)
    plan, trees = plans(placed, "key")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(plan)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, keys, leaves = None, [], []
        for batch in batches:
            if len(batch):
                part = int(batch["part"].iloc[0])
                keys += names(batch["key"])
                leaves += batch["leaf"].tolist()
        if part is not None:
            piece = Piece(shared.value[part], keys, leaves)
            out = [(part, *node, False) for node in piece.waiting()] + [(part, t, 0, level, index, "", True) for t, level, index in piece.wanted()]
            yield pd.DataFrame(out, columns=["part", "tree", "n", "level", "index", "digest", "wanted"])

    found = checkpoint(placed.select("part", "key", "leaf").mapInPandas(fold, f"part int, {NODES}, wanted boolean"))
    every = checkpoint(reduce_forests(found.where("NOT wanted").drop("wanted"), max(plan, default=0) + 1, trees))
    height = next(k for k in range(99) if width(max(1, trees), k) == 1)
    root = every.where((F.col("tree") == TOP) & (F.col("level") == height)).first()
    given = found.where("wanted").select("part", "tree", "level", "index").join(every.select("tree", "level", "index", "digest"), ["tree", "level", "index"])

    def prove(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        other = {(t, v, i): d for t, v, i, d in others[["tree", "level", "index", "digest"]].itertuples(index=False, name=None)}
        leaves = rows["leaf"].tolist()
        piece = Piece(shared.value[int(rows["part"].iloc[0])], names(rows["key"]), leaves)
        changes = [c if isinstance(c, str) else None for c in rows["changed"]]
        out = pd.DataFrame(piece.proofs(other, changes), columns=["subroot", "proof_sha256", "folded_root"])
        return rows[["id", "no_id", "leaf"]].join(out)

    known = placed.select("part", "pos", "key", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "leaf", "changed")
    schema = "id long, no_id boolean, leaf string, subroot string, proof_sha256 string, folded_root string"
    proved = known.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(prove, schema)
    top = F.lit(root["digest"] if root else None).cast("string")
    return proved.select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col), "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified")
    )
