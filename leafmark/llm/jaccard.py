"""Similar documents by n-gram Jaccard, exactly, with a token-group matrix.

A document's set is its distinct shingles of `width` words; two documents link
when the intersection is at least `percent` hundredths of the union.

1. Documents of equal sets become one class, named by the digest of the set.
2. The corpus is asked how many texts hold each shingle, which orders all
   shingles from rare to frequent.  Of two linked sets, the larger has a
   common shingle within its first n - percent n / 100 + 1, and the smaller
   has it within its first n - 2 percent n / (100 + percent) + 1: the one may
   ask, the other may be found.  Shingles that one text alone has fall away.
3. Similar classes are grouped: each goes to the pivot that shares most of its
   first shingles, and is held against it.  Rounds of pivots follow, each from
   the largest component that a shingle has, until they find few new links.
   Classes that links join are one group; those that are similar to a pivot
   without linking are another; groups are split where they have many tokens.
4. The token-group matrix has the shingles by which a group's members may be
   found.  A class meets through it the groups that aren't of its own
   component.  The union of each such group's sets is stored; what a class has
   in common with the union bounds the intersection with every member, and
   groups whose bound is too small aren't opened.
5. The groups that qualify are opened: their members' sets are compared.

Each pair of linked classes is either joined before or meets in step 4, as one
of both asks for a shingle by which the other is found.  A task answers with a
forest of the links that it sees, so nobody enumerates the pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import exchange as ex
from leafmark.llm.components import attach, components
from leafmark.llm.shared import Scratch, lean, stage
from leafmark.llm.words import LOWER, Words, bounded, inner_windows, mix, places, text_bytes, window_hashes

WIDTH = 5
PERCENT = 75
#: Shingles of a group's members, and classes held against it in one task, about.
GROUP, QUERIES = 100_000, 128
#: Rounds of pivots end when they join less than 1 / YIELD of what they try, and after so many at the latest:
#: the rounds only save work, the matrix finds what they leave.
ROUNDS, YIELD = 8, 20
#: For one class that a group is opened for, a task's files are sized as for so many plain rows.
OPENED = 50
#: Rows of the matrix that meet one shingle in one task, about.
MEETINGS = 2048
#: Rows of 50 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Cells in the table of shingle counts for each shingle.
CELLS_PER_TOKEN = 32

_KEPT = "node binary, n long, tokens array<long>, own int, set binary"


def least_common(n, m, percent: int = PERCENT):
    """The least intersection of linked sets of n and m shingles (numbers, arrays or columns' SQL names)."""
    if isinstance(n, str):
        return f"((({percent} * ({n} + {m})) + {99 + percent}) div {100 + percent})"
    return -(-percent * (n + m) // (100 + percent))


def _sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, LOWER)
    ids, first = words.hashes(), words.first
    n = np.diff(first)
    start = inner_windows(first, width)
    hashes = window_hashes(ids, width)[start] if len(start) else np.empty(0, np.uint64)
    ends = np.cumsum(np.maximum(0, n - width + 1))
    out = []
    for i, size in enumerate(n.tolist()):
        if size >= width:
            own = np.sort(hashes[ends[i] - (size - width + 1) : ends[i]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif size:
            own = mix(window_hashes(ids[first[i] : first[i] + size], size) + np.uint64(size))
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
    return out


def shingle_sets(docs: DataFrame, width: int = WIDTH, with_set: bool = False, *columns: str) -> DataFrame:
    """(doc_id, columns, n_shingles, digest[, set]) of every document; digest is null for empty sets."""
    import pyarrow as pa

    names = ["doc_id", *columns]
    kinds = docs.select(*names).schema

    def batch(batches):
        for b in bounded(batches):
            raw = [s.tobytes() for s in _sets(text_bytes(b.column("text")), width)]
            digest = [hashlib.md5(r).digest() if r else None for r in raw]
            made = [pa.array([len(r) // 8 for r in raw], pa.int64()), pa.array(digest, pa.binary())]
            made += [pa.array(raw, pa.binary())] * with_set
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + made, [*names, "n_shingles", "digest", "set"][: len(names) + len(made)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", n_shingles long, digest binary" + ", set binary" * with_set
    return docs.select(*names, "text").mapInArrow(batch, schema)


class _Levels(ex.Reduction):
    """How many texts have a cell; told is 0 for one text, else a coarse logarithm, which orders all texts' shingles alike."""

    def answer(self, keys, values):
        total = values[0]
        return [np.where(total > 1, 1 + np.floor(8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint64)]


def _own_sets(table, told, width: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Of a chunk: the classes whose representatives it was told of (as block -1), in order, and their sets."""
    wanted = {a for b, a in zip(told["block"].to_pylist(), told["answer"].to_pylist(), strict=True) if b < 0}
    found = {}
    if table.num_rows and wanted:
        ids = table["doc_id"].to_pylist()
        mine = [i for i, d in enumerate(ids) if d is not None]
        texts = text_bytes(table["text"])
        for i, own in zip(mine, _sets([texts[i] for i in mine], width), strict=True):
            digest = hashlib.md5(own.tobytes()).digest()
            if ids[i].to_bytes(8, "little", signed=True) + digest in wanted:
                found[digest] = own
    return sorted(found), [found[k] for k in sorted(found)]


def _prefixes(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, n, tokens, own, set) of the classes with a first shingle that others may hold too.

    tokens: those by which the class asks, rare ones first; by `own` of them, which come first, it may be found.
    """
    import pyarrow as pa

    plan = ex.plan_chunks(docs)
    bits = max(10, (CELLS_PER_TOKEN * plan.text_bytes // 5).bit_length())
    dealt, levels = ex.deal(docs, plan, "doc_id", "text"), _Levels(bits)

    def wanted(batches):
        for b in batches:
            both = [i.to_bytes(8, "little", signed=True) + d for i, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-1] * len(both), pa.int64()), pa.array(both, pa.binary())], ["chunk", "block", "answer"])

    mine = reps.select(ex.chunk_of(plan, "rep").alias("chunk"), "rep", "digest").mapInArrow(wanted, ex.ANSWER)

    def cells(sets):
        return places(mix(np.concatenate(sets)) >> np.uint64(64 - bits))

    def count(table, told):
        _, sets = _own_sets(table, told, width)
        if not sets:
            return ex.asks([])
        known, place = cells(sets)
        return ex.asks(levels.ask(plan, table["chunk"][0].as_py(), known, [np.bincount(place).astype(np.uint64)]))

    def prefix(table, told):
        nodes, sets = _own_sets(table, told, width)
        rows, begin = [], 0
        if sets:
            known, place = cells(sets)
            level = levels.read(plan, ex.by_block(told), known)[0][place]
        for node, own in zip(nodes, sets, strict=True):
            n, seen = len(own), level[begin : begin + len(own)]
            begin += n
            order = np.lexsort((own, seen))
            asks, found = n - -(-percent * n // 100) + 1, n - least_common(n, n, percent) + 1
            first = order[:asks]
            shared = seen[first] > 0
            if shared.any():
                rows.append((node, n, own[first[shared]].view(np.int64), int(shared[:found].sum()), own.tobytes()))
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["node", "n", "tokens", "own", "set"])

    answered = levels.resolve(ex.told(dealt, mine, count, ex.ASK), plan)
    return ex.told(dealt, mine.unionAll(answered.select("chunk", "block", "answer")), prefix, _KEPT)


def _few(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


class _Index:
    """The sets of some classes, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens)
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The sets that link with this one."""
        lo, hi = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * shared >= percent * (len(own) + self.sizes - shared))


def _dealt(queries: DataFrame, key: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """queries (so many) with the task that each is dealt to, and the tasks of each key."""
    n = queries.groupBy(*key).agg(F.count("*").alias("c")).select(*key, "c", F.ceil(F.col("c") / QUERIES).cast("int").alias("parts"))
    dealt = attach(queries, n, key, "c", total).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    return dealt, n.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _open(members: DataFrame, queries: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Edges (u, v) that join all of queries (key, part, node, set) that link with members (key, part, node, set).

    The members of a key (bounded) go to each task of it.  A task's edges are
    a forest of the links between its queries and members.
    """
    import pyarrow as pa

    def links(left, right):
        out = []
        if left.num_rows and right.num_rows:
            own = sorted(zip(left["node"].to_pylist(), left["set"].to_pylist(), strict=True))
            index, parent = _Index([np.frombuffer(s, np.uint64) for _, s in own]), {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for node, raw in sorted(zip(right["node"].to_pylist(), right["set"].to_pylist(), strict=True)):
                for k in index.linked(np.frombuffer(raw, np.uint64), percent).tolist():
                    a, b = find(node), find(own[k][0])
                    if a != b:
                        parent[a] = b
                        out.append((node, own[k][0]))
        columns = list(zip(*out, strict=True)) if out else [()] * 2
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["u", "v"])

    key = [*key, "part"]
    members, queries = members.toDF(*members.columns), queries.toDF(*queries.columns)
    return members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(links, "u binary, v binary")


def _unions(members: DataFrame) -> DataFrame:
    """(g, linked, h, lo, union): the least size and the token union of each group (g, linked, h, node, set)."""
    import pyarrow as pa

    def union(key, table):
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        both = np.unique(np.concatenate(sets))
        row = [*[k.as_py() for k in key], min(map(len, sets)), both.tobytes()]
        kinds = (pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["g", "linked", "h", "lo", "union"])

    return members.groupBy("g", "linked", "h").applyInArrow(union, "g binary, linked boolean, h int, lo long, union binary")


def _qualify(unions: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """(g, linked, h, part, node) of the queries whose overlap with a group's token union may hold a link."""
    import pyarrow as pa

    key, kinds = ["g", "linked", "h", "part"], (pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())

    def bound(left, right):
        out = []
        if left.num_rows and right.num_rows:
            tokens, lo = np.frombuffer(left["union"][0].as_py(), np.uint64), left["lo"][0].as_py()
            head = [left[k][0].as_py() for k in key]
            for node, raw in zip(right["node"].to_pylist(), right["set"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                common = int((tokens[np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)] == own).sum())
                if common >= least_common(len(own), max(lo, -(-percent * len(own) // 100)), percent):
                    out.append((*head, node))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*key, "node"])

    unions, queries = unions.toDF(*unions.columns), queries.toDF(*queries.columns)
    return unions.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(bound, "g binary, linked boolean, h int, part int, node binary")


def _pivots(met: DataFrame, number: int) -> DataFrame:
    """(token, c, pivot, home, m): of the classes (token, node, n, root, common) that have a shingle, the pivot, its component and size.

    First the class with most in common with others; later a member, another
    each time, of the largest component that has the shingle.
    """
    who = F.struct("node", "root", "n")
    if number == 0:
        best = met.groupBy("token").agg(F.count("*").alias("c"), F.max_by(who, F.struct("common", "node")).alias("p"))
    else:
        draw = F.struct(F.xxhash64(F.lit(number), "node"), F.col("node"))
        homes = met.groupBy("token", "root").agg(F.count("*").alias("k"), F.max_by(who, draw).alias("p"))
        best = homes.groupBy("token").agg(F.sum("k").alias("c"), F.max_by("p", F.struct("k", "root")).alias("p"), F.count("*").alias("homes")).where("homes > 1")
    return best.select("token", "c", F.col("p.node").alias("pivot"), F.col("p.root").alias("home"), F.col("p.n").alias("m"))


def _similar(kept: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that join all linked classes of kept."""
    spark = kept.sparkSession
    n_kept, n_tokens = kept.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    common = F.size("tokens") / F.col("n")  # of a class with the largest share of its set in common with others, most are near
    rows = kept.select("node", "n", "own", common.alias("common"), F.posexplode("tokens").alias("pos", "token"))
    rows = rows.select("token", "node", "n", "common", (F.col("pos") < F.col("own")).alias("found"))
    # shingles that one class alone has among its first, or by which none may be found, fall here
    tokens = rows.groupBy("token").agg(F.count("*").alias("c"), F.max("found").alias("f")).where("c > 1 and f").select("token", "c")
    tokens = scratch.stage(tokens, "tokens", n_tokens)
    total = tokens.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    met = scratch.stage(attach(rows, tokens, ["token"], "c", total), "met", total)
    sets = kept.select("node", "set")

    edges, n_edges = spark.createDataFrame([], "u binary, v binary"), 0
    roots, home = None, None
    for number in range(ROUNDS):
        if roots is None:
            now = met.withColumn("root", F.col("node"))
        else:
            now = met.join(roots.withColumnRenamed("root", "r"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("r", "node")).drop("r", "of")
            now = scratch.stage(now, "now", total)
        pivots = scratch.stage(_pivots(now, number), "pivots", total)
        meets = attach(now, pivots, ["token"], "c", total).where("root <> home")
        fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
        votes = meets.groupBy("node", "pivot").agg(F.count("*").alias("votes"), F.first(fits).alias("fits"))
        best = votes.groupBy("node").agg(F.max_by(F.struct("pivot", "fits"), F.struct("fits", "votes", "pivot")).alias("p")).select("node", "p.*")
        best = scratch.stage(best, "best", n_kept)
        home = best.select("node", F.col("pivot").alias("near")) if number == 0 else home
        tried = best.where("fits").select("pivot", "node")
        n_tried = tried.count()
        queries, tasks = _dealt(tried, ["pivot"], n_tried)
        queries, tasks = scratch.stage(queries, "tried", n_kept), scratch.stage(tasks, "tasks", n_kept)
        members = _few(tasks).join(sets.select(F.col("node").alias("pivot"), "node", "set"), "pivot")
        asked = sets.join(_few(queries), "node").select("pivot", "part", "node", "set")
        new = scratch.stage(_open(members.select("pivot", "part", "node", "set"), asked, ["pivot"], percent), "links", OPENED * n_tried)
        n_new = new.count()
        edges, n_edges = edges.unionAll(new), n_edges + n_new
        found = scratch.stage(components(edges, scratch, n_edges), "roots", n_kept)
        roots = found.select(F.col("node").alias("of"), "root")
        if YIELD * n_new <= n_tried:
            break

    # the groups: linked classes, and classes similar to a pivot without linking
    nodes = met.groupBy("node").agg(F.first("n").alias("n")).join(roots, F.col("node") == F.col("of"), "left").join(home, "node", "left")
    nodes = nodes.select("node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("root", "near", "node").alias("g"), F.col("root").isNotNull().alias("linked"))
    nodes = scratch.stage(nodes, "nodes", n_kept)
    sizes = nodes.groupBy("g", "linked").agg(F.count("*").alias("c"), F.ceil(F.sum("n") / GROUP).alias("parts"))
    nodes = scratch.stage(attach(nodes, sizes, ["g", "linked"], "c", n_kept).withColumn("h", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts"), "grouped", n_kept)

    met = met.select("token", "node", "found").join(nodes, "node")
    mixed = met.groupBy("token").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token", "c")
    mixed = scratch.stage(mixed, "mixed", total)
    met = scratch.stage(attach(met, mixed, ["token"], "c", total), "mixed_met", total)
    # a cell of the matrix: a shingle by which members of a group may be found
    matrix = met.where("found").groupBy("token", "g", "linked", "h").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("a"), F.max("root").alias("b"))
    salts = mixed.select("token", "c", F.ceil(F.col("c") / MEETINGS).cast("int").alias("salts"))
    asked = attach(met.select("token", "node", "n", "root"), salts, ["token"], "c", total).select("token", "node", "n", "root", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"))
    cells = matrix.join(salts.drop("c"), "token").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    other = (F.col("a") != F.col("b")) | (F.col("a") != F.col("root"))
    fits = (F.col("lo") <= F.col("n")) & (F.col("hi") * 100 >= F.col("n") * percent)
    meets = asked.join(cells, ["token", "salt"]).where(other & fits).groupBy("g", "linked", "h", "node").agg(F.count("*").alias("votes"))
    meets = scratch.stage(meets, "meets", total)

    key, n_meets = ["g", "linked", "h"], meets.count()
    queries, tasks = _dealt(meets.drop("votes"), key, n_meets)
    queries, tasks = scratch.stage(queries, "asked", n_meets), scratch.stage(tasks, "tasks", n_meets)
    homes = scratch.stage(tasks.select(*key).distinct().join(nodes.select(*key, "node"), key), "homes", n_kept)
    members = sets.join(_few(homes), "node").select(*key, "node", "set")
    unions = scratch.stage(_unions(members), "unions", OPENED * n_kept)
    asked = sets.join(_few(queries), "node").select(*key, "part", "node", "set")
    opened = scratch.stage(_qualify(unions.join(tasks, key), asked, percent), "qualified", OPENED * n_meets)
    tasks = opened.select(*key, "part").distinct()
    homes = scratch.stage(tasks.join(homes, key).select(*key, "part", "node"), "opened", OPENED * n_meets)
    members = sets.join(_few(homes), "node").select(*key, "part", "node", "set")
    asked = sets.join(_few(opened), "node").select(*key, "part", "node", "set")
    return scratch.stage(edges.unionAll(_open(members, asked, key, percent)), "all", n_edges + OPENED * n_meets)


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the document's own
    if there are none.  Null texts and texts without words have empty sets and
    no links; rows without doc_id take no part and have a null component_id;
    rows that repeat a doc_id are all in the component of that id's texts.
    Other columns are ignored.
    """
    docs = lean(docs).select(F.col("doc_id").cast("long"), "text")
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.stage(shingle_sets(docs, width), "sets")
        n_docs = sets.count()
        full = sets.where("digest is not null and doc_id is not null")
        reps = scratch.stage(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "reps", n_docs)
        kept = scratch.stage(_prefixes(docs, reps, width, percent), "kept")
        edges = _similar(kept, percent, scratch)
        # the texts of a repeated id are in one component
        repeated = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id", "a")
        same = full.join(repeated, "doc_id").selectExpr("digest u", "a v").where("u <> v")
        linked = scratch.stage(components(edges.unionAll(same), scratch, n_docs), "linked", n_docs)
        placed = scratch.stage(reps.join(linked.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", "c", F.coalesce("root", "digest").alias("root")), "placed", n_docs)
        firsts = placed.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("k"))
        n = placed.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        named = attach(placed, firsts, ["root"], "k", n[0]).select("digest", "c", F.col("first").alias("component_id"))
        named = scratch.stage(named, "named", n_docs)
        whole = attach(full, named, ["digest"], "c", n[1]).select("doc_id", "n_shingles", "component_id")
        rest = sets.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stage(whole.unionAll(rest), "components", n_docs)
