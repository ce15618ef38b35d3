"""Near duplicates by a signature-coordinate inverted join.

A document is the set of its k-word shingles (lower-cased A-Z). Documents of equal sets form a class, and only classes
are compared. A class has a MinHash signature of COORDINATES values; it is posted under its (coordinate, value) pairs.

Match threshold: two sets of a Jaccard similarity s agree in each coordinate with probability s; a pair that agrees in
fewer than `agree` of the coordinates is given up. At s = 0.8 that is a chance of 3 in 10^11 with the default of 28 (2 in
10^8 with 32, below 10^-13 with 24); a smaller `agree` is the way to an even smaller one.

Prefix and skip merging: pairs are ordered by how many classes post under them, rare ones first. Two classes that agree
in `agree` pairs share one of the first COORDINATES - agree + 1 of either, so only these lists are merged (pairs under
which nobody else posts, and classes that share fewer than `agree` pairs with anyone, are skipped). The other, longer
lists are never merged: whether a candidate stands in them is looked up in its signature. Survivors are confirmed on
their full sets.

A large group isn't expanded into all pairs. First each class is compared with the most typical class of its lists (the
one that shares most of its pairs with others); what that connects needs no more comparisons, since only components are
wanted. What a list holds outside its largest component, and only that, then meets the rest of the list in tasks of
blocks: collisions are counted, and those above the threshold in other components are confirmed on the full sets, which
go once to each task; a task returns links that join components, no pairs. What is sent grows with the members of a list.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; one of fewer
than k words has its words as one shingle; repeated rows are of one class and share a result (if their doc_id is the
smallest, all of them are kept); a null doc_id is never the smallest, and components of null ids alone have a null
component and are kept; an empty table gives no rows; other columns are ignored, whatever their names (the removal keeps
them). Words are told apart by 64-bit hashes, classes by 128 bits of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import binaries, bounded, dropped, slices, small, staged, text_buffer
from arrayloom.llm.components import components
from arrayloom.llm.words import U, grams, hashes, spans, stream, whole

COORDINATES, AGREE, PER_GROUP = 64, 28, 128
#: Classes of a list's block, and of those outside its largest component that meet it in a task.
BLOCK, PROBES = 1024, 512
NULL_LAST = 2**63 - 1
_A, _B = stream(21, COORDINATES) | U(1), stream(22, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hashes of a set that isn't empty, in bounded memory."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> U(32)).min(axis=1).astype(np.uint32))
    return out


def _set(words: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, bytes | None]:
    """The sorted shingles of a text by one hash of its words, and a digest of the set by both; None of an empty set."""
    if not len(words):
        return np.zeros(0, U), None
    if len(words) < k:
        one, other = np.array([whole(words)], U), np.array([whole(others)], U)
    else:
        one, first = np.unique(grams(words, k), return_index=True)
        other = grams(others, k)[first]
    return one, xxhash.xxh3_128_digest(one.tobytes() + other.tobytes())


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """The shingle set of each text of a column and its digest, in order."""
    for a, b in slices(column):
        buf, offsets = text_buffer(column.slice(a, b - a))
        starts, ends, bounds = spans(buf, offsets)
        words, others = hashes(buf, starts, ends), hashes(buf, starts, ends, lane=1)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield _set(words[i:j], others[i:j], k)


def _keyed(docs: DataFrame) -> DataFrame:
    """id (null: NULL_LAST), key (16 bytes that tell texts apart) and text of each row."""
    return docs.select(*_keys(docs), docs["text"].alias("text"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, key, n (set size), class (a digest of the set; null if empty), sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 2 << 20):
                part, n, cls, sig = batch.slice(a, b - a), [], [], []
                for s, digest in sets_of(part.column(2), k):
                    n.append(len(s))
                    cls.append(digest)
                    sig.append(signature(s).view(np.int32).tolist() if digest else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["id", "key", "n", "class", "sig"])

    return _keyed(docs).mapInArrow(run, "id long, key binary, n long, class binary, sig array<int>")


def prefix_postings(classes: DataFrame, agree: int = AGREE) -> DataFrame:
    """list, node, shared: the prefix lists that classes (node, sig) share, and how many pairs of the node others share.

    How long a list is comes from an aggregation and a join with its staged result, which Spark can split where a list is
    very long.
    """
    value = F.col("value").cast("long") + F.lit(2**31)
    posted = classes.select("node", F.posexplode("sig").alias("coordinate", "value")).select(((F.col("coordinate").cast("long") * F.lit(2**32)) + value).alias("list"), "node")
    lengths, _ = staged(posted.groupBy("list").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    of_node = Window.partitionBy("node")
    ranked = posted.join(lengths, "list").withColumns({"shared": F.count("*").over(of_node), "place": F.row_number().over(of_node.orderBy("length", "list"))})
    return ranked.where(F.col("place") <= F.col("shared") - (agree - 1)).select("list", "node", "shared")


def _fits(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def colliding(pairs: DataFrame, classes: DataFrame, percent: int, agree: int = AGREE) -> DataFrame:
    """The pairs (a, b), met in a merged list, that collide often enough and whose sizes allow the similarity."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    agreed = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_fits(percent) & (agreed >= agree)).select("a", "b")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, str]:
    """A staged table of the pairs (a, b) with 100 * shared shingles >= percent * all shingles, on full sets taken from the texts again.

    pairs: a, b, and the task (g, h, i) that compares them; a set is sent once to each task that has a pair of it.
    """
    task = ["g", "h", "i"]
    wanted = pairs.select(*task, F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted, wanted_at = staged(wanted.join(classes.select("node", "id", "key"), "node"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in slices(batch.column(4), 2 << 20):
                part = batch.slice(x, y - x)
                data = [s.tobytes() for s, _ in sets_of(part.column(4), k)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], binaries(data)], names=[*task, "node", "data"])

    rows = _keyed(docs).join(small(wanted), ["id", "key"]).select(*task, "node", "text")

    def compare(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        found = dict(zip(sets.column("node").to_pylist(), sets.column("data"), strict=True))  # rows of an id and a text that repeat are equal
        out, last, first = [], None, None
        for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
            if a != last:
                last, first = a, np.frombuffer(found[a].as_buffer(), U)
            second = np.frombuffer(found[b].as_buffer(), U)
            at = np.minimum(np.searchsorted(first, second), len(first) - 1)
            shared = int((first[at] == second).sum())
            if 100 * shared >= percent * (len(first) + len(second) - shared):
                out.append((a, b))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = rows.mapInArrow(run, "g long, h long, i long, node long, data binary")
    links, links_at = staged(sets.groupBy(*task).cogroup(pairs.select("a", "b", *task).groupBy(*task)).applyInArrow(compare, "a long, b long"), "links")
    dropped(docs.sparkSession, wanted_at)
    return links, links_at


def star_tasks(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with tasks of about PER_GROUP pairs of one a."""
    parts, _ = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_GROUP).alias("parts")), "parts")
    return pairs.join(parts, "a").select("a", "b", F.col("a").alias("g"), F.pmod(F.xxhash64("b"), "parts").cast("long").alias("h"), F.lit(0).cast("long").alias("i"))


def agreements(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many coordinates each two signatures agree."""
    out = np.zeros((len(some), len(others)), np.uint8)
    for c in range(COORDINATES):
        out += some[:, c][:, None] == others[:, c][None, :]
    return out


class Task:
    """A block of a list and some of the classes outside its largest group: signatures, sizes, groups, and who probes whom."""

    def __init__(self, table: pa.Table, percent: int, agree: int) -> None:
        self.node, self.group, self.n, probe, self.outside = (table.column(c).to_numpy() for c in ("node", "group", "n", "probe", "outside"))
        self.sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(table), COORDINATES)
        self.percent, self.agree = percent, agree
        self.x, self.y = np.flatnonzero(probe), np.flatnonzero(~probe & (self.node != table.column("g")[0].as_py()))  # the lead has met all

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of x, and which of y collide with each often enough, are of another group and of a fitting size."""
        y = self.y
        for a in range(0, len(self.x), 128):
            x = self.x[a : a + 128]
            low, high = np.minimum(self.n[x][:, None], self.n[y][None, :]), np.maximum(self.n[x][:, None], self.n[y][None, :])
            right = (agreements(self.sig[x], self.sig[y]) >= self.agree) & (self.group[x][:, None] != self.group[y][None, :]) & (100 * low >= self.percent * high)
            yield x, right & (~self.outside[y][None, :] | (self.node[x][:, None] < self.node[y][None, :]))  # of two outside, one order

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join groups, found on full sets: shared elements of a probe with all others are counted at once."""
        y = self.y
        element = np.concatenate([sets[j] for j in y]) if len(y) else np.zeros(0, U)
        owner = np.repeat(np.arange(len(y)), [len(sets[j]) for j in y])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        head: dict[int, int] = {}

        def find(g: int) -> int:
            while head.get(g, g) != g:
                g = head[g]
            return g

        out = []
        for some, right in self.candidates():
            for i, fit in zip(some.tolist(), right, strict=True):
                if not fit.any():
                    continue
                low, high = np.searchsorted(element, sets[i], "left"), np.searchsorted(element, sets[i], "right")
                n = high - low
                at = np.repeat(high - np.cumsum(n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(y))
                similar = np.flatnonzero(fit & (100 * shared >= self.percent * (self.n[i] + self.n[y] - shared)))
                _, first = np.unique(self.group[y[similar]], return_index=True)
                for j in y[similar[first]].tolist():
                    g, h = find(int(self.group[i])), find(int(self.group[j]))
                    if g != h:
                        head[h] = g
                        out.append((int(self.node[i]), int(self.node[j])))
        return out


def outside_links(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, agree: int) -> tuple[DataFrame, str]:
    """A staged table of links (a, b) between groups, of classes in one list, one of them outside the list's largest group.

    members: lead, node, group. A task has a block of a list's classes and some of those outside; blocks and shares are
    dealt by hash, so no task has more than about BLOCK and PROBES of them. A first pass over signatures says which
    classes have candidates; the full sets of these alone go to the tasks. Tasks return links that join groups, no pairs.
    """
    groups = members.groupBy("lead", "group").agg(F.count("*").alias("n"))
    lists = groups.groupBy("lead").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("groups")).where("groups > 1")
    lists = lists.select("lead", F.col("most.group").alias("main"), F.ceil(F.col("total") / BLOCK).alias("blocks"), F.ceil((F.col("total") - F.col("most.n")) / PROBES).alias("shares"))
    lists, lists_at = staged(lists, "lists")
    held = members.join(lists, "lead").join(classes.select("node", "n", "sig"), "node").withColumn("outside", F.col("group") != F.col("main"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = (F.col("lead").alias("g"), "node", "group", "n", "sig", "outside")
    listed = held.select(*columns, F.pmod(F.xxhash64("node"), "blocks").alias("h"), spread("shares").alias("i"), F.lit(False).alias("probe"))
    probes = held.where("outside").select(*columns, spread("blocks").alias("h"), F.pmod(F.xxhash64("node", F.lit(1)), "shares").alias("i"), F.lit(True).alias("probe"))
    task, kept = ["g", "h", "i"], "g long, h long, i long, node long, group long, n long, sig array<int>, outside boolean, probe boolean"
    names = [x.split()[0] for x in kept.split(", ")]

    def busy(table: pa.Table) -> pa.Table:
        this = Task(table, percent, agree)
        stay = np.zeros(len(table), bool)
        for x, right in this.candidates():
            stay[x] |= right.any(axis=1)
            stay[this.y] |= right.any(axis=0)
        return table.select(names).filter(pa.array(stay))

    wanted = listed.unionByName(probes).groupBy(*task).applyInArrow(busy, kept)
    wanted, wanted_at = staged(wanted.join(classes.select("node", "id", "key"), "node"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(names)), 2 << 20):
                part = batch.slice(a, b - a)
                data = [s.tobytes() for s, _ in sets_of(part.column(len(names)), k)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], binaries(data)], names=[*names, "data"])

    def compare(table: pa.Table) -> pa.Table:
        keys = table.select(["node", "probe"]).to_pandas()
        table = table.filter(pa.array(~keys.duplicated().to_numpy())).combine_chunks()  # rows of an id and a text that repeat are equal
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("data")]
        found = Task(table, percent, agree).links(sets)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = _keyed(docs).join(small(wanted), ["id", "key"]).select(*names, "text").mapInArrow(run, f"{kept}, data binary")
    links, at = staged(rows.groupBy(*task).applyInArrow(compare, "a long, b long"), "links")
    for old in (wanted_at, lists_at):
        dropped(docs.sparkSession, old)
    return links, at


def _joined_up(links: DataFrame, path: str, led: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, agree: int) -> DataFrame:
    """The components of links and of what lists hold beyond them."""
    groups = components(links)
    members = led.join(groups.select("node", F.col("component").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    more, more_at = outside_links(members, classes, docs, k, percent, agree)
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    for old in (path, more_at):
        dropped(docs.sparkSession, old)
    return groups


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id) of each row."""
    found = _judged(docs, k, percent, agree)
    return found.select(F.nullif("id", F.lit(NULL_LAST)).alias("doc_id"), "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _judged(docs: DataFrame, k: int, percent: int, agree: int) -> DataFrame:
    """id, key, n_shingles, component_id, component (its number, null for an empty set) of each row."""
    spark = docs.sparkSession
    made, _ = staged(signatures(bounded(docs), k), "signatures")
    grouped = made.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "key")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes, _ = staged(grouped.select("class", "least.*", "n", "sig").withColumn("node", F.monotonically_increasing_id()), "classes")
    postings, at = staged(prefix_postings(classes, agree), "postings")
    best = postings.groupBy("list").agg(F.min(F.struct((-F.col("shared")).alias("shared"), "node")).alias("best"))
    best, best_at = staged(best.select("list", F.col("best.node").alias("lead")), "best")
    led, led_at = staged(postings.join(best, "list").select("lead", "node").distinct(), "led")
    dropped(spark, at)
    dropped(spark, best_at)
    stars = led.where("lead <> node").groupBy(F.least("lead", "node").alias("x"), F.greatest("lead", "node").alias("y")).agg(F.min("lead").alias("a"))
    stars = stars.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
    stars, at = staged(colliding(stars, classes, percent, agree), "stars")
    tasks, tasks_at = staged(star_tasks(stars), "tasks")
    dropped(spark, at)
    links, links_at = confirmed(tasks, classes, docs, k, percent)
    dropped(spark, tasks_at)
    groups = _joined_up(links, links_at, led, classes, docs, k, percent, agree)
    dropped(spark, led_at)
    member = classes.select("node", "class", "id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = member.groupBy("component").agg(F.min("id").alias("component_id"))
    named = member.join(smallest, "component").select("class", "component", F.nullif("component_id", F.lit(NULL_LAST)).alias("component_id"))
    out = made.select("id", "key", "n", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.nullif("id", F.lit(NULL_LAST))).otherwise(F.col("component_id"))
    return out.select("id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), "component")


def duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80, agree: int = AGREE) -> DataFrame:
    """One row of docs for each component, and every row of an empty set, with all columns.

    The row that stays has the smallest doc_id (null last), then the smallest digest of the text.
    """
    found, _ = staged(_judged(docs, k, percent, agree).where("component IS NOT NULL").groupBy("component", "id", "key").agg(F.count("*").alias("rows")), "judged")
    stays = found.groupBy("component").agg(F.min(F.struct("id", "key")).alias("stays"))
    marked = found.join(stays, "component").select("id", "key", (F.struct("id", "key") != F.col("stays")).alias("gone"), "rows")
    marks, _ = staged(marked.where("gone OR rows > 1").select("id", "key", "gone"), "marks")
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), *_keys(docs))
    joined = rows.join(small(marks), ["id", "key"], "left").where("gone IS NULL OR NOT gone")
    if marks.where("NOT gone").limit(1).count():  # rows that repeat
        joined = joined.where("gone IS NULL").unionByName(joined.where("NOT gone").dropDuplicates(["id", "key"]))
    return joined.select(*[F.col("doc")[c].alias(c) for c in columns])


def _keys(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_LAST)).alias("id"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).alias("key")]
