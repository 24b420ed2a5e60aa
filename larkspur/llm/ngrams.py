"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text's words (lower-cased runs of ASCII letters, digits and all other characters beyond ASCII) give shingles of SHINGLE
consecutive words; a text of fewer words is one shingle. Documents with equal sets of shingles are copies and take
part once, as a class with a number of copies.

Each of TREES trees is a prefix trie over sequences of MinHash values of eight bits, kept as sorted keys. A tree's sequence begins with
OWN values of its own and goes on into the next tree's, DEEPEST in all. The matched prefix starts at its deepest and is shortened
until the target recall is met (``matched_depth``): the share of the links among all pairs of a class and the smallest of its prefix,
verified exactly, that still meet in some tree. Too few to tell leave the prefix at the depth where a pair at the threshold, the worst case, meets with the target
probability (``prefix_depth``); it is never shorter, so no corpus is matched worse than that.

Classes that share a prefix are joined to the smallest of them, so a very common prefix gives one row per class and tree and
never its pairs. Prefixes also meet by chance, and chains of such meetings would join a whole corpus of boilerplate; so every joined
pair is compared by its signatures, and where one is too far from the threshold to be a link, all pairs of that
prefix are compared and only those that may be links stay. (Prefixes of more than GROUP classes keep all of theirs.) The components of what stays
hold every candidate pair; within each, all pairs are verified exactly on the full sets. The classes that come out are
components of verified links alone.

Verification works on blocks of bounded weight, in order of set size: a pair of blocks whose sizes
alone rule the threshold out is skipped, and one that remains gives at most one row per class (its number of links, and a
member of its local component). Links are thus complete within a component without ever being expanded into pairs. A component is cut into
PARTS blocks or more, so that the pairs of a large one are spread over many tasks.

Defined cases: null texts and texts without words link with nothing and are classes of their own; rows with a null id count
only as copies of others and, if they have none with an id, get a null class; repeated rows count as copies; different texts of one id are
documents of their own, each with its row and links; very long texts are shingled whole; an empty table gives an empty table; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, connected_components, groups, least_of_each, linked_members, number_rows, summarise_links

SHINGLE = 5
THRESHOLD = 0.8
#: Trees, values of a tree's own (eight bits each, one word), and of its whole sequence.
TREES, OWN, DEEPEST = 40, 8, 16
RECALL = 0.999
#: Signature values that a candidate pair is compared by, and by how many standard errors it may fall short of the threshold.
COMPARED, ERRORS = 128, 4.5
#: Classes of a prefix whose pairs are compared by their signatures.
GROUP = 1024
#: Shingles of a block of verification; every class weighs SMALLEST at least. A component has about PARTS blocks, LEAST or more each.
WEIGHT, SMALLEST, PARTS, LEAST = 1_000_000, 500, 32, 80_000
#: Columns of a dense incidence matrix that are multiplied at a time.
COLUMNS = 4096

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix with which a pair of this similarity shares one in some tree with at least this probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, _U)
    up[0] = 1
    inverse = np.full(n, pow(int(_BASE), -1, 1 << 64), _U)
    inverse[0] = 1
    return np.cumprod(up), np.cumprod(inverse)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit value for each word, in order, from running polynomial sums over the bytes."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = _WORD[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.zeros(0, _U)
    up, inverse = _powers(1 << max(16, int(data.size).bit_length()))
    sums = np.r_[_U(0), np.cumsum((data.astype(_U) + _U(1)) * up[: data.size])]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingles, as sorted 64-bit values."""
    words = word_hashes(text or "")
    if not words.size:
        return words
    n = max(words.size - SHINGLE + 1, 1)
    total = np.zeros(n, _U)
    for k in range(min(SHINGLE, words.size)):
        total = mix(total + words[k : k + n] + _U(k + 1))
    return np.unique(total)


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhash(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n permutations of the values."""
    factor, shift = _permutations(n)
    low, high = values.astype(np.uint32), (values >> _U(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(values), 128):
        x = low[a : a + 128, None] * factor
        x ^= x >> np.uint32(15)
        x += high[a : a + 128, None] ^ shift
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def signature(values: np.ndarray, trees: int) -> np.ndarray:
    """The trees' words of OWN values each, first value first, as 64-bit numbers."""
    least = minhash(values, OWN * trees) * np.uint32(0x9E3779B1)
    return (least >> np.uint32(24)).astype(np.uint8).view(">i8").astype(np.int64)


def values_of(words: np.ndarray) -> np.ndarray:
    """The values of rows of words, one byte each, in order."""
    return np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), -1)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles."""
    return (int(mix(s + _U(5)).sum(dtype=_U).view(np.int64)), int(mix(s ^ _BASE).sum(dtype=_U).view(np.int64))) if len(s) else (0, 0)


def mark(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def signatures(docs: DataFrame, key: str, text: str, trees: int) -> DataFrame:
    """(id, mark, size, set1, set2, words): the number of shingles, a 128-bit digest of their set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, words = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t)
                sizes.append(len(s))
                sets.append(set_digest(s))
                words.append(signature(s, trees) if len(s) else None)
            numbers = [pa.array(sizes, pa.int64()), *(pa.array([s[k] for s in sets], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(words, pa.list_(pa.int64()))], names=["id", "mark", "size", "set1", "set2", "words"])

    return docs.select(F.col(key).cast("bigint").alias("id"), mark(text).alias("mark"), text).mapInArrow(run, "id bigint, mark bigint, size bigint, set1 bigint, set2 bigint, words array<bigint>")


def prefix(depth: int) -> list:
    """Columns that are equal for sequences (w, w2) with the same first values; the trie is these columns, sorted."""
    cut = lambda word, n, name: F.shiftright(word, 64 - 8 * n).alias(name)
    return [cut("w", depth, "p")] if depth <= OWN else [F.col("w").alias("p"), cut("w2", depth - OWN, "p2")]


def on_prefix(entries: DataFrame, depth: int) -> tuple[DataFrame, list[str]]:
    keys = ["tree", "p", "p2"][: 2 + (depth > OWN)]
    return entries.select("*", *prefix(depth)), keys


def met(entries: DataFrame, depth: int) -> DataFrame:
    """entries (tree, rep, w, w2) whose prefix another class has, with the smallest class (head) and the number (n) of classes that have it."""
    own, keys = on_prefix(entries, depth)
    heads = own.groupBy(*keys).agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.join(checkpoint(heads), keys).select(*keys, "rep", "w", "w2", "head", "n")


def stars(entries: DataFrame) -> DataFrame:
    return entries.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()


def deepest_meeting(x: np.ndarray, y: np.ndarray) -> int:
    """The longest prefix that two signatures share in any tree."""
    same = values_of(x[None])[0].reshape(-1, OWN) == values_of(y[None])[0].reshape(-1, OWN)
    # a sequence goes on into the next tree's values
    same = np.concatenate([same, np.roll(same, -1, axis=0)[:, : DEEPEST - OWN]], axis=1)
    return int(np.cumprod(same, axis=1).sum(axis=1).max())


def link_depths(docs: DataFrame, key: str, text: str, classes: DataFrame, words: DataFrame, pairs: DataFrame, threshold: float) -> dict[int, int]:
    """How many of the pairs (a, b) are links, by the longest prefix that they share; all are verified. A class without ``least`` is named by its id."""
    named = classes if "least" in classes.columns else classes.withColumn("least", F.col("rep"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    known = ids.join(named, "rep").select("rep", "least", "set1", "set2")
    texts = docs.select(F.col(key).cast("bigint").alias("least"), F.col(text).alias("text")).join(known, "least")
    sets = checkpoint(shingle_sets(texts.select("rep", "set1", "set2", "text")).select("rep", "shingles").join(words, "rep"))
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("shingles").alias(f"{s}_set"), F.col("words").alias(f"{s}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a_set", "b_set", "a_words", "b_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, p, q in zip(*(batch.column(i) for i in range(4))):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common) - 1e-6:
                    out.append(deepest_meeting(*(v.values.to_numpy(zero_copy_only=False) for v in (p, q))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["depth"])

    counts = both.mapInArrow(run, "depth int").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    return {r["depth"]: r["n"] for r in counts.collect()}  # DEEPEST rows at most


def matched_depth(links: dict[int, int], least: int, recall: float) -> int:
    """The longest prefix, least at the shortest, that loses no more of the counted links than the target recall lets it.

    Three links more than were lost are counted (the rule of three), so few links do not pass for a sure recall.
    """
    total = sum(links.values())
    for depth in range(DEEPEST, least, -1):
        lost = sum(n for d, n in links.items() if d < depth)
        if total and (lost + 3) / total <= 1 - recall:
            return depth
    return least


def least_agreement(threshold: float) -> float:
    """The share of COMPARED values in which a pair at the threshold agrees, less its error."""
    p = threshold + (1 - threshold) / 256
    return p - ERRORS * float(np.sqrt(p * (1 - p) / COMPARED))


def compared(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with may: whether their signatures are near enough for a link."""
    some = words.select("rep", F.slice("words", 1, COMPARED // OWN).alias("s"))
    both = pairs.join(some.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(some.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (values_of(batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1) >= least if batch.num_rows else [], pa.bool_())], names=["a", "b", "may"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, may boolean")


def near_in_groups(entries: DataFrame, keys: list[str], words: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all pairs of a prefix, of GROUP classes at most, whose signatures are near enough."""
    rows = entries.join(words.select("rep", F.slice("words", 1, COMPARED // OWN).alias("s")), "rep").select(*keys, "rep", "s")
    runs = rows.repartition(*keys).sortWithinPartitions(*keys, "rep")
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            ids = table.column("rep").to_numpy()
            values = values_of(table.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            may = np.zeros((len(ids), len(ids)), bool)
            for i in range(0, len(ids), 32):
                may[i : i + 32] = (values[i : i + 32, None] == values[None]).mean(axis=2) >= least
            one = np.ones(len(ids))
            found, _, root = summarise_links(may, ids, ids, one, one, True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return runs.mapInArrow(run, "a bigint, b bigint").filter("a <> b")


def candidate_links(words: DataFrame, depth_of, threshold: float, least: int) -> DataFrame:
    """(a, b): links whose components hold every pair that meets in the forest and may be a link.

    words: rep and its signature. depth_of: from the pairs that meet at the least depth, the depth to match at.
    """
    trees = F.size("words")
    spread = words.select("rep", "words", F.posexplode("words").alias("tree", "w"))
    entries = spread.select("tree", "rep", "w", F.get("words", F.pmod(F.col("tree") + 1, trees)).alias("w2"))
    found = checkpoint(met(entries, least))
    pairs = checkpoint(stars(found))
    depth = depth_of(pairs)
    if depth > least:
        found = checkpoint(met(found.select("tree", "rep", "w", "w2"), depth))
        pairs = checkpoint(stars(found))
    keys = on_prefix(entries, depth)[1]
    judged = checkpoint(compared(pairs, words, threshold))
    far = judged.filter("not may").select(F.col("a").alias("rep"), F.col("b").alias("head"))
    doubted = found.filter(F.col("n") <= GROUP).join(far, ["rep", "head"], "left_semi").select(*keys).distinct()
    near = near_in_groups(found.filter(F.col("n") <= GROUP).join(checkpoint(doubted), keys, "left_semi"), keys, words, threshold)
    large = stars(found.filter(F.col("n") > GROUP))
    return judged.filter("may").select("a", "b").unionAll(near).unionAll(large).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs (rep, set1, set2, ..., text) with the text replaced by its shingles, packed as bytes: a row for each rep, of a text that has its set.

    Texts were looked up by an id, which others may share.
    """
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names), "shingles binary"])
    at = [names.index(c) for c in ("set1", "set2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(len(names)).to_pylist()]
            own = [set_digest(s) == want for s, want in zip(found, zip(*(batch.column(i).to_pylist() for i in at)))]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([s.tobytes() for s in found], pa.binary())], names=[*names, "shingles"])
            yield out.filter(pa.array(own, pa.bool_()))

    return docs.select(*names, "text").mapInArrow(run, schema).dropDuplicates(["rep"])


def overlaps(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Sizes of the intersections of the first n sets with the others (with each other, if there are no others)."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    counts = np.diff(np.r_[starts, values.size])
    same = n == len(sets)
    out = np.zeros((n, n if same else len(sets) - n), np.float32)
    shared = counts > 1
    column = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), counts)
    # what only one set holds is in no intersection
    owner, column = owner[column >= 0], column[column >= 0]
    total = int(shared.sum())
    for a in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, total - a)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        out += dense[:n] @ (dense if same else dense[n:]).T
    return out


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root) from members (comp, rep, copies, size, shingles): all pairs of a component, block by block."""
    slim = number_rows(members.select("comp", "rep", "copies", "size"), "comp", "size", "rep")
    # the running weight over all rows, cut at every width of the component, gives blocks; one that components share is one block in each
    weights = slim.groupBy("part").agg(F.sum(F.greatest("size", F.lit(SMALLEST))).alias("w"))
    before = weights.select("part", (F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("before"))
    running = F.sum(F.greatest("size", F.lit(SMALLEST))).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    width = F.least(F.lit(WEIGHT), F.greatest(F.lit(LEAST), F.expr(f"whole div {PARTS}")))
    widths = slim.groupBy("comp").agg(F.sum(F.greatest("size", F.lit(SMALLEST))).alias("whole")).select("comp", width.alias("width"))
    placed = slim.withColumn("running", F.coalesce(running, F.lit(0))).join(before, "part").join(widths, "comp").withColumn("block", F.expr("(running + before) div width"))
    placed = checkpoint(placed.select("comp", "rep", "copies", "size", "block"))
    blocks = checkpoint(placed.groupBy("comp", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi")))
    other = blocks.select("comp", F.col("block").alias("b"), F.col("lo").alias("b_lo"))
    work = blocks.join(other, "comp").filter((F.col("block") <= F.col("b")) & (F.col("hi") >= F.floor(F.col("b_lo") * threshold)))
    sides = work.select("comp", F.col("block").alias("a"), "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).filter("side = 0 or a <> b")
    sides = checkpoint(sides.withColumn("block", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))))
    rows = placed.drop("size").join(sides, ["comp", "block"]).join(members.select("rep", "shingles"), "rep")
    # every component and pair of blocks is one run of bounded weight
    runs = rows.repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for table in groups(batches, ["comp", "a", "b"]):
            sides_ = table.column("side").to_numpy()
            ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            sets = [np.frombuffer(x, _U) for chunk in table.column("shingles").chunks for x in (s.as_buffer() for s in chunk)]
            same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
            n = len(sets) if same else int((sides_ == 0).sum())
            sizes = np.array([len(s) for s in sets], np.float64)
            common = overlaps(sets, n)
            rest = slice(0, n) if same else slice(n, None)
            union = sizes[:n, None] + sizes[rest][None, :] - common
            linked = common >= threshold * union - 1e-6
            found = summarise_links(linked, ids[:n], ids[rest], copies[:n], copies[rest], same)
            held.append(found)
            if len(held) >= 512:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in range(3)], names=["rep", "links", "root"])

    return runs.mapInArrow(run, "rep bigint, links bigint, root bigint")


def classified(docs: DataFrame, key: str, text: str, threshold: float, trees: int, recall: float) -> DataFrame:
    """(id, mark, class, class_id, n_links) of each row of docs; class numbers the classes, and is null for rows that link with nothing by definition.

    Classes and what they are made of go by numbers of their own, as ids may repeat; the smallest ids are looked up at the end.
    """
    least = prefix_depth(threshold, trees, recall)
    signed = checkpoint(signatures(docs, key, text, trees))
    worded = signed.filter("size > 0")
    first = worded.groupBy("set1", "set2", "size").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("least is not null")
    classes = checkpoint(first.withColumn("rep", F.monotonically_increasing_id()))
    # one row of each class: ids may repeat
    named = worded.select("set1", "set2", F.col("id").alias("least"), "words").join(classes.select("set1", "set2", "least", "rep"), ["set1", "set2", "least"])
    words = checkpoint(named.dropDuplicates(["rep"]).select("rep", "words"))

    def depth_of(pairs: DataFrame) -> int:
        return matched_depth(link_depths(docs, key, text, classes, words, pairs, threshold), least, recall)

    components = checkpoint(connected_components(candidate_links(words, depth_of, threshold, least)))
    chosen = components.select(F.col("node").alias("rep"), F.col("component").alias("comp")).join(classes, "rep")
    texts = docs.select(F.col(key).cast("bigint").alias("least"), F.col(text).alias("text"))
    sets = shingle_sets(texts.join(chosen, "least").select("comp", "rep", "copies", "size", "set1", "set2", "text"))
    members = checkpoint(sets.select("comp", "rep", "copies", "size", "shingles"))
    known = checkpoint(least_of_each(linked_members(classes, verify(members, threshold)), classes.select("rep", "least", "set1", "set2")))
    joined = worded.select("id", "mark", "set1", "set2").join(known, ["set1", "set2"], "left")
    alone = signed.filter("size = 0").select("id", "mark", F.lit(None).cast("bigint").alias("class"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return joined.select("id", "mark", F.col("component").alias("class"), F.col("least").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")).unionAll(alone)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """key, class_id and n_links of each row of docs.

    Links are pairs of documents whose similarity is at least the threshold; a class is what links connect, named by its smallest id.
    """
    return classified(docs, key, text, threshold, trees, recall).select(F.col("id").alias(key), "class_id", "n_links")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """docs with one document of each class: that of the smallest id, and of several texts of that id one; rows that share both stay together."""
    found = checkpoint(classified(docs, key, text, threshold, trees, recall))
    first = found.filter("class is not null and id is not null").groupBy("class").agg(F.min(F.struct("id", "mark")).alias("first")).select("first.id", "first.mark")
    keep = first.unionAll(found.filter("class is null").select("id", "mark").distinct()).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    return docs.join(keep, docs[key].cast("bigint").eqNullSafe(keep["_id"]) & (mark(text) == keep["_mark"]), "left_semi")


#: The same rows in DuckDB's SQL: every pair that shares a shingle is compared.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, l.class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN least l ON l.node = d.doc_id LEFT JOIN counts c ON c.a = d.doc_id
"""
