"""Jaccard join of documents on word shingles, exact, by T-occurrence search.

1. Every shingle's document count is found without moving texts to it (``shared_keys``).
2. A document whose shared shingles are too few for any link ends here. Of the others, the rarest
   shingles are posted, so many that two linked documents must share one of them.
3. Documents that share a posted shingle and could be linked by their sizes are joined to candidate
   families (connected components; postings are reduced to a spanning forest where they meet).
4. Each family is searched (``overlap``). Small families share a task; a family of more than
   ``BLOCK`` sets is dealt to blocks by size class and hash, and only blocks of neighbouring size
   classes are searched against each other.
5. Links make the final components.

Equal sets are one set throughout: they are combined in each chunk before anything is sent.

Shingles and sets are compared by 64-bit hashes. Defined cases: a null or empty text, or one without
words, has an empty set, no links, and is its own component; a text of fewer words than a shingle is
one shingle; rows with the same ``doc_id`` are judged one by one and share a component where linked;
a null ``doc_id`` is never the smallest of a component that has another; empty tables give empty
ones. Only ``doc_id`` and ``text`` are read; results keep no other column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable
from cohort_spark.llm import bytes as B
from cohort_spark.llm import shared_keys as S
from cohort_spark.llm.components import components, local_roots
from cohort_spark.llm.overlap import PERCENT, Lists, required

WORDS = 5
# Sets of one search; larger families are dealt to blocks of this size.
BLOCK = 1000
# Members of small families that share a task.
TASK_SETS = 2000

_DOC, _POSTING, _SET = 0, 1, 2
_SENT = "kind int, bucket int, chunk int, doc_id bigint, tie bigint, sid bigint, n bigint, one binary, two binary, three binary"


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data = B.LOWER[data]
    starts, ends, first, mask = B.words(data, at, B.NOT_SPACE)
    word = B.hashes(data, mask, starts, ends)
    gram = B.grams(word, words)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= words:
            out.append(np.unique(gram[low : high - words + 1]))
        elif high > low:
            out.append(B.mix(B.grams(word[low:high], high - low) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_id(elements: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    mixed = B.mix(elements ^ B._C)
    total = np.uint64(np.bitwise_xor.reduce(mixed)) ^ (np.add.reduce(mixed * B._A) + np.uint64(len(elements)))
    return int(B.mix(np.array([total], np.uint64)).view(np.int64)[0])


class Chunk:
    """The different non-empty sets of one chunk, in an order that does not depend on arrival."""

    def __init__(self, table: pa.Table, buckets: int, words: int) -> None:
        table = table.combine_chunks()
        sets: list[np.ndarray] = []
        for batch in table.to_batches():
            for piece in B.pieces(batch, "text"):
                sets += shingle_sets(*B.raw(piece.column("text")), words)
        self.doc_id, self.tie = table["doc_id"], table["tie"]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.sid = np.array([_set_id(s) if len(s) else 0 for s in sets], np.int64)
        has = np.flatnonzero(self.n)
        self.sids, example = np.unique(self.sid[has], return_index=True)
        self.sets = [sets[i] for i in has[example].tolist()]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.keys = S.Keys(every, np.repeat(np.arange(len(self.sets)), self.sizes), buckets)


def _posted(chunk: Chunk, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets can be linked at all, and their rarest shared shingles with the set's place."""
    level = levels[chunk.keys.inverse]
    alive, tokens, owners = [], [], []
    at = 0
    for i, s in enumerate(chunk.sets):
        mine = level[at : at + len(s)]
        at += len(s)
        spare = len(s) - int(required(len(s), percent))
        alone = int(np.count_nonzero(mine < 2))
        if alone > spare:
            continue
        alive.append(i)
        order = np.lexsort((s, mine))[alone : spare + 1]
        tokens.append(s[order])
        owners.append(np.full(len(order), i))
    none = np.zeros(0, np.int64)
    if not alive:
        return none, np.zeros(0, np.uint64), none
    return np.array(alive), np.concatenate(tokens), np.concatenate(owners)


def _rows(columns: dict[str, list], rows: int, **values) -> None:
    for name, cells in columns.items():
        cells.extend(values.get(name, [None] * rows))


def _send(number: int, chunk: Chunk, levels: np.ndarray, buckets: int, percent: int) -> pa.Table:
    names = [c.split()[0] for c in _SENT.split(", ")]
    columns: dict[str, list] = {n: [] for n in names}
    docs = len(chunk.n)
    _rows(
        columns, docs, kind=[_DOC] * docs, chunk=[number] * docs, doc_id=chunk.doc_id.to_pylist(),
        tie=chunk.tie.to_pylist(), sid=chunk.sid.tolist(), n=chunk.n.tolist(),
    )
    alive, token, owner = _posted(chunk, levels, percent)
    _rows(
        columns, len(alive), kind=[_SET] * len(alive), chunk=[number] * len(alive), sid=chunk.sids[alive].tolist(),
        n=chunk.sizes[alive].tolist(), one=[chunk.sets[i].tobytes() for i in alive.tolist()],
    )
    bucket = (token % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut)).tolist()
    parts = [order[cut[b] : cut[b + 1]] for b in used]
    _rows(
        columns, len(used), kind=[_POSTING] * len(used), bucket=used, chunk=[number] * len(used),
        one=[token[p].tobytes() for p in parts], two=[chunk.sids[owner[p]].tobytes() for p in parts],
        three=[chunk.sizes[owner[p]].astype(np.uint32).tobytes() for p in parts],
    )
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int32(), "one": pa.binary(), "two": pa.binary(), "three": pa.binary()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in columns.items()})


def sets_and_postings(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, plan: S.Layout | None = None) -> DataFrame:
    """Documents with their set's name, sets that can be linked, and postings; stored."""
    plan = plan or S.layout(docs)
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie")
    ).withColumn("chunk", S.chunk_of(plan))

    def name(key: tuple, table: pa.Table) -> pa.Table:
        return Chunk(table, plan.buckets, words).keys.sent(key[0].as_py())

    def send(key: tuple, table: pa.Table, levels: pa.Table) -> pa.Table:
        chunk = Chunk(table, plan.buckets, words)
        known = [S.unpack(x, "<u2") for x in levels["levels"].to_pylist()]
        level = chunk.keys.spread(levels["bucket"].to_pylist(), known, 0)
        return _send(key[0].as_py(), chunk, level, plan.buckets, percent)

    by_chunk = dealt.groupBy("chunk")
    levels = S.levels(by_chunk.applyInArrow(name, S.SENT))
    return durable(by_chunk.cogroup(levels.groupBy("chunk")).applyInArrow(send, _SENT))


def _forest(percent: int):
    """Spanning edges of sets that share a posted shingle and could be linked by their sizes."""

    def join(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        token, sid, n = whole("one", np.uint64), whole("two", np.int64), whole("three", np.uint32).astype(np.int64)
        order = np.lexsort((sid, n, token))
        token, sid, n = token[order], sid[order], n[order]
        near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (sid[1:] != sid[:-1])
        nodes, code = np.unique(sid, return_inverse=True)
        root = local_roots(code[1:][near], code[:-1][near], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": nodes[moved], "b": nodes[root[moved]]})

    return join


def _size_class(n: str = "n", percent: int = PERCENT):
    """Linked sets are in the same or neighbouring classes."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / percent) * 1.0000001)).cast("int")


def _tasks(members: DataFrame, *, block: int, task_sets: int, percent: int) -> DataFrame:
    """``sid, task, side``: where each set is searched; side 0 both ways, 1 and 2 against each other.

    Each set of a family in blocks goes to its own block and to the pairings of its block with every
    block of its size class and of the two next to it.
    """
    classed = members.withColumn("class", _size_class(percent=percent))
    families = members.groupBy("family").agg(F.count("*").alias("whole"))
    sized = classed.groupBy("family", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    slots = max(1, -(-members.count() // task_sets))
    large = durable(families.where(F.col("whole") > block).select(F.col("family").alias("big")))
    small = classed.join(large, classed["family"] == large["big"], "left_anti").select(
        "sid", "family", F.pmod(F.xxhash64("family"), F.lit(slots)).cast("string").alias("task"), F.lit(0).alias("side")
    )
    mine = classed.join(large, classed["family"] == large["big"], "left_semi")
    other = sized.select(F.col("family").alias("f"), F.col("class").alias("c"), F.col("blocks"))
    own = sized.select(F.col("family").alias("of"), F.col("class").alias("oc"), F.col("blocks").alias("own_blocks"))
    placed = mine.join(own, (F.col("family") == F.col("of")) & (F.col("class") == F.col("oc")))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("sid"), F.col("own_blocks")).cast("int"))
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("near")
    paired = placed.select("sid", "family", "class", "b", near)
    paired = paired.join(other, (F.col("family") == F.col("f")) & (F.col("near") == F.col("c")))
    paired = paired.select("sid", "family", "class", "b", "near", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    me, them = F.struct(F.col("class").alias("x"), F.col("b").alias("y")), F.struct(F.col("near").alias("x"), F.col("j").alias("y"))
    task = F.concat_ws(
        "/", "family", F.least(me, them)["x"], F.least(me, them)["y"], F.greatest(me, them)["x"], F.greatest(me, them)["y"]
    )
    side = F.when(me == them, 0).when(me < them, 1).otherwise(2)
    return small.union(paired.select("sid", "family", task.alias("task"), side.alias("side")))


def _search(percent: int):
    """Links within each family of a task."""

    def search(table: pa.Table) -> pa.Table:
        family = table["family"].to_numpy()
        sid, side, copies, n = (table[c].to_numpy() for c in ("sid", "side", "copies", "n"))
        elements = table["one"].to_pylist()
        order = np.lexsort((sid, n, family))
        links = np.zeros(len(sid), np.int64)
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            for a, b in _links([np.frombuffer(elements[m], np.uint64) for m in members.tolist()], side[members], percent):
                low.append(members[a])
                high.append(members[b])
        a, b = np.concatenate(low), np.concatenate(high)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = local_roots(a, b, len(sid))
        some = np.flatnonzero(links)
        return pa.table({"sid": sid[some], "root": sid[root[some]], "links": links[some]})

    return search


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of linked sets, each once: all of side 0, or one of side 1 with one of side 2."""
    sizes = np.array([len(s) for s in sets], np.int64)
    inside = np.flatnonzero(side != 1)
    asked = np.flatnonzero(side != 2)
    if not len(inside) or not len(asked):
        return
    lists = Lists(np.concatenate([sets[i] for i in inside.tolist()]), sizes[inside])
    both = bool((side == 0).any())
    for at, q in enumerate(asked.tolist()):
        found = lists.partners(sets[q], at + 1 if both else 0, percent)
        if len(found):
            yield np.full(len(found), q), inside[found]


def join_similar(
    docs: DataFrame,
    *,
    words: int = WORDS,
    percent: int = PERCENT,
    block: int = BLOCK,
    task_sets: int = TASK_SETS,
    plan: S.Layout | None = None,
) -> DataFrame:
    """``doc_id, tie, root, n_shingles, component_id, n_links`` for every row.

    ``tie`` hashes the text, ``root`` names the component also where it has no ``doc_id``.
    """
    sent = sets_and_postings(docs, words=words, percent=percent, plan=plan)
    rows = sent.where(F.col("kind") == _DOC).select("doc_id", "tie", "sid", "n")
    forest = (
        sent.where(F.col("kind") == _POSTING)
        .select("bucket", "one", "two", "three")
        .groupBy("bucket")
        .applyInArrow(_forest(percent), "a bigint, b bigint")
    )
    families = components(forest)
    copies = rows.where("n > 0").groupBy("sid").agg(F.count("*").alias("copies"))
    sets = sent.where(F.col("kind") == _SET).groupBy("sid").agg(F.min("chunk").alias("chunk"), F.first("n").alias("n"))
    members = durable(
        families.select(F.col("node").alias("sid"), F.col("root").alias("family"))
        .join(sets, "sid").join(copies, "sid")
    )
    tasks = _tasks(members.select("sid", "family", "n"), block=block, task_sets=task_sets, percent=percent)
    placed = tasks.join(members.select("sid", "chunk", "n", "copies"), "sid")
    elements = sent.where(F.col("kind") == _SET).select("sid", "chunk", "one")
    links = durable(
        placed.join(elements, ["sid", "chunk"])
        .select("task", "family", "sid", "side", "copies", "n", "one")
        .groupBy("task")
        .applyInArrow(_search(percent), "sid bigint, root bigint, links bigint")
    )
    roots = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy(F.col("sid").alias("l_sid")).agg(F.sum("links").alias("links"))
    labelled = (
        rows.where("n > 0")
        .join(roots.select(F.col("node").alias("r_sid"), "root"), F.col("sid") == F.col("r_sid"), "left")
        .withColumn("root", F.coalesce("root", "sid"))
    )
    smallest = labelled.groupBy(F.col("root").alias("s_root")).agg(F.min("doc_id").alias("component_id"))
    with_links = (
        labelled.join(smallest, F.col("root") == F.col("s_root"))
        .join(copies.withColumnRenamed("sid", "c_sid"), F.col("sid") == F.col("c_sid"))
        .join(counted, F.col("sid") == F.col("l_sid"), "left")
    )
    found = with_links.select(
        "doc_id", "tie", "root", F.col("n").alias("n_shingles"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
    )
    empty = rows.where("n = 0").select(
        "doc_id", "tie", F.col("sid").alias("root"), F.col("n").alias("n_shingles"),
        F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"),
    )
    return found.union(empty)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, under any name: of each component the row of its smallest ``doc_id``.

    Of rows with one ``doc_id`` and one text, one stays. Rows without words are linked with nothing, so
    all of them stay, repeated ones too.
    """
    joined = durable(join_similar(docs.select("doc_id", "text"), **options))
    best = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))
    linked = joined.where("n_shingles > 0").groupBy("root").agg(F.min(best).alias("k"))
    kept = linked.select(F.col("k.doc_id").alias("kept_id"), F.col("k.tie").alias("kept_tie"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).select(row, F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_tie"))
    on = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_tie") == F.col("kept_tie"))
    chosen = keyed.join(kept.distinct(), on).dropDuplicates(["own_id", "own_tie"]).select("row.*")
    return chosen.unionByName(docs.where(~worded))
