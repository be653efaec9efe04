"""Operator 6: exact n-gram Jaccard join by PartEnum signatures.

Sets of 5-word shingles link when 100 * |A & B| >= 80 * |A | B|, which bounds the size of their symmetric
difference by H = (|A| + |B|) / 9. Sizes are dealt into bands [2^i, 2^(i+1)); an instance of the join serves one
band as the smaller side and sets up to 1.25 times its top as the larger one, so a set joins in two instances at
most. An instance partitions the domain of shingles by hash, and each set enumerates the partitions in order and
signs the non-empty ones until it has signed h + 1 of them, h its largest possible H. Of the partitions up to the
place where the first of two similar sets stops, that one has signed h + 1 and at most h differ, so one signature
is shared: no link is lost. Empty partitions are never signed. A set with too few non-empty partitions signs all
it has, and its prefix in hash order besides; two such sets share a prefix element, and with any other set the
other one's signatures suffice.

Shingles found often in a sample (repeated passages, degenerate repeats) are left out of the signed domain, behind a sieve of
them: any choice of them keeps the argument, as leaving elements out shrinks differences, so the sample steers cost only.

Two sets of up to GROUP that share a signature become an edge of candidate blocks if their parity sketches (bit i: whether an odd number of
elements have the hash i) differ in H bits at most. Sketches differ in no more bits than sets in elements, so no link is lost; sets that
share passages only seldom pass, so blocks don't grow together as the corpus does. Larger groups become stars. Blocks hold each set once. A block is cut into chunks
of about CHUNK shingles, and a chunk is joined in one task by rarest-first prefixes over its own frequencies, which gives its
components. A block of one chunk, the usual case, is done then. Of a larger one the leaders of the chunks' largest components are joined in the same
way, so a group of near copies of any size becomes one component at the cost of one pass over it. What stays outside the
block's largest component then is compared with it and with itself, in pairs of chunks of BLOCK shingles at most, which
skip pairs known to be connected: every pair of a block is in one component or was compared.
Members travel to their blocks as texts, which shuffle files compress, and the task that has a block makes its sets; texts that are no
member's stay where they are, behind a sieve of the members' ids.

Defined cases: null text, empty text and text of white space have the empty set and link with nothing; a null
doc_id has a null component; rows that repeat a doc_id, null ones too, count as one document (the one with the larger set
stands for it if their texts differ); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Packer, bucket_count, by_bucket, runs, unpack
from .graph import Forest, components, spanning
from .lean import lean
from .sieve import Sieve, sieve_of
from .store import drop, drop_path, fresh, written
from .words import SHINGLE, mix, set_digest, shingles, signed, text_buffers, words_of

#: Shingles in a chunk of a block, and at most in each of the two chunks of a pair.
CHUNK, BLOCK = 30_000, 2_000_000
#: The sample that finds frequent shingles takes about this many documents, one in SAMPLE_EVERY at least; a shingle is frequent with so many in it.
SAMPLE_DOCS, SAMPLE_EVERY, SAMPLE_FREQUENT = 20_000, 8, 4
#: Sets of a signature whose pairs are held against each other by their sketches; more sets become a star.
GROUP = 64


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a batch with a text column."""
    offsets, data = text_buffers(batch.column(batch.schema.get_field_index("text")))
    for i, j, at, _, _, h in words_of(offsets, data):
        for r in range(i, j):
            a, b = at[r - i], at[r - i + 1]
            yield r, np.unique(shingles(h[a:b], n))


def _ids(batch: pa.RecordBatch, name: str = "doc_id") -> list[int | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def document_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bits): set size, 128-bit digest and sketch of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, d1, d2, bits = [], [], [], []
            for _, s in _sets(batch, n):
                a, b = set_digest(s)
                size.append(len(s))
                d1.append(signed(a))
                d2.append(signed(b))
                bits.append(sketch(s))
            own = [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (size, d1, d2)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_shingles", "d1", "d2", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, d1 long, d2 long, bits binary")


def sketch(s: np.ndarray) -> bytes:
    """The parities of a set's elements by their last bits, at least a bit for each element; a power of two, so halves fold."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: int, x: bytes, b: int, y: bytes) -> bool:
    """Whether sets of a and b elements with sketches x and y may differ in (a + b) / 9 elements at most."""
    p, q, m, k = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    if m < k:
        p, q, m, k = q, p, k, m
    while m > k:
        m //= 2
        p = (p >> m) ^ (p & ((1 << m) - 1))
    return 9 * max(abs(a - b), (p ^ q).bit_count()) <= a + b


def frequent_shingles(docs: DataFrame, n_docs: int, n: int = SHINGLE) -> tuple[str, int]:
    """The sieve of the hashes of shingles that SAMPLE_FREQUENT documents of the sample hold."""
    every = max(1, min(SAMPLE_EVERY, round(n_docs / SAMPLE_DOCS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(["s"], buckets)
        for batch in batches:
            for _, s in _sets(batch, n):
                yield from pack.add(s)
        yield from pack.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            v, c = np.unique(unpack(rows, "s", "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v[c >= SAMPLE_FREQUENT].view(np.int64))], names=["h"])

    buckets = bucket_count(docs)
    part = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & F.col("text").isNotNull()).select("text")
    found = written(by_bucket(part.mapInArrow(lean(run), "bucket int, s binary")).mapInArrow(lean(count), "h long"), "frequent")
    own = sieve_of(found, found.count())
    drop(found)
    return own


def _instances(s: int) -> list[tuple[int, int, int]]:
    """(instance, its number of partitions, h) of the instances in which a set of s joins: h is a ninth of s and its largest partner's
    size there. With s < 4 only equal sets link."""
    if s < 4:
        return []
    i = s.bit_length() - 1
    out = [(i, 2 * s + s // 4)]
    if s <= ((1 << i) - 1) * 5 // 4:
        out.append((i - 1, s + min(s, (1 << i) - 1)))
    return [(k, int(0.62 * (1 << k)) + 6, total // 9) for k, total in out]


def signatures(s: np.ndarray, size: int) -> np.ndarray:
    """Signatures of a set of so many shingles in all, s those in the signed domain; see the module."""
    out, rest = [], False
    for k, parts, h in _instances(size):
        where = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # s is sorted, so this is too
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(s) else np.zeros(0, np.int64)
        rest |= len(cuts) < h + 1
        if len(cuts):
            held = np.add.reduceat(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), cuts)[: h + 1]
            out.append(mix(held ^ (where[cuts[: h + 1]] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((k + 1) << 56)))
    if rest:
        out.append(None)
    return out


def _prefix(s: np.ndarray) -> np.ndarray:
    return mix(s[: len(s) - (4 * len(s) + 4) // 5 + 1] ^ np.uint64(0x7FB5D329728EA185))


def candidate_edges(docs: DataFrame, frequent: tuple[str, int], sketches: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(u, v) of set digests that share a signature, reduced to 64 bits: the pairs that may link by their sketches(d1, n_shingles, bits), and a
    star for each group of more than GROUP. A digest without a sketch has no pair."""
    buckets = bucket_count(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen, often = Packer(["sig", "id"], buckets), set(), Sieve.of(*frequent)
        for batch in batches:
            for _, s in _sets(batch, n):
                if len(s) < 4:
                    continue
                d = set_digest(s)[0]
                if d in seen:
                    continue
                seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()
                for x in signatures(s[~often.passes(s)], len(s)):
                    x = _prefix(s) if x is None else x
                    yield from pack.add(x, np.full(len(x), d, np.uint64))
        yield from pack.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            sig, own = unpack(rows, "sig", "<u8"), unpack(rows, "id", "<u8")
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])] if len(sig) else np.zeros(0, bool)
            sig, own = sig[new], own[new]
            _, group, size = np.unique(sig, return_inverse=True, return_counts=True)
            large = size[group] > GROUP
            at = np.flatnonzero(large)[1:]
            at = at[group[at] == group[at - 1]]
            if len(at):
                u, v = spanning(own[at - 1], own[at])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.ones(len(u), bool))], names=["u", "v", "star"])
            some = (size[group] > 1) & ~large
            group, own, pairs = group[some], own[some], []
            for k in range(1, GROUP):
                at = np.flatnonzero(group[k:] == group[:-k])
                if not len(at):
                    break
                pairs.append(np.unique(np.stack([own[at], own[at + k]], 1), axis=0))
            if pairs:
                both = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.zeros(len(both), bool))], names=["u", "v", "star"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    signed_rows = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(lean(sign), "bucket int, sig binary, id binary")
    met = written(by_bucket(signed_rows).mapInArrow(lean(meet), "u long, v long, star boolean"), "pairs")
    sk = sketches.select("d1", "n_shingles", "bits")
    pairs = met.where("not star").select("u", "v").distinct()
    for end in "uv":
        pairs = pairs.join(sk.select(F.col("d1").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("bits").alias(f"b{end}")).hint("merge"), end)
    linked = pairs.select("u", "v", "nu", "bu", "nv", "bv").mapInArrow(lean(test), "u long, v long")
    out = written(linked.unionAll(met.where("star").select("u", "v")), "pairs")
    drop(met)
    return out


def similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= 80 * (a + b - common)


def join_block(sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the components of sets: every pair that links is connected by what is returned and by known, which has a
    label of each set that those of a component share.

    Sets are taken by size. One meets those before it that share one of its rarest elements (rarity within the
    block); of each component it first meets the oldest member, others only if that one isn't similar.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: (len(sets[i]), i))
    if n > 2:
        flat = np.concatenate(sets)
        values, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        once = int((counts == 1).sum())
        codes = rank[codes]
        cuts = np.cumsum([0, *map(len, sets)])
        own = [np.sort(codes[cuts[i] : cuts[i + 1]]) for i in range(n)]
    else:
        own, once = sets, 0
    forest, links = Forest(n), []
    if known is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(known):
            forest.union(first.setdefault(label, i), i)
    postings: dict[int, dict[int, list[int]]] = {}
    for x in order:
        s = own[x]
        a = len(s)
        if n > 2:
            head = s[: a - (4 * a + 4) // 5 + 1]
            head = head[np.searchsorted(head, once) :].tolist()  # elements of one set only meet nothing
        else:
            head = [0]
        tried: set[int] = set()
        for t in head:
            for root, members in list(postings.get(t, {}).items()):
                for y in members:
                    if y in tried or 5 * len(own[y]) < 4 * a:
                        continue
                    if forest.find(y) == forest.find(x):
                        break
                    tried.add(y)
                    lead = forest.find(y)
                    for z in (lead, y) if lead not in tried and 5 * len(own[lead]) >= 4 * a else (y,):
                        tried.add(z)
                        if similar(_common(s, own[z]), a, len(own[z])):
                            links.append((x, z))
                            forest.union(x, z)
                            break
        for t in head:
            at = postings.setdefault(t, {})
            at.setdefault(forest.find(x), []).append(x)
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _stars(entities: list[int], links: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(entity, least entity of its component, sets in it) of sets that each belong to an entity, for components of two entities or more."""
    forest, first = Forest(len(entities)), {}
    for i, e in enumerate(entities):
        forest.union(first.setdefault(e, i), i)
    for x, y in links:
        forest.union(x, y)
    groups: dict[int, list[int]] = {}
    for i in range(len(entities)):
        groups.setdefault(forest.find(i), []).append(i)
    for members in groups.values():
        own = {entities[i] for i in members}
        if len(own) > 1:
            least = min(own)
            yield from ((e, least, len(members)) for e in own)


def _held(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The set of each row of a batch, from bytes in held."""
    return [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(batch.schema.get_field_index("held"))]


def _solved(members: DataFrame, attach: Callable[[DataFrame], DataFrame], name: str, sets: Callable[[pa.RecordBatch], list[np.ndarray]] = _held) -> DataFrame:
    """(id, label, n), a written table: the components of each block of members(id, blocks), found by the task that has the block; label is
    the least id of a component, n its number of sets, and components of one aren't there. Where a block's name is followed by `|` and a
    label, members of one label are connected already, and labels stand for ids in the result."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["id", "label", "n"])

        for _, rows in runs(batches, "block"):
            ids: dict[int, np.ndarray] = {}
            labels: dict[int, int] = {}
            for r in rows:
                for d, s, label in zip(_ids(r, "id"), sets(r), _ids(r, "label"), strict=True):
                    labels[d] = d if label is None else label
                    if len(s) >= len(ids.get(d, ())):
                        ids[d] = s
            names = sorted(ids)
            entities = [labels[d] for d in names]
            out += _stars(entities, join_block([ids[d] for d in names], entities))
            if len(out) > 100_000:
                yield batch()
                out = []
        yield batch()

    parts = F.split("block", "[|]")
    held = attach(members).select("id", "held", parts[0].alias("block"), F.get(parts, F.lit(1)).cast("long").alias("label"))
    return written(held.repartition(bucket_count(held), "block").sortWithinPartitions("block").mapInArrow(lean(solve), "id long, label long, n long"), name)


def _name(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def linked(reps: DataFrame, attach: Callable[[DataFrame], DataFrame], sets: Callable[[pa.RecordBatch], list[np.ndarray]] = _held) -> DataFrame:
    """(node, component), a written table, of the ids of reps(id, component, size) that link within their block, a component of candidates.

    attach gives members(id, blocks) what they hold as (id, held, block), one row for each of a member's blocks; sets makes the sets of a
    batch of those rows, in the task that has the block. See the module for the steps.
    """
    sizes = reps.groupBy("component").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    reps = written(reps.join(sizes, "component").select("id", F.col("component").alias("block"), "size", "chunks", chunk.alias("chunk")), "blocks")
    one, text = F.hex("block"), (lambda c: c.cast("string"))
    solved = _solved(reps.select("id", F.array(_name(one, text(F.col("chunk")))).alias("blocks")), attach, "linked", sets)
    many = reps.where("chunks > 1")
    if not many.limit(1).count():
        drop(reps)
        return _as_components(solved)

    # the leaders of the chunks' largest components
    lead = solved.where("id = label").join(many, "id").groupBy("block", "chunk").agg(F.max(F.struct("n", (-F.col("id")).alias("o"), "size")).alias("x"))
    leaders = written(lead.select((-F.col("x.o")).alias("id"), F.col("block").alias("component"), "x.size"), "leaders")
    if leaders.groupBy("component").agg(F.sum("size").alias("s")).where(F.col("s") > BLOCK).limit(1).count():
        across = linked(leaders, attach, sets)
    else:
        across = _as_components(_solved(leaders.select("id", F.array(F.hex("component")).alias("blocks")), attach, "linked", sets))
    own = many.join(solved.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    marked = written(own.join(across.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component"), "labels")
    drop(leaders)
    drop(across)

    # what is outside a block's largest component, with it and with itself
    sums = marked.groupBy("block", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    main = sums.groupBy("block").agg(F.max(F.struct("n", (-F.col("label")).alias("o"), "s")).alias("x"), F.sum("s").alias("s")).select("block", (-F.col("x.o")).alias("main"), F.col("x.s").alias("in_main"), (F.col("s") - F.col("x.s")).alias("rest"))
    some = main.where("rest > 0").withColumn("r", F.ceil(F.col("rest") / BLOCK).cast("int")).withColumn("m", F.ceil(F.col("in_main") / F.least(F.lit(BLOCK), F.greatest(F.lit(CHUNK), "rest"))).cast("int"))
    some = written(some, "rests")
    final = marked
    if some.limit(1).count():
        x = marked.join(some, "block")
        at_r, at_m = F.pmod(F.xxhash64("id"), F.col("r")).cast("int"), F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
        rs, ms = F.sequence(F.lit(0), F.col("r") - 1), F.sequence(F.lit(0), F.col("m") - 1)
        with_rest = F.transform(rs, lambda k: _name(one, "r", text(F.least(k, at_r)), text(F.greatest(k, at_r))))
        with_main = F.transform(ms, lambda k: _name(one, "m", text(k), text(at_r)))
        of_main = F.transform(rs, lambda k: _name(one, "m", text(at_m), text(k)))
        blocks = F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(with_rest, with_main))
        late = _solved(x.select("id", F.transform(blocks, lambda b: F.concat_ws("|", b, text(F.col("label")))).alias("blocks")), attach, "linked", sets)
        if late.limit(1).count():
            joined = components(late.select(F.col("id").alias("u"), F.col("label").alias("v")))
            final = marked.join(joined.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label"))
        drop(late)
    rest = solved.join(many.select("id"), "id", "left_anti").select("id", "label").unionAll(final.select("id", "label"))
    out = _as_components(written(rest, "linked"))
    for t in (solved, marked, some, reps):
        drop(t)
    return out


def _as_components(solved: DataFrame) -> DataFrame:
    out = solved.select(F.col("id").alias("node"), F.col("label").alias("component"))
    out._keymoment_path = solved._keymoment_path
    return out


def jaccard_components(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text): see the module."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    meta = written(document_sets(docs, n).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "d1", "d2", "bits")).alias("x"), F.count("*").alias("times")).select("doc_id", "x.*", "times"), "sets")
    classes = meta.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"))
    frequent = frequent_shingles(docs, meta.count(), n)
    sketches = meta.where("n_shingles > 0").groupBy("d1").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    edges = candidate_edges(docs, frequent, sketches, n)
    blocks = components(edges)
    drop(edges)
    drop_path(docs.sparkSession, frequent[0])
    reps = classes.join(blocks, F.col("d1") == F.col("node")).select(F.col("rep").alias("id"), "component", "size")

    paths = []

    def attach(members: DataFrame) -> DataFrame:
        hashes = members.select(F.xxhash64("id").alias("h"))
        own = sieve_of(hashes, hashes.count())
        paths.append(own[0])

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sieve = Sieve.of(*own)
            for batch in batches:
                yield batch.filter(pa.array(sieve.passes(batch.column(2).to_numpy().view(np.uint64)))).drop_columns("h")

        some = docs.where("text is not null and doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(lean(wanted), "doc_id long, text string")
        return some.join(members.hint("merge"), some["doc_id"] == members["id"]).select("id", F.col("text").alias("held"), F.explode("blocks").alias("block"))

    def sets(batch: pa.RecordBatch) -> list[np.ndarray]:
        texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("held"))], names=["text"])
        return [s for _, s in _sets(texts, n)]

    found = linked(reps, attach, sets)
    for path in paths:
        drop_path(docs.sparkSession, path)
    drop(blocks)
    classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = meta.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_k"))
    return out.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; columns stay. Rows with a null doc_id stay."""
    own = fresh(docs, "gone")
    gone = jaccard_components(docs, n).where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
