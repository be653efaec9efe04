"""Jaccard join, substring dedup, decontamination: against brute force and hand-made cases."""

from __future__ import annotations

import random
import time
import tracemalloc
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keymoment.llm import decontaminate, graph, jaccard_join, passages, store, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, share: float, rng: random.Random) -> str:
    w = text.split(" ")
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def shingle_set(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t) for i, t in texts}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed: int, n: int = 60):
    """Documents of sizes from a word to some hundreds, with copies, near copies on both sides of 0.8, and a shared passage."""
    rng = random.Random(seed)
    passage = prose(60, rng)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            t = prose(rng.choice([1, 3, 4, 5, 6, 9, 14, 30, 80, 200, 400]), rng)
        elif kind == 1:
            t = rng.choice(texts)[1]
        elif kind in (2, 3):
            t = edited(rng.choice(texts)[1], rng.choice([0.005, 0.01, 0.02, 0.03, 0.04]), rng)
        elif kind == 4:
            t = prose(rng.choice([20, 40, 90]), rng) + "\n" + passage + " " + prose(10, rng)
        else:
            t = " ".join([rng.choice(VOCABULARY)] * rng.choice([4, 60, 200]))
        texts.append((i * 3, t))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components_are_exact(spark, seed):
    texts = [*corpus(seed), (1000, None), (1001, ""), (1002, " \n\t "), (1003, "One TWO"), (1004, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts)
    assert got[1000] == (0, 1000) and got[1001] == (0, 1001) and got[1004] == (1, 1003)


def test_jaccard_odd_rows(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x" * 300_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 1, 3)], key=repr)
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    kept = jaccard_join.one_of_each(frame(spark, texts).withColumn("component_id", F.lit(0)))
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([1, 1, None, 3], key=repr)


@pytest.mark.parametrize("seed, chunk, block", [(9, 100, 400), (10, 300, 600), (11, 1000, 1000)])
def test_blocks_cut_into_chunks(spark, monkeypatch, seed, chunk, block):
    """Blocks of many chunks: a group of near copies, drifting families on both sides of 0.8, and what candidates chain to them."""
    rng = random.Random(seed)
    base, texts = prose(120, rng), corpus(seed, 24)
    for i in range(40):
        near = edited(base, 0.01, rng) if i % 2 else edited(texts[-1][1] if i > 4 else base, rng.choice([0.01, 0.03, 0.04]), rng)
        texts.append((1000 + i, near))
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("size", [4, 9, 31, 64, 127, 128, 200, 700])
def test_similar_sets_share_a_signature(size):
    """The guarantee itself, at the largest difference that still links, with and without a reduced domain."""
    rng = np.random.default_rng(size)
    for trial in range(60):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        h = 2 * len(a) // 9
        x = int(rng.integers(0, h // 2 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - x]], rng.integers(0, 2**64, max(0, min(x, h - x)), dtype=np.uint64)]))
        if not jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        frequent = a[: len(a) // 3] if trial % 2 else a[:0]
        sigs = []
        for s in (a, b):
            own = s[~np.isin(s, frequent)]
            sigs.append({int(v) for y in jaccard_join.signatures(own, len(s)) for v in (jaccard_join._prefix(s) if y is None else y)})
        assert sigs[0] & sigs[1] or np.array_equal(a, b)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    """Hubs as smallest and as largest node, with a tail each, against union-find."""
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 60)] + [(5000, i) for i in range(1000, 1060)] + [(59, 300), (300, 301), (1059, 2000)] + [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(60)]
    rng.shuffle(edges)
    up = graph.Forest(7000)
    for u, v in edges:
        up.union(u, v)
    want = {x: up.find(x) for e in edges if e[0] != e[1] for x in e}
    monkeypatch.setattr(graph, "HUBS", 20)
    for hub in (3, 30, 10**6):
        got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3), hub).collect()
        assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_word_hashes_depend_on_words_only(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng.choice([0, 1, 50, 700]), rng).replace(" ", rng.choice([" ", "\n", "  "])) for _ in range(20)] + ["é É", None]

    def hashes():
        out = []
        offsets, data = words.text_buffers(pa.array(texts))
        for _, _, at, s, e, h in words.words_of(offsets, data):
            out += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    one = hashes()
    monkeypatch.setattr(words, "PIECE", 64)
    assert hashes() == one
    assert [len(x) for x in one] == [len((t or "").split()) for t in texts]
    assert one[20][0] != one[20][1]  # only A-Z are folded


# --- passages


def test_passages_in_the_middle_of_lines(spark):
    rng = random.Random(3)
    passage = prose(64, rng)
    texts = [(i, f"{prose(70, rng)} {passage} {prose(50, rng)}\n{prose(30, rng)}") for i in range(40)] + [(100 + i, prose(150, rng)) for i in range(40)]
    docs = frame(spark, texts)
    rows = passages.repeated_passages(docs).collect()
    hit = {r["doc_id"] for r in rows}
    assert hit <= set(range(1, 40)) and len(hit) >= 38
    assert all(r["also_in"] < r["doc_id"] and r["also_in"] < 40 for r in rows)
    raw = dict(texts)
    for r in rows:
        assert raw[r["doc_id"]][r["start"] : r["end"]] in passage or passage in raw[r["doc_id"]][r["start"] : r["end"]]
    out = {r["doc_id"]: r for r in passages.remove_passages(docs).collect()}
    assert len(out) == 80 and all(out[100 + i]["text"] == raw[100 + i] for i in range(40)) and out[0]["text"] == raw[0]
    assert sum(passage in out[i]["text"] for i in range(40)) <= 2
    assert all(out[i]["n_chars"] == len(out[i]["text"]) for i in out)


def test_similar_lines_and_copies(spark):
    rng = random.Random(4)
    line = prose(90, rng)
    near = line.split()
    near[45] = "zzz"
    docs = frame(spark, [(1, f"{prose(40, rng)}\n{line}\n{prose(40, rng)}"), (2, f"{prose(40, rng)}\n{' '.join(near)}\n{prose(40, rng)}"), (3, line), (4, prose(60, rng) + "\n" + "short line here"), (5, "short line here")])
    got = {r["doc_id"] for r in passages.repeated_passages(docs).collect()}
    assert got == {2, 3}
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert 3 not in left and "zzz" not in left[2] and line in left[1]


def test_passages_odd_rows(spark):
    rng = random.Random(6)
    t = prose(80, rng)
    docs = frame(spark, [(None, t), (1, None), (2, ""), (3, t), (3, t), (4, "é " * 50), (5, "the " * 300), (6, "the " * 200)])
    rows = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in rows} <= {6}
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    assert passages.remove_passages(frame(spark, [])).count() == 0
    assert passages.bands(0.8, 0.99, 3) == 7
    clash = docs.where("doc_id > 2").withColumns({n: F.lit(n) for n in ("_cuts", "cuts", "_cut_id", "CUT_ID", "gone", "_gone", "names", "doc")})
    for step in (passages.remove_passages, jaccard_join.one_of_each):
        left = step(clash)
        assert left.columns == clash.columns and {r["gone"] for r in left.collect()} == {"gone"}


def test_repetitive_passages_in_the_middle_of_lines(spark):
    rng = random.Random(11)
    cycles = (["to.", "ndti"], ["by"], ["by"] * 3 + ["he"] * 3, ["a", "b", "a"], ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"])
    for n in (passages.MIN_RUN + passages.REACH - 1, 60):
        shared = [" ".join((c * 60)[:n]) for c in cycles] + [prose(n, rng) for _ in range(20)]
        texts = [(2 * i + j, f"{prose(40, rng)} {x} {prose(40, rng)}") for i, x in enumerate(shared) for j in range(2)]
        assert {r["doc_id"]: r["also_in"] for r in passages.repeated_passages(frame(spark, texts)).collect()} == {i: i - 1 for i, _ in texts if i % 2}


def repeat_tasks(docs, monkeypatch) -> list:
    """The two tasks of exact_repeats, to be run here."""
    tasks, kind = [], type(docs)
    real = kind.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, f, schema, *a, **b: tasks.append(f) or real(self, f, schema, *a, **b))
        passages.exact_repeats(docs)
    return tasks


def test_memory_of_tasks_that_find_repeats(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vocabulary = np.array([w[:3] for w in VOCABULARY])
    texts = [" ".join(vocabulary[rng.integers(0, len(vocabulary), 600)]) for _ in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10_000), pa.int64()), "text": pa.array(texts)})
    cut, meet = repeat_tasks(frame(spark, []), monkeypatch)
    words.powers(words.PIECE + 1024)
    tracemalloc.start()
    try:
        before, largest, packed = tracemalloc.get_traced_memory()[0], 0, []
        for x in cut(iter([batch])):
            largest = max(largest, x.nbytes)
            if len(packed) < 4:
                packed.append(x)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert sum(x.num_rows for x in packed) and largest < 16_000_000 and peak < 130_000_000, (largest, peak)


def test_repeats_settled_in_small_steps(spark, monkeypatch):
    rng = random.Random(14)
    shared = [prose(30, rng) for _ in range(5)]
    texts = [f"{prose(rng.randrange(60), rng)} {rng.choice(shared)} {prose(40, rng)}\n{rng.choice(shared)}" for _ in range(60)]
    cut, meet = repeat_tasks(frame(spark, []), monkeypatch)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(a, a + 20), pa.int64()), "text": pa.array(texts[a : a + 20])}) for a in (40, 0, 20)]
    monkeypatch.setattr(words, "PIECE", 2000)  # groups of a few documents
    found = []
    for settle, pack in ((1 << 19, 1 << 18), (30, 8), (1, 4)):
        monkeypatch.setattr(passages, "SETTLE", settle)
        monkeypatch.setattr(passages, "PACK", pack)
        packed = pa.Table.from_batches(cut(iter(batches))).sort_by("bucket").to_batches()
        rows = list(meet(iter(packed)))
        spans = passages._joined(*(passages.unpack(rows, n, t) for n, t in passages._FIELDS[1:]))
        found.append({(d, a, n) for d, a, n in zip(*(spans[k].tolist() for k in (0, 2, 3)), strict=True)})
        for d, a, low in zip(*(spans[k].tolist() for k in (0, 2, 5)), strict=True):
            assert low < d and " ".join(texts[d][a:].split()[:20]) in " ".join(texts[low].split())
    assert found[0] and found[1] == found[0] and found[2] == found[0]
    first = {x: min(i for i, t in enumerate(texts) if x in t) for x in shared}
    for d, t in enumerate(texts):
        for x in shared:
            if x in t and d != first[x]:
                at = t.index(x)
                assert sum(max(0, min(at + len(x), a + n) - max(at, a)) for e, a, n in found[0] if e == d) > len(x) // 2


def test_marks_against_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        docs = [np.array([rng.randrange(rng.choice([1, 2, 3, 1000])) for _ in range(rng.choice([0, 5, 19, 25, 26, 27, 60, 200]))], np.uint64) for _ in range(4)]
        h, row = words.mix(np.concatenate(docs) + np.uint64(1)), np.repeat(np.arange(4), [len(d) for d in docs])
        a, e, names = passages.marks(h, row)
        want = set()
        for r in range(4):
            at = np.flatnonzero(row == r)[: max(0, int((row == r).sum()) - passages.MIN_RUN + 1)]
            own = passages._window_names(h, at, at + passages.MIN_RUN).tolist()
            for k in range(len(own) - passages.REACH + 1):
                w = own[k : k + passages.REACH]
                want.add(int(at[0]) + k + max(j for j in range(passages.REACH) if w[j] == min(w)))
        inside = np.zeros(len(h) + 1, np.int64)
        for x in want:
            inside[x : x + passages.MIN_RUN] = 1
        mine = np.zeros(len(h) + 1, np.int64)
        for x, y in zip(a.tolist(), e.tolist(), strict=True):
            assert row[x] == row[y - 1]
            mine[x:y] = 1
        assert (mine == inside).all() and set(a.tolist()) <= want


# --- decontamination


def test_leaks_and_changed_slots(spark):
    rng = random.Random(8)
    items = [(1, "A train goes 60 km in 2 hours and then stops for 60 minutes near the old town of Ghent before it turns back"), (2, prose(30, rng)), (3, "of the"), (4, None), (5, "seven words that make up one item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = items[0][1].replace("60", "75").replace("2 hours", "3 hours").replace("Ghent", "Bruges")
    mixed = items[0][1].replace("60 km", "75 km")
    docs = frame(spark, [(10, prose(40, rng) + " " + items[0][1] + " " + prose(5, rng)), (11, f"{prose(30, rng)}. {changed} {prose(9, rng)}"), (12, f"{prose(30, rng)}. {mixed}"), (13, prose(20, rng) + "\n" + items[1][1].replace(" ", "\n", 3)), (14, prose(90, rng)), (15, None), (16, ""), (17, "x seven words that make up one item y"), (18, items[1][1][: len(items[1][1]) // 4])])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert {(10, 1), (11, 1), (13, 2), (17, 5)} <= set(got)
    assert got[11, 1]["changed"] and not got[10, 1]["changed"]
    assert {d for d, _ in got} <= {10, 11, 12, 13, 17}
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def brute_tokens(text: str) -> tuple[list[tuple[str, tuple | None, int]], list[str]]:
    """((literal or type, value of a slot, number of words), ...) and the words of a text, by the module's rules."""
    words_of, tokens, last, after = [], [], "", 0
    for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text):
        raw = m[0]
        w = re.sub("[A-Z]", lambda x: x[0].lower(), raw)
        gap = text[after : m.start()]
        fresh = not words_of or re.search(r"[\n!.:?]", gap)
        digits, spelt = raw[0].isascii() and raw[0].isdigit(), w in decontaminate.NUMBERS
        name = bool(re.match(r"[A-ZÀ-Þ]", raw)) and not spelt and w not in decontaminate.OPENERS
        kind = "digits" if digits else "spelt" if spelt else "name" if name else "unit" if w in decontaminate.UNITS and last in ("digits", "spelt") else ""
        glued = words_of and kind == last and ((kind == "digits" and gap in (".", ",")) or (kind == "spelt" and gap in (" ", "-")) or (kind == "name" and gap in (" ", "-") and not fresh))
        if glued:
            t, v, n = tokens[-1]
            tokens[-1] = (t, (*v, w), n + 1)
        elif kind:
            tokens.append(({"spelt": "digits"}.get(kind, kind).upper(), (w,), 1))
        else:
            tokens.append((w, None, 1))
        words_of.append(w)
        last, after = kind, m.end()
    return tokens, words_of


def brute_leaks(docs, items) -> dict[tuple[int, int], tuple[float, bool]]:
    out = {}
    for i, item in items:
        own, own_words = brute_tokens(item or "")
        if len(own_words) < decontaminate.MIN_LITERALS:
            continue
        n = min(decontaminate.WINDOW, len(own))
        good = [p for p in range(len(own) - n + 1) if sum(v is None for _, v, _ in own[p : p + n]) >= min(n, decontaminate.MIN_LITERALS)] if len(own) >= decontaminate.MIN_LITERALS else []
        seen = {p + k for p in good for k in range(n)}
        starts = np.cumsum([0, *(k for *_, k in own)]).tolist()
        unseen = {w for k in range(len(own)) if k not in seen for w in range(starts[k], starts[k + 1])}
        m = min(decontaminate.WINDOW, len(own_words))
        for d, text in docs:
            theirs, their_words = brute_tokens(text or "")
            diagonals: dict[int, set[int]] = {}
            for p in good:
                for q in range(len(theirs) - n + 1):
                    if [t for t, *_ in theirs[q : q + n]] == [t for t, *_ in own[p : p + n]]:
                        diagonals.setdefault(q - p, set()).update(range(p, p + n))
            covered, changed = set(), False
            for k, places in diagonals.items():
                pairs = {(own[p][1], theirs[p + k][1]) for p in places if own[p][1]}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    covered |= places
                    changed |= any(a != b for a, b in pairs)
            share = {w for p in covered for w in range(starts[p], starts[p + 1])}
            for p in range(len(own_words) - m + 1):
                if unseen & set(range(p, p + m)) and any(their_words[q : q + m] == own_words[p : p + m] for q in range(len(their_words) - m + 1)):
                    share |= set(range(p, p + m))
            cover = len(share) / len(own_words) if unseen else len(covered) / len(own)
            if cover >= decontaminate.COVER and share:
                out[d, i] = (round(cover, 6), changed)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(17)
    names, units = ["Anna", "Peter Smith", "Ghent", "Mary-Ann"], ["km", "hours", "apples", "%"]

    def filled(template):
        return " ".join({"#": rng.choice(["5", "12", "3.5", "1,200", "seven", "twenty five"]), "@": rng.choice(names), "u": rng.choice(units)}.get(w, w) for w in template)

    templates = [[rng.choice(["#", "@", "# u", *VOCABULARY[:40]] if rng.random() < 0.4 else VOCABULARY[:400]) for _ in range(rng.randint(3, 30))] for _ in range(25)]
    templates = [" ".join(t).split() for t in templates]
    items = [(i, ("What. " if i % 7 == 0 else "") + filled(t)) for i, t in enumerate(templates)]
    texts = []
    for k in range(160):
        t = rng.choice(templates)
        inner = rng.choice(items)[1] if k % 3 == 0 else filled(t)
        if k % 5 == 0:
            w = inner.split()
            inner = " ".join(w[rng.randrange(len(w)) :] + w[: rng.randrange(len(w))])
        texts.append((k, f"{prose(rng.randint(0, 20), rng)}{rng.choice([' ', '. ', chr(10), ', '])}{inner}{rng.choice(['', ' ', '. '])}{prose(rng.randint(0, 9), rng)}"))
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["changed"]) for r in decontaminate.leaks(frame(spark, texts).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(texts, items) and len(got) > 40 and any(c for _, c in got.values())


def test_leaks_odd_rows(spark):
    rng = random.Random(21)
    item = "Anna walks 12 km on the first day and 7 km on the second day before she rests near Ghent"
    bench = spark.createDataFrame([(1, item), (1, item), (1, prose(12, rng)), (None, prose(30, rng)), (4, "")], "item_id long, text string").withColumn("h", F.lit(0))
    long = prose(150_000, rng) + " " + item
    same = item.replace("12", "9").replace("7", "9")  # two values of the item stand for one
    texts = [(None, item), (1, f"so. {item}"), (1, f"so. {item}"), (2, long), (3, same), (4, None), (5, "")]
    docs = frame(spark, texts).withColumn("leak", F.lit("x")).withColumn("_leak", F.lit("y")).withColumn("row", F.lit(1))
    got = sorted([(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.leaks(docs, bench).collect()], key=repr)
    assert got == sorted([(None, 1, 0), (1, 1, 4), (1, 1, 4), (2, 1, len(long) - len(item))], key=repr)
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_slots_of_several_parts(spark):
    item = "The bakery sold 500 loaves to Anna before noon and then it gave another 500 loaves to Anna for the late market"
    parts = item.replace("500", "1,200").replace("Anna", "Mary Smith")
    bench = spark.createDataFrame([(1, item), (2, parts.replace("bakery", "stall"))], "item_id long, text string")
    uneven = parts.replace("bakery", "stall").replace("1,200", "1,300", 1).replace("Mary Smith", "Mary Jones", 1)
    docs = frame(spark, [(10, f"so 1,7 it was. {parts}"), (11, f"at 3.5 then. {bench.collect()[1]['text']}"), (12, f"well. {uneven}")])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert got[10, 1]["changed"] and not got[11, 2]["changed"] and got[10, 1]["coverage"] == got[11, 2]["coverage"] == 1
    assert (12, 2) not in got
    for text in ("1,200", "Mary Smith"):
        offsets, data = words.text_buffers(pa.array([f"so {text} and {text}", f"x 1,5 y {text}"]))
        _, _, at, _, value, _, _ = next(decontaminate.tokens_of(offsets, data))[:7]
        assert value[1] == value[3] == value[-1] != 0


def test_items_of_few_literals(spark):
    items = ["Compute 12 + 7 * 3 - 45 / 9 + 18 * 2 - 6", "Solve for x: 3x + 7 = 22, 5x - 4 = 11, 2x + 9 = 31", "What Is The Capital Of The French Republic?", "3 + 4 = 7 9", "Of The", "the long old road goes down to the sea and then on 11 + 12 + 13 + 14 + 15 + 16 + 17 + 18 + 19 + 20 + 21 + 22"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rng = random.Random(13)
    texts = [(10 + k, f"{prose(30, rng)} Then {x} {prose(9, rng)}") for k, x in enumerate(items)]
    texts += [(20, f"{prose(30, rng)} Compute 13 + 8 * 4 - 46 / 8 + 17 * 3 - 5"), (21, prose(90, rng)), (22, "12 7 3 and 45"), (23, f"Then {items[5].replace('15', '99')}")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert {k for k in got if k[0] != 23} == {(10 + k, k) for k in range(6) if k != 4}
    raw = dict(texts)
    for k in (0, 1, 2, 3, 5):
        r = got[10 + k, k]
        assert r["coverage"] == 1 and not r["changed"] and raw[10 + k].encode()[r["start"] : r["end"]].decode() == items[k].rstrip("?")
    assert 0.5 <= got[23, 5]["coverage"] < 1
    assert {r["doc_id"] for r in decontaminate.drop_leaks(frame(spark, texts), bench).collect()} == {14, 20, 21, 22}


def test_written_tables_leave_no_shuffle_files(spark):
    from pathlib import Path

    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    t = store.written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "swept")
    for _ in range(100):  # files go in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert t.count() == 1000
    store.drop(t)


def test_only_members_texts_are_dealt_to_blocks(spark, monkeypatch):
    """Of 400 texts two are alike; the others aren't shuffled with them."""
    rng = random.Random(5)
    base = prose(60, rng)
    texts = [(i, prose(60, rng)) for i in range(400)] + [(1000, base), (1001, base + " end")]
    seen = []
    solved = jaccard_join._solved
    monkeypatch.setattr(jaccard_join, "_solved", lambda members, attach, *a: seen.append(attach(members)._jdf.queryExecution().optimizedPlan().toString()) or solved(members, attach, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts)
    assert seen and all("MapInArrow task(doc_id" in plan for plan in seen)


@pytest.mark.parametrize("size", [4, 63, 64, 65, 130, 700])
def test_sketches_of_similar_sets_pass(size):
    """Every pair that links passes, on both sides of a power of two; unlike sets don't."""
    rng = np.random.default_rng(size)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    may = lambda a, b: jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b))
    for _ in range(200):
        a = np.unique(fresh(size))
        b = np.unique(np.concatenate([a[rng.permutation(size)[: size - int(rng.integers(0, size // 5 + 1))]], fresh(int(rng.integers(0, size // 4 + 1)))]))
        if jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            assert may(a, b) and may(b, a)
        if size > 60:
            assert not may(a, np.unique(fresh(size)))


def test_shared_passages_make_no_blocks(spark, monkeypatch):
    """Texts of which each shares a passage with the next share signatures, but none of them becomes a candidate."""
    rng = random.Random(8)
    parts = [prose(90, rng) for _ in range(121)]
    texts = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(120)]
    members = []
    linked = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda reps, *a: members.append(reps.count()) or linked(reps, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == {i: i for i, _ in texts} and members == [0]
