"""Tokens, files, media, languages, toxicity, quality, licences, the pipeline: against the library, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import io
import random
import tarfile
import textwrap
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keymoment.llm import bpe, decontaminate, jaccard_join, language, licenses, media, passages, quality, store, token_files, toxicity

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD = ["", "a<|endoftext|>b  \n\n c", "日本語 テスト ２３ ½ don't we'll  ", "\x1c\x1d a\x85b\xa0c ²³", "x" * 5000, "ab" * 3000, "naïve 😀😀 é", "the the " * 100, " <|endoftext|> ", "''s 't'sx_a__b1234", None]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)], SCHEMA).withColumn("ids", F.lit("clash")).withColumn("score", F.lit(1))


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_bpe_is_the_library(spark, docs, odd):
    path, t = P.path("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    for frame in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}
        got = {r["doc_id"]: r for r in bpe.round_trip(frame, path).collect()}
        assert set(got) == set(texts)
        for i, x in texts.items():
            ids = t.encode(x, add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_without_lexicon_and_empty(spark, docs):
    path = P.path("byte_bpe_50k.json")
    uri = bpe.build_lexicon(docs.limit(0), path)
    a = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(docs, path, uri).collect()}
    b = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(docs, path).collect()}
    assert a == b and {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(docs, path, uri), path).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_transducer_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(2000)})
    m = bpe.Transducer.of(words)
    assert m.numbers(words).tolist() == list(range(len(words)))
    other = [w + b"d" for w in words[:50]] + [b"", b"zz"]
    assert (m.numbers(other) == -1).all()
    assert len(m.final) < sum(map(len, words)) / 4  # suffixes are shared
    assert bpe.Transducer.of([]).numbers([b"a"]).tolist() == [-1]


def test_token_files_hold_the_library_s_ids(spark, docs, odd):
    path, t = P.path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    for frame in (docs.repartition(5), odd.repartition(3)):
        files = token_files.write_token_files(frame, path)
        got = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
        start = 0
        for r in sorted(frame.select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            g = got[r["doc_id"]]
            assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path)).count() == 0


def test_kept_words_are_the_library_s(monkeypatch):
    """Random texts of all of Latin-1 with controls, apostrophes, digits and marks of special tokens, in small groups, so kept words grow and are forgotten."""
    t, rng = tokenizer("word_bpe_49k.json"), random.Random(3)
    monkeypatch.setattr(token_files, "WORDS_KEPT", 300)
    e = token_files.WordEncoder(P.path("word_bpe_49k.json"))
    pieces = [chr(c) for c in range(256)] + ["'s", "'ll", "don't", "<|", "<|endoftext|>", "12", " \n\t ", "the", "of", "éa", "ÀÉ", "x1y2", "''", "</w>"]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces if rng.random() < 0.4 else pieces[32:127] + pieces[256:]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        n, ids = e.encode(texts)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for v in (np.array([5]), np.array([2**32 - 1, 0]), np.arange(3000), np.full(1025, 7), rng.integers(0, 50_000, 5000), np.where(rng.random(4096) < 0.02, 2**31, rng.integers(0, 9, 4096)), np.zeros(0)):
        v = v.astype(np.uint32)
        blocks = token_files.pack_blocks(v)
        starts = np.cumsum([0, *map(len, blocks)])
        assert (token_files.unpack_blocks(b"".join(blocks), starts)[: len(v)] == v).all() if len(v) else not blocks
    small = np.where(np.arange(1024) == 3, 2**31, 1).astype(np.uint32)
    assert len(token_files.pack_blocks(small)[0]) < 40  # one outlier doesn't widen its block


def test_null_and_repeated_ids_in_token_files(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b c"), (1, "")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(token_files.write_token_files(rows, P.path("word_bpe_49k.json"))).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 3), (6, 2, 3)]


def test_media_payloads(spark, odd):
    frame = odd.unionAll(odd.withColumn("doc_id", F.col("doc_id") + 100))
    index = media.store_payloads(frame)
    got = {r["doc_id"]: r for r in media.media_columns(frame).collect()}
    for i, x in enumerate(ODD):
        raw = (x or "").encode()
        p = media.padded(raw)
        g = got[i]
        assert len(p) % 576 == 0 and p and (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert g["height"] * 576 == len(p) and [v for k, v in g.asDict().items() if k != "doc_id"] == [v for k, v in got[i + 100].asDict().items() if k != "doc_id"]
    rows = index.collect()
    assert len({bytes(r["digest"]) for r in rows}) == len(rows) == len({(x or "") for x in ODD})
    fs, where = store.open_fs(rows[0]["shard"])
    with fs.open_input_file(where) as f:
        raw = f.read()
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for m in tar.getmembers():
            assert m.name == hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".pngs"
    one = raw[rows[0]["offset"] : rows[0]["offset"] + rows[0]["length"]]
    assert hashlib.sha256(media.from_png(one)).digest() == bytes(rows[0]["digest"])
    assert media.media_columns(odd.limit(0)).count() == 0
    assert media.header_columns(index).count() == len(rows)


def test_languages_held_out(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(big).join(big.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_languages_odd_rows(spark, docs, odd):
    names, vectors = language.prototypes(docs)
    assert names == sorted(names) and np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-5)
    rows = odd.unionAll(odd.select(F.lit(None).cast("long").alias("doc_id"), F.lit("123 !!").alias("text"), "lang", "source", "n_chars", "ids", "score").limit(1))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(rows, names, vectors).collect()}
    assert got[0] == got[10] == got[None] == "und" and got[6] in names
    assert {r["lang_pred"] for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predict_languages(docs.limit(0)).count() == 0
    clash = docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    kept = language.keep_identified(clash)
    assert kept.columns == clash.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(blind).count() == kept.count()  # nothing was learned, so nothing is told apart
    assert language.keep_identified(docs.limit(0)).count() == 0


def brute_vector(text: str | None) -> np.ndarray:
    out = np.zeros(language.DIM)
    for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split():
        draw = [np.random.default_rng([language.SEED, ord(c)]).choice(np.array([-1, 1], np.float32), language.DIM) for c in f" {word} "]
        for x, y, z in zip(draw, draw[1:], draw[2:], strict=False):
            out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_languages_against_brute_force(spark, docs):
    """Cosines, prototypes and the pipeline's decision in plain Python, with texts in scripts that nothing was learned from."""
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"][:400], r["lang"]) for r in docs.orderBy("doc_id").limit(40).collect()]
    rows += [(1000 + i, "".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in range(200)), None) for i in range(30)] + [(2000, None, "en"), (2001, "", "en"), (2002, "12 34", "en"), (None, "some words", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vectors = {i: brute_vector(t) for i, t, _ in rows}
    names = sorted({x for i, t, x in rows if x and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2})
    sums = {n: np.zeros(language.DIM) for n in names}
    for i, t, x in rows:
        if x and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[x] += vectors[i] / max(1, sum(c.isalpha() for c in t))
    got = {r["doc_id"]: r for r in language.predict_languages(frame).collect()}
    kept = {r["doc_id"] for r in language.keep_identified(frame).collect()}
    for i, t, _ in rows:
        cos = [float(vectors[i] @ sums[n] / max(1e-12, np.linalg.norm(vectors[i]) * np.linalg.norm(sums[n]))) for n in names]
        some = any(c.isalpha() for c in t or "")
        assert got[i]["lang_pred"] == (names[int(np.argmax(cos))] if some else "und")
        assert abs(got[i]["score"] - (min(1, max(0, *cos)) if some else 0)) < 2e-6
        assert (i in kept) == (some and max(cos) > language.CHANCE / language.DIM**0.5)
    assert len(kept & set(range(1000, 1030))) < 8 < 40 <= len(kept - set(range(1000, 1030)))


def test_language_memory_is_bounded(monkeypatch):
    """Sections and small pieces give the same vectors; many short or empty texts and one long text in a wide script are taken in pieces."""
    rng = random.Random(1)
    texts = ["one two", None, "", "Ab cdéf " * 300, "日本語テスト" * 100, "x", "y" * 999, "1 2"] + ["short %d text" % i for i in range(30)]
    whole = np.concatenate([v for v, _ in language.Encoder(64).bundles(pa.array(texts))])
    for name, n in (("CHARS", 50), ("TEXTS", 3), ("COLUMNS", 7), ("SLOTS", 11)):
        monkeypatch.setattr(language, name, n)
        e = language.Encoder(64)
        assert (np.concatenate([v for v, _ in e.bundles(pa.array(texts))]) == whole).all()
    monkeypatch.undo()
    e, most = language.Encoder(), 0
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(2000)] + [""] * 10_000 + ["".join(map(chr, rng.choices(range(0x4E00, 0x9FFF), k=300_000)))]
    n = 0
    for first, end, parts in language.pieces(pa.array(texts)):
        most, n = max(most, sum(len(p.text) for p in parts)), n + (end - first if not parts[0].left else 0)
        assert len(parts) <= language.TEXTS
    assert n == len(texts) and most <= language.CHARS + 2
    assert sum(len(v) for v, _ in e.bundles(pa.array(texts))) == len(texts) and e.n <= language.SLOTS


def test_binding_is_by_place():
    e = language.Encoder(256)
    v = np.concatenate([v for v, _ in e.bundles(pa.array(["abc", "cba", "abc", "", "12", "日本語"]))])
    assert (v[0] == v[2]).all() and not (v[0] == v[1]).all() and not v[3].any() and not v[4].any() and v[5].any()
    a, b, c = (e.letters[e.number[ord(x)]] for x in "abc")
    assert np.allclose(e.bound(*(e.number[[ord(x)]] for x in "abc"))[0], np.roll(a, 2) * np.roll(b, 1) * c)


def test_toxicity_held_out_and_located(spark):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predict_toxicity(big, labels).join(labels, "doc_id").join(big.select("doc_id", "text"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() / held.predicted.sum() > 0.85 and hit.sum() / (held.toxic == 1).sum() > 0.85
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    flagged = got[got.predicted == 1].head(50)
    for r in flagged.itertuples():
        for s in r.sentences:
            assert 0 <= s["start"] < s["end"] <= len(r.text)


def test_toxicity_small(spark, odd):
    rng = random.Random(0)
    texts = [(i, ". ".join("word%d is here" % rng.randrange(50) for _ in range(20)) + (". you awful thing" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(0, None), (1, 0)], "doc_id long, toxic int")
    got = toxicity.predict_toxicity(docs, labels).toPandas().set_index("doc_id")
    assert all((got.predicted[i] == 1) == (i % 4 == 0) for i, _, _ in texts)
    s = got.sentences[0][0]
    assert texts[0][1][s["start"] : s["end"]] == "you awful thing"
    none = toxicity.predict_toxicity(odd, labels.limit(0)).toPandas()
    assert len(none) == len(ODD) and (none.score == 0).all()
    assert toxicity.predict_toxicity(docs.limit(0), labels).count() == 0


def test_noisy_or_loss_and_gradient():
    """The gradient against differences of the loss in plain Python, bag by bag, with bags of one and of no toxic sentence."""
    rng = np.random.default_rng(2)
    bag = np.repeat(np.arange(50), rng.integers(1, 6, 50))
    f = rng.integers(0, 12, 4 * len(bag))
    s = np.repeat(np.arange(len(bag)), 4)
    y = rng.integers(0, 2, 50).astype(float)
    w, b = rng.normal(0, 0.5, 12), -1.0

    def loss(w, b):
        total = 0.0
        for k in range(50):
            none = 1.0
            for j in np.flatnonzero(bag == k):
                z = b + sum(w[f[e]] for e in np.flatnonzero(s == j))
                none *= 1 - 1 / (1 + np.exp(-z))
            total -= np.log(1 - none) if y[k] else np.log(none)
        return total / 50

    gw, gb = toxicity.gradient(y, f, s, bag, w, b)
    step = 1e-5
    for i in range(12):
        d = np.zeros(12)
        d[i] = step
        assert gw[i] == pytest.approx((loss(w + d, b) - loss(w - d, b)) / (2 * step), abs=1e-6)
    assert gb == pytest.approx((loss(w, b + step) - loss(w, b - step)) / (2 * step), abs=1e-6)


def test_odd_rows_of_every_operator(spark, docs):
    """Null ids, repeated rows, null and empty texts and a text of 3 MB: each row in, a row out, equal rows alike."""
    long = " ".join(["you awful thing. one more word 12345"] * 80_000)
    rows = [(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (5, "same text of some words", "en", "s", 9), (5, "same text of some words", "en", "s", 9), (6, None, None, None, None), (7, "", "en", "s", 0), (8, long, "en", "s", len(long))]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("_id", F.lit(2))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    t = tokenizer("byte_bpe_50k.json")
    for name, out in (
        ("op3", bpe.round_trip(frame, P.path("byte_bpe_50k.json"))),
        ("op7", media.media_columns(frame)),
        ("op8", toxicity.predict_toxicity(frame, labels)),
        ("op2", quality.quality(frame, labels, F.col("source"), F.col("lang"))),
    ):
        got = out.collect()
        assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(r[0]) for r in rows), name
        for same in (None, 5):
            a = [[v for k, v in r.asDict().items()] for r in got if r["doc_id"] == same]
            assert len(a) == 2 and a[0] == a[1], name
        if name == "op3":
            n = {r["doc_id"]: r["n_tokens"] for r in got}
            assert n[8] == len(t.encode(long, add_special_tokens=False).ids) and n[6] == n[7] == 0
    found = licenses.scan(frame).collect()
    assert all(r["doc_id"] in (None, 5, 8) for r in found)


def test_quality_held_out(spark):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(big, labels, F.col("source"), F.col("lang")).toPandas()
    assert len(got) == big.count()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.keep == (held.quality == 1)).mean() > 0.97


def _strength(groups, most):
    """groups: (k, n, mean) of each; the moment estimate in plain Python."""
    n = sum(g[1] for g in groups)
    within = sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n
    between = max(sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups) / n - within * len(groups) / n, within / most, 1e-12)
    return min(max(within / between - 1, 1.0), most)


def test_quality_posteriors_in_plain_python(spark, docs):
    """Every row's host and path rates and its score from the document probabilities, by loops; null and repeated ids and clashing columns among them."""
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    rows += [(None, "a text", "src1", "en"), (rows[0][0], rows[0][1], rows[0][2], rows[0][3]), (9001, None, None, None), (9002, "", "only", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit("clash")).withColumn("p", F.lit(0)).withColumn("k1", F.lit(1))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels = labels.unionAll(labels.limit(3))
    y = {}
    for r in labels.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["quality"] is not None:
            y[r["doc_id"]] = min(r["quality"], y.get(r["doc_id"], 1))
    got = quality.quality(frame, labels, F.col("source"), F.col("lang"))
    p = {}
    for r in got.collect():
        p.setdefault(r["doc_id"], []).append(r)
    assert sorted(map(str, (r[0] for r in rows))) == sorted(str(k) for k, v in p.items() for _ in v)
    site = {}
    own = []
    for i, _, host, path in rows:
        g = p[i][0]
        n1, k1 = (1.0, float(y[i])) if i in y else (quality.SOFT, g["p_document"] * quality.SOFT)
        own.append((i, host, path, k1, n1, g))
        for key in ((host,), (host, path)):
            a = site.setdefault(key, [0.0, 0.0])
            a[0] += k1
            a[1] += n1
    hosts = [v for k, v in site.items() if len(k) == 1]
    mean = sum(h[0] for h in hosts) / sum(h[1] for h in hosts)
    s1 = _strength([(*h, mean) for h in hosts], quality._MOST_STRENGTH)
    paths = [(*v, (site[k[:1]][0] + s1 * mean) / (site[k[:1]][1] + s1)) for k, v in site.items() if len(k) == 2]
    s2 = _strength(paths, quality._MOST_STRENGTH)
    logit = lambda q: np.log(q / (1 - q))
    for _, host, path, k1, n1, g in own:
        hk, hn = site[(host,)]
        k, n = site[(host, path)]
        host_rate = (hk - k1 + s1 * mean) / (hn - n1 + s1)
        path_rate = (k - k1 + s2 * host_rate) / (n - n1 + s2)
        q = min(max(g["p_document"], 1e-6), 1 - 1e-6)
        score = 1 / (1 + np.exp(-(logit(q) + logit(path_rate) - logit(mean))))
        assert g["host_rate"] == pytest.approx(host_rate, abs=2e-5) and g["path_rate"] == pytest.approx(path_rate, abs=2e-4)
        assert g["score"] == pytest.approx(score, abs=2e-3) and g["keep"] == (g["score"] >= quality.KEEP)


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "same words in each text of these", f"h{i % 3}", "p") for i in range(300)] + [(900, "same words in each text of these", "h9", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0 or i % 30 == 0)) for i in range(300)], "doc_id long, quality int")
    got = quality.quality(docs, labels, F.col("source"), F.col("lang")).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang"]), on="doc_id")
    rate = got.groupby("source").host_rate.mean()
    assert rate["h0"] < 0.4 < rate["h9"] < rate["h1"]  # the site of one document keeps near the global rate
    none = quality.quality(docs, labels.limit(0), F.col("source"), F.lit(None)).toPandas()
    assert len(none) == len(rows) and (none.score == 0.5).all()
    assert quality.quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_licences(spark, docs, odd):
    model = licenses.train(docs)
    assert model.held_accuracy > 0.95 and model.template_accuracy > 0.5  # of variants of known templates, of whole templates
    texts = {1: "Intro line\nReleased under the MIT License.\nmore", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under the Zebra Quay License, version 9.", 4: "The cat sat on the mat and looked at the sea.", 5: "licensed under the apache license, version 2.0", 6: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = {r["doc_id"]: r for r in licenses.scan(rows, model).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert {i: got[i]["family"] for i in got} == {1: "mit", 2: "gpl-3.0", 3: "unknown", 5: "apache-2.0"}
    assert got[1]["confirmed"] and got[1]["line"] == 1 and texts[1].encode()[got[1]["start"] : got[1]["end"]].decode() == "Released under the MIT License"
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_licences(spark, docs):
    model = licenses.train(docs)
    texts, want = [], []
    for family, k in (("mit", 2), ("gpl-3.0", 1)):
        for width in (72, 79):
            for mark in ("", "# ", " * "):
                lines = [mark + x for x in textwrap.wrap(licenses.TEMPLATES[family][k], width)]
                texts.append("\n".join(["#!/bin/sh", "", *lines, "", "The cat sat on the mat", "and looked at the sea."]))
                want.append((family, "\n".join(lines).lstrip("#* ").rstrip(".")))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(rows, model).collect()}
    assert licenses.scan(rows, model).count() == len(texts) == len(got)
    for i, (family, part) in enumerate(want):
        assert got[i]["confirmed"] and got[i]["family"] == family and got[i]["line"] == 2
        assert texts[i].encode()[got[i]["start"] : got[i]["end"]].decode() == part


def test_licences_against_the_model_itself(spark, docs):
    """Each one-line paragraph of the corpus judged in plain Python from the weights, without the screen."""
    model = licenses.train(docs)
    weight = {int(f): w for f, w in zip(model.features, model.w, strict=True)}
    rows = [(i, line) for i, line in enumerate(x for r in docs.orderBy("doc_id").limit(120).collect() for x in r["text"].split("\n"))]
    rows += [(10_000 + i, t) for i, t in enumerate(x for own in licenses.TEMPLATES.values() for x in own)] + [(20_000, "version 3"), (20_001, "the License")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for i, text in rows:
        z = model.b.copy()
        for f in licenses._bag(pa.array([text]))[0].tolist():
            z = z + weight.get(f, 0)
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        k = int(p.argmax())
        assert (i in got) == (model.classes[k] != "none")
        if i in got:
            assert got[i]["family"] == (model.classes[k] if p[k] >= licenses.CONFIDENT else "unknown") and abs(got[i]["probability"] - p[k]) < 1e-5
    assert sum(i >= 10_000 and i < 20_000 and g["confirmed"] for i, g in got.items()) >= 0.9 * sum(map(len, licenses.TEMPLATES.values()))


def test_licences_of_similar_wording(spark, docs):
    """A line that two families share confirms neither; whole notices do."""
    model = licenses.train(docs)
    texts = {1: "This program is free software: you can redistribute it and/or modify it under the terms", 2: licenses.TEMPLATES["gpl-3.0"][1], 3: licenses.TEMPLATES["gpl-2.0"][1], 4: licenses.TEMPLATES["lgpl"][1], 5: "x " * 200_000 + "\n" + licenses.TEMPLATES["mit"][2], None: licenses.TEMPLATES["bsd"][0]}
    rows = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string")
    got = licenses.scan(rows, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert not (1 in by and by[1]["confirmed"])
    assert {k: by[k]["family"] for k in by if by[k]["confirmed"]} == {2: "gpl-3.0", 3: "gpl-2.0", 4: "lgpl", 5: "mit", None: "bsd"} and sum(r["doc_id"] == 3 for r in got) == 2


def test_pipeline_stages(spark, docs):
    at, kept = docs, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        at = store.written(stage(spark, at, DATA), name)
        kept[name] = at
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_leaks", "byte_pairs"]
    for name in ("language_id", "near_duplicates", "repeated_passages", "benchmark_leaks"):
        assert kept[name].columns == docs.columns
    a, b, c, d = (kept[n] for n in ("language_id", "near_duplicates", "repeated_passages", "benchmark_leaks"))
    comp = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(a).collect()}
    assert {r["doc_id"] for r in b.collect()} == {i for i, x in comp.items() if i == x}
    gone = {r["doc_id"] for r in passages.repeated_passages(b).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (b, c))
    assert all(after[i] == before[i] for i in before if i not in gone) and all(len(after.get(i, "")) < len(before[i]) for i in gone)
    leaked = {r["doc_id"] for r in decontaminate.leaks(c, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in d.collect()} == set(after) - leaked
    t = tokenizer("byte_bpe_50k.json")
    final = {r["doc_id"]: r for r in at.collect()}
    assert set(final) == set(after) - leaked
    for i in list(final)[:50]:
        assert np.frombuffer(final[i]["ids"], "<u4").tolist() == t.encode(after[i], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, DATA).count() == len(final)


def test_pipeline_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, no language known, clashing columns: the defined cases of the pipeline's statement."""
    text = "some words of a text that is long enough to be told from the others and has more than twenty of them in its only line here"
    rows = [(None, "one text without an id", None), (3, text, None), (3, text, None), (4, text + " and", None), (5, None, None), (6, "", None), (7, "12 34 --", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("source", "component_id", "cuts", "cut_id", "gone", "_cuts", "ids"):
        frame = frame.withColumn(c, F.lit("x"))
    frame.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None"]
    t = tokenizer("byte_bpe_50k.json")
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {None: len(t.encode(rows[0][1]).ids), 3: len(t.encode(text).ids)}


def test_pipeline_on_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
