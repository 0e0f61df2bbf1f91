"""Very long texts, odd characters, ties, shared ids, hubs and empty tables."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wavelark.llm import ann, bpe, langid, linededup, ngramjoin, packing, pii, quality, sharding, toxicity
from wavelark.llm.graph import components

from .test_neighbours import brute, classes
from .test_texts import CLASH, base_spans, docs_of, plain_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BLANKS = {"spaces": " " * 1_000_000, "newlines": "a" + "\n" * 1_000_000 + "b", "both": "\n " * 500_000, "wide": "\u3000" * 1_000_000}


def test_bpe_takes_every_character_as_the_library_does():
    lib, own = Tokenizer.from_file(WORDS), bpe.load(WORDS)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x11800 or c % 64 == 0 or 0xE0000 <= c < 0xE0200)]
    for i in range(0, len(points), 512):
        text = " ".join(f"a{chr(c)}b {chr(c)}!" for c in points[i : i + 512])
        assert np.frombuffer(own.encode(text), np.int32).tolist() == lib.encode(text, add_special_tokens=False).ids, hex(points[i])


def test_bpe_of_very_long_texts(spark):
    rnd = random.Random(1)
    texts = [*BLANKS.values(), "".join(rnd.choice("abcdefghij") for _ in range(60_000)), "7" * 100_000, "many words " * 50_000, "twin", "twin"]
    docs = docs_of(spark, texts, ids=[*range(len(texts) - 2), 1, None]).select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("decoded"))
    lib = Tokenizer.from_file(WORDS)
    want = Counter((d, tuple(lib.encode(t, add_special_tokens=False).ids)) for d, t in zip([*range(len(texts) - 2), 1, None], texts, strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode_documents(docs, WORDS).collect()) == want


def test_packing_of_very_long_texts(spark):
    texts = [*BLANKS.values(), "ab" * 500_000, ("x" + " " * 4999) * 50]
    lib = Tokenizer.from_file(BYTES)
    got = defaultdict(list)
    for r in packing.token_pieces(docs_of(spark, texts), BYTES).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t in enumerate(texts):
        assert sum((x for _, x in sorted(got[i])), []) == [*lib.encode(t, add_special_tokens=False).ids, 0]
    out = corpus_pipeline.packed(spark, docs_of(spark, texts), "")
    assert out.agg(F.sum("length")).first()[0] == sum(len(x) for parts in got.values() for _, x in parts)


def test_only_letters_are_letters(spark):
    docs = docs_of(spark, ["½ ² ① Ⅷ ৹", "12", "one word", "ein Wort", "x" * 300_000 + " one"], ids=[1, 1, 2, 3, 4]).withColumn("lang", F.when(F.col("doc_id") == 2, "en").when(F.col("doc_id") == 3, "de"))
    model = langid.fit(docs.select("text", "lang"))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()]
    assert got[:4] == [(1, "und"), (1, "und"), (2, "en"), (3, "de")] and got[4][1] in ("en", "de")
    counted = {(r["lang"], r["word"]): r["n"] for r in langid.counted_words(docs.filter("lang IS NOT NULL").select("lang", "text").repartition(3)).collect()}
    assert counted == {("en", "one"): 1, ("en", "word"): 1, ("de", "ein"): 1, ("de", "wort"): 1}
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.fixture
def all_are_candidates(monkeypatch):
    fit = ann.fit_curves
    monkeypatch.setattr(ann, "fit_curves", lambda *given: (fit(*given)[0], 2.0))


def test_many_equal_scores(spark, all_are_candidates):
    rnd = np.random.default_rng(2)
    # To the queries, which have the first component alone, all others are equally near.
    rows = [(20 * i, [1.0 + i] + [0.0] * 7) for i in range(3)] + [(i, [0.5, *rnd.permutation(np.arange(1, 8)).astype(float).tolist()]) for i in range(1, 400) if i % 20]
    table = spark.createDataFrame([rows[i] for i in rnd.permutation(len(rows))], "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = defaultdict(list)
    for r in ann.search(table).orderBy("rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == brute(rows, 20, 20)


def test_groups_of_queries_find_the_same(spark, monkeypatch, all_are_candidates):
    rnd = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rnd.normal(size=6).tolist()) for i in range(600)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, ann.search(table, k=5, query_every=2).collect()))
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    assert sorted(map(tuple, ann.search(table, k=5, query_every=2).collect())) == want


def test_formats_that_were_never_fitted(spark):
    made = pii.Invented(77)
    d, n, t = made.num, made.name, made.tld
    forms = {
        "email": ([lambda: f"{n()}{{at}}{n()}.{t()}", lambda: f"{n()}-{n()} AT {n()} dot {t()}"], [lambda: f"{d(1)} at {d(3)}.{d(1)}", lambda: f"{made.word()} at {made.word()}.\n"]),
        "card": ([lambda: " / ".join(made.card(True)), lambda: "/".join(made.card(True, (4, 6, 5)))], [lambda: " / ".join(made.card(False)), lambda: d(17)]),
        "phone": ([lambda: f"({d(3)})-{d(3)}-{d(4)}", lambda: f"0{d(3)}.{d(6)}"], [lambda: f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}"]),
    }
    rows = [(kind, y, pii.placed(made, kind, y, makers[i % 2]())) for kind, both in forms.items() for y, makers in zip((1, 0), both, strict=True) for i in range(200)]
    found = {r["doc_id"]: {pii.KINDS[s["rank"]] for s in r["spans"]} for r in pii.spans_of(docs_of(spark, [x[2] for x in rows]), ["doc_id"]).collect()}
    for kind in forms:
        hits = [kind in found[i] for i, x in enumerate(rows) if x[0] == kind and x[1]]
        wrong = [kind in found[i] for i, x in enumerate(rows) if x[0] == kind and not x[1]]
        assert np.mean(hits) >= (0.5 if kind == "phone" else 0.8), (kind, np.mean(hits))
        assert sum(wrong) <= 0.1 * max(1, sum(hits)), (kind, sum(wrong), sum(hits))


def test_personal_data_of_long_texts_and_shared_ids(spark):
    texts = ["a b " * 100_000 + "x@y.org", "1." * 100_000, "1234 " * 40_000, "@" * 200_000, "x@y.org", "x@y.org"]
    rows = pii.spans_of(docs_of(spark, texts, ids=[0, 1, 2, 3, 4, 4]), ["doc_id"]).collect()
    assert [(r["doc_id"], [(s["start"], s["rank"], s["end"]) for s in r["base"]]) for r in rows] == [(i, [x[:3] for x in base_spans(t)]) for i, t in zip([0, 1, 2, 3, 4, 4], texts, strict=True)]
    assert pii.spans_of(docs_of(spark, texts).limit(0), ["doc_id"]).count() == 0


def test_join_of_very_long_texts(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(150_000)]
    other = [w if rnd.random() > 0.01 else "x" for w in words]
    rows = list(enumerate([" ".join(words), " ".join(other), " ".join(words[:90_000]), "same " * 100_000, "same " * 50_000, None]))
    got = ngramjoin.join_similar(docs_of(spark, [t for _, t in rows])).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == classes(rows)
    tokens, paths = ngramjoin.tokens_of(rows[0][1]), ngramjoin.seeds_of(0, 5)
    want = ngramjoin.descend(tokens, paths, 2, 0.8)
    monkeypatch.setattr(ngramjoin, "SLICE", 1000)
    assert (ngramjoin.descend(tokens, paths, 2, 0.8) == want).all()


def test_large_groups_are_dealt_by_sizes(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 10)
    rows = spark.createDataFrame([(7, bytes([i]), 10 + i * i, 90) for i in range(90)], "label int, key binary, size int, n long")
    cells = defaultdict(list)
    for r in ngramjoin.cells(rows, "label", 0.8).collect():
        cells[r["_cell"]].append(r)
    met = {(a["key"][0], b["key"][0]) for c in cells.values() for a in c for b in c if a["key"] < b["key"] and (not a["_mixed"] or a["_block"] != b["_block"])}
    sizes = [10 + i * i for i in range(90)]
    assert all((i, j) in met for i in range(90) for j in range(i + 1, 90) if sizes[i] >= 0.8 * sizes[j])
    assert len(met) < 0.5 * 90 * 89 / 2


def test_copies_are_told_apart_by_row(spark):
    text = "one of the longer texts that has a copy in another row of this table"
    ids, texts = [1, 2, 2, 5, 5, None], [text, text, "this is quite another text with the same number as a copy", text + "!", "and a third one that is like none of the others here", text]
    kept = ngramjoin.keep_one(docs_of(spark, texts, ids), ["doc_id", "text", "_kept"])
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, text), (2, texts[2]), (5, texts[4])]


def test_a_hub_with_many_neighbours(spark):
    links = [(5000, i) for i in range(1, 3000)] + [(i, 10_000 + i) for i in range(1, 3000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 5999 and set(got.values()) == {1}


def test_shards_are_those_of_the_formula(spark):
    texts = ["a", "", None, "ünï", "long " * 200_000]
    rows = {r["doc_id"]: r for r in sharding.assign_shards(docs_of(spark, texts, ids=[3, 17, 4, None, 99]), [1.0, 2.0, 1.5]).collect()}

    def place(key, weights):
        scores = []
        for s, w in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
            scores.append((-math.log(((h >> 11) + 0.5) / 2**53) / w, s))
        return min(scores)[1]

    for i, t in zip([3, 17, 4, None, 99], texts, strict=True):
        raw, key = (t or "").encode(), "\x00null" if i is None else str(i)
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (rows[i]["shard"], rows[i]["grown_shard"]) == (place(key, [1.0, 2.0, 1.5]), place(key, [1.0, 2.0, 1.5, 1.0]))


def test_boilerplate_that_recurs_in_a_document(spark):
    ad, own = "buy now from our shop", "words of its own that stay in every document of the host "
    texts = [f"{own}{i} {own}\n" + f"{ad}\n" * (1 + 9 * (i % 2)) + f"tail {i} " + " ".join(f"w{i}x{j}" for j in range(200)) for i in range(24)]
    rows = quality.judge(docs_of(spark, texts), min_docs=20, min_share=0.5, min_left=0.9).orderBy("doc_id").collect()
    assert [r["lost_chars"] for r in rows] == [0] + [len(ad) * (1 + 9 * (i % 2)) for i in range(1, 24)]
    assert not any(r["base_failed"] for r in rows) and [r["kept"] for r in rows] == [i == 0 or i % 2 == 0 for i in range(24)]
    # In a large host a number of documents suffices, whatever share of it they are.
    assert quality.judge(docs_of(spark, texts), min_docs=20, min_share=2.0, most_docs=24).filter("lost_chars > 0").count() == 23


def test_quality_of_long_texts_and_shared_ids(spark):
    texts = ["a b c " * 50_000, "x\n" * 50_000, "q" * 300_000, "one two", "one two"]
    rows = quality.judge(docs_of(spark, texts, ids=[0, 1, 2, 3, 3])).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows] == [plain_counts(t) for t in texts]
    assert linededup.dedup_lines(docs_of(spark, ["z" * 500_000 + "\n" * 100_000] * 5)).agg(F.sum("n_dropped")).first()[0] == 4


def test_labels_that_repeat_and_empty_tables(spark):
    docs = docs_of(spark, ["vile words", "good words", None], ids=[1, 1, 2])
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (None, 1, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels, ["doc_id"]).count() == 3 and toxicity.classify(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_later_models_do_not_see_a_rows_own_label():
    # What the second model is fed for a row comes from folds without it: with the row's first label turned, only the others change.
    rnd = np.random.default_rng(1)
    rows = [np.flatnonzero(rnd.random(12) < 0.4) for _ in range(60)]
    y, folds = (rnd.random((60, 2)) < 0.5).astype(float), [i % toxicity.FOLDS for i in range(60)]
    fed, plain = [], toxicity.fit_linear

    def watch(part, n, extra, target, **more):
        fed.append(extra)
        return plain(part, n, extra, target, **more)

    toxicity.fit_linear = watch
    try:
        toxicity.fit_chain(rows, y, folds, {str(i): i for i in range(12)}, ["a", "b"])
        turned = y.copy()
        turned[7, 0] = 1 - turned[7, 0]
        first, fed[:] = fed[-1].copy(), []
        toxicity.fit_chain(rows, turned, folds, {str(i): i for i in range(12)}, ["a", "b"])
    finally:
        toxicity.fit_linear = plain
    same = [i for i in range(60) if first[i, 0] == fed[-1][i, 0]]
    assert same == [i for i in range(60) if folds[i] == folds[7]]
    for f in range(toxicity.FOLDS):
        train = [i for i in range(60) if folds[i] != f]
        w, _, b = plain([rows[i] for i in train], 12, np.zeros((len(train), 0)), y[train, 0])
        assert first[[i for i in range(60) if folds[i] == f], 0] == pytest.approx([toxicity.logit(toxicity.sigmoid(w[rows[i]].sum() + b)) for i in range(60) if folds[i] == f])


def test_pipeline_of_nulls_and_of_nothing(spark, tmp_path):
    text = "a text of some more words than five which has a copy"
    docs = docs_of(spark, [None, "", text, text, "mail a@b.org"]).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows, want in (("some", docs, [0, 1, 2, 4]), ("none", docs.limit(0), [])):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r["doc_id"] for r in out) == want
