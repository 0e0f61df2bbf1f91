"""Joins, nearest neighbours, components and the pipeline, against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelark.llm import ann, ngramjoin, pii, queries, toxicity
from wavelark.llm.graph import components

from .test_texts import CLASH, docs_of, drop_lines


def classes(rows, similarity=0.8):
    """(doc_id, class_id, links) of each row, all pairs compared."""
    sets = [frozenset(ngramjoin.tokens_of(t).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, known[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([20, 80, 300]))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 6)):
            changed = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                changed[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(changed))
    return [*texts, *texts[:5], None, "", "!?", "one two", "One, two!", "one"]


def test_join_finds_what_all_pairs_find(spark):
    texts = near_copies()
    ids = [*range(len(texts) - 2), 3, None]
    got = ngramjoin.join_similar(docs_of(spark, texts, ids))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == classes(list(zip(ids, texts, strict=True)))
    assert ngramjoin.join_similar(docs_of(spark, texts, ids).limit(0)).count() == 0


def test_buckets_larger_than_a_block(spark, monkeypatch):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(60):
        changed = list(words)
        changed[rnd.randrange(120)] = f"own{i}"
        texts.append(" ".join(changed))
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    got = ngramjoin.join_similar(docs_of(spark, texts))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == classes(list(enumerate(texts)))


def test_isolated_pairs_in_large_buckets_have_the_recall(spark, monkeypatch):
    # All that a pair shares is in passages that many others hold in other mixtures; its similarity is just 0.8.
    rnd = random.Random(4)
    passages = [[f"p{i}w{j}" for j in range(20)] for i in range(20)]
    texts = []
    for i in range(400):
        words = [w for k in sorted(rnd.sample(range(20), 14)) for w in passages[k]]
        texts += [" ".join(words), " ".join([*words, *[f"own{i}w{j}" for j in range(69)]])]
    monkeypatch.setattr(ngramjoin, "BLOCK", 60)
    got = {r["doc_id"]: r["class_id"] for r in ngramjoin.join_similar(docs_of(spark, texts)).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 800, 2)) >= 0.99 * 400


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, v in ok:
        if q % every == 0:
            out[q] = sorted(((float(v @ x), i) for i, x in ok if i != q), key=lambda s: (-s[0], s[1]))[:k]
    return out


def test_nearest_neighbours_have_the_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 20)
    got = defaultdict(list)
    for r in queries.op5_curves(spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {(q, i): s for q in want for s, i in want[q]}
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert all(s == pytest.approx(exact[q, i], rel=1e-12) for _, i, s in rows if (q, i) in exact)


def test_vectors_that_take_no_part(spark):
    rows = [(i, [float(i % 7 + 1), 1.0]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0]), (120, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = defaultdict(list)
    for r in ann.search(table, k=4).orderBy("rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == brute(rows[:30], 4, 20)
    few = ann.search(table.filter("vec_id < 3"), k=20).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 2), (0, 1)]
    assert ann.search(table.limit(0)).count() == 0 and ann.search(table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_hilbert_neighbours_are_a_step_apart():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert sorted(ann.hilbert(cells, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_a_discarded_span_discards_none(spark, monkeypatch):
    # The card falls to the address, so the first number, which overlaps the card alone, stays.
    models = {k: pii.Forest([], 1.0, b, 0.5) for k, b in {"email": 3.0, "ip": 0.0, "card": 2.0, "phone": 1.0}.items()}
    monkeypatch.setattr(pii, "trained", lambda _: models)
    docs = docs_of(spark, ["so 555 123 4444 5555 6666 7777 at home.com now"])
    (row,) = pii.spans_of(docs, ["doc_id"]).collect()
    assert row["base"] == [] and [(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in row["spans"]] == [("phone", 3, 15), ("email", 26, 42)]
    assert pii.redact(docs, ["text"]).first()["text"] == "so [PHONE] 5555 6666 [EMAIL] now"


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf, names = "/root/testdata/sf0.001", [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        if i < len(names) - 1:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i == len(names) - 1:
            break
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
            gone = set(before) - set(kept)
            said = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"]).filter("is_toxic").collect()
            assert all(before[k] == kept[k] for k in kept) and gone == {r["doc_id"] for r in said} and gone & bad
        elif name == "line_dedup":
            left = {i: "\n".join(x) for i, _, x, d in drop_lines(list(before.items())) if not d or "\n".join(x).strip(" \t\n\x0b\x0c\r")}
            assert kept == left
        elif name == "ngram_join":
            assert set(kept) == {d for d, c, _ in classes(sorted(before.items())) if d == c} and all(before[k] == kept[k] for k in kept)
        else:
            assert set(kept) == set(before)
            found = {r["doc_id"]: r["spans"] for r in pii.spans_of(spark.createDataFrame(list(before.items()), "doc_id long, text string"), ["doc_id"]).collect()}
            for k, text in before.items():
                want, at = "", 0
                for s in found[k]:
                    if s["start"] >= at:
                        want += text[at : s["start"]] + f"[{pii.KINDS[s['rank']].upper()}]"
                    at = max(at, s["end"])
                assert kept[k] == (None if text is None else want + text[at:])
    assert {r["doc_id"] for r in docs.collect()} == set(kept)
