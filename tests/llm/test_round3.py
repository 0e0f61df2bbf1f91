"""Search, mixing and alignment against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wavelark.llm import alignment, common, mixing, packing, search

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, key long, size string, query int"


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators use within."""
    return spark.createDataFrame([(i, t, s, 7, "x", 1) for i, t, s in rows], SCHEMA).repartition(3)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    found = [(i, plain_terms(t)) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in items:
        asked, scores = set(plain_terms(text)), []
        for doc_id, t in found:
            tf, score = Counter(t), 0
            for x in asked & set(t):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += weight * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * (50 + (50 * len(t) * n_docs) // words)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


WORDS = "river Stone ALMOST every window carries green letters under morning bright paper again slowly turning Äpfel naïve x1 42".split()


def texts_of(n, seed=0):
    """Texts whose words are of very unequal frequency, and copies of some."""
    out = []
    for i in range(n):
        h = int(hashlib.md5(f"{seed}:{i // 3 if i % 9 < 3 else i}".encode()).hexdigest(), 16)
        words = [WORDS[min((h >> (3 * j)) % 64, (h >> j) % 19)] + ("" if j % 5 else str(h % 50)) for j in range(h % 40)]
        out.append((i, " ".join(words)))
    return out


def found_by(spark, docs, items, **more):
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in search.search(table(spark, [(i, t, "s") for i, t in docs]), queries, **more).collect()], key=str)


def test_search_is_exact(spark, monkeypatch):
    docs = texts_of(400) + [(9000, None), (9001, ""), (9002, "!!! ..."), (None, "river stone 42"), (9003, "river " * 60_000 + "stone"), (9004, "same words here"), (9004, "same words here")]
    items = [(i, t) for i, t in texts_of(14, seed=5)] + [(50, None), (51, "--"), (52, "nowhere-to-be-found"), (53, "river " * 50), (53, "same words"), (None, "RIVER äpfel ÄPFEL")]
    for k in (1, 7, 50):
        assert found_by(spark, docs, items, k=k) == plain_search(docs, items, k)
    monkeypatch.setattr(search, "BUCKET_ENTRIES", 300)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 3)
    assert found_by(spark, docs, items, k=5) == plain_search(docs, items, 5)
    monkeypatch.setattr(search, "VOCABULARY", 0)  # all postings, joined
    assert found_by(spark, docs, items, k=5) == plain_search(docs, items, 5)


def test_search_of_nothing(spark):
    assert found_by(spark, [], [(1, "river")]) == []
    assert found_by(spark, [(1, None), (2, " ")], [(1, "river")]) == []
    assert found_by(spark, [(1, "river")], []) == []


def test_search_of_many_ties(spark):
    docs = [(i, "river stone") for i in range(300)] + [(i, "river other") for i in range(300, 330)]
    assert found_by(spark, docs, [(1, "stone river")], k=20) == plain_search(docs, [(1, "stone river")], 20)


def plain_targets(sizes, weights, share=1.5, most=2):
    """Shared step by step, as one would by hand."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def mixed(spark, rows, **more):
    return mixing.plan_mix(table(spark, rows), [3, 1, 2], keep=["doc_id", "source"], **more).collect()


def test_mix_meets_every_budget(spark, monkeypatch):
    texts = texts_of(900)
    rows = [(i, t, "big" if i % 3 else [None, "", "a", "Ä", "small", "z"][i % 6]) for i, t in texts]
    rows += [(None, "one two three", "big")] * 40 + [(5, None, "nothing"), (6, "", "nothing"), (5000, "word " * 50_000, "a")]
    sizes, ids = defaultdict(int), Counter()
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        ids[i, s] += 1
    got = mixed(spark, rows)
    want = plain_targets(sizes, [3, 1, 2])
    assert Counter((r["doc_id"], r["source"]) for r in got) == ids
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    assert sum(0 < r["extra"] < r["size"] for r in got) <= len(sizes)  # one cut a source at most
    plan = lambda rows: sorted((str(r["doc_id"]), r["source"] or "-", r["size"], r["taken"]) for r in rows)
    assert plan(mixed(spark, list(reversed(rows)))) == plan(got)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)  # many ranges of keys: the same mix
    assert plan(mixed(spark, rows)) == plan(got)


def test_mix_of_nothing_and_texts_of_the_mix(spark):
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [0, 0]
    with pytest.raises(ValueError, match="weights"):
        mixing.plan_mix(table(spark, []), [])
    rows = [(i, f"a{i}  b{i}\n c{i}" + ("\x01 d" if i % 2 else ""), "s") for i in range(20)]
    plan = {r["doc_id"]: r for r in mixing.plan_mix(table(spark, rows), [1.0], share=1.3).collect()}
    out = defaultdict(list)
    for r in mixing.mix(table(spark, rows), [1.0], share=1.3).collect():
        out[r["doc_id"]].append(r["text"])
    for i, text, _ in rows:
        assert sum(len(t.split(" ")) if "\n" not in t else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in out[i]) == plan[i]["taken"]
        assert sum(t == text for t in out[i]) >= plan[i]["epochs"] and all(t in (text,) or text.startswith(t) or "\x01" in text for t in out[i])


def plain_alignment(rows):
    """By the bytes of tokens, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, n = {}, 0
    for x in range(256):  # the public byte-level scheme, read off: printable bytes stand for themselves
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            letters[chr(x)] = x
        else:
            letters[chr(256 + n)] = x
            n += 1
    docs, counts = [], Counter()
    for i, text in rows:
        ends, ids, ok = [], [], bool(text)
        if ok:
            found = a.encode(" " + text, add_special_tokens=False)
            pieces = b.encode(text)
            tokens = [bytes(letters[c] for c in a.id_to_token(t)) for t in found.ids], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, pieces)]
            ok = all(b"".join(t) == (" " + text).encode() for t in tokens)
            ids = [found.ids, pieces]
            ends = [[sum(map(len, t[: j + 1])) for j in range(len(t))] for t in tokens] if ok else []
        if not ok:
            docs.append((i, 0, 0, 0, "", []))
            continue
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        links = [(x, y) for (s, e), x in zip(spans[0], ids[0], strict=True) for (s2, e2), y in zip(spans[1], ids[1], strict=True) if s < e2 and s2 < e]
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            part = lambda k: ",".join(str(t) for t, e in zip(ids[k], ends[k], strict=True) if last < e <= cut)  # noqa: B023, E731
            groups.append(f"{part(0)}|{part(1)}")
            last = cut
        counts.update(links)
        docs.append((i, len(ids[0]), len(ids[1]), len(groups), ";".join(groups), links))
    best = defaultdict(int)
    for (x, y), c in counts.items():
        best[y] = max(best[y], c)
    return sorted([(i, na, nb, ng, len(links), g, sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)) for i, na, nb, ng, g, links in docs], key=str)


ODD = [None, "", " ", "  two  blanks ", "tab\tand\nline\r\n", "naïve Äpfel 日本語 text 🙂👩‍👩‍👧", "▁ is not a blank", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 zero \x01", "é combined", "x", "a" * 3000, "12345678901234567890 " * 30, "﻿mark", "　wide space"]


def test_alignment_is_that_of_the_bytes(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "  two  blanks ")] + [(100 + i, t) for i, t in texts_of(30)]
    want = plain_alignment(rows)
    assert sum(w[1] > 0 for w in want) > 30 and any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True))
    run = lambda **more: sorted([tuple(r) for r in alignment.align_documents(table(spark, [(i, t, "s") for i, t in rows]), A, B, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()], key=str)
    assert run() == want
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 40)  # many chunks: the same counts
    hashed = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert run(digests=True) == sorted([(*w[:5], hashed(w[5]), *w[6:]) for w in want], key=str)


def test_alignment_of_nothing_and_of_a_long_text(spark):
    assert alignment.align_documents(table(spark, []), A, B).collect() == []
    (row,) = alignment.align_documents(table(spark, [(1, "river stone " * 100_000, "s")]), A, B, digests=True).collect()
    assert row["n_groups"] > 100_000 and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_temporary_tables_go(spark):
    work = common.Workspace(spark)
    kept = work.keep(spark.range(3), "x")
    work.drop(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.kept_at)


def test_a_text_of_very_many_finds(spark):
    import time

    from wavelark.llm import pii

    pii.trained(spark)
    began = time.perf_counter()
    docs = spark.createDataFrame([(1, "12," * 300_000)], "doc_id long, text string")
    (row,) = pii.spans_of(docs, ["doc_id"]).collect()
    assert row["spans"] == [] and time.perf_counter() - began < 60
    line = "a@b.cc 10.0.0.1 +49 89 123456789 ; "
    docs = spark.createDataFrame([(1, line * 20_000)], "doc_id long, text string")
    assert pii.redact(docs, ["doc_id", "text"]).first()["text"] == "[EMAIL] [IP] [PHONE] ; " * 20_000


def test_trees_as_columns_are_the_trees(spark):
    from pyspark.sql import functions as F

    from wavelark.llm import pii

    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] + x[:, 5] > 6) ^ (rng.random(400) < 0.05)).astype(float)
    forest = pii.boost(x, y, rounds=12)
    assert len(forest.trees) == 12
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
    got = rows.select("i", forest.column([F.get("f", F.lit(k)) for k in range(x.shape[1])]).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == pytest.approx([1 / (1 + math.exp(-(forest.a * forest.margin(r) + forest.b))) for r in x])


def test_overlapping_spans_are_chosen_as_by_hand(spark):
    import random

    from wavelark.llm import pii

    rnd = random.Random(4)
    rows = []
    for i in range(60):
        span = lambda p: {"start": (s := rnd.randrange(60 if i % 2 else 4000)), "rank": rnd.randrange(4), "end": s + rnd.randint(1, 12), "p": p}  # noqa: B023, E731
        rows.append((i, [span(1.0) for _ in range(rnd.randrange(4))], [span(round(rnd.random(), 1)) for _ in range(rnd.choice([0, 1, 9, 120]))]))
    kind = "array<struct<start:int,rank:int,end:int,p:double>>"
    found = {r["i"]: r["spans"] for r in pii.chosen(spark.createDataFrame(rows, f"i int, base {kind}, _wide {kind}")).collect()}
    for i, base, wide in rows:
        kept = [tuple(b.values()) for b in base]
        for w in sorted((tuple(w.values()) for w in wide), key=lambda w: (-w[3], w[0], w[1], w[2])):
            if not any(w[0] < k[2] and k[0] < w[2] for k in kept):
                kept.append(w)
        want = sorted(kept) if wide else kept
        assert [tuple(s) for s in found[i]] == want


def test_rows_become_objects_in_small_parts(spark):
    sizes = common.arrow_map(spark.range(0, 2500, 1, 1), lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows], "sum": [sum(b.column(0).to_pylist())]}), "n long, sum long").collect()
    assert sum(r["n"] for r in sizes) == 2500 and max(r["n"] for r in sizes) <= common.SLICE_ROWS < 2500
    assert sum(r["sum"] for r in sizes) == 2500 * 2499 // 2


def test_packing_starts_no_python_workers_for_its_plan(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 9) for i in range(40)], "doc_id long, start long, length long")
    pieces = common.materialize(pieces, "pieces")
    placed = packing.pack(pieces, 16)
    assert placed.count() == 40 and "ExistingRDD" not in placed._jdf.queryExecution().executedPlan().toString()
    assert packing.pack(pieces.filter("length > 99"), 16).count() == 0


def test_labels_give_groups_and_links_with_few_matches():
    # Tokens of A and of B by their bytes: 1000 that end alike, then 2 against 3, then two against one, then one alike.
    a, b = [1] * 1000 + [3, 3] + [2, 1] + [4], [1] * 1000 + [2, 2, 2] + [3] + [4]
    labels = alignment.labels_of(np.array(a), np.array(b))
    assert len(labels) == 1000 + 4 + 2 + 1 and len(alignment.SPAN.findall(labels)) == 4
    a_counts, b_counts, i, j = alignment.token_groups(labels)
    assert a_counts.tolist() == [1] * 1000 + [2, 2, 1] and b_counts.tolist() == [1] * 1000 + [3, 1, 1]
    assert list(zip(i.tolist(), j.tolist(), strict=True))[1000:] == [(1000, 1000), (1000, 1001), (1001, 1001), (1001, 1002), (1002, 1003), (1003, 1003), (1004, 1004)]
    assert alignment.told(np.array([7, 123456]), np.array([50]), np.array([2]), np.array([1])) == b"7,123456|50"


def test_long_runs_of_blanks_are_seen_wherever_they_begin():
    for start in (0, 1, 99, 100, 4321):
        for n, want in ((4999, False), (5000, True), (7000, True)):
            text = "x" * start + (" \n\t" * n)[:n] + "y" * 3000
            assert packing.has_long_blank(text) is want is bool(packing.LONG_BLANK.search(text))
    assert not packing.has_long_blank((" " * 99 + "x") * 100) and not packing.has_long_blank(("x" * 99 + " ") * 100)
