"""Operators on single texts and lines, against plain versions of the same."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelark.llm import bpe, common, langid, linededup, packing, pii, quality, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
TRICKY = [
    None, "", " ", "\n\n", "A", "don't STOP now, it's 12,345.67 o'clock!", "Ünïcödé ΣΑΣ ﬁ 𝔘 café café İ", "<|startoftext|>x <|endoftext|>", "a\x01b\x1cc d e",
    "x" * 700 + " " + "ab" * 300, "日本語のテキスト 你好", "line\r\nline\nLINE \n", "👩‍👩‍👧 ok", "mail me: a.b+c@d-e.co.uk or +49 (170) 123-4567, 192.168.001.254; 4111 1111 1111 1111", "1.2.3.4.5 1234567890123456789012 +1 2 999.1.1.1 x@y@z.com",
]
#: Names that operators might use for themselves.
CLASH = ["_kept", "key", "n", "path", "salt", "label", "h1", "_text", "_digit", "ids", "lost", "spans", "pos"]


def docs_of(spark, texts, ids=None, source=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", source[k] if source else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.select("*", *[F.lit("x").alias(c) for c in CLASH])


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(2)
    texts = TRICKY + ["".join(rnd.choice("abcdefghij'ABC ,.0189éßΣ\n") for _ in range(rnd.randint(1, 300))) for _ in range(150)]
    docs = docs_of(spark, texts).select("doc_id", "text").union(real(spark).select(F.col("doc_id") + 10_000, "text"))
    got = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()}
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == ids, r["text"]
        assert got[r["doc_id"]]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_the_tree_merges_as_a_scan_would():
    rnd = random.Random(5)
    merges = {}
    for rank in range(60):
        merges.setdefault(rnd.randrange(12) << bpe.ID_BITS | rnd.randrange(12), rank << bpe.ID_BITS | rnd.randrange(12))
    for _ in range(300):
        word = [rnd.randrange(12) for _ in range(rnd.randint(1, 40))]
        want = list(word)
        while True:
            pairs = [(merges[k], i) for i in range(len(want) - 1) if (k := want[i] << bpe.ID_BITS | want[i + 1]) in merges]
            if not pairs:
                break
            made, i = min(pairs)
            want[i : i + 2] = [made & ((1 << bpe.ID_BITS) - 1)]
        assert bpe.merge_word(list(word), merges) == want


def luhn(d):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found)


def test_personal_data(spark):
    rnd = random.Random(7)
    odd = ["".join(rnd.choice("ab1234567890.@+-() \x01") for _ in range(rnd.randint(5, 120))) for _ in range(400)]
    docs = docs_of(spark, TRICKY + odd).select("doc_id", "text", *CLASH).unionByName(real(spark).select(F.col("doc_id") + 10_000, "text"), allowMissingColumns=True)
    found = pii.spans_of(docs, ["doc_id"])
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "Arrow" not in plan
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = base_spans(r["text"] or "")
        assert [(s["start"], s["rank"], s["end"]) for s in r["base"]] == [x[:3] for x in want], r["text"]
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and {(s["start"], s["rank"], s["end"]) for s in r["base"]} <= {(s["start"], s["rank"], s["end"]) for s in r["spans"]}


def test_trees_choose_written_out_data_and_redaction_hides_it(spark):
    texts = ["please write to: anna.lee (at) mill.org, thanks", "phone: (201) 555-0134, call", "meet at noon. then go", "version: 10 . 20 . 300 . 4", "card 4111 1111 1111 1111 and a@b.co", None, ""]
    out = [r["text"] for r in pii.redact(docs_of(spark, texts), ["doc_id", "text"]).orderBy("doc_id").collect()]
    assert out[0] == "please write to: [EMAIL], thanks" and "[PHONE]" in out[1] and out[2:4] == texts[2:4]
    assert out[4] == "card [CARD] and [EMAIL]" and out[5] is None and out[6] == ""
    model = pii.boost(np.array([[i % 7, i % 2] for i in range(90)], float), np.array([float(i % 2) for i in range(90)]))
    p = lambda row: 1 / (1 + np.exp(-(model.a * model.margin(np.array(row)) + model.b)))
    assert p([3.0, 1.0]) >= model.threshold > p([3.0, 0.0])


def test_toxicity_on_held_out_texts(spark):
    rnd = random.Random(3)
    plain, vile = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vilest", "hateful", "scumbag", "wretch"]
    texts, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [rnd.choice(plain) for _ in range(30)] + [rnd.choice(vile) for _ in range(4 * bad)]
        rnd.shuffle(words)
        texts.append(" ".join(words))
        if i < 600:
            labels.append((i, int(rnd.random() < 0.5), int(bad)))
    docs = docs_of(spark, [*texts, None, ""])
    got = toxicity.classify(docs, spark.createDataFrame([*labels, (601, None, 1)], "doc_id long, quality int, toxic int"), ["doc_id"]).orderBy("doc_id").collect()
    assert all(r["is_toxic"] == (r["doc_id"] % 5 == 0) for r in got if 600 <= r["doc_id"] < 900)
    assert not got[900]["is_toxic"] and got[900]["p_toxic"] == got[901]["p_toxic"] and all(0 <= r["p_quality"] <= 1 for r in got)
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), ["doc_id"])
    assert none.filter("is_toxic").isEmpty() and none.count() == 902


def test_toxicity_of_documents_whose_label_was_not_learned(spark):
    """A word's weight has to be learned, so this takes the larger table; copies of a text have the same half."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id").persist()
    out = toxicity.classify(docs, labels.filter("h % 2 = 0"), ["doc_id"]).join(labels.filter("h % 2 <> 0"), "doc_id")
    got = {(r["toxic"], r["is_toxic"]): r["count"] for r in out.groupBy("toxic", "is_toxic").count().collect()}
    n = lambda y, said: got.get((y, said), 0)
    assert n(1, True) >= 0.9 * (n(1, True) + n(1, False)), got
    assert n(0, True) <= 0.02 * (n(0, True) + n(0, False)), got


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    judged = [r for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    assert np.mean([r["lang_pred"] == r["lang"] for r in judged]) > 0.95
    odd = docs_of(spark, [None, "", "12 345 !", "plain words here"], ids=[1, 1, None, 4])
    got = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 4
    model = langid.fit(docs.select("text", "lang"))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[None]["lang_pred"] == "und" and got[4]["lang_pred"] in model.langs and 0 <= got[4]["score"] <= 1
    assert (model.word("zzqx") == model.word("zzqx")).all() and "zzqx" not in model.words


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_lines(spark):
    rnd = random.Random(4)
    line = lambda k: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(k))
    shared = "Subscribe to  our NEWSLETTER\ttoday"
    texts = [f"{line(30)}\n{shared if i % 2 else shared.lower()}\n{line(30)}" for i in range(24)] + [f"{shared}\nshort tail {i}" for i in range(4)] + [*TRICKY, "a b c a b c " * 40, "# x\n# x\n\n# x"]
    hosts = ["h"] * 28 + [None] * (len(texts) - 28)
    docs = docs_of(spark, texts, source=hosts)
    judged = quality.judge(docs, min_docs=20, min_share=0.5)
    assert "Python" not in judged._jdf.queryExecution().toString()
    rows = judged.orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain_counts(t), t
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    n = len("subscribe to our newsletter today")
    assert [r["lost_chars"] for r in rows[:28]] == [0] + [n] * 27 and all(r["lost_chars"] == 0 for r in rows[28:])
    assert all(r["kept"] == (not r["base_failed"]) for r in rows[:24])
    kept = {r["doc_id"]: r["text"] for r in quality.remove_lines(docs, 20, 0.5).collect()}
    assert kept[0] == texts[0] and kept[5] == "\n".join(x for i, x in enumerate(texts[5].split("\n")) if i != 1) and kept[25] == "short tail 1" and kept[28] is None
    assert quality.judge(docs.limit(0)).count() == 0


def drop_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(i, len(xs := (t or "").split("\n")), kept := [x for x in xs if key(x) not in gone or gone[key(x)] == i], len(xs) - len(kept)) for i, t in rows]


def test_line_dedup(spark):
    a, b = "This passage is repeated in very many of the documents.", "ünïcode line of forty code points or more, yes"
    texts = [f"{a}\nx{i}" for i in range(6)] + [f"  {a.upper()}\r\n{b}\n{b}" for _ in range(5)] + [*TRICKY, "y\n" * 3000 + a, f"{a}\nlast", f"{a}\nnone"]
    ids = [*range(len(texts) - 2), 3, None]
    rows = list(zip(ids, texts, strict=True))
    got = Counter((r["doc_id"], r["n_lines"], r["text"], r["n_dropped"]) for r in linededup.dedup_lines(docs_of(spark, texts, ids)).collect())
    assert got == Counter((i, n, "\n".join(kept), d) for i, n, kept, d in drop_lines(rows))
    assert linededup.dedup_lines(docs_of(spark, texts, ids).limit(0)).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs_of(spark, [*TRICKY, "many words " * 3000, "twin", "twin"], ids=[*range(len(TRICKY) + 1), 5, None]).select("doc_id", "text").union(real(spark).select(F.col("doc_id") + 100, "text"))
    rows = packing.pack_documents(docs, path).collect()
    pieces = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    ids = packing.token_pieces(docs, path).collect()
    import zlib

    assert pieces == {(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in ids} and len(rows) == len(ids)
    whole, _, _ = packing._encoders(path)
    by_doc = defaultdict(list)
    for r in ids:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            by_doc[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for r in docs.collect():
        if r["doc_id"] in by_doc:
            assert sum((x for _, x in sorted(by_doc[r["doc_id"]])), []) == [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(r["length"] for r in rows) / (1024 * len(at)) > 0.98
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_least_squares_never_packs_more_than_there_is():
    rnd = np.random.default_rng(1)
    hist = {int(k): int(v) for k, v in zip(rnd.choice(np.arange(1, 65), 30, replace=False), rnd.integers(1, 500, 30), strict=True)}
    slots = packing.plan(hist, 64)
    for length, n in hist.items():
        parts = sorted((low, high) for k, low, high, _, _ in slots if k == length)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    combos = packing.fillings(np.array([16, 32, 48]), 64)
    x = packing.solve_counts(combos, np.bincount([16, 16, 32, 48], minlength=65).astype(float))
    assert (x >= 0).all()


def test_shards(spark):
    docs = docs_of(spark, [*TRICKY, *[f"text {i}" for i in range(3000)], "again"], ids=[*range(len(TRICKY) + 3000), 7])
    out = sharding.assign_shards(docs, [1.0] * 16)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.4 * len(rows) / 16
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and 0.03 < np.mean([r["grown_shard"] == 16 for r in rows]) < 0.09
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1 and next(r["size"] for r in rows if r["doc_id"] == 0) == 1
    assert {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.repartition(7), [1.0] * 16).collect()} == {r["doc_id"]: r["shard"] for r in rows}
    heavy = Counter(r["shard"] for r in sharding.assign_shards(docs, [3.0, 1.0]).collect())
    assert 0.7 < heavy[0] / len(rows) < 0.8
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1.0, 0.0])
    assert sharding.assign_shards(docs.limit(0), [1.0]).count() == 0


def test_digests_and_shared_folder(spark):
    got = {r["doc_id"]: r for r in queries.op10_line_dedup(spark, SF).collect()}
    want = {i: (n, d, hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, n, kept, d in drop_lines([(r["doc_id"], r["text"]) for r in real(spark).collect()])}
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == want
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
