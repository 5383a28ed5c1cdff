"""The operators on small tables: brute force, nulls, empty and repeated rows, clashing names."""

import math
import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, decontam, lines, minhash, packing, pages, quality, queries, sharding, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _f string, node int, `key` string, shard int, score string"


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvw") + rng.choice("xyz") for _ in range(n)]


def table(spark, tmp_path, rows, schema=DOCS):
    """Rows are (id, text), filled up with nulls and clashing columns, as a Parquet table."""
    width = schema.count(",") + 1
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:4]):
        near = list(w)
        near[30] = "changed"
        rows += [(10 + i, " ".join(near)), (20 + i, " ".join(w).upper())]
    rows += [(3, rows[3][1]), (None, rows[0][1]), (None, None), (40, ""), (41, "  \n "), (42, "???"), (43, "???"), (44, "one two")]
    return rows


def shingle_set(text):
    w = minhash.words_of(text)
    if not w:
        return {text.strip()} if text and text.strip() else set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates_against_brute_force(spark, tmp_path, texts):
    docs = table(spark, tmp_path, texts)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) and sum(r["kept"] for r in got) == len({(r["class_id"], r["id"] if r["class_size"] == 1 else 0) for r in got})
    sets = [shingle_set(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    sizes = sorted(group.count(g) for g in group)
    assert sorted(r["class_size"] for r in got) == sizes
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_of_near_copies_in_chunks(spark, tmp_path):
    rng = random.Random(9)
    w = words(rng, 80)
    rows = []
    for i in range(60):
        own = list(w)
        own[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(own)))
    docs = table(spark, tmp_path, rows)
    assert minhash.near_duplicates(docs).filter("kept").count() == 1


def test_lines(spark, tmp_path):
    rng = random.Random(2)
    long = " ".join(words(rng, 40))
    rows = [(1, f"{long}\nshort line\nunique words stand here for once"), (2, f"another text of its own kind\n{long.upper()}!"),
            (3, long), (4, long.replace(long.split()[20], "qqqq", 1)), (None, None), (5, ""), (6, "short line"), (2, "short line\n" + long)]
    docs = table(spark, tmp_path, rows)
    out = lines.dedup_lines(docs)
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in out.collect()}
    assert got[1, rows[0][1]] == 0 and got[2, "another text of its own kind"] == 1 and got[3, ""] == 1 and got[2, "short line"] == 1
    assert got[None, None] == 0 and got[5, ""] == 0 and got[6, "short line"] == 0 and set(docs.columns) < set(out.columns)
    kept = lines.drop_copied(docs)
    assert kept.columns == docs.columns and 3 not in [r[0] for r in kept.collect()] and kept.count() >= 6
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_no_fuzzy_copies_are_left_among_real_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = {lines.normalised(x) for r in lines.dedup_lines(docs).collect() for x in (r["text"] or "").split("\n")}
    tall = sorted((x for x in left if 5 <= len(x.split()) < 60), key=len)
    for low, high in ((5, 12), (12, 30), (30, 60)):
        part = [x for x in tall if low <= len(x.split()) < high]
        pairs = sum(lines.alike(x, y, 0.8) for i, x in enumerate(part) for y in part[i + 1:i + 1 + sum(len(z) <= 1.25 * len(x) for z in part[i + 1:])])
        assert part and pairs <= 0.002 * len(part), (low, pairs, len(part))


def test_one_changed_word_of_a_short_line(spark, tmp_path):
    line = "heti orwhea to thha reea en onshnt edre that"
    docs = table(spark, tmp_path, [(1, line), (2, line.replace("onshnt", "edou")), (3, "wholly other words stand here for themselves today")])
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_short_lines_and_copied_documents_go(spark, tmp_path):
    text = "all rights reserved\none two three four five six seven\n---"
    docs = table(spark, tmp_path, [(1, text), (2, text), (3, "All rights reserved.\nother words of a third document"), (4, "\n\n")])
    cut = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, min_words=1).collect()}
    assert cut == {1: text, 2: "", 3: "other words of a third document", 4: "\n\n"}
    assert [r["doc_id"] for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == [1, 3, 4]


def test_decontamination(spark, tmp_path):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 30)) + ". " + " ".join(words(rng, 6)) + ".") for i in range(20)] + [(99, None), (98, "")]
    other = lambda n: " ".join(words(rng, n))
    rows = [(1, other(500)), (2, other(200) + " " + items[4][1] + " " + other(200)), (3, items[7][1]), (3, items[7][1]), (None, items[0][1]),
            (5, None), (6, ""), (7, items[5][1].split(".")[0])]
    docs, bench = table(spark, tmp_path, rows), table(spark, tmp_path, items, "item_id long, text string, node string")
    got = decontam.contamination(docs, bench).select("id", "item_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, 4), (3, 7), (3, 7), (None, 0)], key=str)
    assert decontam.contamination(docs.limit(0), bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).count() == 0


def test_toxicity(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 60)
        if i % 4 == 0:
            for k in rng.sample(range(60), 5):
                w[k] = rng.choice(["nastyword", "viletalk", "meanthing"])
        rows.append((i, " ".join(w)))
        labels.append((i, None if i == 7 else 1, int(i % 4 == 0)))
    rows += [(None, None), (900, ""), (3, rows[3][1])]
    docs = table(spark, tmp_path, rows)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score_documents(docs, model).withColumn("out", toxicity.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert len(held) > 20 and all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held)
    bad = next(r for r in held if r["doc_id"] % 4 == 0)
    assert any(w in bad["text"][bad["passage_starts"][0]:bad["passage_ends"][0]] for w in ("nastyword", "viletalk", "meanthing"))
    assert toxicity.fit(docs, marks.limit(0)).base == 0.0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_sharding(spark, tmp_path):
    rows = [(i % 50, f"text {i % 60} é") for i in range(400)] + [(None, None), (None, "")]
    out = sharding.shard_documents(table(spark, tmp_path, rows), 7).collect()
    assert sorted((r["doc_id"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted(
        (i, zlib.crc32(t.encode())) for i, t in rows if i is not None)
    sizes = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {r["size"] for r in out if r["doc_id"] is None} == {16}
    mixed = sharding.shard_rows(table(spark, tmp_path, rows), 7)
    assert mixed.columns[:2] == ["doc_id", "text"] and mixed.count() == len(rows)
    assert sharding.shard_documents(table(spark, tmp_path, []), 7).count() == 0


def test_packing(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(1, 300)))) for i in range(60)] + [(None, None), (61, ""), (3, "a b"), (3, "a b")]
    cut, placed = packing.pack_documents(table(spark, tmp_path, rows), queries.TOKENIZER, 256)
    got = placed.collect()
    enc = packing.encoder(queries.TOKENIZER)
    want = {}
    for i, t in rows:
        ids = next(enc.encode([t or ""])) + bytes(4)
        want[i] = want.get(i, 0) + len(ids) // 4
    have = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
        assert r["length"] == 256 or r["piece"] == 0
    assert have == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in cut.collect())
    _, none = packing.pack_documents(table(spark, tmp_path, []), queries.TOKENIZER)
    assert none.count() == 0


def test_top_k(spark, tmp_path):
    rng = random.Random(7)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(230)]
    rows += [(i, rows[5][1]) for i in range(230, 260)] + [(300, None), (301, [None] * 8), (302, [float("nan")] + [0.0] * 7), (None, vec()), (303, [1.0])]
    out = topk.top_k(table(spark, tmp_path, rows, "vec_id long, embedding array<float>, q int, id string"), F.col("vec_id") % 100 == 0).collect()
    import numpy as np
    v = {i: np.floor(np.array(x, np.float32).astype(float) * 1024).astype(int) for i, x in rows[:260]}
    for q in (0, 100, 200):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in best]
    assert len(out) == 30
    assert topk.top_k(table(spark, tmp_path, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_quality_model_against_a_plain_one(spark, tmp_path):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "them", "then", "hen", "ten"]) for _ in range(30)) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, "zzqx qqqx xzzq " * 9, "en"), (101, None, None), (None, "the hen", "en"), (102, "", "xx")]
    docs = table(spark, tmp_path, rows)
    out = {r["doc_id"]: r for r in quality.judge(docs, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).collect()}
    assert not out[100]["kept"] and out[101]["perplexity"] is None and not out[102]["kept"] and sum(out[i]["kept"] for i in range(40)) >= 38
    model = {r["gram"]: (r["p"], r["gamma"]) for r in quality.fit(docs.filter("doc_id < 40").select("text"), 3).collect()}
    nan = float("nan")
    known = {g: (nan if p is None else p, nan if w is None else w) for g, (p, w) in model.items()}
    chars = {g for g, (p, _) in model.items() if len(g) == 1 and p is not None}
    for ctx in ("", "t", "th", "he", quality.START + "t"):
        total = sum(_p(known, ctx, c) for c in chars)
        unseen = 1 / (len(chars) + 1)  # what all contexts leave to a new character
        for k in range(len(ctx) + 1):
            unseen *= known[ctx[k:]][1]
        assert abs(total + unseen - 1) < 1e-9
    found = [r["perplexity"] for r in quality.perplexities(docs, quality.fit(docs.filter("doc_id < 40").select("text"), 3), 3).collect()]
    texts = [t for _, t, _ in rows]
    unseen = 1 / (len(chars) + 1)  # the weight of the empty context is counted on the way
    plain = []
    for t in texts:
        marked = quality.running(t, 3)
        plain.append(math.exp(-quality.log_probability(marked, known, unseen, 3) / (len(marked) - 2)) if marked else None)
    assert sorted(x for x in found if x is not None) == pytest.approx(sorted(x for x in plain if x is not None), rel=1e-9) and sum(x is None for x in found) == 2
    none = quality.judge(docs, spark.createDataFrame([], "doc_id long"))
    assert none.filter("kept").count() == 0 and quality.judge(docs.limit(0), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_quality_sees_repeated_words_and_long_texts(spark, tmp_path):
    """A good text whose words are repeated or run together backwards is told from the text itself."""
    rng = random.Random(9)
    words = ["the", "river", "ran", "down", "to", "sea", "and", "slowly", "past", "hills"]
    good = [" ".join(words[(i + j) % 10] for j in range(40)) for i in range(10) for _ in range(3)]
    mixed = " ".join(rng.sample(words * 4, 40))
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, "the " * 40, "en"), (101, mixed, "en"), (102, good[0], "en"), (103, good[0] + " and " + good[0] * 300, "en")]
    out = {r["doc_id"]: r for r in quality.judge(table(spark, tmp_path, rows), spark.createDataFrame([(i,) for i in range(30)], "doc_id long")).collect()}
    assert not out[100]["kept"] and not out[101]["kept"] and out[102]["kept"]
    assert out[100]["perplexity"] > 2 * out[102]["perplexity"] and out[103]["perplexity"] < 2 * out[102]["perplexity"]


def _p(known, ctx, c):
    weight = 1.0
    for k in range(len(ctx) + 1):
        p = known.get(ctx[k:] + c, (float("nan"),))[0]
        if p == p:
            return weight * p
        weight *= known[ctx[k:]][1]
    return 0.0


def test_chat_table(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<|im_end|>\\"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "b<|im_end|>\\")]
    talks = table(spark, tmp_path, rows, "conv_id long, turn long, role string, text string, id string, ts int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(talks)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 24 and got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_conversations(talks.limit(0))).count() == 0


def test_page_table(spark, tmp_path):
    page = "<body><nav><a href=x>m</a></nav><article><h1>T</h1><p>long text of the page</p></article><footer>f</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "w", ""), (1, "u", page)]
    site = table(spark, tmp_path, rows, "page_id long, url string, html string, text string")
    got = [r["text"] for r in pages.extract(site, pages.fit(site)).orderBy("page_id").collect()]
    assert sorted(got) == ["", "", "T\n\nlong text of the page", "T\n\nlong text of the page"]
    assert pages.extract(site.limit(0), pages.fit(site.limit(0))).count() == 0
