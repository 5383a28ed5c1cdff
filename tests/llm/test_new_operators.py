"""Prefix trie, ranked search and URL filter against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from logloom.llm import ranked, trie, urls

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# prefix trie

def plain_trie(rows):
    turns, members, whole, kids, sums = defaultdict(list), defaultdict(list), {}, defaultdict(list), {}
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        below = [sums[k] for k in kids[node]]
        sums[node] = ((len(members[node]) - 1) * words + sum(s for s, _ in below), sum(n for _, n in below) or 1)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), sums[node][1],
                    sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same_trie(spark, rows, schema=CONV, more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], schema)
    got = rows_of(trie.prefix_trie(df))
    key = lambda r: (r[1], r[0], r[7])
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "GRAIN", 3)  # conversations cross the borders of pieces
    monkeypatch.setattr(trie, "IDS", 4)  # end lists too
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "c\td\x0be"]))
            for c in range(-25, 60) if rng.random() < 0.9 for t in range(rng.randint(1, 7))]
    same_trie(spark, rows)


def test_trie_of_odd_conversations(spark):
    long = " ".join(["w"] * 200_000)
    rows = [(c, None, None, None) for c in range(100, 130)] + [(None, 1, "user", "lost"), (3, 5, "user", long), (3, 5, "user", "b"), (3, 5, "user", "b"),
                                                              (3, None, "system", "x"), (23, 1, "user", "alone")]
    got = same_trie(spark, rows, CONV + ", depth long, p1 string, c string", (7, "p", "c"))
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_trie_of_many_equal_conversations(spark):
    """Copies, and conversations that end where others go on."""
    same_trie(spark, [(c, t, "user", f"t{t}") for c in range(0, 9000, 5) for t in range(1 + c % 3)])


def test_trie_of_an_empty_table(spark):
    assert rows_of(trie.prefix_trie(spark.createDataFrame([], CONV))) == []


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_search(docs, items, k=20):
    counts = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms, df, out = len(counts), sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c), []
    for item, text in items:
        wanted, found = Counter(TERM.findall((text or "").translate(SMALL))), []
        for i, c, n in counts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in wanted.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def by_place(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("leaf, batch", [(32, 4096), (2, 50)])
def test_search_equals_the_plain_one(spark, monkeypatch, leaf, batch):
    monkeypatch.setattr(ranked, "LEAF", leaf)
    monkeypatch.setattr(ranked, "BATCH", batch)
    rng = random.Random(leaf)
    words = [f"w{i}" for i in range(60)] + ["É", "ß9", "A-b"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.1)), len(words) - 1)] for _ in range(n))
    docs = [(i, draw(rng.randint(0, 30))) for i in range(600)] + [(None, "w1 w2"), (7, "w1"), (7, "w1"), (8, None), (9, "?!")]
    items = [(i, draw(rng.randint(1, 9))) for i in range(40)] + [(None, "w1 w1"), (1, "w2"), (1, "w2"), (2, None), (3, "unknown")]
    got = rows_of(ranked.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).select("item_id", "rank", "doc_id", "score"))
    assert by_place(got) == by_place(plain_search(docs, items))


def test_search_prunes_pairs(spark):
    """With k-th scores known, most documents are never scored."""
    rng = random.Random(5)
    docs = [Counter(f"{lang}{int(rng.expovariate(0.05))}" for _ in range(40)) for lang in "abcd" for _ in range(1000)]
    terms = sorted({t for d in docs for t in d})
    number, df = {t: i for i, t in enumerate(terms)}, Counter(t for d in docs for t in d)
    vectors = [{number[t]: ranked.weight(len(docs), df[t]) for t in rng.choice(docs)} for _ in range(50)]
    import numpy as np
    sizes = np.array([len(d) for d in docs])
    ids = np.array([number[t] for d in docs for t in d])
    tfs = np.array([c for d in docs for c in d.values()])
    tree = ranked.ItemTree(vectors, np.array([df[t] for t in terms]))
    best = ranked.Best(50, 20, np.zeros(50, np.int64))
    scored = ranked.dual_search(tree, np.full(len(docs), 40), np.concatenate([[0], np.cumsum(sizes)]), ids, tfs, np.arange(len(docs)),
                                np.zeros(len(docs), bool), len(docs), 40 * len(docs), len(terms), best)
    assert scored < 0.4 * 50 * len(docs)


def test_search_in_blocks_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(ranked, "SLICE", 64)
    docs = [(1, "Alpha beta " * 5000), (2, "x" * 1000 + " beta"), (3, "gamma," * 40), (4, "beta")]
    items = [(i, t) for i, t in enumerate(["alpha", "BETA beta", "gamma beta", "x" * 1000, "delta"])]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS + ", n long, ids string")
    got = rows_of(ranked.search(frame, spark.createDataFrame([(*i, 5, 6) for i in items], ITEMS + ", rank int, score long"), k=2)
                  .select("item_id", "rank", "doc_id", "score"))
    assert by_place(got) == by_place(plain_search(docs, items, 2))


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    assert rows_of(ranked.search(none, one.toDF("item_id", "text"))) == []
    assert rows_of(ranked.search(one, none.toDF("item_id", "text"))) == []


def test_sums_beyond_doubles_stay_exact():
    import numpy as np
    assert ranked.ItemTree([{0: 1 << 40}], np.array([1])).kind is np.int64
    assert ranked._product_div(np.array([1 << 40]), 1 << 30, 3 << 10).tolist() == [(1 << 70) // (3 << 10)]


# URL filter

def judged(spark, found, rules=urls.RULES, schema="page_id long, url string"):
    return {r["page_id"]: r for r in urls.judge(spark.createDataFrame(found, schema), rules=rules).collect()}


def test_host_path_and_rule(spark):
    cases = ["https://A.Example.ORG/es/x?y", "http://example.org/en/12#a", "http://notexample.org/es/", "http://org/", "http://org", None, "",
             "no scheme/org/", "x://b.com/fr/é?de", "x://com/de/", "a://com?/fr/", "a://c.net/p://q/", "http://example.org/En/1"]
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
            ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("org", "", None, None), ("", "", None, None), ("", "", None, None),
            ("", "", None, None), ("b.com", "/fr/é", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("com", "", None, None),
            ("c.net", "/p://q/", None, None), ("example.org", "/En/1", "org/", "allow")]
    got = judged(spark, list(enumerate(cases)))
    for i, (host, path, rule, verdict) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block") and r["score"] is not None


def plain_scores(train, scored, order=urls.ORDER):
    """The same model from plain dictionaries, over the whole list of grams."""
    def grams(t):
        chars = urls.START * order + t + urls.END
        return [chars[i:i + order + 1] for i in range(len(t) + 1)]

    alphabet = {g[-1] for t in [*train[0], *train[1], *scored] for g in grams(t)}
    ratio = defaultdict(float)
    probs = []
    for texts in train:
        n = [Counter(g[order - k:] for t in texts for g in grams(t)) for k in range(order + 1)]
        all_, kinds = [Counter() for _ in n], [Counter() for _ in n]
        for k in range(order + 1):
            for s, x in n[k].items():
                all_[k][s[:-1]] += x
                kinds[k][s[:-1]] += 1

        def prob(g, n=n, all_=all_, kinds=kinds):
            p = 1 / len(alphabet)
            for k in range(order + 1):
                s = g[order - k:]
                total = all_[k][s[:-1]] + kinds[k][s[:-1]]
                p = (n[k][s] + kinds[k][s[:-1]] * p) / total if total else p
            return p
        probs.append(prob)
    for t in scored:
        ratio[t] = sum(round((math.log(probs[0](g)) - math.log(probs[1](g))) * 1e6) for g in grams(t)) // (len(t) + 1)
    return ratio


def made_urls(rng, n):
    words = {"allow": ["news", "garden", "libros", "musée"], "block": ["casino", "pills", "bet365", "win"]}
    for i in range(n):
        kind = rng.choice(["allow", "block"])
        word = rng.choice(words[kind])
        yield i, kind, f"https://{word}{rng.randint(0, 99)}.{'good.org' if kind == 'allow' else 'bad.org'}/{word}/{i}"


RULES = (urls.Rule("allow", "good.org", "/"), urls.Rule("block", "bad.org", "/"))


def test_scores_equal_a_plain_model(spark):
    made = list(made_urls(random.Random(1), 400))
    rest = [(1000 + i, f"http://{w}.net/{w}/{i}") for i, w in enumerate(["garden", "casino", "bet365", "libros", "q", "日本"])]
    got = judged(spark, [(i, u) for i, _, u in made] + rest + [(2000, None), (2001, "news" * 50_000)], RULES)
    text = lambda u: u.split("://")[1] if u and "://" in u else u or ""
    train = [[text(u) for _, kind, u in made if kind == k and zlib.crc32(text(u).encode()) % urls.HOLD_OUT] for k in ("allow", "block")]
    held = [text(u) for _, _, u in made if not zlib.crc32(text(u).encode()) % urls.HOLD_OUT]
    rest += [(2000, None), (2001, "news" * 50_000)]
    want = plain_scores(train, [text(u) for _, u in rest] + held)
    for i, u in rest:
        assert abs(got[i]["score"] - want[text(u)]) <= 1
    assert [got[1000 + i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"]


def test_held_out_urls_are_told_apart(spark):
    """Ruled URLs of one half, without their rules, judged by what the other half taught."""
    made = list(made_urls(random.Random(2), 1000))
    hidden = [(i, u.replace("good.org", "x.net").replace("bad.org", "x.net")) for i, _, u in made[:500]]
    got = judged(spark, hidden + [(i, u) for i, _, u in made[500:]], RULES)
    assert sum(got[i]["verdict"] == kind for i, kind, _ in made[:500]) > 0.97 * 500


def test_threshold_against_all_cuts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["allow", "block"]), int(rng.gauss(0, 4000))) for _ in range(300)]
    rows = [(kind, s + (3000 if kind == "allow" else -3000)) for kind, s in rows]
    least = urls.threshold(spark.createDataFrame(rows, "label string, score long")).first()["least"]
    n = Counter(kind for kind, _ in rows)

    def gain(cut):
        return sum((s // 1000 * 1000 >= cut) * (1 / n["allow"] if kind == "allow" else -1 / n["block"]) for kind, s in rows)
    assert gain(least) == pytest.approx(max(gain(c * 1000) for c in range(-20, 21)))


def test_repeats_clashing_columns_and_nothing_to_learn(spark):
    frame = [(1, "http://a.net/x", "u", "v"), (1, "http://a.net/x", "u", "v"), (2, None, None, None)]
    out = urls.judge(spark.createDataFrame(frame, "page_id long, url string, text string, Rule string"))
    assert sorted(out.columns) == ["host", "page_id", "path", "rule", "score", "text", "url", "verdict"]
    assert [(r["verdict"], r["score"]) for r in out.collect()] == [("allow", 0)] * 3
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
