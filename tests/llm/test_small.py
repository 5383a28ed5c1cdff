"""Single-machine parts against brute force, and round trips."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import chat, decontam, graph, lines, minhash, packing, pages, quality, sharding, topk, toxicity
from logloom.llm.common import words_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MIXED = st.text(alphabet=st.sampled_from(list("ab1é'.,!\n \t\r\x1c 　|<endoftext>中👍")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_chunk_encoding_equals_the_tokenizer(text):
    enc = packing.encoder(TOKENIZER)
    ids = np.frombuffer(next(enc.encode([text])), "<u4").tolist()
    assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids


def squares(counts):
    return sum(n * n for n in counts.values())


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_takes_the_smallest_sum(seed):
    rng, limit = random.Random(seed), 12
    lengths = [rng.randint(1, limit) for _ in range(300)]
    seq, off = packing.sum_of_squares(np.array(lengths), limit)
    gaps, counts = {}, {}
    for n, s, o in zip(lengths, seq.tolist(), off.tolist()):
        def after(gap):
            c = dict(counts)
            if gap != limit:
                c[gap] -= 1
            if gap > n:
                c[gap - n] = c.get(gap - n, 0) + 1
            return squares(c)

        taken = gaps.get(s, limit)
        assert o == limit - taken and taken >= n
        choices = [g for g, k in counts.items() if k and g >= n] + [limit]
        assert after(taken) == min(map(after, choices))
        if taken != limit:
            counts[taken] -= 1
        gaps[s] = taken - n
        if gaps[s]:
            counts[gaps[s]] = counts.get(gaps[s], 0) + 1


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    x = np.clip(rng.exponential(400, 20_000).astype(int) + 1, 1, 2047)
    x = x[packing.placing_order(x, 0)]
    seq, _ = packing.sum_of_squares(x, 2048)
    assert seq.max() + 1 <= 1.02 * math.ceil(x.sum() / 2048)


def test_hypergeometric_mean_and_matrix_sums():
    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert min(draws) >= 0 and abs(sum(draws) / len(draws) - 6) < 0.15
    var = sum((d - 6) ** 2 for d in draws) / len(draws)
    assert abs(var - 20 * .3 * .7 * 80 / 99) < 0.35
    m = sharding.communication_matrix([5, 0, 1000, 17], [256, 256, 255, 255], 1)
    assert [sum(r) for r in m] == [5, 0, 1000, 17] and [sum(c) for c in zip(*m)] == [256, 256, 255, 255]
    assert sharding.hypergeometric(rng, 10 ** 12, 39 * 10 ** 12, 10 ** 9) == pytest.approx(25_000_000, rel=1e-2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-3, 3).map(lambda x: round(x, 2)), max_size=25))
def test_maximal_segments_are_the_recursive_ones(xs):
    def brute(lo, hi):
        best = max(((sum(xs[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        return brute(lo, best[3]) + [best[3:]] + brute(best[4], hi)

    got = toxicity.maximal_segments(np.array(xs, float))
    assert sum(s for *_, s in got) == pytest.approx(sum(sum(xs[a:b]) for a, b in brute(0, len(xs))), abs=1e-6)
    assert all(s > 0 for *_, s in got) and all(a[1] < b[0] for a, b in zip(got, got[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    assert lines.edit_distance(a, b) == row[-1]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 400).astype(float), rng.integers(1, 6, 400).astype(float)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    same = (minhash.signature(e, wa, 2000) == minhash.signature(e, wb, 2000)).mean()
    assert abs(same - true) < 0.05
    flat = np.ones(400)
    same = (minhash.signature(e[:300], flat[:300], 2000) == minhash.signature(e[100:], flat[100:], 2000)).mean()
    assert abs(same - 0.5) < 0.05
    assert (minhash.signature(e[:1], np.array([0.3])) != 0).all()


def test_forest_links_what_is_alike():
    like = np.array([[1, .9, .1, 0], [.9, 1, .7, 0], [.1, .7, 1, 0], [0, 0, 0, 1]], float)
    assert {tuple(sorted(e)) for e in graph.forest(like, 0.6, np.full(4, -1))} == {(0, 1), (1, 2)}
    assert graph.forest(like, 0.6, np.array([7, 7, -1, -1])) in ([(1, 2)], [(2, 1)])


@pytest.mark.parametrize("seed", range(4))
def test_block_max_wand_finds_what_a_full_scan_finds(seed):
    rng = random.Random(seed)
    items = [[rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 12))] for _ in range(60)]
    rows = [{"no": i, "item_id": i, "text": " ".join(w), "words": sorted(set(w)), "impacts": [1 / len(set(w))] * len(set(w))}
            for i, w in enumerate(items)]
    index = decontam.build_index(rows)
    order = sorted(range(60), key=lambda i: (len(items[i]), i))
    for _ in range(30):
        words = [rng.choice("abcdefghijklmnopqrst") for _ in range(6)]
        terms = sorted({index.terms[w] for w in words if w in index.terms})
        want = {k: len(set(items[i]) & set(words)) / len(set(items[i])) for k, i in enumerate(order)}
        want = {k: round(s, 6) for k, s in want.items() if s >= 0.5 - 1e-9}
        assert {i: round(s, 6) for i, s in decontam.block_max_wand(index, terms, 0.5, 0, 60)} == want


def test_item_parts_and_passages():
    assert decontam.question_and_answer("What is it now? Yes it is.") == (["what", "is", "it", "now"], ["yes", "it", "is"])
    assert decontam.question_and_answer(None) == ([], [])
    assert decontam.overlap(["a", "b"], ["x", "a", "b"]) == 1.0
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (20, 30, 50, 150, 7)]
    rows = [{"no": i, "item_id": i, "text": " ".join(w[:-4]) + ". " + " ".join(w[-4:]), "words": sorted(set(w)),
             "impacts": [1 / len(set(w))] * len(set(w))} for i, w in enumerate(items)]
    index = decontam.build_index(rows)
    for w in items:
        text = [word() for _ in range(777)] + w + [word() for _ in range(90)]
        found = decontam.contaminated_items(text, index, decontam.length_classes(index.lengths), 0.5)
        assert [index.ids[i] for i, (q, a, *_) in found.items() if q > 0.9 and a > 0.9] == [items.index(w)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab\n\\<|im_end>", max_size=8), st.text("ab\n\\<|im_startend>", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    done = chat.render(chat.marked_turns, turns)
    assert chat.read_turns(done.text) == turns and done.rewritten == -1
    assert [chat.unescape(done.text[a:b]) for a, b in done.texts] == [x for _, x in turns]
    assert "".join(done.text[a:b] for a, b in done.spans) == done.text


def test_chat_templates_that_rewrite_history():
    def last_only(turns):  # earlier answers are shortened once a new turn comes
        return "".join(f"[{r}]{x if k == len(turns) - 1 else x[:3]}" for k, (r, x) in enumerate(turns))

    done = chat.render(last_only, [("user", "hello there"), ("assistant", "general")])
    assert done.rewritten == 1 and done.text[slice(*done.texts[1])] == "general"
    prompt = chat.render(lambda t: "<s>" + "".join(f"{r}: {x}\n" for r, x in t), [("a", "x"), ("b", "x")])
    assert prompt.rewritten == -1 and [prompt.text[a:b] for a, b in prompt.texts] == ["x", "x"]


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies <button>ok</button></div>
<article><h1>One &amp; two</h1><p>First  <b>bold</b>\n text<p>Second &eacute; <a href=x>link</a> text<div class="ad">Buy now</div>
<ul><li>point one<li>point two</ul></article><aside class="sidebar"><p>More to read here</p></aside>
<section id="comments"><p>Nice article, thanks</p></section><footer>&copy; me"""


def trained():
    rng = random.Random(1)
    html = "<html><body><nav><ul><li><a href=x>a</a></li></ul></nav><div class=ad>x y</div><article><h1>The title</h1>" + "".join(
        f"<p>{' '.join(rng.choice('abcdefghij') * 4 for _ in range(25))}.</p>" for _ in range(6)) + "</article><footer>f</footer></body></html>"
    return pages.fit_trees([pages.Tree(x) for k in range(60) for x in pages.labelled_layouts(html, random.Random(k))])


def test_page_text():
    text = pages.main_text(PAGE, trained())
    assert text == "One & two\n\nFirst bold text\n\nSecond é link text\n\npoint one\n\npoint two"
    assert pages.main_text(None, trained()) == pages.main_text("", trained()) == ""


def test_marginals_equal_enumeration():
    tree = pages.Tree("<div><p>a b c</p><nav><a href=x>d</a></nav></div>")
    model = trained()
    fs = pages.features(tree)
    n, weights = len(tree.nodes), {}
    tree = pages.Tree("<div><p>a b c</p><nav><a href=x>d</a></nav></div>")
    for mask in range(2 ** n):
        y = [mask >> i & 1 for i in range(n)]
        s = model.root[y[0]] + sum(sum(model.odds.get(f, 0) for f in fs[i]) for i in range(n) if y[i])
        weights[mask] = math.exp(s + sum(
            model.edge(tree.nodes[tree.nodes[i].parent].tag, tree.nodes[i].tag)[y[tree.nodes[i].parent]][y[i]] for i in range(1, n)))
    total = sum(weights.values())
    want = [sum(w for m, w in weights.items() if m >> i & 1) / total for i in range(n)]
    assert pages.marginals(tree, model) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_sliced_block_is_exact(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-700, 700, (300, 16))
    rows[50:120] = rows[50]
    block = topk.SlicedBlock(np.arange(300), rows)
    sums = block.weighted_sum([3, -5] + [0] * 14)
    kept = (rows - block.low) >> block.shift
    want = 3 * kept[:, 0] + 5 * ((1 << topk.SLICES) - 1 - kept[:, 1])
    assert [sum((s >> r & 1) << p for p, s in enumerate(sums)) for r in range(300)] == want.tolist()
    for q in (0, 50, 299):
        ids, scores = block.top(q, rows[q], 10)
        exact = sorted(((-int(rows[q] @ rows[r]), r) for r in range(300) if r != q))[:10]
        assert list(zip(ids.tolist(), scores.tolist())) == [(r, -s) for s, r in exact]


def test_word_probability_sums_to_one_over_next_characters():
    known = {"a": (.5, .4), "\x03": (.3, math.nan), "\x02": (math.nan, .6), "\x02a": (.7, .5), "": (math.nan, .1), "aa": (.2, math.nan)}
    assert quality.log_probability("\x02a\x03", known, 0.01, 2) == pytest.approx(math.log(.7) + math.log(.4 * .3))
    assert quality.log_probability("\x02b\x03", known, 0.01, 2) == pytest.approx(math.log(.6 * .1 * .01) + math.log(.3))


def test_line_normal_form():
    assert lines.normalised("  Hello,  WORLD!! ") == "hello world" and words_of(None) == [] and re.match(r"\w", "é")


def test_edit_similarities_side_by_side(monkeypatch):
    """Pairs of a batch are compared side by side, with the answer of one pair at a time; pairs far beyond the limit are not followed to
    their ends, and few pairs are left to single comparisons."""
    rng = random.Random(5)
    pairs = []
    for n in [1, 2, 31, 63, 64, 65, 128, 200, 300] * 60:
        a = [rng.choice("abcd é漢😀") for _ in range(n)]
        b = list(a)
        for _ in range(int(rng.random() * 0.4 * n)):
            b[rng.randrange(n):rng.randrange(n)] = rng.choice("abcd")
        pairs.append(("".join(a), "".join(b)[rng.choice([0, 0, n // 9]):]))
    pairs += [("".join(rng.choices("abcdefgh ", k=400)), "".join(rng.choices("abcdefgh ", k=400))) for _ in range(200)] + [("", ""), ("", "x")]
    for least in (0.5, 0.8, 0.95):
        want = [lines.alike(a, b, least) for a, b in pairs]
        assert lines.alike_pairs([a for a, _ in pairs], [b for _, b in pairs], least).tolist() == want and any(want) and not all(want)
    one, calls = lines.edit_distance, []
    monkeypatch.setattr(lines, "edit_distance", lambda a, b: calls.append(1) or one(a, b))
    lines.alike_pairs([a for a, _ in pairs[-202:]], [b for _, b in pairs[-202:]], 0.8)
    assert len(calls) < lines.FEW


def test_bands_and_early_ends_leave_distances_as_they_are():
    """Pairs of all likenesses and lengths against the plain distance; the last ones are longer than a set takes."""
    rng = random.Random(5)

    def near(a, edits):
        a = list(a)
        for _ in range(edits):
            at = rng.randrange(len(a) + 1)
            a[at:at + rng.randrange(2)] = rng.choice(["", "x", "yé"])
        return "".join(a)

    pairs = []
    for size in (1, 30, 64, 65, 200, 700):
        for _ in range(120):
            a = "".join(rng.choices("abcd e", k=size))
            pairs.append((a, near(a, rng.randrange(1 + size // 3))))
            pairs.append((near(a, size // 5), near(a, size // 20)))
    a = "".join(rng.choices("abcdefgh ", k=5000))
    pairs += [(a, near(a, e)) for e in (0, 10, 700, 1500)] + [(a, a[:4000]), (a, a[:3999]), (a, a[::-1])]
    want = [lines.alike(a, b, 0.8) for a, b in pairs]
    assert lines.alike_pairs([a for a, _ in pairs], [b for _, b in pairs], 0.8).tolist() == want and 100 < sum(want) < len(want) - 100
    for a, b in pairs[::40]:
        d = lines.edit_distance(a, b)
        assert [lines.within(a, b, x) for x in (d - 1, d, d + 1)] == [False, True, True]


def test_second_round_gives_links_of_agreeing_pairs_only(spark, monkeypatch):
    """A bucket of several groups: the pairs that do not agree never leave their task."""
    texts = [f"alpha beta {w} {w * 2} gamma delta" for w in ("one", "two", "six")] + ["alpha beta one oneone gamma deltas"]
    entries = spark.createDataFrame([(7, i) for i in range(4)], "key long, node long")
    payload = spark.createDataFrame([(i, bytes(8)) for i in range(4)], "node long, sig binary")
    full = spark.createDataFrame(list(enumerate(texts)), "node long, full string")
    made, real = [], graph._in_line

    def seen(*a):
        found = real(*a)
        made.extend(tuple(r) for r in found.collect())
        return found

    monkeypatch.setattr(graph, "_in_line", seen)
    asked = []
    roots, _ = graph.grouped_links(entries, payload, lambda x, y: np.zeros((len(x), len(y))), -1, lambda links: asked.append(1) or links.filter("false"),
                                   "small", whole=lambda w: full.join(w, "node"), agree=lambda a, b: lines.alike_pairs(a, b, 0.9))
    assert made == [(0, 3)] and len(asked) == 1
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(0, 0), (3, 0)}
