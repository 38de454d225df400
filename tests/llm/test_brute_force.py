"""Operators that SQL can't express, against brute force, a round trip or held-out labels."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from mailsift.llm import op2_langid, op3_packing, op5_simhash, op6_toxicity, op7_lm, op8_quality
from mailsift.llm.elias_fano import EliasFano
from mailsift.llm.op4_html import Weights, count_places, extract, region
from mailsift.llm.op9_decontamination import mark
from mailsift.llm.queries import QUERIES
from mailsift.llm.tokens import TextEncoder, default_path
from tests.llm.conftest import SF001, SF01, SF1, TEXTS


def _docs(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"])
    return list(zip(*(t[c].to_pylist() for c in ("doc_id", "text", "lang"))))


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.integers(0, 61))
def test_elias_fano(values, shift):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    ef, _ = EliasFano.from_buffer(EliasFano.of(values).to_bytes())
    assert (ef.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array([0, 2**62], np.uint64)])
    assert (ef.next_geq(asked) == np.searchsorted(values, asked)).all()


#: Added tokens and parts of them, every white space, letters, marks, digits and signs.
_SNIPS = [*"aBé漢😀.,'!*1²ª", *(chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 32, 32, 133, 160, 5760, 8192, 8202, 8232, 8233, 8239, 8287, 12288)),
          "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "'ll", " the", "word"]


@settings(deadline=None, max_examples=500)
@given(st.lists(st.sampled_from(_SNIPS), max_size=30).map("".join))
def test_cached_units_are_the_tokenizers_ids(text):
    enc = _ENCODER
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_many_random_texts_have_the_tokenizers_ids():
    dice = np.random.default_rng(3)
    texts = ["".join(_SNIPS[k] for k in dice.integers(0, len(_SNIPS), n)) for n in dice.integers(1, 16, 300_000)]
    for k in range(0, len(texts), 10_000):
        want = _ENCODER.tokenizer.encode_batch(texts[k:k + 10_000], add_special_tokens=False)
        assert [np.frombuffer(_ENCODER.encode(t), "<u4").tolist() for t in texts[k:k + 10_000]] == [e.ids for e in want]


def test_words_are_kept_once_whatever_follows_them():
    enc = TextEncoder(default_path())
    text = "word, word. word! word word,word Étéé; don't"
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(enc.units) == sorted(["word", " word", " Étéé", " don't", ",", ".", "!", ",word", ";"])


_ENCODER = TextEncoder(default_path(), cache_units=50)


def _ids(folder):
    tokenizer = Tokenizer.from_file(default_path())
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t, _ in _docs(folder)]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_token_files_round_trip(spark, odd, where):
    folder = odd if where == "odd" else SF001
    rows = sorted(QUERIES["op10_binary"](spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in _ids(folder)), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])))[:-1].tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in _ids(folder))


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_packing(spark, odd, where):
    folder = odd if where == "odd" else SF001
    rows = QUERIES["op3_packing"](spark, folder).collect()
    want = Counter()
    for i, x in _ids(folder):
        bounds = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset  # gapless
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(bins) <= least + 1 + least // 50


def test_genetic_grouping_beats_best_fit():
    dice = np.random.default_rng(1)
    lengths = dice.integers(300, 1100, 400).tolist()
    first = op3_packing.best_fit(sorted(range(400), key=lambda i: -lengths[i]), lengths, op3_packing.Bins(2048))
    best = op3_packing.evolve(lengths, 2048, 1, [], generations=10)
    assert sorted(i for _, items in best for i in items) == list(range(400))
    assert all(sum(lengths[i] for i in items) + room == 2048 for room, items in best)
    assert len(best) < len(first)
    again = op3_packing.evolve(lengths, 2048, 2, [best])
    assert len(again) <= len(best)


@pytest.mark.parametrize("low, high", [(200, 700), (1, 300), (1100, 1200)])
def test_levels_merge_the_ill_filled_bins_of_all_blocks(spark, low, high):
    lengths = np.random.default_rng(2).integers(low, high, 1200).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    rows = op3_packing.pack(pieces, block=60).collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    if low > 1024:
        assert len(bins) == 1200  # nothing fits together, and the levels end
        return
    # blocks of 60 alone cannot do with less than the sum of their bounds; levels go below it
    blocks = [lengths[k:k + 60] for k in range(0, 1200, 60)]
    assert len(bins) < sum(-(-sum(b) // 2048) for b in blocks)


def _simhash(text):
    w = _words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((sum(y >> b & 1 for y in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def _classes(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_simhash(spark, odd, where):
    folder = odd if where == "odd" else SF001
    docs = _docs(folder)
    fps = [_simhash(t) for _, t, _ in docs]
    want = Counter((i, f"{f:016x}", c) for (i, _, _), f, c in zip(docs, fps, _classes(fps, [d[0] for d in docs])))
    assert Counter(map(tuple, QUERIES["op5_simhash"](spark, folder).collect())) == want


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_of_dense_groups(spark, bucket):
    """One group of near copies, larger than a bucket may be, beside unrelated fingerprints."""
    dice = np.random.default_rng(2)
    fps = {int(x) for x in dice.integers(0, 2**63, 60)}
    for _ in range(120):
        fps.add(int(dice.choice(sorted(fps)[:3])) ^ 1 << int(dice.integers(0, 64)))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in op5_simhash.connected_components(op5_simhash.links(df, bucket=bucket)).collect()}
    got, want = {}, {}
    for s, c in zip(signed, _classes(fps, list(range(len(fps))))):
        got.setdefault(roots.get(s, s), set()).add(s)
        want.setdefault(c, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_language_model(spark):
    docs = _docs(SF001)
    words = {i: [*_words(t), "\n"] for i, t, _ in docs}
    one, two = Counter(), Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w)
            two.update(zip(["\n", *w], w))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    rows = QUERIES["op7_lm"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - sum(np.log10(p(x)) for x in w)) < 1e-6 * len(w)
        a, m = op7_lm.ALPHA, op7_lm.MU
        want = sum(np.log10(((1 - a) * two[x, y] + (m + a * one[x]) * p(y)) / (one[x] + m)) for x, y in zip(["\n", *w], w))
        assert abs(r.score - want) <= 0.017 * len(w)  # half a step of the quantiser for each token
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_successors_of_hot_words():
    """Shares keep their size after words of any count."""
    counts = np.array([5, 10**6, 25 * 10**7, 10**12, 2**62])
    n = np.array([1, 5, 1, 10**6, 1, 25 * 10**7, 1, 10**12, 1, 2**62])
    left, right = np.repeat(np.arange(5), 2), np.tile([3, 8], 5)
    data = op7_lm.successor_file(np.arange(5), np.arange(0, 10, 2), right, n, counts)
    got = op7_lm.Successors(pa.py_buffer(data)).share(left, right)
    want = (1 - op7_lm.ALPHA) * n / (np.repeat(counts, 2) + op7_lm.MU)
    assert np.abs(np.log10(got) - np.log10(want)).max() <= 0.5 / op7_lm.STEPS + 1e-9


def test_language(spark):
    lang = {i: x for i, _, x in _docs(SF01)}
    rows = [r for r in QUERIES["op2_langid"](spark, SF01).collect() if r.held_out]
    assert len(rows) > 150 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97


def test_unknown_language(spark, odd):
    text = {i: t for i, t, _ in _docs(odd)}
    for r in QUERIES["op2_langid"](spark, odd).collect():
        if r.doc_id not in (None, 7):
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))


def test_toxicity(spark):
    t = pq.read_table(f"{SF1}/labels.parquet").to_pydict()
    toxic = dict(zip(t["doc_id"], t["toxic"]))
    rows = [r for r in QUERIES["op6_toxicity"](spark, SF1).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    caught = [r.predicted for r in rows if toxic[r.doc_id]]
    blamed = [r.predicted for r in rows if not toxic[r.doc_id]]
    assert sum(caught) / len(caught) > 0.8 and sum(blamed) / len(blamed) < 0.05


def test_cuts_follow_the_true_shares():
    """However many rows of a label were fitted on, the cut is that of all labelled rows."""
    dice = np.random.default_rng(5)
    for share in (0.02, 0.1, 0.5):
        size = {1: int(40_000 * share), 0: int(40_000 * (1 - share))}
        rows = {x: np.floor(dice.normal(x, 0.7, n) * op6_toxicity.BINS).astype(int) for x, n in size.items()}
        bins = np.unique(np.concatenate([*rows.values()]))
        count = lambda x, part: np.array([np.sum(rows[x][part] == b) for b in bins])
        for toxic, other in ((1, 1), (1, 5), (4, 1)):  # one of so many rows is left
            cells = [(0, int(b), x, int(n), int(k)) for x, left in ((0, other), (1, toxic))
                     for b, n, k in zip(bins, count(x, slice(None)), count(x, slice(0, None, left)))]
            cut = op6_toxicity.cuts_of(cells, 1)[0] * op6_toxicity.BINS
            f1 = lambda c: 2 * np.sum(rows[1] >= c) / (np.sum(rows[1] >= c) + np.sum(rows[0] >= c) + size[1])
            assert f1(cut) > max(map(f1, bins)) - 0.02


def test_toxicity_counts_every_labelled_row(spark):
    """Rows beyond the training bound set the cut with their true share."""
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(4000)], "doc_id long, toxic int")
    once = op6_toxicity.labelled_rows(labels, F.lit(True))
    picked, apart = op6_toxicity.picked_ids(once, 200)
    assert apart and 0 < picked.where("toxic = 1").count() < 80 and picked.where("toxic = 0").count() == 200
    scores = labels.select("doc_id", F.lit(0).alias("_language"), F.col("toxic").cast("double").alias("_logit"))
    seen = []
    keep, op6_toxicity.cuts_of = op6_toxicity.cuts_of, lambda rows, n: seen.extend(rows) or keep(rows, n)
    try:
        op6_toxicity.calibrate(scores, once, picked, apart, 1)
    finally:
        op6_toxicity.cuts_of = keep
    assert sum(r[3] for r in seen) == 4000 and sum(r[4] for r in seen) == 4000 - picked.count()


def test_region_is_the_best_run():
    dice = np.random.default_rng(3)
    for _ in range(50):
        s = dice.normal(0, 1, 30).tolist()
        a, b = region(s)
        assert abs(sum(s[a:b]) - max(sum(s[i:j]) for i in range(30) for j in range(i, 31))) < 1e-9


def test_page_without_article():
    page = ("<body><header>Site name</header><nav><a href=1>Home</a></nav><div class=content><h2>Head &amp; line</h2>"
            "<p>First paragraph of several words.<p>Second <a href=2>one</a> has<br>more words<div class='ad-box'>Buy</div><p>The last one here.</div>"
            "<div id=comments><p>I liked it a lot, really.</p></div><footer>&copy; Site</footer>")
    assert extract(page, Weights({})) == "Head & line\nFirst paragraph of several words.\nSecond one has more words\nThe last one here."


@pytest.mark.parametrize("page", ["", "<", "<p", "<div " + 'a="' * 3000, "<" * 20000, "<p>" * 20000, "<b>" * 5000 + "x"])
def test_broken_pages(page):
    extract(page, Weights({}))


def test_long_attribute_values():
    long = "A" * 9000
    for tag in (f'<img src="data:{long}">', f"<img data-props='{{\"a\": \"x>y {long}\"}}'>", f'<img class="x"" alt="{long}>">'):
        page = f'<div><p>Words before it.</p>{tag}<p>Words "after" it and <b class="y">more</b> words.</p></div>'
        assert extract(page, Weights({})) == 'Words before it.\nWords "after" it and more words.'


def _learned():
    counts = Counter()
    for page in pq.read_table(f"{SF01}/pages.parquet")["html"].to_pylist():
        counts.update(count_places(page or ""))
    return Weights(counts)


def test_pages_without_article_elements():
    """Weights learned on pages with an article element find the same text without it."""
    learned = _learned()
    for page in pq.read_table(f"{SF01}/pages.parquet")["html"].to_pylist():
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert plain != page and extract(plain, learned) == extract(page, learned)


@pytest.mark.parametrize("weights", [lambda: Weights({}), _learned])
def test_cards_and_comments_are_not_the_main_element(weights):
    body = [f"Paragraph {k} of the story with a good number of words in it." for k in range(8)]
    story = "<div class=body>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    cards = "".join(f"<article class=card><h3><a href={k}>Other story {k}</a></h3><p>Teaser</p></article>" for k in range(3))
    comments = "<div id=comments>" + "".join(f"<article class=comment-body><p>I liked part {k} a lot.</p></article>" for k in range(3)) + "</div>"
    for page in (story + cards, cards + story, story + comments, "<main>" + story + cards + "</main>" + comments):
        out = extract(f"<body><nav><a href=1>Home</a></nav>{page}<footer>Site</footer></body>", weights()).split("\n")
        assert [x for x in out if x in body] == body and not any("liked" in x or x in ("Home", "Site") for x in out)


@pytest.mark.parametrize("begin, end", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<article class='post no-comments'>", "</article>"), ("<div id=with-banner>", "</div>"),
    ("<div class=sidebar-right>", "</div>"), ("<form action=x>", "</form>"), ("<form><article>", "</article></form>"), ("<div class=menu-page><main>", "</main></div>")])
def test_layout_names_remove_nothing(begin, end):
    body = [f"Paragraph {k} of the story with a good number of words in it." for k in range(8)]
    aside = "<div class=sidebar><p>Elsewhere on this site.</p></div><div id=comments><article class=comment-body><p>I liked it.</p></article></div>"
    page = "<body><nav><a href=1>Home</a></nav>" + begin + "".join(f"<p>{x}</p>" for x in body) + aside + end + "<footer>Site</footer>"
    for weights in (Weights({}), _learned()):
        assert extract(page, weights) == "\n".join(body)


def test_frame_names_around_every_block():
    body = [f"Paragraph {k} of the story with a good number of words in it." for k in range(8)]
    page = "<nav>Home</nav>" + "".join(f"<div class=x-widget><p>{x}</p></div>" for x in body) + "<footer>Site</footer>"
    assert extract(page, Weights({})) == "\n".join(body)
    comments = "<div class=comments>" + "<p>I did not like a word of all this story.</p>" * 15 + "</div>"
    assert extract("<div>" + "".join(f"<p>{x}</p>" for x in body) + "</div>" + comments, Weights({})) == "\n".join(body)
    assert extract("<div class=sidebar-right>" + "".join(f"<p>{x}</p>" for x in body) + comments + "</div>", Weights({})) == "\n".join(body)


def _marks(texts, items, n=10):
    """(spans as a set of words hit, items) of each text, by looking for every window at every place."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for text in texts:
        words, hit, ids = cut(text), set(), set()
        for item, t in items:
            w = cut(t)
            for k in range(max(1, len(w) - n + 1)) if w else ():
                window = w[k:k + n]
                for i in range(len(words) - len(window) + 1):
                    if words[i:i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        ids.update([] if item is None else [str(item)])
        out.append((hit, sorted(ids)))
    return out


@pytest.mark.parametrize("bits", [25, 6])
def test_marks_by_brute_force(spark, bits):
    """Also with bit arrays so small that every bit is set: the join alone decides then."""
    dice = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{k}" for k in dice.zipf(1.5, n) % 12)
    texts = TEXTS[:12] + [say(60) for _ in range(25)]
    shared = say(11)
    items = [(k, say(int(dice.integers(1, 14)))) for k in range(30)] + [(k, shared + " " + say(2)) for k in range(30, 60)] + [(None, "the lazy dog"), (1, say(12)), (70, None)]
    texts.append(say(5) + " " + shared + " " + say(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("_row", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    got = {r.doc_id: r for r in mark(docs, bench, prefix="h_", bits=bits).collect()}
    for k, (hit, ids) in enumerate(_marks(texts, items)):
        spans = got[k].h_spans
        assert {x for a, b in zip(spans[::2], spans[1::2]) for x in range(a, b)} == hit and got[k].h_items == ids and got[k]._row == "clash"
    assert len(got[len(texts) - 1].h_items) >= 30  # a window of half the items


@pytest.mark.parametrize("kept", [
    '<div class="entry-header"><h1>Kept words</h1></div>', '<h1 class="page-header">Kept words</h1>', '<p class="notice">Kept words</p>',
    '<div class="ad-free">Kept words</div>', '<p class="cookie-recipe">Kept words</p>', '<section id="related-work"><p>Kept words</p></section>',
    '<blockquote class="reply">Kept words</blockquote>', '<p>Kept <math><mi>words</mi><annotation>no words</annotation></math></p>',
    '<a href=http://x.org/foo/>Kept words</a><p>here</p>', '<table class="menu"><tr><td>Kept words</td></tr></table>'.replace("menu", "menu-prices")])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>"])
def test_names_remove_no_article_text(kept, around):
    body = [f"Paragraph {k} has quite a number of words, so that the article is the content of its page." for k in range(4)]
    page = around.format(f"<p>{body[0]}</p><p>{body[1]}</p>{kept}<p>{body[2]}</p><p>{body[3]}</p>")
    got = extract(f"<nav><a href=1>Home</a></nav>{page}<footer>Site</footer>", Weights({}))
    assert "Kept words" in got.replace("\n", " ") and "no words" not in got and "Home" not in got and "Site" not in got and all(x in got for x in body)


@pytest.mark.parametrize("gone", ['<div class="advert">Gone now</div>', '<div class="sidebar-right">Gone now</div>', '<ul id="comment-list"><li>Gone now</ul>', '<div role="complementary">Gone now</div>',
                                  '<div class="cookie-banner">Gone now</div>', "<form>Gone now</form>", "<aside>Gone now</aside>", '<div class="ad-slot-2">Gone now</div>'])
def test_frames_inside_an_article_are_left_out(gone):
    body = [f"Paragraph {k} has quite a number of words, so that the article is the content of its page." for k in range(4)]
    page = f"<article><p>{body[0]}</p><p>{body[1]}</p>{gone}<p>{body[2]}</p><p>{body[3]}</p></article>"
    assert extract(page, Weights({})) == "\n".join(body)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "</i>" * 25_000 + "<hr>" * 25_000, "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000,
                                  "<ul><li>x" * 50_000, "<p><b>x" * 50_000])
def test_deep_nesting_is_linear(page):
    begin = time.process_time()
    extract(page, Weights({}))
    assert time.process_time() - begin < 5


def test_letters_and_marks_make_words():
    assert op2_langid.words_of("½ ² Ⅷ ① 12_3 !") == [] and op2_langid.words_of("12 + 3") == []
    assert op2_langid.words_of("नमस्ते Été2x a1b") == ["नमस्ते", "été", "x", "a", "b"]
    assert op2_langid.words_of("Plain, words") == ["plain", "words"]


def test_rules_come_in_a_repeatable_order(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    orders = [[r.name for r in op8_quality.order_rules(docs, op8_quality.RULES)] for _ in range(2)]
    assert orders[0] == orders[1]
    rejected = {r.rejected_by for r in op8_quality.cascade(docs, list(op8_quality.RULES)).select("rejected_by").distinct().collect()}
    assert orders[0][0] in rejected
