"""Operators that look at one text at a time: tokens, fingerprints, benchmark passages, quality, pages."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelmill.llm import bpe, decontaminate, fingerprint, html_text, quality

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# --- byte-pair encoding


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_library_on_odd_texts(vocabulary, library):
    rng = random.Random(3)
    pools = ["abc \n\t'sdre", "".join(map(chr, range(32, 600))), "日本語テキスト 　\u0085\x1c🙂é  ", "a b", "x9 _-!"]
    for k in range(600):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(90)))
        if k % 7 == 0:
            text += "<|endoftext|>" + text[:9] + "<|endoftext|"
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text).tolist() == ids
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_runs(vocabulary, library):
    for text in ("ab" * 20_000, "a" * 5_000, " " * 3_000 + "x", "漢" * 4_000):
        assert vocabulary.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_fragments_never_join_across_a_cut(vocabulary):
    raw = "naïve—the€end".encode()
    cuts = [i for i in range(1, len(raw)) if not vocabulary.inside[raw[i - 1]][raw[i]]]
    assert cuts
    parts = [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])]
    assert b"".join(vocabulary.merge(p) for p in parts) == vocabulary.merge(raw)


def test_bpe_rows(spark, library):
    rows = [(1, "Hello  world\n", "kept"), (2, None, None), (3, "", "x"), (1, "Hello  world\n", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.bpe_round_trip(df, VOCABULARY).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, ""), (3, "")]
    assert out[0].ids == library.encode("Hello  world\n", add_special_tokens=False).ids and out[2].ids == []
    assert bpe.bpe_round_trip(df.limit(0), VOCABULARY).count() == 0
    assert bpe.encode_texts(df, VOCABULARY).columns == ["doc_id", "text", "ids"]
    lists = spark.createDataFrame([([15496, None],), (None,), ([246],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_ids(lists, VOCABULARY).collect()] == ["Hello", "", "�"]


# --- fingerprints


def test_entropies_by_counting():
    data = np.frombuffer(("some wörds of text " * 30 + "aaaa" * 40).encode(), np.uint8)
    for width in (16, 64):
        got = fingerprint.entropies(data, width)
        for i in range(0, len(got), 37):
            share = np.bincount(data[i : i + width])
            share = share[share > 0] / width
            assert abs(got[i] + (share * np.log2(share)).sum()) < 1e-4


def test_fingerprint_depends_on_the_text_alone(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ij") for _ in range(n)) for n in (0, 5, 40, 63, 64, 65, 300, 511, 512, 5000)]
    together = fingerprint.fingerprints(pa.array(texts))
    for text, chain in zip(texts, together):
        (alone,) = fingerprint.fingerprints(pa.array([text]))
        assert np.array_equal(alone, chain)
        assert fingerprint.likeness(chain, alone) == pytest.approx(1.0)
    assert fingerprint.likeness(together[0], together[9]) == 0 and fingerprint.likeness(together[0], together[0]) == 1
    assert fingerprint.likeness(together[8], together[9]) < 0.1


def test_texts_on_both_sides_of_the_long_limit_are_alike(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop .,") for _ in range(520))
    long, cut, other = fingerprint.fingerprints(pa.array([text, text[:505], text[::-1][:505]]))
    assert fingerprint.likeness(long, cut) == fingerprint.likeness(cut, long) > 0.8
    assert fingerprint.likeness(long, other) < 0.1
    first, _ = fingerprint.compare_with_edit(docs(spark, text, "short")).orderBy("doc_id").collect()
    assert first.near_edited > 0.5


def test_compare_with_edit_in_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(400)))) for i in rng.sample(range(10_000), 60)]
    rows += [(rows[0][0], rows[0][1]), (20_000, None), (20_001, ""), (None, "without an id")]
    out = fingerprint.compare_with_edit(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(out) == len(rows)
    want = []
    for k, (i, text) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + follower[:n]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted((str(a), b, c) for a, b, c in want)
    longer = [r for r in out if r.n_chars > 300]
    assert np.mean([r.near_edited for r in longer]) > 0.5 and all(0 <= r.near_next <= 1 for r in out)


def test_fingerprint_of_nothing(spark):
    assert fingerprint.compare_with_edit(docs(spark).limit(0)).count() == 0
    (only,) = fingerprint.compare_with_edit(docs(spark, "a text that follows itself")).collect()
    assert only.near_next == pytest.approx(1.0)
    assert fingerprint.add_fingerprint(docs(spark, None, "x")).orderBy("doc_id").first().fingerprint == ""


# --- benchmark passages


def normal(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).strip()


def edits(a, b):
    row = [0] * (len(b) + 1)  # the passage may begin and end anywhere in b
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_passages_by_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(8, 20))) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    texts = []
    for _ in range(60):
        passage = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(0, 14)):
            passage[rng.randrange(len(passage))] = rng.choice(["", "q", "zz"])
        texts.append(say(10) + " " + "".join(passage) + " " + say(5))
    texts += [None, "", items[3][1], items[3][1].upper().replace(" ", "!! ")]
    found = decontaminate.leaked_passages(docs(spark, *texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    budget = {r.item_id: r.budget for r in found}
    for d, text in enumerate(texts):
        for i, item in items[:12]:
            least = edits(normal(item), normal(text or ""))
            if i in budget:
                assert ((d, i) in got) == (least <= budget[i]), (d, i, least)
                assert got.get((d, i), least) == least
    for r in found:
        if r.edits == 0:
            assert normal(texts[r.doc_id][r.start_char : r.end_char]) == normal(dict(items)[r.item_id])


def test_passages_in_blocks_and_of_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"the benchmark sentence number {i * 7919} of the set") for i in range(40)], "item_id long, text string")
    texts = docs(spark, *[f"before the benchmark sentence number {i * 7919} of the set after" for i in range(0, 40, 5)])
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaked_passages(texts, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked_passages(texts, items).collect()} == whole
    assert {(k, 5 * k) for k in range(8)} <= whole
    assert decontaminate.clean_documents(texts, items).count() == 0
    assert decontaminate.clean_documents(texts, items.limit(0)).count() == 8
    assert decontaminate.leaked_passages(texts.limit(0), items).count() == 0


def test_alignment_of_wide_bands():
    rng = np.random.default_rng(5)
    item = rng.integers(97, 123, 60).astype(np.uint8)
    windows = rng.integers(97, 123, (1, 60 + 40_000)).astype(np.uint8)
    windows[0, 36_000:36_060] = item
    edits, off = decontaminate.align(item, windows)
    assert (edits[0], off[0]) == (0, 36_000)
    edits, off = decontaminate.align(item, windows, anchored=True)
    assert 35_900 > edits[0] >= 0


def test_many_small_items_and_documents():
    items = [f"{i * 7919 % 1_000_000_007:010d}" for i in range(250_000)]
    block = decontaminate.Block.of(list(range(len(items))), pa.array(items), 0.1)
    texts = ["nothing to be found here"] * 10_000
    want = {(9_000 + k, 249_000 + k) for k in range(900)}
    for row, item in want:
        texts[row] = f"so it says {items[item]} in here"
    assert {(r[0], r[1]) for r in decontaminate.find(block, pa.array(texts)) if r[2] == 0} == want


# --- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert not [r for r in rows if r.predicted != (r.score >= 0.3)]


def test_quality_without_labels(spark):
    texts = docs(spark, "one text", None, "", "one text")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.score_documents(texts, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(4)] + [(0, None), (None, 1)], "doc_id long, quality int")
    out = quality.score_documents(texts, one).collect()
    assert len(out) == 4 and all(0.5 < r.score <= 1 and r.predicted == 1 for r in out)
    assert quality.keep_good(texts.withColumn("features", F.lit(1)), one).columns == ["doc_id", "text", "features"]
    assert quality.score_documents(texts.limit(0), one).count() == 0


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies a lot and
tell you so here at length, dear reader.</p></div><form><p>Sign up</p><input value=x></form>
<div id="main"><article class=post><h1>The &amp; title</h1><p>First  <b>bold
</b> text&nbsp;here.<br>More<p>Second &eacute; <i>unclosed<ul><li>one<li>two</ul><aside>See also</aside>
<div class="comments"><p>Nice post!</p></div></article></div>
<div class=sidebar><p>Some long text in a bar at the side that isn't part of anything much.</p></div><footer>&copy; me</footer></body></html>"""


def test_page_main_text():
    assert html_text.main_text(PAGE) == "The & title\nFirst bold text here. More\nSecond é unclosed\none\ntwo"


def test_page_densest_subtree_without_names():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
    text = "".join(f"<p>Paragraph {i} has a good many words that tell the story of this page.</p>" for i in range(5))
    page = f"<body><div><ul>{links}</ul></div><div><div>{text}</div></div><div><a href=x>About</a> <a href=y>Help</a></div></body>"
    assert html_text.main_text(page) == "\n".join(f"Paragraph {i} has a good many words that tell the story of this page." for i in range(5))


def test_names_that_only_hold_a_word_cost_no_text():
    text = [f"Paragraph {i} has a good many words that tell the story of this page." for i in range(4)]
    side = "<div class='sidebar'><p>Some other text at the side.</p></div>"
    body = "".join(f"<p>{x}</p>" for x in text)
    for names in ("class='content has-sidebar'", "id=main class=no-sidebar", "class='sidebar'", "class=related-work"):
        page = f"<body><h1>The title</h1><div {names}>{body}</div>{side}</body>"
        assert html_text.main_text(page).split("\n")[-4:] == text
    form = f"<body><form id=aspnetForm><div>{body}</div></form></body>"
    assert html_text.main_text(form).split("\n") == text
    page = (
        f"<article><h1>T</h1><p>{text[0]}</p><h2 id='social-impact'>Social impact</h2><p>{text[1]}</p><section id='related-work'><h2>Related</h2>"
        f"<p>{text[2]} <span class=ad>ad</span> x<math><mi>y</mi></math></p></section><section id=notices><h2 id=notices-h>Notices</h2></section>"
        f"<p id='notices-served'>{text[3]}</p><div class='ad-slot-3'>Buy</div><div class='social-share-buttons'>Share</div></article>"
    )
    want = ["T", text[0], "Social impact", text[1], "Related", text[2] + " ad xy", "Notices", text[3]]
    assert html_text.main_text(page).split("\n") == want
    comments = "".join(f"<p>Reader {i} says a few words about the page.</p>" for i in range(9))
    assert html_text.main_text(f"<body><article>{body}</article><div class='post-comments'>{comments}</div></body>").split("\n") == text


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>a<", "</p></b>", "<script>x", "<a href='", "<!-- x", "&am", "<div>" * 3000 + "x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_of_the_tables(spark):
    import html

    for r in html_text.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet").withColumn("TEXT", F.lit(1))).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
