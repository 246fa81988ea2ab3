"""Words, suffix arrays, languages, toxicity, fingerprints and page texts against plain versions."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larderline.llm import decontaminate, html_text, language, syncmers, toxicity
from larderline.llm import words as W

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "...", "a", "Ä", "été 12 Über", "x" * 5000, "a b " * 3000, "日本語 text", "1 2 3"]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words_are_found_and_hashed_alike():
    found = W.words_of(pa.array(ODD + ["Ab aB", "ab ab"]))
    for i, text in enumerate(ODD):
        got = [
            bytes(W.LOWER[found.data[s:e]]).decode()
            for s, e in zip(found.start, found.end)
            if found.offsets[i] <= s < found.offsets[i + 1]
        ]
        assert got == plain_words(text)
    last = found.hash[found.first[-3] :]
    assert len(set(last.tolist())) == 1
    by_word = {}
    for s, e, h in zip(found.start, found.end, found.hash.tolist()):
        by_word.setdefault(bytes(W.LOWER[found.data[s:e]]), set()).add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_words_do_not_depend_on_the_pieces(monkeypatch):
    texts = ["one two three " * 40, None, "four", "five six " * 300]
    whole = W.words_of(pa.array(texts))
    monkeypatch.setattr(W, "PIECE_BYTES", 64)
    small = W.words_of(pa.array(texts))
    assert (whole.hash == small.hash).all() and (whole.first == small.first).all()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(W.pieces([batch], "t"))
    assert sum(p.num_rows for p in parts) == 4 and len(parts) > 1


def test_shingles_of_short_and_long_texts():
    found = W.words_of(pa.array(["a b c d e f", "", "a b", "b a", "a b c d e"]))
    values, first = W.shingles(found, 5)
    assert np.diff(first).tolist() == [2, 0, 1, 1, 1]
    assert values[0] == values[-1] and values[2] != values[3]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 3, 400)
    for depth in (1, 4, 10):
        order = decontaminate.suffix_array(seq, depth)
        keys = [tuple(seq[i : i + depth]) for i in order]
        assert keys == sorted(keys)
    assert len(decontaminate.suffix_array(np.zeros(0, dtype=np.int64), 5)) == 0


def brute_hits(docs, items, window=10):
    out = []
    for text in docs:
        w = plain_words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = plain_words(item)
            n = min(len(v), window)
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit |= set(range(q, q + n))
                        ids.add(item_id)
        out.append((len(w), len(hit), sorted(i for i in ids if i is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 60])
def test_contamination_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, draw(rng.randrange(1, 16))) for i in range(8)]
    items += [(50, None), (51, ""), (None, "c c c c b"), (3, "b b a"), (3, "b b a")]
    texts = [draw(rng.randrange(0, 60)) for _ in range(30)] + ODD + [items[0][1]] * 2
    docs = spark.createDataFrame(
        [(i, t, "kept", 1) for i, t in enumerate(texts)],
        "doc_id int, text string, n_hit string, items int",
    ).repartition(3)
    tests = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, tests).collect()}
    want = brute_hits(texts, items)
    assert [(got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) for i in range(len(texts))] == want
    for i, text in enumerate(texts):
        for m in got[i].matches:
            w = plain_words(text)[m.start : m.start + m.words]
            sources = [plain_words(t)[m.item_start :] for k, t in items if k == m.item_id]
            assert any(v[: m.words] == w for v in sources)
    kept = decontaminate.decontaminated(docs, tests)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in enumerate(want) if not x[1]}


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    tests = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.find_contamination(docs, tests).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    got = decontaminate.find_contamination(one, tests).first()
    assert (got.n_words, got.n_hit, got["items"], got.matches) == (2, 0, [], [])


def test_viterbi_equals_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 9])
    got = language.viterbi(scores, first, 0.7)
    for a, b in zip(first, first[1:]):
        best, n = None, b - a
        for code in range(3**n):
            path = [code // 3**i % 3 for i in range(n)]
            value = sum(scores[a + i, k] for i, k in enumerate(path))
            value -= 0.7 * sum(x != y for x, y in zip(path, path[1:]))
            best = max(best, (value, path)) if best else (value, path)
        if n:
            mine = sum(scores[a + i, k] for i, k in enumerate(got[a:b]))
            mine -= 0.7 * (np.diff(got[a:b]) != 0).sum()
            assert mine == pytest.approx(best[0], abs=1e-4)


SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away from here with them",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann läuft er schnell davon",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом она убегает отсюда",
}


def labelled_rows(n=30, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, text in SENTENCES.items():
        for _ in range(n):
            w = text.split()
            rows.append((" ".join(rng.choice(w) for _ in range(20)), lang))
    return rows


def test_languages_scripts_and_spans(spark):
    model = language.train_languages(
        spark.createDataFrame(labelled_rows() + [(None, "en"), ("x", None)], "text string, lang string")
    )
    assert model.languages == ["de", "en", "ru"]
    mixed = SENTENCES["en"] + " " + SENTENCES["ru"] + " 123 " + SENTENCES["de"]
    texts = [SENTENCES["de"], mixed, "12 34", "собаку fox", *ODD]
    docs = spark.createDataFrame(
        [(i, t, 5.0, "x") for i, t in enumerate(texts)],
        "i int, text string, score double, lang_pred string",
    )
    got = {r.i: r for r in language.label_languages(docs, model).collect()}
    assert got[0].lang_pred == "de" and got[0].score == 1.0
    langs = [s.lang for s in got[1].spans]
    assert langs == ["en", "ru", "de"]
    assert sum(s.words for s in got[1].spans) == len(plain_words(mixed))
    assert got[2].lang_pred == "und" and got[2].score == 0.0
    odd = [got[4 + i].lang_pred for i in range(len(ODD))]
    assert odd[0] == odd[1] == odd[2] == odd[3] == odd[-1] == "und" and "und" not in odd[4:-1]
    none = language.train_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.label_languages(docs, none).collect()} == {"und"}
    empty = spark.createDataFrame([], "text string")
    assert language.label_languages(empty, model).count() == 0


def test_languages_in_any_script(spark):
    rows = [("ሰላም ለሁሉም ሰው", "am"), ("မင်္ဂလာပါ ကမ္ဘာ", "my"), ("ສະບາຍດີ ໂລກ", "lo"), ("the quick fox", "en")]
    rows += [(f"the quick fox {i}", f"x{i:03}") for i in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.train_languages(df)
    few = language.label_languages(df.limit(3), model).collect()
    assert [(r.lang_pred, r.score) for r in few] == [("am", 1.0), ("my", 1.0), ("lo", 1.0)]
    labels = language.viterbi(np.eye(200, dtype=np.float32)[[190, 190]] * 9, np.array([0, 2]), 6.0)
    assert labels.tolist() == [190, 190]


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([("a text", None)], "text string, lang string")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
def test_held_out_languages(spark):
    from larderline.llm.queries import REGISTRY

    got = REGISTRY["op8_language"].run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(7)
    calm = "the of and to that was it for on are with they house tree river stone walk".split()
    rude = ["scumlike", "scumish", "blockhead", "blockheads"]

    def text(toxic):
        w = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        return " ".join(w)

    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    model = toxicity.train_toxicity(
        spark.createDataFrame(rows + [(None, 1), ("x", None)], "text string, toxic int")
    )
    fresh = [(text(i % 2), i % 2, i) for i in range(200)]
    fresh += [("the of " * 9000 + rude[0] + " the" * 900, 1, 201), ("the of " * 9000, 0, 202)]
    scored = toxicity.score_toxicity(
        spark.createDataFrame(fresh, "text string, toxic int, score int"), model
    ).collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    odd = spark.createDataFrame([(t,) for t in ODD], "text string")
    found = {r.text: r.score for r in toxicity.score_toxicity(odd, model).collect()}
    assert found[None] == found[""] and len(found) == len(ODD)
    assert toxicity.score_toxicity(odd.where("false"), model).count() == 0
    flat = toxicity.train_toxicity(spark.createDataFrame([("a b", 0)] * 9, "text string, toxic int"))
    assert toxicity.score_toxicity(odd, flat).count() == len(ODD)


def test_toxicity_learns_from_long_texts_and_from_every_shard(spark):
    rng = random.Random(8)
    calm = "the of and to that was it for on are with they house tree river stone walk".split()

    def text(word, n):
        w = [rng.choice(calm) for _ in range(n)]
        return " ".join([*w, word, *w[:3]])

    # The rude word stands in texts of more than 20 000 characters only.
    rows = [(f"{'scumlike walk ' * 1500}{i}", 1) for i in range(60)]
    rows += [(text("stone", rng.randrange(5, 60)), 0) for i in range(600)]
    long = toxicity.train_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    asked = spark.createDataFrame([(text("scumlike", 20),), (text("tree", 20),)], "text string")
    rude, mild = [r.score for r in toxicity.score_toxicity(asked, long).collect()]
    assert rude > 5 * mild
    # Many shards, copies as weights; the same embedding whatever the order and partitions.
    rows = [(text("scumlike" if i % 3 == 0 else "walk", 30), int(i % 3 == 0)) for i in range(1500)]
    rows += rows[:200]
    one = spark.createDataFrame(rows, "text string, toxic int")
    other = spark.createDataFrame(rows[::-1], "text string, toxic int").repartition(3)
    made, again = [toxicity.train_toxicity(df, shard_bytes=50_000) for df in (one, other)]
    assert (made.embedding == again.embedding).all()
    fresh = [(text("scumlike" if i % 2 else "walk", 30), i % 2) for i in range(100)]
    scored = toxicity.score_toxicity(spark.createDataFrame(fresh, "text string, toxic int"), made)
    assert scored.where("predicted = toxic").count() >= 95


def brute_anchors(text, k, s):
    if 0 < len(text) < k:
        return {(text, 0)}
    out = set()
    for i in range(len(text) - k + 1):
        small = [text[i + j : i + j + s] for j in range(k - s + 1)]
        hashes = [int(hash_of(x)) for x in small]
        if min(hashes) in (hashes[0], hashes[-1]):
            out.add((text[i : i + k], i))
    return out


def hash_of(text):
    codes, _ = syncmers.code_points([text])
    up, down = W.powers(len(codes) + 1)
    sums = np.concatenate(
        [[np.uint64(0)], np.cumsum(W.mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])]
    )
    return W.mixed((sums[-1:] - sums[:1]) * down[:1])[0]


def test_anchors_are_the_closed_syncmers():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé日 ") for _ in range(n)) for n in (200, 0, 60, 49)]
    for text, (values, places) in zip(texts, syncmers.anchors(texts, 16, 8)):
        want = brute_anchors(text, 16, 8)
        assert {(text[p : p + 16], p) for p in places.tolist()} == want
        for v, p in zip(values.tolist(), places.tolist()):
            assert v == int(hash_of(text[p : p + 16])) >> 32


def test_fingerprints_of_odd_texts(spark):
    docs = spark.createDataFrame([(t, "x") for t in ODD * 2], "text string, fingerprint string")
    got = {}
    for r in syncmers.fingerprints(docs).collect():
        assert got.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert got[None] == got[""] == "" and len({got[t] for t in ODD if t}) == len([t for t in ODD if t])
    one = syncmers.kept_anchors(syncmers.anchors(["some words stand here " * 20], 16, 8)[0], 64)
    none = syncmers.kept_anchors(syncmers.anchors([""], 16, 8)[0], 64)
    assert syncmers.likeness(one, one, 64) == syncmers.likeness(none, none, 64) == 1
    assert syncmers.likeness(one, none, 64) == 0


def test_edits_and_neighbours(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = {i * 3: " ".join(word() for _ in range(rng.randrange(0, 200))) for i in range(40)}
    texts[6] = None
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {
        r.doc_id: r
        for r in syncmers.compared_with_edits(
            spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        ).collect()
    }
    ids = sorted(texts)
    for i, k in enumerate(ids):
        mine, after = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        q = len(mine) // 4
        edited = mine[: len(mine) - q] + after[:q]
        assert got[k].n_chars == len(mine)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_edited >= 0.5 or len(mine) < 100
        assert got[k].near_next < 0.2 or not (mine and after)
    alone = spark.createDataFrame([(None, "abc")], "doc_id bigint, text string")
    assert syncmers.compared_with_edits(alone).first().near_next == 1.0
    assert syncmers.compared_with_edits(alone.where("false")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a>One</a><li>Two</ul></nav><script>var a="</p><p>no";</script>
<div class="cookie-notice"><p>We use cookies, as you know. Accept.</p></div>
<div id="wrap">%s</div><aside><p>Aside text, long enough. Really.</p></aside>
<section id="comments"><h3>Comments</h3><p>Great text, really! I like it.</p></section>
<form><p>Your mail, please.</p></form><footer>Foot, all rights.</footer></body></html>"""
BODY = """<h1>A title</h1><p>First &amp; last,   with <b>bold</b><br>text &lt;here&gt;.
<p>Second&nbsp;one. It is longer, and has marks; many.</p><div class="ad"><p>Buy now! Cheap, good.</p></div>
<ul><li>item one<li>item two</ul><!-- <p>hidden</p> --><p>Third, the last of them. It ends here.</p>"""
WANT = """A title
First & last, with bold text <here>.
Second one. It is longer, and has marks; many.
item one
item two
Third, the last of them. It ends here."""


@pytest.mark.parametrize("box", ["<article>%s</article>", "<div class='post'>%s</div>", "<main>%s"])
def test_main_text(box):
    assert html_text.main_text(PAGE % (box % BODY)) == WANT


P = "<p>A sentence of the text, long enough to count. It has marks, and an end; number %d.</p>"


def test_sibling_containers():
    two = [re.sub("<.*?>", "", P % i) for i in (1, 2)]
    page = f"<body><article><header><h1>T</h1></header><div class=entry>{P % 1}{P % 2}</div></article>"
    assert html_text.main_text(page) == "\n".join(["T", *two])
    page = f"<body><div class=s1>{P % 1}</div><div class=s2>{P % 2}</div></body>"
    assert html_text.main_text(page) == "\n".join(two)
    page = f"<body><div class=top><h1>T</h1></div><div class=entry>{P % 1}{P % 2}</div></body>"
    assert html_text.main_text(page) == "\n".join(["T", *two])


@pytest.mark.parametrize("wrap", [
    "<div class='layout has-sidebar'><article>%s</article></div>",
    "<article class='post comments-open'>%s</article>",
    "<div id='share-page'>%s</div>",
    "<div class='sidebar wide'><main>%s</main></div>",
    "<svg width='1' /><article>%s</article><svg><p>no</p></svg>",
])
def test_hints_are_no_verdict(wrap):
    body = P % 1 + P % 2 + "<div class=ad><p>Buy now! Cheap, good.</p></div>" + P % 3
    page = f"<body>{wrap % body}<p>Stray line.</p><div class=comments><p>Great, really.</p></div>"
    got = html_text.main_text(page).split("\n")
    assert got[:3] == [re.sub("<.*?>", "", P % i) for i in (1, 2, 3)]
    assert got[3:] in ([], ["Stray line."])


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text", "<p>only", "<nav>a</nav>", "<", "a < b", "<p" * 300,
             "<div>" * 3000 + "deep" + "</div>" * 10, "<script>never closed", "&#233;&amp;lt;"]
    df = spark.createDataFrame(
        [(i, p, 1) for i, p in enumerate(pages)], "page_id int, html string, text int"
    )
    got = [r.text for r in html_text.extract_text(df).orderBy("page_id").collect()]
    assert got[:6] == ["", "", "", "plain text", "only", ""] and got[7] == "a < b"
    assert got[9] == "deep" and got[10] == "" and got[11] == "é&lt;"
    assert html_text.extract_text(df.where("false")).count() == 0


def plain(block):
    return re.sub("<.*?>", "", block)


REMARK = "<p>What a great post, thank you so much! I read it twice, and liked it, as ever.</p>" * 12


@pytest.mark.parametrize("page", [
    "<div class=post>%s</div><div id=comments>%s</div>",
    "<div class=post>%s</div><section class=responses>%s</section>",
    "<div class=post>%s</div><div class=discussion>%s</div>",
    "<article>%s<div class='comment-list'>%s</div></article>",
    "<article>%s</article><div class='sidebar'><div class=comments><article>%s</article></div></div>",
])
def test_long_comments_are_no_content(page):
    got = html_text.main_text("<body>" + page % (P % 1 + P % 2, REMARK))
    assert got.split("\n") == [plain(P % i) for i in (1, 2)]


def test_subject_words_do_not_cost_article_text():
    levels = (P % 2).replace("<p>", "<p class='alert-levels'>")
    page = (
        f"<body><nav>{P % 9}</nav><article><h1>T</h1>{P % 1}{levels}<div id='social'>{P % 3}</div>"
        "<ul><li>short</li></ul><div class=buy>Buy now</div><div class=tags>Tags a b</div></article>"
    )
    want = ["T", *(plain(P % i) for i in (1, 2, 3)), "short"]
    assert html_text.main_text(page).split("\n") == want


def test_scores_decide(monkeypatch):
    page = PAGE % ("<article>%s</article>" % BODY)
    assert html_text.main_text(page) == WANT
    scores = html_text.path_scores

    def inverted(blocks):
        found, least = scores(blocks)
        return {k: max(found.values()) - v for k, v in found.items()}, least

    monkeypatch.setattr(html_text, "path_scores", inverted)
    assert "We use cookies" in html_text.main_text(page)


def test_whole_page_in_a_form_and_only_set_apart_text():
    page = f"<body><form>{P % 1}{P % 2}<label>Name</label></form><footer>{P % 3}</footer>"
    assert html_text.main_text(page).split("\n") == [plain(P % i) for i in (1, 2)]
    assert html_text.main_text("<footer>all rights</footer><div class=comments>Great.</div>") == ""
    assert html_text.main_text(f"<div hidden>{P % 1}</div><p style='display: none'>no</p>") == ""


def test_many_open_elements_take_time_and_paths_by_page_length():
    paths = {n.path for n, _ in html_text.blocks_of("<div>x" * 20_000)}
    assert len(paths) == 20_000 and max(paths) <= 20_000
    assert html_text.main_text("<div>" * 200_000 + "deep").endswith("deep")
