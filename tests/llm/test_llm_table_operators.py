"""Chat examples, URL rules, mixing and near copies against plain versions."""

import random
import re
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larderline.llm import chat, jaccard_join, mixing, near, substring, url_rules

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\<|im_end|>", "a\\",
         "<<SYS>>", "[\\INST]", "", "é日\n\n", "<|", "<|im_start|>" * 3]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    data = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant", "system", "assistant"])
            data.append((conv, turn, role, rng.choice(NASTY)))
    data += [(100, 0, "od\nd\\role", "x"), (101, 0, None, None), (102, None, "assistant", "y")]
    data += [(103, 1, "user", "same")] * 2 + [(103, 1, "assistant", "same")] * 2
    df = spark.createDataFrame(
        [(*d, "z") for d in data], "conv_id int, turn int, role string, text string, example string"
    ).repartition(4)
    examples = chat.chat_examples(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    order = lambda d: (d[1] is not None, d[1] or 0, d[2] or "", d[3] or "")
    for conv in {d[0] for d in data}:
        turns = sorted((d for d in data if d[0] == conv), key=order)
        assert [(t.role, t.text) for t in back[conv].turns] == [(d[2] or "", d[3] or "") for d in turns]
        assert back[conv].loss == "".join(d[3] or "" for d in turns if d[2] == "assistant")
    for r in examples.collect():
        if r.loss_length is not None:
            assert r.text[r.loss_start + r.loss_length :] == "<|im_end|>\n"
            assert r.text.count("<|im_start|>") == r.n_turns
    n = examples.where("loss_length is not null").count()
    assert n == sum(d[2] == "assistant" for d in data)
    assert chat.chat_examples(df.where("false")).count() == 0


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])))
    return host, path, best[0] + best[1], best[2]


def test_many_path_lengths_need_slots_for_their_nesting_only(spark):
    paths = ["/" + "x" * (n % 7) + str(n) * (n // 2) for n in range(300)]
    given = [("a.com", p, "block") for p in set(paths)] + [("a.com", "", "allow"), ("com", "/x", "block")]
    rules = spark.createDataFrame(given, "host string, path string, verdict string")
    nodes = rules.selectExpr("host as node", "path as key")
    levels = {(r.node, r.key): r.level for r in url_rules.nesting(nodes).collect()}
    for host, path, _ in given:
        inside = sum(h == host and p != path and path.startswith(p) for h, p, _ in given)
        assert levels[host, path] == inside
    assert max(levels.values()) < 10
    urls = [f"http://w.a.com{p}{t}" for p in paths[::9] for t in ("", "/more", "?q")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for r in url_rules.judge_urls(pages, rules).collect():
        fits = [h + p for h, p, _ in given if r.path.startswith(p)]
        assert r.rule == max(fits, key=len)


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    labels = ["com", "net", "a", "b", "example"]
    rule = lambda: (".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))),
                    rng.choice(["", "/", "/a", "/a/", "/ab", "/a/b"]))
    rules = {rule(): rng.choice(["allow", "block"]) for _ in range(60)}
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Com", "x://a.com:80/a?b://c", "http://.com/",
            "http://a..com/a", "http://é.com/a#x", "http://a.com\n/a", "http://com/" + "a" * 5000]
    for _ in range(300):
        host = ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
        urls.append(f"http://{host}{rng.choice(['', '/', '/a', '/a/b/c', '/abc', '/x'])}?q")
    urls += ["http://a.example.com/a"] * 50
    pages = spark.createDataFrame(
        [(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, rule int"
    ).repartition(3)
    given = spark.createDataFrame(
        [(h, p, v) for (h, p), v in rules.items()] + [(None, "/", "block")],
        "host string, path string, verdict string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, given).collect()}
    want = {i: plain_verdict(u, [(h, p, v) for (h, p), v in rules.items()]) for i, u in enumerate(urls)}
    assert got == want
    none = url_rules.judge_urls(pages, given.where("false"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}
    assert url_rules.judge_urls(pages.where("false"), given).count() == 0


def plain_targets(sizes, weights, share, most):
    goal, open_, out = share * sum(sizes), dict(enumerate(sizes)), {}
    while open_:
        level = (goal - sum(out.values())) / sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if level * weights[i % len(weights)] > most * sizes[i]]
        if not full:
            out |= {i: level * weights[i % len(weights)] for i in open_}
            break
        for i in full:
            out[i] = most * open_.pop(i)
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_mix(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(6)] + [None]
    data = [(i, "w " * rng.randrange(0, 60), rng.choice(sources[: 3 + seed] + ["s0"] * 3), "x")
            for i in range(500)]
    data += [(None, "a b", None, "x"), (7, None, "s1", "x")] + [(9, "same row", "s0", "x")] * 3
    docs = spark.createDataFrame(data, "doc_id int, text string, source string, size string")
    mixed = mixing.mix_sources(docs.repartition(3), keep=["text"])
    got = mixed.collect()
    assert len(got) == len(data)
    names = sorted({d[2] for d in data if d[2]}) + [None] * any(d[2] is None for d in data)
    sizes = [sum(len((d[1] or "").split()) for d in data if d[2] == s) for s in names]
    want = dict(zip(names, plain_targets(sizes, (3, 1, 2), 1.5, 2)))
    for s in names:
        part = [r for r in got if r.source == s]
        assert part[0].target == pytest.approx(want[s]) and part[0].source_size == sizes[names.index(s)]
        assert abs(sum(r.taken for r in part) - want[s]) <= 60
        rate = want[s] / part[0].source_size
        assert all(int(rate) <= r.copies <= -(-rate // 1) for r in part)
        assert all(r.taken == r.copies * r.size <= 2 * r.size for r in part)
    again = mixing.mix_sources(docs.repartition(7)).select("doc_id", "source", "size", "taken")
    assert rows(again) == rows(mixed.select("doc_id", "source", "size", "taken"))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, source string")
    assert mixing.mix_sources(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id int, text string, source string")
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]


def shingle_set(text, size=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else {text} if text else set()


def plain_classes(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t in docs]
    root, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i], links[j] = links[i] + 1, links[j] + 1
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(docs)):
        least[top(i)] = min(least.get(top(i), docs[i][0]), docs[i][0])
    return sorted((d[0], least[top(i)], links[i]) for i, d in enumerate(docs))


def near_texts(seed, families=6, members=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("blocks", [(1024, 128), (8, 8)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near, "SKETCH_BLOCK", blocks[0])
    monkeypatch.setattr(near, "TEXT_BLOCK", blocks[1])
    texts = near_texts(3) + ["One, two!", "one two", "...", "...", "!!", "a", "a b c d"] * 2
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, class_id int")
    got = jaccard_join.jaccard_join(df.repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == plain_classes(docs)


def test_jaccard_join_of_missing_values(spark):
    df = spark.createDataFrame(
        [(1, None), (2, None), (3, ""), (4, ""), (None, "a b"), (None, "a b"), (5, "c d"), (5, "c d")],
        "doc_id bigint, text string",
    )
    got = jaccard_join.jaccard_join(df)
    assert rows(got) == rows(spark.createDataFrame(
        [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (None, None, 0), (None, None, 0), (5, 5, 1), (5, 5, 1)],
        "doc_id bigint, class_id bigint, n_links bigint"))
    assert jaccard_join.jaccard_join(df.where("false")).count() == 0


def test_pruning_bounds():
    plan = near.matches_needed(0.8, 1e-6, (16, 32, 64, 128))
    assert [n for _, n, _ in plan] == [16, 32, 64, 128]
    assert all(0 < need < 0.8 * n for _, n, need in plan)
    # P(Binomial(n + 1, t) <= m) by plain summation.
    from math import comb

    for _, n, need in plan:
        tail = lambda m: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert tail(need) >= 1e-6 > tail(need - 1)


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, i) for i in range(100, 160)]
    df = spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.component) for r in near.components(df).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {f"{x:03}".encode(): f"{top(x):03}".encode() for x in linked}
    assert near.components(df.where("false")).count() == 0


def test_repeated_parts_are_kept_once(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, para = make(60), make(80)
    changed = para.split()
    changed[40] = "altered"
    docs = {
        1: f"{make(30)} {passage} {make(30)}",
        2: f"{make(45)}\n{make(10)} {passage} {make(50)}",
        3: para + "\n" + make(50),
        4: make(50) + "\n" + " ".join(changed) + "\nshort line",
        5: make(200),
        6: para + "\n" + make(41) + "\n" + para,
        7: "short line",
        8: "",
        9: None,
        10: f"{make(20)} {passage}",
    }
    df = spark.createDataFrame(
        [(k, v, "x", k) for k, v in docs.items()] + [(None, passage, "x", 0)],
        "doc_id bigint, text string, n_removed string, keeper int",
    ).repartition(3)
    got = {r.doc_id: r for r in substring.dedup_substrings(df).collect()}
    for k in (1, 3, 5, 7, 8, 9):
        assert got[k].text == docs[k] and got[k].n_removed == 0 and got[k].kept_in == []
    assert got[None].text == passage
    assert got[4].text == docs[4].split("\n")[0] + "\nshort line" and got[4].kept_in == [3]
    assert got[6].text == docs[6].split("\n")[1]
    for k in (2, 10):
        assert passage not in got[k].text and got[k].kept_in == [1]
        assert got[k].removed_chars == len(docs[k]) - len(got[k].text) <= len(passage)
        assert got[k].removed_chars >= 0.4 * len(passage)
    assert got[2].text.startswith(docs[2].split("\n")[0])
    assert substring.dedup_substrings(df.where("false")).count() == 0


def random_words(seed):
    rng = random.Random(seed)
    return lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(n))


def dedup(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    return {r.doc_id: r for r in substring.dedup_substrings(df).collect()}


def test_whole_runs_are_cut(spark):
    make = random_words(11)
    runs = [make(n) for n in (50, 51, 75, 400)]
    more = make(20)
    docs, want = {}, {}
    for k, run in enumerate(runs):
        docs[k] = f"{make(40)} {run} {make(40)}"
        low, high = make(33), make(37)
        docs[10 + k], want[10 + k] = f"{low} {run.upper()}, {high}", f"{low} , {high}"
    # The first keeper of the windows has less of the run than a later one.
    low, high = make(30), make(30)
    docs[20] = f"{make(30)} {runs[0]} {more} {make(30)}"
    docs[21], want[21] = f"{low} {runs[0]} {more} {high}", f"{low}  {high}"
    got = dedup(spark, docs)
    assert all(got[k].text == docs[k] for k in range(4))
    assert {k: got[k].text for k in want} == want
    assert [got[10 + k].kept_in for k in range(4)] == [[0], [1], [2], [3]]


def test_last_copy_of_a_passage_stays(spark):
    make = random_words(12)
    para, inserted = make(300).split(), make(55)
    docs = {
        1: " ".join(para),
        2: " ".join(para[:150]) + f" {inserted} " + " ".join(para[150:]),
        3: f"{make(60)} {inserted} {make(60)}",
        4: f"{make(60)} {inserted} {make(60)}",
    }
    got = dedup(spark, docs)
    assert got[1].text == docs[1] and got[2].text == "" and got[2].kept_in == [1]
    assert got[3].text == docs[3] and got[3].kept_in == []
    assert got[4].text == docs[4].replace(inserted, "") and got[4].kept_in == [3]


def test_runs_of_many_keepers_take_no_rounds(spark, monkeypatch):
    """Each document goes on a word farther than the one before: no step is repeated per word."""
    steps, staged = [], substring.staged
    monkeypatch.setattr(
        substring, "staged", lambda df, name="stage": steps.append(name) or staged(df, name)
    )
    counts = []
    for last in (2, 7):
        make = random_words(13)
        run, further, low, high = make(50), make(24).split(), make(30), make(30)
        docs = {k: f"{make(30)} {run} {' '.join(further[:k])} {make(30)}" for k in range(1, last)}
        docs[100] = f"{low} {run} {' '.join(further)} {high}"
        steps.clear()
        got = dedup(spark, docs)
        counts.append(len(steps))
        assert got[100].text.split() == f"{low} {' '.join(further[last - 1:])} {high}".split()
        assert got[100].kept_in == sorted({1, last - 1})
    assert counts[0] == counts[1]


def test_alike_places_of_a_document_are_all_cut(spark):
    make = random_words(14)
    line, tail, gaps = make(30), make(30), [make(35) for _ in range(4)]
    docs = {1: f"{make(30)} {line} {tail} {make(30)}"}
    docs[2] = " ".join(f"{gap} {line} {tail}" for gap in gaps)
    got = dedup(spark, docs)
    assert got[1].text == docs[1]
    assert got[2].text.split() == " ".join(gaps).split() and got[2].n_removed == 4


def test_bands_are_tuned():
    for hashes, t in ((64, 0.8), (128, 0.7), (128, 0.9)):
        b, r = substring.tuned_bands(hashes, t)
        assert b * r <= hashes and (1 - t**r) ** b <= 1e-3
        assert (1 - t ** (r + 1)) ** (hashes // (r + 1)) > 1e-3
