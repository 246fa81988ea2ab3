"""Conversation repair, periodic runs and quality rules against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larderline.llm import quality, repair, runs
from larderline.llm.queries import REGISTRY, damaged, with_repeated_tails

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "...", "a", "a a a a a a", "Ä\xa0Ä Ä\x85Ä", "x" * 5000, "a b " * 3000, "日本 " * 9]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair


def every_edit(turns, most_inserted=4):
    """All edits of a few turns, one by one."""
    best = None

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if i == len(turns) and state in repair.ENDS and (best is None or (cost, audit) < best):
            best = cost, audit
        for initial, then in repair.NEXT[state].items():
            if initial != "s" and inserted < most_inserted:
                go(i, then, cost + 3, audit + "I", inserted + 1)
            if i < len(turns) and not turns[i].must_go:
                more = 3 if turns[i].truncated else 0
                if turns[i].initial == initial:
                    go(i + 1, then, cost + more, audit + "K", inserted)
                if initial != "s":
                    go(i + 1, then, cost + 3 + more, audit + "R", inserted)
        if i < len(turns):
            go(i + 1, state, cost + 4, audit + "D", inserted)

    go(0, repair.START, 0, "", 0)
    return best


def random_turns(rng, n):
    return [
        repair.Turn(rng.choice("suuaaax "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)
    ]


def test_cheapest_edits_are_the_best_of_all():
    rng = random.Random(11)
    for _ in range(400):
        turns = random_turns(rng, rng.randrange(5))
        assert repair.cheapest_edits(turns) == every_edit(turns)


def test_parts_of_long_conversations_join(monkeypatch):
    rng = random.Random(12)
    for _ in range(100):
        turns = random_turns(rng, rng.randrange(30))
        monkeypatch.setattr(repair, "PART", 256)
        whole = repair.cheapest_edits(turns)
        monkeypatch.setattr(repair, "PART", rng.choice([1, 2, 7]))
        assert repair.cheapest_edits(turns) == whole


def test_repaired_conversations(spark):
    given = [
        (1, 0, "system", "Be short."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."),
        (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 5, "assistant", "cut off"),
        (3, None, "assistant", "Yes."), (3, 4, None, None), (3, 6, "tool", "\t\u2003."),
        (None, 1, "user", ""),
        (4, 2, "assistant", "A."), (4, 1, "assistant", "A."),
        (5, 0, "user", "one. "), (5, 1, "system", "two."), (5, 2, "assistant", "x" * 100_000 + "!"),
    ]
    turns = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumns({"audit": F.lit("x"), "gaps": F.lit(7), "_turns": F.lit(0)})
    got = {r.conv_id: r for r in repair.repair_conversations(turns).collect()}
    assert sorted(got, key=str) == [1, 2, 3, 4, 5, None]

    def facts(k):
        r = got[k]
        return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit

    def said(k):
        return [(t.role, t.text[:10]) for t in got[k].turns]

    assert facts(1) == (0, 0, 0, 0, 0, 0, "KKK")
    assert facts(2) == (4, 0, 1, 1, 1, 7, "KDK")
    assert said(2) == [("user", "Hi."), ("assistant", "cut off")]
    assert facts(3) == (1, 1, 0, 0, 2, 10, "RDR")
    assert said(3) == [("user", "Yes."), ("assistant", "\t\u2003.")]
    assert facts(None) == (0, 1, 0, 0, 0, 4, "D") and said(None) == []
    assert facts(4) == (0, 0, 1, 0, 1, 7, "IKD")
    assert said(4) == [("user", ""), ("assistant", "A.")]
    assert facts(5) == (0, 0, 0, 0, 2, 4, "KDK")
    assert repair.repair_conversations(turns.where("false")).count() == 0


def test_every_conversation_comes_back(spark, tmp_path):
    given = [(k, t, "user", f"{k} {t}.") for k in range(40) for t in range(2)] + [(None, None, None, None)]
    spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    got = REGISTRY["op11_repair"].run(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id for r in got), key=str) == sorted([*range(40), None], key=str)
    lost = [
        k for k in range(40) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 == 0 for t in range(2))
    ]
    for r in got:
        if r.conv_id in lost:
            assert (r.cost, r.audit, r.repaired_sha256) == (0, "", sha(""))


def test_damage_by_checksum(spark):
    given = [(k, 0, "assistant", "A. B? C!") for k in range(200)]
    turns = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for k, turn, role, text in given:
        kind = zlib.crc32(f"{k}:{turn}".encode()) % 20
        text = "" if kind == 1 else "A B C" if kind == 2 else text
        want += [(k, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert rows(damaged(turns)) == sorted(want, key=repr)


# Periodic runs


def plain_runs(words, exponent=4, least=6):
    found, n = {}, len(words)
    for period in range(1, n // exponent + 1):
        i = period
        while i < n:
            j = i
            while j < n and words[j] == words[j - period]:
                j += 1
            start, size = i - period, j - i + period
            # Multiples of a shorter period find the same stretch again.
            if size >= max(least, exponent * period) and (start, size) not in found:
                found[start, size] = period
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    gone = {i for start, size, period in found for i in range(start + period, start + size)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("exponent", [3, 4, 6])
def test_runs_are_those_of_the_definition(exponent):
    rng = random.Random(exponent)
    for _ in range(1500):
        kinds, words = rng.choice([1, 2, 2, 3, 5]), []
        n = rng.randrange(70)
        while len(words) < n:
            part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 7))]
            words += part * rng.choice([1, 1, 2, 3, 5, 8])
        assert runs.runs_of(np.array(words, dtype=np.int64), exponent) == plain_runs(words, exponent)


def test_stretches_lose_no_word_of_a_run():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.randrange(4) for _ in range(40)] + rng.choices(range(9), k=rng.randrange(1, 9)) * 5
        words += [rng.randrange(4) for _ in range(40)]
        spans = runs.stretches(np.array(words), 4)
        for start, size, _ in plain_runs(words):
            assert any(a <= start and start + size <= b for a, b in spans)


def test_every_root_path_is_found_by_access():
    rng = random.Random(8)
    for _ in range(50):
        words = [rng.randrange(3) for _ in range(40)]
        link, length, state = runs.suffix_automaton(words)
        ends, last = runs.LastEnds(link, length), {}
        for i, s in enumerate(state):
            path = []
            while s != 1:
                path.append(s)
                s = link[s]
            want = {}
            for node in path:
                if node in last:
                    want[last[node]] = max(want.get(last[node], 0), length[node])
                last[node] = i
            assert dict(ends.access(state[i], i)) == want


def test_runs_of_documents(spark):
    table = [(i, text, "kept") for i, text in enumerate(ODD)] + [(1, "", "kept"), (None, "b b b b b b c", None)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, runs string")
    got = runs.periodic_runs(docs.withColumn("n_words", F.lit("gone")))
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    seen = got.collect()
    assert len(seen) == len(table)
    for r in seen:
        words = WORD.findall(r.text or "")
        found = plain_runs(words) if len(words) < 5000 else [(0, 6000, 2)]
        assert r.n_words == len(words)
        assert [tuple(x) for x in r.runs] == found
        assert r.collapsed == " ".join(without_repeats(words, found))
    assert runs.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="3 periods"):
        runs.periodic_runs(docs, exponent=2)


def test_op12_against_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10**6 + i, text) for i, text in enumerate(ODD)] + [(None, "a " * 50)], "doc_id bigint, text string"
    )
    texts = docs.select("doc_id", "text").unionByName(odd)
    changed = {r.doc_id: r.text for r in with_repeated_tails(texts).collect()}
    got = {r.doc_id: r for r in REGISTRY["op12_runs"].run(spark, SF).collect()}
    checked = 0
    for r in texts.collect():
        words = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if r.doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert WORD.findall(changed[r.doc_id] or "") == words
        if r.doc_id not in got or n > 1500:
            continue
        found, row = plain_runs(words), got[r.doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in found))
        assert row.collapsed_sha256 == sha(" ".join(without_repeats(words, found)))
        checked += 1
    assert checked > 150


# Quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(inside)


def test_counts_of_texts():
    rng = random.Random(2)
    texts = [t for t in ODD if len(t or "") < 6000] + ["a\nb\n \na\n\na", "#a *b\r\n#a *b\r\nc|d"]
    texts += ["".join(rng.choices("ab \n#", k=60)) for _ in range(300)]
    for text in texts:
        assert quality.counts_of(text)[:5] == plain_counts(text)


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    right, votes = [0.95, 0.9, 0.8, 0.7], []
    for r in right:
        vote = np.where(rng.random(len(good)) < r, good, ~good) * 2
        votes.append(np.where(rng.random(len(good)) < 0.2, quality.NONE, vote))
    patterns, times = np.unique(np.array(votes).T, axis=0, return_counts=True)
    share, chance = quality.estimate(patterns, times.astype(float))
    assert abs(share - 0.8) < 0.03
    for found, r in zip(chance, right):
        assert abs(found[1, quality.GOOD] / (1 - found[1, quality.NONE]) - r) < 0.05
        assert abs(found[1, quality.NONE] - 0.2) < 0.03


def test_quality_of_odd_documents(spark):
    clean = [(i, " ".join(f"word{'abcdefghij'[(i * k) % 10]}x{'.' * (k % 9 == 0)} w{'qrstu'[k % 5]}{'y' * (k % 7)}" for k in range(60)), 1) for i in range(30)]
    table = [*clean, *[(100 + i, t, 0) for i, t in enumerate(ODD)], (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, votes int")
    counted = quality.text_counts(docs.withColumn("n_lines", F.lit("gone")))
    assert counted.columns == ["doc_id", "votes", *quality.COUNTS]
    judged = quality.judge_quality(counted).collect()
    assert len(judged) == len(table)
    for r in judged:
        assert 0 <= r.quality <= 1
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    empty = quality.judge_quality(counted.where("false"))
    assert empty.count() == 0


def test_rules_agree_with_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("benchmark tables not present")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = REGISTRY["op13_quality"].run(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        if len(docs[r.doc_id]) < 4000:
            counts = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
            assert counts == plain_counts(docs[r.doc_id])
    judged = [r for r in got if r.doc_id in labels and not r.base_failed]
    right = sum(r.kept == (labels[r.doc_id] == 1) for r in judged)
    assert len(judged) > 200 and right / len(judged) > 0.98
