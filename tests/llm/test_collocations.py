"""Phrase mining against a plain version on small fixtures."""

import random
import re
from collections import Counter

import pytest

from marlstone.llm import collocations


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain(docs, longest=3, least=10, top=2000):
    freq, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            freq.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in freq.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in cands.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (freq[lang, p[:k]] * freq[lang, p[k:]]), k, freq[lang, p[:k]], freq[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        for i, x in enumerate(sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]):
            ranked.append((lang, i + 1, *x[1:]))
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "É", "ç", "new", "York", "City", "x\x00y", " ", "d", "e", "\U0001f600"]
    text = lambda: "".join(rng.choice(words[: rng.choice([4, 12])]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\xa0"]) for _ in range(rng.choice([0, 3, 30, 200])))
    return [(rng.choice(["en", "d\te", None]), text() + " New York City." * rng.choice([0, 1])) for _ in range(60)] + [("en", None), ("en", ""), ("fr", "one")]


@pytest.mark.parametrize("shards,filter_bits,longest,top", [(1, 1 << 15, 3, 2000), (3, 1 << 20, 3, 2000), (4, 1 << 15, 4, 7)])
def test_collocations_against_a_plain_version(spark, shards, filter_bits, longest, top):
    docs = corpus(shards)
    frame = spark.createDataFrame([(lang, text, "x", 1) for lang, text in docs], "lang string, text string, phrase string, n int").repartition(3)
    assert sorted(rows(collocations.collocations(frame, shards=shards, filter_bits=filter_bits, longest=longest, top=top))) == plain(docs, longest=longest, top=top)


def test_late_phrases_complete_their_cycle(spark):
    """Words that reach the threshold in the last shard only make the scans go round again; each phrase is counted once a shard."""
    docs = [("en", "p q r")] * 11 + [("en", f"z{i}") for i in range(50)]
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    for shards in (2, 5):
        found = collocations.counted(frame, shards=shards)
        assert [(r["key"], r["n"]) for r in found[3].collect()] == [("en\tp q r", 11)]
        assert {r["key"]: r["n"] for r in found[2].collect()} == {"en\tp q": 11, "en\tq r": 11}


def test_false_hits_of_a_full_filter_change_nothing():
    words, full = [b"a", b"b", b"A", b"a", b"b", b"c"], b"\xff" * 4096
    assert {(k, tuple(p), tuple(n)) for k, p, n in collocations.count_phrases("en", list(words), 3, False, {1: full, 2: full}, {})} == {(2, (b"a b", b"b c"), (2, 1)), (3, (b"a b c",), (1,))}
    assert list(collocations.count_phrases("en", list(words), 3, False, {1: full, 2: full}, {1: full, 2: full})) == []


def test_collocations_on_edges(spark, docs, none):
    assert rows(collocations.collocations(none)) == []
    long = spark.createDataFrame([("en", "in the city " * 20000, 1)], "lang string, text string, a int")
    assert sorted(rows(collocations.collocations(long))) == plain([("en", "in the city " * 20000)])
    assert [r[2] for r in rows(collocations.collocations(docs))] == ["word word word"]


def test_texts_are_cut_at_pieces():
    text = b"a b. " * 1000
    parts = list(collocations._chunks(text, 100))
    assert len(parts) > 10 and b"".join(parts) == text.translate(collocations._TABLE)
    assert list(collocations._chunks(b"word " * 100, 10)) == [b"word " * 100]
