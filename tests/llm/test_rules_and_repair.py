"""Quality rules and conversation repair against plain versions on small fixtures."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from marlstone.llm import conversation, quality_rules


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 12 quality rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_measures_against_a_plain_version():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 9, 40, 300):
        for _ in range(20):
            text = "".join(rng.choice(["a", "b", "é#", "*", "\U0001f600", "c d"]) + rng.choice([" ", "\n", "\t", "\x0b", "\xa0", "\x1c", "\n\n"]) for _ in range(n))
            assert quality_rules.measures(text.encode())[:5] == plain_measures(text)


def test_quality_rules_on_edges(docs, none):
    got = rows(quality_rules.quality_rules(docs))
    assert len(got) == 11
    by = {r["row"]["doc_id"]: r for r in got}
    assert all(by[i]["n_words"] == 0 and by[i]["base_failed"] and not by[i]["kept"] for i in (3, 4, 5))
    assert by[6]["n_repeat_words"] == 5000 and by[6]["base_failed"] and by[1]["kept"] and by[1]["class_distance"] is None
    assert rows(quality_rules.quality_rules(none)) == []


def test_documents_unlike_their_language_are_dropped(spark):
    rng = random.Random(2)
    common, rare = ["the", "of", "and", "to", "in"], [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))
    data = [(i, prose(120), "en") for i in range(300)]
    data += [(1000 + i, prose(200).upper(), "en") for i in range(5)] + [(2000 + i, " ".join(w + "###" for w in prose(200).split()), "en") for i in range(5)]
    data += [(3000 + i, " ".join(rng.choice(rare) for _ in range(300)), "en") for i in range(5)] + [(4000 + i, prose(150), None) for i in range(2)] + [(5000, prose(12).upper(), "en")]
    kept = {r["row"]["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")))}
    assert {i for i, k in kept.items() if not k} == {i for i in kept if 1000 <= i < 4000}


# 13 conversation repair


def brute(conv):
    """The least (cost, audit) and the repaired rows by trying every string of edits row by row, with up to two insertions before each row."""
    nxt, want = conversation.NEXT, conversation.WANTED
    ways = {(0, "", 0, ())}
    for role, text, fault in conv:
        grown = set()
        for cost, audit, q, out in ways:
            for ins in range(3):
                c, a, s, o = cost + 5 * ins, audit + "I" * ins, q, out
                for _ in range(ins):
                    o, s = (*o, f"{want[s]}:"), nxt[s, want[s][0]]
                grown.add((c + 2, a + "D", s, o))
                if fault not in (conversation.BLANK, conversation.DUPLICATE):
                    more = 5 * (fault == conversation.TRUNCATED)
                    if (s, role[:1]) in nxt:
                        grown.add((c + more, a + "K", nxt[s, role[:1]], (*o, f"{role}:{text}")))
                    grown.add((c + 1 + more, a + "R", nxt[s, want[s][0]], (*o, f"{want[s]}:{text}")))
        ways = {min(g) for _, g in itertools.groupby(sorted(grown, key=lambda w: (w[2], w)), key=lambda w: w[2])}
    ends = []
    for cost, audit, q, out in ways:
        for ins in range(3):
            if q in (0, 3):
                ends.append((cost, audit, out))
            cost, audit, out, q = cost + 5, audit + "I", (*out, f"{want[q]}:"), nxt[q, want[q][0]]
    return min(ends)


def faults(conv):
    seen, out = set(), []
    for role, text in conv:
        out.append((role, text, conversation.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    return out


@pytest.mark.parametrize("block_rows", [1, 2, 3, 256])
def test_repair_against_trying_all_edits(spark, block_rows):
    rng = random.Random(block_rows)
    convs = {c: [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", "", "Why?", " \n", "So. it", f"{rng.random()}!"])) for _ in range(rng.choice([1, 2, 5, 9, 14]))] for c in range(60)}
    data = [(c, t, role, text) for c, conv in convs.items() for t, (role, text) in enumerate(conv)]
    rng.shuffle(data)
    got = {r["conv_id"]: r for r in rows(conversation.repair_summary(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), block_rows=block_rows))}
    assert len(got) == len(convs)
    for c, conv in convs.items():
        told = faults(conv)
        cost, audit, out = brute(told)
        assert (got[c]["cost"], got[c]["audit"]) == (cost, audit)
        assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(out).encode()).hexdigest()
        assert [got[c][k] for k in ("blank", "duplicate", "truncated")] == [sum(f == k for _, _, f in told) for k in (1, 2, 3)]
        assert got[c]["gaps"] == 0 and got[c]["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(conv, conv[1:]))


def test_repair_on_edges(spark):
    schema = "conv_id string, turn long, role string, text string, cost int, audit string, block string"
    data = [
        ("a", None, "user", "Hi.", 1, "x", "y"), ("a", 3, "assistant", "Yes.", 1, "x", "y"), ("a", 7, None, None, 1, "x", "y"),
        (None, 1, "user", "Go.", 1, "x", "y"), (None, 1, "user", "Go.", 1, "x", "y"), ("b", None, "system", "S.", 1, "x", "y"), ("long", 1, "user", "w " * 300000 + ".", 1, "x", "y"),
    ]
    frame = spark.createDataFrame(data, schema)
    ids = spark.createDataFrame([("a",), (None,), ("none",), ("a",), ("b",), ("long",)], "conv_id string")
    got = {r["conv_id"]: r for r in rows(conversation.repair_summary(frame, ids))}
    assert len(got) == 5
    assert (got["a"]["gaps"], got["a"]["blank"], got["a"]["audit"], got["a"]["illegal"]) == (3, 1, "KKD", 1)
    assert (got[None]["duplicate"], got[None]["audit"], got[None]["cost"]) == (1, "DD", 4)
    assert (got["b"]["audit"], got["b"]["gaps"]) == ("D", 0) and got["long"]["audit"] == "D"
    assert got["none"] == {"conv_id": "none", "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert rows(conversation.repair_summary(frame.limit(0))) == []


def test_a_long_conversation_is_chained_over_blocks(spark):
    rng = random.Random(9)
    conv = [(rng.choice(["user", "assistant"]), f"{i} {rng.choice(['ok.', 'cut', ''])}") for i in range(3000)]
    frame = spark.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(conv)], "conv_id long, turn long, role string, text string")
    got = rows(conversation.repair_summary(frame, block_rows=7))[0]
    want = conversation.lightest([(role, f) for role, _, f in faults(conv)], conversation.START, True)[conversation.GOAL]
    assert (got["cost"], got["audit"]) == want


def test_repaired_turns_alternate(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (1, 2, "user", "C.")], "conv_id long, turn long, role string, text string")
    turns = [t for r in sorted(rows(conversation.repaired(frame)), key=lambda r: r["block"]) for t in r["turns"]]
    assert [t["role"] for t in turns] == ["user", "assistant"] and [t["text"] for t in turns] == ["A.", "B."]
