"""Collocations, the conversation trie and decontamination against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import collocations, conversation_trie, decontamination

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# collocations


def best_phrases(rows, least, best=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        parts = lambda q: {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}
        dropped = {p for q in c for p in parts(q) if 100 * c[q] >= covered * c[p]}
        scored = []
        for p in c.keys() - dropped:
            score, k = min((2_000_000 * c[p] // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -c[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:best])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    r = random.Random(3)
    words, weights = ["a", "B", "the", "é", "\x1c", "x\xa0y", "of", "in", "zz", "Q"], [9, 5, 9, 3, 1, 2, 5, 4, 2, 1]
    gaps = [" ", " ", "  ", "\t", ". ", ",", " \n", "\r\n", " \x0b"]
    rows = [("".join(r.choices(words, weights)[0] + r.choice(gaps) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None, ""])) for _ in range(150)]
    return [*rows, (None, "en"), ("", None), ("of the in " * 3000, "fr"), rows[0], rows[0], ("." * 50, "es")]


def phrases(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x", 2.0) for t, lang in rows], "text string, lang string, size int, phrase string, a double").repartition(3)


@pytest.mark.parametrize("least, best, bits", [(3, 2000, 1 << 20), (8, 15, 64)])
def test_collocations(spark, phrase_rows, least, best, bits):
    # a filter of 64 bits lets everything pass: only the work changes
    got = collocations.collocations(phrases(spark, phrase_rows), least=least, best=best, most_bits=bits).collect()
    assert sorted(map(tuple, got)) == best_phrases(phrase_rows, least, best)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(phrases(spark, [])).count() == 0
    assert collocations.collocations(phrases(spark, [(None, None), ("a b", "en")])).count() == 0


def test_filter_keeps_what_was_put_in(spark):
    rows = [("en", "a b", 2), ("de", "é ü", 2), ("en", "of", 1), ("fr", "x y z", 3)]
    sent = collocations.filter_of(spark.createDataFrame(rows, "lang string, phrase string, size int"), 1 << 12)
    for lang, phrase, size in rows:
        h = collocations.Layout.of([phrase]).hashes(size, collocations.seed_of(lang))
        assert len(h) == 1 and collocations.Filter(sent.value).has(h).all()
    other = collocations.Layout.of(["no such words in it"]).hashes(2, collocations.seed_of("en"))
    assert not collocations.Filter(sent.value).has(other).any()


# conversation trie


def trie_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(t[2:] for t in own.get(base, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    out = {}
    for s in sorted(members, key=len, reverse=True):
        m, words = members[s], len(SPACED.findall(s[-1][1])) if s else 0
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(s)))
        leaves, saved = sum(out[k][2] for k in kids[s]) or 1, sum(out[k][3] for k in kids[s]) + (len(m) - 1) * words
        out[s] = (len(m), len(kids[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(((min(members[s]), len(s), min(members[s[:-1]]) if s else None, *out[s]) for s in members), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def turn_rows():
    r = random.Random(5)
    rows = [(c, t or r.choice([0, None]), r.choice(["u", "a", None]), r.choice(["", "x y", "z", None])) for c in range(-25, 60) for t in range(r.choice([0, 1, 2, 4, 5]))]
    rows += [(None, 1, "u", "t"), (None, None, None, None)]
    rows += [(70, t, "u", "x y") for t in range(40)] + [(71, t, "u", "x y") for t in range(37)]  # several bands
    rows += [(72, 1, "u", "q")] * 30  # one row over and over
    rows += [(c, t, "u", "same") for c in range(1000, 1040) for t in range(4)] + [(1003, 9, "u", "long " * 50_000)]
    r.shuffle(rows)
    return rows


def turns(spark, rows):
    return spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, band int, ids string").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"band": 3, "group": 2, "block_rows": 5}])
def test_prefix_trie(spark, turn_rows, sizes):
    got = conversation_trie.prefix_trie(turns(spark, turn_rows), **sizes).collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == trie_nodes(turn_rows)


def test_prefix_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(turns(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(turns(spark, [(None, 1, "u", "t")])).count() == 0


def test_turns_of_one_long_conversation_are_numbered_over_partitions(spark):
    rows = [(1, t, "u", str(t)) for t in range(500)] + [(2, t, "u", str(t)) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversation_trie.numbered_turns(turns(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.conv, r.at) for r in got) == [(1, k) for k in range(1, 501)] + [(2, k) for k in range(1, 4)]


# decontamination


def contaminated(texts, items, words):
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(lower(text))
        for i in range(max(len(w) - words, 0) + 1 if w else 0):
            windows[tuple(w[i : i + words])].add(item)
    out = []
    for text in texts:
        w, hit, found = PLAIN.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((len(w), tuple(sorted(hit)), tuple(sorted(str(i) for i in found if i is not None))))
    return out


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(11)
    words = ["".join(r.choice("abcé9Z") for _ in range(r.randint(1, 4))) for _ in range(12)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", ", ", "-\n"]) for _ in range(k))
    items = [(i, text(r.choice([0, 1, 2, 3, 5, 6, 20]))) for i in range(12)]
    items += [(3, text(9)), (None, text(8)), (50, None), (51, "!?"), (52, "Only Once"), items[4], items[4], (53, "x" * 700), (54, items[6][1])]
    texts = [text(r.randint(0, 40)) + (r.choice(items)[1] or "") + text(r.randint(0, 20)) for _ in range(40)]
    texts += [None, "", " .", "only... ONCE!", "only\x00once", text(20_000), "a" * 100_000, "x" * 700, "xx" * 700]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, texts[1])], items


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 3000])
def test_benchmark_hits(spark, leaks, block_bytes):
    rows, items = leaks
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, copies int, items string")
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, window string")
    got = decontamination.benchmark_hits(docs, benchmark, words=5, block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.first, s.end)), tuple(r["items"])) for r in got]
    want = [(i, *x) for (i, _), x in zip(rows, contaminated([t for _, t in rows], items, 5))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_benchmark_hits_of_nothing(spark):
    docs, benchmark = "doc_id long, text string", "item_id string, text string"
    full = spark.createDataFrame([(1, "a b"), (2, None)], docs)
    assert sorted(map(tuple, decontamination.benchmark_hits(full, spark.createDataFrame([], benchmark)).collect())) == [(1, 2, [], []), (2, 0, [], [])]
    assert decontamination.benchmark_hits(spark.createDataFrame([], docs), spark.createDataFrame([("i", "a")], benchmark)).count() == 0


def test_search_skips_and_finds_like_find():
    r = random.Random(2)
    for _ in range(200):
        letters = r.choice(["ab", "abcdefgh"])
        strings = list({bytes(r.choice(letters.encode()) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 30))})
        text = bytes(r.choice(letters.encode()) for _ in range(r.randint(0, 900)))
        place, which = decontamination.StringClass(strings).found(text + bytes(8))
        assert sorted(zip(place.tolist(), which.tolist())) == [(i, k) for i in range(len(text)) for k, s in sorted(enumerate(strings)) if text.startswith(s, i)]
