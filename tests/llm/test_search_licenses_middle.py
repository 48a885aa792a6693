"""License scan, ranked search and fill-in-the-middle against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from keytide.llm import boundaries, ranked_search
from keytide.llm.boundaries import BLOCK, ArrayContainer, BitmapContainer, BoundarySet, RunContainer
from keytide.llm.fill_middle import drawn, fill_in_middle, restored
from keytide.llm.license_texts import TEMPLATES
from keytide.llm.licenses import find_licenses
from keytide.llm.templates import Library, parse, words_of

SCHEMA = "doc_id long, text string, n_words int, score string, hash string"
LONG = "word " * 30_000
ODD = [(1, None, 1, "x", "x"), (2, "", 1, "x", "x"), (3, " \n\t ", 1, "x", "x"), (None, "a b", 1, "x", "x"),
       (4, LONG, 1, "x", "x"), (4, LONG, 1, "x", "x")]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(*r, *ODD[0][len(r):]) for r in rows], SCHEMA)


# --- templates


def accepted(template, words, start):
    """All ends of a template that begins at a word, by trying every way."""
    ends = set()

    def go(i, at):
        if i == len(template.elements):
            ends.add(at)
            return
        for low, high in template.skips:
            if low == i:
                go(high, at)
        if at < len(words) and template.elements[i].word in (None, words[at]):
            go(i + 1, at + 1)

    go(0, start)
    return ends


SMALL = {
    "x": "a b {{c}} {{d {{e}}}} <<any:2>> f",
    "y": "{{a}} b <<any:3>> {{c <<any:1>>}} a",
    "x#other": "b b {{{{a}} b}} c",
    "z": "f f",
}


def test_templates_accept_what_trying_every_way_accepts():
    rng, library = random.Random(1), Library(SMALL)
    parsed = [parse(k.split("#")[0], v) for k, v in SMALL.items()]
    found = 0
    for _ in range(3000):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]) for _ in range(rng.randint(0, 14))]
        every = {(t.label, s, e, n) for n, t in enumerate(parsed) for s in range(len(words)) for e in accepted(t, words, s)}
        longest = {}
        for label, s, e, n in every:  # of one end the longest, then of one first word
            longest[n, e] = min(longest.get((n, e), s), s)
        spans = {}
        for (n, e), s in longest.items():
            spans[parsed[n].label, s] = max(spans.get((parsed[n].label, s), 0), e)
        mine, share = library.matches(words)
        assert mine == sorted((label, s, e) for (label, s), e in spans.items())
        assert bool(mine) == (share == 1.0)
        found += len(mine)
    assert found > 1000


def test_templates_without_end_or_words_are_refused():
    for bad in ("{{a", "a}}", "", "{{a}}", "<<x:3>>", "<<x:2>> a", "a <<x:2>>"):
        with pytest.raises(ValueError):
            Library({"bad": bad})


def test_every_license_text_is_accepted_with_and_without_its_regions():
    library = Library(TEMPLATES)
    for name, text in TEMPLATES.items():
        full = re.sub(r"<<[^>]*>>", "some Body", re.sub(r"\{\{|\}\}", " ", text))
        bare = text
        while "{{" in bare:
            bare = re.sub(r"\{\{[^{}]*\}\}", "", bare)
        bare = re.sub(r"<<[^>]*>>", "", bare)
        for shown in (full, bare):
            words = words_of(f"Intro: {shown.title()}; end".encode())
            label = name.split("#")[0]
            assert (label, 1, len(words) - 1) in [(a, s, e) for a, s, e in library.matches(words)[0]], name
            for i in range(3):  # a changed mandatory word
                broken = words_of(bare.encode())
                broken[(i * len(broken)) // 3] = b"otherwise"
                assert label not in {m[0] for m in library.matches(broken)[0]} or len(broken) > 20, name


def test_license_phrases_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["MIT", " license", " License,", "apache", "gnu general public", " ", "CC", "-by", " by ", "É", "x", "9", "\n", "cc by"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(400)]
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    expected = {}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = sorted((j, label) for p, label in phrases.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        expected[i] = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                       ",".join(sorted({x for _, x in places})))
    found = find_licenses(documents(spark, rows + ODD)).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in found if r.doc_id in expected and r not in found[len(rows):]} == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert len(found) == len(rows) + len(ODD) and find_licenses(documents(spark).limit(0)).count() == 0
    short = [r for r in found if r.n_words == 0]
    assert len(short) >= 3 and all(r.labels == "" and r.matches == [] and r.first_word is None for r in short)


def test_repeated_notices_take_time_in_step_with_their_words():
    from keytide.llm.licenses import default_library, scan

    row = scan(b"Released under the MIT License. permission is hereby granted free " * 20_000, default_library())
    assert row[1] == 20_000 and len(row[-1]) == 20_000 and row[5] == "mit"


# --- ranked search


def brute_search(rows, queries, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, terms(t)) for i, t, *_ in rows]
    docs = [d for d in docs if d[1]]
    number, length, out = len(docs), sum(len(w) for _, w in docs), []
    for item, text in queries:
        scores = []
        for i, words in docs:
            m, score = 75 + 25 * len(words) * number // length, 0
            for t in terms(text):
                df, tf = sum(t in w for _, w in docs), words.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, block, sent", [(1 << 14, 4 << 20, 1 << 20), (7, 150, 0)])
def test_ranked_search_matches_brute_force(spark, monkeypatch, width, block, sent):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked_search, "SENT_PAIRS", sent)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdéfg" for b in ("", "x", "Y", "9")]
    rows = [(i, ", ".join(rng.choices(words[: rng.randint(3, 28)], k=rng.randint(0, 30)))) for i in range(80)]
    rows += [rows[3], (200, rows[3][1]), (1, rows[3][1]), (None, rows[3][1]), (None, "ax"), (90, None), (91, " -- ")]
    rows += [(300 + i, "same text ax ax") for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(7)]
    items += [(7, "nowhere"), (8, None), (9, ""), (None, "ax same"), (0, "cx cx cx text"), (11, "q " * 50 + "ax")]
    benchmark = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    found = ranked_search.ranked_search(documents(spark, rows), benchmark, top=5, width=width).collect()
    assert sorted(map(tuple, found), key=repr) == brute_search(rows, items, 5)


def test_ranked_search_of_equal_scores_goes_by_id(spark):
    words = ["alpha", "beta", "gamma", "delta", "other"]
    texts = [" ".join(p) for p in itertools.permutations(words)]  # all different, all with one score
    rng = random.Random(3)
    ids = rng.sample(range(1000), len(texts) + 3)
    rows = [*zip(ids, [*texts, *texts[:3]]), (None, "beta gamma alpha delta")]
    benchmark = spark.createDataFrame([("q", "alpha beta"), ("r", "other")], "item_id string, text string")
    found = ranked_search.ranked_search(documents(spark, rows), benchmark, top=7).orderBy("item_id", "rank").collect()
    assert len({r["score"] for r in found if r["item_id"] == "r"}) == 1
    assert [r["doc_id"] for r in found if r["item_id"] == "r"] == sorted(ids)[:7]
    assert [r["doc_id"] for r in found if r["item_id"] == "q"] == [None, *sorted(ids)[:6]]


def test_ranked_search_of_odd_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "word a"), (2, None)], "item_id long, text string")
    found = ranked_search.ranked_search(documents(spark), benchmark).collect()
    assert sorted(map(tuple, found), key=repr) == brute_search(ODD, [(1, "word a")], 20)
    assert ranked_search.ranked_search(documents(spark).limit(0), benchmark).count() == 0
    empty = ranked_search.ranked_search(documents(spark), benchmark.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranked_search.ranked_search(documents(spark), benchmark, width=0)


def test_bounds_hold():
    rng = random.Random(4)
    words = [b"t%d" % i for i in range(60)]
    queries = ranked_search.Queries.of([(i, b" ".join(rng.choices(words, k=8))) for i in range(10)], width=16)
    weights = ranked_search.Weights.of(50, 5000, [rng.randint(1, 50) for _ in queries.vocabulary])
    slot_of = queries.slots()
    for _ in range(50):
        tf = {w: rng.randint(1, 9) for w in rng.sample(words, 12)}
        best = {}
        for w, n in tf.items():
            slot = int(slot_of[queries.coordinate(w)])
            if slot >= 0:
                best[slot] = max(best.get(slot, 0), n)
        size = sum(tf.values())
        slots, tfs = np.fromiter(best, np.uint16).tobytes(), np.fromiter(best.values(), np.uint32).tobytes()
        bounds = ranked_search._bounds([slots], [tfs], [size], ranked_search._lookups(queries, weights), weights)[:, 0]
        m = int(weights.m([size])[0])
        numbers = {n: w for w, n in queries.vocabulary.items()}
        for terms, bound in zip(queries.terms, bounds):
            score = sum(int(weights.weights[t]) * k * (10**9 * tf[numbers[t]] // (1000 * tf[numbers[t]] + 12 * m)) for t, k in terms.items() if numbers[t] in tf)
            assert score <= bound


# --- fill in the middle


@pytest.mark.parametrize(
    "kind, members",
    [
        (RunContainer, np.arange(BLOCK) % 5000 < 4900),
        (ArrayContainer, np.arange(BLOCK) % 37 == 3),
        (BitmapContainer, np.arange(BLOCK) % 2 == 0),
        (BitmapContainer, np.random.default_rng(0).random(BLOCK) < 0.4),
        (ArrayContainer, np.random.default_rng(1).random(999) < 0.3),
    ],
)
def test_containers_select_every_member(kind, members):
    container = boundaries.container_of(members)
    assert isinstance(container, kind)
    places = np.flatnonzero(members)
    assert [container.select(k) for k in range(len(places))] == places.tolist()


def test_boundaries_of_texts():
    rng = random.Random(5)
    for alphabet, size in (("ab", 10), ("aé€\U0001f642", 300), ("é", 70_000), ("a" * 30 + "é", 150_000), ("a", 200_000), ("aé", 90_000)):
        text = "".join(rng.choices(alphabet, k=size))
        places, data = BoundarySet(text.encode()), text.encode()
        assert len(places) == size + 1
        for k in [0, 1, size // 2, size - 1, size, *rng.choices(range(size + 1), k=40)]:
            assert data[: places.select(k)].decode() == text[:k]
    assert len(BoundarySet(b"")) == 1 and BoundarySet(b"").select(0) == 0
    with pytest.raises(IndexError):
        BoundarySet(b"abc").select(4)


def test_forms_match_brute_force_and_restore_the_text(spark):
    rng = random.Random(6)
    parts = ["a", "é", "\U0001f642", "<P>", "<", "P>", "<S", ">", "M", "<M>", " ", "long words here "]
    rows = [(i, "".join(rng.choices(parts if i % 9 == 0 else [p for p in parts if len(p) != 3], k=rng.randint(0, 40)))) for i in range(500)]
    rows += [(1000, "é" * 70_000 + "x"), (1001, LONG), (1002, "<" * 50), (1003, "<S<S<S<M<P<"), (1004, "")]
    made = fill_in_middle(documents(spark, rows + ODD))
    found = made.withColumn("back", restored(made["form"], made["output"])).collect()
    assert len(found) == len(rows) + len(ODD)
    forms = {}
    for r, (i, text, *_) in zip(found, rows + ODD):
        text, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        assert h == drawn(i, "1")
        n = len(text)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            expected = ("plain", None, None, text)
        elif h[3] % 100 < 20:
            expected = ("spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
        else:
            expected = ("psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (i, n, *expected, text)
        forms[r.form] = forms.get(r.form, 0) + 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 40
    assert fill_in_middle(documents(spark).limit(0)).count() == 0
