"""Every corpus operator against brute force, and on nulls, empty, long and repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from keytide.llm import decontaminate, jaccard, packing, quality_rules, secrets, token_counts, warc
from keytide.llm.decontaminate import contamination, drop_contaminated
from keytide.llm.html_text import extract_text, main_text
from keytide.llm.jaccard import jaccard_join
from keytide.llm.quality_model import quality_scores
from keytide.llm.toxicity import Field, toxicity

SCHEMA = "doc_id long, text string, n_words int, kept string"
LONG = "word " * 30_000
ODD = [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \n\t ", 1, "x"), (None, "a b", 1, "x"), (4, LONG, 1, "x"), (4, LONG, 1, "x")]
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi pi rho sigma tau".split()


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def near_copies(seed, n=60):
    rng, rows = random.Random(seed), []
    bases = [[rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 80))] for _ in range(6)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words), 0, ""))
    return rows


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_jaccard_components_match_brute_force(spark, seed, size, percent):
    rows = near_copies(seed) + [(100, None, 0, ""), (101, "  ", 0, ""), (5, "lone words here", 0, "")]
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    expected = sorted((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))
    found = jaccard_join(documents(spark, rows), size=size, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng, met = np.random.default_rng(0), 0
    rarity = rng.integers(0, 3, 1 << jaccard.SLOT_BITS).astype(np.uint8)
    values = rng.integers(0, 2**64, 400, dtype=np.uint64)
    table = jaccard.BitTable(8, rng.integers(0, 256, 32).astype(np.uint8))
    for _ in range(300):
        a = rng.choice(400, rng.integers(1, 200), replace=False)
        b = np.union1d(rng.choice(a, max(1, int(len(a) * 0.95)), replace=False), rng.choice(400, rng.integers(0, 9)))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= 85 * either:
            met += 1
            sets = [np.sort(values[x]) for x in (a, b)]
            assert jaccard.linked(*sets, 85)
            for other, known in ((None, None), (jaccard._SECOND, table), (jaccard._THIRD, None)):
                heads = [jaccard.prefix(x, rarity, 85, other, shared=known) for x in sets]
                assert len(np.intersect1d(*heads)) and [len(h) for h in heads] == [jaccard.prefix_length(len(x), 85) for x in sets]
                at = [min(map(list(x).index, np.intersect1d(*heads))) for x in heads]
                assert min(len(a) - at[0], len(b) - at[1]) >= both
            heads = [jaccard.prefix(x, rarity, 85, more=len(x) // 20) for x in sets]
            assert len(np.intersect1d(*heads)) >= max(jaccard.least_shared(len(x), 85) for x in sets)
    assert met > 50


def test_a_line_that_many_unlike_documents_share_makes_no_pairs(spark, monkeypatch):
    rng, asked = random.Random(31), []
    line = " ".join(f"common{i}" for i in range(30))
    word = lambda: f"w{rng.getrandbits(40)}"
    rows = [(i, f"{line} {' '.join(word() for _ in range(25))}", 0, "") for i in range(10_000)]
    rows += [(20_000 + i, rows[i][1] + " end", 0, "") for i in range(0, 10_000, 500)]
    verified = jaccard._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join(documents(spark, rows)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {20_000 + i: i for i in range(0, 10_000, 500)}
    assert sum(asked) < 2 * len(rows)


def test_components_of_a_join_without_any_shared_shingle(spark):
    rows = [(i, f"text{i} of{i} its{i} own{i} words{i} only{i}", 0, "") for i in range(20)]
    found = jaccard_join(documents(spark, rows)).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 2 for r in found) and len(found) == 20


def brute_contamination(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item_text or "").lower())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS[:5], k=rng.randint(1, 14)))) for i in range(8)]
    items += [(10, None), (11, ""), (12, "solo"), (3, "a b")]
    rows = [(i, ", ".join(rng.choices(WORDS[:5] + ["Solo"], k=rng.randint(0, 60))), 0, "") for i in range(25)]
    rows += [(30, items[2][1].upper(), 0, ""), (31, None, 0, ""), (1, "repeat alpha", 0, ""), (1, "repeat alpha", 0, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(documents(spark, rows), benchmark).collect()
    mine = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found)
    assert mine == sorted((r[0], *brute_contamination(r[1], items)) for r in rows)
    clean = sorted(r[0] for r in rows if not brute_contamination(r[1], items)[1])
    kept = drop_contaminated(documents(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == clean and kept.columns == documents(spark).columns


def test_large_benchmark_never_passes_the_driver(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 3)

    def collected(*_):
        raise AssertionError("windows were collected")

    monkeypatch.setattr(decontaminate, "_block", collected)
    rng = random.Random(15)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 30)))) for i in range(30)] + [(40, "alpha"), (41, "mu nu")]
    rows = [(i, " ".join(rng.choices(WORDS, k=20)) + " " + items[i % 7][1] + " end", 0, "") for i in range(60)]
    found = contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    mine = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found)
    assert mine == sorted((r[0], *brute_contamination(r[1], items)) for r in rows)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_rule_statistics_match_brute_force():
    rng, hashes = random.Random(2), quality_rules.WordHashes()
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "É", "\n", " ", "#", "　", "x y z a b c d e ", "|", "\x0b"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.statistics(text.encode(), hashes)[0] == brute_statistics(text)


def test_forest_singles_out_odd_rows():
    rng = np.random.default_rng(1)
    plain, odd = rng.normal(0, 0.02, (900, 5)).round(1), np.full((60, 5), 0.9)
    rows, clean = np.concatenate([plain, odd]), np.arange(960) < 900
    forest = quality_rules.calibrate(quality_rules.grow(rows), rows, clean, 0.005)
    assert forest.rejects(odd).all() and forest.rejects(plain).mean() <= 0.005
    assert not quality_rules.grow(rows[:0]).rejects(rows).any()


def test_rules_reject_repeated_lines_and_words(spark):
    rng, rows, known = random.Random(21), [], []
    words = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]
    for i in range(600):
        lines = [" ".join(words(9)) for _ in range(16)]
        if i % 20 == 0:
            lines = [x for line in lines[:12] for x in (line, "read more here")]
        if i % 20 == 1:
            lines[8:10] = lines[3:5]
            lines[8] += " and"
        rows.append((i, "\n".join(lines), 0, ""))
        known.append((i, int(i % 20 > 1), 0))
    found = quality_rules.quality_rules(documents(spark, rows), labels(spark, known)).collect()
    assert not any(r.base_failed for r in found)
    assert {r.doc_id for r in found if not r.kept} == {i for i in range(600) if i % 20 < 2}


def test_threshold_counts_every_labelled_row():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 4, (3000, 7)) / 10
    clean, forest = rng.random(3000) < 0.9, quality_rules.grow(rows)
    limit = quality_rules.calibrate(forest, rows, clean, 0.02).limit
    groups, counts = np.unique(np.column_stack([rows, clean]), axis=0, return_counts=True)
    assert quality_rules.calibrate(forest, groups[:, :7], groups[:, 7] > 0, 0.02, counts).limit == limit
    assert not hasattr(quality_rules, "CALIBRATION_ROWS")


def brute_spans(text):
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_match_brute_force():
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "=", ": ", '"', "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", " ", "x", "apikey"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert secrets.base_spans(text.encode()) == brute_spans(text)


def random_words(rng, n):
    return ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(n)]


def test_network_finds_secrets_that_no_pattern_names():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, further = [], []
    for i in range(400):
        text = f"some words token = {hexes(40)} and more"
        start = text.index("=") + 2
        rows += [(secrets.windows(text, start, start + 40)[0], 0)]
        rows += [(w, 0) for w in secrets.bare_windows(text, (text.index("token"), 0, start + 40))]
        text = f"write to mail{i}.example.com or 10.0.{i % 200}.17 today"
        rows += [(secrets.windows(text, m.start(), m.end())[0], -1) for m in re.finditer(r"\S+", text)]
        text = " ".join(random_words(rng, 8))
        rows += [(secrets.windows(text, m.start(), m.end())[0], -1) for m in re.finditer(r"\S+", text)]
        text = " ".join(random_words(rng, 20))
        further += [secrets.windows(text, m.start(), m.end())[0] for m in re.finditer(r"\S+", text)]
    network = secrets.train(rows, further)
    hidden = f"signing value {hexes(32).upper()} here"
    (base, every), (_, none) = secrets.all_spans([hidden.encode(), b"see mail777.example.com now"], network)
    assert base == [] and every == [(14, 3, 46)] and none == []
    assert np.isfinite(network.thresholds[0]) and np.isinf(network.thresholds[1:]).all()
    # Too few held-out findings, and counter-examples that cannot be told from findings: nothing is added.
    assert np.isinf(secrets.train(rows[:60] + [r for r in rows if r[1] < 0], further).thresholds).all()
    confused = secrets.train(rows, [w for w, k in rows if k == 0] + further)
    assert np.isinf(confused.thresholds).all()
    assert secrets.redacted(b"a token=abcdefabcdefabcd1 b", secrets.base_spans(b"a token=abcdefabcdefabcd1 b"), "[S]") == "a [S] b"


def test_secrets_without_a_name_are_found(spark):
    rng = random.Random(12)
    make = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    word = lambda: make("etaoinshrdlu", rng.randint(1, 9))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    rows, hidden = [], {}
    for i in range(600):
        plain = [word() for _ in range(30)] + [f"mail{i}.example.com", f"10.0.{i % 200}.17", f"555-{1000 + i}"]
        rng.shuffle(plain)
        rows.append((i, f"{' '.join(plain)} token = {make('0123456789abcdef', 40)} {word()}", 0, ""))
    for i, bare in enumerate([make("0123456789ABCDEF", 32), make(letters, 40), make(letters + "0123456789+/", 40)]):
        text = f"{word()} signing value {bare} {word()} {word()}"
        hidden[1000 + i] = f"model:{text.index(bare)}:{text.index(bare) + len(bare)}"
        rows += [(1000 + i, text, 0, "")] * 3  # in the sample of counter-examples, were it taken for one
    found = secrets.find_secrets(documents(spark, rows)).collect()
    assert {r.doc_id: r.spans for r in found if r.doc_id >= 1000} == hidden
    assert sum(r.n_model for r in found if r.doc_id < 1000) <= 20 and sum(r.n_assign for r in found) == 600


@pytest.mark.parametrize("findings", [10, 150])
def test_clean_texts_get_no_spans_of_the_network(spark, findings):
    rng, rows = random.Random(findings), []
    for i in range(1500):
        words = [w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.05 else w for w in random_words(rng, 40)]
        words += [f"mail{i}.example.com", f"10.0.{i % 200}.17", "La.", f"{i}-{i + 4}", f"2024-01-{i % 28 + 1}"]
        rng.shuffle(words)
        if i < findings:
            kind = i % 3
            value = "".join(rng.choices("0123456789abcdef", k=32))
            words.insert(9, [f"token={value}x", f"AKIA{value.upper().replace('A', 'Q')[:16]}", value][kind])
        rows.append((i, " ".join(words), 0, ""))
    found = secrets.find_secrets(documents(spark, rows)).collect()
    assert sum(r.n_assign + r.n_access + r.n_hex > 0 for r in found) == findings
    assert sum(r.n_model for r in found if r.doc_id >= findings) <= 1
    texts = {r[0]: r[1] for r in rows}
    changed = [r.doc_id for r in secrets.redact_secrets(documents(spark, rows)).collect() if r.text != texts[r.doc_id]]
    assert set(range(findings)) <= set(changed) and len(changed) <= findings + 1


def test_long_runs_and_blocks_score_like_windows():
    rng = random.Random(13)
    rows = [(w, k) for k, a in ((0, "0123456789abcdef"), (-1, "etaoin")) for _ in range(200) for w in secrets.windows("".join(rng.choices(a, k=20)), 0, 20)]
    network = secrets.train(rows)
    texts = [" ".join("".join(rng.choices("abc19.é", k=rng.randint(1, 30))) for _ in range(300)) for _ in range(30)]
    runs = secrets.Runs.of(texts, [[]] * 30)
    some = [(int(o), int(s - runs.offsets[o]), int(e - runs.offsets[o])) for s, e, o in zip(runs.starts, runs.ends, runs.owner)]
    logits = network.logits([w for o, s, e in some for w in secrets.windows(texts[o], s, e)])
    peaks = network._peaks(runs.codes, runs.starts, runs.ends)
    assert len(runs.codes) > 2 * secrets._BLOCK
    assert np.allclose(peaks @ network.weights["out"] + network.weights["out_bias"], logits, atol=1e-4)
    network._peaks(*(lambda r: (r.codes, r.starts, r.ends))(secrets.Runs.of(["a" * 3 * secrets._BLOCK, "b"], [[], []])))


def test_runs_that_look_secret_score_alone_as_in_their_text():
    rng = random.Random(14)
    texts = ["".join(rng.choices("aB1 ./=é", [6, 6, 6, 1, 1, 1, 1, 1], k=rng.randint(0, 200))) for _ in range(200)]
    runs = secrets.Runs.of(texts, [[]] * 200)
    cores = [texts[o][s - runs.offsets[o] : e - runs.offsets[o]] for s, e, o in zip(runs.starts, runs.ends, runs.owner)]
    assert runs.secret().tolist() == [secrets.looks_secret(c) for c in cores] and 9 < runs.secret().sum() < len(cores)
    hashes = runs.hashes().tolist()
    assert len(set(hashes)) == len(set(cores)) == len(set(zip(cores, hashes)))
    every = np.arange(len(cores))
    shown = [secrets.windows(texts[o], int(s - runs.offsets[o]), int(e - runs.offsets[o]))[0] for s, e, o in zip(runs.starts, runs.ends, runs.owner)]
    assert (runs.windows(every) == secrets.coded(shown)).all()
    network = secrets.CharNetwork(secrets.Training.start().weights)
    some, alone = every[::3], runs.alone(every[::3])
    peaks = network._peaks(runs.codes, runs.starts, runs.ends)[some]
    assert (network._peaks(alone.codes, alone.starts, alone.ends) == peaks).all()


def test_network_learns_every_run(spark, monkeypatch):
    rng, rows = random.Random(15), []
    for i in range(900):  # far more distinct runs than any sample would take
        rows.append((i, " ".join(f"{w}{i}x{k}" for k, w in enumerate(random_words(rng, 50))) + f" token={rng.randrange(16**20, 16**21):x}", 0, ""))
    kinds = {}
    for text in (r[1] for r in rows):
        runs = secrets.Runs.of([text], [secrets.base_spans(text.encode())])
        kinds |= {text[s - runs.offsets[0] : e - runs.offsets[0]]: k for s, e, k in zip(runs.starts, runs.ends, runs.kinds)}
    others = {c for c, k in kinds.items() if k < 0 and not secrets.looks_secret(c)}
    docs = documents(spark, rows)
    found = [sorted(map(tuple, secrets.distinct_runs(docs.repartition(n), "text").collect())) for n in (1, 7)]
    assert found[0] == found[1]
    cores = [(k, bytes(w).decode("latin-1")[secrets.LEFT : secrets.LEFT + secrets.CORE].rstrip("\0")) for _, k, _, w in found[0]]
    assert sorted(c for k, c in cores if k < 0) == sorted(others) and len(others) > 40_000
    # Every row that is not held out is learnt from, over shards and turns; every other one is counted.
    codes, kinds = secrets.coded([chr(i // 100 + 1) * 10 + chr(i % 100 + 1) * 62 for i in range(9000)]), np.repeat([0, -1], [90, 8910])
    monkeypatch.setattr(secrets, "_TURN_ROWS", 500)
    seen = set()
    monkeypatch.setattr(secrets.Training, "_learn", lambda self, c, k, r: seen.update(map(bytes, c)))
    for turn in range(secrets.TURNS):
        secrets.Training.start().turn(codes, kinds, turn)
    assert seen == set(map(bytes, codes))
    held = spark.createDataFrame([(int(k), bytes(c)) for k, c in zip(kinds, codes)], "kind int, window binary")
    network = secrets.CharNetwork(secrets.Training.start().weights)
    counts = secrets._held_counts(held.repartition(3), network)
    assert (counts == network.counts(codes, kinds)).all() and counts[0].sum(1).tolist() == [90, 8910]


def test_counts_and_ids_match_the_libraries(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    sp_path, hf_path = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    sp, hf = SentencePieceProcessor(model_file=sp_path), Tokenizer.from_file(hf_path)
    rng = random.Random(1)
    parts = ["a", "Don't ", "É", " ", "  ", "\n", "<|endoftext|>", "9", "́", "▁", "\U0001f642", "\x85", "the ", "!.", "</s>", "\x00", "ΣΣ", "ß."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    data = [t.encode() for t in texts]
    assert token_counts.PieceCounter(sp_path).count(data) == [len(x) for x in sp.encode(texts)]
    mine = packing.ChunkTokens(hf_path).encode(data)
    assert [x.tolist() for x in mine] == [hf.encode(t, add_special_tokens=False).ids for t in texts]
    huge = "".join(rng.choices(["word ", "x" * 300, "é", "\n", "longer words "], k=9000))
    rows = [(1, huge, 0, ""), (2, "y" * 70_000, 0, ""), *ODD]
    found = token_counts.token_counts(documents(spark, rows), sp_path).collect()
    expected = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=repr) == sorted(expected, key=repr)


def test_packing_is_gapless_and_near_the_bound(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    rows = ODD + [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 50, 400, 900]))), 0, "") for i in range(10, 90)]
    found = packing.pack(documents(spark, rows), path).collect()
    chunks = packing.ChunkTokens(path)
    pieces = []
    for doc, text, *_ in rows:
        ids = np.append(chunks.encode([(text or "").encode()])[0], 0).astype("<u4")
        pieces += [(doc, i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(pieces, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) <= 1.05 * -(-sum(p[3] for p in pieces) // 2048) + 1


def test_plans_hold_every_piece_and_reduction_keeps_the_optimum():
    rng = np.random.default_rng(6)
    for _ in range(150):
        sizes = rng.integers(1, 13, rng.integers(1, 9)).tolist()
        counts = np.bincount(sizes, minlength=13)
        plan = packing.plan(counts, 12)
        assert sorted(x for e in plan for x in e.lengths * e.count) == sorted(sizes)
        assert all(sum(e.lengths) <= 12 for e in plan)
        left = counts.copy()
        left[12] = 0
        fixed = packing.reduce_by_dominance(left, 12)
        rest = [s for s in range(1, 13) for _ in range(left[s])]
        assert sum(e.count for e in fixed) + _fewest(rest, 12) == _fewest([s for s in sizes if s < 12], 12)


def test_plans_are_as_short_for_any_counts():
    rng = np.random.default_rng(7)
    for capacity in (12, 64, 2048):
        for most in (3, 10**9):
            for low in (1, capacity // 3):
                counts = np.zeros(capacity + 1, np.int64)
                some = rng.choice(np.arange(low, capacity + 1), max(1, capacity // 3), replace=False)
                counts[some] = rng.integers(1, most, len(some), endpoint=True)
                plan = packing.plan(counts, capacity)
                assert len(plan) <= 4 * capacity
                held = np.zeros(capacity + 1, np.int64)
                for e in plan:
                    assert sum(e.lengths) <= capacity and e.count > 0
                    for x in e.lengths:
                        held[x] += e.count
                assert (held == counts).all()
                assert len(packing.Places(plan).keys) <= 8 * capacity


def _fewest(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= order[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, rest + [room - order[i]])
        go(i + 1, bins + [capacity - order[i]])

    order = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    model = Field(step=rng.normal(size=(2, 2)))
    chains = [rng.normal(size=n) for n in (0, 1, 4, 6, 2)]
    for chain, mine in zip(chains, model.marginals(chains)):
        weights = np.zeros((len(chain), 2))
        for code in range(2 ** len(chain)):
            states = [code >> i & 1 for i in range(len(chain))]
            total = np.exp(sum(chain[i] * s for i, s in enumerate(states)) + sum(model.step[a, b] for a, b in zip(states, states[1:])))
            for i, s in enumerate(states):
                weights[i, s] += total
        assert np.allclose(mine, weights[:, 1] / weights.sum(1) if len(chain) else [])


def test_models_on_held_out_rows(spark):
    rng, rows, known = random.Random(9), [], []
    for i in range(600):
        toxic, good = i % 4 == 0, i % 3 != 0
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vilething", "vilest"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" if not w.startswith("vile") else w for w in words)
        rows.append((i, text, 0, ""))
        known.append((i, int(good), int(toxic)))
    docs, known_rows = documents(spark, rows + ODD), labels(spark, known)
    truth = {i: (g, t) for i, g, t in known}
    for found, which in ((quality_scores(docs, known_rows), 0), (toxicity(docs, known_rows), 1)):
        got = found.collect()
        assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 80
        assert sum(r.predicted == truth[r.doc_id][which] for r in held) >= 0.95 * len(held)
    unlabelled = toxicity(docs, labels(spark)).collect()
    assert len({r.score for r in unlabelled}) == 1


def test_html_main_text():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div id="cookie-notice">We use cookies</div><nav><a href=x>menu</a></nav><div class="wrap"><main><article>
    <h1>Title &amp; more</h1><p>One   two<br>three<p>Next <b>bold</b><ul><li>a<li>b</ul><script>var x = "</p>";</script>
    <table><tr><td>x<td>y</table></article></main><section id="comments"><p>a reader says much more than the text</p>
    </section><div class=sidebar><a href=x>links</a></div></div><footer>f</footer></body></html>"""
    assert main_text(page) == "Title & more\n\nOne two three\n\nNext bold\n\na\n\nb\n\nx y"
    assert main_text("") == "" and main_text("plain <i>words</i>") == "plain words"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_html_words_of_a_class_are_only_evidence():
    prose = "Plain words that make up the article and go on for a while, as articles do. " * 4
    part = f"<p>{prose}</p>"
    text = prose.strip()
    for name in ("content has-sidebar", "no-sidebar", "share-price", "content sidebar", "main search"):
        assert main_text(f'<body><nav><a href=x>m</a></nav><div class="{name}">{part * 4}</div></body>') == "\n\n".join([text] * 4), name
    inner = f'<h2 id="related">A</h2><p class="notice">{prose}</p><section id="search">{part}</section><div class="share-price">9.50</div>'
    links = '<div class="share"><a href=x>one</a> <a href=y>two</a></div>'
    expected = "\n\n".join([text, "A", text, text, "9.50", text])
    assert main_text(f"<body><article>{part}{inner}{links}{part}</article></body>") == expected
    plain = f'<section id="search">{part}</section><div class="ad">Buy it.</div>'
    assert main_text(f"<body><div>{part * 3}{plain}</div></body>") == "\n\n".join([text] * 4)


def test_html_article_in_several_elements():
    prose = "Plain words that make up the article and go on for a while, as articles do. " * 4
    text, part = prose.strip(), f"<p>{prose}</p>"
    menu, foot = "<nav><a href=x>m</a></nav><div class='ad'>Buy it.</div>", "<div><a href=x>More</a></div><footer>f</footer>"
    page = f"<body>{menu}<h1>Title</h1><section>{part * 20}</section> <h2>B</h2><p>Short.</p><ul><li>x<li>y</ul><section>{part * 15}</section>{foot}</body>"
    assert main_text(page) == "\n\n".join(["Title", *[text] * 20, "B", "Short.", "x", "y", *[text] * 15])
    named = f"<body>{menu}<h1>Site</h1><article><h1>Title</h1>{part * 3}</article><div>{prose}</div>{foot}</body>"
    assert main_text(named) == "\n\n".join(["Title", *[text] * 3])


def test_html_links_of_an_article_stay():
    prose = "Plain words that make up the article and go on for a while, as articles do. " * 4
    text, part = prose.strip(), f"<p>{prose}</p>"
    sources = "<h2>References</h2><ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul>"
    link = "<p><a href=z>A paragraph that is one link</a></p>"
    listed = ["References", "First source", "Second source"]
    expected = [text, "A paragraph that is one link", text, *listed]
    for tag in ("article", "main"):
        page = f"<body><nav><a href=x>m</a></nav><{tag}>{part}{link}{part}{sources}</{tag}><footer>f</footer></body>"
        assert main_text(page) == "\n\n".join(expected)
    between = f"<body><div>{part * 2}<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>{part * 2}<div><a href=x>More</a></div></div></body>"
    assert main_text(between) == "\n\n".join([text, text, "One", "Two", text, text])


def test_html_compound_names_are_evidence():
    prose = "Plain words that make up the article and go on for a while, as articles do. " * 4
    text, part = prose.strip(), f"<p>{prose}</p>"
    for name in ("comments-area", "comment-list", "commentList", "ad-slot", "sidebar-left", "cookie-bar", "newsletterBox"):
        other = f'<div class="{name}"><p>Somebody else says this, at some length and without a link. {prose}</p></div>'
        assert main_text(f"<body><article>{part * 3}{other}</article></body>") == "\n\n".join([text] * 3), name
        assert main_text(f'<body><div class="wrap">{part * 3}</div>{other}</body>') == "\n\n".join([text] * 3), name
    for name in ("share-price", "has-sidebar", "search-theory", "related-work", "notice", "commentary"):
        own = f'<div class="{name}">{part}</div>'
        assert main_text(f"<body><article>{part * 3}{own}</article></body>") == "\n\n".join([text] * 4), name


def brute_density(node, link=False):
    """``characters, tags, link characters, link tags`` of a nested ``(tag, children)``, by recursion."""
    tag, children = node
    totals = [0, 0, 0, 0]
    for c in children:
        if isinstance(c, str):
            n = sum(not ch.isspace() for ch in c)
            totals = [totals[0] + n, totals[1], totals[2] + n * (link or tag == "a"), totals[3]]
        else:
            below = brute_density(c, link or tag == "a")
            totals = [t + b for t, b in zip(totals, below)]
            totals[1] += 1
            totals[3] += c[0] == "a"
    return totals


def test_densities_match_a_plain_recursion():
    from math import e, log

    from keytide.llm import html_text

    rng = random.Random(17)

    def grown(depth):
        tag = rng.choice(["div", "section", "span", "b", "a", "article"])
        children = []
        for _ in range(rng.randint(0, 4)):
            children.append(grown(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["word ", " x\n", "", "longer text here "]))
        return tag, children

    def shown(node):
        return f"<{node[0]}>{''.join(c if isinstance(c, str) else shown(c) for c in node[1])}</{node[0]}>"

    def nested_links(node, inside=False):
        return any(not isinstance(c, str) and (c[0] == "a" and (inside or node[0] == "a") or nested_links(c, inside or node[0] == "a")) for c in node[1])

    compared = 0
    for _ in range(300):
        body = ("body", [grown(4) for _ in range(3)])
        if nested_links(body):
            continue
        tree = html_text.Tree()
        tree.feed(shown(body))
        tree.close()
        order = html_text.measure(tree.body)
        html_text.score(order, tree.body)
        all_c, _, all_lc, _ = brute_density(body)

        def density(node):
            c, t, lc, lt = brute_density(node, node[0] == "a")
            if not c:
                return 0.0
            spread = log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
            base = log(max(e, log(c / max(1, c - lc) * lc + all_lc / max(1, all_c) * c + e)))
            return c / max(1, t) * spread / max(1.0, base)

        def walk(node, made):
            nonlocal compared
            compared += 1
            assert abs(density(node) - made.density) < 1e-9
            inner = [c for c in node[1] if not isinstance(c, str)]
            assert abs(sum(map(density, inner)) - made.total) < 1e-9
            for c, m in zip(inner, [m for m in made.children if not isinstance(m, str)], strict=True):
                walk(c, m)

        walk(body, tree.body)
    assert compared > 1000


def test_html_rows(spark):
    rows = [(1, "u", "<p>a<p>b", 1), (1, "u", "<p>a<p>b", 1), (None, None, None, 2), (2, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(map(tuple, extract_text(pages).collect()), key=repr)
    assert found == sorted([(1, "u", "a\n\nb", 4)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", ["128m", "3000"])
def test_warc_round_trip(spark, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    kinds = ["", "short", "x" * 2000, None, inner, inner * 30, "b" * 1500 + "WARC/1.0", "é" * 3000 + inner + warc.MAGIC * 3]
    rows = [(i, f"http://h/{i} x\r\n" if i % 5 else None, kinds[i % len(kinds)], 1) for i in range(24)]
    rows += [(None, None, "x" * 2000, 1), (7, "u", None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    latest, expected = {}, []
    for i, _, h, _ in rows:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and latest[h] != (-1 if i is None else i)
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", latest[h] if again else None))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        found = [tuple(r) for r in warc.round_trip(pages).collect()]
        assert warc.round_trip(pages.limit(0)).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_odd_rows_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    operators = {
        "jaccard": jaccard_join,
        "contamination": lambda d: contamination(d, benchmark),
        "rules": lambda d: quality_rules.quality_rules(d, labels(spark)),
        "quality": lambda d: quality_scores(d, labels(spark)),
        "toxicity": lambda d: toxicity(d, labels(spark)),
        "secrets": secrets.find_secrets,
        "redaction": secrets.redact_secrets,
        "tokens": lambda d: token_counts.token_counts(d, path),
    }
    packed = packing.pack(documents(spark), public_tokenizers.path("word_bpe_49k.json"))
    assert packed.filter("piece = 0").count() == len(ODD)
    assert packing.pack(documents(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    for name, operator in operators.items():
        assert operator(documents(spark)).count() == len(ODD), name
        assert operator(documents(spark).limit(0)).count() == 0, name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [(i, " ".join(random.Random(i).choices(WORDS, k=60)) + f" number{i}", 0, "") for i in range(40)]
    rows = good + [(90, good[3][1], 0, ""), good[5], (91, "too short", 0, ""), *ODD]
    rows += [(92, good[7][1] + " token=abcdefabcdef123456", 0, ""), (93, "one two three four five six seven eight nine ten " * 1 + good[9][1][::-1], 0, "")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "one two three four five six seven eight nine ten")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = corpus_pipeline.read(spark, str(tmp_path), "documents"), {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == documents(spark).columns
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept["quality_rules"] == sorted([*range(40), 5, 90, 92, 93])
    assert set(kept["near_duplicates"]) in ({*range(40), 93}, {*range(40), 92, 93}) and len(kept["near_duplicates"]) <= 42
    assert 93 not in kept["decontamination"] and set(range(40)) <= set(kept["decontamination"])
    assert kept["secrets"] == kept["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in packed.collect()}) == sorted(set(kept["secrets"]))


def test_near_copies_are_found_without_a_copy_of_the_table(spark, tmp_path):
    import corpus_pipeline

    good = [(i % 7 or None, " ".join(random.Random(i % 40).choices(WORDS, k=60)), 0, "") for i in range(80)]
    documents(spark, good).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.read(spark, str(tmp_path), "documents")
    rows = corpus_pipeline.numbered(docs, "n")
    assert not hasattr(rows, "staged_at") and rows.columns == [*docs.columns, "n"]
    assert len({r.n for r in rows.collect()}) == 80 and sorted(rows.collect(), key=repr) == sorted(rows.repartition(3).collect(), key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 40
    for other in (docs.union(docs), documents(spark, good)):  # not a table as it was written
        rows = corpus_pipeline.numbered(other, "n")
        assert hasattr(rows, "staged_at") and rows.select("n").distinct().count() == other.count()


def test_near_copies_are_left_out_without_moving_the_texts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(random.Random(i % 90).choices(WORDS, k=60)), 0, "") for i in range(150)]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to be sent as they are
    try:
        found = corpus_pipeline.near_duplicates(spark, corpus_pipeline.read(spark, str(tmp_path), "documents"), "")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in found.collect()) == list(range(90))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange hashpartitioning" not in plan


def test_stages_and_the_jaccard_join_get_their_texts_in_short_batches(spark, tmp_path):
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(40, numPartitions=1).selectExpr("id doc_id", "repeat('lorem ipsum ', 25000) text")
    documents(spark, [(1, "some words", 0, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.read(spark, str(tmp_path), "documents")
    before = spark.conf.get(name)
    try:
        for use in (lambda: jaccard_join(docs), lambda: corpus_pipeline.packing(spark, docs, str(tmp_path))):
            spark.conf.set(name, "64m")
            use()
            found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
            assert len(found) > 2 and max(found) < (4 << 20) + 400_000
        spark.conf.set(name, "1m")  # smaller than the operators ask for
        corpus_pipeline.prepare(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_numbering_starts_no_python_workers(spark, tmp_path):
    import corpus_pipeline

    documents(spark, [(i, "some words", 0, "") for i in range(9)]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.numbered(corpus_pipeline.read(spark, str(tmp_path), "documents"), "n")
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 9


def test_rows_are_marked_whatever_their_numbers(spark, monkeypatch):
    import corpus_pipeline

    numbers = [0, 1, 62, 63, 64, 127, 128, (1 << 40) - 1, 1 << 40, (5 << 40) + 63, (1 << 33) + 31, -1, -64]
    rows = spark.createDataFrame([(n, str(n), 7) for n in numbers], "n long, word string, BITS long")
    for some in (numbers, numbers[::2], numbers[1::2], []):
        asked = spark.createDataFrame([(n,) for n in some], "number long")
        for sent in (corpus_pipeline.SENT_ROWS, 0):
            monkeypatch.setattr(corpus_pipeline, "SENT_ROWS", sent)
            found = corpus_pipeline.marked(rows, "n", asked)
            assert found.columns == rows.columns and sorted(r.n for r in found.collect()) == sorted(some)


def test_near_copies_without_an_id_of_their_own_go(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(random.Random(i).choices(WORDS, k=60)) + f" number{i}" for i in range(5)]
    rows = [(None, texts[0], 0, "a"), (None, texts[0] + " more", 0, "a"), (None, texts[1], 0, "b")]
    rows += [(7, texts[2], 0, "c"), (7, texts[2] + " more", 0, "c"), (7, texts[3] + " more", 0, "d"), (3, texts[3], 0, "d")]
    rows += [(8, texts[4], 0, "e"), (None, texts[4], 0, "e"), (9, "", 0, "f"), (None, None, 0, "g")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.read(spark, str(tmp_path), "documents")
    found = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    expected = [(None, "a"), (None, "b"), (7, "c"), (3, "d"), (8, "e"), (9, "f"), (None, "g")]
    assert sorted(((r.doc_id, r.kept) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_pipeline_of_empty_tables_and_of_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    names = ["__row", "row_number", "text_key", "Text_Key_", "cls", "rep", "group", "n_chars"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)
    good = [(i, " ".join(random.Random(i).choices(WORDS, k=60)) + f" number{i}", *range(100 + i, 108 + i)) for i in range(12)]
    rows = good + [(20, good[3][1], *range(8)), (21, None, *range(8))]
    rows += [(22, good[4][1] + " one two three four five six seven eight nine ten eleven", *range(8))]
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    for name, data in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        labels(spark).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items[: len(data)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = corpus_pipeline.read(spark, folder, "documents")
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(step(spark, docs, folder), "stage")
            assert docs.columns == ["doc_id", "text", *names]
        # No text holds a secret: what is kept comes out as it went in.
        assert sorted(map(tuple, docs.collect())) == (good if data else [])
        packed = corpus_pipeline.run(spark, folder)
        assert sorted({r.doc_id for r in packed.collect()}) == ([r[0] for r in good] if data else [])


def test_large_benchmark_drops_rows_of_tables_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=30)), i, i) for i in range(20)]
    rows += [(30, "and " + rows[0][1] + " too", 5, 6), (31, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key long, TEXT_KEY_ long")
    benchmark = spark.createDataFrame([(1, rows[0][1]), (2, rows[5][1])], "item_id long, text string")
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted((r for r in rows if r[0] not in (0, 5, 30)), key=lambda r: r[0])


def test_quality_model_matches_a_dense_fit(monkeypatch):
    """The same updates on whole vectors, coordinate by coordinate as the method's paper states them."""
    from keytide.llm import quality_model as q

    monkeypatch.setattr(q, "BITS", 6)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        label = int(i % 3 > 0)
        places = np.unique(rng.integers(0, 40, rng.integers(0, 12)) + 20 * label).astype(np.int32)
        rows.append((places, label, 1.0 if label else 1.5))
    model = q.fit(rows, epochs=4, seed=9)
    z, n, order = [0.0] * 65, [0.0] * 65, np.random.default_rng(9)

    def weight(i):
        l1 = 0 if i == 0 else q.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(4):
        for r in order.permutation(60):
            places, label, times = rows[r]
            x = [0.0] * 65
            x[0] = 1.0
            for at in places.tolist():
                x[at + 1] = 1 / math.sqrt(len(places))
            w = [weight(i) for i in range(65)]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i in range(65):
                g = (p - label) * times * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(model.weights, [weight(i) for i in range(1, 65)], atol=1e-6) and abs(model.bias - weight(0)) < 1e-9
    for places, *_ in rows[:10]:
        total = model.bias + sum(model.weights[a] for a in places.tolist()) / math.sqrt(max(1, len(places)))
        assert abs(model.score(places) - 1 / (1 + math.exp(-total))) < 1e-6
    features = q.WordFeatures()
    text = "Some words, some WORDS 42 42 here"
    ids, shapes = ([q.xxhash.xxh64_intdigest(f(w), k) for w in text.encode().split()] for f, k in ((bytes, 0), (q.shape, 1)))
    shapes = [s ^ (i > 0 and ids[i] == ids[i - 1]) for i, s in enumerate(shapes)]

    def grams(values, size):
        return [q.ngram_hashes(np.array(values[i : i + size], np.uint64), size)[0] for i in range(len(values) - size + 1)]

    turned = [s ^ (2**64 - 1) for s in shapes]
    plain = [q.scramble(np.array([v], np.uint64))[0] for v in ids + turned]
    expected = plain + grams(ids, 2) + grams(turned, 2) + grams(turned, 3)
    assert features.of(text.encode()).tolist() == sorted({int(h) >> 58 for h in expected})
