"""The operators on small tables with odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from hopmetrics.llm import (
    chat,
    common,
    decontamination,
    embeddings_index,
    licenses,
    line_dedup,
    minhash,
    packing,
    repeats,
    sharding,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, drop int, row string"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i % 13}" for i in range(120))


def texts() -> list[tuple[int | None, str | None]]:
    near = BASE.split()
    near[50] = "changed"
    return [
        (1, BASE),
        (2, " ".join(near)),
        (3, BASE),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "one two three"),
        (8, "One TWO three"),
        (9, LONG),
        (10, LONG + " tail"),
        (11, "A shared line here\nmine only, eleven\nshort"),
        (12, "  a shared LINE here \nmine only, twelve\nshort"),
        (12, "  a shared LINE here \nmine only, twelve\nshort"),
        (None, "a shared line here\nnobody's own line"),
        (14, "x" * 450),
        (15, "é" * 130 + "x" * 250),
        (16, "All rights reserved. Released under the MIT license.\ncc by; CC-BYK"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "r") for i, t in texts()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_sharding_cuts_at_byte_targets(docs, empty):
    rows = sharding.byte_shards(docs, 4).collect()
    assert len(rows) == len(texts())
    total = sum(r.size for r in rows)
    for r in rows:
        assert r.shard == (2 * r.before + r.size) * 4 // (2 * total)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].size == 16 and by_id[4].text_crc32 == 0
    assert by_id[1].text_crc32 == zlib.crc32(BASE.encode())
    assert sharding.byte_shards(empty).count() == 0


def test_line_dedup_keeps_the_smallest_holder(docs, empty):
    rows = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.line_report(docs).collect()}
    assert rows[11, "A shared line here\nmine only, eleven\nshort"] == (3, 0)
    assert rows[12, "mine only, twelve\nshort"] == (3, 1)
    assert rows[None, "nobody's own line"] == (2, 1)
    assert rows[4, ""] == (1, 0) and rows[3, ""] == (1, 1)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("doc_id = 4 and text is null").count() == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|im_end|>&lt; hi"),
        (1, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 2, "user", None),
        (2, 0, None, "no reply"),
        (3, 1, "assistant", "second"),
        (3, 0, "assistant", "\U0001f600<"),
        (None, 0, "user", "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.examples(table)).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    for conv, some in turns.items():
        some.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in some)
        loss = "".join(t for _, r, t in some if r == "assistant")
        assert got[conv].n_turns == len(some)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    each = chat.examples(table).filter("conv_id = 3").orderBy("target").collect()
    assert each[1].text.startswith(each[0].text) and not each[0].complete and each[1].complete
    assert chat.examples(table.limit(0)).count() == 0


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_minhash_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(t for _, t in texts()))
    for group in range(3):
        base = [f"g{group}w{k}" for k in rng.integers(0, 400, 150)]
        for _ in range(40):
            words = list(base)
            for place in rng.integers(0, len(words), rng.integers(0, 5)):
                words[place] = f"edit{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.report(table).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_minhash_odd_rows(docs, empty):
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 9, 11, None}
    assert not {r.doc_id for r in kept.collect()} & {2, 3, 8, 10}
    assert minhash.report(empty).count() == 0


def test_repeats_equal_brute_force(docs, empty, monkeypatch):
    count: Counter[bytes] = Counter()
    raw = [(i, (t or "").encode()) for i, t in texts()]
    for _, b in raw:
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    # Bins of any size are dealt out again down to single windows; shards of a few rows are merged.
    for most, shard in ((repeats.MOST, repeats.SHARD), (repeats.MOST, 2), (1, 2), (0, 1)):
        monkeypatch.setattr(repeats, "MOST", most)
        monkeypatch.setattr(repeats, "SHARD", shard)
        got = [tuple(r) for r in repeats.report(docs).drop("kept").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert repeats.report(empty).count() == 0


def test_merged_transforms_are_the_sorted_suffixes():
    rng = np.random.default_rng(5)
    for n, width, n_bins, shard, letters in ((1, 5, 1, 1, 2), (60, 12, 1, 7, 2), (80, 9, 5, 80, 3), (90, 300, 4, 20, 1)):
        bins = rng.integers(0, n_bins, n).astype(np.uint8)
        chars = rng.integers(1, letters + 1, (n, width)).astype(np.uint16)
        for row in chars:  # ragged on both sides
            row[: rng.integers(0, width // 2 + 1)] = 0
            row[width - rng.integers(0, width // 2 + 1) :] = 0
        shards = [repeats.transform(bins[k : k + shard], chars[k : k + shard]) for k in range(0, n, shard)]
        seen = []
        for column, rows, prefix in repeats.merge(shards):
            seen.append(column)
            assert rows.tolist() == sorted(range(n), key=lambda r: (bins[r], *chars[r, column:]))
            for rank in range(1, n):
                a, b = rows[rank - 1], rows[rank]
                alike = (chars[a, column:] == chars[b, column:]) & (chars[a, column:] > 0)
                want = int(np.argmin(np.append(alike, False))) if bins[a] == bins[b] else 0
                assert prefix[rank] == min(want, repeats.SPAN)
            assert prefix[0] == prefix[n] == 0
        assert seen == list(range(width))[::-1]


def test_licenses_places_and_blocks(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[16]
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (12, 2, 0, 8)
    assert (r.base_labels, r.labels, r.score) == ("cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].score) == (0, 0, None, 0.0)
    assert len(licenses.scan(docs).collect()) == len(texts())
    assert licenses.scan(empty).count() == 0


NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated
 * documentation files (the "Software"), to deal in it""",
    "bsd": """# Redistribution and use in source and binary forms,
# with or without modification, are permitted provided

# that the following conditions are met:""",
    "apache-2.0": """you may not use this file except in compliance\r
with the License. You may obtain a copy of\r
the License at""",
    "isc": """Permission to use, copy, modify, and/or distribute
this software for any purpose with or without fee
is hereby granted""",
    "mpl-2.0": """// This Source Code Form is subject to the
// terms of the Mozilla Public
// License, v. 2.0.""",
}


def test_wrapped_notices_are_found(spark):
    rows = [(i, f"a title\n\n{text}\nand more text below") for i, text in enumerate(NOTICES.values())]
    # Words of a notice that lie too far apart; many marks without words; a line for each word.
    rows += [(10, "\n".join(f"{w} " + "filler " * 9 for w in licenses.TEMPLATES[11][1].split())), (11, " ,\n" * 3000)]
    rows += [(12, "\n".join(licenses.TEMPLATES[11][1].split())), (13, None), (14, "\n" + "- " * 5000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(NOTICES))] == list(NOTICES)
    assert (got[10].labels, got[10].score, got[11].labels, got[12].labels, got[14].labels) == ("", 0.0, "", "mit", "")


def test_license_stretches_reach_over_lines_only(spark):
    template = (("x", "one two three four five"),)
    rows = [(0, "one two\nthree four\nfive"), (1, "one two three\nz z z z four five"), (2, "one two three four five"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.blocks(docs, template).collect()
    assert sorted((r.doc, r.reach, r.line, r.containment) for r in found) == [(0, 7, 0, 1.0), (2, 0, 0, 1.0)]


def test_decontamination_tolerates_substitutions(spark, docs, empty):
    item = [f"item{i}" for i in range(40)]
    changed = list(item)
    for k in (7, 16, 25, 34):
        changed[k] = "other"
    rows = [
        (1, "before " + " ".join(item).upper() + " after"),
        (2, "x y z " + " ".join(changed)),
        (3, " ".join(item[::-1])),
        (4, None),
        (5, " ".join(item[:5])),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (8, None), (7, "too short")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.overlaps(table, bench).collect()}
    assert got == {1: (9, 1, 40, 40), 2: (9, 3, 40, 36)}
    assert sorted(r.doc_id for r in decontamination.clean(table, bench).collect()) == [3, 4, 5]
    assert decontamination.clean(docs, bench).columns == docs.columns
    assert decontamination.overlaps(empty, bench).count() == 0
    assert decontamination.overlaps(table, bench.limit(0)).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    marks = ["a", "B", "é", "É", "ß", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'S", "<|endoftext|>"]
    marks += ["1", "!!", "...", ".", ",", "日本", "́", "İ", "ﬁ", "\x00", "word", "Word."]
    rng = np.random.default_rng(9)
    some = ["".join(rng.choice(marks, rng.integers(0, 25))) for _ in range(3000)]
    ids, begin = packing.Encoder(packing.tokenizer_path())(some)
    for i, text in enumerate(some):
        assert whole.encode(text, add_special_tokens=False).ids + [2] == ids[begin[i] : begin[i + 1]].tolist()


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(n): int(rng.integers(1, 60)) for n in rng.integers(1, 65, 40)} | {64: 9}
    used = defaultdict(list)
    for length, low_, high, sequence, per, at in packing.plan(counts, 64):
        for k in range(low_, high + 1):
            used[sequence + (k - low_) // per].append((at + (k - low_) % per * length, length))
    assert Counter(n for some in used.values() for _, n in some) == Counter(counts)
    for some in used.values():
        end = 0
        for at, length in sorted(some):
            assert at == end
            end += length
        assert end <= 64
    # Few lengths and a small window: still nearly full.
    assert sum(n * c for n, c in counts.items()) >= 0.95 * 64 * len(used)


def test_packing_covers_all_tokens(docs, empty):
    rows = packing.pack(docs, packing.tokenizer_path(), 64).collect()
    whole = packing.Encoder(packing.tokenizer_path())
    for doc_id, text in texts():
        ids, _ = whole([text or ""])
        own = [r for r in rows if r.doc_id == doc_id and r.doc_tokens == len(ids)]
        for r in own:
            part = ids[r.start : r.start + r.length].astype("<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
        assert {r.start for r in own} == set(range(0, len(ids), 64))
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(taken, taken[1:], strict=False):
        assert (p == o + n) if s == t else (p == 0)
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def distance(a: str, b: str) -> int:
    """Least edits; a swap of neighbours is one, and its characters are not edited again."""
    d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and (x, a[i - 2]) == (b[j - 2], y):
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_finds_the_nearest_term(edits):
    rng = np.random.default_rng(edits)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(3, 7))) for _ in range(40)})
    trie = toxicity.Trie(terms)
    for _ in range(300):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        away = min((distance(word, t), k) for k, t in enumerate(terms))
        assert trie.nearest(word, edits) == (away[1] if away[0] <= edits else -1)


def test_words_near_a_term_equal_brute_force():
    rng = np.random.default_rng(7)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 8))) for _ in range(30)})
    matcher = toxicity.Matcher(toxicity.Model(words=dict.fromkeys(terms, 1.0)))
    for _ in range(1500):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 9)))
        long = [t for t in terms if len(t) >= toxicity.FUZZY_FROM]
        near = {t for t in long if distance(word, t) == 1}
        found = matcher.near(word)
        assert (terms[found] == word) if word in long else (terms[found] in near if near else found == -1)
    matcher = toxicity.Matcher(toxicity.Model(words={"scum": 1.0, "idiots": 1.0, "oaf": 1.0}))
    got = [matcher.near(w) for w in ("scun", "scmu", "sucm", "scum", "idoits", "idots", "ooaf", "scnu", "")]
    assert got == [0, 0, 0, 0, 1, 1, -1, -1, -1]


def test_features_equal_brute_force():
    model = toxicity.Model(words={"scum": 2.0, "vermin": 3.0}, stems={"loath": 1.5})
    matcher = toxicity.Matcher(model)
    text = "You scum , loathing vermn ! " + "fine weather here " * 9 + 'he said "scum" and left'
    tokens = text.lower().split()
    # Word: weight and kind; the last scum stands in quotation marks.
    places = [(1, 2.0, "exact", 0), (3, 1.5, "stem", 2), (4, 3.0, "fuzzy", 1)]
    windows = [sum(w for p, w, _, _ in places if q <= p <= q + 2 * toxicity.WINDOW) for q, _, _, _ in places]
    total, size = sum(w for _, w, _, _ in places), len(tokens)
    want = [2.0, 1.5, 3.0, 1, 100 * total / size, 100 * 2.0 / size, 100 * 1.5 / size, max(windows), 3, 1, size]
    assert np.allclose(toxicity.features(text, matcher), np.log1p(want))
    for blank in (None, "", " \n"):
        assert toxicity.features(blank, matcher).tolist() == [0.0] * 11


def test_toxicity_learns_and_tolerates_misspelling(spark, empty):
    rng = np.random.default_rng(5)
    plain = [f"plain{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, 60))
        toxic = i % 5 == 0
        if toxic:
            for place in rng.integers(0, 60, 5):
                words[place] = str(rng.choice(["nastyword", "vileterm"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, "plain1 nastywrd plain2 vilterm nastywordd " + " ".join(plain[:20])), (2001, None), (2002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, table)
    assert {"nastyword", "vileterm"} <= model.words.keys()
    matcher = toxicity.Matcher(model)
    assert matcher.codes(["nastywrd"])[0] & 3 in (toxicity.FUZZY, toxicity.STEM)
    assert toxicity.is_quotation(['he', 'said', '"nastyword"'], 2) and not toxicity.is_quotation(["you", "vileterm"], 1)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    right = [(got[i] >= 0.7) == (i % 5 == 0) for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) >= 0.98 * len(right)
    assert got[2001] == got[2002] < 0.5
    assert toxicity.clean(docs, table).columns == docs.columns
    assert {r.score for r in toxicity.scored(docs, toxicity.learn(docs, table.limit(0))).collect()} == {0.0}
    assert toxicity.clean(empty, table).count() == 0


def test_index_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1500, 16)).astype("float32").astype(float)
    points[30:60] = points[7]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in embeddings_index.search(table, 50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    found = total = 0
    for q in range(0, 1500, 50):
        away = np.sqrt(((points - points[q]) ** 2).sum(1))
        away[q] = np.inf
        near = np.lexsort((np.arange(len(points)), away))[:10]
        assert len(got[q]) == 10 and all(away[v] == s for v, s in got[q])
        found += len(set(near) & {v for v, _ in got[q]})
        total += 10
    assert got.keys() == set(range(0, 1500, 50)) and found >= 0.9 * total
    assert [v for v, _ in got[50]] == [7, *range(30, 39)]
    assert embeddings_index.search(table.limit(0)).count() == 0


def test_durable_needs_a_shared_folder_only_on_a_cluster(spark):
    table = common.durable(spark.range(5))
    assert table.count() == 5
    common.forget(table)
