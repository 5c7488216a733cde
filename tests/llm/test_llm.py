"""Every operator against brute force, and with nulls, empties, ties, repeats and extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quernal.llm import decontaminate, language_model, licenses, ngram_join, packing, quality, sharding, substring, vector_topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch_id int, score string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(200)
    out = [(i, text(rng.randrange(0, 120))) for i in range(60)]
    for i in range(60, 90):  # near copies
        w = base.split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edited" + str(rng.randrange(1000))
        out.append((i, " ".join(w)))
    out += [(i, "the same  text\nover and over again in every one of these rows\x0b here you see") for i in range(90, 110)]
    shared = text(60)
    out += [(i, text(20) + " " + shared + " " + text(10)) for i in range(110, 118)]
    out += [(118, None), (119, ""), (120, "   "), (121, "one"), (122, "one two"), (123, "ONE two"), (124, "é ü ß"), (125, "word " * 30_000), (None, base), (126, base), (126, base)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make_docs(spark, rows).repartition(5).cache()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_ngram_join_against_brute_force(docs, rows):
    rows = [(i, t) for i, t in rows if i is not None]
    for hot in (1 << 16, 2):
        got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join_sets(docs, hot).collect() if r.doc_id is not None}
        sets = {}
        for i, t in rows:
            w = words_of(lower(t))
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
        comp = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and comp[a] != comp[b]:
                        common = len(sets[a] & sets[b])
                        if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                            comp[a] = comp[b] = min(comp[a], comp[b])
                            changed = True
        assert got == {(i, len(s)): comp[i] for i, s in sets.items()}


def test_keep_one_leaves_one_of_each_group(docs):
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    assert left.where("text like 'the same%'").count() == 1
    assert left.where("doc_id in (118, 119, 120)").count() == 3


def test_near_duplicate_stage_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(40, 160))]
        for edits in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            texts.append(w)
        at = rng.randrange(len(base))
        texts += [base[: len(base) * k // 100] for k in (79, 80, 81, 90)] + [base[:at] + [f"p{rng.randrange(10_000)}" for _ in range(len(base) // 8)] + base[at:]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    comp = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if comp[a] != comp[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    frame = make_docs(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()) == [i for i, c in enumerate(comp) if i == c]


def test_substring_against_brute_force(docs, rows):
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), order(i))
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone[k : k + 13] = [True] * 13
        want[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, substring.measure(docs).collect())) == want
    stripped = substring.strip(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(rows)


def test_levels_double_up_to_the_window():
    assert substring.lengths(13) == [4, 8, 13]
    assert substring.lengths(1) == [1]
    assert substring.lengths(50) == [13, 26, 50]


def test_sharding_is_minimax(docs, rows):
    got = sharding.shard_by_bytes(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, shards = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    largest = max(sum(r.size for r in got if r.shard == k) for k in slots)
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    assert largest >= max(sizes.values())
    assert largest <= max(max(sizes.values()), -(-sum(sizes.values()) // 8) + max(sizes.values()))


def test_minimax_cuts_against_exhaustive(spark):
    rng = random.Random(1)
    for shards in (2, 3, 4):
        sizes = [rng.randrange(1, 40) for _ in range(12)]
        prefix = np.cumsum(sizes).tolist()
        frame = spark.createDataFrame([(p,) for p in prefix], "upto long")

        def need(c):
            n, used = 1, 0
            for s in sizes:
                if used + s > c:
                    n, used = n + 1, 0
                used += s
            return n

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= shards)
        assert sharding.minimax_cuts(frame, prefix[-1], max(sizes), shards)[0] == best


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, path).collect()
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    want = Counter(i for (i, _) in rows)
    assert Counter(r.doc_id for r in got if r.start == 0) == want
    by = {i: np.array(x, "<u4") for (i, _), x in zip(rows, ids, strict=True)}
    for r in got:
        assert r.doc_tokens == len(by[r.doc_id]) and zlib.crc32(by[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    tokenizer = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "x\n\n<|endoftext|>\n y", "<|ENDOFTEXT|>"]
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    got = packing.pack(make_docs(spark, list(enumerate(texts))).repartition(1), path).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(i, len(x)) for i, x in want.items()}
    for r in got:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "a" + "\n" * 1_200_000, "b" + " \t" * 80_000 + "c d"])
def test_packing_takes_very_long_white_space(text):
    from tokenizers import Tokenizer

    path = vocabulary()
    assert packing.ids_of_text(path, text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packer_takes_the_level_with_least_sum_of_squares():
    rng = random.Random(5)
    packer = packing.LevelPacker(16)
    for _ in range(300):
        size = rng.randrange(1, 16)
        before = packer.count.copy()
        costs = []
        for h in range(0, 17 - size):
            if h and not before[h]:
                continue
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            costs.append((after[1:16] ** 2).sum())
        packer.place(size, (0, 0, size, np.zeros(size, "<u4")))
        assert (packer.count[1:16] ** 2).sum() == min(costs)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (700, 12)).astype(np.float32)
    x[50:80] = x[49]
    x[300:320] *= 5
    rows = [(i * 10, v.tolist(), 0) for i, v in enumerate(x)] + [(7001, None, 0), (7002, [None] * 12, 0), (7003, [float("nan")] * 12, 0), (None, [0.0] * 12, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = np.floor(x.astype(float) * 1024).astype(np.int64)
    ids = np.arange(700) * 10
    want = set()
    for q in range(0, 700, 10):
        s = v @ v[q]
        best = [j for j in np.lexsort((ids, -s)) if j != q][:10]
        want |= {(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    assert set(map(tuple, vector_topk.top_k(frame).collect())) == want
    old, vector_topk.BLOCK_ROWS = vector_topk.BLOCK_ROWS, 100
    try:
        assert set(map(tuple, vector_topk.top_k(frame).collect())) == want
    finally:
        vector_topk.BLOCK_ROWS = old


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1 é</p>"
    rows = [(1, "http://a/\n b", big, 3), (5, None, big, 3), (3, "u", big, 3), (4, "u", "small", 3), (6, "u", "small", 3), (7, "u", None, 3), (8, "u", "", 3), (None, "u", big, 3), (5, "u", big, 3)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, archive int")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(
        (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h, _ in rows
    )
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_that_a_lost_attempt_left_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(20)], "page_id long, url string, html string")
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    typed = warc.assign_types(pages)
    warc.write_monolithic(typed, raw).collect()  # a lost attempt: nothing lists its archives
    written = warc.keep(warc.write_monolithic(typed, raw), "list")
    assert warc.normalise(spark, raw, out, written).agg({"records": "sum"}).first()[0] == 20
    assert sorted(r.page_id for r in warc.read_indexed(spark, out).collect()) == list(range(20))


def test_normaliser_makes_one_member_a_record():
    import gzip

    records = [warc.record("response", {"WARC-Record-ID": str(i)}, b"x" * i * 1000) for i in range(5)]
    for raw in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        body, index = warc.normalise_bytes(raw)
        assert [gzip.decompress(body[x["offset"] : x["offset"] + x["length"]]) for x in index] == records
    with pytest.raises(ValueError):
        warc.normalise_bytes(gzip.compress(b"".join(records))[:-20])


def test_licenses(spark):
    lines = ["Released under the MIT License.", "  Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Released under the MIX License.", "a license to speak", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(1, "\n".join(lines)), (2, None), (3, ""), (4, "x" * 9000 + " Released under the MIT License. " + "y" * 9000), (1, lines[0])]
    got = Counter((r.doc_id, r.line, r.license) for r in licenses.scan_licenses(make_docs(spark, rows)).collect())
    assert got == Counter([(1, 0, "MIT"), (1, 1, "Apache-2.0"), (1, 2, "proprietary"), (1, 5, "GPL-3.0"), (4, 0, "MIT"), (1, 0, "MIT")])
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert name in [k for k, _, _ in scanner.scan(text)]


def test_every_license_of_a_line_is_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for names in (["GPL-3.0", "MIT"], ["CC-BY-NC-4.0", "proprietary"], ["proprietary", "AGPL-3.0"], list(licenses.TEMPLATES)):
        found = {k for k, _, _ in scanner.scan(" ".join(licenses.TEMPLATES[k] for k in names))}
        assert found >= set(names)


def test_licenses_over_lines_and_with_other_words(spark):
    texts = {
        1: "x\nLicensed under the Apache License,\nVersion 2.0.\ny",
        2: "# This library is licensed under the\n#   GNU Lesser General Public\n#   License, version 2.1.",
        3: "Released under the terms of the MIT License.",
        4: "This work is published under the GNU General Public License, version 2.",
        5: "Released under the MIX License.\nReleased under the X License.",
        6: "All rights reserved.\nAll rights are reserved.\nAll rights reserved.",
        7: "Licensed under CC BY-NC-SA 4.0.\nLicensed under the GNU General Public License, version 9.",
        8: "Released under the MIT License.\nReleased under the ISC License.",
    }
    got = {(r.doc_id, r.line, r.license, r.differences) for r in licenses.scan_licenses(make_docs(spark, list(texts.items()))).collect()}
    assert got == {(1, 1, "Apache-2.0", 0), (2, 0, "LGPL-2.1", 0), (3, 0, "MIT", 3), (4, 0, "GPL-2.0", 1), (6, 0, "proprietary", 0), (6, 2, "proprietary", 0), (8, 0, "MIT", 0), (8, 1, "ISC", 0)}


def test_licenses_are_found_by_what_their_templates_save(monkeypatch):
    """Without savings there is no notice; with them none is lost that any template's alignment finds."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(12)
    filler = [f"{a}{b}" for a in ("under", "free", "soft", "qu", "the", "lic") for b in ("ware", "", "ing", "ense", "x7")] + "the of to under license licensed version public general".split()
    for trial in range(150):
        own = []
        for name in rng.sample(list(scanner.words), 1 + trial % 3):
            t, (most, lost) = list(scanner.words[name]), scanner.bounds(name)
            for _ in range(rng.randint(0, lost)):
                free = [i for i, w in enumerate(t) if w not in scanner.names[name]]
                if free:
                    i = rng.choice(free)
                    t[i : i + 1] = [rng.choice(filler)] * rng.randint(0, 1)
            for _ in range(rng.randint(0, most - lost)):
                t.insert(rng.randint(1, len(t)), rng.choice(filler))
            own += [rng.choice(filler) for _ in range(rng.choice((0, 5, 60, 300)))] + t
        found = {k for k in scanner.words if scanner.align(k, own)}
        assert found <= scanner.candidates(own), (found, own)
    text = "Released under the MIT License. RELEASED UNDER THE ISC LICENSE."
    assert {(k, n > 0) for k, n, _ in scanner.scan(text)} == {("MIT", True), ("ISC", True)}
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, names, block: dict.fromkeys(names, 0))
    assert licenses.Scanner(licenses.TEMPLATES).scan(text) == []


def test_license_at_any_place_of_a_long_line():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for gap in [*range(1990, 2080), 2500, 4090]:
        line = "z " * 1500 + "license " + "y" * gap + " All rights reserved. " + "x " * 2000
        assert [(n, k) for n, k, *_ in scanner.notices(line)] == [(0, "proprietary")]


def test_decontamination_against_brute_force(spark, rows):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(50)) for _ in range(rng.randrange(4, 40)))) for k in range(12)] + [(90, None), (None, "q w e r t y"), (91, "")]
    documents = [(i, t) for i, t in rows[:40]]
    for k, t in items[:12]:
        w = t.split()
        documents.append((1000 + k, "before it " + t.upper() + " after it"))
        documents.append((2000 + k, "before it " + " ".join([*w[:-1], "other"]) + " after it"))
        documents.append((3000 + k, " ".join(w[: len(w) // 2])))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(make_docs(spark, documents), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def bag(w):
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
        c = Counter()
        for g in grams:
            c[g] += sum(map(len, g))
        return c

    want = {}
    for i, t in documents:
        w = words_of(lower(t))
        for k, item in items[:12]:
            b = words_of(lower(item))
            for s in range(max(1, len(w) - len(b) + 1)):
                part = w[s : s + len(b)]
                if part:
                    x, y = bag(part), bag(b)
                    both = sum((x & y).values())
                    sim = both / (sum(x.values()) + sum(y.values()) - both)
                    if sim >= 0.8:
                        want[(i, k)] = max(want.get((i, k), 0), sim)
    assert found.keys() == want.keys(), (sorted(found.keys() - want.keys()), sorted(want.keys() - found.keys()), [len(t.split()) for _, t in items[:12]])
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert decontaminate.clean(make_docs(spark, documents), spark.createDataFrame(items, "item_id long, text string")).count() == len(documents) - len({i for i, _ in want})


def test_benchmark_in_blocks_gives_the_same(spark):
    rng = random.Random(2)
    items = [(k, " ".join(str(rng.randrange(1000)) for _ in range(30))) for k in range(20)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    documents = make_docs(spark, [(100 + k, f"before {t} after") for k, t in items] + [(7, "nothing of it")])
    whole, parts = ({(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, frame, most).collect()} for most in (1 << 28, 500))
    assert whole == parts == {(100 + k, k) for k, _ in items}
    assert [r.doc_id for r in decontaminate.clean(documents, frame, 500).collect()] == [7]


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.ItemIndex(list(range(30)), [" ".join(f"t{rng.integers(1000)}" for _ in range(20)) for _ in range(30)])
    for i in range(30):
        for flips in (0, 5, 20, 40):
            p = index.prints[i].copy()
            p[rng.choice(128, flips, replace=False)] ^= 1
            assert set(index.within(p)) == set(np.flatnonzero((index.prints != p).sum(1) <= decontaminate.RADIUS))


def test_language_model(docs, rows):
    got = language_model.score_texts(docs).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*words_of(lower(t)), None]) for i, t in rows]
    count = Counter(w for i, t in tokens if zlib.crc32(str("" if i is None else i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(t), sum(count[w] > 0 for w in t), n, round(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_trains_on_every_training_token(docs, monkeypatch):
    seen, average = [], language_model._average

    def spy(parts, like):
        seen.append(sum(r["weight"] for r in parts.select("weight").collect()))
        return average(parts, like)

    monkeypatch.setattr(language_model, "_average", spy)
    tokens = language_model.score_texts(docs).first().train_tokens
    assert sum(seen) == tokens


def test_language_model_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64))
    count = rng.integers(0, 50, len(keys))
    v = language_model.Vocabulary(language_model._stats(keys, count, 20))
    p = language_model.initial(v)
    known = keys[count > 0]
    ids = v.inputs(keys, count)
    states = rng.normal(0, 1, (1, language_model.HIDDEN)).astype(np.float32)
    log = language_model.log_probability(p, np.repeat(states, len(keys), 0), ids)
    tail = (ids >= language_model.TOP) & (ids < language_model.TOP + language_model.TAIL)
    log[tail] += np.log((count[tail] + language_model.SMOOTH) / v.within[ids[tail] - language_model.TOP])
    unknown = np.exp(language_model.log_probability(p, states, np.array([language_model.TOP + language_model.TAIL])))[0]
    assert len(known) and np.exp(log[count > 0]).sum() + unknown <= 1 + 1e-4
    first = np.array([0, 300, 310])
    tokens = ids[rng.integers(0, len(ids), 310)]
    tokens[[299, 309]] = tokens[299]
    a, b = (language_model.score_rows(p, first, tokens, window) for window in (7, 64))
    assert np.allclose(a, b, rtol=1e-4)


def plain_model(p, rows):
    """Summed log probability of each row, token by token in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    n, out = language_model.HIDDEN, []
    for row in rows:
        h, total = np.zeros(n), 0.0
        for k, token in enumerate([row[-1], *row]):
            if k:
                s = np.append(h, 1.0)
                logits, c = s @ p["oc"], token // language_model.CLASS_SIZE
                total += logits[c] - np.log(np.exp(logits).sum())
                if token < language_model.UNKNOWN:
                    logits = s @ p["ow"][c]
                    total += logits[token % language_model.CLASS_SIZE] - np.log(np.exp(logits).sum())
            x, u = p["embed"][token] @ p["wx"] + p["b"], h @ p["wh"]
            z, r = 1 / (1 + np.exp(-(x[:n] + u[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + u[n : 2 * n])))
            c = np.tanh(x[2 * n :] + r * u[2 * n :])
            h = z * h + (1 - z) * c
        out.append(total)
    return np.array(out)


def some_model(rng):
    keys = np.arange(1, 6000, dtype=np.uint64) << np.uint64(50)
    v = language_model.Vocabulary(language_model._stats(keys, rng.integers(1, 50, len(keys)), 20))
    p = language_model.initial(v)
    p["oc"][:-1] *= 30
    p["ow"][:, :-1] *= 30
    return p


def test_language_model_scores_as_a_plain_one():
    rng = np.random.default_rng(4)
    p = some_model(rng)
    sizes = np.append([900, 1, 700], rng.integers(1, 30, 40))
    first = np.append(0, np.cumsum(sizes))
    ids = rng.integers(0, language_model.INPUTS, first[-1]).astype("<u2")
    ids[first[1:] - 1] = 3
    rows = [ids[a:b].astype(int) for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(language_model.score_rows(p, first, ids), plain_model(p, rows), rtol=1e-5)


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    p = some_model(rng)
    time, lanes = 6, 5
    src, dst = rng.integers(0, language_model.INPUTS, (2, time, lanes))
    dst[0, 0] = language_model.UNKNOWN
    got = {}

    class Watched(language_model.Trainer):
        def update(self, g, rows, d_rows):
            got.update(g)
            got["embed"] = np.zeros_like(self.p["embed"])
            got["embed"][rows] = d_rows

    Watched(p).window(src, dst, np.zeros((lanes, language_model.HIDDEN), np.float32))
    p = {k: v.astype(np.float64) for k, v in p.items()}

    def loss():
        h, total = np.zeros((lanes, language_model.HIDDEN)), 0.0
        gathered, w = language_model.thirds(p["embed"] @ p["wx"] + p["b"]), language_model.thirds(p["wh"])
        for t in range(time):
            h = language_model.cell([g[src[t]] for g in gathered], w, h)[-1]
            total -= language_model.log_probability(p, h, dst[t]).sum()
        return total / dst.size

    for k in p:
        for i in np.argsort(-np.abs(got[k].ravel()))[:3]:
            held = p[k].flat[i]
            p[k].flat[i] = held + 1e-4
            up = loss()
            p[k].flat[i] = held - 1e-4
            assert np.isclose((up - loss()) / 2e-4, got[k].flat[i], rtol=2e-3), k
            p[k].flat[i] = held


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(11)
    heads, follow = [f"w{i}" for i in range(60)], {}
    for w in heads:
        follow[w] = [rng.choice(heads) for _ in range(3)]

    def text():
        w = [rng.choice(heads)]
        while len(w) < 150:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    got = [r for r in language_model.score_texts(make_docs(spark, [(i, text()) for i in range(700)])).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert len(got) > 30 and sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.1


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    stream = np.tile(rng.integers(0, 50, 20), 400)
    keys = np.arange(1, 60, dtype=np.uint64) << np.uint64(50)
    v = language_model.Vocabulary(language_model._stats(keys, np.full(59, 10), 1))
    p = language_model.initial(v)
    first = np.array([0, len(stream)])
    before = language_model.score_rows(p, first, stream)[0]
    after = language_model.score_rows(language_model.train_stream(p, stream), first, stream)[0]
    assert after > before * 0.8


def test_topk_of_long_tails_and_equal_lengths(spark, monkeypatch):
    """Lengths over three orders of magnitude, and a third of all rows one and the same vector; pairs of blocks beyond a query's reach are not made."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(900, 12)) * np.exp(rng.normal(size=(900, 1)) * 2)
    m[600:] = m[0]
    m[300] = 0
    rows = [(i, m[i].tolist()) for i in range(900)]
    z = np.floor(1024 * m).astype(np.int64)
    want = set()
    for q in range(0, 900, 100):
        s = z @ z[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        want |= {(q, r + 1, i, int(s[i])) for r, i in enumerate(best)}
    monkeypatch.setattr(vector_topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector_topk, "QUERY_ROWS", 3)
    assert set(map(tuple, vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == want


def test_query_groups_reach_every_class_they_need():
    counts, classes = {0: 5000, 3: 10, 5: 20, 9: 2040}, 12
    first, split, wanted = vector_topk.query_groups(counts, classes)
    for last in counts:
        for c in range(last + 1):
            assert first[last] + split[last] <= wanted[c]
    assert wanted[10] == 0 and wanted[9] == 1 and split[0] == 3


def test_topk_of_empty_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    empty = spark.createDataFrame([(0, [], 1), (1, [], 1), (100, [1.0], 1), (2, [0.5], 1)], schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_topk.top_k(empty).collect()] == [(100, 1, 2, 1024 * 512)]
    large = spark.createDataFrame([(0, [1e6, 0.0], 1), (1, [1e6 + 2**-10, 0.0], 1), (2, [1e6, 0.0], 1)], schema)
    assert [(r.vec_id, r.rank) for r in vector_topk.top_k(large, k=1).collect()] == [(1, 1)]


def test_quality_takes_one_text_a_labelled_id(spark):
    rows = [(i, "good fine words here" if i % 2 else "bad junk junk junk") for i in range(40)] + [(3, "good fine words here")] * 500
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.classify(make_docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_stages_of_empty_tables_and_clashing_names(spark):
    import corpus_pipeline

    rows = [(i, f"some words of text number {i} " * 5, "x", i) for i in range(6)] + [(2, None, "y", 1)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, _at string, _stay long").withColumnsRenamed({"_stay": "row"})
    for frame in (clash, clash.limit(0)):
        assert ngram_join.keep_one(frame).columns == frame.columns
        assert ngram_join.keep_one(frame).count() == frame.count()
        assert substring.strip(frame).count() == frame.count()
    assert {r["_at"] for r in ngram_join.keep_one(clash).collect()} == {"x", "y"}
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = make_docs(spark, [])
    assert decontaminate.clean(empty, benchmark).count() == quality.keep_good(empty, labels).count() == 0
    assert corpus_pipeline.packing_stage(spark, empty, "").count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "house", "river", "walks", "over", "green"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "$$$ now", "zzz"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(300, None), (301, ""), (None, good()), (5, good())]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(make_docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = quality.keep_good(make_docs(spark, rows), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and kept.where("doc_id % 3 = 0 and doc_id < 300").count() == 0


def test_empty_tables(spark):
    empty = make_docs(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.join_sets(empty).count() == 0
    assert substring.measure(empty).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert packing.pack(empty, vocabulary()).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert language_model.score_texts(empty).count() == 0
    assert vector_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert decontaminate.contaminated(make_docs(spark, [(1, "a b c")]), bench).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
        assert 0 < at.count() <= seen, name
        seen = at.count()
    assert corpus_pipeline.run(spark, sf).count() >= seen
