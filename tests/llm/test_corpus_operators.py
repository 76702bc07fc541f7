"""Repeats, near-duplicates, passages, fingerprints, chat: against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import xxhash

from textwarden.llm import chat, fingerprints, passages, repeats, simhash


def table(spark, texts):
    rows = [(i, t, "en", 7) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, root string, n_bytes long").repartition(4)


def test_repeats_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd éß") for _ in range(400)) for _ in range(6)]
    texts = {1: None, 2: "", 4: "ab" * 500, 5: "ab" * 300, 7: "a" * 1000, 8: base[0], 10: base[0], 11: "x" * 99, 13: "x" * 100, 14: "x" * 100}
    for i in range(150):
        texts[15 + i * 3] = "".join(
            b[a:a + rng.randrange(250)] for b, a in ((rng.choice(base), rng.randrange(300)) for _ in range(rng.randrange(6))))
    seen, want = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            window = raw[s:s + 100]
            if window in seen:
                gone[s:s + 100] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = {i: tuple(rest) for i, *rest in repeats.report(table(spark, texts)).collect()}
    assert got == want
    assert repeats.report(table(spark, texts).limit(0)).collect() == []
    kept = {r.doc_id: r for r in repeats.remove(table(spark, texts)).collect()}
    assert 10 not in kept and 2 in kept and kept[1].text is None and kept[8].n_bytes == 7


def test_repeated_rows_keep_each_other(spark):
    text = "some words that are long enough to count " * 3
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    once = repeats.report(df.limit(1)).first().n_removed
    got = repeats.report(df).collect()
    assert sorted(r.n_removed for r in got) == [0, once, once] and sum(r.doc_id is None for r in got) == 1


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = {0: None, 1: "", 2: "one", 3: " \x0b\n"}
    for i in range(4, 120):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        texts[i] = " ".join(own)
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "Edited"
            texts[i + 1000] = " ".join(own)
    fps = {}
    for i, t in texts.items():
        parts = (t or "").encode().lower().split()
        shingles = [b" ".join(parts[k:k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}
    assert {r.doc_id for r in simhash.representatives(table(spark, texts)).collect()} == {find(i) for i in fps}
    assert simhash.near_duplicates(table(spark, texts).limit(0)).collect() == []


def test_representatives_of_null_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(50)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (2, d), (None, d), (3, e), (3, e), (4, e.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in simhash.representatives(df).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d), (3, e)], key=str)


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    roots = {r.v: r.root for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


def test_passages_find_planted_ones(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(200))] for i in range(120)}
    groups = []
    for g in range(20):
        passage = [rng.choice(vocabulary) for _ in range(rng.randrange(55, 120))]
        holders = rng.sample(range(g * 6, g * 6 + 6), 3)
        for d in holders:
            own = list(passage)
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(docs[d]) + 1)
            docs[d] = docs[d][:at] + own + docs[d][at:]
        groups.append(holders)
    texts = {i: " ".join(w) for i, w in docs.items()} | {500: None, 501: ""}
    rows = {r.doc_id: r for r in passages.classes(table(spark, texts)).collect()}
    assert len(rows) == len(texts) and rows[500].n_links == 0
    for holders in groups:
        assert len({rows[d].class_id for d in holders}) == 1
    linked = {d for g in groups for d in g}
    assert all((r.n_links > 0) == (d in linked) for d, r in rows.items())


def found_passages(spark, texts):
    return [tuple(r) for r in passages.passages(table(spark, {i: " ".join(w) for i, w in texts.items()})).collect()]


def test_passages_link_every_two_holders(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, groups = {}, []
    for size in (5, 40, 20):  # the second one is frequent, the third one too, with edits
        passage = [rng.choice(vocabulary) for _ in range(80)]
        group = range(len(texts), len(texts) + size)
        for i in group:
            own = list(passage)
            if size == 20:
                own[rng.randrange(10, 70)] = f"edit{i}"
            texts[i] = [rng.choice(vocabulary) for _ in range(rng.randrange(50))] + own + [rng.choice(vocabulary) for _ in range(30)]
        groups.append(group)
    monkeypatch.setattr(passages, "BLOCK", 16)
    for hot in (64, 10):
        monkeypatch.setattr(passages, "HOT", hot)
        links = {(a, b) for a, b, *_ in found_passages(spark, texts)}
        assert links == {(a, b) for g in groups for a in g for b in g if a > b}


def test_passages_at_later_places_and_short_ones(spark):
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage, texts, want = word(60), {}, set()
    texts[0] = word(20) + [w for k in range(0, 60, 10) for w in passage[k:k + 10] + word(40)] + passage + word(20)
    texts[1] = word(10) + passage + word(30) + passage
    for k in range(30, 44):
        short = word(k)
        texts[k * 2], texts[k * 2 + 1] = word(25) + short + word(25), word(11) + short
        want.add((k * 2 + 1, k * 2, 11, 11 + k, 25, 25 + k))
    rows = found_passages(spark, texts)
    assert {r for r in rows if r[0] >= 60} == want
    assert {r[2:] for r in rows if r[0] == 1} == {(10, 70, 320, 380), (100, 160, 320, 380)}


def test_passages_compare_the_words_of_gaps(spark):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    runs = [word(12) for _ in range(12)]
    form = {i: [w for r in runs for w in r + word(12)] for i in (0, 1)}  # half of the words are equal
    passage = word(70)
    edited = passage[:20] + ["x", "y"] + passage[22:40] + passage[41:52] + ["z"] + passage[52:]
    rows = found_passages(spark, form | {2: passage, 3: edited})
    assert [r for r in rows if r[0] < 2] == []
    assert [r for r in rows if r[0] == 3] == [(3, 2, 0, len(edited), 0, 70)]


def test_passages_of_a_seed_at_many_places(spark):
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    line, texts = word(6), {}
    passage = line + word(3) + line + word(2) + line + word(4) + line + word(3)  # most of its seeds are those of the line
    for i, (before, after) in enumerate(((10, 90), (80, 30), (45, 60))):
        texts[i] = [w for k in range(before) for w in line + word(30)] + passage + [w for k in range(after) for w in word(30) + line]
    for i, n in enumerate((12, 90, 700)):
        texts[10 + i] = word(10) + line * n + word(10)
    rows = found_passages(spark, texts)
    for a, b in ((1, 0), (2, 0), (2, 1)):  # the passage has another rank among the line's places in each
        at = [next(k for k in range(len(texts[i])) if texts[i][k:k + len(passage)] == passage) for i in (a, b)]
        assert any(r[:2] == (a, b) and r[2] <= at[0] and r[3] >= at[0] + len(passage) and r[4] - r[2] == at[1] - at[0] for r in rows)
    for a, b, n, m in ((11, 10, 90, 12), (12, 10, 700, 12), (12, 11, 700, 90)):  # each word of both runs is in a passage
        found = [r for r in rows if r[:2] == (a, b)]
        assert {k for r in found for k in range(r[2], r[3])} >= set(range(16, 4 + 6 * n))  # at the ends a place may be no seed
        assert {k for r in found for k in range(r[4], r[5])} >= set(range(16, 4 + 6 * m))
        assert all(r[3] - r[2] == r[5] - r[4] for r in found)


def test_repeated_words_are_laid_over_all_of_both():
    for m, n in ((7, 20), (20, 7), (30, 30), (300, 31), (8, 300)):
        for step in (1, 2, 3):
            for shift in range(step):
                x, y = [k % step for k in range(m)], [(k - shift) % step for k in range(n)]
                found = passages.laid(m, n, step, shift)
                assert all(x[a:b] == y[c:d] and b - a == d - c == e for a, b, c, d, e in found)
                assert {k for a, b, *_ in found for k in range(a, b)} == set(range(m))
                assert {k for _, _, c, d, _ in found for k in range(c, d)} == set(range(n))
                assert max(e for *_, e in found) > min(m, n) - step


def test_matches_of_places_without_a_run():
    here, there = np.sort(np.random.default_rng(1).choice(10 ** 6, (2, 90), replace=False), 1)
    none = np.zeros(90, np.uint32)
    i, j = passages.matched(here, there, none, none)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in here.tolist() for b in there.tolist()}


def test_classes_of_copies_and_shared_ids_count_all_links(spark):
    rng = random.Random(10)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    shared = [word(50) for _ in range(4)]
    texts = [" ".join(word(20) + shared[k % 4] + word(10)) for k in range(12)] + [" ".join(word(60)) for _ in range(3)] + ["a few words", "", None]
    rows = [(i, texts[i % len(texts)]) for i in range(40)]
    rows += [(i, texts[(i * 7) % len(texts)]) for i in range(0, 40, 9)] + rows[:5] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = {(r.doc_id, r.other) for r in passages.passages(df).collect()}
    have = {i: {t for j, t in rows if j == i} for i in range(40)}
    alike = lambda t, o: t and o and len(t.split()) >= 30 and (t == o or any(" ".join(s) in t and " ".join(s) in o for s in shared))
    assert pairs == {(i, j) for i in have for j in range(i) if any(alike(t, o) for t in have[i] for o in have[j])}
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    least = {i: i for i in have}
    for _ in have:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (least[i], sum(i in p for p in pairs)) for i in have}


def test_classes_cover_what_every_pair_shares(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    form, run, rows = word(70), word(1), []
    for i in range(36):  # near copies, repeated words and both, all frequent
        own, k = list(form), rng.randrange(5, 65)
        own[k:k + 1] = [[f"edit{i}"], [], word(2)][i % 3]
        rows.append((i, " ".join(word(i % 5) + (own if i % 4 else run * (20 + i) + word(i % 3) + run * 9) + (run * (15 + i) if i % 6 == 1 else word(9)))))
    rows += [(40, rows[0][1]), (41, rows[0][1]), (42, rows[5][1]), (5, rows[8][1])]
    monkeypatch.setattr(passages, "HOT", 4)
    monkeypatch.setattr(passages, "BLOCK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = [tuple(r) for r in passages.passages(df).collect()]
    got = {r.doc_id: r for r in passages.classes(df).collect()}
    links = {(a, b) for a, b, *_ in pairs} | {(b, a) for a, b, *_ in pairs}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(a == i for a, _ in links) for i in got}
    held = {i: {k for a, b, s, e, t, f in pairs if i in (a, b) for k in range(*((s, e) if a == i else (t, f)))} for i in got}
    for i, r in got.items():
        parts = [tuple(map(int, p.split(":"))) for p in r.passages.split(",") if p]
        assert (r.n_passages, r.n_words) == (len(parts), sum(e - s for s, e in parts))
        if i != 5:  # the words of its two texts are numbered apart
            assert {k for s, e in parts for k in range(s, e)} == held[i]


def seeds_of(texts):
    """Words, and the seeds' text, place, hash and gap, of texts that are lists of words."""
    data = " ".join(w for t in texts for w in t).encode()
    offsets = np.cumsum([0] + [len(" ".join(t)) + 1 for t in texts])
    offsets[-1] -= 1
    data = np.frombuffer(data, np.uint8)
    word, own, _ = passages.words_of(data, offsets)
    words = [(word[own == i] >> np.uint64(32)).astype(np.uint32) for i in range(len(texts))]
    doc, pos, h, gap = passages.seeds(data, offsets)
    return words, doc, pos.astype(np.int64), h, gap


def test_chains_lose_no_words_that_a_passage_needs():
    rng = random.Random(13)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    form, line, texts = word(90), word(20), []
    for _ in range(30):  # edits, words left out, frequent lines within and beside, repeated words
        a = rng.randrange(60)
        own = form[a:a + rng.randrange(20, 90)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(own))
            own[k:k + rng.randrange(3)] = [word(1), [], line, ["r"] * 12][rng.randrange(4)]
        texts.append(word(rng.randrange(20)) + line[rng.randrange(20):] + own + line[:rng.randrange(20)] + word(30) + form[:12])
    words, doc, pos, h, gap = seeds_of(texts)
    for hot in (2, 12, 64):
        found, often = passages.paired(h, doc, pos, gap, hot)
        a, b, x, y = np.concatenate(found, 1)
        links, often = {"row": a, "other": b, "pos": x, "shift": y - x}, {"row": doc[often], "pos": pos[often], "h": h[often], "gap": gap[often]}
        _, near, places = passages._places([often], 30)
        chained = passages._linked([links], near, places, 30)
        got, carried = set(), 0
        for _, _, _, blob in passages._cut_out(chained, words, 3) if chained else ():
            part = passages._whole(blob)
            carried += len(part["cut"])
            got |= set(passages._compared(part, words, 30, 0.8))
        want, whole = set(), 0
        for i in range(len(texts)):
            for j in range(len(texts)):
                k = np.flatnonzero((a == i) & (b == j))
                k = k[np.lexsort((y[k], x[k]))]
                for p, q in passages._chains(x[k], y[k]) if len(k) else ():
                    whole += p[-1] + passages.RUN + 64 - max(0, p[0] - 64)
                    for s, e, t, f, _ in passages.aligned(words[i].tolist(), words[j].tolist(), p, q, 30, 0.8):
                        want.add((i, j, s, e, t, f) if i > j else (j, i, t, f, s, e))
        assert got == want and (hot == 2 or len(got) > 50)
        assert carried < whole / 2


def test_short_repeats_carry_no_words():
    rng = random.Random(14)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    lines = [word(15) for _ in range(10)]
    _, doc, pos, h, gap = seeds_of([[w for line in rng.sample(lines, 6) for w in word(40) + line] for _ in range(8)])
    a, b, x, y = np.concatenate(passages.paired(h, doc, pos, gap, 64)[0], 1)
    assert len(a) > 100
    none = np.zeros(0, np.int64)
    assert passages._linked([{"row": a, "other": b, "pos": x, "shift": y - x}], none, none, 30) == {}


def test_blocks_are_sent_to_tiles_not_to_all_blocks(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    forms, rows = [word(50) for _ in range(3)], []
    for i in range(60):
        own = [w for form in forms[i % 3:i % 3 + 1 + i % 2] for w in form + word(30)]
        own[10 + i % 30] = f"edit{i}"
        rows.append((i, " ".join(word(i % 7) + own)))
    rows += [(70, rows[1][1]), (3, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(passages, "HOT", 4)
    want = sorted(map(tuple, passages.classes(df).collect()))
    assert sum(r[2] for r in want) > 1000
    monkeypatch.setattr(passages, "BLOCK", 2)
    monkeypatch.setattr(passages, "TILES", 3)
    assert sorted(map(tuple, passages.classes(df).collect())) == want
    _, stretches = passages.matches(passages._rows(df))
    stretches = stretches.selectExpr("*", "1L AS weight", "false AS several")
    assert stretches.count() > 40
    sent = passages._pairs_of_blocks(stretches.coalesce(1), None, 3)
    blocks = sent.select("block").distinct().count()
    assert blocks > 20 and sent.count() <= blocks * (3 + -(-blocks // 8))


def test_cores_are_compared_as_by_chains(monkeypatch):
    rng = random.Random(12)
    form = [f"f{k}" for k in range(60)]
    texts = []
    for i in range(60):
        own, k = list(form), rng.randrange(60)
        own[k:k + 1] = [["x"], [], ["y", "z"]][i % 3]
        run = ["r"] * rng.randrange(10, 50)
        texts.append([own, run, ["r", "s"] * rng.randrange(8, 20), run + own[:30], own[:40] + own[20:]][i % 5])
    data = " ".join(w for t in texts for w in t).encode()
    offsets = np.cumsum([0] + [len(" ".join(t)) + 1 for t in texts])
    offsets[-1] -= 1
    doc, at, h, gap = passages.seeds(np.frombuffer(data, np.uint8), offsets)
    word, own, _ = passages.words_of(np.frombuffer(data, np.uint8), offsets)
    count = lambda x: np.bincount(x, minlength=len(texts))
    block = passages._Block([repeats.packed(
        row=np.arange(len(texts)), start=np.zeros(len(texts), np.int64), n=count(doc), size=count(own), h=h, at=at, gap=gap,
        core=(word >> np.uint64(32)).astype(np.uint32), around=np.zeros(len(texts) * 2 * passages.BEYOND, np.uint32),
        weight=np.ones(len(texts), np.int64), several=np.zeros(len(texts), bool))])
    ranges = lambda: [sorted(map(tuple, passages._alike(block, block, me, 16, 0.8)[:5].T.tolist())) for me in range(len(block.seen))]
    found = ranges()
    monkeypatch.setattr(passages, "_lines", lambda *_: ([np.zeros((4, 0), np.int64)], []))
    monkeypatch.setattr(passages, "_level", lambda a, b, me, core, *_: np.stack([0 * core, 0 * core + 10 ** 6, 0 * core]))  # all are aligned
    assert found == ranges()
    assert sum(map(len, found)) > 500


def test_fenwick_chain_prefers_the_ascending_matches():
    pos = np.array([0, 8, 16, 24, 32, 40])
    there = np.array([100, 108, 3, 124, 132, 1])
    assert passages.chains(pos, there)[0] == [0, 1, 3, 4]


def test_fingerprints(spark):
    texts = {3: "a b c d e\nf g\nh", 5: "h\na b c d e\nf g", 9: None, 12: "é🙂x", 2 ** 40: "f g"}
    rows = {r.doc_id: r for r in fingerprints.edited_neighbours(table(spark, texts)).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i] or "", texts[j] or ""
        half = len(t) // 2
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[3].fingerprint == rows[5].fingerprint and rows[3].near_next == 1.0  # order does not matter
    df = table(spark, {1: "a b c d e\nf g", 2: "h", 3: "a b c d e\nf g\nh"}).withColumnRenamed("text", "value")
    fp = {r.doc_id: r for r in fingerprints.sums(df.select("doc_id", "value"), ["doc_id"]).collect()}
    whole = [(x + y) % 2 ** 32 for x, y in zip(fp[1].fp, fp[2].fp, strict=True)]
    assert whole == fp[3].fp
    assert fingerprints.edited_neighbours(table(spark, texts).limit(0)).collect() == []


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "<", "</turn>", "\n", "<turn>user\n", "\\l", "\\s", "é", "ok ", "### Assistant:"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb<", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))]))
            for c in range(20) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows + rows[:1], "conv_id long, turn long, role string, text string")
    got = chat.formatted_turns(df).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(chat.ORACLE_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got[want.columns.tolist()].to_dict() == want.to_dict()


def test_helper_columns_do_not_clash(spark):
    """Operators that keep all columns, on tables that have columns of their helpers' names."""
    names = "_doc _key _hash _own _id _kept_hash _kept_id __doc key root".split()
    said = "a passage that is long enough to be taken out of one of two texts, as it stands in both of them, word by word"
    df = spark.createDataFrame([(i, f"{said} {i}", *range(len(names))) for i in range(3)],
                               "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(2)
    for out in (repeats.remove(df), simhash.representatives(df)):
        assert out.columns == df.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())


def test_turns_pass_through_every_kind_of_event(spark):
    rows = [(1, 2, "assistant", "odd"), (1, 1, "user", "é🙂<x"), (1, 2, "assistant", "odd"), (1, None, None, None), (None, 1, "assistant", "")]
    events = chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in events.select("kind").distinct().collect()} == set(chat.KINDS)
    got = sorted(((r.conv_id is None, r.at, r.role, r.text) for r in chat.fold(events).collect()))
    assert got == [(False, 1, "", ""), (False, 2, "user", "é🙂<x"), (False, 3, "assistant", "odd"),
                   (False, 4, "assistant", "odd"), (True, 1, "assistant", "")]


def test_chat_folds_events(spark):
    events = spark.createDataFrame(
        [(1, 1, "message", None, "user", "h<i\\"), (1, 2, "message", None, "assistant", ""), (1, 3, "delta", None, None, "ab"),
         (1, 4, "delta", None, None, "cd"), (1, 5, "regenerate", None, None, None), (1, 6, "delta", None, None, "xy"),
         (1, 7, "edit", 1, None, "hello"), (2, 1, "delta", None, None, "alone")],
        "conv_id long, seq long, kind string, target long, role string, text string")
    assert [(r.conv_id, r.at, r.role, r.text) for r in chat.fold(events).orderBy("conv_id", "at").collect()] == [
        (1, 1, "user", "hello"), (1, 2, "assistant", "xy"), (2, 0, "", "alone")]


def brute_fingerprint(text):
    """The part of a fingerprint for equality, and the number of runs, from sums of Python numbers."""
    sums, runs = [0] * fingerprints.WORDS, 0
    for line in text.split("\n"):
        for k in range(fingerprints.WORDS // 2):
            seed = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)
            h = xxhash.xxh64_intdigest(line.encode(), seed)
            sums[2 * k] += h & 0xFFFFFFFF
            sums[2 * k + 1] += h >> 32
        runs += -(-len(line.split()) // 4)
    return "".join(f"{x % (1 << 32):08x}" for x in [*sums, runs])


def brute_likeness(text, other):
    def signed(t):
        out = [0] * 64
        for line in t.split("\n"):
            words = line.split()
            for i in range(0, len(words), 4):
                seed = xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42)
                h = xxhash.xxh64_intdigest(b"unit", seed)
                for j in range(64):
                    out[j % 32 + (32 if j >= 32 else 0)] += 1 if h >> j & 1 else -1
        return out
    if brute_fingerprint(text) == brute_fingerprint(other):
        return 1.0
    a, b = signed(text), signed(other)
    both = sum(x * x + y * y for x, y in zip(a, b, strict=True))
    return 0.0 if not both else min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a, b, strict=True)) / both))


def test_fingerprints_of_ids_of_any_kind(spark, monkeypatch):
    """Hashed and far ids, null ids, one id of many documents, repeated rows: against plain Python."""
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    rng = random.Random(9)
    for ids in ([0, 1 << 62], [-(1 << 63), (1 << 63) - 1, 0, None], [*range(40), 1 << 40], [5] * 60 + [None] * 30 + [1, 9],
                [xxhash.xxh64_intdigest(str(i)) - (1 << 63) for i in range(80)], [3]):
        rows = [(i, rng.choice([f"text {k} of some words\nand a line {k % 3}", "", None, "é" * 7, f"w{k}"])) for k, i in enumerate(ids)]
        rows += rows[:2] if len(rows) > 3 else []
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
        got = fingerprints.edited_neighbours(df).collect()
        tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
        ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0,
                                                                         (tie(r[1]) + (1 << 63)) % (1 << 64)))
        want = []
        for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(t), brute_fingerprint(edited),
                         round(brute_likeness(t, edited), 9), round(brute_likeness(t, following), 9)))
        assert sorted(map(repr, want)) == sorted(repr((
            r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint[:72], r.edited_fingerprint[:72],
            round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
