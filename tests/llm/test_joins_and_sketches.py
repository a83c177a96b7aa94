"""Jaccard join, fingerprints, nearest vectors, license scans and archives against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from odd_rows import ODD
from warden.llm import fingerprints, license_notices, licenses, nearest, ngram_join, shingles, warc
from warden.llm.queries import QUERIES


def word_shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [word_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def shared_passage(share, texts=60, size=200):
    """Texts with one passage for ``share`` of their words, and near copies of some."""
    rng, rows = random.Random(6), []
    passage = [f"p{i}" for i in range(int(size * share))]
    for i in range(texts):
        own = [f"o{i}.{k}" for k in range(size - len(passage))]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(passage + own[:-rng.randrange(1, 9)])))
    return rows


def test_hot_cells_are_cut_into_block_pairs(documents, monkeypatch):
    """No task compares more sets than two blocks hold, and the answer stays that of brute force."""
    monkeypatch.setattr(ngram_join, "HOT", 8)
    dealt, cut = [], ngram_join.block_pairs
    monkeypatch.setattr(ngram_join, "block_pairs", lambda cells: dealt.append(cut(cells)) or dealt[-1])
    for share in (0.4, 0.7, 0.8):
        rows = shared_passage(share)
        got = [tuple(r) for r in ngram_join.linked(documents(rows)).collect()]
        assert sorted(got) == sorted(brute_components(rows))
        sizes = [r["count"] for r in dealt[-1].groupBy("key", "low", "high").count().collect()]
        assert max(sizes, default=0) <= 4 * ngram_join.HOT  # blocks are dealt by hash
    assert dealt[-1].filter("low <> high").count() > 0


def near_copies(seed):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(50)]
    for _ in range(45):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 9, 20, 47, 60, 66, 70, 150, 250, 262, 1030]))]
        base += passage * (rng.random() < 0.3)
        for _ in range(rng.choice([1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 22)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 2])
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


def test_join_equals_brute_force(documents):
    rows = near_copies(4) + ODD
    got = [tuple(r) for r in ngram_join.linked(documents(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert ngram_join.linked(documents(rows).limit(0)).collect() == []


def test_one_document_of_each_group_stays(documents):
    rows = near_copies(9)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(documents(rows + rows[:3])).collect())
    assert kept == sorted({c for _, _, c in brute_components(rows)})


def test_rows_without_or_with_one_id_cost_a_row_each(documents, monkeypatch):
    """Many rows that share an id, or have none, meet by their texts: nothing grows with their product."""
    rows = [(None, f"a{i} b c d e f g h{i % 9} text of its own") for i in range(120)] + [(7, f"q{i // 2} r s t u v w x y z") for i in range(80)]
    seen, keep = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, *a: seen.append(keep(df, *a)) or seen[-1])
    got = [tuple(r) for r in ngram_join.linked(documents(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert all(df.count() <= len(rows) for df in seen if "text" in df.columns)


def test_rows_without_an_id_are_deduplicated(documents):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (4, text.upper()), (5, text), (6, "other words that stand alone in here"), (6, text),
            (None, ""), (None, None), (8, ""), (8, ""), (None, "no id but words of its own"), (None, "no id but words of its own")]
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(documents(rows)).collect()]
    assert sorted(kept, key=repr) == sorted(
        [(4, text.upper()), (6, rows[4][1]), (None, ""), (None, None), (8, ""), (None, "no id but words of its own")], key=repr
    )


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 70, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 7 :], rng.integers(0, 2**63, n // 9, dtype=np.uint64)]))
        for band in set(ngram_join.bands(len(a))) & set(ngram_join.bands(len(b))):
            x, y = set(ngram_join.sketch(a, band).tolist()), set(ngram_join.sketch(b, band).tolist())
            delta = len(np.setxor1d(a, b))
            assert len(x - y) <= delta and len(y - x) <= delta
            assert len(x) > ngram_join.difference(len(a), len(a))
        p, q = ngram_join.parity(a), ngram_join.parity(b)
        assert ngram_join.hamming(p, [q, p, p + p]).tolist() == [ngram_join.hamming(q, [p])[0], 0, ngram_join.hamming(p, [bytes(len(p))])[0]]
        assert ngram_join.hamming(p, [q])[0] <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert ngram_join.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_shingles_are_those_of_the_words():
    texts = [t or "" for _, t in ODD] + ["A b C d E f", "a B c D e F", "a  b\tc\nd\x0be\x0cf", "a b c d e f"]
    for text, own in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(own) == len(word_shingles(text))
    same = shingles.shingle_sets(texts[-4:])
    assert (same[0] == same[1]).all() and (same[0] == same[2]).all() and len(same[3]) == 1


def test_fingerprints_and_edited_texts(documents):
    rows = [(d, t) for d, t in ODD if d is not None and d != 9] + near_copies(2)[:60]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents(rows), k=64).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = word_shingles(text.lower()), word_shingles(other.lower())
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - exact) <= (0.25 if len(a | b) > 64 else 1e-9)
    assert got[6].fingerprint == got[7].fingerprint != got[5].fingerprint
    one = fingerprints.edited_fingerprints(documents([(1, "a b c")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b ca"[:4] + b"a").hexdigest()
    repeated = fingerprints.edited_fingerprints(documents([(9, "x"), (9, "x"), (None, "y"), (None, None)])).collect()
    assert len(repeated) == 4
    assert fingerprints.edited_fingerprints(documents(rows).limit(0)).collect() == []


def test_sketches_merge(spark, documents):
    text = " ".join(f"w{i}" for i in range(900))
    cut = text.index("w450")
    df = spark.createDataFrame([(1, text[: cut + 20], "g"), (2, text[cut:], "g"), (3, text, "h"), (4, None, "i")], "i int, t string, g string")
    parts = fingerprints.with_sketch(df, "t", "s", 128)
    merged = {r.g: r.s for r in fingerprints.merge_groups(parts, ["g"], "s", 128).collect()}
    assert merged["g"] == merged["h"] and "i" not in merged
    a, b, c = (r.s for r in parts.orderBy("i").limit(3).collect())
    two = spark.createDataFrame([(a, b, c)], "a array<bigint>, b array<bigint>, c array<bigint>")
    row = two.select(
        fingerprints.distinct_shingles(F.col("c"), 128).alias("n"),
        fingerprints.containment(F.col("a"), F.col("c"), 128).alias("in"), fingerprints.merge(F.col("a"), F.col("b"), 128).alias("m"),
    ).first()
    assert abs(row.n - 896) < 300 and row["in"] > 0.7 and row.m == c


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 24)) * 10.0 ** rng.integers(-3, 4, size=(900, 1))
    vectors[40:400] = vectors[39]  # a hot vector: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1050, []), (1100, [0.0] * 24), (1150, [float("nan")] * 24), (1200, [1.0] * 23 + [None]), (None, [1.0] * 24),
           (1250, [1e200] * 24), (1300, [1.0, 2.0]), (0, vectors[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([*range(900), 1250])
    x = np.concatenate([vectors, [[1e200] * 24]])
    unit = nearest.scaled(x)
    for i in np.flatnonzero(ids % 50 == 0):
        scores, others = nearest.cosines(np.repeat(x[i][None], len(x), 0), x), ids != ids[i]
        order = np.lexsort((ids[others], -scores[others]))[:5]
        assert [(r, v) for r, v, _ in got[ids[i]]] == list(enumerate(ids[others][order].tolist(), 1))
        assert np.allclose([s for *_, s in got[ids[i]]], (unit[others][order] @ unit[i]), atol=1e-12)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}  # 1300 has no candidate of its length
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = nearest.scaled(rng.normal(size=(50, 1500))), nearest.scaled(rng.normal(size=(60, 1500)))
    ai, ascale, alost, _ = nearest.quantise(a)
    bi, bscale, blost, blen = nearest.quantise(b)
    error = np.abs(a @ b.T - nearest.products(ai, bi) * ascale[:, None] * bscale)
    assert (error <= blost + alost[:, None] * blen).all()
    assert (nearest.products(ai, bi) == ai.astype(int) @ bi.astype(int).T).all()


def test_license_scan_equals_exact_containment(documents):
    rng, scanner = random.Random(3), licenses.Scanner()
    filler, rows = [f"v{i}" for i in range(500)], []
    for i in range(150):
        words = [rng.choice(filler) for _ in range(rng.randrange(60))]
        if i % 2:
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    want = set()
    for doc, text in rows + ODD:
        own, words = licenses.ordered_shingles((text or "").encode().translate(licenses._PLAIN))
        for t, n in enumerate(scanner.sizes):
            windows = [np.unique(own[a : a + 2 * n - 4]) for a in range(0, max(1, words), n)]
            best = max(len(np.intersect1d(w, scanner.sets[t])) / len(scanner.sets[t]) for w in windows)
            if best >= 0.75:
                want.add((doc, licenses.TEMPLATES[t][0], t, best))
    got = {tuple(r)[:4] for r in licenses.scan_licenses(documents(rows + ODD)).collect()}
    assert got == want and len(want) > 30
    assert licenses.scan_licenses(documents([]).limit(0)).collect() == []


def test_license_with_inserted_words_is_found_at_every_start(documents):
    rng, rows = random.Random(5), []
    for _, notice in licenses.TEMPLATES:
        for at in range(0, 45):
            words = notice.split()
            for _ in range(rng.choice([0, 1, 1, 2])):  # at places of their own, as line numbers and comment words are
                place = rng.randrange(1, len(words))
                words[place:place] = [f"i{k}" for k in range(rng.randrange(1, 1 + len(words) // 2))]
            rows.append((len(rows), " ".join([f"a{k}" for k in range(at)] + words + [f"b{k}" for k in range(45 - at)])))
    mit = licenses.TEMPLATES[1][1].split()
    spread = [*mit[:11], *"lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split(), *mit[11:]]
    rows += [(1000 + at, " ".join(["x"] * at + spread)) for at in range(20)]
    scanner, want = licenses.Scanner(), set()
    for doc, text in rows:
        own, words = licenses.ordered_shingles(text.encode().translate(licenses._PLAIN))
        for t, n in enumerate(scanner.sizes):
            best = max(len(np.intersect1d(own[a : a + 3 * n - 4], scanner.sets[t])) for a in range(max(1, words))) / len(scanner.sets[t])
            if best >= 0.75:
                want.add((doc, licenses.TEMPLATES[t][0], t, best))
    got = licenses.scan_licenses(documents(rows)).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert {r.doc_id for r in got if r.doc_id >= 1000} == set(range(1000, 1020))
    assert {(r.first_word, r.window_words) for r in got if r.doc_id == 1007} == {(7, 30)}


def test_license_versions_and_families_are_told_apart(spark, documents, tmp_path):
    later = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public "
             "License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    short = "This work is licensed under the GNU {}General Public License, version {}."
    texts = [(later.format("", "2"), {"GPL-2.0"}), (later.format("", "3"), {"GPL-3.0"}), (later.format("Affero ", "3"), {"AGPL-3.0"}),
             (later.format("Lesser ", "3"), {"LGPL-3.0"}), (later.format("Lesser ", "2.1"), {"LGPL-2.1"}), (later.format("Library ", "2"), {"LGPL-2.0"}),
             (short.format("", "2"), {"GPL-2.0"}), (short.format("", "3"), {"GPL-3.0"}), (short.format("Lesser ", "2"), {"LGPL-2.0"}),
             (short.format("", "4"), set()), (later.format("", "9"), set()),  # a version that nothing lists is not another one
             (later.format("", "2") + " " + later.format("", "3"), {"GPL-2.0", "GPL-3.0"}),
             ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}), ("Licensed under CC BY-NC 3.0.", {"CC-BY-NC-3.0"})]
    texts += [("x y z " + text + " and more words", {name}) for name, text in license_notices.catalogue(licenses.TEMPLATES)]
    documents([(i, text) for i, (text, _) in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(set)
    for r in QUERIES["op3_license_scans"](spark, str(tmp_path)).collect():
        got[r.doc_id].add(r.license)
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]


def test_bands_make_a_miss_rare():
    for template, window in ((1, 6), (8, 20), (30, 64)):
        least = -(-75 * template // 100) / (template + window - (-(-75 * template // 100)))
        assert (1 - least) ** licenses.bands_for(template, window) <= licenses.MISSED


def test_loser_tree_merges_in_order():
    rng = random.Random(8)
    for k in range(12):
        runs = [sorted(rng.choices(range(40), k=rng.randrange(20))) for _ in range(k)]
        assert [v for (v,) in warc.LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(sum(runs, []))


def test_archives_read_back(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://www.b.org/x#top", big), (2, None, big), (3, "http://b.org/x", None), (None, "é b\n", big), (7, "https://a.org:444/?q=1", big),
            (5, "http://b.org/x", "z"), (5, "http://b.org/x", "z"), (8, "u", other), (8, "u", other), (6, "u", other), (10, "", "y" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as payload", "'y' as digest", "1 as at")
    got = warc.archive_and_read(df).collect()
    last = {big: 7, other: 8}
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html in last and page != last[html]
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[html] if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    places = [(warc.url_key(None if r.url == "urn:none" else r.url), r.captured) for r in got if r.url.startswith("http")]
    assert places == sorted(places)
    assert warc.archive_and_read(df.limit(0)).collect() == []


def test_hot_keys_meet_what_is_known_of_them_once(spark, monkeypatch):
    """A key with a third of the rows, null keys, keys that are not known and repeated rows: a plain left join's rows."""
    from warden.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, 8 if i % 3 == 0 else None if i % 7 == 0 else 2 * (i % 11)) for i in range(300)] + [(0, 8)] * 3
    counts = {k: sum(1 for _, x in rows if x == k) for _, k in rows if k is not None and k != 4}
    left = spark.createDataFrame(rows, "doc_id long, set_id long")
    known = spark.createDataFrame([(k, 100 + k, n) for k, n in counts.items()], "set_id long, component long, copies long")
    got = common.met_by_key(left, known, "set_id", "copies")
    assert got.columns == ["doc_id", "set_id", "component"]
    want = [(i, k, 100 + k if k in counts else None) for i, k in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert common.met_by_key(left.limit(0), known.limit(0), "set_id", "copies").collect() == []
