"""Each training-data operator on small tables: edge cases, brute force, round trips."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, takes int, pos int"
LETTERS = ["ba", "no", "ti", "re", "su", "la", "ke", "mo", "vi", "da"]


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randint(30, 120)) for _ in range(40)]
    near = [b.replace(b.split()[10], "zzz", 1) for b in base[:8]]
    lines = ["\n".join(words(rng, 9) for _ in range(4)) for _ in range(10)]
    edited = [x[:20] + "q" + x[20:] for x in lines[:4]]
    odd = ["", None, "   ", "\n\n", "one", "two words", "1234 5678 !!", "é" * 50, words(rng, 3000)]
    return base + base[:5] + near + lines + lines[:3] + edited + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ("en", "fr", None)[k % 3], ("s1", "s2", None)[k % 3], len(t or ""), "x", 9, 9) for k, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", "s1", 1, "x", 9, 9), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(docs):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for r in docs.collect():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").translate(table))
        out.append((r.doc_id, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def test_op1_against_all_pairs(docs, empty):
    from tidemark.llm.ngram_join import deduplicate, ngram_join

    sets = sets_of(docs)
    links = Counter()
    expected = []
    for i, (a, s) in enumerate(sets):
        n = sum(1 for j, (_, u) in enumerate(sets) if i != j and s and u and len(s & u) >= 0.8 * len(s | u))
        expected.append((a, n))
        links[a] += n
    got = ngram_join(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in got) == sorted((-1 if a is None else a, n) for a, n in expected)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    lone = [s for _, s in sets_of(kept) if s]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(lone) for b in lone[:k])
    assert ngram_join(empty).count() == 0 == deduplicate(empty).count()


def test_op1_blocks_agree_with_one_task(docs):
    from tidemark.llm.ngram_join import ngram_join

    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.class_id is None, r.class_id or 0, r.n_links)
    assert sorted(map(key, ngram_join(docs).collect())) == sorted(map(key, ngram_join(docs, task_texts=2, broadcast_rows=0).collect()))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_op2_against_brute_force(spark, texts, empty):
    from tidemark.llm.line_dedup import dedup_lines

    texts = [*texts, "menu about us\nshort x1", "menu about uz\nshort x2", "contact and imprint!!\nmenu about", "contact und imprint!"]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_near int")
    places = [(k, p, x.strip(" ")) for k, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    first = {}
    for k, p, x in places:
        first.setdefault(x, (k, p))
    allow = lambda a, b: min(2, int(max(len(a), len(b)) * 0.1 + 1e-9))
    near = {a for a in first for b in first if a != b and first[b] < first[a] and abs(len(a) - len(b)) <= allow(a, b) and edit_distance(a, b) <= allow(a, b)}
    assert any(len(x) < 20 for x in near) and "menu about" not in near and "short x1" not in near
    gone = {(k, p) for k, p, x in places if x in near or first[x] != (k, p)}
    assert near
    for r in dedup_lines(df, bucket=2).collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (r.doc_id, p) not in gone))
    assert dedup_lines(empty).count() == 0


def test_op2_edit_distance():
    from tidemark.llm.line_dedup import within_edits

    rng = random.Random(3)
    for tau in (1, 2, 3):
        pairs = []
        while len(pairs) < 400:
            a = [rng.randrange(3) for _ in range(rng.randrange(tau + 1, 14))]
            b = [rng.randrange(3) if rng.random() < 0.15 else x for x in a if rng.random() > 0.1]
            if abs(len(a) - len(b)) <= tau and len(b) > tau:
                pairs.append((a, b))
        got = within_edits([np.array(a, np.uint32) for a, _ in pairs], [np.array(b, np.uint32) for _, b in pairs], tau)
        assert got.tolist() == [edit_distance(a, b) <= tau for a, b in pairs]


def test_op3_quotas(docs, empty, texts):
    from tidemark.llm.mixing import mix_sources, mixed, split_quotas, targets

    rows = mix_sources(docs, block_words=300, shard_words=2000).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.takes <= 3
        by.setdefault(r.source, [r.target, 0])[1] += r["size"] * r.takes
    for target, taken in by.values():
        assert abs(taken - target) <= 120
    again = mix_sources(docs, keep=["doc_id", "source"], block_words=300, shard_words=2000)
    assert Counter((r.doc_id, r.takes) for r in rows) == Counter((r.doc_id, r.takes) for r in again.collect())
    assert mixed(docs).count() == sum(r.takes for r in mix_sources(docs).collect())
    leaves = split_quotas(np.array([100, 7, 0, 55]), 6, 1)
    assert leaves.sum(0).tolist() == [100, 7, 0, 55] and leaves.min() >= 0
    assert targets({"a": 10, "b": 100}, {"a": 3, "b": 1}) == {"a": 30.0, "b": 80.0}
    assert mix_sources(empty).count() == 0 == mixed(empty).count()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[100:110] = x[1]
    x[200] *= 50
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0], 0), (905, [], 0), (None, rows[3][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int"), x


def test_op4_recall(spark, vectors):
    from tidemark.llm.ann import nearest

    df, x = vectors
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=5, ef=24, expand=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(math.isclose(s, score[3 if v is None else v], rel_tol=1e-9, abs_tol=1e-9) for _, v, s in found)
        fifth = sorted((s for k, s in enumerate(score) if k != q), reverse=True)[4]
        hits += sum(s >= fifth - 1e-9 for _, _, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert nearest(df.where("vec_id is null"), F.col("vec_id") == 1).count() == 0


def test_op7_against_all_pairs(spark, vectors):
    from tidemark.llm.vector_dedup import link_vectors

    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = (u @ u.T >= 0.9).sum(1) - 1
    like[3] += 1  # the row without an id has the same vector
    got = {r.vec_id: r for r in link_vectors(df, shards=2, block_rows=100).collect()}
    assert len(got) == df.count()
    assert [got[k].n_links for k in range(300)] == like.tolist()
    assert {got[k].component_id for k in range(50, 90)} == {0} and got[100].component_id == 1 and got[1].kept and not got[100].kept
    assert all(got[k].n_links == 0 and got[k].kept and got[k].component_id == k for k in range(900, 906))
    assert link_vectors(df.where("false")).count() == 0


def test_op5_rules(spark, docs, empty):
    from tidemark.llm.licenses import BASE_PHRASES, build_rules, scan_licenses

    cases = [
        "Released UNDER the MIT  License; also cc-by-nc, cc by nc cc by nc", "Apache License, Version 2.0 and apache license version 2", "GNU Lesser General Public License version 2.1 license",
        "SPDX-License-Identifier: MPL-2.0", "nothing", "", None, "Creative Commons Attribution NonCommercial 4.0", "all rights reserved", "café under the mit licensed",
    ]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(cases)], "doc_id int, text string, kept int")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for k, t in enumerate(cases):
        flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", flat)
        places = sorted((i, label) for p, label in BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert got[k].n_words == len(w) and sorted((d.start, d.label) for d in got[k].detections if d.base) == places
        spans = [(d.start, d.end, d.priority) for d in got[k].kept]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] for a in spans for b in spans)
    names = {k: {d.label for d in got[k].kept} for k in got}
    assert names[2] == {"lgpl-2.1"} and names[3] == {"mpl-2"} and names[7] == {"cc-by-nc-4.0"} and names[8] == {"all-rights-reserved"} and names[4] == set()
    assert len(build_rules()) > 200 and scan_licenses(empty).count() == 0 and scan_licenses(docs).count() == docs.count()


def test_op5_alternatives_pass_their_keywords(spark):
    from tidemark.llm.licenses import STEM_PATTERN, build_rules, scan_licenses

    def texts(pattern):
        """Every text of a pattern, digits and bracketed characters by their first."""
        out, at = [""], 0
        options = []
        while at < len(pattern) and pattern[at] != ")":
            if pattern.startswith("(?:", at):
                inner, size = texts(pattern[at + 3 :])
                at += size + 4
            elif pattern[at] == "|":
                options, out, at = options + out, [""], at + 1
                continue
            elif pattern[at] == "[":
                inner, at = [pattern[at + 1]], pattern.index("]", at) + 1
            elif pattern[at] == chr(92):
                inner, at = ["0"], at + 2
            else:
                inner, at = [pattern[at]], at + 1
            if pattern[at : at + 1] == "?":
                inner, at = [*inner, ""], at + 1
            out = [x + y for x in out for y in inner]
        return options + out, at

    gate = re.compile(STEM_PATTERN)
    for rule in build_rules():
        found, size = texts(rule.pattern)
        assert size == len(rule.pattern)
        for text in found:
            assert re.fullmatch(rule.pattern, text), (rule.pattern, text)
            assert any(key in f" {text} " for key in rule.keyword.split("|")), (rule.label, text)
            assert gate.search(f" {text} "), (rule.label, text)
    cases = {"reproduction is strictly prohibited": "no-redistribution", "do what the fuck you want to public license": "wtfpl", "responsible ai license": "openrail"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    assert [{d.label for d in r.kept} for r in scan_licenses(df).orderBy("doc_id").collect()] == [{x} for x in cases.values()]


def test_op6_round_trip(spark):
    from tidemark.llm.warc import read_records, write_bundles

    rng = random.Random(2)
    html = [f"<p>{words(rng, rng.randint(1, 400))}</p>" for _ in range(60)]
    rows = [(k, f"http://x/{k}", h, 1) for k, h in enumerate(html + html[:20])] + [(200, None, None, 1), (201, "u", "", 1), (None, "u", html[0], 1), (205, "u", "é\r\n\r\nx", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, frame int")
    folder, index = write_bundles(df, frame_bytes=2000, bundle_bytes=20_000)
    got = {r.record_id: r for r in read_records(folder, index).collect()}
    first = {}
    for k, _, h, _ in rows:
        if k is not None:
            first.setdefault(h or "", k)
    for k, _, h, _ in rows:
        raw, r = (h or "").encode(), got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        if k is not None:
            assert r.refers_to == (None if first[h or ""] == k else first[h or ""]) and (r.record_type == "revisit") == (r.refers_to is not None)
            assert r.payload == (bytes(raw) if r.record_type == "response" else None)
    picked = read_records(folder, index.where("record_id = 7")).collect()
    assert [r.record_id for r in picked] == [7] and picked[0].payload.decode() == html[7]
    assert read_records(*write_bundles(df.where("false"))).count() == 0
    assert all(r.record_type == "response" for r in read_records(*write_bundles(df, min_payload=10_000)).collect())


def test_op8_paths_agree_and_learn(spark):
    from tidemark.llm.toxicity import score_toxicity

    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        w = words(rng, 60).split()
        if toxic:
            w[5] = w[30] = rng.choice(["vilemark", "foulmark"])
        rows.append((k, " ".join(w), 1.0))
        if k < 300:
            labels.append((k, int(toxic), 1))
    rows += [(900, None, 1.0), (901, "", 1.0), (None, "vilemark foulmark", 1.0)]
    labels += [(5, None, 1), (None, 1, 1), (5, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    learn = F.col("doc_id") % 5 != 2
    got = {r.doc_id: r for r in score_toxicity(docs, known, learn).collect()}
    held = [k for k in range(400) if k >= 300 or k % 5 == 2]
    assert np.mean([(got[k].score >= 0.3) == (k % 4 == 0) for k in held]) > 0.97
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score and len(got) == len(rows)
    joined = {r.doc_id: r for r in score_toxicity(docs, known, learn, table_rows=0, vocabulary_rows=0, label_broadcast_rows=0).collect()}
    assert all(abs(got[k].score - joined[k].score) < 1e-9 and got[k].n == joined[k].n for k in got)
    assert all(0 <= r.score <= 1 for r in score_toxicity(docs, known.where("false"), learn).collect())


def test_op8_rare_expressions_against_brute_force(spark):
    from tidemark.llm.toxicity import score_toxicity

    rng = random.Random(9)
    stock = words(rng, 300).split()  # few enough that no two words' hashes meet
    rows, labels = [], []
    for k in range(600):
        toxic = k % 10 == 0
        w = rng.choices(stock, k=40)
        if toxic:
            w[7], w[21] = f"rare{k // 10 % 20}", f"odd{k // 10 % 20}"  # three texts each, of which two are learnt from at most
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = (F.col("doc_id") / 10).cast("long") < 40
    got = {r.doc_id: r for r in score_toxicity(docs, known, learn).collect()}

    counts = Counter()
    for k, text in rows:
        w = ["<s>", *text.split()]
        if k < 400:
            counts.update((labels[k][1], h, v) for h, v in zip(w, w[1:]))
    pairs = {x[1:] for x in counts}
    said, after, before, met, met_all = Counter(), Counter(), Counter(), Counter(), Counter()
    for (c, h, v), n in counts.items():
        said[c, v] += n
        after[c, h] += n
        met[c, h] += 1
    for h, v in pairs:
        before[v] += 1
        met_all[h] += 1
    size, types = [sum(n for x, n in said.items() if x[0] == c) for c in (0, 1)], [len({x[1] for x in said if x[0] == c}) for c in (0, 1)]

    def chance(c, h, v):
        one = max(said[c, v] - 0.75, 0) / size[c] + 0.75 * types[c] / size[c] * (before[v] or 1) / len(pairs)
        n = after[0, h] + after[1, h]
        pooled = max(counts[0, h, v] + counts[1, h, v] - 0.75, 0) / n + 0.75 * met_all[h] / n * one if n else one
        return max(counts[c, h, v] - 0.75, 0) / after[c, h] + 0.75 * met[c, h] / after[c, h] * pooled if after[c, h] else pooled

    for k, text in rows:
        w = ["<s>", *text.split()]
        ratio = sum(math.log(chance(1, h, v) / chance(0, h, v)) for h, v in zip(w, w[1:]))
        assert abs(got[k].llr - ratio) < 1e-5 * max(1, abs(ratio))
    held = [(got[k].score, labels[k][1]) for k in range(400, 600)]
    marked, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in marked for b in clean]) > 0.9


def test_op9_plan_is_best_fit_decreasing():
    from tidemark.llm.packing import plan_packing

    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = min((k for k, left in enumerate(bins) if left >= n), key=lambda k: bins[k], default=None)
            if fit is None:
                bins.append(cap - n)
            else:
                bins[fit] -= n
        used = {}
        for n, _, count, first, offset in plan_packing(Counter(lengths), cap):
            for k in range(first, first + count):
                used.setdefault(k, []).append((offset, n))
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
        assert sorted(cap - sum(n for _, n in p) for p in used.values()) == sorted(bins)


def test_op9_pieces(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm.packing import FastBytePairs, best_fit_pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = FastBytePairs(path)
    rng = random.Random(1)
    odd = ["".join(rng.choice(" ab1,.\n\t é2²½ª'x中ʰ̀ \x85\x1c") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["don't  stop\n\n\n x", "<|endoftext|>", "a <|endoftext|> b"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)  # as the library has it, nothing set
    assert [x.tolist() for x in encoder.encode(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]
    rows = best_fit_pack(docs, path, capacity=256).collect()
    by = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length <= 256
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 0)}
    for k, t in text.items():
        ids = [*encoder.slow.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r.piece, r.start, r.ids) for r in rows if r.doc_id == k)
        assert b"".join(x for _, _, x in mine) == np.array(ids, "<u4").tobytes() and [len(x) // 4 for _, _, x in mine[1:]] == [256] * (len(mine) - 1)
    assert best_fit_pack(empty, path).count() == 0


def test_op10_languages(spark, empty):
    from tidemark.llm.langid import UNKNOWN, fit, identify

    rng = random.Random(5)
    parts = {"aa": ["ka", "to", "mi"], "bb": ["el", "ur", "zo"], "cc": ["sch", "ung", "ei"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang if k % 2 else None, 0.5, lang) for k in range(300) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(900, None, "aa", 0.5, ""), (901, "12 !!", "aa", 0.5, ""), (902, "", None, 0.5, ""), (None, "katomi katomi", None, 0.5, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, truth string")
    got = identify(df, fit(df, per_language=40)).collect()
    assert all(r.lang_pred == (r.truth or UNKNOWN) and 0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert all(r.lang_pred == UNKNOWN for r in identify(df, fit(df.where("false"))).collect())
    assert identify(empty, fit(df)).count() == 0


def test_components(spark):
    from tidemark.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[150] == got[200] == 100 and got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    from tidemark.llm.textcore import shingles, slices, word_hashes

    column = pa.array(["One two", None, "", "two ONE", "é one"])
    h, bounds = word_hashes(column)
    assert bounds.tolist() == [0, 2, 2, 2, 4, 6] and h[0] == h[3] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 3
    grams, edges = shingles(h, bounds, 5)
    assert edges.tolist() == [0, 1, 1, 1, 2, 3] and len(set(grams.tolist())) == 3
    assert slices(column, 8) == [(0, 4), (4, 5)] or sum(b - a for a, b in slices(column, 8)) == 5


def test_pipeline_stages(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tidemark.llm.shared import materialize

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, ""), name)
        assert now.columns == columns, name
        assert now.count() > 20
    assert all(any(c.isalpha() for c in r.text) for r in now.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_columns_may_have_any_name(spark):
    """Every operator carries columns along whose names its own working columns might have."""
    from tidemark.llm.langid import fit, identify
    from tidemark.llm.licenses import scan_licenses
    from tidemark.llm.line_dedup import dedup_lines
    from tidemark.llm.mixing import mix_sources, mixed
    from tidemark.llm.ngram_join import deduplicate
    from tidemark.llm.toxicity import score_toxicity

    odd = ["exact", "near", "_id", "_mark", "_m", "_n", "_l", "_d", "_key", "_size", "_sid", "_h", "_block", "_lower", "_text", "_words", "_row", "_doc", "_draw", "a", "b",
           "mark", "lid", "words", "base", "n", "strong", "key", "label", "cell", "_own", "_mine", "_all"]
    rows = [(k, f"some words of text number {k} under the mit license\nand a line", "en", "s", *[f"{c}{k}" for c in odd]) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in odd))
    known = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    for got in (
        deduplicate(docs), dedup_lines(docs), mix_sources(docs), mixed(docs), scan_licenses(docs), identify(docs, fit(docs)),
        score_toxicity(docs, known, F.lit(True), keep=[c for c in docs.columns if c not in ("n", "strong")]),
        score_toxicity(docs, known, F.lit(True), keep=[c for c in docs.columns if c not in ("n", "strong")], table_rows=0),
    ):
        for r in got.collect():
            for c in odd:
                if c not in ("n", "strong"):
                    assert r[c] == f"{c}{r.doc_id}"


def test_vector_and_score_operators_on_empty_tables_ties_and_repeats(spark):
    from tidemark.llm.ann import nearest
    from tidemark.llm.langid import fit, identify
    from tidemark.llm.toxicity import score_toxicity

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    rows = [(k, [1.0, 0.0]) for k in range(5)] + [(5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    docs = spark.createDataFrame([(1, "one two", "en")] * 3 + [(2, "uno dos", "es"), (None, "one two", None)], "doc_id long, text string, lang string")
    said = identify(docs, fit(docs)).where("text = 'one two'").select("lang_pred", "score").distinct().collect()
    assert len(said) == 1 and said[0].lang_pred == "en"
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len(score_toxicity(docs, known, F.lit(True)).where("text = 'one two'").select("score").distinct().collect()) == 1


def test_op10_tells_very_long_texts_apart(spark):
    from tidemark.llm.langid import fit, identify

    rng = random.Random(8)
    stocks = {c: [words(rng, 1) + c for _ in range(40)] for c in "xy"}
    rows = [(k, " ".join(rng.choices(stocks["xy"[k % 2]], k=40)), "xy"[k % 2]) for k in range(60)]
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(9)) for _ in range(60_000)]
    long = [(100 + k, " ".join(w for x in noise for w in (x, rng.choice(stocks[c]))), c) for k, c in enumerate("xy")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = identify(spark.createDataFrame(long, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_op3_deal_against_a_plain_one(spark):
    """The tree's leaves, dealt by the executors, are the tree's leaves; and each shard's draws are whole blocks once a pass."""
    from tidemark.llm.mixing import shard_ranges, split_quotas, subtrees

    quotas = np.array([500, 0, 37, 1200])
    whole = split_quotas(quotas, 41, 3)
    assert (whole.sum(axis=0) == quotas).all() and (whole >= 0).all()
    at, dealt = np.zeros(4, int), np.zeros_like(whole)
    for lo, hi, left in subtrees(0, 41, quotas, 3, 7):
        import pandas as pd

        for pdf in shard_ranges([pd.DataFrame([(lo, hi, left.tolist(), at.tolist())])], 3):
            for sid, shard, a, b in pdf.itertuples(index=False):
                dealt[shard, sid] += b - a
        at = at + left
    assert (dealt == whole).all()


def test_span_hashes_beyond_the_kept_powers():
    from tidemark.llm import textcore

    points = np.arange(2 * textcore.KEPT + 10, dtype=np.uint32) % 7
    starts = np.array([0, 7, 2 * textcore.KEPT - 2 * textcore.KEPT % 7])
    assert len(set(textcore.span_hash(textcore.prefix_hash(points), starts, starts + 5).tolist())) == 1
    up, down = textcore.powers(2 * textcore.KEPT)
    assert (up * down == 1).all() and all(len(kept) == textcore.KEPT for kept in textcore._powers.values())
