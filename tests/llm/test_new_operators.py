"""Prefix trie, collocations and language identification against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import collocations, decontaminate, language_id, prefix_trie, toxicity

# 11 prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, block long, p string"


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, who in members.items():
        at_end = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(at_end.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def found_trie(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS).repartition(parts)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.trie(frame).select(*columns).collect()), key=repr)


def chats(seed, n, longest, kinds):
    rng = np.random.default_rng(seed)
    return [(int(c), t, "user" if t % 2 else "bot", f"é{rng.integers(kinds)}") for c in range(n) for t in range(rng.integers(0, longest))]


ODD = [
    (0, None, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "a", ""), (0, 2, "b", None),  # null turn, ties, a repeated row
    (3, 5, "a", "y" * 5000), (4, 0, "", ""), (None, 0, "a", "x"), (7, 0, "a", "x"), (7, 9, "a", "z"), (23, 1, "a", "x"), (5, 0, "a", "x"),
]


@pytest.mark.parametrize("rows", [ODD, chats(1, 40, 7, 2), chats(2, 30, 30, 2), chats(3, 25, 3, 1)], ids=["odd", "short", "blocks", "equal"])
def test_trie_is_the_plain_one(spark, rows):
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_hot_conversation_in_many_parts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 4)
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 2)
    rows = [(2, t, "u", f"{t % 3}") for t in range(700)] + [(c, t, "u", f"{t % 3}") for c in (0, 1, 5, 8) for t in range(150)] + [(c, 0, "u", "0") for c in range(10, 40)]
    assert found_trie(spark, rows, 5) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], CONVERSATIONS)).collect() == []


# 12 collocations

DOCUMENTS = "doc_id long, text string, lang string, source string, chunk long, place int, words string"


def plain_collocations(rows, longest=3, least=10, inside=50, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, b in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= inside * f[q[i : i + m]]}
        kept = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found_collocations(spark, rows, parts=3, **given):
    frame = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], DOCUMENTS).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(frame, **given).collect())


def babble(seed, n, kinds, most=40):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", " ", "\t ", ", ", ".", "\n", " ? "]
    made = []
    for i in range(n):
        words = rng.zipf(1.3, rng.integers(0, most)) % kinds
        made.append((i, "".join(f"W{w}é{rng.choice(marks)}" for w in words), str(rng.choice(["en", "fr", "und"]))))
    return made


STRANGE = [(1, None, "en"), (2, "", None), (3, " \t\n.,", "en"), (None, "a b c " * 30, None), (5, "A b c\x00 d " * 20, "und"), (5, "A b c\x00 d " * 20, "und"), (6, "x " * 50, "en")]


@pytest.mark.parametrize("rows", [STRANGE, babble(1, 120, 12), babble(2, 60, 4), STRANGE + babble(3, 200, 40)], ids=["strange", "some", "few", "many"])
def test_collocations_are_the_plain_ones(spark, rows):
    assert found_collocations(spark, rows) == plain_collocations(rows)


def test_collocations_over_many_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 30)
    monkeypatch.setattr(collocations, "SLICE", 40)
    rows = babble(4, 150, 10) + [(500, "a b c d " * 300, "en")]
    found = list(collocations._slices(b"ab cd\nef" * 30))
    assert b"".join(found) == b"ab cd\nef" * 30 and len(found) > 3
    assert found_collocations(spark, rows, 2, top=5, longest=4) == plain_collocations(rows, top=5, longest=4)


def test_collocations_meet_no_rows_that_grow_with_a_chunk(spark):
    rng = np.random.default_rng(9)
    rows = [(1, " ".join(f"w{i}" for i in rng.integers(0, 20_000, 80_000)), "en"), (2, "a b c. " * 3000, "fr")]
    frame = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], DOCUMENTS).coalesce(1)
    relation = collocations.occurrences(frame)
    found = collocations.frequent(relation, ["lang", "words"], ["words"], 2)
    for table, names in ((relation, "words"), (collocations.extended(relation, found), "first")):
        size, most, kinds, rows_of = table.selectExpr(f"max(size({names}))", "max(size(ids))", f"sum(size({names}))", "count(*)").first()
        assert size <= collocations.PHRASES and most <= collocations.OCCURRENCES
        assert kinds > 2 * collocations.PHRASES and rows_of > 4  # so it was cut
    assert found_collocations(spark, rows, 1, least=2, top=500) == plain_collocations(rows, least=2, top=500)


def test_a_chunk_grows_alike_however_its_rows_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    chunks = {number: (np.where(rng.random(400) < 0.1, -1, rng.integers(0, 30, 400)).astype(np.int32), rng.permutation(30)[:20].astype(np.int32)) for number in (5, 9, 1 << 40)}
    chunks[11] = (np.array([0, 1, 0, 1], np.int32), np.array([], np.int32))

    def grown(cut):
        for name, value in (("PHRASES", cut), ("OCCURRENCES", 2 * cut), ("ROWS", 3), ("PACK", 25)):
            monkeypatch.setattr(collocations, name, value)
        entries = [(n, int(p), n + int(p)) for n, (_, places) in chunks.items() for p in places]
        entries = [entries[i] for i in rng.permutation(len(entries))]
        flat = [pa.RecordBatch.from_pylist([dict(zip(("chunk", "place", "name"), e, strict=True)) for e in entries[i : i + 10]]) for i in range(0, len(entries), 10)]
        rows = [r for b in collocations._packed(iter(flat)) for r in b.to_pylist()]
        assert sorted((r["chunk"], p, n) for r in rows for p, n in zip(r["places"], r["names"], strict=True)) == sorted(entries)
        for n, (ids, _) in chunks.items():
            rows += [{"chunk": n, "at": i, "ids": ids[i : i + cut].tolist()} for i in range(0, len(ids), cut)]
        rows.sort(key=lambda r: (r["chunk"], "at" not in r, r.get("at", 0)))
        kind = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("ids", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("names", pa.list_(pa.int64()))])
        out = [r for b in collocations._extend(iter([pa.RecordBatch.from_pylist(rows[i : i + 4], kind) for i in range(0, len(rows), 4)])) for r in b.to_pylist()]
        assert all(len(r["counts"] or []) <= cut and len(r["ids"] or []) <= 2 * cut for r in out)
        return {n: {c: [x for r in out if r["chunk"] == n for x in r[c] or []] for c in ("ids", "counts", "first", "rest")} for n in chunks}

    whole = grown(1000)
    assert grown(7) == whole and all(whole[n]["counts"] for n in (5, 9, 1 << 40)) and not whole[11]["ids"]
    for n, (ids, places) in chunks.items():
        here = set(places.tolist())
        want = Counter((n + a, n + b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True) if a in here and b in here)
        assert dict(zip(zip(whole[n]["first"], whole[n]["rest"], strict=True), whole[n]["counts"], strict=True)) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_products_beyond_64_bits_are_exact(spark):
    a = 3_000_000_007
    level = spark.createDataFrame([("n", "en", "x y", a, [7 * a, a], [5 * a, a])], "name string, lang string, phrase string, a long, heads array<long>, tails array<long>")
    got = collocations._scored(level, 2).first()
    assert got["score"] == 1_000_000 * a * a // (35 * a * a) and (got["l"], got["r"]) == (7 * a, 5 * a)


# 13 language identification

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèàüöß"}


def speech(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(ALPHABETS[lang] + "xyz"), rng.integers(2, 8))) for _ in range(n))


def plain_grams(text):
    letters = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


@pytest.mark.parametrize("text", ["a", "Ab, c1d -- É中文😀 x", "  ..  ", "word " * 40, "İstanbul ½ ²a"])
def test_grams_are_the_plain_ones(text, monkeypatch):
    packed = set()
    for g in plain_grams(text):
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        packed.add(n)
    assert set(language_id.grams(text).tolist()) == packed
    if text.isascii():
        monkeypatch.setattr(language_id, "SLICE", 3)
        assert set(language_id.grams(text).tolist()) == packed


def test_kernel_and_folded_scores_are_the_plain_ones():
    texts = [speech(lang, 10 * i + k, 12) for k, lang in enumerate(ALPHABETS) for i in range(8)]
    langs = [lang for lang in ALPHABETS for _ in range(8)]
    found = [language_id.grams(t) for t in texts]
    sets = [plain_grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(language_id.kernel(found, found), want, atol=1e-6)
    # With all rows as landmarks the Nystrom approximation is exact: ridge regression in the kernel's own feature space.
    model = language_id.Model.fit(found, [len(t) for t in texts], langs)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "CELLS", 100)
        assert np.allclose(language_id.kernel(found, found), want, atol=1e-6)
    y = np.array([[1.0 if lang == name else -1.0 for name in ALPHABETS] for lang in langs])
    centre = np.eye(24) - 1 / 24
    dual = np.linalg.solve(centre @ want @ centre + 24 * language_id.RIDGE * np.eye(24), y - y.mean(axis=0))
    fitted = centre @ want @ centre @ dual + y.mean(axis=0)
    assert np.allclose(model.scores(texts), fitted, atol=2e-3)
    again = language_id.Model.unpack(model.pack())
    assert again.langs == model.langs and np.array_equal(again.weights, model.weights)


def test_languages_of_held_out_rows(spark):
    rows = [(i, speech(lang, i), lang) for i in range(240) for lang in [list(ALPHABETS)[i % 3]]]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (None, speech("bb", 7), "bb"), (3, speech("cc", 9), "aa"), (3, speech("cc", 9), "aa"), (1004, speech("aa", 3, 60_000), None), (1005, "é", "cc")]
    frame = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows + odd], DOCUMENTS).repartition(3)
    model = language_id.train(frame)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(frame, model).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for *_, s in got)
    by_id = defaultdict(list)
    for i, lang, _ in got:
        by_id[i].append(lang)
    unseen = [i for i in range(240) if i != 3 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(unseen) > 30 and all(by_id[i] == [list(ALPHABETS)[i % 3]] for i in unseen)
    assert by_id[1000] == by_id[1001] == by_id[1002] == ["und"] and by_id[None] == ["bb"] and by_id[1004] == ["aa"]
    assert language_id.predict(frame.limit(0), model).collect() == []


def test_languages_are_learnt_from_texts_and_labels_alone(spark):
    rows = [(i, speech(lang, i), lang) for i in range(120) for lang in [list(ALPHABETS)[i % 3]]]
    frame = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], DOCUMENTS)
    hidden = frame.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    model, other = language_id.train(frame), language_id.train(hidden)
    assert other.langs == model.langs and np.array_equal(other.weights, model.weights)


def test_no_language_is_learnt_from_nothing(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    model = language_id.train(empty)
    rows = spark.createDataFrame([(1, "some text", "en", "s", 1, 2, "x")], DOCUMENTS)
    assert [tuple(r) for r in language_id.predict(rows, model).collect()] == [(1, "und", 0.0)]


def test_landmarks_take_turns():
    langs, lengths = ["a", "a", "a", "b", "b"], [10, language_id.LANDMARK_CHARS + 1, 5, language_id.LANDMARK_CHARS + 1, language_id.LANDMARK_CHARS + 2]
    assert language_id.landmarks_of(langs, lengths) == [0, 3, 2] and language_id.landmarks_of(langs, lengths, 2) == [0, 3]


# 8 toxicity: evidence of pairs


def test_pair_evidence_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    rng = np.random.default_rng(3)
    ids = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(300)] + [np.zeros(0, np.int64)]
    labels = np.array([float({2, 5} <= set(r.tolist()) or {7, 9, 11} <= set(r.tolist())) for r in ids])
    expected = rng.random(301) * 0.2
    buckets = np.arange(30)
    want = np.zeros(30, bool)
    for a in range(30):
        for b in range(a):
            both = [k for k, r in enumerate(ids) if a in r and b in r]
            total, spread = sum(labels[k] - expected[k] for k in both), sum(expected[k] * (1 - expected[k]) for k in both)
            if abs(total) >= toxicity.Z_PAIR * max(spread, 1) ** 0.5:
                want[[a, b]] = True
    assert want.any() and not want.all()
    assert toxicity.paired_evidence(ids, labels, expected, buckets).tolist() == want.tolist()
    may = toxicity.may_pair(ids, labels, expected, buckets)
    assert not (want & ~may).any()
    assert buckets[may][toxicity.paired_evidence(ids, labels, expected, buckets[may])].tolist() == buckets[want].tolist()


def test_a_rare_pair_is_learnt():
    """Two words in 2.5 % of the texts each, alone never toxic, together always, in 16 texts."""
    rng = np.random.default_rng(0)
    held = np.zeros((8000, 2), bool)
    rows = rng.permutation(8000)
    held[rows[:16]] = True
    held[rows[16:200], 0] = held[rows[200:384], 1] = True
    fill = rng.integers(0, 400, (8000, 30))
    texts = [b" ".join([b"w%d" % w for w in line] + [b"foo"] * int(a) + [b"bar"] * int(b)) for line, (a, b) in zip(fill, held, strict=True)]
    ids = [np.array(sorted({b for w in toxicity.distinct_words(t) for b in toxicity.terms_of(w)})) for t in texts]
    model = toxicity.learn(ids, held.all(axis=1).astype(float))
    assert model.score(b"foo bar w1 w2 w3") > 0.5 > 0.05 > max(model.score(b"foo w1 w2"), model.score(b"bar w1"), model.score(b"w1 w2"))


def test_toxicity_of_repeated_ids_and_odd_labels(spark):
    rows = [(i, "bad" if i % 2 else "good", "en", "s", 1, 2, "x") for i in range(200)] * 2
    labels = [(i, i % 2) for i in range(200)] + [(1, 0), (1, None), (None, 1)]
    frame, known = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, toxicity.train(frame, known)).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 1) for i in got)


# 9 decontamination: blocks of the benchmark


@pytest.mark.parametrize("block_bytes", [200, 1000])
def test_blocks_hold_equal_texts_once_and_cut_long_ones(spark, block_bytes):
    long = " ".join(f"w{i}" for i in range(400))
    equal = " ".join(f"v{i}" for i in range(20))
    items = [(f"same{i}", equal) for i in range(500)] + [("long", long), ("short", "only four words here"), (None, "x " * 14), ("none", None), ("blank", " ")]
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    rows = [(1, f"a {equal} b", "en"), (2, " ".join(f"w{i}" for i in range(95, 130)), "en"), (3, "so only four words here end", "en"), (4, "x " * 20, "en"), (5, None, "en"), (6, "w1 w2 w3", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], DOCUMENTS)

    def found(limit):
        return sorted((r["_row"]["doc_id"], r["_n_words"], tuple(r["_items"]), tuple(map(tuple, r["_spans"]))) for r in decontaminate.find_spans(docs, bench, block_bytes=limit).collect())

    assert found(block_bytes) == found(1 << 20)
    plain = bench.select(F.col("item_id").alias("item"), "text")
    _, blocks = decontaminate._blocks(plain, 14_000, 13, block_bytes)
    sizes = blocks.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    assert len(sizes) > 1 and max(r["size"] for r in sizes) <= block_bytes
