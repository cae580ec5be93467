"""Operators on texts against brute force on small tables, and their awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import ROWS, documents, empty
from pyspark.sql import functions as F

from sortdesk.llm import (decontamination, licences, near_duplicates, pieces, pseudonyms, repeats,
                          sharding, toxicity)
from sortdesk.llm.queries import PIECE_MODEL

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def noisy(seed, n, size, vocabulary=("a", "b", "c", "dd", "eé")):
    """Texts of few words that share many runs."""
    rng = random.Random(seed)
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        kind = rng.random()
        text = list(base)
        if kind < 0.6:
            for _ in range(rng.randint(0, size // 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary) + str(rng.randrange(9))
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.randint(0, size))]
        out.append(" ".join(text))
    return out


# sketches and near duplicates

def jaccard_components(rows, k, percent):
    def shingles(text):
        w = words(lower(text))
        return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_all_pairs(spark, k):
    texts = noisy(1, 60, 40) + noisy(2, 60, 80, tuple("abcdefghijklmnop")) + ["", " ", "x", "X"]
    rows = list(enumerate(texts))
    found = near_duplicates.near_duplicates(documents(spark, rows), shingle=k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == jaccard_components(rows, k, 80)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 5)
    rows = list(enumerate(noisy(3, 120, 60, tuple("abcdefghijklmnopqrstuvw"))))
    found = near_duplicates.near_duplicates(documents(spark, rows), shingle=2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == jaccard_components(rows, 2, 80)


def test_near_duplicates_of_awkward_rows(spark):
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in
                  near_duplicates.near_duplicates(documents(spark), shingle=2).collect())
    assert sum(got.values()) == len(ROWS)
    assert got[1, True, 1, True] == 1 and got[2, True, 1, False] == 2
    assert got[3, False, 3, True] == got[4, False, 4, True] == got[5, False, 5, True] == 1
    assert got[None, True, None, True] == got[None, False, None, True] == 1
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (7, "a b c d e f"), (9, "q r s t u v")]
    got = near_duplicates.near_duplicates(documents(spark, rows), shingle=2)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 5), (7, 5), (9, 5)}


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, 40, 900])
    row = np.repeat(np.arange(4), sizes)
    sketch = near_duplicates.sketches(row, rng.integers(1, 1 << 62, sizes.sum()).astype(np.uint64),
                                      sizes)
    assert (sketch != near_duplicates._EMPTY).all()
    a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(1, 1 << 62, 60).astype(np.uint64)])
    pair = near_duplicates.sketches(np.repeat([0, 1], 300), np.concatenate([a, b]),
                                    np.array([300, 300]))
    assert abs((pair[0] == pair[1]).mean() - 240 / 360) < 0.15


# repeated passages

def without_repeats(rows, window):
    """Rows in order of id; equal places are not earlier than each other."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats_match_brute_force(spark, seed):
    texts = noisy(seed, 50, 90, ("a", "b", "A")) + noisy(seed + 9, 50, 70, tuple("abcdefgh"))
    texts += ["z y " * 60, " ".join(texts[:3])]
    rows = list(enumerate(texts))
    got = repeats.without_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == without_repeats(rows, 20)


def test_repeats_of_awkward_rows(spark):
    got = repeats.without_repeats(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[3][0].n_words == 0 and by_id[3][0].kept == ""
    assert by_id[2][0] == by_id[2][1]
    assert by_id[7][0].kept == ROWS[9][1]
    long = by_id[8][0]
    assert (long.n_words, long.n_removed) == without_repeats([(8, ROWS[10][1])], 20)[0][1:3]
    assert repeats.without_repeats(empty(spark)).count() == 0


# benchmark passages

def contamination(texts, items, window):
    found = {}
    for name, t in items:
        w = re.findall(decontamination.WORD, lower(t))
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            found.setdefault(tuple(w[s:s + size]), set()).add(str(name))
    out = []
    for t in texts:
        w = re.findall(decontamination.WORD, lower(t))
        hit, names = set(), set()
        for size in {len(k) for k in found}:
            for s in range(len(w) - size + 1):
                got = found.get(tuple(w[s:s + size]))
                if got:
                    names |= got
                    hit |= set(range(s, s + size))
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("waves", [False, True])
def test_contamination_matches_brute_force(spark, monkeypatch, waves):
    if waves:
        monkeypatch.setattr(decontamination, "WAVE_BYTES", 300)
        monkeypatch.setattr(decontamination, "PIECE_WORDS", 14)
    texts = noisy(6, 60, 50, ("a", "b", "c")) + ["", "Q.r-s"]
    items = list(enumerate(noisy(7, 8, 30, ("a", "b", "c")) + [texts[3], "a b c a", "q R s", "", None]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(documents(spark, list(enumerate(texts))), bench)
    mark = got.columns[-1]
    rows = got.orderBy("doc_id").select("doc_id", F.col(mark).alias("m")).collect()
    assert [(r.m.n_words, r.m.n_hit, r.m["items"]) for r in rows] == contamination(texts, items, 10)
    for r, t in zip(rows, texts):
        assert sum(s.end - s.start for s in r.m.spans) == r.m.n_hit


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")
    rows = [(1, f"Before, {item.upper()}! after and quite a lot more of it"), (2, item), (3, None), (4, "x")]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(documents(spark, rows), bench).collect()}
    assert got == {1: "Before, ! after and quite a lot more of it", 3: None, 4: "x"}
    assert decontamination.decontaminate(documents(spark), bench).count() == len(ROWS)
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(documents(spark), none).count() == len(ROWS)


# pieces

def test_pieces_match_the_library(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(8)
    signs = ["a", "b", "th", "er", "ing", " ", "  ", "\n", "é", "ß", "▁", "😀", "0", "<s>", "\x00",
             "漢", "aaaa", "'s", "́", ",", ".", "|", "\t", "</s>", "the "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(texts)]
    got = pieces.encode_pieces(documents(spark, rows), PIECE_MODEL)
    result = got.columns[-1]
    for r in got.select("text", F.col(result).alias("p")).collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.p.ids == ids and r.p.n_tokens == len(ids)
        assert r.p.decoded == library.decode(ids)
        assert r.p.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.p.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(empty(spark), PIECE_MODEL).count() == 0


def test_walk_steps_back_where_the_longest_piece_does_not_fit():
    p = pieces.Pieces(PIECE_MODEL)
    rng = random.Random(9)
    stepped = 0
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 14)))
        greedy = [x for _, x in p.longest.iter_long(word)]
        merged = [p.ids[x] for x in p.merge(word)]
        assert p.split(word) == merged
        stepped += greedy != merged
    assert stepped > 100


# shards

def test_shards_hold_every_row_once_in_balance(spark):
    rows = [(i % 40 if i % 3 else None, "same" if i % 2 else f"text {i}") for i in range(500)]
    docs = documents(spark, rows).repartition(4)
    got = sharding.shuffled_shards(docs, shards=7, bucket_bytes=200)
    shard, slot = got.columns[-2:]
    assert (shard, slot) == ("shard_", "slot_")
    out = got.select("doc_id", "text", F.col(shard).alias("s"), F.col(slot).alias("p")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    sizes = Counter(r.s for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s in sizes:
        assert sorted(r.p for r in out if r.s == s) == list(range(sizes[s]))


def test_shards_are_stable_shuffled_and_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    runs = [sorted(map(tuple, sharding.shuffled_shards(docs, 4, bucket_bytes=4096).select(
        "doc_id", "shard", "slot").collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    placed = [i for i, s, p in sorted(runs[0], key=lambda r: r[1:])]
    assert placed != sorted(placed)
    sharding.write_shards(sharding.shuffled_shards(docs, 4), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_both_passes_agree_when_the_scan_is_planned_anew(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text")
                             ).repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    got = sharding.shuffled_shards(docs, 4, bucket_bytes=4096)
    try:
        for n, v in zip(names, ("3k", "1")):
            spark.conf.set(n, v)
        out = got.select("doc_id", "shard", "slot").collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sorted(r.doc_id for r in out) == list(range(3000))
    assert sorted((r.shard, r.slot) for r in out) == [(s, p) for s in range(4) for p in range(750)]


def test_shards_of_awkward_rows(spark):
    assert sharding.shuffled_shards(documents(spark)).count() == len(ROWS)
    assert sharding.shuffled_shards(empty(spark)).count() == 0
    sizes = documents(spark).select("text", sharding.text_bytes("text").alias("b"), F.crc32("text"))
    for text, size, crc in sizes.collect():
        assert size == len((text or "").encode()) + 1
        assert crc == (None if text is None else zlib.crc32(text.encode()))


# pseudonyms

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    text = ("pay 4785380592391139, again 4785-3805-9239-1139; not 4785380592391138. "
            "call +1 (743) 555-3824 or a.b-C9@mail5.example.com from 70.23.22.57, not 999.1.1.1, "
            "born 2024-02-29, 31/12/1999, 12/31/1999, 01.02.2003, not 2023-02-29; 123-45-6789 not 000-12-1234; "
            'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
    rows = [(1, text), (2, text), (3, "x4785380592391139 version 1.2.3 and 12345"), (4, None)]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(documents(spark, rows, extra=False), "k").collect()}
    new = got[1].text
    assert new == got[2].text
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", t)))
    address = r"from [\d.]+,"
    assert shape(re.sub(address, "", new.split("token")[0])) == shape(
        re.sub(address, "", text.split("token")[0]))
    first, second = re.search(r"pay (\d+), again ([\d-]+)", new).groups()
    assert first == second.replace("-", "") != "4785380592391139" and luhn(first)
    for kept in ("4785380592391138", "999.1.1.1", "2023-02-29", "000-12-1234", "+1 (", "@mail5.example.com"):
        assert kept in new
    for gone in ("555-3824", "a.b-C9", "70.23.22.57", "2024-02-29", "31/12/1999", "12/31/1999",
                 "123-45-6789", "24be64439e"):
        assert gone not in new
    assert got[3].text == rows[2][1] and got[4].text is None
    assert got[1].pseudonyms.n_replaced == 11
    other = pseudonyms.pseudonymise(documents(spark, rows[:1], extra=False), "other").first().text
    assert other != new


def test_pseudonyms_of_values_in_parentheses_and_of_iso_times(spark):
    values = ["1980-01-02", "31/12/1999", "01.02.2003", "70.23.22.57", "123-45-6789", "4785380592391139",
              "4785-3805-9239-1139", "+1 743 555 3824", "+1 (743) 555-3824", "(743) 555-3824",
              "a.b-C9@mail5.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    rows = [(i, f"see ({v}), or ( {v} )") for i, v in enumerate(values)]
    times = ["2024-01-31T10:00", "2024-01-31T10:00:05Z", "(2024-01-31T10)", "2024-01-31T1000"]
    rows += [(100 + i, t) for i, t in enumerate(times)]
    kept = ["2024-01-31Tuesday", "(2024-01-31x)", "f(12345)", "x(1.2.3)"]
    rows += [(200 + i, t) for i, t in enumerate(kept)]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(documents(spark, rows, extra=False), "k").collect()}
    for i, v in enumerate(values):
        new = re.fullmatch(r"see \((.*)\), or \( (.*) \)", got[i].text)
        assert got[i].pseudonyms.n_replaced == 2 and v not in got[i].text and new[1] == new[2]
    for i, t in enumerate(times):
        assert "2024-01-31" not in got[100 + i].text and got[100 + i].text.split("T")[1] == t.split("T")[1]
    for i, t in enumerate(kept):
        assert got[200 + i].text == t


def test_pseudonyms_are_one_to_one(spark):
    days = spark.range(0, 36525, 7).select(F.expr(
        "cast(date_add(date'1930-01-01', cast(id as int)) as string)").alias("v"))
    moved = days.select(pseudonyms.pseudonym(F.col("v"), "k").alias("p"))
    assert moved.distinct().count() == moved.count()
    assert moved.where("try_to_date(p) between date'1930-01-01' and date'2029-12-31'").count() == moved.count()
    areas = spark.range(1, 900).where("id <> 666").select(F.format_string("%03d-01-0001", "id").alias("v"))
    moved = areas.select(pseudonyms.pseudonym(F.col("v"), "k").alias("p"))
    assert moved.where(pseudonyms.is_ssn(F.col("p"))).distinct().count() == 898
    boxes = spark.range(100).select(F.format_string("a%02d@b.example", "id").alias("v"))
    assert boxes.select(pseudonyms.pseudonym(F.col("v"), "k")).distinct().count() == 100


def test_pseudonyms_of_awkward_rows(spark):
    got = pseudonyms.pseudonymise(documents(spark), "k")
    assert got.columns[-1] == "pseudonyms_" and got.count() == len(ROWS)
    assert pseudonyms.pseudonymise(empty(spark), "k").count() == 0


# toxicity

def test_chain_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    fitted = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs, *fitted).select("doc_id", "toxicity.rejected").join(
        labels.where(held), "doc_id")
    hits, false, missed = got.agg(*[F.count_if(F.expr(c)) for c in (
        "rejected and toxic = 1", "rejected and toxic = 0", "not rejected and toxic = 1")]).first()
    assert hits / (hits + false) > 0.95 and hits / (hits + missed) > 0.85


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    y = np.stack([rng.integers(0, 2, n), np.zeros(n, int)], axis=1)
    y[:, 1] = y[:, 0]
    row, h = np.arange(n), np.where(y[:, 0] == 1, 11, 12).astype(np.uint64)
    models, _ = toxicity.fit_chain(row, h, np.zeros((n, toxicity.FORMS)), y)
    assert len(models[1].weights) == len(models[1].words) + toxicity.FORMS + 1 + 1
    assert models[1].weights[-2] > 0.1
    p = toxicity.predict_chain(models, row, h, np.zeros((n, toxicity.FORMS)))
    assert ((p[:, 1] > 0.5) == (y[:, 1] == 1)).all()


def test_chain_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(documents(spark), labels)
    assert got.columns[-1] == "toxicity_" and got.count() == len(ROWS)
    assert toxicity.toxic_documents(empty(spark), labels).count() == 0
    none = toxicity.toxic_documents(documents(spark), labels.limit(0)).select(
        F.col("toxicity_.rejected").alias("r"), F.col("toxicity_.toxic").alias("p")).distinct()
    assert none.collect() == [(False, 0.0)]


# repeats among texts without id

def test_texts_without_id_and_with_equal_short_hashes_stay_apart(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = spark.range(400_000).select(F.expr(f"""if(id % 2 = 0, concat('{passage} u', id),
        array_join(transform(sequence(0, 24), i -> concat('q', id, '_', i)), ' '))""").alias("text"))
    pairs = texts.groupBy(F.hash("text")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where(
        "a like 'p0 %' and b like 'q%'").collect()
    assert pairs
    rows = [(1, passage)] + [(None, t) for r in pairs for t in (r.a, r.b)]
    got = {r.kept for r in repeats.without_repeats(documents(spark, rows, extra=False)).collect()}
    assert got == {passage} | {r.a.split()[-1] for r in pairs} | {r.b for r in pairs}


# licences

@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.LicenceModel(spark)


def test_licence_families(spark, licence_model):
    rows = [(i, f"first line\n{t}\nlast line") for i, t in enumerate(
        [licences.NOTICES[f][0] for f in sorted(licences.NOTICES)])]
    got = {r.id: r.family for r in licences.licence_paragraphs(
        documents(spark, rows), licence_model).collect()}
    assert got == dict(enumerate(sorted(licences.NOTICES)))
    others = [(i, t) for i, t in enumerate([
        "Licensed under the Foo License, Version 9.", "you need a license to fish here",
        "no permission was asked for this", "the license of the taxi", "", None])]
    got = licences.licence_paragraphs(documents(spark, others), licence_model)
    assert {r.family for r in got.collect()} == {licences.UNKNOWN}


WRAPPED = {
    "MIT": """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice shall be included in all copies.""",
    "GPL": """# tool.py: part of a tool
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
import os""",
    "BSD": """/*
 * Copyright (c) 2001, The Authors
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice.
 */""",
    "MPL": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */""",
    "Unlicense": "// This is free and unencumbered software released into the public\r\n// domain.\r\n",
}


def test_wrapped_notices(spark, licence_model):
    rows = [(i, WRAPPED[f]) for i, f in enumerate(WRAPPED)]
    rows += [(i, t) for i, t in rows]      # each row counts
    rows += [(9, "some prose\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nmore prose")]
    found = licences.licence_paragraphs(documents(spark, rows), licence_model).where(
        F.col("family") != licences.UNKNOWN).groupBy("id", "family").count().collect()
    assert {(r.id, r.family, r["count"]) for r in found} == {
        (i, f, 2) for i, f in enumerate(WRAPPED)} | {(9, "MIT", 1), (9, "CC-BY", 1)}


def test_licences_of_held_out_variants(spark, licence_model):
    """Accuracy on variants that the model was not fitted on."""
    held = licences.training_paragraphs(spark).where("held")
    best = licence_model.probabilities(held).select("family", "best.*").toDF("truth", "p", "family")
    right = best.where("truth = family").count() / best.count()
    assert right > 0.9


def test_licences_in_forms_and_names_not_trained_on(spark, licence_model):
    """Whole sentences that no notice was made from, and licences of no family."""
    forms = ("This project is made available under the {}, see the file in the root folder for details.",
             "You can use all of the code under the {} if you like.",
             "Everything in here is provided under the {}; contributions are welcome.")
    names = {f: n for f, ns in licences.NAMES.items() for n in ns[-1:]}
    foreign = ["SIL Open Font License", "Server Side Public License", "Open Database License",
               "PostgreSQL License", "Sleepycat License", "Common Public License", "Company License"]
    rows = [(f, form.format(n)) for f, n in names.items() for form in forms]
    rows += [(licences.UNKNOWN, form.format(n)) for n in foreign for form in forms]
    rows += [(licences.UNKNOWN, t) for t in (
        "The driver lost his licence after the accident.", "A fishing license costs ten dollars.",
        "This film was licensed for three countries.", "Ask the owner for permission to copy the keys.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.id: r.family for r in licences.licence_paragraphs(docs, licence_model).collect()}
    got = [(f, found.get(i, licences.UNKNOWN)) for i, (f, _) in enumerate(rows)]
    granted = [p for p in got if p[0] != licences.UNKNOWN]
    named = [p for p in got if p[1] != licences.UNKNOWN]
    hits = sum(a == b for a, b in granted)
    print("recall", hits / len(granted), "precision", hits / len(named),
          [p for p in got if p[0] != p[1]])
    assert hits / len(granted) >= 0.8 and hits / len(named) >= 0.9
    assert sum(b == licences.UNKNOWN for a, b in got if a == licences.UNKNOWN) >= 0.9 * (len(rows) - len(granted))


def test_licences_of_awkward_rows(spark):
    got = {(r.doc_id, r.families) for r in licences.document_licences(documents(spark)).collect()}
    assert (11, "MIT") in got and (3, "") in got and (None, "") in got
    assert licences.document_licences(empty(spark)).count() == 0
