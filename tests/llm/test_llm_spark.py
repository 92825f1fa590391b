"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard, materialise, ppm, stringkernel
from quern.llm.common import with_row_number
from quern.llm.components import components
from quern.llm.exact_dedup import DigestIndex, dedup_exact
from quern.llm.feistel import permute, permute_array
from quern.llm.jaccard import near_groups
from quern.llm.licenses import scan
from quern.llm.materialise import read_shards, write_documents
from quern.llm.packing import pack, pack_documents
from quern.llm.quality import clean, quality_rules
from quern.llm.sentencepiece_trie import decode, encode, read_model
from quern.llm.sharding import shard
from quern.llm.stringkernel import identify, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(4000))
ROWS = [
    (1, "Alpha beta gamma", "en", "s0", 16),
    (2, "Alpha beta gamma", "en", "s0", 16),
    (2, "Alpha beta gamma", "en", "s0", 16),
    (3, None, None, None, None),
    (4, "", "de", "s1", 0),
    (5, " \n\t ", "de", None, 4),
    (None, "No id here", "fr", "s1", 10),
    (7, LONG, "en", "s0", len(LONG)),
    (8, LONG + " end", "en", "s0", len(LONG) + 4),
    (9, "ünï ☃   x", "fr", "s2", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    for c in "\x0b\x0c\t\n\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_permutation_columns_equal_arrays(spark):
    for n in (1, 2, 3, 17, 100):
        got = [r[0] for r in spark.range(n).select(permute(F.col("id"), F.lit(n).cast("long"), 5)).collect()]
        assert got == permute_array(np.arange(n), n, 5).tolist()


def test_row_numbers_are_gapless(docs):
    got = with_row_number(docs, ["doc_id", "text"], 4).select("row_no", "n_rows").collect()
    assert sorted(r["row_no"] for r in got) == list(range(len(ROWS))) and {r["n_rows"] for r in got} == {len(ROWS)}


def test_shard_counts_and_slots(docs, none):
    got = shard(docs.withColumn("slot", F.lit("clash")), ["doc_id", "text"], 3).select("shard", "slot").collect()
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min(by.values()) <= 1
    for k, n in by.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    again = shard(docs.repartition(3), ["doc_id", "text"], 3).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(map(str, shard(docs, ["doc_id", "text"], 3).select("doc_id", "text", "shard", "slot").collect()))
    assert shard(none, ["doc_id", "text"], 3).count() == 0


def test_exact_dedup(docs, none, spark):
    got = dedup_exact(docs.withColumn("digest", F.lit("clash"))).collect()
    assert len(got) == len(ROWS)
    by = {r["text_sha256"]: r for r in got}
    assert {(r["keep_id"], r["group_size"]) for r in by.values()} == {(2, 3), (4, 2), (5, 1), (None, 1), (7, 1), (8, 1), (9, 1)}
    assert [r["kept"] for r in got if r["doc_id"] == 1] == [False]
    assert dedup_exact(none).count() == 0


def test_digest_index_persists(spark, docs):
    index = DigestIndex(spark, buckets=3)
    index.add(docs, "doc_id", "text").collect()
    n = index.read().count()
    later = index.add(spark.createDataFrame([(99, "Alpha beta gamma"), (98, "new")], "doc_id long, text string"), "doc_id", "text").collect()
    assert index.read().count() == n + 1
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later} == {(99, 2, False), (98, 98, True)}


def test_hot_texts_are_joined_apart(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(600)]
    got = dedup_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600 and sum(r["kept"] for r in got) == 201
    assert {r["keep_id"] for r in got if rows[r["doc_id"]][1] == "same"} == {599}


def brute_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, none):
    many = " ".join(f"a{i % 29} b{i % 31}" for i in range(900)) + " " + " ".join(f"a{i % 29} b{i % 31}" for i in range(900))
    texts = [None, "", " \n ", "a b", "a b c a b c", "x x x x", "l1\nl1\n l1\n\n\nl1 ", "# $ <a> |b", "a b c d e a b c", many, LONG]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert quality_rules(none).count() == 0


def test_frequent_lines_go_and_copies_stay(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Same Line here\n{body(i)}", "h") for i in range(20)]
    copies = [(100 + i, f"first part {body('c')}\nsecond {body('d')}", "h") for i in range(20)]
    hollow = [(200, "Same line   here\n" * 30 + body(7), "h"), (201, None, None), (None, body("n"), None), (202, body("n"), None)]
    df = spark.createDataFrame(rows + copies + hollow, "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert all(verdict[i]["kept"] and verdict[i]["removed_words"] == 3 for i in range(20))
    assert all(verdict[100 + i]["kept"] and verdict[100 + i]["removed_words"] == 0 for i in range(20))
    assert not verdict[200]["kept"] and not verdict[201]["kept"] and verdict[None]["kept"]
    left = {r["doc_id"]: r["text"] for r in clean(df).collect()}
    assert left[3] == body(3) and left[100] == copies[0][1] and 200 not in left and left[None] == body("n")


def test_headers_and_footers_of_two_lines_go(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    heads = [(i, f"Site name\nMain menu\n{body(i)}", "head") for i in range(20)]
    feet = [(100 + i, f"{body(i)}\nAll rights\nContact us", "foot") for i in range(20)]
    copies = [(200 + i, f"first {body('c')}\nSecond {body('d')}" + " " * i, "copy") for i in range(20)]
    hollow = [(300 + i, "one two three " * 2 + "\n" + " ".join(f"menu{k}" for k in range(60)) + f"\nown{i} text", "hollow") for i in range(20)]
    df = spark.createDataFrame(heads + feet + copies + hollow, "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert all(verdict[i]["kept"] and verdict[i]["removed_words"] == 4 for i in [*range(20), *range(100, 120)])
    assert all(verdict[200 + i]["kept"] and verdict[200 + i]["removed_words"] == 0 for i in range(20))
    assert not any(verdict[300 + i]["base_failed"] or verdict[300 + i]["kept"] for i in range(20))
    left = {r["doc_id"]: r["text"] for r in clean(df).collect()}
    assert all(left[i] == left[100 + i] == body(i) for i in range(20)) and left[205] == copies[5][1]


def test_language_id(spark, docs, none):
    model = train(docs.select("text", "lang"))
    got = identify(docs.withColumn("kind", F.lit("x")), model, "text", ["doc_id", "kind"]).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (3, 4, 5)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert by[1]["lang_pred"] in {"en", "fr"}
    nothing = train(none.select("text", "lang"))
    assert {r["lang_pred"] for r in identify(docs, nothing, "text", ["doc_id"]).collect()} == {"und"}
    assert identify(none, model, "text", ["doc_id"]).count() == 0


def test_more_languages_than_can_be_learned_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(stringkernel, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        train(docs.select("text", "lang"))


def test_encoding_round_trip(docs, none):
    model = read_model()
    ids = encode(docs, "text", ["doc_id", "lang"], model)
    back = decode(ids, "ids", ["doc_id", "n_ids"], model).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((r[0], r[1] or "")) for r in ROWS)
    assert encode(none, "text", ["doc_id"], model).count() == 0


def brute_groups(rows):
    sets = []
    for _, text in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("hot, block, flush", [(256, 2048, 1 << 19), (3, 4, 1 << 11)])
def test_near_groups_equal_brute_force(spark, monkeypatch, hot, block, flush):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    monkeypatch.setattr(jaccard, "SAMPLE_MOD", 1)
    monkeypatch.setattr(jaccard, "COMMON_AT", 3)
    rows = []
    passage = " ".join(f"shared{k}" for k in range(60))
    for g in range(14):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(1, 700)))]
        for _ in range(int(rng.integers(1, 7))):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, 1 + len(text) // 30))):
                text[at] = f"e{rng.integers(1000)}"
            rows.append((len(rows), " ".join(text) + (" " + passage if g % 3 == 0 else "")))
    # A chain: neighbours are similar, ends are not.
    chain = [f"c{k}" for k in range(400)]
    for step in range(8):
        rows.append((len(rows), " ".join(chain[: 400 - 25 * step])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "a B"), (len(rows) + 4, "A\tb"), (len(rows) + 5, rows[0][1])]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(rows))


def test_near_groups_with_odd_rows(docs, none):
    got = near_groups(docs.withColumn("key", F.lit("clash"))).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[8]["component_id"] == 7 and by[3]["component_id"] == 3 and by[4]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert near_groups(none).count() == 0


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_scoring_equals_the_definition(spark, docs, none, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_WORDS", 2)
    learned = docs.filter("doc_id is null or doc_id % 5 <> 1")
    got = ppm.score_texts(docs, learned.select("text"), ["doc_id", "source"]).collect()
    assert len(got) == len(ROWS)
    token = lambda t: [*(w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)), None]
    c = Counter(w for r in ROWS if r[0] is None or r[0] % 5 != 1 for w in token(r[1]))
    n, v = sum(c.values()), len(c)
    by = {r["doc_id"]: r for r in got}
    for doc, text, *_ in ROWS:
        t = token(text)
        r = by[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0
    assert ppm.score_texts(none, none.select("text"), ["doc_id"]).count() == 0
    assert ppm.score_texts(docs, none.select("text"), ["doc_id"]).filter("n_known > 0").count() == 0


def test_bounded_model_keeps_common_contexts(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", 40)
    grams = ppm.train(docs.select("text"))
    assert all(len(set((codes >> 9).tolist())) <= 40 for codes, _ in grams)
    assert ppm.Unfolded(grams).score(b"word1 word2") < 0


@pytest.mark.parametrize("contexts, grams", [(40, 1 << 20), (1 << 16, 100), (1, 1 << 20), (1 << 16, 5)])
def test_the_bound_of_the_model_leaves_scores_as_they_are(spark, docs, monkeypatch, contexts, grams):
    learned = [r[1] for r in ROWS if r[0] != 1]
    trie = ppm.CountTrie()
    for text in learned:
        for before, symbol in ppm._walk(text, ppm.ORDER):
            trie.add(before, symbol)
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", contexts)
    monkeypatch.setattr(ppm, "MAX_GRAMS", grams)
    other = [(20, "zebra \u00fc \u4e2d quiz word12 Alpha"), (21, "\x00\x01")]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(other, "doc_id long, text string"))
    got = ppm.score_texts(texts, spark.createDataFrame([(t,) for t in learned], "text string"), ["doc_id"]).collect()
    text_of = {r[0]: r[1] for r in ROWS} | dict(other)
    assert len(got) == len(ROWS) + 2
    for r in got:
        wanted = sum(trie.log10(before, symbol) for before, symbol in ppm._walk(text_of[r["doc_id"]], ppm.ORDER))
        assert r["score"] == pytest.approx(wanted, rel=1e-4)


def test_packing(docs, none, spark):
    got = pack_documents(docs.withColumn("bin", F.lit("clash")), capacity=64).collect()
    lengths = Counter()
    bins = {}
    for r in got:
        lengths[r["doc_id"]] += r["length"]
        bins.setdefault(r["bin"], []).append(r)
    assert lengths == Counter({i: sum(len(words(t)) + 1 for d, t, *_ in ROWS if d == i) for i in {r[0] for r in ROWS}})
    source = {r[0]: r[3] for r in ROWS}
    for held in bins.values():
        assert sum(r["length"] for r in held) <= 64
        named = [source[r["doc_id"]] for r in held if source[r["doc_id"]]]
        assert len(named) == len(set(named))
    assert pack_documents(none).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (2, -3, "a", "k"), (3, 0, "a", None), (4, 5, None, "k")], "id long, n long, s string, c string")
    assert pack(odd, "id", "n", "s", "c", 8).count() == 4


def test_packing_in_runs_keeps_every_item(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("id"), F.lit(3).alias("n"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("c"))
    got = pack(rows, "id", "n", "s", "c", 10, group_items=100)
    sums = got.groupBy("bin").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.max("n")).collect()[0]
    assert tuple(sums) == (9000, 9)


def test_shards_round_trip(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(source)
    folder = f"file://{tmp_path}/shards"
    rows = write_documents(spark.read.parquet(source).withColumn("ids", F.lit("clash")).withColumn("slot", F.lit(1)), folder, length=64, per_shard=50).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    bpe, end = materialise.Bpe(open(materialise.RANKS_PATH, "rb").read()).encoding, 50256
    ids = dict(read_shards(folder, 64))
    assert len(ids) == len(rows) and len({r["shard"] for r in rows}) > 3
    counts = Counter()
    for r in rows:
        data = ids[r["slot"]]
        assert zlib.crc32(data.tobytes()) == r["crc32"] and r["slot"] == r["row"] + sum(x["shard"] < r["shard"] for x in rows)
        assert (data[r["n_ids"] :] == end + 1).all()
        counts[r["doc_id"]] += r["n_ids"]
    assert counts == Counter({i: sum(len(bpe.encode_ordinary(t or "")) + 1 for d, t, *_ in ROWS if d == i) for i in {r[0] for r in ROWS}})
    seven = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["seq"])
    assert [int(x) for r in seven for x in ids[r["slot"]][: r["n_ids"]]] == [*bpe.encode_ordinary(LONG), end]
    assert [s for s, _ in read_shards(folder, 64, start=57)] == list(range(57, len(rows)))
    # A run that broke off: one shard is lost, the others stay as they are.
    shards = sorted((tmp_path / "shards").glob("shard-*.bin"))
    before, whole = shards[-1].stat().st_mtime_ns, [x.read_bytes() for x in shards]
    shards[0].unlink()
    again = write_documents(spark.read.parquet(source), folder, length=64, per_shard=50).collect()
    assert sorted(again, key=repr) == sorted(rows, key=repr) and [x.read_bytes() for x in shards] == whole and shards[-1].stat().st_mtime_ns == before
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert write_documents(spark.read.parquet(str(tmp_path / "none")), f"file://{tmp_path}/no").count() == 0


def test_license_scan(spark):
    rows = [
        ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
        ("a/b/c.py", "x = 1"),
        ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/d.py", "code\nLicensed under CC BY-NC 4.0.\ncode"),
        ("e.py", None),
        (None, ""),
        ("a/b/c.py", "x = 1"),
        ("z/license-notes.txt", "nothing about copyright in a long line of other words that match no notice at all here"),
        ("z/y.py", ""),
    ]
    got = scan(spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")).collect()
    assert len(got) == len(rows)
    found = {r["path"]: (r["license"], r["license_from"]) for r in got}
    assert found == {"LICENSE": ("MIT", None), "a/b/c.py": ("GPL-3.0", "a"), "a/COPYING": ("GPL-3.0", None), "a/b/d.py": ("CC-BY-NC-4.0", None), "e.py": ("MIT", ""), None: (None, None), "z/license-notes.txt": ("MIT", ""), "z/y.py": ("MIT", "")}
    assert scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_usual_headers_are_found(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
    mark = lambda text, m: "\n".join(f"{m} {x}" for x in text.split("\n")) + "\n\ncode()"
    wanted = {
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
        "GPL-3.0": mark(gpl, "#"),
        "GPL-2.0": mark(gpl.replace("version 3", "version 2").replace("software:", "software;"), "//"),
        "LGPL-2.1": "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;",
        "BSD-2-Clause": "# spdx-license-identifier: BSD-2-Clause",
        "MIT": mark(mit, "//"),
        "Apache-2.0": mark(apache, " *"),
        "CC-BY-SA-4.0": "words before. Licensed under CC BY-SA 4.0. words after",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    }
    rows = [(k, v) for k, v in wanted.items()] + [("MIT/in-a-line", "We made it for fun and it is Released under the MIT License. Enjoy it as much as we do, and write to us")]
    none = ["She gave him permission to leave the house under one condition.", "The license of the driver was taken away. He walked home.", "SPDX-License-Identifier: LicenseRef-own", "All rights reserved under copyright law.", "It is under the license.", "copyright 2020 by the author of this file"]
    rows += [(f"none/{i}", x) for i, x in enumerate(none)]
    got = {r["path"]: r["own_license"] for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {k: k for k in wanted} | {"MIT/in-a-line": "MIT"} | {f"none/{i}": None for i in range(len(none))}


def test_kept_columns_named_like_outputs_are_left_out(spark, docs, none):
    clash = docs.selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS ids", "4 AS n_ids", "5 AS n_tokens", "6 AS tail", "7 AS codes")
    model = train(docs.select("text", "lang"))
    found = identify(clash, model, "text", ["doc_id", "score", "lang_pred", "ids"])
    assert found.columns == ["doc_id", "ids", "lang_pred", "score"] and found.count() == len(ROWS)
    coded = encode(clash, "text", ["doc_id", "ids", "N_IDS", "score"], read_model())
    assert coded.columns == ["doc_id", "score", "ids", "n_ids"] and coded.count() == len(ROWS)
    assert decode(coded.withColumn("text", F.lit("x")), "ids", ["doc_id", "text"], read_model()).columns == ["doc_id", "text"]
    scored = ppm.score_texts(clash, docs.select("text"), ["doc_id", "score", "tail", "ids", "n_tokens", "codes"])
    assert scored.columns == ["doc_id", "ids", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and scored.count() == len(ROWS)


def test_sharding_query_by_brute_force(spark, tmp_path):
    from quern.llm.sharding import op2_sharding

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["", None, "é", "same", "same", *(f"t{k}" for k in range(60))])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op2_sharding(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    slots = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots.setdefault(got[i]["shard"], []).append(got[i]["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_sample_of_a_language_is_that_of_the_smallest_hashes(spark):
    rows = [(f"text number {k}", "en" if k % 3 else "de") for k in range(400)] * 2
    df = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    got = {(r["lang"], r["h"]) for r in stringkernel._sample(df, 20).collect()}
    hashes = df.selectExpr("lang", "xxhash64(text) AS h").distinct().collect()
    assert got == {(lang, h) for lang in ("en", "de") for h in sorted(r["h"] for r in hashes if r["lang"] == lang)[:20]}


def test_training_never_holds_the_presence_matrix(spark):
    texts = [(f"{a}{b}{c} {a * 2}{c} {b}{a}{lang}", lang) for lang in ("de", "en", "fr", "pl") for a in "abcdefg" for b in "hijklm" for c in "nopqrs"]
    df = spark.createDataFrame(texts, "text string, lang string")
    tracemalloc.start()
    names, weights = train(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["de", "en", "fr", "pl"] and weights.shape == (stringkernel.SLOTS + 1, 4)
    # 960 texts are sampled: 126 MB as float32, held twice before.
    assert peak < 100 << 20
